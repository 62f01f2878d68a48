import hashlib
import random

import pytest

from pyspark.sql import functions as F

from tessera.llm import fingerprint, neardup
from tessera.operators.graph import components

from ._brute import groups, shingle_set


def corpus(seed=1):
    """Copies, near copies, chains, shared passages and junk."""
    rng = random.Random(seed)

    def words(n):
        return [f"w{rng.randint(0, 10 ** 6)}" for _ in range(n)]

    texts = {}

    def add(w):
        texts[len(texts)] = w if isinstance(w, str) or w is None else " ".join(w)

    passage = words(60)
    for _ in range(60):
        add(words(rng.randint(1, 200)))
    for _ in range(40):
        add(words(rng.randint(5, 60)) + passage + words(rng.randint(5, 60)))
    for _ in range(12):
        base = words(rng.randint(40, 300))
        for _ in range(rng.randint(2, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10 ** 6)}"
            add(w)
    chain = words(200)
    for _ in range(15):
        add(chain)
        chain = chain[8:] + words(8)
    for t in ["", None, "  ", "one", "One", "one two three", "ONE  two\tthree", "one two three four"]:
        add(t)
    for _ in range(30):
        add(texts[3])
    return texts


def test_near_duplicates_match_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, component string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df.repartition(7)).collect()}
    want = groups(texts)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingle_set(t)) for i, t in texts.items())
    assert all(got[i].kept == (want[i] == i) for i in texts)
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in texts if want[i] == i)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(300):
        w = list(base)
        for _ in range(12):
            w[rng.randrange(400)] = f"e{rng.randint(0, 10 ** 9)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == groups(texts)


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    df = spark.createDataFrame([(None, long), (7, long), (7, long), (3, other), (None, "alone here"),
                                (None, "alone here"), (9, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (3, 3, True), (None, None, True),
                          (None, None, False), (9, 9, True), (None, None, True)], key=str)
    kept = [tuple(r) for r in neardup.drop_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted([(7, long), (3, other), (None, "alone here"), (9, None), (None, None)], key=str)


def test_near_copies_without_ids_leave_one(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]

    def variant():
        w = list(base)
        w[rng.randrange(200)] = f"e{rng.randint(0, 10 ** 9)}"
        return " ".join(w)

    rows = [(None, variant()) for _ in range(5)] + [(i, " ".join(f"u{i}x{j}" for j in range(40))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = neardup.drop_near_duplicates(df).collect()
    assert sum(r.doc_id is None for r in kept) == 1 and sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 3]
    # one id for two similar texts: one row of the group stays
    both = spark.createDataFrame([(5, variant()), (5, variant()), (9, variant())], "doc_id long, text string")
    assert [r.doc_id for r in neardup.drop_near_duplicates(both).collect()] == [5]


def test_near_duplicates_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 500)] + [(1000, 1001), (1001, 1000), (2000, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(501)}, 1000: 1000, 1001: 1000, 2000: 2000}


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_fingerprint_edits(spark, ranges):
    rng = random.Random(ranges)
    texts = {i * 3: t for i, t in corpus(2).items() if i < 150}
    texts |= {10 ** 12: "é" * 7, -5: "", -9: "a 💡 b c d e f g"}
    rows = list(texts.items())
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, range string")
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(df.repartition(4), ranges=ranges).collect()}
    assert set(got) == set(texts)
    order = sorted(texts, reverse=True)
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}

    def near(a, b):
        return sum(a[i:i + 8] == b[i:i + 8] for i in range(0, len(a), 8)) / (len(a) // 8)

    for k, i in enumerate(order):
        own, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[:len(own) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == prints[i]
        assert r.near_next == near(prints[i], prints[order[(k + 1) % len(order)]])
        assert r.near_edited == near(r.fingerprint, r.edited_fingerprint)
        if edited == own:
            assert r.edited_fingerprint == r.fingerprint


@pytest.mark.parametrize("ranges", [2, 16])
def test_fingerprint_of_repeated_ids_and_equal_rows(spark, ranges):
    """A third of the rows without an id, a third all equal: ranges stay even, and
    every row is compared with the one after it."""
    rows = [(None, f"no id {i}") for i in range(200)] + [(7, "the same text")] * 200 + [(i, f"text {i} é") for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprint.fingerprint_edits(df, ranges=ranges)
    parts = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) <= 2.2 * 600 / ranges
    out = got.collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    texts = {i: t for i, t in rows if i is not None}
    order = sorted(set(texts), reverse=True)
    follows = {i: texts[j] for i, j in zip(order, order[1:])}
    for r in out:
        if r.doc_id in texts and r.doc_id != 7:
            own, half = texts[r.doc_id], len(texts[r.doc_id]) // 2
            edited = own[:len(own) - half] + follows[r.doc_id][:half]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    # of the equal rows all but the last are followed by an equal one
    assert sum(r.near_next == 1.0 for r in out if r.doc_id == 7) == 199
    assert sum(r.near_next == 1.0 for r in out if r.doc_id is None) == 0


def test_fingerprint_of_a_text_longer_than_a_group(spark):
    from tessera.llm import _text
    long = " ".join(f"w{i}" for i in range(150_000))
    assert len(long) > _text.GROUP_BYTES
    rows = [(3, long), (2, "a b c d e f g"), (1, long.replace("w77 ", "x ")), (0, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(df, ranges=3, links=fingerprint.band_groups(df)).collect()}
    assert got[3].n_chars == len(long) and got[3].group_id == got[1].group_id is not None and got[3].leader == 1
    a, b = shingle_set(long), shingle_set(rows[2][1])
    assert abs(got[3].jaccard - len(a & b) / len(a | b)) < 1e-12
    edited = rows[2][1][:len(rows[2][1]) - len(rows[2][1]) // 2] + "one"
    assert got[1].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(4, "a b c d e f")], "doc_id long, text string")
    r = fingerprint.fingerprint_edits(one, ranges=8).first()
    assert r.near_next == 1.0 and r.n_chars == 11
    assert fingerprint.fingerprint_edits(one.where("false")).count() == 0
    ties = spark.createDataFrame([(4, "x"), (4, "x"), (None, "y"), (None, None)], "doc_id long, text string")
    assert fingerprint.fingerprint_edits(ties, ranges=3).count() == 4


def test_band_links(spark):
    texts = corpus(3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links = fingerprint.band_links(df).collect()
    sets = {i: shingle_set(t) for i, t in texts.items()}
    for r in links:
        want = len(sets[r.doc_id] & sets[r.leader]) / len(sets[r.doc_id] | sets[r.leader])
        assert abs(r.jaccard - want) < 1e-12 and want >= 0.75 and r.leader < r.doc_id
    # every document with an exact copy of a smaller id is linked
    linked = {r.doc_id for r in links}
    first = {}
    for i, s in sets.items():
        if s and s in first:
            assert i in linked
        first.setdefault(s, i)


def test_band_pairs_that_no_leader_settles(spark):
    rng = random.Random(12)
    # chains of variants of one core, many of them too far from the least id of their band
    core = [f"c{i}" for i in range(300)]

    def variant(base, at, n):
        return base[:at] + [f"e{rng.randint(0, 10 ** 9)}" for _ in range(n)] + base[at + n:]

    texts = {}
    for i in range(40):
        texts[i] = " ".join(variant(core, (i * 7) % 250, 25))
    for i in range(40, 60, 2):
        w = variant(variant(core, (i * 11) % 120, 30), 150 + (i * 5) % 100, 30)
        texts[i], texts[i + 1] = " ".join(w), " ".join(w[:-1] + [f"z{i}"])
    assert {i: g for i, g in groups(texts).items() if g != i}
    texts[99] = None
    df = spark.createDataFrame(list(texts.items()) + [(None, texts[0])], "doc_id long, text string")
    want = groups(texts)
    out = fingerprint.fingerprint_edits(df, ranges=4, links=fingerprint.band_groups(df)).collect()
    assert len(out) == len(texts) + 1
    got = {r.doc_id: r for r in out}
    assert {i: got[i].group_id for i in texts} == want and got[None].group_id is None
    sets = {i: shingle_set(t) for i, t in texts.items()}
    for i in texts:
        if got[i].leader is not None:
            assert want[i] <= got[i].leader < i
            a, b = sets[i], sets[got[i].leader]
            assert abs(got[i].jaccard - len(a & b) / len(a | b)) < 1e-12 and got[i].jaccard >= 0.75
