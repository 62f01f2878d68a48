import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import codes, trie, vectors
from tessera.llm._ranges import following, ranged, running



@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Small tables stay in as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# -- ordered ranges ---------------------------------------------------------


def test_running_sums_and_following_rows_cross_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.randint(-5, 5)) for i in range(400)]
    df = ranged(spark.createDataFrame(rows, "g string, i long, v long").repartition(7), ["g", "i"])
    assert df.select("_part").distinct().count() > 3
    got = {(r.g, r.i): (r.s, r.n) for r in running(df, ["g"], ["i"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    nxt = {(r.g, r.i): r.after for r in following(df, ["g"], "i", "after").collect()}
    for g in (None, "a", "b"):
        own, s = [r for r in rows if r[0] == g], 0
        for n, (_, i, v) in enumerate(own):
            s += v
            assert got[g, i] == (s, n + 1)
            assert nxt[g, i] == (own[n + 1][1] if n + 1 < len(own) else None)


# -- prefix trie --------------------------------------------------------------


def brute_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0,
                                  hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = convs.get(c - int(math.fmod(c, 100)), [])
        whole[c] = tuple((r, t) for _, r, t in first[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        leaves, saving = (0 if k in kids else 1), (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        for x in kids.get(k, []):
            more = below(x)
            leaves, saving = leaves + more[0], saving + more[1]
        return leaves, saving

    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == k)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *below(k),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def built(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = trie.prefix_trie(df.selectExpr("*", "1 AS conv", "'x' AS depth", "0 AS `a.b`", "2 AS e"))
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)


def test_trie_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(11)
    rows = []
    for c in [*range(-120, 330, 3), 100, 200, 250, 10 ** 12 + 7]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]),
                         rng.choice([None, "", "a", "b", "é" * 5, "long " * 400])))
    # equal rows, a row without an id, ids whose turns all lie in a head that is absent
    rows += [(77, 1, "user", "same")] * 40 + [(None, 0, "user", "x")] * 5 + [(9901, 0, "user", "y"), (9902, 0, "u", "z")]
    assert built(spark, rows) == brute_trie(rows)


def test_trie_of_one_long_conversation_and_of_nothing(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(300)] + [(c, 0, "user", "hi") for c in range(100, 130)]
    assert built(spark, rows) == brute_trie(rows)
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "a", "b")]) == []


@pytest.mark.parametrize("shuffled", [False, True])
def test_list_ranking_over_many_ranges(spark, shuffled):
    """A list whose order has nothing to do with its names needs the coins."""
    n = 3000
    names = [(i // 2, i % 2) for i in range(n)]
    if shuffled:
        random.Random(5).shuffle(names)
    rows = [(*names[i], *(names[i + 1] if i + 1 < n else (None, None))) for i in range(n)]
    arcs = spark.createDataFrame(rows, "c long, e long, nc long, ne long")
    got = {(r.c, r.e): r["rank"] for r in trie.list_rank(arcs, per_task=200).collect()}
    assert got == {x: i for i, x in enumerate(names)}


def test_position_sums_over_blocks(spark):
    df = spark.range(500).selectExpr("id AS p", "id % 7 AS v").repartition(6)
    got = {r.p: r.v_sum for r in trie.position_sums(df, "p", ["v"], block=6).collect()}
    assert got == {i: sum(j % 7 for j in range(i + 1)) for i in range(500)}


# -- embedding near-duplicates ------------------------------------------------


def brute_links(rows, cosine=vectors.COSINE):
    """Links, components and kept flags by row number."""
    ok = {}
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float)
    n, comp = [0] * len(rows), list(range(len(rows)))
    at = sorted(ok)
    for k, i in enumerate(at):
        for j in at[k + 1:]:
            a, b = ok[i], ok[j]
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                n[i] += 1
                n[j] += 1
                x, y = comp[i], comp[j]
                if x != y:
                    comp = [min(x, y) if c in (x, y) else c for c in comp]
    out = []
    for i, (vec_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        least = min(ids) if ids and i in ok else vec_id
        out.append((vec_id, n[i], least))
    return sorted(out, key=str)


def planted(seed=4):
    rng = np.random.default_rng(seed)

    def near(x, much, count):
        return [(x + rng.normal(0, much, len(x))).tolist() for _ in range(count)]

    rows, base = [], rng.normal(0, 1, (900, 24))
    rows += [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(2000 + i, v, 0) for i, v in enumerate(near(base[0], .12, 330))]        # larger than a block
    rows += [(3000 + i, v, 1) for i, v in enumerate(near(base[1], .27, 300))]        # partly beyond half the angle
    rows += [(4000 + i, v, 2) for i, v in enumerate(near(base[2], .15, 25))]
    rows += [(5000 + i, base[5 + 3 * i].tolist(), 2) for i in range(20)]             # exact copies, same label
    rows += [(6000 + i, base[3 * i].tolist(), 1) for i in range(20)]                 # same vectors, other label
    arc = rng.normal(0, 1, (2, 24))
    rows += [(7000 + i, (math.cos(i / 4) * arc[0] + math.sin(i / 4) * arc[1]).tolist(), 0) for i in range(8)]  # chain
    odd = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0] * 5]
    rows += [(8000 + i, v, 0) for i, v in enumerate(odd)] + [(8100, [2.0] * 5, 0), (8101, base[0].tolist(), None)]
    rows += [(None, v, 2) for v in near(base[2], .1, 4)] + [(7000, base[100].tolist(), 1)] * 2
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_vector_links_match_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS grp", "2 AS node", "'c' AS c", "0 AS `a.b`").repartition(5)
    got = vectors.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert not any(r.kept for r in got if r.vec_id is None)


def test_vectors_without_ids_keep_one_of_a_component(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 8)
    rows = [(None, (x + rng.normal(0, .01, 8)).tolist(), 1) for _ in range(5)] + [(None, (-x).tolist(), 1)] * 3
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_links for r in got) == [2, 2, 2, 4, 4, 4, 4, 4] and sum(r.kept for r in got) == 2
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    one = vectors.near_duplicates(spark.createDataFrame([(1, [1.0], 1), (2, None, None)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in one) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_audit_joins_components_that_the_descent_missed(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 16)
    rows = [(i, (x + rng.normal(0, .02, 16)).tolist(), 1) for i in range(6)]
    _, classes = vectors.vector_classes(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label")
    split = classes.selectExpr("node", "CASE WHEN least_id < 3 THEN 0L ELSE 1L END AS c", "grp", "unit")
    share, missed = vectors.audit(split, .93, 0)
    assert share == pytest.approx(12 / 30) and [tuple(r) for r in missed.collect()] == [(0, 1)]


# -- vector codes -------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((i is None, i or 0, v), i, lab) for i, v, lab in rows
                  if v and all(x is not None and math.isfinite(x) for x in v))
    kept = [(i, lab, [math.floor(4096 * x) for x in k[2]]) for k, i, lab in kept]
    w = len(kept[0][2]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, xs in own.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for (i, lab, _), c in zip(kept, cut):
        near = [nearest(c[p], books[p]) for p in range(parts)]
        coded.append((i, lab, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)))
    total = {}
    for _, lab, _, e in coded:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, code, e, total[lab], sha) for i, lab, code, e in coded), key=str)


def test_codes_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, .25, -.5, rng.uniform(-1, 1)]) for _ in range(16)], rng.choice([None, 1, 2]))
            for i in range(150)]
    rows += rows[:3] + [(None, rows[5][1], 1), (200, None, 1), (201, [], 2), (202, [float("nan")] * 16, 1),
                        (203, [1.0] * 15 + [None], 1), (204, [float("-inf")] * 16, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS ints", "0 AS code", "'z' AS x").repartition(4)
    got = codes.vector_codes(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_codes(rows)


def test_codes_of_few_odd_and_no_vectors(spark):
    few = [(2, [.1] * 16, 1), (1, [.9] * 16, None)]
    assert sorted(tuple(r) for r in codes.vector_codes(spark.createDataFrame(few, SCHEMA)).collect()) == brute_codes(few)
    assert codes.vector_codes(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    # length 10 in 8 parts of 2; another length and a component beyond the limit are left out
    odd = [(1, [.5] * 10, 1), (2, [.25] * 10, 1), (3, [.5] * 4, 1), (4, [1e30] * 10, 1)]
    got = codes.vector_codes(spark.createDataFrame(odd, SCHEMA)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(1, "00" * 8, 0), (2, "01" * 5 + "00" * 3, 0)]


def test_orchard_agrees_with_full_search():
    rng = np.random.default_rng(0)
    for k in (1, 2, 7, 16):
        x, book = rng.integers(-4, 5, (500, 3)), rng.integers(-4, 5, (k, 3))
        d = ((x[:, None] - book[None]) ** 2).sum(-1)
        near, best = codes.orchard(x, book)
        assert (near == d.argmin(1)).all() and (best == d.min(1)).all()
