import random
from collections import Counter

import pytest

from tessera.llm import lengths, packing, tokens

from ._brute import crc

tokenizers = pytest.importorskip("tokenizers")


def reference_ids(texts):
    t = tokenizers.Tokenizer.from_file(tokens.default_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def some_texts(n=300):
    rng = random.Random(8)
    parts = ["the ", "Word", "'s", "'LL", "don't ", "  ", "\n\n", "\t", "\x85", "\x1c", " ", " ",
             "é", "ß", "ñ", "日本", "💡", "👩‍👩‍👧", "٣", "½", "123", "4567", "<|endoftext|>", "_", "\\", "\x00", "🇫🇷", "़"]
    return [None, "", " ", "<|endoftext|>"] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_tokenizer_file():
    enc, texts = tokens.encoder(tokens.default_path()), some_texts()
    assert [enc.ids(t) for t in texts] == reference_ids(texts)


def test_ids_of_test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text for r in rows]
    enc = tokens.encoder(tokens.default_path())
    assert [enc.ids(t) for t in texts] == reference_ids(texts)


def test_another_split_goes_to_the_tokenizer(tmp_path):
    """A file that splits otherwise is not read by the fast path."""
    import json
    spec = json.load(open(tokens.default_path(), encoding="utf-8"))
    assert tokens.plain_bytes(spec)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert not tokens.plain_bytes(spec)
    other, plain = tokens.encoder(str(path)), tokens.encoder(tokens.default_path())
    want = tokenizers.Tokenizer.from_file(str(path)).encode("hello there", add_special_tokens=False).ids
    assert other.ids("hello there") == want != plain.ids("hello there")


def test_texts_longer_than_a_group(spark):
    """One text of several groups' length among short ones."""
    from tessera.llm import _text
    long = " ".join(f"word{i % 5000}" for i in range(120_000))
    assert len(long) > 2 * _text.GROUP_BYTES
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string").repartition(2)
    n = {i: len(x) for i, x in zip((1, 2, 3), reference_ids([long, "short", None]))}
    hist = {r["length"]: r.n_docs for r in lengths.length_histogram(df).collect()}
    assert hist == {x: 1 for x in n.values()}
    out = packing.pack_documents(df).collect()
    for i in n:
        own = sorted((r.start, r.length) for r in out if r.doc_id == i)
        assert [a for a, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))]
        assert sum(x for _, x in own) == n[i] + 1


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 700, 1024, 1025, 1500, 2047, 2048, 2049, 5000])
def test_cut_covers_and_wastes_little(n):
    parts = packing.cut(n)
    assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
    waste = sum((2048 / (2048 // p) - p) for p in parts)
    assert waste <= 0.01 * 2048 * 2 + 64


def test_packing_round_trip(spark, monkeypatch):
    rng = random.Random(9)
    texts = some_texts(60) + [" ".join(str(rng.random()) for _ in range(rng.randint(1, 900))) for _ in range(80)]
    rows = [(i % 130, t, i) for i, t in enumerate(texts)] + [(None, "no id", 0), (5, texts[5], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    parts = packing.pieces(df).cache()
    out = packing.pack(parts, group=64).collect()
    want = Counter()
    for (doc, text, _), ids in zip(rows, reference_ids([r[1] for r in rows])):
        ids, at = ids + [1], 0
        for size in packing.cut(len(ids)):
            want[doc, at, size, crc(ids[at:at + size]), len(ids)] += 1
            at += size
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for places in by.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    total = sum(r.length for r in out)
    assert padding <= 0.05 * total + 4 * 2048
    again = packing.pack_documents(df.repartition(3)).collect()
    assert len(again) == len(out)
    assert sorted(map(str, (r.ids for r in parts.collect() if r.doc_id == 0))) != []


def test_open_bins_go_through_levels(spark):
    """One class with very many equal pieces: groups are small, little is left."""
    parts = spark.range(40_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0L AS start", "1L AS length", "7L AS ids_crc32",
                                           "1L AS doc_tokens").repartition(6)
    out = packing.pack(parts, capacity=16, group=64, fill=8).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r.offset)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len(by) == 2500 and max(r.level for r in out) <= 15 and len({r.level for r in out}) > 2


def test_packing_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_length_sums(spark, monkeypatch):
    monkeypatch.setattr(lengths, "BLOCK", 16)
    texts = some_texts(200)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    sizes = [len(x) for x in reference_ids(texts)]
    sums = lengths.suffix_sums(lengths.length_histogram(df), (50, 10_000)).cache()
    got = sums.collect()
    assert sorted(r.context_limit for r in got) == sorted({*sizes, 50, 10_000})
    for r in got:
        c = r.context_limit
        assert r.n_docs == sizes.count(c) and r.docs_over == sum(s > c for s in sizes)
        assert r.docs_fit == sum(s <= c for s in sizes) and r.tokens_fit == sum(s for s in sizes if s <= c)
        assert r.tokens_truncated == sum(min(s, c) for s in sizes)
        assert r.tokens_lost == sum(sizes) - r.tokens_truncated
    q = {r.p: r.length for r in lengths.quantiles(sums, (0.5, 0.99)).collect()}
    order = sorted(sizes)
    for p, x in q.items():
        assert x == next(s for s in order if sum(y <= s for y in sizes) / len(sizes) >= p)


def test_length_sums_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lengths.suffix_sums(lengths.length_histogram(empty)).count() == 0
