"""MinHash fingerprints of whole texts, and links by signature bands.

A fingerprint is the hexadecimal form of ``k`` least values of universal hash
permutations over a text's word shingles; the likeness of two fingerprints, the
share of equal coordinates, estimates the Jaccard similarity of their shingle
sets.  ``band_links`` cuts signatures into bands, joins on them in Spark and
verifies every linked pair by the exact Jaccard similarity; ``band_groups`` names
the groups.

``fingerprint_edits`` compares each text with an edited form of itself that
borrows the head of the next document in falling id order.  The order needs no
single task: ranges are cut by id, text hash and a random number, so that rows of
one id, or of none, and equal rows spread over ranges as well; every range also
receives the one row that follows it, and each task then streams its sorted range.

Defined cases: a null text is empty; texts without words share the fingerprint
of the empty set; a null id sorts after all others; rows of one id are ordered
by the hash of their text; a single row is its own next document; a null id has
no links, and rows of one id are one node with the links of all their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text, neardup
from tessera.operators.graph import components
from tessera.sources.scratch import saved, small, temporary

K = 128
SEED = 4
BANDS = 32
LAST = (1 << 63) - 1
LEAST_HASH = -(1 << 63)

RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")
LINKED = "leader long, jaccard double, group_id long"


def to_hex(signatures: np.ndarray) -> list[str]:
    """Fixed-width hexadecimal fingerprints."""
    return [s.tobytes().hex() for s in np.ascontiguousarray(signatures, ">u4")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                 seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    @F.arrow_udf("string")
    def of(text: pa.Array) -> pa.Array:
        return pa.array(to_hex(_text.MinHasher(k, seed).of_column(text)), pa.string())

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("fingerprint"))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _not_after(cuts: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted ``cuts`` are not after each row, in the order of the columns."""
    lo, hi = (np.searchsorted(cuts[0], rows[0], side=s) for s in ("left", "right"))
    if len(cuts) == 1:
        return hi
    for value in np.unique(rows[0][hi > lo]):
        same = rows[0] == value
        a, b = lo[same][0], hi[same][0]
        lo[same] += _not_after([c[a:b] for c in cuts[1:]], [r[same] for r in rows[1:]])
    return lo


class _Chunk:
    """Rows gathered until their texts fill a group."""

    def __init__(self):
        self.ids, self.texts, self.links, self.nexts, self.size = [], [], [], [], 0

    def add(self, doc_id, text, link, following):
        self.ids.append(doc_id)
        self.texts.append(text)
        self.links.append(link or (None, None, doc_id))
        self.nexts.append(following)
        self.size += len(text)


def _compare(chunk: _Chunk, hasher: _text.MinHasher) -> pa.RecordBatch:
    edited = [_edited(t, n) for t, n in zip(chunk.texts, chunk.nexts)]
    # next documents are the following rows but for the last of the chunk
    own = hasher.of_column(pa.array([*chunk.texts, chunk.nexts[-1]], pa.large_string()))
    new = hasher.of_column(pa.array(edited, pa.large_string()))
    following, own = own[1:], own[:-1]
    same = [i for i in range(len(chunk.texts) - 1) if chunk.nexts[i] is not chunk.texts[i + 1]]
    if same:
        following[same] = hasher.of_column(
            pa.array([chunk.nexts[i] for i in same], pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.ids, pa.int64()), pa.array([len(t) for t in chunk.texts], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
         pa.array(to_hex(own)), pa.array(to_hex(new)),
         pa.array((own == new).mean(axis=1)), pa.array((own == following).mean(axis=1)),
         *[pa.array(x, t) for x, t in zip(zip(*chunk.links), (pa.int64(), pa.float64(), pa.int64()))]],
        [c.split()[0] for c in f"{RESULT}, {LINKED}".split(", ")])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                      seed: int = SEED, ranges: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """One row per document with the columns of ``RESULT``; given ``links`` (of
    ``band_groups``), which travel with the ranges, also those of ``LINKED``."""
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # falling ids, nulls last; then the text's hash; equal rows in any order
    falling = F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit(LAST))
    place = [falling.alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"), F.rand(seed).alias("deal")]
    order = ["key", "hash", "deal"]
    keys = saved(docs.select(*place).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "keys")
    # one row per range
    first = keys.groupBy("part").agg(F.min(F.struct(*order)).alias("m")).select("m.*").orderBy(*order).collect()
    cuts = [np.array([r[c] for r in first[1:]], t) for c, t in zip(order, (np.int64, np.int64, np.float64))]

    def ranges_of(key: pa.Array, hash_: pa.Array, deal: pa.Array) -> pa.Array:
        rows = [c.to_numpy(zero_copy_only=False) for c in (key, hash_, deal)]
        return pa.array(_not_after(cuts, rows).astype(np.int32))

    # a range's first row also goes to the range before it; where equal rows make
    # several first rows, one of them does
    goes: dict = {}
    for i, r in enumerate(first):
        goes.setdefault((r["key"], r["hash"]), []).append((i - 1) % len(first))
    heads = spark.createDataFrame([(k, h, to) for (k, h), to in goes.items()], "k long, h long, to array<int>")
    on = (F.col("key") == F.col("k")) & (F.col("hash") == F.col("h"))
    several = {(r["k"], r["h"]) for r in keys.join(F.broadcast(heads), on).groupBy("k", "h")
               .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "h").collect()}
    alone = {k: to for k, to in goes.items() if k not in several}

    @F.arrow_udf("struct<range:int,also:array<int>>")
    def placed(key: pa.Array, hash_: pa.Array, deal: pa.Array) -> pa.Array:
        """A row's range, and the ranges that it follows as their first row."""
        pairs = zip(key.to_pylist(), hash_.to_pylist())
        return pa.StructArray.from_arrays([ranges_of(key, hash_, deal), pa.array(
            [alone.get(p) for p in pairs], pa.list_(pa.int32()))], ["range", "also"])

    @F.arrow_udf("array<int>")
    def spanned(key: pa.Array) -> pa.Array:
        """The ranges that hold rows of an id."""
        ends = [ranges_of(key, pa.array(np.full(len(key), h)), pa.array(np.full(len(key), d))).to_pylist()
                for h, d in ((LEAST_HASH, 0.0), (LAST, 1.0))]
        return pa.array([list(range(a, b + 1)) for a, b in zip(*ends)], pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _text.MinHasher(k, seed)
        chunk, held, after, link = _Chunk(), None, False, (None, None)
        for batch in batches:
            for doc_id, text, copy, *linked in zip(batch.column(0).to_pylist(), batch.column(1),
                                                   *[c.to_pylist() for c in batch.columns[2:]]):
                if linked[-1] is not None:  # comes before the rows of its id
                    link = (doc_id, linked)
                    continue
                if copy and after:
                    continue
                text = text.as_py() or ""
                if held is not None:
                    chunk.add(*held, text)
                    held = None
                    if chunk.size >= _text.GROUP_BYTES:
                        yield _compare(chunk, hasher)
                        chunk = _Chunk()
                if copy:
                    after = True
                else:
                    held, after = (doc_id, text, link[1] if link[0] == doc_id else None), False
        if chunk.ids:
            yield _compare(chunk, hasher)

    rows = docs.select(*place, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("at", placed(*order))
    here = F.array(F.struct("at.range", F.lit(False).alias("copy")))
    there = F.transform(F.coalesce("at.also", F.array().cast("array<int>")),
                        lambda r: F.struct(r.alias("range"), F.lit(True).alias("copy")))
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in LINKED.split(", ")]
    own = ["key", "hash", "deal", "doc_id", "text"]
    rows = rows.select(*own, F.explode(F.concat(here, there)).alias("p")).select(*own, "p.range", "p.copy", *none)
    if several:
        hot = spark.createDataFrame([(k, h, goes[k, h]) for k, h in several], heads.schema)
        texts = (docs.select(*place, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                 .join(F.broadcast(hot), on).groupBy("key", "hash").agg(
                     F.first("to").alias("to"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text")))
        rows = rows.unionByName(texts.select("key", "hash", F.lit(0.0).alias("deal"), "doc_id", "text",
                                             F.explode("to").alias("range"), F.lit(True).alias("copy"), *none))
    if links is not None:
        at = F.bitwise_not("doc_id")
        linked = links.select(at.alias("key"), F.lit(LEAST_HASH).alias("hash"), F.lit(0.0).alias("deal"), "doc_id",
                              F.lit(None).cast("string").alias("text"), F.explode(spanned(at)).alias("range"),
                              F.lit(False).alias("copy"), "leader", "jaccard", "group_id")
        rows = rows.unionByName(linked)
    sorted_ = (rows.repartitionById(max(len(first), 1), F.col("range"))
               .sortWithinPartitions("copy", "key", F.col("group_id").isNull(), "hash", "deal"))
    out = (sorted_.select("doc_id", "text", "copy", "leader", "jaccard", "group_id")
           .mapInArrow(run, f"{RESULT}, {LINKED}"))
    return out if links is not None else out.drop("leader", "jaccard", "group_id")


def band_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
               bands: int = BANDS, similarity: float = 0.75, seed: int = SEED) -> DataFrame:
    """``doc_id, leader, jaccard``: linked documents (``leader`` is the smaller id)
    with verified Jaccard similarity of at least ``similarity``.

    Documents of equal sets form a class, linked to its smallest document, which
    stands for it.  In every band the classes are compared with the most central
    one, a star of any size; pairs of a band that no star brings together are
    found from their overlaps with it (``neardup.open_pairs``).  So the links
    connect all documents that a chain of similar pairs with common bands does.
    """
    rows, pct = k // bands, 100 * similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _text.MinHasher(k, seed)
        for batch in batches:
            for w in _text.word_groups(batch.column(2), lower=True):
                sets = list(neardup.distinct_shingles(w, _text.SHINGLE))
                sizes = np.array([len(s) for s in sets], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                every = np.concatenate(sets)
                sig = hasher.signatures(every, offsets).astype(np.uint64)
                acc = np.tile(np.arange(bands, dtype=np.uint64), (w.n, 1))
                for j in range(rows):
                    acc = _text.mix64(acc + sig[:, j::rows][:, :bands])
                ends = pa.array(np.arange(w.n + 1, dtype=np.int32) * np.int32(bands))
                part = batch.slice(w.first, w.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes),
                     *(pa.array(x) for x in neardup.set_names(every, offsets)),
                     pa.ListArray.from_arrays(ends, pa.array(acc.view(np.int64).reshape(-1)))],
                    ["doc_id", "text_key", "n", "set_a", "set_b", "bands"])

    text = F.col(text_col).cast("string")
    full = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    full = saved(full.mapInArrow(run, "doc_id long, text_key long, n long, set_a long, set_b long, bands array<bigint>")
                 .where("n > 0"), "profiles")
    by_set = full.groupBy("set_a", "set_b")
    tokens = (by_set.agg(F.min(F.struct("doc_id", "bands")).alias("m"))
              .select(F.col("m.doc_id").alias("rep"), F.explode("m.bands").alias("token")))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    posts = saved(tokens.join(shared, "token").groupBy("rep")
                  .agg(F.sum("df").alias("weight"), F.collect_set("token").alias("t"))
                  .select("rep", "weight", F.explode("t").alias("token")), "postings")
    first = by_set.agg(F.min(F.struct("doc_id", "text_key")).alias("m"))
    copies = full.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    named = saved(first.select(F.col("m.doc_id").alias("rep"), "m.doc_id", "m.text_key")
                  .join(posts.select("rep").distinct(), "rep").join(copies, ["doc_id", "text_key"]), "named")
    sets = saved(neardup.shingle_sets(docs, named, id_col, text_col, _text.SHINGLE), "sets")

    leaders = posts.groupBy("token").agg(
        F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("leader"))
    led = posts.select("rep", "token").join(leaders, "token").where("rep <> leader")
    stars = saved(neardup.star_overlaps(led.select("rep", "leader").distinct(), sets), "stars")
    similar = 100 * F.col("inner") >= pct * (F.col("n") + F.col("n_leader") - F.col("inner"))
    links = saved(stars.where(similar).select(
        F.col("rep").alias("a"), F.col("leader").alias("b"),
        (F.col("inner") / (F.col("n") + F.col("n_leader") - F.col("inner"))).alias("jaccard")), "links")

    component = saved(components(links.select("a", "b")).withColumnRenamed("node", "rep"), "first")
    rest = neardup.open_pairs(posts, leaders, stars, component, pct)
    of = {x: posts.select(F.col("rep").alias(x), "token") for x in "ab"}
    rest = rest.join(of["a"], "a").join(of["b"], ["b", "token"]).select("a", "b").distinct()
    of = {x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"}
    common = F.size(F.array_intersect("set_a", "set_b"))
    more = (rest.join(of["a"], "a").join(of["b"], "b")
            .select("a", "b", common.alias("c"), (F.size("set_a") + F.size("set_b")).alias("n"))
            .where(100 * F.col("c") >= pct * (F.col("n") - F.col("c")))
            .select("a", "b", (F.col("c") / (F.col("n") - F.col("c"))).alias("jaccard")))
    # classes of several documents; as few as these are, their rows need no shuffle
    several = by_set.agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).where("b <> last").drop("last")
    copies = (full.join(small(saved(several, "several")), ["set_a", "set_b"]).where("doc_id <> b")
              .select(F.col("doc_id").alias("a"), "b", F.lit(1.0).alias("jaccard")))
    return (links.unionByName(more).unionByName(copies)
            .groupBy(F.greatest("a", "b").alias("doc_id"), F.least("a", "b").alias("leader"))
            .agg(F.max("jaccard").alias("jaccard")))


def band_groups(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, leader, jaccard, group_id`` of every linked document: its least
    verified leader, if it has one, and the least document of its group.

    The tables that lead to it are removed."""
    with temporary(docs.sparkSession):
        links = saved(band_links(docs, **options), "links")
        best = (links.groupBy("doc_id").agg(F.min(F.struct("leader", "jaccard")).alias("m"))
                .select("doc_id", "m.*"))
        groups = components(links.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))
        return saved(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))
                     .join(best, "doc_id", "left").select("doc_id", "leader", "jaccard", "group_id"), "groups", keep=True)
