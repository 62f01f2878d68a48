"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every document's set of distinct word shingles gives ``k`` MinHash
   coordinates.  Documents with equal sets form a class, which gets a number of
   its own, so that documents without an id take part like any other.
2. Classes are posted under each (coordinate, value).  Pairs that agree in at
   least ``m`` of ``k`` coordinates are wanted, so two such classes share a
   posting among any ``k - m + 1`` of their coordinates (the prefix).  Prefixes
   are taken rarest first: coordinates that many texts share, from passages or
   licences, are skipped unless they make up most of a text.
3. Within a posting list every class is compared with the list's most central
   class only (its leader): a star, never all pairs, with the exact size of the
   intersection.  Pairs that reach the similarity are links; links give
   components.
4. Two classes x, y of one list and different components are left over.  With
   a leader L known to both, they can only be similar if
   a) they share a shingle that L lacks: the sets without L's shingles are
      posted under (L, shingle), again only a rarest-first prefix, or
   b) what they share lies in L, so that both intersections with L reach the
      overlap that their sizes ask for: a join on L and the sizes.
   Variants of one text that differ by own edits meet neither, so a large family
   stays linear.  L is the most central leader of both (their home) if that is
   the same one, else the leader of their list.  Candidates must agree in ``m``
   coordinates over the whole signatures and are then confirmed on full sets.
5. Components of all links name the groups.

``m`` is far below the wanted similarity: with k = 64, m = 32 a pair of
similarity 0.75 is missed with probability below 1e-5, a closer one far less.

Defined cases: texts without words have an empty set and link with nothing;
rows with a null id are linked like others, ``component_id`` is the least id of
the group that is not null, and null for a group without ids; rows that share an
id are linked by their texts alone.  ``first`` marks one row of each group, of the
least id if there is one: the document that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.sources.scratch import saved, small
from tessera.operators.graph import components

K = 64
MATCHES = 32
SIMILARITY_PCT = 75
SEED = 6


def distinct_shingles(words: _text.Words, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text of a group."""
    sh, offsets = _text.shingles(words.hashes, words.offsets, width)
    for i in range(words.n):
        yield np.unique(sh[offsets[i]:offsets[i + 1]])


def set_names(every: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two longs per text that name its set of shingles."""
    names = []
    for salt in (1, 2):
        mixed = _text.mix64(every + np.uint64(salt * 0x51ED270B))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        names.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return names


def profile_sets(docs: DataFrame, id_col: str, text_col: str, k: int, width: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_a, set_b, signature`` per row; the two
    longs name the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _text.MinHasher(k, SEED)
        for batch in batches:
            at = 0
            for w in _text.word_groups(batch.column(2), lower=True):
                sets = list(distinct_shingles(w, width))
                sizes = np.array([len(s) for s in sets], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                every = np.concatenate(sets)
                sig = hasher.signatures(every, offsets)
                names = set_names(every, offsets)
                part = batch.slice(at, w.n)
                at += w.n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes), pa.array(names[0]),
                     pa.array(names[1]), pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "signature"])

    text = F.col(text_col).cast("string")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.xxhash64(text).alias("text_key"), text.alias("text"))
            .mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_a long, set_b long, "
                             "signature binary"))


def _postings(reps: DataFrame, k: int) -> DataFrame:
    """``rep, token`` for every coordinate: token = coordinate and value in a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.arange(k, dtype=np.int64) << 32
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, k)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), 4096):
                tokens = sig[lo:lo + 4096].astype(np.int64) + coordinate
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[lo:lo + 4096], k)), pa.array(tokens.ravel())],
                    ["rep", "token"])

    return reps.select("rep", "signature").mapInArrow(run, "rep long, token long")


def prefix_postings(reps: DataFrame, k: int, matches: int) -> DataFrame:
    """``rep, token, weight``: the shared coordinates of each class among its
    ``k - matches + 1`` rarest; ``weight`` says how central the class is."""
    tokens = _postings(reps, k)
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per_rep = (tokens.join(shared, "token")
               .groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")))
    # a class has k coordinates; those of one class only come first in its prefix
    alone = F.lit(k) - F.size("t")
    prefix = F.slice("t", 1, F.greatest(F.lit(k - matches + 1) - alone, F.lit(0)))
    weight = F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc + x["df"])
    return (per_rep.select("rep", prefix.alias("p"), weight.alias("weight")).where("size(p) > 0")
            .select("rep", "weight", F.explode("p").alias("x"))
            .select("rep", "weight", F.col("x.token").alias("token")))


def agreement(a: str, b: str) -> Column:
    """Equal coordinates of two signatures."""
    @F.arrow_udf("int")
    def equal(a: pa.Array, b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], pa.int32())
        x = np.frombuffer(b"".join(a.to_pylist()), np.uint32).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b.to_pylist()), np.uint32).reshape(len(b), -1)
        return pa.array((x == y).sum(axis=1).astype(np.int32))

    return equal(a, b)


def shingle_sets(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``rep, shingles`` (sorted distinct hashes) of the documents named in ``reps``
    (``rep, doc_id, text_key, copies``: rows of that id and text); one of several
    equal rows is taken."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch for every group of texts: sets are larger than their texts."""
        for batch in batches:
            for w in _text.word_groups(batch.column(1), lower=True):
                sets = [s.view(np.int64) for s in distinct_shingles(w, width)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.n),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["rep", "shingles"])

    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("text"))

    def having(which: str) -> DataFrame:
        named = small(reps.where(which).drop("copies"))
        return d.join(named, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))).select(
            "rep", "text")

    found = having("copies = 1")
    if not reps.where("copies > 1").isEmpty():
        found = found.unionByName(having("copies > 1").groupBy("rep").agg(F.first("text").alias("text")))
    return found.mapInArrow(run, "rep long, shingles array<bigint>")


def star_overlaps(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """``rep, leader, n, n_leader, inner, rest``: sizes, the intersection's size
    and the shingles of ``rep`` that its leader lacks."""
    own = sets.select("rep", F.col("shingles").alias("own"))
    lead = sets.select(F.col("rep").alias("leader"), F.col("shingles").alias("lead"))
    return (stars.join(own, "rep").join(lead, "leader")
            .select("rep", "leader", F.size("own").alias("n"), F.size("lead").alias("n_leader"),
                    F.array_except("own", "lead").alias("rest"))
            .withColumn("inner", F.col("n") - F.size("rest")))


def _cross_pairs(lists: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Pairs ``a, b`` within the groups of ``keys`` whose ``c`` and ``g`` differ.

    ``by`` is ``c`` or ``g``.  One of a pair is not of the group's most frequent
    ``by``, so only those rows are joined to all; groups with one value of it
    end here.
    """
    counts = lists.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("k"))
    top = (counts.groupBy(*keys).agg(F.max_by(by, F.struct("k", by)).alias("top"),
                                     F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    rows = saved(lists.join(top.drop("kinds"), keys), "lists")
    x = rows.where(F.col(by) != F.col("top")).select(
        *keys, F.col("rep").alias("x"), F.col("c").alias("cx"), F.col("g").alias("gx"))
    y = rows.select(*keys, F.col("rep").alias("y"), F.col("c").alias("cy"), F.col("g").alias("gy"))
    return _unordered(x.join(y, keys).where("cx <> cy and gx <> gy"))


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def pairs_outside_leader(family: DataFrame, similarity_pct: int, by: str) -> DataFrame:
    """Pairs that differ in ``c`` and ``g`` and share a shingle their leader lacks."""
    posted = family.select("leader", "rep", F.explode("rest").alias("s"))
    shared = posted.groupBy("leader", "s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per_rep = (posted.join(shared, ["leader", "s"]).groupBy("leader", "rep")
               .agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("t")))
    # at least this many of the ``rest`` must be shared: similar sets share
    # similarity * n, and at most ``inner`` of those lie in the leader
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * similarity_pct / 100).cast("int") - F.col("inner"))
    prefix = F.slice("t", 1, F.greatest(F.size("t") - least + 1, F.lit(0)))
    lists = (per_rep.join(family.select("leader", "rep", "c", "g", "n", "inner"), ["leader", "rep"])
             .select("leader", "rep", "c", "g", F.explode(prefix).alias("x"))
             .select("leader", "rep", "c", "g", F.col("x.s").alias("s")))
    return _cross_pairs(lists, ["leader", "s"], by)


def pairs_inside_leader(family: DataFrame, similarity_pct: int) -> DataFrame:
    """Pairs that differ in ``c`` and ``g`` and whose overlap may lie within
    their leader.

    Their overlap is at most either intersection with the leader, so the sizes
    of a pair add up to at most ``inner * (100 + pct) / pct`` on both sides.
    """
    pct = similarity_pct
    near = (family.where(100 * F.col("inner") >= pct * F.col("n"))
            .withColumn("most", F.col("inner") * (100 + pct) / pct - F.col("n")).drop("rest"))

    def step(size):
        return F.floor(F.log(size) / F.log(F.lit(1.05))).cast("int")

    x = (near.where("c <> c_leader")
         .select("leader", F.col("rep").alias("x"), F.col("c").alias("cx"), F.col("g").alias("gx"),
                 F.col("n").alias("nx"), F.col("most").alias("mx"),
                 F.explode(F.sequence(step(F.col("n") * pct / 100) - 1,
                                      F.greatest(step(F.col("most")), step(F.col("n") * pct / 100))))
                 .alias("step")))
    y = near.select("leader", F.col("rep").alias("y"), F.col("c").alias("cy"), F.col("g").alias("gy"),
                    F.col("n").alias("ny"), F.col("most").alias("my"), step(F.col("n")).alias("step"))
    return _unordered(x.join(y, ["leader", "step"])
                      .where("cx <> cy and gx <> gy and ny <= mx and nx <= my"))


def open_pairs(posts: DataFrame, leaders: DataFrame, stars: DataFrame, component: DataFrame,
               similarity_pct: int) -> DataFrame:
    """Pairs of different components that no star has compared and that can still
    be similar (step 4 above)."""
    central = posts.select(F.col("rep").alias("leader"), F.col("weight").alias("w")).distinct()
    rank = F.struct((2 * F.col("inner") >= F.col("n")).alias("near"), "w", -F.col("leader"))
    home = (stars.select("rep", "leader", "inner", "n").join(central, "leader")
            .groupBy("rep").agg(F.max_by("leader", rank).alias("h")))
    of = (posts.select("rep").distinct().join(home, "rep", "left").join(component, "rep", "left")
          .select("rep", F.coalesce("h", "rep").alias("h"), F.coalesce("component", "rep").alias("c")))
    of = saved(of, "homes")
    lead = of.select(F.col("rep").alias("leader"), F.col("c").alias("c_leader"))
    overlap = stars.select("rep", "leader", "n", "inner", "rest")

    at_home = (of.where("rep <> h").select("rep", F.col("h").alias("leader"), "c", F.col("rep").alias("g"))
               .join(overlap, ["rep", "leader"]).join(lead, "leader"))
    at_home = saved(at_home, "family")
    led = (posts.select("rep", "token").join(leaders, "token").where("rep <> leader").join(of, "rep"))
    several = (led.groupBy("token").agg(F.min("h").alias("h0"), F.max("h").alias("h1"),
                                        F.min("c").alias("c0"), F.max("c").alias("c1"))
               .where("h0 <> h1 and c0 <> c1").select("token"))
    abroad = (led.join(several, "token").select("leader", "rep", "c", F.col("h").alias("g")).distinct()
              .join(overlap, ["rep", "leader"]).join(lead, "leader"))
    abroad = saved(abroad, "family")
    pairs = pairs_outside_leader(at_home, similarity_pct, "c")
    for more in (pairs_outside_leader(abroad, similarity_pct, "g"),
                 pairs_inside_leader(at_home, similarity_pct),
                 pairs_inside_leader(abroad, similarity_pct)):
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def confirm(pairs: DataFrame, reps: DataFrame, sets: DataFrame, matches: int,
            similarity_pct: int) -> DataFrame:
    """The pairs (``a, b``) that agree in ``matches`` coordinates and whose full
    sets reach the similarity."""
    def side(name: str) -> DataFrame:
        return reps.select(F.col("rep").alias(name), F.col("signature").alias(f"sig_{name}"),
                           F.col("n_shingles").alias(f"n_{name}"))

    near = (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(100 * F.least("n_a", "n_b") >= similarity_pct * F.greatest("n_a", "n_b"))
            .where(agreement("sig_a", "sig_b") >= matches).select("a", "b").distinct())
    of = {x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"}
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return (near.join(of["a"], "a").join(of["b"], "b")
            .where(100 * both >= similarity_pct * union).select("a", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                    matches: int = MATCHES, similarity_pct: int = SIMILARITY_PCT,
                    width: int = _text.SHINGLE) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept, first`` per input row."""
    rows = profile_sets(docs, id_col, text_col, k, width)
    rows = saved(rows.withColumn("rid", F.monotonically_increasing_id()), "shingles")
    full = rows.where("n_shingles > 0")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "text_key", "signature", "n_shingles")
    classes = full.groupBy("set_a", "set_b").agg(F.min(least).alias("m"))
    # classes are numbered in the order of their first documents, so that of equally
    # central ones the earliest leads; the table is written, so the numbers stay
    order = ["m.none", "m.doc_id", "m.rid"]
    classes = classes.repartitionByRange(*order).sortWithinPartitions(*order)
    reps = saved(classes.select(F.monotonically_increasing_id().alias("rep"), "set_a", "set_b", "m.doc_id", "m.text_key",
                                F.col("m.rid").alias("first_rid"), "m.n_shingles", "m.signature"), "classes")
    posts = saved(prefix_postings(reps, k, matches), "postings")
    named = reps.join(posts.select("rep").distinct(), "rep").select("rep", "doc_id", "text_key")
    copies = rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count(F.lit(1)).alias("copies"))
    named = saved(named.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
                  .drop("_id", "_key"), "named")
    sets = saved(shingle_sets(docs, named, id_col, text_col, width), "sets")

    leaders = posts.groupBy("token").agg(
        F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("leader"))
    led = posts.select("rep", "token").join(leaders, "token").where("rep <> leader")
    stars = saved(star_overlaps(led.select("rep", "leader").distinct(), sets), "stars")
    similar = 100 * F.col("inner") >= similarity_pct * (F.col("n") + F.col("n_leader") - F.col("inner"))
    links = saved(stars.where(similar).select(F.col("rep").alias("a"), F.col("leader").alias("b")),
                  "links")

    first = saved(components(links).withColumnRenamed("node", "rep"), "first")
    rest = open_pairs(posts, leaders, stars, first, similarity_pct)
    more = saved(confirm(rest, reps, sets, matches, similarity_pct), "links")
    groups = components(links.unionByName(more))

    member = (reps.select("rep", "set_a", "set_b", "doc_id", "first_rid").join(groups.withColumnRenamed("node", "rep"),
                                                                             "rep", "left")
              .withColumn("c", F.coalesce("component", "rep")))
    heads = member.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min(
        F.struct(F.col("doc_id").isNull(), "doc_id", "first_rid")).alias("m")).select(
        "c", "component_id", F.col("m.first_rid").alias("head"))
    of = member.select("set_a", "set_b", "c").join(heads, "c").drop("c")
    out = rows.drop("signature").join(of, ["set_a", "set_b"], "left")
    empty = F.col("n_shingles") == 0
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    first_row = empty | (F.col("rid") == F.col("head"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, first_row).alias("kept"), first_row.alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         **options) -> DataFrame:
    """``docs`` with one document of each group, its columns as they are; a
    repeated row stays once."""
    text = F.xxhash64(F.col(text_col).cast("string"))
    decided = saved(near_duplicates(docs, id_col, text_col, **options)
                    .groupBy("doc_id", "text_key").agg(F.max("first").alias("kept"),
                                                       F.count(F.lit(1)).alias("n")), "kept")
    keep = saved(decided.where("kept").select("doc_id", "text_key", "n"), "keep")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("_i"), text.alias("_t"))

    def having(which: str) -> DataFrame:
        k = small(keep.where(which))
        return packed.join(k, packed["_i"].eqNullSafe(k["doc_id"]) & (packed["_t"] == k["text_key"]),
                           "left_semi")

    once = having("n = 1")
    if not keep.where("n > 1").isEmpty():
        once = once.unionByName(having("n > 1").dropDuplicates(["_i", "_t"]))
    return once.select("row.*")
