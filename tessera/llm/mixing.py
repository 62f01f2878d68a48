"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources.  Documents are aggregated by the set
of sources they belong to (the pattern); the flow sends pattern capacity to
source quotas.  A pattern's words cost nothing in their first copy and one unit
more in every further copy (convex), so repetition is spread before it deepens,
and no pattern gives more than ``max_copies`` copies.  The network falls apart
into components of patterns that share sources; every component is solved on
its own by successive shortest paths, in parallel.

The routed words of a pattern are then filled with whole documents in a seeded
order: with c full copies and a remainder, every document is taken c times and
the first documents of the seeded order once more until the remainder is met.
The order's prefix sums need no window over a source: documents fall into
hash buckets, bucket totals find the one bucket in which the
remainder ends, and only that bucket is sorted.  A document's place in the order
follows from its id, its text and, among rows that share both and their sources,
from a number, so that rows of one id (or of none) are not taken or left together.

Defined cases: a null source is a source of its own, after all others; null and
empty texts have size 0 and are taken 0 words; repeated rows count as often as
they occur; extra columns pass through ``mix`` untouched.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.llm._ranges import SPREAD, ranged, running, spread
from tessera.operators.graph import components
from tessera.sources.scratch import saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
#: Hash buckets of a pattern: 16 to this power.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in each whole text; null: 0."""
    @F.arrow_udf("long")
    def count(col: pa.Array) -> pa.Array:
        data, offsets = _text.text_buffers(col)

        def starts(part, rel):
            is_word = _text._IS_WORD[part]
            first = is_word.copy()
            first[1:] &= ~is_word[:-1]
            edges = rel[rel < len(part)]
            first[edges] = is_word[edges]
            return first

        return pa.array(_text.per_text(data, offsets, starts), pa.int64())

    return count(text)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
                   cap: float = MAX_COPIES) -> DataFrame:
    """``source, source_size, target``: weights repeat over the sources by code
    point, null last; targets share ``share`` of all words and stop at ``cap``
    times the source's size, the excess going to the others by weight.

    That is the level L with sum(min(cap * size, L * weight)) = total: sources
    are capped in the order of cap * size / weight, so prefix sums in that order
    give L.  The windows run over one row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1,
                             F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("ratio", F.col("top") / F.col("w"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    s = (s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
         .withColumn("capped", F.coalesce(F.sum("top").over(before), F.lit(0.0)))
         .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("w").over(after)))
    # the first source, in this order, that the level leaves below its cap fixes the level
    s = s.withColumn("n", F.row_number().over(order))
    fixed = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("n", "level"))).over(every)["level"]
    target = F.least(F.col("top"), F.coalesce(fixed * F.col("w"), F.col("top")))
    return s.select("source", "source_size", target.alias("target"))


def _shortest_paths(patterns: list[tuple[list, int]], quotas: dict, copies: int) -> list[float]:
    """Words routed from each pattern; unit costs 0, 1, .. for its copies.

    Successive shortest augmenting paths over pattern, copy and source arcs; the
    costs rise with the copy, so paths of one cost are exhausted before the next.
    """
    n, sources = len(patterns), list(quotas)
    flow = [{s: 0.0 for s in p[0]} for p in patterns]
    left = dict(quotas)
    used = [0.0] * n
    takers: dict = {s: [] for s in sources}
    for i, (members, _) in enumerate(patterns):
        for s in members:
            takers[s].append(i)
    for copy in range(1, copies + 1):
        for start in range(n):
            while True:
                room = copy * patterns[start][1] - used[start]
                if room <= 1e-9:
                    break
                # breadth-first over (pattern -> source) and back along flow that can be moved
                back: dict = {("p", start): None}
                queue, end = [("p", start)], None
                while queue and end is None:
                    kind, x = queue.pop(0)
                    if kind == "p":
                        for s in patterns[x][0]:
                            if ("s", s) not in back:
                                back[("s", s)] = ("p", x)
                                queue.append(("s", s))
                                if left[s] > 1e-9:
                                    end = ("s", s)
                                    break
                    else:
                        for i in takers[x]:
                            if flow[i][x] > 1e-9 and ("p", i) not in back:
                                back[("p", i)] = ("s", x)
                                queue.append(("p", i))
                if end is None:
                    break
                path = [end]
                while back[path[-1]] is not None:
                    path.append(back[path[-1]])
                path.reverse()
                amount = min(room, left[end[1]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "s":
                        amount = min(amount, flow[b[1]][a[1]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1]][b[1]] += amount
                    else:
                        flow[b[1]][a[1]] -= amount
                used[start] += amount
                left[end[1]] -= amount
    return used


def route(patterns: DataFrame, targets: DataFrame, copies: int = MAX_COPIES) -> DataFrame:
    """``pattern, size, routed``: words that the flow takes from each pattern.

    ``patterns``: ``pattern`` (array of sources), ``size``.  ``targets``:
    ``source``, ``target``.  One task solves one component.
    """
    keyed = patterns.withColumn("pid", F.xxhash64(F.lit("pattern"), "pattern"))
    arcs = keyed.select("pid", "size", F.explode("pattern").alias("member"))
    arcs = arcs.withColumn("node", F.xxhash64(F.lit("source"), "member"))
    comp = components(arcs.select(F.col("pid").alias("a"), F.col("node").alias("b")))
    rows = (arcs.join(targets, F.col("member").eqNullSafe(F.col("source")))
            .select("pid", "size", F.col("node").alias("source"), "target")
            .join(comp.withColumnRenamed("node", "pid"), "pid"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        groups = [(pid, sorted(g["source"]), int(g["size"].iloc[0]))
                  for pid, g in sorted(frame.groupby("pid"), key=lambda x: x[0])]
        quotas = dict(sorted(zip(frame["source"], frame["target"])))
        used = _shortest_paths([(m, n) for _, m, n in groups], quotas, copies)
        return pd.DataFrame({"pid": [g[0] for g in groups], "routed": used})

    solved = rows.groupBy("component").applyInPandas(solve, "pid long, routed double")
    return keyed.join(solved, "pid").select("pattern", "size", "routed")


def _key(seed: int) -> Column:
    """The seeded order of documents: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("row_key").cast("string"), F.lit("")),
                             F.col("text_key"), F.col("again").cast("string")))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


_SAME = ["row_key", "text_key", "pattern"]


def _repeated(rows: DataFrame) -> DataFrame:
    """The ``row_key, text_key, pattern`` that several rows share."""
    many = rows.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return saved(many.select(*[F.col(c).alias(f"_{c}") for c in _SAME]), "repeated")


def _numbered(rows: DataFrame, many: DataFrame) -> DataFrame:
    """``rows`` with ``again``: 0, 1, .. among rows that share a line of ``many``; only
    these are sorted, over ranges."""
    if many.isEmpty():
        return rows.withColumn("again", F.lit(0).cast("long"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SAME]
    once = rows.join(many, on, "left_anti").withColumn("again", F.lit(0).cast("long"))
    again = ranged(spread(rows.join(many, on, "left_semi")), [*_SAME, SPREAD], "repeated")
    again = running(again, _SAME, [SPREAD], {"again": F.lit(1).cast("long")})
    return once.unionByName(again.withColumn("again", F.col("again") - 1).drop("_part", SPREAD))


def borders(docs: DataFrame, routed: DataFrame, seed: int = 0) -> DataFrame:
    """``pattern, full, border``: every document of the pattern is taken ``full``
    times, and those whose key is at most ``border`` once more.

    ``docs``: ``row_key, text_key, again, pattern, size``.
    """
    keyed = docs.select(_key(seed).alias("key"), "pattern", "size")
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    plan = routed.withColumn("full", F.when(F.col("size") > 0, F.floor(F.col("routed") / F.col("size")))
                             .otherwise(0))
    plan = plan.select("pattern", "full",
                       (F.col("routed") - F.col("full") * F.col("size")).alias("rest"))
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (keyed.groupBy("pattern", "bucket").agg(F.sum("size").alias("n"))
            .select("pattern", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")))
    last = (sums.join(plan, "pattern").where("before < rest").groupBy("pattern", "rest")
            .agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("at"))
            .select("pattern", "rest", "at.bucket", "at.before"))
    inside = (Window.partitionBy("pattern", "bucket").orderBy("key")
              .rowsBetween(Window.unboundedPreceding, -1))
    near = (keyed.join(last, ["pattern", "bucket"])
            .groupBy("pattern", "bucket", "rest", "before", "key").agg(F.sum("size").alias("n"))
            .withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))))
    # a document joins if at least half of it lies below the border; a bucket's
    # name is less than its keys and more than those of the buckets before it
    passes = F.when(F.col("at") + F.col("n") / 2 <= F.col("rest"), F.col("key"))
    ends = near.groupBy("pattern").agg(F.coalesce(F.max(passes), F.first("bucket")).alias("border"))
    ends = ends.withColumnRenamed("pattern", "_p")
    return (plan.join(ends, F.col("pattern").eqNullSafe(F.col("_p")), "left")
            .select("pattern", "full", "border"))


def _copies(seed: int) -> Column:
    return F.col("full") + F.coalesce(_key(seed) <= F.col("border"), F.lit(False)).cast("long")


def _solve(docs: DataFrame, members: Column, id_col: str, text_col: str, seed: int):
    """(sizes, targets, borders, repeated rows) of a table; the text is read once."""
    sized = saved(docs.select(F.col(id_col).alias("row_key"), _text_key(F.col(text_col)).alias("text_key"),
                              members.alias("pattern"), word_count(F.col(text_col)).alias("size")), "sizes")
    many = _repeated(sized)
    sized = _numbered(sized, many)
    by_source = (sized.select(F.explode("pattern").alias("source"), "size")
                 .groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = saved(source_targets(by_source), "targets")
    patterns = sized.groupBy("pattern").agg(F.sum("size").alias("size"))
    return sized, targets, saved(borders(sized, route(patterns, targets), seed), "borders"), many


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", seed: int = 0) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, copies, taken``."""
    sized, targets, ends, _ = _solve(docs, F.array(source_col), id_col, text_col, seed)
    per_source = ends.join(targets, F.col("pattern")[0].eqNullSafe(F.col("source"))).drop("pattern")
    one = sized.select("row_key", "text_key", "again", "size", F.col("pattern")[0].alias("_s"))
    return (one.join(per_source, F.col("_s").eqNullSafe(F.col("source"))).withColumn("copies", _copies(seed))
            .select(F.col("row_key").alias("doc_id"), "source", "size", "source_size", "target",
                    "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: int = 0, members: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, columns as they are.

    ``members`` gives a document's sources where it has several (an array).
    """
    pattern = F.array(source_col) if members is None else members
    _, _, ends, many = _solve(docs, pattern, id_col, text_col, seed)
    ends = ends.withColumnRenamed("pattern", "_pattern")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = _numbered(docs.select(row.alias("row"), F.col(id_col).alias("row_key"),
                                   _text_key(F.col(text_col)).alias("text_key"), pattern.alias("pattern")), many)
    taken = (packed.join(ends, F.col("pattern").eqNullSafe(F.col("_pattern")))
             .withColumn("n", _copies(seed)).where("n > 0"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
