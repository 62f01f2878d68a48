"""Embedding near-duplicates by NN-descent.

Vectors are compared within a group: equal label and length.  Equal vectors form
a class; classes are the nodes of a neighbour graph.

1. *Start.*  Each of a few random trees orders a group by the signs of its
   projections; runs of that order give every node its first neighbours.
2. *Descent.*  In each round every node compares the neighbours it has and those
   that have it with each other, pairs with a new one only, on half-precision
   copies; every node keeps the best ``k`` of what it is offered.  Rounds end
   when few lists change.  A list that holds nothing but near-duplicates is
   saturated and doubles, up to ``most`` entries.
3. *Edges.*  Pairs near the threshold are confirmed in double precision;
   confirmed edges give components.
4. *Audit.*  Seeded sample vectors (``AUDIT``, a fixed number) are compared with
   all rows.  A true pair in two components is a miss and joins them; if fewer
   than ``recall`` of the true pairs were found, the descent goes on with new
   trees and longer lists.
5. *Links.*  What a bounded list cannot hold is counted, not listed: within each
   component all pairs are decided.  A component of up to ``BLOCK`` classes is
   compared in one task.  In a larger one, the classes within half the threshold
   angle of its centre are linked with each other by the triangle inequality;
   only the others are compared with all, block by block.  Tasks return counts.

Defined cases: null, empty or zero vectors, null or non-finite components and null
labels link with nothing; rows with a null id take part, ``component_id`` is the
least id that is not null, and a component without any id keeps one row; rows
that share an id are vectors of their own; an empty table gives an empty result.
Columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.codes import usable
from tessera.operators.graph import components
from tessera.sources.scratch import saved

COSINE = 0.93
NEIGHBOURS = 12
MOST = 48
TREES = 4
#: Signs that order a tree, and nodes of one run of it.
SIGNS = 16
RUN = 128
#: Rounds of one pass, and the share of changed entries at which it ends.
MAX_ROUNDS = 8
SETTLED = 0.002
AUDIT = 1024
RECALL = 0.98
MAX_PASSES = 4
BLOCK = 256
#: Error bound of cosines between half-precision copies.
HALF = 0.002


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def _stack(col: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a binary column of one length as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def _by_group(names: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    codes = names.dictionary_encode()
    index = codes.indices.to_numpy()
    for i, name in enumerate(codes.dictionary.to_pylist()):
        yield name, np.flatnonzero(index == i)


def vector_classes(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows: ``rid, vec_id, grp, v1, v2``; classes: ``node, grp, v1, v2, unit,
    half, n, least_id, first_rid``); the two longs name the vector, ``grp`` is null
    for rows that link with nothing."""
    vec, label = F.col(f"`{vec_col}`"), F.col(f"`{label_col}`").cast("string")
    v = F.transform(vec, lambda x: x.cast("double"))
    nonzero = F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), label.alias("label"),
                     F.when(usable(vec), v).alias("v"), F.monotonically_increasing_id().alias("rid"))
    group = F.when(F.coalesce(nonzero, F.lit(False)) & F.col("label").isNotNull(),
                   F.concat(F.size("v").cast("string"), F.lit(":"), "label"))
    rows = saved(rows.select("rid", "vec_id", group.alias("grp"), F.xxhash64(F.lit(1), "v").alias("v1"),
                             F.xxhash64(F.lit(2), "v").alias("v2"), "v"), "vectors")

    @F.arrow_udf("struct<unit:binary,half:binary>")
    def scaled(col: pa.Array) -> pa.Array:
        units = [_unit(np.asarray(x, np.float64)) for x in col.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([u.tobytes() for u in units], pa.binary()),
                                           pa.array([u.astype(np.float16).tobytes() for u in units], pa.binary())],
                                          ["unit", "half"])

    classes = rows.where("grp is not null").groupBy("grp", "v1", "v2").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"),
        F.min("rid").alias("first_rid"))
    # a row's number names its class: the table is written, so it stays
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "grp", "v1", "v2", scaled("v").alias("s"),
                             "n", "least_id", "first_rid")
    return rows.drop("v"), saved(classes.select("node", "grp", "v1", "v2", "s.unit", "s.half", "n", "least_id",
                                                "first_rid"), "classes")


def tree_neighbours(classes: DataFrame, seed: int, k: int) -> DataFrame:
    """``x, y, sim``: for every node the best ``k`` of its run in one random tree."""
    @F.arrow_udf("struct<code:int,along:float>")
    def place(names: pa.Array, half: pa.Array) -> pa.Array:
        code, along = np.zeros(len(half), np.int32), np.zeros(len(half), np.float32)
        for name, at in _by_group(names):
            x = _stack(half.take(pa.array(at)), np.float16).astype(np.float32)
            planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], SIGNS + 1))
            side = x @ planes.astype(np.float32)
            code[at] = (side[:, :SIGNS] > 0) @ (1 << np.arange(SIGNS)[::-1])
            along[at] = side[:, SIGNS]
        return pa.StructArray.from_arrays([pa.array(code), pa.array(along)], ["code", "along"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, halves = None, [], []

        def best():
            x = np.frombuffer(b"".join(halves), np.float16).reshape(len(nodes), -1).astype(np.float32)
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            near = np.argsort(-sim, axis=1, kind="stable")[:, :min(k, len(nodes) - 1)]
            ids = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, near.shape[1])), pa.array(ids[near].ravel()),
                 pa.array(np.take_along_axis(sim, near, 1).ravel())], ["x", "y", "sim"])

        for batch in batches:
            for name, node, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if name != group or len(nodes) == RUN:
                    if len(nodes) > 1:
                        yield best()
                    group, nodes, halves = name, [], []
                nodes.append(node)
                halves.append(half)
        if len(nodes) > 1:
            yield best()

    order = ["grp", "p.code", "p.along", "node"]
    return (classes.select("grp", "node", "half", place("grp", "half").alias("p")).repartitionByRange(*order)
            .sortWithinPartitions(*order).select("grp", "node", "half").mapInArrow(run, "x long, y long, sim float"))


def _best(edges: DataFrame, limits: DataFrame, most: int) -> DataFrame:
    """The best entries of every list (``x, y, sim, new``), as many as ``limits``
    (``x, size``) say."""
    order = Window.partitionBy("x").orderBy(F.desc("sim"), "y")
    first = edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return first.join(limits, "x", "left").where(F.col("_r") <= F.coalesce("size", F.lit(0))).drop("_r", "size")


def _meet(lists: DataFrame) -> DataFrame:
    """Pairs ``x, y, sim`` that meet in a list (``z, members``), one of them new, and
    would enter the list of ``x``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            offsets = members.offsets.to_numpy()
            flat = members.values
            u, new, worst = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            halves = flat.field(3).to_pylist()
            out = []
            for lo, hi in zip(offsets[:-1], offsets[1:]):
                if hi - lo < 2:
                    continue
                x = np.frombuffer(b"".join(halves[lo:hi]), np.float16).reshape(hi - lo, -1).astype(np.float32)
                sim = x @ x.T
                fits = (sim > worst[lo:hi, None]) & (new[lo:hi, None] | new[None, lo:hi])
                np.fill_diagonal(fits, False)
                i, j = np.nonzero(fits)
                out.append((u[lo + i], u[lo + j], sim[i, j]))
            if out:
                x, y, sim = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(sim)], ["x", "y", "sim"])

    return lists.select("members").mapInArrow(run, "x long, y long, sim float")


def _round(graph: DataFrame, classes: DataFrame, limits: DataFrame, k: int, most: int, turn: int) -> DataFrame:
    worst = graph.join(limits, "x").groupBy("x").agg(
        F.when(F.count(F.lit(1)) >= F.first("size"), F.min("sim")).alias("worst"))
    state = (classes.select(F.col("node").alias("u"), "half").join(worst.withColumnRenamed("x", "u"), "u", "left")
             .withColumn("worst", F.coalesce("worst", F.lit(-2.0)).cast("float")))
    back = Window.partitionBy("z").orderBy(F.desc("new"), F.xxhash64("u", "z", F.lit(turn)), "u")
    known = graph.select(F.col("x").alias("z"), F.col("y").alias("u"), "new")
    having = (graph.select(F.col("y").alias("z"), F.col("x").alias("u"), "new")
              .withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= k).drop("_r"))
    lists = known.unionByName(having).groupBy("z", "u").agg(F.max("new").alias("new"))
    members = (lists.join(state, "u").groupBy("z")
               .agg(F.collect_list(F.struct("u", "new", "worst", "half")).alias("members"), F.max("new").alias("any"))
               .where("any"))
    offered = _meet(members).withColumn("new", F.lit(True))
    every = graph.withColumn("new", F.lit(False)).unionByName(offered).groupBy("x", "y").agg(
        F.max("sim").alias("sim"), F.min("new").alias("new"))
    return saved(_best(every, limits, most), "graph")


def _limits(graph: DataFrame, limits: DataFrame, cosine: float, most: int) -> DataFrame:
    """Longer lists for nodes whose entries are all near-duplicates."""
    full = graph.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least"))
    longer = (F.col("n") >= F.col("size")) & (F.col("least") >= cosine - HALF)
    return saved(limits.join(full, "x", "left").select(
        "x", F.when(longer, F.least(2 * F.col("size"), F.lit(most))).otherwise(F.col("size")).alias("size")), "limits")


def descend(classes: DataFrame, graph: DataFrame | None, cosine: float, k: int, most: int, seed: int) -> DataFrame:
    """The neighbour graph ``x, y, sim, new`` after one pass of rounds."""
    limits = saved(classes.select(F.col("node").alias("x"), F.lit(k).alias("size")), "limits")
    start = tree_neighbours(classes, seed, k)
    for t in range(1, TREES):
        start = start.unionByName(tree_neighbours(classes, seed + t, k))
    start = start.withColumn("new", F.lit(True))
    if graph is not None:
        start = start.unionByName(graph.withColumn("new", F.lit(False)))
    start = start.groupBy("x", "y").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    graph = saved(_best(start, limits, most), "graph")
    for turn in range(MAX_ROUNDS):
        limits = _limits(graph, limits, cosine, most)
        graph = _round(graph, classes, limits, k, most, seed + turn)
        count = graph.agg(F.count(F.lit(1)).alias("n"), F.count_if("new").alias("new")).first()
        if count["new"] <= SETTLED * count["n"]:
            break
    return graph


def confirmed(graph: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """Edges ``a, b`` of the graph whose cosine in double precision reaches ``cosine``."""
    @F.arrow_udf("double")
    def dot(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(a.to_pylist(), b.to_pylist())],
                        pa.float64())

    pairs = graph.where(F.col("sim") >= cosine - HALF).select(F.least("x", "y").alias("a"),
                                                              F.greatest("x", "y").alias("b")).distinct()
    unit = classes.select(F.col("node").alias("a"), F.col("unit").alias("ua"))
    other = classes.select(F.col("node").alias("b"), F.col("unit").alias("ub"))
    return pairs.join(unit, "a").join(other, "b").where(dot("ua", "ub") >= cosine).select("a", "b")


def audit(placed: DataFrame, cosine: float, seed: int) -> tuple[float, DataFrame]:
    """(share of the sample's true pairs whose nodes (``node, c, grp, unit``) share a
    component, ``a, b``: pairs of components that a missed pair joins)."""
    spark = placed.sparkSession
    sample = placed.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(AUDIT).collect()
    groups: dict = {}
    for r in sample:
        groups.setdefault(r["grp"], []).append((r["node"], r["c"], np.frombuffer(r["unit"])))
    groups = {g: (np.array([r[0] for r in q]), np.array([r[1] for r in q]), np.array([r[2] for r in q]))
              for g, q in groups.items()}
    held = spark.sparkContext.broadcast(groups)  # AUDIT vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = found = 0
        missed = set()
        for batch in batches:
            for name, at in _by_group(batch.column(2)):
                if name not in held.value:
                    continue
                ids, comps, q = held.value[name]
                node, c = (batch.column(i).to_numpy()[at] for i in (0, 1))
                hit = _stack(batch.column(3).take(pa.array(at))) @ q.T >= cosine
                hit &= node[:, None] != ids[None, :]
                same = c[:, None] == comps[None, :]
                total += int(hit.sum())
                found += int((hit & same).sum())
                i, j = np.nonzero(hit & ~same)
                missed.update(zip(c[i].tolist(), comps[j].tolist()))
        rows = [(total, found, None, None), *((0, 0, min(p), max(p)) for p in missed)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["total", "found", "a", "b"])

    out = saved(placed.select("node", "c", "grp", "unit").mapInArrow(run, "total long, found long, a long, b long"),
                "audit")
    count = out.agg(F.sum("total"), F.sum("found")).first()
    return (count[1] / count[0] if count[0] else 1.0), out.where("a is not null").select("a", "b").distinct()


def neighbour_components(classes: DataFrame, cosine: float = COSINE, k: int = NEIGHBOURS, most: int = MOST,
                         recall: float = RECALL, seed: int = 12) -> tuple[DataFrame, float]:
    """(``node, c`` of every class, the audited share of true pairs within them)."""
    nodes = classes.select("node", "grp", "unit")
    graph, reached = None, 0.0
    for turn in range(MAX_PASSES):
        graph = descend(classes, graph, cosine, k << turn, most << turn, seed + 101 * turn)
        edges = saved(confirmed(graph, classes, cosine), "edges")
        placed = saved(nodes.join(components(edges), "node", "left").withColumn("c", F.coalesce("component", "node"))
                       .drop("component"), "placed")
        reached, missed = audit(placed, cosine, seed + turn)
        if reached >= recall:
            break
    if not missed.isEmpty():
        merged = components(missed).withColumnRenamed("node", "c")
        placed = placed.join(merged, "c", "left").withColumn("c", F.coalesce("component", "c")).drop("component")
    return saved(placed.select("node", "c"), "components"), reached


def _small_counts(members: DataFrame, cosine: float) -> DataFrame:
    """Links of components of up to ``BLOCK`` classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, nodes, sizes, units, out = None, [], [], [], []

        def flush():
            if nodes:
                x, n = np.frombuffer(b"".join(units)).reshape(len(nodes), -1), np.array(sizes, np.int64)
                near = x @ x.T >= cosine
                np.fill_diagonal(near, True)
                out.append((np.array(nodes, np.int64), near @ n - 1))

        for batch in batches:
            for c, node, n, unit in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != comp:
                    flush()
                    comp, nodes, sizes, units = c, [], [], []
                nodes.append(node)
                sizes.append(n)
                units.append(unit)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "links"])
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "links"])

    return (members.select("c", "node", "n", "unit").repartition("c").sortWithinPartitions("c")
            .mapInArrow(run, "node long, links long"))


def _inner(members: DataFrame, cosine: float) -> DataFrame:
    """``members`` with ``inner``: within half the threshold angle of the centre of
    the component, the mean direction of its classes."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_numpy()
            rows = []
            for comp in np.unique(c):
                x = _stack(batch.column(1).filter(pa.array(c == comp))).sum(0)
                rows.append((np.full(len(x), comp), np.arange(len(x), dtype=np.int32), x))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*rows)], ["c", "i", "s"])

    centre = (members.select("c", "unit").mapInArrow(partial, "c long, i int, s double")
              .groupBy("c", "i").agg(F.sum("s").alias("s"))
              .groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]).alias("m")))

    @F.arrow_udf("boolean")
    def near(unit: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for u, x in zip(unit.to_pylist(), m.to_pylist()):
            centre_of = np.asarray(x)
            size = math.sqrt(centre_of @ centre_of)
            out.append(bool(size > 0 and np.frombuffer(u) @ centre_of / size >= math.sqrt((1 + cosine) / 2) + 1e-12))
        return pa.array(out, pa.bool_())

    return saved(members.join(centre, "c").withColumn("inner", near("unit", "m")).drop("m"), "members")


def _large_counts(members: DataFrame, cosine: float) -> DataFrame:
    """Links of larger components, by blocks of about ``BLOCK`` classes."""
    members = _inner(members, cosine)
    sizes = members.groupBy("c").agg(F.sum(F.when(F.col("inner"), F.col("n")).otherwise(0)).alias("within"),
                                     F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"),
                                     F.ceil(F.count_if(~F.col("inner")) / BLOCK).alias("outer_blocks"))
    m = members.join(sizes, "c")
    block = F.struct("node", "n", "inner", "unit")
    every = m.groupBy("c", F.pmod(F.xxhash64("node"), "blocks").alias("j"), "outer_blocks").agg(
        F.collect_list(block).alias("theirs"))
    every = every.where("outer_blocks > 0").withColumn("i", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("outer_blocks") - 1))).drop("outer_blocks")
    outer = m.where(~F.col("inner")).groupBy("c", F.pmod(F.xxhash64("node"), "outer_blocks").alias("i")).agg(
        F.collect_list(block).alias("ours"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (a, na, _, ua), (b, nb, ib, ub) = ([s.values.field(k) for k in range(4)] for s in (
                    batch.column(0)[row], batch.column(1)[row]))
                a, b, na, nb = (v.to_numpy() for v in (a, b, na, nb))
                near = _stack(ua) @ _stack(ub).T >= cosine
                near |= a[:, None] == b[None, :]
                ib = ib.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b[ib]])), pa.array(np.concatenate(
                    [near @ nb, na @ near[:, ib]]))], ["node", "links"])

    met = (outer.join(every, ["c", "i"]).select("ours", "theirs").mapInArrow(compare, "node long, links long")
           .groupBy("node").agg(F.sum("links").alias("met")))
    return m.join(met, "node", "left").select(
        "node", (F.coalesce("met", F.lit(0)) + F.when(F.col("inner"), F.col("within")).otherwise(0) - 1).alias("links"))


def count_links(placed: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """``node, links``: vectors linked with a vector of the class, all pairs within
    components decided."""
    sizes = placed.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    members = saved(placed.join(sizes, "c").join(classes.select("node", "n", "unit"), "node"), "members")
    alone = members.where("size = 1").select("node", (F.col("n") - 1).alias("links"))
    few = members.where((F.col("size") > 1) & (F.col("size") <= BLOCK)).drop("size")
    many = members.where(F.col("size") > BLOCK).drop("size")
    return alone.unionByName(_small_counts(few, cosine)).unionByName(_large_counts(many, cosine))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row."""
    rows, classes = vector_classes(df, id_col, vec_col, label_col)
    placed, _ = neighbour_components(classes, cosine, **options)
    links = count_links(placed, classes, cosine)
    named = classes.drop("unit", "half").join(placed, "node")
    comps = named.groupBy("c").agg(F.min("least_id").alias("component_id"), F.min("first_rid").alias("first"))
    of = saved(named.join(comps, "c").join(links, "node").select("grp", "v1", "v2", "links", "component_id", "first"),
               "links")
    mine = rows.where("grp is not null").join(of, ["grp", "v1", "v2"])
    kept: Column = F.when(F.col("component_id").isNull(), F.col("rid") == F.col("first")).otherwise(
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    out = mine.select("vec_id", F.col("links").alias("n_links"), "component_id", kept.alias("kept"))
    alone = rows.where("grp is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)
