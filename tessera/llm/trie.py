"""Prefix trie of conversations by the Euler-tour technique.

1. Turns become digests; running sums of hashes over (depth, digest) name every
   prefix, so that no conversation is gathered.  A node is a distinct prefix,
   called by its smallest member and its depth.
2. Every node has an enter and an exit arc.  An enter arc is followed by the
   first child's enter arc or the node's own exit arc, an exit arc by the next
   sibling's enter arc or the parent's exit arc; siblings stand in the order of
   their smallest members.
3. The tour is list-ranked: tasks hold ranges of arcs and contract every piece of
   the list that lies within a range to its first arc, until one task's worth of
   arcs is left; the ranks go back level by level.  Arcs are sorted by member and
   depth, as the tour mostly runs; where a level shrinks too little, half of the
   arcs, drawn by coins, splice their successors of the other half.
4. Prefix sums over positions give every subtree's leaves and savings as
   differences between its exit and its enter arc.

Conversations are ordered by turn (null first), turns of one number by the
digest of role and text.  Defined cases: rows with a null id belong to no
conversation; null roles and texts are empty; a long text is read once, for its
digest and length; repeated rows are turns of their own; a conversation without
turns of its own is known only by its rows, so it does not occur; an empty table
gives no nodes.  Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._ranges import SPREAD, following, ranged, running, spread
from tessera.sources.scratch import saved

#: Arcs that one task contracts, and the most ranges of a level.
ARCS = 1 << 14
RANGES = 1 << 15
#: A level that keeps more than this share of its arcs is spliced by coins.
SHRINK = 0.75
#: Member ids in one piece of a node's digest.
PIECE = 512
#: Positions of a block of prefix sums, and blocks of a larger one.
BLOCK = 1 << 12

_LOW = 0xFFFFFFFF


def head_length(conv: Column) -> Column:
    """Turns that a conversation shares with the first one of its hundred."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


def turn_digests(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, pos, digest, chars``: turns numbered from 0."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"))
    order = ["turn", "digest", SPREAD]
    turns = ranged(spread(rows), ["conv", *order], "turns")
    return running(turns, ["conv"], order, {"pos": F.lit(1).cast("long")}).select(
        "conv", (F.col("pos") - 1).alias("pos"), "digest", "chars")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``conv, total`` of every conversation; its rows ``conv, depth, digest,
    chars, total``): the head of the first conversation of its hundred, then its
    own turns after as many."""
    sizes = saved(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "sizes")
    head = head_length(F.col("conv"))
    of = sizes.select("conv", "n", head.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    first = sizes.where("conv % 100 = 0").select(F.col("conv").alias("base"), F.col("n").alias("have"))
    took = F.least("h", F.coalesce("have", F.lit(0)))
    convs = saved(of.join(first, "base", "left").select(
        "conv", "base", "h", took.alias("took"),
        (took + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    heads = turns.where("conv % 100 = 0 and pos < 5").withColumnRenamed("conv", "base")
    shared = (convs.where("took > 0").join(heads, "base").where("pos < took")
              .select("conv", (F.col("pos") + 1).alias("depth"), "digest", "chars", "total"))
    own = turns.where(F.col("pos") >= head).join(convs, "conv").select(
        "conv", (F.col("took") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "chars", "total")
    return convs.select("conv", "total"), shared.unionByName(own)


def prefix_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with the name of the prefix that ends there (``k1, k2``) and of the
    one before (``p1, p2``)."""
    term = {f"s{i}": v for j in (0, 1) for i, v in (
        (2 * j, F.shiftrightunsigned(F.xxhash64(F.lit(j), "depth", "digest"), 32)),
        (2 * j + 1, F.xxhash64(F.lit(j), "depth", "digest").bitwiseAND(_LOW)))}
    sums = running(ranged(rows, ["conv", "depth"], "prefixes"), ["conv"], ["depth"], term)

    def name(j: int, less: bool) -> Column:
        hi, lo = (F.col(f"s{i}") - (term[f"s{i}"] if less else F.lit(0)) for i in (2 * j, 2 * j + 1))
        return F.shiftleft(hi.bitwiseAND(_LOW), 32).bitwiseOR(lo.bitwiseAND(_LOW))

    return saved(sums.select("conv", "depth", "chars", "total", name(0, False).alias("k1"), name(1, False).alias("k2"),
                             name(0, True).alias("p1"), name(1, True).alias("p2")), "prefixes")


def node_table(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, depth, parent, n_convs, chars, k1, k2`` of every node."""
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    nodes = saved(rows.groupBy("depth", "k1", "k2").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2")), "nodes")
    names = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                         F.col("conv").alias("parent"))
    deep = nodes.where("depth > 1").join(names, ["depth", "p1", "p2"])
    top = nodes.where("depth = 1").withColumn("parent", F.lit(root["conv"]).cast("long"))
    columns = ["conv", "depth", "parent", "n_convs", "chars", "k1", "k2"]
    at_root = convs.limit(1).select(F.lit(root["conv"]).cast("long").alias("conv"), F.lit(0).cast("long").alias("depth"),
                                    F.lit(None).cast("long").alias("parent"), F.lit(root["n"]).alias("n_convs"),
                                    F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("k1"),
                                    F.lit(0).cast("long").alias("k2"))
    return deep.select(columns).unionByName(top.select(columns)).unionByName(at_root)


def tour(nodes: DataFrame) -> DataFrame:
    """``c, e, nc, ne, leaf, saving``: arcs (member, 2 * depth, or 1 more for exits)
    with their successors, and what the node adds to its subtree's sums."""
    n = ranged(nodes.select("conv", "depth", "parent", "n_convs", "chars"), ["parent", "depth", "conv"], "siblings")
    kids = n.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(
        F.min("conv").alias("child"), F.count(F.lit(1)).alias("n_children"))
    n = following(n, ["parent", "depth"], "conv", "sibling").join(kids, ["conv", "depth"], "left")
    enter = F.struct((2 * F.col("depth")).alias("e"), F.coalesce("child", "conv").alias("nc"),
                     F.when(F.col("child").isNotNull(), 2 * F.col("depth") + 2).otherwise(2 * F.col("depth") + 1)
                     .alias("ne"),
                     F.col("child").isNull().cast("long").alias("leaf"),
                     ((F.col("n_convs") - 1) * F.col("chars")).alias("saving"))
    leave = F.struct((2 * F.col("depth") + 1).alias("e"), F.coalesce("sibling", "parent").alias("nc"),
                     F.when(F.col("sibling").isNotNull(), 2 * F.col("depth"))
                     .when(F.col("depth") > 0, 2 * F.col("depth") - 1).alias("ne"),
                     F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saving"))
    return saved(n.select(F.col("conv").alias("c"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
                          F.explode(F.array(enter, leave)).alias("x")).select("c", "x.*", "n_children"), "tour")


_LEVEL = "c long, e long, hc long, he long, dist long, nc long, ne long, len long"


def _contract(c, e, nc, ne, length):
    """Columns of ``_LEVEL`` for one range of arcs; ``ne`` is -1 at the list's end.

    Every arc learns the first arc of its piece of the list and its distance to
    it; the first arc gets the piece's length and the arc that follows it."""
    known = np.unique(np.concatenate([c, nc[ne >= 0]]))
    width = int(max(e.max(), ne.max())) + 1
    key = np.searchsorted(known, c) * width + e
    to = np.where(ne >= 0, np.searchsorted(known, nc) * width + ne, -1)
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key[order], to), len(c) - 1)
    after = np.where(key[order][at] == to, order[at], -1)
    inner = np.flatnonzero(after >= 0)
    head = np.arange(len(c))
    dist = np.zeros(len(c), np.int64)
    head[after[inner]], dist[after[inner]] = inner, length[inner]
    while True:
        further = head[head]
        if (further == head).all():
            break
        dist, head = dist + dist[head], further
    tail = np.flatnonzero(after < 0)
    out = np.zeros((3, len(c)), np.int64)
    out[:, head[tail]] = nc[tail], ne[tail], dist[tail] + length[tail]
    return c, e, c[head], e[head], dist, *out


def _contract_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    columns = [table.column(n).fill_null(-1 if n == "ne" else 0).to_numpy() for n in ("c", "e", "nc", "ne", "len")]
    out = _contract(*columns)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], [f.split()[0] for f in _LEVEL.split(", ")])


def _splice(arcs: DataFrame, turn: int) -> DataFrame:
    """A ``_LEVEL`` in which arcs of the coin's one side take over their successors
    of the other."""
    coin = F.xxhash64(F.lit(turn), "c", "e") % 2 == 0
    takes = arcs.where(coin)
    given = arcs.where(~coin).select(F.col("c").alias("nc"), F.col("e").alias("ne"), F.col("nc").alias("c2"),
                                     F.col("ne").alias("e2"), F.col("len").alias("l2"), F.lit(True).alias("hit"))
    met = saved(takes.join(given, ["nc", "ne"], "left"), "splice")
    own = [F.col("c").alias("hc"), F.col("e").alias("he"), F.lit(0).cast("long").alias("dist")]
    first = met.select("c", "e", *own, *[F.when(F.col("hit"), F.col(b)).otherwise(F.col(a)).alias(a)
                                         for a, b in (("nc", "c2"), ("ne", "e2"))],
                       (F.col("len") + F.coalesce("l2", F.lit(0))).alias("len"))
    gone = met.where("hit").select(F.col("nc").alias("c"), F.col("ne").alias("e"), F.col("c").alias("hc"),
                                   F.col("e").alias("he"), F.col("len").alias("dist"),
                                   *[F.lit(0).cast("long").alias(x) for x in ("nc", "ne", "len")])
    rest = arcs.where(~coin).join(met.where("hit").select(F.col("nc").alias("c"), F.col("ne").alias("e")),
                                  ["c", "e"], "left_anti").select("c", "e", *own, "nc", "ne", "len")
    return first.unionByName(gone).unionByName(rest)


def list_rank(arcs: DataFrame, per_task: int = ARCS) -> DataFrame:
    """``c, e, rank`` of every arc: arcs before it in the list (``c, e, nc, ne``; the
    last arc's successor is null).  The arcs are one list."""
    now = arcs.select("c", "e", "nc", "ne", F.lit(1).cast("long").alias("len"))
    n, levels = now.count(), []
    while True:
        parts = min(-(-n // per_task), RANGES)
        dealt = now.repartitionByRange(parts, "c", "e") if parts > 1 else now.repartition(1)
        levels.append(saved(dealt.mapInArrow(_contract_ranges, _LEVEL), "level"))
        if parts == 1:
            break
        left = levels[-1].where("dist = 0").select("c", "e", "nc", F.expr("nullif(ne, -1)").alias("ne"), "len")
        m = left.count()
        if m > SHRINK * n:
            levels.append(saved(_splice(left, len(levels)), "level"))
            left = levels[-1].where("dist = 0").select("c", "e", "nc", "ne", "len")
            m = left.count()
        now, n = left, m
    ranks = levels.pop().select("c", "e", F.col("dist").alias("rank"))
    for level in reversed(levels):
        heads = ranks.select(F.col("c").alias("hc"), F.col("e").alias("he"), F.col("rank").alias("r"))
        ranks = level.join(heads, ["hc", "he"]).select("c", "e", (F.col("r") + F.col("dist")).alias("rank"))
    return ranks


def position_sums(df: DataFrame, pos: str, cols: list[str], block: int = BLOCK) -> DataFrame:
    """``df`` with running sums of ``cols`` in the order of ``pos`` (0, 1, ...), each
    row's own value included: within blocks, of blocks within larger blocks, and
    of these."""
    d = df.withColumns({"_b": F.floor(F.col(pos) / block).cast("long"),
                        "_s": F.floor(F.col(pos) / (block * block)).cast("long")})
    before = {"_s": Window.orderBy("_s"), "_b": Window.partitionBy("_s").orderBy("_b")}
    blocks = saved(d.groupBy("_s", "_b").agg(*[F.sum(c).alias(c) for c in cols]), "blocks")
    larger = blocks.groupBy("_s").agg(*[F.sum(c).alias(c) for c in cols])
    sums = [t.select(*keys, *[(F.sum(c).over(before[keys[-1]].rowsBetween(Window.unboundedPreceding, -1))).alias(
        f"_{keys[-1]}_{c}") for c in cols]) for t, keys in ((larger, ["_s"]), (blocks, ["_s", "_b"]))]
    offsets = sums[1].join(sums[0], "_s").select(
        "_b", *[(F.coalesce(f"__s_{c}", F.lit(0)) + F.coalesce(f"__b_{c}", F.lit(0))).alias(f"_o_{c}") for c in cols])
    w = Window.partitionBy("_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (d.withColumns({f"{c}_sum": F.sum(c).over(w) for c in cols}).join(offsets, "_b")
            .withColumns({f"{c}_sum": F.col(f"{c}_sum") + F.col(f"_o_{c}") for c in cols})
            .drop("_b", "_s", *[f"_o_{c}" for c in cols]))


def subtree_sums(arcs: DataFrame) -> DataFrame:
    """``conv, depth, n_children, n_leaves, saved_tokens`` of every node of a tour."""
    placed = saved(list_rank(arcs).join(arcs.select("c", "e", "leaf", "saving", "n_children"), ["c", "e"]), "placed")
    sums = position_sums(placed, "rank", ["leaf", "saving"])
    leaving = F.col("e") % 2 == 1

    def within(c: str) -> Column:
        return F.sum(F.when(leaving, F.col(f"{c}_sum")).otherwise(F.col(c) - F.col(f"{c}_sum")))

    return sums.groupBy(F.col("c").alias("conv"), F.floor(F.col("e") / 2).cast("long").alias("depth")).agg(
        F.max("n_children").alias("n_children"), within("leaf").alias("n_leaves"), within("saving").alias("saved_tokens"))


def end_digests(rows: DataFrame, convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conv, depth, ends_sha256`` of the nodes at which conversations end.

    A digest is sequential: one task reads a node's members in order, as pieces of
    ``PIECE`` ids, and holds one piece at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for c, d, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (c, d) != node:
                    if state is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (c, d), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["conv", "depth", "ends_sha256"])
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())],
                                             ["conv", "depth", "ends_sha256"])

    ends = rows.where("depth = total").select("depth", "k1", "k2", F.col("conv").alias("member")).unionByName(
        convs.where("total = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"),
                                        F.lit(0).cast("long").alias("k2"), F.col("conv").alias("member")))
    named = ends.join(nodes.select("depth", "k1", "k2", "conv"), ["depth", "k1", "k2"]).select("conv", "depth", "member")
    r = ranged(named, ["conv", "depth", "member"], "ends")
    number = F.row_number().over(Window.partitionBy("_part", "conv", "depth").orderBy("member"))
    pieces = (r.withColumn("_piece", F.floor((number - 1) / PIECE)).groupBy("conv", "depth", "_part", "_piece")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",")
                   .alias("ids")))
    return (pieces.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "_part", "_piece")
            .select("conv", "depth", "ids").mapInArrow(run, "conv long, depth long, ends_sha256 string"))


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``."""
    turns = saved(turn_digests(df, id_col, turn_col, role_col, text_col), "turns")
    convs, rebuilt = rebuild(turns)
    rows = prefix_rows(rebuilt)
    nodes = saved(node_table(rows, convs), "nodes")
    if nodes.isEmpty():
        sums = nodes.select("conv", "depth", *[F.lit(0).cast("long").alias(c)
                                               for c in ("n_children", "n_leaves", "saved_tokens")])
    else:
        sums = subtree_sums(tour(nodes))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, ["conv", "depth"]).join(end_digests(rows, convs, nodes), ["conv", "depth"], "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
                    "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
