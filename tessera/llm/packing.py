"""Harmonic packing of documents into sequences of a fixed capacity.

A piece of length n belongs to the class j = floor(capacity / n): its length
lies in (capacity/(j+1), capacity/j], and a bin of the class takes exactly j
pieces.  A bin thus needs no search: numbering the pieces of a class is enough,
and groups of a class are numbered independently across workers.  Documents may
be cut, so a cut at a class border replaces a piece that would waste more than
``WASTE`` of a bin: the border part fills its class without loss and the
remainder is small, where classes are narrow.

Bins that a group leaves open go on: the pieces of open bins are dealt into groups
of their class again, level by level, until a class has one group.  A group holds
``FILL`` bins or more, so a level keeps at most one piece in ``FILL``.  What is then
left, fewer than j pieces of each class j, is bounded by the capacity alone and
filled first-fit in one small task.

Defined cases: null and empty texts hold the end token only; repeated rows are
packed as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.sources.scratch import saved

CAPACITY = 2048
END_ID = 1
WASTE = 0.01
#: Pieces of a group, or bins of one where these take more pieces.
GROUP = 1 << 10
FILL = 64


def cut(n: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        border = capacity // (j + 1)
        if capacity - j * rest <= waste * capacity or rest - border < 1 or rest <= capacity // 32:
            out.append(rest)
            break
        out.append(border)
        rest -= border
    return out


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces of every document: where they start, their ids and CRC-32."""
    file = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(file)
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
        names = [c.split()[0] for c in PIECES.split(", ")][:6 if with_ids else 5]

        def made(cols):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            cols, held = [[] for _ in names], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.asarray([*enc.ids(text.as_py()), END_ID], "<u4")
                start = 0
                for size in cut(len(ids), capacity):
                    part = ids[start:start + size]
                    row = (doc_id, start, size, zlib.crc32(part.tobytes()), len(ids), part)
                    for c, v in zip(cols, row):
                        c.append(v)
                    start += size
                held += len(ids)
                if held > 1 << 20:
                    yield made(cols)
                    cols, held = [[] for _ in names], 0
            yield made(cols)

    schema = PIECES if with_ids else PIECES.rpartition(",")[0]
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, schema))


def _fill(rows: DataFrame, group: list[str]) -> DataFrame:
    """Number the pieces of each group; ``bin`` counts the bins, ``place`` the
    pieces of one, ``full`` whether the bin got all its pieces."""
    order = Window.partitionBy(*group).orderBy("seed", "doc_id", "start", "ids_crc32")
    n = F.row_number().over(order) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return (rows.withColumn("_n", n).withColumn("_size", size)
            .withColumn("bin", F.floor(F.col("_n") / F.col("class")))
            .withColumn("place", F.col("_n") % F.col("class"))
            .withColumn("full", (F.col("bin") + 1) * F.col("class") <= F.col("_size"))
            .drop("_n", "_size"))


def _first_fit(capacity: int):
    def run(table):
        """First fit by falling length over the bounded rest."""
        order = table.sort_by([("length", "descending"), ("seed", "ascending"),
                               ("doc_id", "ascending"), ("start", "ascending"),
                               ("ids_crc32", "ascending")])
        room, used, at, number = [], [], [], []
        for n in order.column("length").to_pylist():
            k = next((k for k, r in enumerate(room) if r >= n), len(room))
            if k == len(room):
                room.append(capacity)
                used.append(0)
            number.append(k)
            at.append(capacity - room[k])
            room[k] -= n
            used[k] += 1
        for name, values in (("bin", number), ("offset", at)):
            order = order.append_column(name, pa.array(values, pa.int64()))
        return order
    return run


KEYS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP, fill: int = FILL) -> DataFrame:
    """Give every piece its ``sequence_id`` and gapless ``offset``.

    ``parts`` has the columns of ``pieces`` and is read several times: cut its
    lineage first, as ``pack_documents`` does.
    """
    names = [c.split()[0] for c in KEYS.split(", ")]
    rows = parts.select(*names).withColumn("class", F.floor(F.lit(capacity) / F.col("length"))) \
        .withColumn("seed", F.xxhash64("doc_id", "start", "ids_crc32"))
    # pieces of repeated rows have one seed; the deal spreads them over the groups
    rows = saved(rows.withColumn("deal", F.monotonically_increasing_id()), "dealt")

    def number(level, class_, salt, bin_):
        """Level, class, group and bin in one positive long: 4, 12, 31 and 16 bits."""
        return (F.shiftleft(F.lit(level).cast("long"), 59) + F.shiftleft(class_.cast("long"), 47)
                + F.shiftleft(salt.cast("long"), 16) + bin_).alias("sequence_id")

    def placed(x: DataFrame, level: int) -> DataFrame:
        before = (Window.partitionBy("class", "salt", "bin").orderBy("place")
                  .rowsBetween(Window.unboundedPreceding, -1))
        return x.select(*names, "class", F.lit(level).alias("level"),
                        number(level, F.col("class"), F.col("salt"), F.col("bin")),
                        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))

    out, level, left = None, 0, rows
    while True:
        level += 1
        # classes are as many as the distinct floor(capacity / n): bounded by the capacity
        size = F.greatest(F.lit(group), fill * F.col("class"))
        groups = left.groupBy("class").agg(F.count(F.lit(1)).alias("n")).select(
            "class", F.greatest(F.floor(F.col("n") / size), F.lit(1)).alias("n_groups"))
        groups = saved(groups, "groups")
        more = groups.agg(F.max("n_groups")).first()[0] or 1
        salted = (left.join(F.broadcast(groups), "class")
                  .withColumn("salt", F.pmod(F.xxhash64("seed", "deal", F.lit(level)), F.col("n_groups"))).drop("n_groups"))
        filled = saved(_fill(salted, ["class", "salt"]), "filled")
        part = placed(filled.where("full"), level)
        out = part if out is None else out.unionByName(part)
        left = filled.where(~F.col("full")).drop("bin", "place", "full", "salt")
        if more == 1:
            break
    # fewer than j pieces of each class j: bounded by the capacity
    rest = left.select(*names, "class", "seed", F.lit(15).alias("level"))
    last = rest.groupBy("level").applyInArrow(
        _first_fit(capacity), f"{KEYS}, class long, seed long, level int, bin long, offset long")
    last = last.select(*names, "class", "level", number(15, F.lit(0), F.lit(0), F.col("bin")), "offset")
    return out.unionByName(last).select(*names, "sequence_id", "offset", "class", "level")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cut, number and pack all documents; one row per piece."""
    parts = pieces(docs, id_col, text_col, path, capacity, with_ids=False)
    return pack(saved(parts, "pieces"), capacity)
