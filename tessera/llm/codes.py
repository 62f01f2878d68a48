"""Vector codes: integer codebooks by part, searched by Orchard's method.

Components become integers floor(4096 * x); a vector is cut into ``parts`` equal
consecutive parts.  Every part position has a codebook that starts as that part
of the first kept vectors and is trained by rounds of assignment and
componentwise floor means.  All arithmetic is on integers, so results do not
depend on the split of the rows.

Nearest entries are found by Orchard search: every entry keeps the other entries
sorted by distance; a query walks the list of its best entry, jumps to the list
of an entry that improves it, skips visited entries and stops where the list's
distance exceeds twice the current one (no closer or equal entry can follow).
The queries of a batch walk in step, in numpy.

A round sends one row per part, entry and position from each task; the driver
holds the codebooks alone (parts x entries x width integers).

Defined cases: null vectors, empty ones and those with null or non-finite
components are dropped; so are vectors of another length than the first kept
one, and components beyond ``limit(width)``, whose squares do not fit 64 bits.  If
the length is no multiple of ``parts``, the last parts are filled with zeros.
Null ids come after all others and rows of one id in the order of their
components; fewer vectors than entries give smaller codebooks; repeated rows get
equal codes; no kept row gives an empty result.  Columns of other names are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import saved, small

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096


def limit(width: int) -> int:
    """Integers of at least this size are not coded: sums of ``width`` squared
    differences, four times and over all parts, must fit 64 bits."""
    return int((2.0 ** 56 / max(width, 1)) ** 0.5)


def usable(vec: Column) -> Column:
    """Not null or empty, and every component finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(False))


def orchard(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of ``book`` for every row of
    ``x``; ties go to the lower index."""
    k = len(book)
    gap = ((book[:, None, :] - book[None, :, :]) ** 2).sum(-1)
    key = gap.copy()
    np.fill_diagonal(key, -1)
    lists = np.argsort(key, axis=1, kind="stable")[:, 1:]
    gap = np.take_along_axis(gap, lists, axis=1)
    cur = np.zeros(len(x), np.int64)
    best = ((x - book[0]) ** 2).sum(1)
    seen = np.zeros((len(x), k), bool)
    seen[:, 0] = True
    at = np.zeros(len(x), np.int64)
    live = np.arange(len(x) if k > 1 else 0)
    while len(live):
        entry = lists[cur[live], at[live]]
        on = gap[cur[live], at[live]] <= 4 * best[live]
        live, entry = live[on], entry[on]
        at[live] += 1
        fresh = ~seen[live, entry]
        row, entry = live[fresh], entry[fresh]
        seen[row, entry] = True
        d = ((x[row] - book[entry]) ** 2).sum(1)
        better = (d < best[row]) | ((d == best[row]) & (entry < cur[row]))
        row = row[better]
        cur[row], best[row], at[row] = entry[better], d[better], 0
        live = live[at[live] < k - 1]
    return cur, best


def _matrix(col: pa.Array, dim: int, width: int, parts: int) -> np.ndarray:
    """(rows, parts, width) integers of a list column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = np.zeros((len(col), parts * width), np.int64)
    x[:, :dim] = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)
    return x.reshape(len(col), parts, width)


def _refine(vectors: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    """The codebooks after one round of assignment and floor means."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim, width, parts)
            for p in range(parts):
                near, _ = orchard(x[:, p], books[p])
                n[p] += np.bincount(near, minlength=k)
                np.add.at(s[p], near, x[:, p])
        if n.any():
            at = np.indices(s.shape).reshape(3, -1)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(i.astype(np.int32)) for i in at), pa.array(np.repeat(n.ravel(), width)),
                 pa.array(s.ravel())], ["part", "entry", "place", "n", "s"])

    sums = (vectors.select("ints").mapInArrow(run, "part int, entry int, place int, n long, s long")
            .groupBy("part", "entry", "place")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect())
    out = books.copy()
    for r in sums:
        if r["n"]:
            out[r["part"], r["entry"], r["place"]] = int(r["s"]) // r["n"]
    return out


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", parts: int = PARTS) -> tuple[DataFrame, int]:
    """(``vec_id, label, ints`` of the kept rows, their length)."""
    vec = F.col(f"`{vec_col}`")
    kept = df.where(usable(vec)).select(F.col(f"`{id_col}`").alias("vec_id"),
                                        F.col(f"`{label_col}`").alias("label"),
                                        F.transform(vec, lambda x: x.cast("double") * SCALE).alias("x"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x").alias("n")).first()
    dim = first["n"] if first else 0
    most = limit(-(-dim // parts))
    ints = kept.where((F.size("x") == dim) & F.forall("x", lambda x: F.abs(x) < most)).select(
        "vec_id", "label", F.transform("x", lambda x: F.floor(x).cast("long")).alias("ints"))
    return saved(ints, "vectors"), dim


def train_codebooks(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES,
                    rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of ``integer_vectors``."""
    width = -(-dim // parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        start[i, :dim] = r["ints"]
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        books = _refine(vectors, books, dim)
    return books


def encode(vectors: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits per part, squared distance to
    the coded vector."""
    parts, _, width = books.shape

    @F.arrow_udf("struct<code:string,error:bigint>")
    def coded(col: pa.Array) -> pa.Array:
        x = _matrix(col, dim, width, parts)
        index, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        for p in range(parts):
            near, d = orchard(x[:, p], books[p])
            index[:, p] = near
            error += d
        return pa.StructArray.from_arrays([pa.array([r.tobytes().hex() for r in index], pa.string()),
                                           pa.array(error)], ["code", "error"])

    return vectors.select("vec_id", "label", coded("ints").alias("c")).select(
        "vec_id", "label", "c.code", "c.error")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry, position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per kept row;
    ``label_error`` sums the errors of equal labels, nulls together."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    vectors, dim = integer_vectors(df, id_col, vec_col, label_col, parts)
    books = train_codebooks(vectors, dim, parts, entries, rounds)
    if not books.size:
        return vectors.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                             F.lit(0).cast("long").alias("label_error"),
                                             F.lit("").alias("codebooks_sha256"))
    coded = saved(encode(vectors, books, dim), "codes")
    total = F.sum(F.col("error").cast("decimal(28,0)")).try_cast("long")
    labels = small(saved(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "labels"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
