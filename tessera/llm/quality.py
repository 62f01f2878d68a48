"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks.  The ratio
raw bytes / compressed bytes is high for repetitive text and near one for noise;
what is normal depends on the length, so every length band has its own limits.
A text is rejected if its whole ratio leaves its band, or if more than
``CHUNK_SHARE`` of its chunks leave theirs.  Base rules (too few words, too many
repeated three-word windows) are checked in the same pass.

Defined cases: a null text has no words and fails the base rules; texts shorter
than the first band have no ratio limits; a last chunk shorter than
``MIN_CHUNK`` bytes is not judged.  The decision is per row, so repeated rows
get the same verdict, and other columns are neither read nor renamed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text


@dataclass(frozen=True)
class Bands:
    """Ratio limits by length; ``whole`` rows are (least bytes, low, high).

    Low limits lie between noise (random base64 in words of 5 to 64 letters:
    1.14 at 300 bytes, 1.27 at 600, 1.33 at 1,000, 1.39 at 4,096, 1.40 above)
    and the least ratio of the corpus's prose (1.34 at 300 bytes, 1.43 at 600,
    1.65 at 1,000, 1.92 at 3,200, 2.2 at 12,800; chunks 1.90).  From 3,200 bytes
    they also lie above texts that are half noise (1.81 at most).
    """

    whole: tuple = ((200, 1.2, 3.0), (300, 1.27, 3.0), (400, 1.3, 3.0), (500, 1.32, 3.0), (600, 1.37, 3.0),
                    (800, 1.42, 4.0), (1000, 1.5, 4.0), (1600, 1.58, 4.0), (3200, 1.7, 5.0), (6400, 1.78, 5.0),
                    (12800, 1.85, 6.0))
    chunk_bytes: int = 4096
    min_chunk: int = 2048
    chunk_low: float = 1.55
    chunk_high: float = 5.0
    chunk_share: float = 0.5
    level: int = 3
    min_words: int = 50
    max_repeat_pct: int = 50


METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def repeat_words(hashes: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text, the words that lie in a ``width``-word window found twice or more."""
    n, counts = len(hashes), np.diff(offsets)
    covered = np.zeros(n, bool)
    if n >= width:
        full = n - width + 1
        text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        acc = _text.mix64(text[:full])
        for j in range(width):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + full]
            acc ^= acc >> np.uint64(29)
        whole = np.flatnonzero(text[:full] == text[width - 1:])
        key = _text.mix64(acc[whole])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = whole[twice]
        for j in range(width):
            covered[hit + j] = True
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _word_counts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, repeats = [], []
    for g in _text.word_groups(col, lower=False):
        words.append(np.diff(g.offsets))
        repeats.append(repeat_words(g.hashes, g.offsets))
    none = [np.empty(0, np.int64)]
    return np.concatenate(words or none), np.concatenate(repeats or none)


def _ratios(data, offsets, bands: Bands):
    zip_ = zstandard.ZstdCompressor(level=bands.level)
    view = memoryview(data)
    n = len(offsets) - 1
    whole, chunks, bad = np.ones(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        if hi > lo:
            whole[i] = (hi - lo) / len(zip_.compress(view[lo:hi]))
        if hi - lo <= bands.chunk_bytes:
            continue
        for at in range(lo, hi, bands.chunk_bytes):
            size = min(bands.chunk_bytes, hi - at)
            if size >= bands.min_chunk:
                r = size / len(zip_.compress(view[at:at + size]))
                chunks[i] += 1
                bad[i] += not bands.chunk_low <= r <= bands.chunk_high
    return whole, chunks, bad


def measure(col: pa.Array, bands: Bands = Bands()) -> pa.StructArray:
    """All measures and the verdict for a column of whole texts."""
    data, offsets = _text.text_buffers(col)
    n_words, n_repeat = _word_counts(col)
    word_chars = _text.per_text(data, offsets, lambda d, _: _text._IS_WORD[d] & ((d & 0xC0) != 0x80))
    n_symbols = _text.per_text(data, offsets, lambda d, _: _SYMBOL[d])
    view = memoryview(data)
    n_dup = np.array([duplicate_lines(bytes(view[offsets[i]:offsets[i + 1]]))
                      for i in range(len(offsets) - 1)], np.int64)
    ratio, n_chunks, n_bad = _ratios(data, offsets, bands)
    base_failed = (n_words < bands.min_words) | (100 * n_repeat > bands.max_repeat_pct * n_words)
    size = np.diff(offsets)
    low, high = np.zeros(len(size)), np.full(len(size), np.inf)
    for least, lo, hi in bands.whole:
        low[size >= least], high[size >= least] = lo, hi
    outside = (ratio < low) | (ratio > high) | (n_bad > bands.chunk_share * n_chunks)
    names = [x.split()[0] for x in METRICS.split(", ")]
    cols = [n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, ~(base_failed | outside),
            ratio, n_chunks, n_bad]
    return pa.StructArray.from_arrays([pa.array(c) for c in cols], names)


def metrics_udf(bands: Bands = Bands()):
    @F.arrow_udf(f"struct<{METRICS.replace(' ', ':').replace(',:', ',')}>")
    def metrics(text: pa.Array) -> pa.Array:
        return measure(text, bands)
    return metrics


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    bands: Bands = Bands()) -> DataFrame:
    """One row per input row: ``id_col`` and every measure with the verdict ``kept``."""
    return (docs.select(F.col(id_col), metrics_udf(bands)(F.col(text_col)).alias("_m"))
            .select(id_col, "_m.*"))


def keep_quality(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns as they are."""
    return docs.where(metrics_udf(bands)(F.col(text_col))["kept"])
