"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def groups(texts: dict) -> dict:
    """id -> least id reachable over links of similarity 0.75 or more."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def quality(text, bands):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    raw = t.encode()
    ratio = len(raw) / len(zstandard.ZstdCompressor(level=bands.level).compress(raw)) if raw else 1.0
    low, high = 0.0, float("inf")
    for least, a, b in bands.whole:
        if len(raw) >= least:
            low, high = a, b
    chunks = [raw[i:i + bands.chunk_bytes] for i in range(0, len(raw), bands.chunk_bytes)]
    chunks = [c for c in chunks if len(c) >= bands.min_chunk] if len(raw) > bands.chunk_bytes else []
    rates = [len(c) / len(zstandard.ZstdCompressor(level=bands.level).compress(c)) for c in chunks]
    bad = sum(not bands.chunk_low <= r <= bands.chunk_high for r in rates)
    kept = not failed and low <= ratio <= high and bad <= bands.chunk_share * len(chunks)
    return {"n_words": len(w), "word_chars": sum(map(len, w)),
            "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "base_failed": failed, "kept": kept}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _ok(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in value.split(".")),
            "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items()
            for m in re.finditer(p, text or "") if _ok(k, m.group())]


def redacted(text):
    """Base kinds only, kind after kind."""
    for kind, pattern in PATTERNS.items():
        text = re.sub(pattern, lambda m: f"<{kind.upper()}>" if _ok(kind, m.group()) else m.group(), text)
    return text


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Weighted shares with the excess over the caps shared again, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be"))
    order += [None] if None in sizes else []
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in order if s not in fixed}
        if not rest:
            return fixed
        level = (total - sum(fixed.values())) / sum(rest.values())
        over = [s for s in rest if level * w[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: level * w[s] for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}


def crc(ids):
    import numpy as np
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
