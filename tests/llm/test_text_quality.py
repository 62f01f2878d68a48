import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _text, quality

from ._brute import WORD, quality as brute_quality, shingle_set

CASES = ["", None, "one", "a b c d", "a b c d e", "A b\tC\x0bd\x0ce\rf\n", "  lead and trail  ",
         "é è ü 💡 words stay whole", "x" * 5000, "a a a a a a", "a b a b a b a b c"]


def _texts(seed, n=60):
    rng = random.Random(seed)
    alphabet = ["a", "B", "c", "é", "💡", " ", " ", "\n", "\t", "word", "#", "<", " "]
    return CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(n)]


@pytest.mark.parametrize("group", [64, 1 << 19])
def test_shingles_match_sets(monkeypatch, group):
    monkeypatch.setattr(_text, "GROUP_BYTES", group)
    texts = _texts(1)
    sets = []
    for w in _text.word_groups(pa.array(texts), lower=True):
        sh, off = _text.shingles(w.hashes, w.offsets)
        sets += [frozenset(sh[off[i]:off[i + 1]].tolist()) for i in range(w.n)]
    want = [shingle_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


def test_groups_do_not_change_signatures(monkeypatch):
    texts = pa.array(_texts(2) + [" ".join(f"w{i % 97}" for i in range(20000))])
    whole = _text.MinHasher(16, 1).of_column(texts)
    monkeypatch.setattr(_text, "GROUP_BYTES", 128)
    assert (whole == _text.MinHasher(16, 1).of_column(texts)).all()
    assert (whole == _text.MinHasher(16, 1).of_column(texts.cast(pa.large_string()))).all()
    assert (whole[5:] == _text.MinHasher(16, 1).of_column(texts.slice(5))).all()


def test_minhash_estimates_jaccard():
    rng, hasher, errors = random.Random(3), _text.MinHasher(256, 5), []
    for _ in range(40):
        a = [str(rng.random()) for _ in range(200)]
        b = list(a)
        for _ in range(rng.randint(1, 30)):
            b[rng.randrange(200)] = str(rng.random())
        sig = hasher.of_column(pa.array([" ".join(a), " ".join(b)]))
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        errors.append((sig[0] == sig[1]).mean() - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_quality_matches_brute_force(spark):
    rng = random.Random(4)
    prose = " ".join(f"w{rng.randint(0, 4000)}" for _ in range(3000))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(12)) for _ in range(900))
    texts = _texts(5) + [prose, prose + "\n" + prose, "same line again here\n" * 400, noise,
                         " ".join(["word"] * 60), "a b c " * 20 + prose]
    bands = quality.Bands()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ratio string")
    got = {r.doc_id: r.asDict() for r in quality.quality_metrics(df).collect()}
    for i, t in enumerate(texts):
        want = brute_quality(t, bands)
        assert {k: got[i][k] for k in want} == want, repr((t or "")[:80])
    kept = quality.keep_quality(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in got if got[i]["kept"]]


def test_bands_reject_repetition_and_noise(spark):
    rng = random.Random(6)
    prose = " ".join(f"w{rng.randint(0, 4000)}" for _ in range(3000))
    # no window repeats within a period, so the base rules pass, yet the text repeats
    period = [f"token{i}" for i in range(120)]
    loop = " ".join(period[(i * 7) % 120] + ("" if i % 9 else "x") for i in range(4000))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(9)) for _ in range(900))
    df = spark.createDataFrame([(0, prose), (1, loop), (2, noise)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_metrics(df).collect()}
    assert got[0].kept and not got[1].kept and not got[2].kept
    assert not got[2].base_failed and got[2].ratio < 1.45


def test_bands_reject_base64_noise_at_any_length(spark):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er")]
    lexicon = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(2500)]
    weights = [1 / (i + 40) for i in range(len(lexicon))]

    def noise(n):
        return " ".join("".join(rng.choices(letters, k=12)) for _ in range(n // 13 + 1))[:n]

    def prose(n):
        return " ".join(rng.choices(lexicon, weights, k=n))[:n]

    sizes = (700, 1000, 3000, 6000, 40000)
    half = [prose(20000) + " " + noise(20000), noise(20000) + "\n" + prose(20000),
            prose(2500) + " " + noise(2500)]
    bad, good = [noise(n) for n in sizes] + half, [prose(n) for n in sizes]
    df = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_metrics(df).collect()}
    assert [got[i].kept for i in range(len(bad))] == [False] * len(bad)
    assert [got[i].kept for i in range(len(bad), len(got))] == [True] * len(good)
    assert not any(r.base_failed for r in got.values())
    assert got[4].n_bad_chunks == got[4].n_chunks > 0 and got[5].n_bad_chunks >= 4


def test_quality_of_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_metrics(empty).count() == 0 and quality.keep_quality(empty).count() == 0
    assert WORD.findall("") == []
