import random

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import mixing, packing, quality, tokens
from tessera.llm.queries import ORACLE, QUERIES

from ._brute import crc, groups, quality as brute_quality, redacted

SMALL = "/root/testdata/sf0.001"


def plain(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    rows = [dict(zip(names, r)) for r in want.fetchall()]
    assert sorted(names) == columns
    assert plain(df.collect(), columns) == plain(rows, columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_plain_columns(spark, name, tmp_path):
    df = QUERIES[name](spark, SMALL)
    df.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def brute_pipeline(rows):
    """Pieces of the pipeline as (doc_id, start, length, crc, doc_tokens), but for
    the mix, whose choice of documents ``copies`` gives per id."""
    kept = {i: t for i, t in rows.items() if brute_quality(t, quality.Bands())["kept"]}
    component = groups(kept)
    return {i: redacted(t) for i, t in kept.items() if component[i] == i}


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    clean = brute_pipeline(rows)
    stage = docs
    for _, f in corpus_pipeline.STAGES[:3]:
        stage = f(spark, stage, SMALL)
        assert stage.columns == docs.columns
    got = {r.doc_id: r.text for r in stage.collect()}
    assert got == clean
    frame = spark.createDataFrame([(i, t, source[i]) for i, t in clean.items()], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.plan_mix(frame).collect()}
    want, enc = [], tokens.encoder(tokens.default_path())
    for i, t in clean.items():
        ids, at = [*enc.ids(t), 1], 0
        for size in packing.cut(len(ids)):
            want += [(i, at, size, crc(ids[at:at + size]), len(ids))] * copies[i]
            at += size
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == sorted(want)
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


def odd_documents(spark):
    rng = random.Random(2)
    prose = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(120)) for _ in range(6)]
    rows = [(1, prose[0], "a", "x", 5), (1, prose[0], "a", "x", 5), (None, prose[1], None, None, None),
            (3, None, "a", "x", 0), (4, "", None, "x", 0), (5, prose[2] * 400, "b", "y", 1),
            (6, prose[3] + " mail me@example.org", "b", "y", 1), (7, prose[4], None, "y", 1), (8, prose[4], "a", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").selectExpr(
        "*", "1 AS kept", "'k' AS `key`", "2 AS rep", "'p' AS pattern", "0 AS n", "'odd.name' AS `a.b`")


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_columns(spark, k, tmp_path):
    name, f = corpus_pipeline.STAGES[k]
    docs = odd_documents(spark)
    out = f(spark, docs, SMALL)
    out.write.parquet(str(tmp_path / name))
    if k < 4:
        assert out.columns == docs.columns
    assert f(spark, docs.where("false"), SMALL).count() == 0
    got = [r.doc_id for r in out.collect()]
    if name == "quality":
        assert sorted(got, key=str) == [1, 1, 6, 7, 8, None]
    if name == "near_duplicates":
        assert sorted(got, key=str) == [1, 3, 4, 5, 6, 7, None]
    if name == "personal_data":
        texts = {r.doc_id: r.text for r in out.collect()}
        assert len(got) == 9 and texts[6].endswith("mail <EMAIL>") and texts[3] is None
