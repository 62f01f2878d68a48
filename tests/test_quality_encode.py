"""Unit tests mirroring the reference's ingest / feature assertions (small literal frames)."""

from pyspark.sql import functions as F

from tessera.operators import encode, quality, schema
from tessera.plans import survey_config as cfg


def test_drop_index_and_pii(spark):
    df = spark.createDataFrame([(0, "a", "x@y", "M")], ["Unnamed: 0", "nombre", "correo", "Genero:"])
    out, dropped = schema.drop_if_present(df, ["Unnamed: 0"])
    assert "Unnamed: 0" not in out.columns
    out, pii = schema.drop_if_present(out, ["nombre", "correo", "no_such"])
    assert pii == ["nombre", "correo"] and out.columns == ["Genero:"]


def test_dedupe_exact_keeps_first(spark):
    rows = [(0, 1, "a", 3), (1, 2, "b", 4), (2, 1, "a", 3)]
    df = spark.createDataFrame(rows, "row_id long, k1 int, k2 string, col_extra int")
    out = quality.dedupe_exact(df, "row_id").orderBy("row_id").collect()
    assert [r.row_id for r in out] == [0, 1]
    dc = quality.duplicate_count(df.drop("row_id")).first()
    assert dc.n_duplicates == 1


def test_no_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "col_a int, col_b string").withColumn(
        "row_id", F.monotonically_increasing_id())
    assert quality.dedupe_exact(df, "row_id").count() == 3


def test_dedupe_by_key_nulls_equal(spark):
    rows = [(0, None, 1), (1, None, 2), (2, "a", 3), (3, "a", 4)]
    df = spark.createDataFrame(rows, "row_id long, k string, v int")
    out = quality.dedupe_by_key(df, ["k"], "row_id").orderBy("row_id").collect()
    assert [(r.row_id, r.v) for r in out] == [(0, 1), (2, 3)]


def test_empty_row(spark):
    df = spark.createDataFrame([(1, "x"), (None, None), (3, "z")], "a int, b string")
    assert quality.drop_empty_rows(df, ["a", "b"]).count() == 2


def test_likert_out_of_range(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (87.0,), (5.0,), (None,)], "c double")
    vals = [r.c for r in quality.range_validate(df, ["c"], 1, 5).collect()]
    assert vals == [1.0, 3.0, None, 5.0, None]
    iss = quality.range_issues(df, ["c"], 1, 5).collect()
    assert len(iss) == 1 and iss[0].n_invalid == 1 and iss[0].bad_value == "87.0"


def test_likert_clean_untouched(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "c double")
    assert [r.c for r in quality.range_validate(df, ["c"], 1, 5).collect()] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert quality.range_issues(df, ["c"], 1, 5).count() == 0


def test_binary_domain(spark):
    df = spark.createDataFrame([("Si",), ("No",), ("128",), ("Si",)], "b string")
    out = [r.b for r in quality.domain_validate(df, {"b": ["Si", "No"]}).collect()]
    assert out == ["Si", "No", None, "Si"]
    assert quality.domain_issues(df, {"b": ["Si", "No"]}).first().n_invalid == 1


def test_stratum(spark):
    df = spark.createDataFrame([(1,), (3,), (41,), (6,)], "s int")
    assert [r.s for r in quality.range_validate(df, ["s"], 1, 6).collect()] == [1.0, 3.0, None, 6.0]


def test_sparse_columns(spark):
    rows = [(i, None if i < 8 else i, None) for i in range(10)]
    df = spark.createDataFrame(rows, "full int, eighty int, empty int")
    out, dropped = quality.drop_sparse_columns(df, 0.95, protect=())
    assert dropped == ["empty"] and out.columns == ["full", "eighty"]


def test_sentinel_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 87.0), (2, None), (3, 4.0)], "row_id long, q double")
    assert sorted(r.row_id for r in quality.drop_sentinel_rows(df, "q", 87).collect()) == [2, 3]


def test_incomplete_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1, None)], "row_id long, a int, b int")
    assert [r.row_id for r in quality.drop_incomplete_rows(df, ["a", "b"], 0.9).collect()] == [2]


def test_competence_clean_and_yes_no(spark):
    df = spark.createDataFrame([(1.0, "Si"), (3.0, "No"), (99.0, "Si"), (5.0, "No")], "c double, b string")
    out = df.select(quality.in_range("c", 1, 5).alias("c"),
                    encode.binary_encode("b", cfg.YES_A, cfg.NO_A).alias("b")).collect()
    assert [r.c for r in out] == [1.0, 3.0, None, 5.0]
    assert [r.b for r in out] == [1, 0, 1, 0]


def test_mobility(spark):
    df = spark.createDataFrame([(2.0, 3.0), (3.0, 3.0), (4.0, 2.0)], "grad double, cur double")
    out = [r.m for r in df.select(encode.change_score("cur", "grad", 1, 6).alias("m")).collect()]
    assert out == [1.0, 0.0, -2.0]


def test_wellbeing_score_range(spark):
    import random
    random.seed(42)
    rows = [tuple(random.choice([0, 1, None]) for _ in range(7)) for _ in range(50)]
    cols = [f"b{i}" for i in range(7)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    sc = [r.s for r in df.select(encode.additive_score(cols).alias("s")).collect()]
    assert all(0 <= s <= 7 for s in sc) and len(sc) == 50


def test_keyword_rules_substring_semantics(spark):
    df = spark.createDataFrame([("Profesional de apoyo",), ("Gerente",), ("123",), ("Auxiliar",), ("xyz",)],
                               "t string")
    out = [r.lvl for r in df.select(encode.keyword_level("t", cfg.JOB_LEVEL_RULES, cfg.JOB_LEVEL_DEFAULT,
                                                         null_levels=(0,)).alias("lvl")).collect()]
    # 'profesional' contains 'na' → level 0 → null (reference behaviour, S-5)
    assert out == [None, 5, None, 1, 3]


def test_lump_rare_and_names(spark):
    rows = [("a",)] * 12 + [("b",)] * 3 + [(None,)]
    df = spark.createDataFrame(rows, "p string")
    out = encode.lump_rare(df, "p", 10, "Otro").groupBy("p").count().collect()
    got = {r.p: r["count"] for r in out}
    assert got == {"A": 12, "Otro": 3, None: 1}
    n = spark.createDataFrame([(0,), (5,)], "c int").select(encode.name_segments("c", {0: "Base"}).alias("n"))
    assert [r.n for r in n.collect()] == ["Base", "Arquetipo 5"]


def test_rename_tolerates_quotes(spark):
    df = spark.createDataFrame([(1,)], ["¿Estudiaría \"otro\" programa?"])
    out = schema.rename_columns(df, {"¿Estudiaría “otro” programa?": "cat_otra"})
    assert out.columns == ["cat_otra"]
