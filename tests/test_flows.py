"""The ingest flow on a raw survey with the problems of the reference's fixture
(stratum 41, a 98 %-null column, sentinel 87 and nulls, a stray '128', one exact
duplicate, one all-null row)."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import flows


def _raw(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(50):
        rows.append((i, f"name{i}", str(rng.choice(["Masculino", "Femenino"])),
                     int(rng.integers(1, 7)), int(rng.integers(1, 7)),
                     float(rng.choice([1, 2, 3, 4, 5])), "Si" if i % 2 else "No",
                     "x" if i == 0 else None))
    rows[3] = rows[3][:3] + (41,) + rows[3][4:]                 # stratum out of range
    rows[4] = rows[4][:5] + (87.0,) + rows[4][6:]               # sentinel answer
    rows[5] = rows[5][:5] + (None,) + rows[5][6:]               # missing answer
    rows[6] = rows[6][:6] + ("128",) + rows[6][7:]              # bad binary
    rows.append((50,) + rows[10][1:])                           # exact duplicate of row 10 (new index)
    rows.append((51, None, None, None, None, None, None, None))  # all-null row
    schema = ("idx long, nombre string, genero string, estrato_grado int, estrato_actual int, "
              "competencia_1 double, binaria_1 string, col_casi_vacia string")
    return spark.createDataFrame(rows, schema)


def test_ingest_flow_on_problem_fixture(spark):
    raw = _raw(spark).withColumnRenamed("idx", "row_id")
    spec = flows.IngestSpec(
        question_cols=["genero", "estrato_grado", "estrato_actual", "competencia_1", "binaria_1", "col_casi_vacia"],
        pii_cols=["nombre"], sentinel_col="competencia_1", sparse_threshold=0.95,
        likert_cols=["competencia_1"], binary_cols=["binaria_1"], stratum_cols=["estrato_grado", "estrato_actual"])
    clean, rep = flows.ingest(raw, spec)
    r = rep.first()
    assert r.n_rows_raw == 52 and r.n_pii_dropped == 1
    assert r.n_empty_rows == 1 and r.n_sentinel_rows == 1 and r.n_duplicates == 1
    assert r.n_sparse_cols == 1 and r.n_stratum_invalid == 1 and r.n_binary_invalid == 1
    assert r.n_rows_final == 49 == clean.count()
    assert "nombre" not in clean.columns and "col_casi_vacia" not in clean.columns
    assert clean.where(F.col("row_id") == 3).first().estrato_grado is None
    assert clean.where(F.col("row_id") == 6).first().binaria_1 is None
    assert clean.where(F.col("row_id") == 5).count() == 1             # null answer is not the sentinel
    assert clean.where(F.col("row_id").isin(10, 50)).count() == 1     # first copy kept
    assert clean.where(F.col("row_id") == 10).count() == 1


def test_ingest_b(spark):
    rows = [(0, "a", "Alto", "Si", None), (1, "a", "Bajo", "No", None), (2, "b", "No aplica", "128", None),
            (3, "c", "raro", "SI", "x"), (4, "b", "No aplica", "128", None), (5, None, None, None, None)]
    raw = spark.createDataFrame(rows, "row_id long, cedula string, logro string, bin string, vacia string")
    spec = flows.IngestSpecB(pii_cols=["nombre"], key_col="cedula", sparse_threshold=0.7,
                             allowed={"logro": ["Bajo", "Alto", "No aplica"]}, binary_cols=["bin"])
    clean, report, issues = flows.ingest_b(raw, spec)
    r = report.first()
    assert (r.n_rows_raw, r.n_duplicates, r.n_key_duplicates, r.n_sparse_cols, r.n_rows_final) == (6, 1, 1, 1, 4)
    got = {x.row_id: (x.logro, x.bin) for x in clean.collect()}
    assert got == {0: ("Alto", "Si"), 2: (None, None), 3: (None, "SI"), 5: (None, None)}
    assert sorted((x.check, x.bad_value, x.n_invalid) for x in issues.collect()) == [
        ("binary", "128", 1), ("ordinal", "raro", 1), ("token", "No aplica", 1)]


def test_features_compose(spark):
    raw = spark.createDataFrame([(0, "uno", None, "x", 1.0), (1, None, "dos", " y ", 2.0), (2, "??", None, "z", None)],
                                "row_id long, s1 string, s2 string, cat string, n double")
    out = flows.features(raw, flows.FeatureSpec(
        coalesce={"salario": [("s1", {"uno": 1}), ("s2", {"dos": 2})]},
        nominal={"cat_ok": ("cat", {"z": "w"}, ["x", "y", "w"], False)},
        scores={"total": ["n", "salario"]}, lumps=[("cat_ok", 2, "Otro")]))
    got = {r.row_id: (r.salario, r.cat_ok, r.total) for r in out.collect()}
    assert got == {0: (1, "Otro", 2.0), 1: (2, "Otro", 4.0), 2: (None, "Otro", 0.0)}


def test_report_has_every_section(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), float(rng.integers(1, 6)), float(rng.integers(0, 2)),
             str(rng.choice(["A", "B", "nan"])), float(rng.integers(2000, 2020)), str(rng.choice(["Si", "No"])))
            for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, seg long, q double, b double, prog string, year double, r string")
    out = flows.report(df, flows.ReportSpec(
        seg="seg", competences=["q"], incidence=["q"], score="q", binary=["b"], satisfaction=["q"], programme="prog",
        age="year", year="year", history=["q"], answers=["r"], mobility="b", categories=["prog"], site="prog",
        labelings=("seg", "b")))
    rows = out.collect()
    assert {r.section for r in rows} == {
        "distribution", "competences", "incidence", "wellbeing_score", "wellbeing_yes", "wellbeing_items",
        "programme_coverage", "programme_top", "programme_by_segment", "programme_inverse", "age",
        "graduation_year", "history", "answers", "mobility", "categorical", "site_effect", "robustness"}
    share = [r.value for r in rows if r.section == "distribution" and r.stat == "pct"]
    assert abs(sum(share) - 100) < 1e-9


def _respondents(spark, n=160):
    """Two attitudes that answer alike, a doubled and a constant item."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        kind = i % 2
        a = [float(np.clip(round(2 + 2 * kind + rng.normal(scale=.6)), 1, 5)) if rng.random() > .05 else None for _ in range(4)]
        rows.append((i, *a, a[0], 3.0, ["rojo", "azul", "verde"][int(rng.integers(0, 2)) + kind],
                     ["Si", "No"][kind] if rng.random() > .1 else None, float(kind * 10 + rng.integers(0, 3))))
    return spark.createDataFrame(rows, "row_id long, q1 double, q2 double, q3 double, q4 double, twin double, flat double, "
                                       "color string, apoyo string, score double")


def test_segmentation_is_saved_and_scores_new_rows(spark, tmp_path, caplog):
    df = _respondents(spark)
    blocks = {"B1": (["q1", "q2", "q3"], 1), "B2": (["q4", "q1"], 1), "TWIN": (["q1", "twin"], 1), "FLAT": (["q2", "flat"], 1)}
    with caplog.at_level(logging.WARNING):
        result = flows.segment_respondents(df, blocks, ["color", "apoyo"], k_range=range(2, 5), n_init=4,
                                           eps_grid=(0.5, 1.5), min_pts_grid=(5,), names={0: "Bajo"}, score_col="score")
    assert "TWIN" in caplog.text and "FLAT" in caplog.text and "B1" not in caplog.text
    assert {r.block for r in result.loadings.collect()} == {"B1", "B2"}
    own = {(r.method, r.choice, r.row_id): (r.cluster, r.name) for r in result.assignments.collect()}
    assert len(own) == 4 * df.count()
    best = [own["kmeans", "best", i] for i in range(160)]
    low = [n for c, n in best if c == 0]
    assert set(low) == {"Bajo"} and all(n == f"Arquetipo {c}" for c, n in best if c)
    means = {}
    for i, r in enumerate(df.orderBy("row_id").collect()):
        means.setdefault(best[i][0], []).append(r.score)
    order = [np.mean(means[c]) for c in sorted(means)]
    assert order == sorted(order) and sorted(means) == list(range(len(means)))

    path = flows.save_segmentation(result, df, str(tmp_path / "run"))
    again = {(r.method, r.choice, r.row_id): (r.cluster, r.name)
             for r in flows.score_respondents(df.withColumn("row_id", F.col("row_id") + 1000), path).collect()}
    assert len(again) == len(own)
    for (method, choice, i), v in own.items():
        if method == "kmeans":
            assert again[method, choice, i + 1000] == v
    new = spark.createDataFrame([(1, 9.0, None, 1.5, -3.0, None, None, "nuevo", None, 0.0)], df.schema)
    assert flows.score_respondents(new, path).where("method = 'kmeans'").count() == 2
    spark.createDataFrame([(99,)], "version int").write.mode("overwrite").parquet(f"{path}/parameters/version")
    with pytest.raises(ValueError, match="version 99"):
        flows.score_respondents(df, path)


def test_segmentation_labels_points_not_rows(spark, monkeypatch):
    """Equal answers are labelled once for every method and k; what is written per row
    has no row per labeling."""
    df = _respondents(spark)
    df = df.unionByName(df.withColumn("row_id", F.col("row_id") + 1000)).unionByName(
        df.withColumn("row_id", F.col("row_id") + 2000))
    sizes = {}

    def counted(table, name, *args):
        out = flows_saved(table, name, *args)
        sizes[name] = out.count()
        return out

    flows_saved = flows.saved
    monkeypatch.setattr(flows, "saved", counted)
    result = flows.segment_respondents(df, {"B1": (["q1", "q2", "q3"], 1)}, ["color"], k_range=range(2, 5), n_init=2,
                                       eps_grid=(0.5,), min_pts_grid=(5,), score_col="score")
    assert sizes["points"] <= df.count() / 3 and sizes["labelled"] == 6 * sizes["points"]
    assert max(n for name, n in sizes.items() if name != "labelled") <= df.count()
    assert result.assignments.count() == 4 * df.count()
    got = {(r.method, r.choice, r.row_id): r.cluster for r in result.assignments.collect()}
    assert all(c == got[m, w, i % 1000] for (m, w, i), c in got.items())
