"""End-to-end flows (R19–R22): compositions of the operators, in the order that
is part of their semantics (the ingest row filters must run in this order).

Each stage hands over a DataFrame; ``write_stage`` persists it where a
stage boundary is wanted.  Intermediate results that several actions reuse
are checkpointed into the session's checkpoint folder (lineage cut, survives
executor loss).
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import encode, latent, quality, ranks, schema, scoring, segment, validate
from tessera.operators import report as rp
from tessera.operators.ward import MICRO
from tessera.plans import survey_config as cfg
from tessera.session import ensure_checkpoint_dir
from tessera.sources import stage
from tessera.sources.scratch import saved

log = logging.getLogger(__name__)


@dataclass
class IngestSpec:
    question_cols: list[str]
    pii_cols: list[str] = field(default_factory=list)
    index_col: str = "Unnamed: 0"
    id_col: str = "row_id"
    sentinel_col: str | None = None
    sentinel_value: float = cfg.SENTINEL_VALUE
    sparse_threshold: float = cfg.SPARSE_COLUMN_THRESHOLD_A
    incomplete_threshold: float = cfg.INCOMPLETE_ROW_THRESHOLD
    likert_cols: list[str] = field(default_factory=list)
    likert_range: tuple = cfg.LIKERT_RANGE
    binary_cols: list[str] = field(default_factory=list)
    binary_values: tuple = ("Si", "No")
    stratum_cols: list[str] = field(default_factory=list)
    stratum_range: tuple = cfg.STRATUM_RANGE


def ingest(raw: DataFrame, spec: IngestSpec) -> tuple[DataFrame, DataFrame]:
    """Clean a raw survey table (R19) and report what was done.

    Order: drop index column → drop PII → drop all-empty rows → drop sentinel
    rows → drop exact duplicates (keep smallest id) → drop sparse columns →
    drop incomplete rows → Likert / binary / stratum validation.
    Returns ``(clean, report)`` where report is one row of counts.
    """
    spark = raw.sparkSession
    ensure_checkpoint_dir(spark)
    df, _ = schema.drop_if_present(raw, [spec.index_col])
    df, pii = schema.drop_if_present(df, spec.pii_cols)
    df = schema.add_row_id(df, spec.id_col)
    q = [c for c in spec.question_cols if c in df.columns]
    if len(q) > 1:
        all_null = ~F.greatest(*[F.col(f"`{c}`").isNotNull() for c in q])
    elif q:
        all_null = F.col(f"`{q[0]}`").isNull()
    else:
        all_null = F.lit(False)
    sentinel = (F.col(f"`{spec.sentinel_col}`").try_cast("double").eqNullSafe(F.lit(float(spec.sentinel_value)))
                if spec.sentinel_col and spec.sentinel_col in df.columns else F.lit(False))
    flagged = df.withColumn("_empty", all_null).withColumn("_sent", ~F.col("_empty") & sentinel)
    c1 = flagged.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if("_empty").alias("n_empty"),
                     F.count_if("_sent").alias("n_sentinel")).first()
    kept = flagged.where(~F.col("_empty") & ~F.col("_sent")).drop("_empty", "_sent")
    dedup = saved(quality.dedupe_exact(kept, spec.id_col), "deduplicated")
    n_dedup = dedup.count()
    n_kept = c1["n_raw"] - c1["n_empty"] - c1["n_sentinel"]
    dedup2, sparse = quality.drop_sparse_columns(dedup, spec.sparse_threshold, protect=(spec.id_col,))
    rest = [c for c in q if c in dedup2.columns]
    inc = quality.row_null_fraction(rest) > spec.incomplete_threshold
    lik = [c for c in spec.likert_cols if c in dedup2.columns]
    binc = [c for c in spec.binary_cols if c in dedup2.columns]
    strat = [c for c in spec.stratum_cols if c in dedup2.columns]

    def n_bad_range(cols, lo, hi):
        return sum((F.col(f"`{c}`").isNotNull() & quality.in_range(c, lo, hi).isNull()).cast("long") for c in cols) \
            if cols else F.lit(0)

    def n_bad_dom(cols, vals):
        return sum((F.col(f"`{c}`").isNotNull() & ~F.col(f"`{c}`").isin(*vals)).cast("long") for c in cols) \
            if cols else F.lit(0)

    rows = dedup2.withColumn("_inc", inc)
    c2 = rows.agg(F.count_if("_inc").alias("n_incomplete"),
                  F.sum(F.when(~F.col("_inc"), n_bad_range(lik, *spec.likert_range))).alias("n_likert_invalid"),
                  F.sum(F.when(~F.col("_inc"), n_bad_dom(binc, list(spec.binary_values)))).alias("n_binary_invalid"),
                  F.sum(F.when(~F.col("_inc"), n_bad_range(strat, *spec.stratum_range))).alias("n_stratum_invalid")
                  ).first()
    clean = rows.where(~F.col("_inc")).drop("_inc")
    clean = quality.range_validate(clean, lik, *spec.likert_range)
    clean = quality.domain_validate(clean, {c: list(spec.binary_values) for c in binc})
    clean = quality.range_validate(clean, strat, *spec.stratum_range)
    n_final = n_dedup - (c2["n_incomplete"] or 0)
    report = spark.createDataFrame([(
        int(c1["n_raw"]), len(raw.columns), len(pii), int(c1["n_empty"]), int(c1["n_sentinel"]),
        int(n_kept - n_dedup), len(sparse), int(c2["n_incomplete"] or 0), int(c2["n_likert_invalid"] or 0),
        int(c2["n_binary_invalid"] or 0), int(c2["n_stratum_invalid"] or 0), int(n_final),
        len([c for c in clean.columns]))],
        "n_rows_raw long, n_cols_raw long, n_pii_dropped long, n_empty_rows long, n_sentinel_rows long, "
        "n_duplicates long, n_sparse_cols long, n_incomplete_rows long, n_likert_invalid long, "
        "n_binary_invalid long, n_stratum_invalid long, n_rows_final long, n_cols_final long")
    return clean, report


@dataclass
class IngestSpecB:
    """Table B: a key for duplicates, allowed answers per column, a token for 'not applicable'."""
    pii_cols: list[str] = field(default_factory=list)
    key_col: str | None = None
    id_col: str = "row_id"
    sparse_threshold: float = cfg.SPARSE_COLUMN_THRESHOLD_B
    allowed: dict = field(default_factory=dict)         # ordinal column -> allowed answers, token included
    na_token: str = cfg.NOT_APPLICABLE
    binary_cols: list[str] = field(default_factory=list)
    binary_values: tuple = ("Si", "No", "SI", "NO")


def ingest_b(raw: DataFrame, spec: IngestSpecB) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean a table of kind B (R19): ``(clean, report, issues)``.

    Order: drop PII → drop exact duplicates → keep the first row of every key →
    drop sparse columns → answers outside a column's set to null → token to null
    (counted) → binary answers.  ``report`` is one row of counts; ``issues`` has
    a row per column and bad value, and one per column with the token's count.
    """
    ensure_checkpoint_dir(raw.sparkSession)
    df, pii = schema.drop_if_present(raw, spec.pii_cols)
    df = schema.add_row_id(df, spec.id_col)
    n_raw = df.count()
    exact = saved(quality.dedupe_exact(df, spec.id_col), "exact")
    n_exact = exact.count()
    has_key = spec.key_col in df.columns
    keyed = saved(quality.dedupe_by_key(exact, [spec.key_col], spec.id_col), "keyed") if has_key else exact
    n_keyed = keyed.count() if has_key else n_exact
    rows, sparse = quality.drop_sparse_columns(keyed, spec.sparse_threshold, protect=(spec.id_col,))
    allowed = {c: list(v) for c, v in spec.allowed.items() if c in rows.columns}
    binary = {c: list(spec.binary_values) for c in spec.binary_cols if c in rows.columns}
    tokens = quality.token_counts(rows, list(allowed), spec.na_token)
    issues = quality.domain_issues(rows, allowed, "ordinal").unionByName(
        quality.domain_issues(rows, binary, "binary")).unionByName(
        tokens.where("n_token > 0").select(F.lit("token").alias("check"), "column_name",
                                           F.lit(spec.na_token).alias("bad_value"),
                                           F.col("n_token").alias("n_invalid")))
    clean = quality.domain_validate(rows, allowed)
    clean = quality.token_to_null(clean, list(allowed), spec.na_token)
    clean = quality.domain_validate(clean, binary)
    report = raw.sparkSession.createDataFrame(
        [(n_raw, len(raw.columns), len(pii), n_raw - n_exact, n_exact - n_keyed, len(sparse), n_keyed,
          len(clean.columns))],
        "n_rows_raw long, n_cols_raw long, n_pii_dropped long, n_duplicates long, n_key_duplicates long, "
        "n_sparse_cols long, n_rows_final long, n_cols_final long")
    return clean, report, issues


@dataclass
class FeatureSpec:
    rename: dict = field(default_factory=dict)
    binary: dict = field(default_factory=dict)          # col -> (yes list, no list)
    scales: dict = field(default_factory=dict)          # col -> {text: code}
    coalesce: dict = field(default_factory=dict)        # out -> [(col, {text: code}), ..], first known wins
    change: tuple | None = None                         # (out, current, previous, lo, hi)
    keyword: tuple | None = None                        # (out, col, rules, default, null_levels)
    nominal: dict = field(default_factory=dict)         # out -> (col, replace map, valid set or None, upper)
    scores: dict = field(default_factory=dict)          # out -> cols
    lumps: list = field(default_factory=list)           # (col, min_count, other)


def features(clean: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Build model-ready variables (R20): rename → encoders → nominal cleaning →
    scores → lumping."""
    df = schema.rename_columns(clean, spec.rename)
    chained = {out: encode.coalesce_chain(*[encode.map_values(c, mp) for c, mp in chain])
               for out, chain in spec.coalesce.items()}
    df = df.withColumns(chained) if chained else df
    cols = {c: encode.binary_encode(c, yes, no) for c, (yes, no) in spec.binary.items()}
    for c, mp in spec.scales.items():
        cols[c] = encode.map_values(c, mp)
    df = df.withColumns(cols) if cols else df
    if spec.change:
        out, cur, prev, lo, hi = spec.change
        df = df.withColumn(out, encode.change_score(cur, prev, lo, hi))
    if spec.keyword:
        out, col, rules, default, null_levels = spec.keyword
        df = df.withColumn(out, encode.keyword_level(col, rules, default, null_levels))
    for out, (col, replace, valid, upper) in spec.nominal.items():
        df = df.withColumn(out, encode.nominal_clean(col, replace, valid, upper))
    for out, sc in spec.scores.items():
        df = df.withColumn(out, encode.additive_score(sc))
    return encode.lump_many(df, spec.lumps) if spec.lumps else df


def partitions(rows: DataFrame) -> DataFrame:
    """A row per respondent and partition, of rows with an array of ``partitions``."""
    return rows.select("*", F.explode("partitions").alias("_p")).drop("partitions").select("*", "_p.*").drop("_p")


@dataclass
class Segmentation:
    """What the segmentation flow returns; tables are DataFrames."""
    rows: DataFrame             # row_id, partitions: array of method, choice (best / second), k, cluster, name
    metrics: DataFrame          # method, k, sil, db, dunn, n_dunn, cv, min_pct, score
    choice: DataFrame           # method, k_opt, k_second
    loadings: DataFrame         # block, var, factor, loading
    parameters: dict            # name -> table of the fitted parameters
    sweep: Callable[[], DataFrame]      # the DBSCAN sweep, computed when asked for

    @property
    def assignments(self) -> DataFrame:
        """row_id, method, choice (best / second), k, cluster, name"""
        return partitions(self.rows)

    @cached_property
    def dbscan(self) -> DataFrame:
        """eps, min_pts, n_clusters, noise_pct, viable, sil, min_pct"""
        return self.sweep()


def dbscan_summary(points: DataFrame, cols: list[str], settings: list[tuple[float, int]],
                   id_col: str = "row_id", weight: str | None = None) -> DataFrame:
    """M19 sweep: clusters and noise of every setting; metrics of the viable ones
    (at least 2 clusters, under 20 % noise) on the rows that are not noise.  A row
    counts as ``weight`` points."""
    lab = segment.dbscan_settings(points, cols, settings, id_col, weight)
    keys = ["eps", "min_pts"]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    lab = saved(lab.join(points.select(id_col, *cols, w.alias("_n")).hint("merge"), id_col), "dbscan")
    noise = F.sum(F.when(F.col("cluster") == -1, F.col("_n")).otherwise(0.0)) / F.sum("_n")
    st = lab.groupBy(*keys).agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"),
                                (100.0 * noise).alias("noise"))
    st = st.withColumn("viable", (F.col("n_clusters") >= 2) & (F.col("noise") < 20.0))
    pts = lab.where("cluster >= 0")
    sil = validate.silhouette_all(pts, cols, keys, weight="_n")
    bal = validate.balance(pts, "cluster", keys, "_n").select(*keys, "min_pct")
    out = st.join(sil, keys, "left").join(bal, keys, "left")
    return out.select(*keys, "n_clusters", F.round("noise", 1).alias("noise_pct"), "viable",
                      F.when(F.col("viable"), F.round("sil", 4)).alias("sil"),
                      F.when(F.col("viable"), F.col("min_pct")).alias("min_pct"))


def segment_respondents(df: DataFrame, factor_blocks: dict, nominal_cols: list[str], id_col: str = "row_id",
                        k_range=range(2, 8), k_min: int = 3, n_init: int = 30, n_micro: int = MICRO,
                        eps_grid: tuple = (0.3, 0.5, 0.7, 0.9, 1.2, 1.5), min_pts_grid: tuple = (5, 10, 15),
                        names: dict | None = None, score_col: str | None = None) -> Segmentation:
    """Segmentation (R21): factor blocks + MCA → quantile-normal + PCA(3) →
    k-means, Ward and DBSCAN sweeps → metrics → best and second-best k →
    relabel by ``score_col`` (the first component without one) → names.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts, loadings, medians, blocks, knots, modes, mca = [], None, {}, {}, {}, {}, None
    for block, (cols, n_f) in factor_blocks.items():
        own = latent.column_medians(df, cols)
        v = saved(latent.median_impute(df.select(id_col, *cols), cols, own), "imputed")
        rk = saved(ranks.rank_columns(v, cols, id_col), "ranked")
        try:
            fm = latent.fit_factor_block(rk, cols, n_f, block)
        except latent.SingularBlock as e:
            log.warning("factor block left out: %s", e)
            continue
        blocks[block], knots[block] = fm, scoring.rank_knots(v, cols)
        medians.update(own)
        parts.append(rk.select(id_col, *fm.score_columns()))
        tab = fm.loadings_table(spark)
        loadings = tab if loadings is None else loadings.unionByName(tab)
    if nominal_cols:
        modes = {r["var"]: r["mode"] for r in latent.column_modes(df, nominal_cols).collect()}
        nom = saved(latent.mode_impute(df.select(id_col, *nominal_cols), nominal_cols, modes=modes), "nominal")
        mca = latent.fit_mca(nom, nominal_cols, 3)
        parts.append(nom.select(id_col, *mca.coord_columns()))
    if not parts:
        raise ValueError("no factor block could be fitted and there are no nominal columns")
    if loadings is None:
        loadings = spark.createDataFrame([], "block string, var string, factor int, loading double")
    # by a shuffle: the files of a few columns are small, their rows are not
    lat = parts[0]
    for p in parts[1:]:
        lat = lat.join(p.hint("merge"), id_col)
    lat = saved(lat, "latent")
    cols = [c for c in lat.columns if c != id_col]
    scores, pca, grid = latent.latent_space(lat, cols, id_col, min(3, len(cols)))
    space = saved(scores, "space")
    pcs = [c for c in space.columns if c != id_col]
    # equal answers fall on one point: partitions are fitted and measured on the points, by their rows
    points = saved(space.groupBy(*pcs).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("_w")), "points")
    _, _, km_centres = segment.kmeans_sweep(points, pcs, k_range, n_init=n_init, id_col=id_col, weight="_w")
    leaves_of, wd_cuts, _, _ = segment.ward_fit(points, pcs, k_range, n_micro, weight="_w")

    def label(method, k):
        return (segment.centre_label(pcs, km_centres[k]) if method == "kmeans" else segment.leaf_label(wd_cuts[k])).cast("long")

    every = [("kmeans", k) for k in km_centres] + [("ward", k) for k in wd_cuts]
    labels = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(int(k)).alias("k"), label(m, k).alias("cluster"))
                       for m, k in every])
    labelled = saved(leaves_of(points).select(*pcs, "_w", F.explode(labels).alias("x")).select("x.*", *pcs, "_w"), "labelled")
    # every (method, k) labeling scored in one sweep over the latent table
    sample = validate.md5_sample(space, id_col, validate.DUNN_SAMPLE).select(*pcs)
    metrics = saved(validate.labelled_metrics(labelled, pcs, labelled.join(F.broadcast(sample), pcs), ["method", "k"], "_w")
                    .select("method", "k", "sil", "db", "dunn", "n_dunn", "cv", "min_pct", "score"), "metrics")
    choice = saved(validate.select_k(metrics, k_min=k_min), "choice")
    picks = [(r["method"], which, r[f"k_{at}"]) for r in choice.orderBy("method").collect()
             for which, at in (("best", "opt"), ("second", "second"))]
    value = None if score_col is None else df.select(id_col, F.col(score_col).cast("double").alias("_score"))
    chosen = leaves_of(space).select(id_col, *([F.col(pcs[0]).alias("_score")] if value is None else []),
                                     *[label(m, k).alias(f"_{i}") for i, (m, _, k) in enumerate(picks)])
    chosen = saved(chosen if value is None else chosen.join(value.hint("merge"), id_col), "chosen")
    own = [f"_{i}" for i in range(len(picks))]
    alike = chosen.groupBy(*own).agg(F.sum("_score").alias("_sum"), F.count("_score").alias("_known"))
    clusters = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(which).alias("choice"), F.lit(int(k)).alias("k"),
                                  F.col(f"_{i}").alias("label")) for i, (m, which, k) in enumerate(picks)])
    # a row per cluster
    clusters = saved(alike.select(F.explode(clusters).alias("x"), "_sum", "_known").groupBy("x").agg(
        (F.sum("_sum") / F.nullif(F.sum("_known"), F.lit(0))).alias("_score")).select("x.*", "_score"), "clusters")
    named = None
    for method, which, _ in picks:
        part = validate.relabel_by_score(clusters.where((F.col("method") == method) & (F.col("choice") == which)),
                                         "label", "_score", "cluster")
        named = part if named is None else named.unionByName(part)
    named = saved(named.withColumn("name", encode.name_segments("cluster", names or {})), "named")
    new: dict = {}
    for r in named.collect():
        new.setdefault((r["method"], r["choice"]), {})[r["label"]] = (r["cluster"], r["name"])
    entries = []
    for i, (m, which, k) in enumerate(picks):
        cluster, name = (F.create_map(*[F.lit(x) for old, pair in sorted(new[m, which].items()) for x in (old, pair[j])])
                         for j in (0, 1))
        entries.append(F.struct(F.lit(m).alias("method"), F.lit(which).alias("choice"), F.lit(int(k)).alias("k"),
                                F.try_element_at(cluster, F.col(f"_{i}")).alias("cluster"),
                                F.try_element_at(name, F.col(f"_{i}")).alias("name")))
    rows = chosen.select(id_col, F.array(*entries).alias("partitions"))
    means = labelled.groupBy("method", "k", F.col("cluster").alias("label")).agg(
        F.array(*[F.sum(F.col(f"`{c}`") * F.col("_w")) / F.sum("_w") for c in pcs]).alias("mean"))
    centres = saved(scoring.chosen_centres(means, named, {"kmeans": km_centres}), "centres")
    return Segmentation(rows, metrics, choice, loadings,
                        scoring.parameter_tables(spark, medians, blocks, knots, modes, mca, grid, pca, centres),
                        lambda: dbscan_summary(points, pcs, [(e, m) for e in eps_grid for m in min_pts_grid], id_col, "_w"))


def score_respondents(df: DataFrame, path: str, id_col: str = "row_id") -> DataFrame:
    """Segments of new respondents by the segmentation saved below ``path`` (R21, S5):
    ``id, method, choice, k, cluster, name``; nothing is fitted again."""
    return partitions(score_rows(df, path, id_col))


def score_rows(df: DataFrame, path: str, id_col: str = "row_id") -> DataFrame:
    """:func:`score_respondents` with one row per respondent: ``id, partitions``."""
    return scoring.score_rows(df, scoring.load(df.sparkSession, f"{path}/parameters"), id_col)


def save_segmentation(result: Segmentation, df: DataFrame, path: str, id_col: str = "row_id", sweep: bool = True) -> str:
    """Sinks of the segmentation (S3–S5, S7) below ``path``: the table enriched
    with the best k-means segment, metrics, the DBSCAN ``sweep`` and loadings as CSV,
    parameters."""
    main = (result.assignments.where("method = 'kmeans' and choice = 'best'")
            .select(id_col, F.col("cluster").alias("segment"), F.col("name").alias("segment_name")))
    stage.write_stage(df.join(main.hint("merge"), id_col, "left"), f"{path}/segmented")
    stage.write_csv(result.metrics, f"{path}/metrics_csv")
    stage.write_csv(result.loadings, f"{path}/loadings_csv")
    if sweep:
        stage.write_csv(result.dbscan, f"{path}/dbscan_csv")
    stage.save_params(df.sparkSession, result.parameters, f"{path}/parameters")
    return path


@dataclass
class ReportSpec:
    """Columns of the report's sections; an empty entry leaves its section out."""
    seg: str
    competences: list[str] = field(default_factory=list)
    incidence: list[str] = field(default_factory=list)
    score: str | None = None
    binary: list[str] = field(default_factory=list)
    satisfaction: list[str] = field(default_factory=list)
    programme: str | None = None
    age: str | None = None
    year: str | None = None
    history: list[str] = field(default_factory=list)
    answers: list[str] = field(default_factory=list)
    mobility: str | None = None
    categories: list[str] = field(default_factory=list)
    site: str | None = None
    labelings: tuple | None = None


def report(df: DataFrame, spec: ReportSpec) -> DataFrame:
    """The report (R22): all sections in one long table.

    The columns it needs are read once; all numeric sections share one scan and
    one range sort (``report.Summary``).
    """
    seg = spec.seg
    one = [c for c in (seg, spec.score, spec.programme, spec.age, spec.year, spec.mobility, spec.site) if c]
    many = [c for group in (spec.competences, spec.incidence, spec.binary, spec.satisfaction, spec.history,
                            spec.answers, spec.categories, list(spec.labelings or ())) for c in group]
    df = saved(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*one, *many])]), "report")
    numeric = [*spec.competences, *spec.incidence, *spec.history]
    numeric += [spec.score, *spec.binary, *spec.satisfaction] if spec.score else []
    numeric += [c for c in (spec.age, spec.year) if c]
    s = rp.Summary(df, numeric, seg)
    parts = [rp.distribution(df, seg)]
    if spec.competences:
        parts.append(rp.item_profile(df, spec.competences, seg, "competences", s))
    if spec.incidence:
        parts.append(rp.item_profile(df, spec.incidence, seg, "incidence", s))
    if spec.score:
        parts.append(rp.wellbeing(df, spec.score, spec.binary, spec.satisfaction, seg, s))
    if spec.programme:
        parts.append(rp.programme(df, spec.programme, seg))
    if spec.age:
        parts.append(rp.measure(df, spec.age, seg, "age", s))
    if spec.year:
        parts.append(rp.measure(df, spec.year, seg, "graduation_year", s))
    if spec.history:
        parts.append(rp.item_profile(df, spec.history, seg, "history", s))
    if spec.answers:
        parts.append(rp.yes_rates(df, spec.answers, seg, "answers"))
    if spec.mobility:
        parts.append(rp.mobility(df, spec.mobility, seg))
    if spec.categories:
        parts.append(rp.categorical(df, spec.categories, seg))
    if spec.site:
        parts.append(rp.categorical(df, [spec.site], seg, "site_effect"))
    if spec.labelings:
        parts.append(rp.robustness(df, *spec.labelings))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
