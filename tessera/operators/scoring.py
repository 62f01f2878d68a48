"""A fitted segmentation as a versioned bundle of parameter tables, applied to new
rows as one projection (S5, R21).

The bundle holds everything the flow fitted: medians and modes, rank knots and
factor weights of every block, category scores, quantile grid, components, the
centres of every method's chosen partitions, names.  Scoring fits nothing, joins
nothing and shuffles nothing: tables of bounded size become expressions or go to
the tasks with the functions that use them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import latent, ranks
from tessera.operators.validate import nearest_label
from tessera.sources import stage

VERSION = 1
#: Knots of a column's ranks: all distinct values, or as many quantiles of them.
KNOTS = 1000


def rank_knots(df: DataFrame, cols: list[str], knots: int = KNOTS) -> DataFrame:
    """``var, val, avg_rank``: the ranks of all distinct values of a column with at
    most ``knots`` of them, else those at evenly spaced places of their order."""
    r = ranks.average_ranks(ranks.to_long(df, cols), ["var"])
    number = ranks.rank_histogram(r.select("var", "val", F.lit(1).alias("cnt")), ["var"], "val").select(
        "var", "val", F.col("before").alias("i"), F.col("n").alias("m"))
    step = F.greatest((F.col("m") - 1) / (knots - 1), F.lit(1.0))
    # place i is a knot if a multiple of the step rounds to it
    at = F.round(F.round(F.col("i") / step) * step) == F.col("i")
    return r.join(number, ["var", "val"]).where(at).select("var", "val", "avg_rank")


def _rank_column(col: str, knots: list[tuple[float, float]]) -> Column:
    """The rank of a value among the fitted ones: exact at a knot, between knots
    linear, beyond the ends that of the end; null stays null."""
    x = np.array([k[0] for k in knots], float)
    y = np.array([k[1] for k in knots], float)

    @F.arrow_udf("double")
    def rank(v: pa.Array) -> pa.Array:
        values = v.to_numpy(zero_copy_only=False)
        return pa.array(np.interp(values, x, y), mask=np.isnan(values))

    return rank(F.col(f"`{col}`").cast("double"))


@dataclass
class Bundle:
    """The tables of a saved segmentation as Python values of bounded size."""
    blocks: dict = field(default_factory=dict)         # block -> FactorModel
    medians: dict = field(default_factory=dict)
    knots: dict = field(default_factory=dict)          # block -> {var: [(value, rank)]}
    modes: dict = field(default_factory=dict)
    mca: latent.MCAModel | None = None
    grid: DataFrame | None = None
    pca: latent.PCAModel | None = None
    centres: list = field(default_factory=list)        # rows: method, choice, k, cluster, name, coordinates


def parameter_tables(spark: SparkSession, medians: dict, blocks: dict, knots: dict, modes: dict,
                     mca: latent.MCAModel | None, grid: DataFrame, pca: latent.PCAModel, centres: DataFrame) -> dict:
    """name -> table of everything :func:`load` reads."""
    out = {"version": spark.createDataFrame([(VERSION,)], "version int"),
           "blocks": spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, block string"),
           "quantiles": grid, "pca": pca.to_table(spark), "centres": centres}
    for b, model in blocks.items():
        out[f"factor_{b}"] = model.to_table(spark)
        out[f"ranks_{b}"] = knots[b]
    out["medians"] = spark.createDataFrame([(c, float(v)) for c, v in medians.items()], "var string, median double")
    if mca is not None:
        out["mca"] = mca.to_table(spark)
        out["modes"] = spark.createDataFrame([(i, c, modes.get(c, "Otro")) for i, c in enumerate(mca.cols)],
                                             "i int, var string, mode string")
    return out


def load(spark: SparkSession, path: str) -> Bundle:
    """The bundle below ``path``; a bundle of another version is an error."""
    def read(name):
        return stage.load_params(spark, path, [name])[name]

    version = read("version").first()["version"]
    if version != VERSION:
        raise ValueError(f"bundle of version {version}; this code reads version {VERSION}")
    b = Bundle(grid=read("quantiles"))
    for r in read("blocks").orderBy("i").collect():
        name = r["block"]
        b.blocks[name] = latent.FactorModel.from_table(read(f"factor_{name}"))
        table: dict = {}
        for k in read(f"ranks_{name}").orderBy("var", "val").collect():
            table.setdefault(k["var"], []).append((k["val"], k["avg_rank"]))
        b.knots[name] = table
    b.medians = {r["var"]: r["median"] for r in read("medians").collect()}
    columns = list(dict.fromkeys(r["var"] for r in read("pca").collect()))
    if any(c.startswith("acm_dim") for c in columns):
        b.modes = {r["var"]: r["mode"] for r in read("modes").orderBy("i").collect()}
        b.mca = latent.MCAModel.from_table(read("mca"), list(b.modes))
    order = [c for n, m in b.blocks.items() for c in (f"{n}_F{k + 1}" for k in range(m.n_factors))]
    order += [f"acm_dim{k + 1}" for k in range(b.mca.cat_scores.shape[1])] if b.mca else []
    b.pca = latent.PCAModel.from_table(read("pca"), order)
    b.centres = [r.asDict() for r in read("centres").collect()]
    return b


def score(df: DataFrame, bundle: Bundle, id_col: str = "row_id") -> DataFrame:
    """``id, method, choice, k, cluster, name`` of every row for every saved partition."""
    return score_rows(df, bundle, id_col).select(id_col, F.explode("partitions").alias("x")).select(id_col, "x.*")


def score_rows(df: DataFrame, bundle: Bundle, id_col: str = "row_id") -> DataFrame:
    """``id, partitions`` (an array of ``method, choice, k, cluster, name``) of every row:
    the flow's steps with the fitted parameters, as projections."""
    rows = df.select(id_col, *[F.col(f"`{c}`") for c in dict.fromkeys(
        [*[c for m in bundle.blocks.values() for c in m.cols], *(bundle.mca.cols if bundle.mca else [])])])
    latent_cols, out = [], rows
    for name, model in bundle.blocks.items():
        filled = {f"_{c}": F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(bundle.medians[c])) for c in model.cols}
        ranked = out.withColumns(filled).withColumns(
            {f"_r_{c}": _rank_column(f"_{c}", bundle.knots[name][c]) for c in model.cols})
        own = latent.FactorModel(**{**model.__dict__, "cols": [f"_r_{c}" for c in model.cols]})
        names = [f"{name}_F{k + 1}" for k in range(model.n_factors)]
        out = ranked.withColumns(dict(zip(names, own.score_columns(name)))).drop(
            *filled, *[f"_r_{c}" for c in model.cols])
        latent_cols += names
    if bundle.mca:
        filled = out.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(bundle.modes[c]))
                                  for c in bundle.mca.cols})
        names = [f"acm_dim{k + 1}" for k in range(bundle.mca.cat_scores.shape[1])]
        out = filled.withColumns(dict(zip(names, bundle.mca.coord_columns())))
        latent_cols += names
    normal = ranks.quantile_normal_transform(out.select(id_col, *latent_cols), bundle.grid, latent_cols)
    space = normal.select(id_col, *bundle.pca.score_columns())
    pcs = [c for c in space.columns if c != id_col]
    parts: dict = {}
    for r in bundle.centres:
        parts.setdefault((r["method"], r["choice"], r["k"]), []).append(r)
    labels = []
    for (method, choice, k), centres in sorted(parts.items()):
        of = nearest_label(pcs, [dict(zip(pcs, r["centre"]), cluster=r["cluster"]) for r in centres])
        names = F.create_map(*[F.lit(x) for r in centres for x in (r["cluster"], r["name"])])
        labels.append(F.struct(F.lit(method).alias("method"), F.lit(choice).alias("choice"), F.lit(k).alias("k"),
                               of.cast("long").alias("cluster"), names[of].alias("name")))
    return space.select(id_col, F.array(*labels).alias("partitions"))


def chosen_centres(means: DataFrame, named: DataFrame, fitted: dict) -> DataFrame:
    """``method, choice, k, label, cluster, name, centre`` of the ``named`` clusters
    (``method, choice, k, label, cluster, name``): fitted centres where there are any
    (``fitted``: method -> k -> centres), else the ``means`` (``method, k, label, mean``)."""
    spark = named.sparkSession
    rows = [(m, int(k), j, [float(v) for v in x]) for m, by_k in fitted.items() for k, centres in by_k.items()
            for j, x in enumerate(centres)]
    given = spark.createDataFrame(rows, "method string, k int, label long, fitted array<double>")
    # a row per method, k and cluster
    return (named.join(means, ["method", "k", "label"]).join(F.broadcast(given), ["method", "k", "label"], "left").select(
        "method", "choice", "k", "label", "cluster", "name", F.coalesce("fitted", "mean").alias("centre")))
