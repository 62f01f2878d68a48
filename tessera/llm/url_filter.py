"""URL filters as a temporal list join, with built-in functions only.

A list is a log of dated changes (a pattern is added or removed).  Changes
become validity intervals [valid_from, valid_to).  Every capture is then
evaluated against the entries that were active when it was fetched:

1. A URL yields the keys that an entry could name: the suffixes of its host and
   the prefixes of its path.  Keys that no entry names end here.
2. An as-of join finds, for each key and list, the last interval that began at
   or before the fetch.  It works in two levels: the state carried into a day
   comes from one row per key and day, and inside a day the day's changes and
   captures are sorted together.  A host with a third of all captures or
   changes is thus spread over its days.
3. The longest active pattern decides a capture; of equals, an allowing one.

Defined cases: a null or unparsable URL and a null fetch time match nothing;
several changes of one entry at one instant leave it removed if one of them is
a removal; adding what is listed or removing what is not changes nothing;
repeated captures each get a row; empty lists match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._ranges import neighbour, ranged
from tessera.sources.scratch import saved

#: The columns of a list's log.
LOG = ("list", "policy", "pattern", "change", "changed_at")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL; null if there is none."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(h != "", F.lower(F.regexp_replace(h, r"\.+$", "")))


def path_of(url: Column) -> Column:
    """Path without query, fragment and outer slashes."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.regexp_replace(p, r"^/+|/+$", "")


def url_keys(url: Column, labels: int, depth: int) -> Column:
    """Keys that entries of at most ``labels`` host labels and ``depth`` path
    segments could name: ``b.c`` for hosts, ``a.b.c/x/y`` for paths."""
    host, path = host_of(url), path_of(url)
    parts, segments = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    n, d = F.least(F.size(parts), F.lit(labels)), F.least(F.size(segments), F.lit(depth))
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                        lambda i: F.array_join(F.slice(parts, -i, i), "."))
    paths = F.when(d > 0, F.transform(F.sequence(F.lit(1), F.greatest(d, F.lit(1))), lambda i: F.concat(
        host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(hosts, paths)))


def list_intervals(log: DataFrame) -> DataFrame:
    """``list, policy, pattern, valid_from, valid_to`` (null: still valid).

    Changes are reduced to one per entry and instant and sorted over ranges, so
    that an entry with very many changes lies in many of them; its first and last
    rows of a range learn their neighbours from one row per range.
    """
    key = ["list", "policy", "pattern"]
    at = (log.where(F.col("changed_at").isNotNull() & F.col("pattern").isNotNull())
          .groupBy(*key, "changed_at").agg(F.max((F.col("change") == "remove").cast("int")).alias("off")))
    at = ranged(at, [*key, "changed_at"], "changes")
    turns = neighbour(at, key, "changed_at", "off", "was", ahead=False).where("off <> coalesce(was, 1)")
    turns = saved(turns, "turns")
    return (neighbour(turns, key, "changed_at", "changed_at", "valid_to").where("off = 0")
            .select(*key, F.col("changed_at").alias("valid_from"), "valid_to"))


def _as_of(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """The probes (``entry, at, ..``) whose entry is active ``at`` that time,
    with the interval's start as ``since``."""
    p = probes.withColumn("day", F.to_date("at"))
    v = intervals.withColumn("day", F.to_date("valid_from"))
    last = F.struct(F.col("valid_from").alias("from"), F.col("valid_to").alias("to"))
    # one row per entry and day: the last interval that began on it
    days = (v.groupBy("entry", "day").agg(F.max_by(last, "valid_from").alias("began"))
            .unionByName(p.select("entry", "day").distinct(), allowMissingColumns=True)
            .groupBy("entry", "day").agg(F.max("began").alias("began")))
    before = (Window.partitionBy("entry").orderBy("day")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = days.select("entry", "day", F.last("began", ignorenulls=True).over(before).alias("now"))
    start = F.col("day").cast(probes.schema["at"].dataType)
    rows = (p.withColumn("now", F.lit(None).cast(v.select(last.alias("x")).schema["x"].dataType))
            .withColumn("kind", F.lit(2))
            .unionByName(carried.where("now is not null")
                         .select("entry", "day", start.alias("at"), "now", F.lit(0).alias("kind")),
                         allowMissingColumns=True)
            .unionByName(v.select("entry", "day", F.col("valid_from").alias("at"), last.alias("now"),
                                  F.lit(1).alias("kind")), allowMissingColumns=True))
    upto = (Window.partitionBy("entry", "day").orderBy("at", "kind")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("now", F.last("now", ignorenulls=True).over(upto)).where("kind = 2")
    return (found.where("now.to is null or at < now.to").where("now is not null")
            .withColumn("since", F.col("now.from")).drop("now", "kind", "day"))


def evaluate(captures: DataFrame, log: DataFrame) -> DataFrame:
    """One row per row of ``captures`` (``capture_id, url, fetched_at``) with
    ``n_active``, ``verdict`` (allow, block or none), ``pattern``, ``list``, ``since``."""
    intervals = list_intervals(log)
    entry = F.xxhash64("list", "policy", "pattern")
    intervals = saved(intervals.withColumn("entry", entry), "intervals")
    entries = intervals.select("entry", "list", "policy", "pattern").distinct()
    size = intervals.agg(
        F.max(F.size(F.split(F.substring_index("pattern", "/", 1), r"\."))),
        F.max(F.size(F.split("pattern", "/")) - 1)).first()
    cap = captures.select("capture_id", "url", "fetched_at")
    keys = (cap.distinct().where("fetched_at is not null")
            .select("capture_id", "url", "fetched_at",
                    F.explode(url_keys(F.col("url"), size[0] or 1, size[1] or 0)).alias("pattern")))
    probes = (keys.join(entries, "pattern")
              .select("entry", F.col("fetched_at").alias("at"), "capture_id", "url", "list", "policy",
                      "pattern"))
    hits = _as_of(probes, intervals.select("entry", "valid_from", "valid_to"))
    rank = F.struct(F.length("pattern").alias("n"), (F.col("policy") == "allow").alias("allow"),
                    F.col("pattern"), F.col("list"), F.col("since"))
    best = hits.select("capture_id", "url", F.col("at").alias("fetched_at"), rank.alias("best"),
                       F.lit(1).alias("hit"), F.lit(0).alias("n"))
    rows = cap.withColumn("best", F.lit(None).cast(best.schema["best"].dataType)).withColumn(
        "hit", F.lit(0)).withColumn("n", F.lit(1))
    all_ = (rows.unionByName(best).groupBy("capture_id", "url", "fetched_at")
            .agg(F.max("best").alias("best"), F.sum("hit").alias("n_active"), F.sum("n").alias("n")))
    verdict = (F.when(F.col("best").isNull(), "none").when(F.col("best.allow"), "allow")
               .otherwise("block"))
    out = all_.select("capture_id", "url", "fetched_at", "n_active", verdict.alias("verdict"),
                      F.col("best.pattern").alias("pattern"), F.col("best.list").alias("list"),
                      F.col("best.since").alias("since"),
                      F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i"))
    return out.drop("_i")


def allowed(captures: DataFrame, log: DataFrame) -> DataFrame:
    """The captures that no list blocks."""
    return evaluate(captures, log).where("verdict <> 'block'")
