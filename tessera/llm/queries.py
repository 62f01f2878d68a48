"""Registered queries of the training-data operators and their SQL twins.

``QUERIES``: name -> callable(spark, sf_dir); ``ORACLE``: name -> DuckDB SQL
where SQL expresses the operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import (chat, codes, fingerprint, lengths, mixing, neardup, packing, pii, quality, sharding, trie,
                         url_filter, vectors)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Context limits that the token-count query answers besides every length found.
CONTEXT_LIMITS = tuple(2 ** i for i in range(7, 18))


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH log AS (
  SELECT 'list' || (e.event_id % 4) AS list,
         CASE WHEN e.event_id % 4 = 3 THEN 'allow' ELSE 'block' END AS policy,
         CASE e.event_id % 3 WHEN 0 THEN h
              WHEN 1 THEN regexp_extract(h, '([^.]+\.[^.]+\.[^.]+)$', 1)
              ELSE h || '/' || split_part(p, '/', 1) END AS pattern,
         CASE WHEN e.event_type IN ('view', 'error') THEN 1 ELSE 0 END AS off, e.ts AS tm
  FROM events e JOIN (
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1) AS h,
           regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS p FROM pages) g
    ON g.page_id = e.user_id),
log1 AS (SELECT list, policy, pattern, tm, max(off) AS off FROM log GROUP BY ALL),
turns AS (SELECT *, lag(off, 1, 1) OVER (PARTITION BY list, policy, pattern ORDER BY tm) AS was FROM log1),
iv0 AS (SELECT *, lead(tm) OVER (PARTITION BY list, policy, pattern ORDER BY tm) AS till
        FROM turns WHERE off <> was),
iv AS (SELECT list, policy, pattern, tm AS since, till FROM iv0 WHERE off = 0),
cap AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (page_id * 7919 % 2592000) AS f,
               regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1) AS h,
               regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1), '/+$', '') AS p FROM pages),
keys AS (
  SELECT DISTINCT page_id, f, k FROM (
    SELECT page_id, f, array_to_string(string_split(h, '.')[i:], '.') AS k
    FROM (SELECT *, unnest(range(1, len(string_split(h, '.')) + 1)) AS i FROM cap)
    UNION ALL
    SELECT page_id, f, h || '/' || array_to_string(string_split(p, '/')[:i], '/') AS k
    FROM (SELECT *, unnest(range(1, len(string_split(p, '/')) + 1)) AS i FROM cap WHERE p <> ''))),
hits AS (
  SELECT page_id, f, policy = 'allow' AS allow, pattern, list, since FROM keys
  JOIN iv ON iv.pattern = keys.k AND since <= f AND (till IS NULL OR f < till)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, allow DESC,
                pattern DESC, list DESC, since DESC) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM hits)
SELECT cap.page_id, cap.url, CAST(coalesce(n, 0) AS BIGINT) AS n_active,
       CASE WHEN n IS NULL THEN 'none' WHEN allow THEN 'allow' ELSE 'block' END AS verdict,
       pattern, list, strftime(since, '%Y-%m-%d %H:%M:%S') AS since
FROM cap LEFT JOIN best ON best.page_id = cap.page_id AND r = 1
"""


def list_log(spark, sf_dir: str):
    """A list's log made of the events: every event changes an entry for the
    host, the site or the first path segment of one page."""
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "pages")
    host = url_filter.host_of(F.col("url"))
    kind = F.col("event_id") % 3
    pattern = (F.when(kind == 0, host)
               .when(kind == 1, F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1))
               .otherwise(F.concat(host, F.lit("/"),
                                   F.split(url_filter.path_of(F.col("url")), "/")[0])))
    of = F.col("event_id") % 4
    return e.join(p.select(F.col("page_id").alias("user_id"), "url"), "user_id").select(
        F.concat(F.lit("list"), of).alias("list"),
        F.when(of == 3, "allow").otherwise("block").alias("policy"), pattern.alias("pattern"),
        F.when(F.col("event_type").isin("view", "error"), "remove").otherwise("add").alias("change"),
        F.col("ts").alias("changed_at"))


@query("op1_url_filter", OP1_SQL)
def op1(spark, sf_dir):
    seconds = (F.col("page_id") * 7919 % 2592000).cast("int")
    captures = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("capture_id"), "url",
        F.timestamp_add("SECOND", seconds, F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("fetched_at"))
    out = url_filter.evaluate(captures, list_log(spark, sf_dir))
    return out.select(F.col("capture_id").alias("page_id"), "url", "n_active", "verdict", "pattern", "list",
                      F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("op2_pii")
def op2(spark, sf_dir):
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    base = F.concat(*[F.col(f"found.{k}") for k in pii.BASE_KINDS])
    every = F.concat(*[F.col(f"found.{k}") for k in pii.KINDS])

    def joined(spans, *fields):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[f] for f in fields])), ",")

    place = ("kind", "start", "end")
    return found.select(
        "doc_id", *[F.size(f"found.{k}").cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(joined(base, *place), 256).alias("base_sha256"),
        joined(every, *place).alias("spans"), joined(every, *place, "score").alias("scores"))


@query("op3_token_lengths")
def op3(spark, sf_dir):
    hist = lengths.length_histogram(table(spark, sf_dir, "documents"))
    return lengths.suffix_sums(hist, CONTEXT_LIMITS)


@query("op4_fingerprints")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return fingerprint.fingerprint_edits(docs, links=fingerprint.band_groups(docs))


PROBE_TEXT = "</s>[INST] ok [/INST]"

OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + length(role) + length(regexp_replace(text || chr(1) || role, '[^\\]', '', 'g'))
    + len(regexp_extract_all(text || chr(1) || role, '</?s>|\[/?INST\]')) AS n FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + length('<s>[INST] ') + length(' [/INST]') + length('</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op5_chat", OP5_SQL)
def op5(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE_TEXT), (-1, 1, "assistant", PROBE_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    messages = chat.final_messages(chat.events_of(rows.unionByName(probe)))
    return chat.digests(chat.render(messages))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id
          GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       CAST(coalesce(min(r), w.doc_id) AS BIGINT) AS component_id, coalesce(min(r), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""


@query("op6_near_duplicates", OP6_SQL)
def op6(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "first")


@query("op7_quality")
def op7(spark, sf_dir):
    return quality.quality_metrics(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("class", "level")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':'
                      || (row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source ORDER BY doc_id) - 1)) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
              CAST([5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS w
       FROM d GROUP BY source),
s1 AS (SELECT *, CAST(source_size AS DOUBLE) * 2 AS top, CAST(source_size AS DOUBLE) * 2 / w AS ratio FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS n,
         ((SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 FROM s1)
           - coalesce(sum(top) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT source, source_size, least(top, coalesce((SELECT arg_min(level, n) FROM s2 WHERE level <= ratio) * w, top)) AS target FROM s2),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS f FROM s3),
c AS (SELECT d.source, d.k, sum(d.size) AS n, any_value(p.target - p.f * p.source_size) AS rest,
             coalesce(sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source GROUP BY d.source, d.k),
b AS (SELECT source, max(k) FILTER (pos + n / 2 <= rest AND rest > 0) AS border FROM c GROUP BY source)
SELECT d.doc_id, d.source, d.size, p.source_size, p.target,
       CAST(p.f + CASE WHEN d.k <= b.border THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST((p.f + CASE WHEN d.k <= b.border THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM d.source
"""


@query("op9_mixing", OP9_SQL)
def op9(spark, sf_dir):
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


@query("op10_sharding")
def op10(spark, sf_dir):
    out = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


OP11_SQL = r"""
WITH t0 AS (SELECT conv_id AS c, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS m,
                   length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(m)) - 1 AS pos FROM t0),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
bits AS (SELECT c, n, CAST(c AS VARCHAR) AS s, c - c % 100 AS base FROM n),
crc AS (SELECT c, n, base, xor(list_reduce(
          [CAST((ascii(s[(k // 8) + 1]) >> (k % 8)) & 1 AS BIGINT) FOR k IN range(8 * length(s))],
          lambda a, b: xor(a >> 1, 3988292384 * ((a + b) & 1)), 4294967295), 4294967295) % 6 AS h FROM bits),
r AS (SELECT crc.c, pos + 1 AS d, m, chars FROM crc JOIN t ON t.c = crc.base AND t.pos < crc.h
      UNION ALL
      SELECT crc.c, least(crc.h, coalesce(b.n, 0)) + pos - crc.h + 1, m, chars FROM crc
      JOIN t ON t.c = crc.c AND t.pos >= crc.h LEFT JOIN n b ON b.c = crc.base),
p AS (SELECT n.c, coalesce(list(sha256(m) ORDER BY d) FILTER (m IS NOT NULL), []) AS p,
             coalesce(list(chars ORDER BY d) FILTER (m IS NOT NULL), []) AS ch
      FROM n LEFT JOIN r ON r.c = n.c GROUP BY n.c),
x AS (SELECT c, d, p[1:d] AS k, ch[d] AS chars, d = len(p) AS last FROM p, unnest(range(0, len(p) + 1)) AS u(d)),
node AS (SELECT k, d, min(c) AS conv, count(*) AS n, max(chars) AS chars,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends
         FROM x GROUP BY k, d),
kid AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
up AS (SELECT node.k[1:i] AS k, kid.k IS NULL AS leaf, (node.n - 1) * coalesce(chars, 0) AS saving
       FROM node LEFT JOIN kid ON kid.k = node.k, unnest(range(0, node.d + 1)) AS u(i)),
total AS (SELECT k, count(*) FILTER (leaf) AS leaves, sum(saving) AS saving FROM up GROUP BY k)
SELECT node.conv AS conv_id, node.d AS depth, parent.conv AS parent_conv_id, node.n AS n_convs,
       coalesce(kid.n, 0) AS n_children, leaves AS n_leaves, CAST(saving AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN total ON total.k = node.k LEFT JOIN kid ON kid.k = node.k
LEFT JOIN node parent ON node.d > 0 AND parent.k = node.k[1:node.d - 1]
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            AND len(a.e) = len(b.e)
          WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93),
reach AS (SELECT a AS vec_id, b AS r FROM links
          UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1),
c AS (SELECT vec_id, min(r) AS r FROM reach GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.r, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(c.r, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id
"""


@query("op12_embedding_duplicates", OP12_SQL)
def op12(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def _op13_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    """The rounds as a chain of tables: nearest entry per part, then floor means."""
    near = """a{i} AS MATERIALIZED (SELECT x.vec_id, x.part, min(list_sum([CAST((x.x[j] - b.x[j]) * (x.x[j] - b.x[j]) AS HUGEINT)
         FOR j IN range(1, len(x.x) + 1)]) * {k} + b.entry) AS best FROM x JOIN b{i} b ON b.part = x.part GROUP BY ALL)"""
    means = """m{i} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM (
         SELECT a.part, a.best % {k} AS entry, u.j, count(*) AS n, sum(CAST(x.x[u.j] AS HUGEINT)) AS s
         FROM a{i} a JOIN x ON x.vec_id = a.vec_id AND x.part = a.part, unnest(range(1, len(x.x) + 1)) AS u(j) GROUP BY ALL)
         GROUP BY part, entry),
    b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b
         LEFT JOIN m{i} m ON m.part = b.part AND m.entry = b.entry)"""
    chain = []
    for i in range(rounds):
        chain += [near.format(i=i, k=entries), means.format(i=i, n=i + 1, k=entries)]
    return f"""
WITH v AS (
  SELECT vec_id, label, [CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p AS part, e[p * (len(e) // {parts}) + 1:(p + 1) * (len(e) // {parts})] AS x
      FROM v, unnest(range({parts})) AS u(p)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM x
       QUALIFY entry < {entries}),
{', '.join(chain)},
{near.format(i=rounds, k=entries)},
r AS (SELECT x.vec_id, any_value(x.label) AS label, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY x.part) AS code,
             CAST(sum(best // {entries}) AS BIGINT) AS error
      FROM a{rounds} a JOIN x ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY x.vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM r
"""


@query("op13_vector_codes", _op13_sql())
def op13(spark, sf_dir):
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))
