"""The registered queries of the training-data operators, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, forest, langid, mixing, pii, quality, secretscan, shards, topk, urllists

LEAST_QUALITY = 0.3
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo n."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder("doc_id", 3) != 1))
    found = langid.identify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), F.col("best_lang").alias("lang_pred"), "score", "rejected")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def list_events(pages: DataFrame) -> DataFrame:
    """A list of dated entries made by rule: half the hosts seen, some suffixes and some sections."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    hosts = pages.select(urllists.host_of(F.col("url")).alias("entry")).where("entry IS NOT NULL").distinct()
    hosts = hosts.withColumn("h", F.md5(F.col("entry").cast("binary"))).where(F.substring("h", 1, 1) < "8")
    first = F.conv(F.substring("h", 2, 2), 16, 10).cast("int")
    dated = F.array(*(F.struct(F.lit(a).alias("action"), day(first + n).alias("at")) for a, n in (("add", 0), ("remove", 60), ("add", 100))))
    hosts = hosts.select(F.lit("hosts").alias("list"), "entry", F.explode(dated).alias("e")).select("list", "entry", "e.action", "e.at")
    fixed = pages.sparkSession.createDataFrame(FIXED_EVENTS, "list string, entry string, action string, at string").withColumn("at", F.col("at").cast("date"))
    return hosts.unionByName(fixed)


#: Entries of the query's own list.
FIXED_EVENTS = [
    ("suffixes", "example.net", "add", "2024-02-01"),
    ("suffixes", "example.net", "remove", "2024-05-01"),
    ("suffixes", "example.org", "add", "2024-07-15"),
    ("sections", "example.com/fr", "add", "2024-03-01"),
    ("sections", "example.com/fr", "add", "2024-04-01"),
    ("sections", "example.com/fr", "remove", "2024-09-01"),
    ("sections", "example.org/de", "remove", "2024-02-01"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    return urllists.evaluate(captures, list_events(pages), ["page_id", "url", "fetched"])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("found")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.jaccard_join(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(table(spark, sf_dir, "documents")).drop("found")


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> quality.Discriminant:
    return quality.train(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality_model(docs, spark, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), SHARDS)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language, op2_decontaminate, op3_url_filter, op4_pii, op5_topk, op6_jaccard, op7_secrets, op8_quality, op9_jump_shards, op10_mix)
    return {f.__name__: f for f in every}


def _op3_sql() -> str:
    fixed = ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in FIXED_EVENTS)
    return rf"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1), '') AS host,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS section
  FROM pages),
hosts AS (SELECT DISTINCT host AS entry, md5(host) AS h FROM captures WHERE host IS NOT NULL AND substr(md5(host), 1, 1) < '8'),
events AS (
  SELECT 'hosts' AS list, entry, action, CAST(DATE '2024-01-01' + (CAST('0x' || substr(h, 2, 2) AS INTEGER) + n) AS DATE) AS day
  FROM hosts, (VALUES ('add', 0), ('remove', 60), ('add', 100)) e(action, n)
  UNION ALL SELECT * FROM (VALUES {fixed}) f(list, entry, action, day)),
valid AS (
  SELECT * FROM (SELECT list, entry, action, day AS since, lead(day) OVER (PARTITION BY list, entry ORDER BY day, action) AS until FROM events)
  WHERE action = 'add' AND (until IS NULL OR until > since)),
matches AS (
  SELECT c.page_id, v.list FROM captures c JOIN valid v
    ON (v.entry = c.host OR c.host LIKE '%.' || v.entry
        OR (c.section <> '' AND (v.entry = c.host || '/' || c.section OR (c.host || '/' || c.section) LIKE '%.' || v.entry)))
   AND v.since <= c.fetched AND (v.until IS NULL OR c.fetched < v.until))
SELECT c.page_id, c.url, c.fetched, c.host, CASE WHEN c.host IS NOT NULL THEN c.section END AS section,
  coalesce(m.lists, '') AS lists, coalesce(m.n, 0) AS n_entries, coalesce(m.n, 0) > 0 AS blocked
FROM captures c LEFT JOIN (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n FROM matches GROUP BY page_id) m USING (page_id)"""


_OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256.0) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""


def _op10_sql() -> str:
    def inverse(share: str, schedule: tuple[float, ...]) -> str:
        knots, n = mixing.demand(schedule), len(schedule)
        inside = lambda i: f"(CAST({i} AS DOUBLE) + ({share} - CAST({knots[i]!r} AS DOUBLE)) / CAST({knots[i + 1] - knots[i]!r} AS DOUBLE)) / CAST({n} AS DOUBLE)"
        cases = " ".join(f"WHEN {share} < CAST({knots[i + 1]!r} AS DOUBLE) THEN {inside(i)}" for i in range(n - 1))
        return f"CASE {cases} ELSE {inside(n - 1)} END"

    kinds = " ".join(f"WHEN {k} THEN {inverse('share', s)}" for k, s in enumerate(mixing.SCHEDULES))
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} AS kind FROM s),
x AS (SELECT *, [{weights}][kind + 1] AS weight, source_size * {mixing.MOST} AS lim FROM w),
y AS (SELECT *, CAST(lim AS DOUBLE) / weight AS reach FROM x),
z AS (SELECT *, row_number() OVER o AS n,
    CAST((SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM y WINDOW o AS (ORDER BY reach, source IS NULL, source)),
t AS (SELECT source, source_size, kind,
    CASE WHEN level < reach THEN weight * (SELECT arg_min(level, n) FROM z WHERE level < reach) ELSE CAST(lim AS DOUBLE) END AS target FROM z),
p AS (SELECT d.*, t.source_size, t.kind, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, (CAST(start AS BIGINT) + source_size * 0 + size / CAST(2 AS DOUBLE)) AS m0, (CAST(start AS BIGINT) + source_size * 1 + size / CAST(2 AS DOUBLE)) AS m1, (CAST(start AS BIGINT) + source_size * 2 + size / CAST(2 AS DOUBLE)) AS m2 FROM p),
f AS (SELECT *, CASE WHEN m0 < target THEN m0 / target END AS share FROM u)
SELECT doc_id, size, source_size, target,
  size * (CAST(m0 < target AS BIGINT) + CAST(m1 < target AS BIGINT) + CAST(m2 < target AS BIGINT)) AS taken,
  CASE WHEN share IS NOT NULL THEN CASE kind {kinds} END END AS position
FROM f"""


_OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, text, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, md5(text) AS t, len(g) AS n, md5(array_to_string(list_sort(g), '|')) AS k FROM g),
u AS (SELECT doc_id, unnest(g) AS x FROM g),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i, j, x.t <> y.t AS other, y.t FROM c JOIN s x ON x.doc_id = i JOIN s y ON y.doc_id = j WHERE c.n >= 0.8 * (x.n + y.n - c.n) - 1e-9),
r(i, j) AS (SELECT i, j FROM l UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i)
SELECT d.doc_id, least(d.doc_id, (SELECT min(j) FROM r WHERE r.i = d.doc_id)) AS class_id,
  (SELECT count(*) FROM l WHERE l.i = d.doc_id) AS n_links, (SELECT count(DISTINCT t) FROM l WHERE l.i = d.doc_id AND other) AS n_text_links,
  (SELECT count(*) FROM s x JOIN s y USING (k) WHERE x.doc_id = d.doc_id AND y.doc_id <> d.doc_id) AS n_copies
FROM documents d"""


def _op9_sql() -> str:
    def jumped(shards: int) -> str:
        """The last jump below ``shards`` of every key."""
        return f"""
  SELECT key, max(place) AS shard FROM walk WHERE place < {shards} GROUP BY key"""

    step = "CAST((state * 2862933555777941757 + 1) % 18446744073709551616 AS UHUGEINT)"
    # Jumps go on until they pass the larger number of shards.
    return rf"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), a >> 1) ELSE a >> 1 END, i) AS c FROM range(256) r(i))),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UHUGEINT) AS key FROM documents),
c AS (
  SELECT doc_id, size, key, xor(list_reduce(list_transform(regexp_extract_all(bytes, '..'), lambda s: CAST('0x' || s AS BIGINT)),
    lambda a, b: xor(t[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS crc FROM d, t),
walk AS (
  SELECT DISTINCT key, key AS state, CAST(0 AS BIGINT) AS place FROM d
  UNION ALL
  SELECT key, {step}, CAST(floor(CAST(place + 1 AS DOUBLE) * (CAST(2147483648 AS DOUBLE) / (CAST({step} // 8589934592 AS DOUBLE) + CAST(1 AS DOUBLE)))) AS BIGINT)
  FROM walk WHERE place < {SHARDS + 1}),
a AS ({jumped(SHARDS)}),
b AS ({jumped(SHARDS + 1)})
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, CAST(a.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(crc AS VARCHAR)), doc_id) - 1 AS slot, CAST(b.shard AS INTEGER) AS grown_shard
FROM c JOIN a USING (key) JOIN b USING (key)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _op3_sql(), "op5_topk": _OP5_SQL, "op6_jaccard": _OP6_SQL, "op9_jump_shards": _op9_sql(), "op10_mix": _op10_sql()}
