"""Queries of retrieval, history, jobs and budgets."""

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators import retrieval as ops
from tessera.plans.catalog_graph import EDGES
from tessera.plans.registry import registry
from tessera.sources import views
from tessera.streaming import jobs

QUERIES, ORACLES, query = registry()


@query("""WITH f AS (SELECT doc_id AS path, text FROM documents WHERE length(text) <= 12000 AND trim(text) <> ''), c AS (SELECT path, unnest(range(0, CAST((length(text) - 1) // 1500 AS BIGINT) + 1)) AS i, text FROM f), p AS (SELECT path, CAST(i + 1 AS INTEGER) AS part, substr(text, i * 1500 + 1, 1500) AS content FROM c)
SELECT path, part, content FROM p WHERE trim(content) <> ''""")
def chunk_fixed(spark, sf_dir):
    return ops.fixed_chunks(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query()
def chunk_lines(spark, sf_dir):
    return ops.line_chunks(views.files(spark, sf_dir))


@query()
def hash_embeddings(spark, sf_dir):
    v = views.table(spark, sf_dir, "benchmark").select("item_id", ops.hash_embedding("text").alias("v"))
    return v.select("item_id", F.size("v").alias("dims"), F.round(ops.dot(F.col("v"), F.col("v")), 6).alias("norm"))


QUESTION = [((i * 37) % 11 - 5) / 10 for i in range(64)]


@query(f"""WITH q AS (SELECT CAST({QUESTION} AS DOUBLE[]) AS q), s AS (SELECT vec_id AS id, list_inner_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(q, q))) AS similarity FROM embeddings, q)
SELECT id, round(similarity, 6) AS similarity FROM s ORDER BY s.similarity DESC, id LIMIT 10""")
def vector_topk(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return ops.vector_topk(e, QUESTION, 10).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE {EDGES}, u AS MATERIALIZED (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), w AS (SELECT 'nation/3' AS node, 0 AS d UNION SELECT u.b, d + 1 FROM w JOIN u ON w.node = u.a WHERE d < 3),
d AS (SELECT node AS path, min(d) AS hops FROM w GROUP BY node), c AS (SELECT 'supplier/' || s_suppkey AS path, s_acctbal / 10000 AS similarity FROM supplier ORDER BY 2 DESC, 1 LIMIT 48),
s AS (SELECT path, similarity, similarity + coalesce(0.15::DOUBLE / (1 + hops), 0) AS score FROM c LEFT JOIN d USING (path)) SELECT path, round(score, 6) AS score FROM s ORDER BY s.score DESC, similarity DESC, path LIMIT 8""")
def graph_rerank(spark, sf_dir):
    return reranked(spark, sf_dir, views.edges(spark, sf_dir))


def reranked(spark, sf_dir, edges):
    s = views.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("path"), (F.col("s_acctbal") / 10000).alias("similarity"))
    hops = graph.bounded_bfs(edges, spark.createDataFrame([("nation/3",)], "node string"), 3, "both")
    out = ops.graph_rerank(s, hops.select(F.col("node").alias("path"), F.col("distance").alias("hops")), 8)
    return out.select("path", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT source || '/d' || doc_id || '.txt' AS path, text AS content, (doc_id % 97) / 100.0::DOUBLE AS similarity FROM documents ORDER BY 3 DESC, 1 LIMIT 48), k AS (SELECT * FROM c WHERE similarity >= greatest(0.43, (SELECT max(similarity) FROM c) - 0.09) AND regexp_matches(substr(lower(content), 1, 2500), '(^|[^a-z_])(license|licensed|terms)($|[^a-z_0-9])'))
SELECT path, round(similarity, 4) AS similarity FROM k ORDER BY k.similarity DESC, path LIMIT 4""")
def source_filter(spark, sf_dir):
    c = views.table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), ((F.col("doc_id") % 97) / 100.0).alias("similarity"))
    return ops.source_filter(c, "license licensed terms").select("path", F.round("similarity", 4).alias("similarity"))


@query(f"""WITH q AS (SELECT CAST({QUESTION} AS DOUBLE[]) AS q), s AS (SELECT vec_id AS id, list_inner_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(q, q))) AS similarity FROM embeddings, q),
c AS (SELECT d.doc_id AS id, d.text, row_number() OVER (ORDER BY s.similarity DESC, s.id) AS rank FROM (SELECT * FROM s ORDER BY similarity DESC, id LIMIT 8) s JOIN documents d ON d.doc_id = s.id)
SELECT substr(string_agg('### d' || id || chr(10) || substr(text, 1, 1200), chr(10) || chr(10) ORDER BY rank), 1, 4000) AS prompt FROM c""")
def prompt_assembly(spark, sf_dir):
    """The texts whose vectors are nearest to the question, of all."""
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    top = ops.vector_topk(e, QUESTION, 8).select("id", (-F.col("similarity")).alias("rank"))
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return ops.prompt(top.join(d, "id").select("rank", "path", "content"), total=4000)


@query("""WITH n AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations), s AS (SELECT conv_id, t, sum(length(coalesce(text, ''))) AS size FROM n WHERE t > 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t DESC) AS i, sum(size) OVER (PARTITION BY conv_id ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS so FROM s) SELECT n.conv_id, n.turn, n.role FROM n JOIN k USING (conv_id, t) WHERE i <= 2 AND (i = 1 OR so <= 1500)""")
def history_trim(spark, sf_dir):
    return ops.trimmed_history(views.table(spark, sf_dir, "conversations"), 2, 1500).select("conv_id", "turn", "role")


@query("""SELECT conv_id, CAST(sum(length(coalesce(text, ''))) // 4 + 1200 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")
def token_estimate(spark, sf_dir):
    n = F.sum(F.length(F.coalesce("text", F.lit(""))))
    return views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.floor(n / 4) + 1200).alias("tokens"))


@query("""WITH n AS (SELECT p_partkey AS id, lower(p_name) AS name FROM part), s AS (SELECT id, 5 * (name = 'almond')::INT + contains(name, 'al')::INT + contains(name, 'ro')::INT AS score FROM n) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 5""")
def question_context(spark, sf_dir):
    name = F.lower("p_name")
    score = (name == "almond").cast("int") * 5 + F.contains(name, F.lit("al")).cast("int") + F.contains(name, F.lit("ro")).cast("int")
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(5)


@query("""WITH e AS (SELECT user_id AS repository, CASE WHEN event_type IN ('click', 'view') THEN 'INDEX' ELSE 'DELETE' END AS operation, ts, event_id FROM events), l AS (SELECT repository, operation, max((ts, event_id)) AS m, count(*) AS enqueued FROM e GROUP BY 1, 2)
SELECT repository, operation, CASE WHEN m = max(m) OVER (PARTITION BY repository) THEN 'PENDING' ELSE 'CANCELLED' END AS status, enqueued FROM l""")
def job_replay(spark, sf_dir):
    op = F.when(F.col("event_type").isin("click", "view"), "INDEX").otherwise("DELETE")
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("repository"), op.alias("operation"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return jobs.replayed(e).select("repository", "operation", "status", "enqueued")


@query("""WITH j AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RETRY' WHEN 2 THEN 'RUNNING' ELSE 'DEAD' END AS status, ts FROM events), n AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events)
SELECT id, status FROM j, n WHERE (status IN ('PENDING', 'RETRY') AND ts + INTERVAL 60 SECOND <= now) OR (status = 'RUNNING' AND ts + INTERVAL 180 SECOND < now) ORDER BY ts, id LIMIT 20""")
def lease_claim(spark, sf_dir):
    k = F.col("event_id") % 4
    e = views.table(spark, sf_dir, "events")
    now = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now")).first()["now"]
    j = e.select(F.col("event_id").alias("id"), F.when(k == 0, "PENDING").when(k == 1, "RETRY").when(k == 2, "RUNNING").otherwise("DEAD").alias("status"), F.expr("ts + INTERVAL 60 SECOND").alias("next_attempt_at"), F.col("ts").alias("created_at"), F.expr("ts + INTERVAL 180 SECOND").alias("lease_until"))
    return jobs.claimable(j, F.lit(now), 20).select("id", "status")


@query("""SELECT event_id % 20 AS attempts, CAST(least(3600, 1 << CAST(least(12, greatest(1, event_id % 20)) AS INTEGER)) AS INTEGER) AS delay, count(*) AS n FROM events GROUP BY 1, 2""")
def retry_delay(spark, sf_dir):
    a = F.col("event_id") % 20
    return views.table(spark, sf_dir, "events").groupBy(a.alias("attempts"), jobs.retry_delay(a).alias("delay")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, CAST(sum(CAST(value * 1000 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM events""")
def rolling_budget(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("at"), F.round(F.col("value") * 1000).cast("long").alias("tokens"))
    return jobs.rolling_use(e, "user_id").select("user_id", "event_id", "used")
