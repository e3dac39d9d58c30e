"""Queries over findings and metrics."""

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import findings as ops
from tessera.operators import metrics
from tessera.plans.registry import registry
from tessera.sources import views

QUERIES, ORACLES, query = registry()

FOUND = """f AS (SELECT event_id AS id, event_type AS "ruleId", 'src/m' || (user_id % 7) || '/f' || user_id || '.py' AS path, CAST(event_id % 40 AS INTEGER) AS line,
  CASE WHEN value > 150 THEN 'critical' WHEN value > 80 THEN 'high' WHEN value > 30 THEN 'medium' WHEN value > 10 THEN 'low' ELSE 'info' END AS severity,
  CASE event_id % 3 WHEN 0 THEN 'FACT' WHEN 1 THEN 'INFERENCE' ELSE 'UNCERTAIN' END AS confidence, value, ts FROM events)"""


@query(f"""WITH {FOUND} SELECT "ruleId", path, line, severity, count(*) AS n, CASE max(CASE confidence WHEN 'FACT' THEN 3 WHEN 'INFERENCE' THEN 2 ELSE 1 END) WHEN 3 THEN 'FACT' WHEN 2 THEN 'INFERENCE' ELSE 'UNCERTAIN' END AS confidence,
  array_to_string(list_slice(list_sort(list(DISTINCT id)), 1, 5), ',') AS evidence FROM f GROUP BY 1, 2, 3, 4""")
def dedupe_findings(spark, sf_dir):
    return ops.deduplicated(views.findings(spark, sf_dir)).withColumn("evidence", F.array_join("evidence", ","))


@query(f"""WITH {FOUND} SELECT string_split("ruleId", '_')[1] AS family, path, line, count(*) AS n, count(DISTINCT "ruleId") AS n_rules FROM f GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def finding_clusters(spark, sf_dir):
    return ops.clusters(views.findings(spark, sf_dir))


RULES = [(1, "purchase", "src/m1/f1.py", None), (2, "cli.*", None, 3), (3, "click", None, None), (4, "*", None, 7)]


@query(f"""WITH {FOUND}, r AS (SELECT * FROM (VALUES (1, 'purchase', 'src/m1/f1.py', NULL), (2, 'cli.*', NULL, 3), (3, 'click', NULL, NULL), (4, '*', NULL, 7)) t(no, rule, rp, rl)),
h AS (SELECT id, min(no) AS suppressed_by FROM f JOIN r ON (rule = '*' OR rule = "ruleId" OR (rule LIKE '%.*' AND starts_with("ruleId", rule[:-2]))) AND (rp IS NULL OR rp = path) AND (rl IS NULL OR rl = line) GROUP BY id)
SELECT coalesce(suppressed_by, 0) AS suppressed_by, CASE WHEN suppressed_by IS NULL THEN 'open' ELSE 'suppressed' END AS status, count(*) AS n FROM f LEFT JOIN h USING (id) GROUP BY 1, 2""")
def suppress_findings(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "no int, rule string, path string, line int")
    out = ops.suppressed(views.findings(spark, sf_dir), rules)
    return out.groupBy(F.coalesce("suppressed_by", F.lit(0)).alias("suppressed_by"), "status").agg(F.count("*").alias("n"))


PATTERNS = [("long-number", "[0-9]{6,}", None), ("mail", "[a-z0-9.]+@[a-z0-9.]+", "^src"), ("shout", "!![ ]", "/en/"), ("unsafe", "(a+)+", None)]


@query("""WITH l AS (SELECT source || '/' || lang || '/d' || doc_id || '.txt' AS path, unnest(string_split(text, chr(10))) AS text FROM documents),
r AS (SELECT * FROM (VALUES ('long-number', '[0-9]{6,}', ''), ('mail', '[a-z0-9.]+@[a-z0-9.]+', '^src'), ('shout', '!![ ]', '/en/')) t(rule, pattern, include))
SELECT rule, path, count(*) AS n FROM l JOIN r ON regexp_matches(text, pattern) AND (include = '' OR regexp_matches(path, include)) GROUP BY 1, 2""")
def custom_rules(spark, sf_dir):
    rules = spark.createDataFrame(PATTERNS, "rule string, pattern string, include string")
    return ops.custom_rules(views.lines(views.files(spark, sf_dir)), rules).groupBy("rule", "path").agg(F.count("*").alias("n"))


@query(f"""WITH {FOUND}, k AS (SELECT id, "ruleId" || '|' || path || '|' || line || '|' || severity AS k FROM f),
h AS (SELECT id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM k)
SELECT id, 'finding:' || printf('%08x', h) AS key FROM h""")
def stable_ids(spark, sf_dir):
    key = F.concat_ws("|", "ruleId", "path", F.col("line").cast("string"), "severity")
    return views.findings(spark, sf_dir).select("id", F.concat(F.lit("finding:"), S.fnv1a(key)).alias("key"))


@query(f"""WITH {FOUND} SELECT severity, count(*) AS n, count(DISTINCT path) AS n_files FROM f GROUP BY severity""")
def severity_overview(spark, sf_dir):
    return views.findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files"))


@query(f"""WITH {FOUND} SELECT path, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM f GROUP BY path ORDER BY critical DESC, high DESC, path LIMIT 25""")
def hotspots(spark, sf_dir):
    by = views.findings(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return by.orderBy(F.desc("critical"), F.desc("high"), "path").limit(25)


#: Titles and categories that each call for another action.
ADVISED = (("Cognitive load", "", "split"), ("Clone of a block", "", "compare-copies"), ("Unused export", "", "check-unused"), ("Odd edge", "architecture", "inspect-path"), ("REST route twice", "", "verify-route"), ("Schema drift", "", "trace-schema"), ("Low coverage", "", "confirm-test"), ("Other", "misc", "review"))


@query(f"""WITH {FOUND} SELECT title, tag, action, count(*) AS n FROM (SELECT [{", ".join(f"'{t}'" for t, _, _ in ADVISED)}][id % 8 + 1] AS title, [{", ".join(f"'{a}'" for _, _, a in ADVISED)}][id % 8 + 1] AS action,
  CASE "ruleId" WHEN 'error' THEN 'FACT' WHEN 'click' THEN 'INFERENCE' ELSE 'UNCERTAIN' END AS tag FROM f) GROUP BY 1, 2, 3""")
def recommended_actions(spark, sf_dir):
    rule = F.col("ruleId")
    part = lambda k: F.element_at(F.array(*(F.lit(a[k]) for a in ADVISED)), (F.col("id") % 8 + 1).cast("int"))
    tag = F.when(rule == "error", "FACT").when(rule == "click", "INFERENCE").otherwise("UNCERTAIN")
    f = views.findings(spark, sf_dir).select(part(0).alias("title"), part(1).alias("category"), tag.alias("tag"))
    return f.groupBy("title", "tag", S.finding_action(F.col("title"), F.col("category")).alias("action")).agg(F.count("*").alias("n"))


@query("""SELECT lang AS language, count(*) AS n_files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS loc, round(sum(len(string_split(text, chr(10)))) * 100.0::DOUBLE / (SELECT sum(len(string_split(text, chr(10)))) FROM documents), 1) AS pct FROM documents GROUP BY lang""")
def language_stats(spark, sf_dir):
    from pyspark.sql import Window as W

    n = F.size(F.split("content", "\n"))
    by = views.files(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n_files"), F.sum(n).alias("loc"))
    return by.withColumn("pct", S.pct(F.col("loc"), F.sum("loc").over(W.partitionBy())))


@query("""SELECT coalesce(lang, 'all') AS language, coalesce(source, 'all') AS folder, count(*) AS n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines
FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def analysis_metrics(spark, sf_dir):
    f = views.table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.col("source").alias("folder"), F.octet_length("text").cast("long").alias("b"), F.size(F.split("text", "\n")).cast("long").alias("n"))
    sets = f.groupingSets([["language"], ["folder"], []], "language", "folder").agg(F.count("*").alias("n_files"), F.sum("b").alias("bytes"), F.sum("n").alias("n_lines"))
    return sets.select(F.coalesce("language", F.lit("all")).alias("language"), F.coalesce("folder", F.lit("all")).alias("folder"), "n_files", "bytes", "n_lines")


@query("""SELECT CAST(l_suppkey AS BIGINT) AS module, count(*) AS functions, count(*) FILTER (l_quantity < 10) AS dead, CAST(greatest(0, floor(100 - least(20.0, count(*) FILTER (l_quantity < 10) * 100.0::DOUBLE / count(*))
  - least(20.0, (max(l_tax) > 0.07)::INT * 5.0) - least(15.0, (count(*) > 600)::INT * 3.0) - least(15.0, greatest(0.0, count(*) * 1.0::DOUBLE / count(DISTINCT l_orderkey) - 3) * 2)
  - least(20.0, count(*) FILTER (l_discount >= 0.1) * 5.0) + 0.5)) AS INTEGER) AS score FROM lineitem GROUP BY l_suppkey""")
def health_score(spark, sf_dir):
    by = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("module")).agg(
        F.count("*").alias("functions"), F.count_if(F.col("l_quantity") < 10).alias("dead"), (F.max("l_tax") > 0.07).cast("int").alias("c"),
        (F.count("*") > 600).cast("int").alias("g"), F.count_distinct("l_orderkey").alias("files"), F.count_if(F.col("l_discount") >= 0.1).alias("h"),
    )
    score = S.health(F.col("functions"), F.col("dead"), F.col("c"), F.col("g"), F.col("files"), F.col("functions"), F.col("h"))
    return by.select("module", "functions", "dead", score.alias("score"))


@query("""WITH b AS (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS d, CAST(max(l_quantity) AS INTEGER) AS cx, count(*) FILTER (l_discount >= 0.1) AS sec FROM lineitem GROUP BY 1),
r AS (SELECT s, least(100, floor((CASE WHEN d >= 560 THEN 55 WHEN d >= 540 THEN 25 ELSE 5 END) * 0.6::DOUBLE + least(30, cx) * 0.25::DOUBLE + least(20, sec * 10) * 0.15::DOUBLE + 0.5)) AS x FROM b)
SELECT s AS node, CAST(x AS INTEGER) AS score, CASE WHEN x >= 70 THEN 'critical' WHEN x >= 45 THEN 'high' WHEN x >= 20 THEN 'medium' ELSE 'low' END AS level FROM r""")
def migration_risk(spark, sf_dir):
    b = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count_distinct("l_partkey").alias("d"), F.max("l_quantity").cast("int").alias("cx"), F.count_if(F.col("l_discount") >= 0.1).alias("sec"))
    level = F.when(F.col("d") >= 560, "high").when(F.col("d") >= 540, "medium").otherwise("low")
    x = b.select("node", S.migration_risk(level, F.col("cx"), F.col("sec")).alias("score"))
    return x.select("node", "score", F.when(F.col("score") >= 70, "critical").when(F.col("score") >= 45, "high").when(F.col("score") >= 20, "medium").otherwise("low").alias("level"))


@query("""SELECT coalesce(event_type, 'all') AS file, count(*) AS endpoints, count(*) FILTER (user_id % 3 = 0) AS protected, round(count(*) FILTER (user_id % 3 = 0) * 100.0::DOUBLE / count(*), 1) AS pct FROM events GROUP BY ROLLUP (event_type)""")
def auth_coverage(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").rollup(F.col("event_type").alias("file")).agg(F.count("*").alias("endpoints"), F.count_if(F.col("user_id") % 3 == 0).alias("protected"))
    return e.select(F.coalesce("file", F.lit("all")).alias("file"), "endpoints", "protected", S.pct(F.col("protected"), F.col("endpoints")).alias("pct"))


@query("""SELECT o_orderpriority AS stage, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'P') AS partial, count(*) FILTER (o_orderstatus = 'O') AS failed, CASE WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'partial' ELSE 'complete' END AS status FROM orders GROUP BY 1""")
def coverage_rollup(spark, sf_dir):
    s = lambda v: F.count_if(F.col("o_orderstatus") == v)
    by = views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(s("F").alias("complete"), s("P").alias("partial"), s("O").alias("failed"))
    return by.withColumn("status", F.when(F.col("failed") > 0, "partial").otherwise("complete"))


@query("""WITH f AS (SELECT c_mktsegment || '/' || lower(split_part(n_name, ' ', 1)) || CASE c_custkey % 3 WHEN 0 THEN '_service' WHEN 1 THEN 'Controller' ELSE '' END || '.py' AS path, lower(split_part(n_name, ' ', 1)) AS token FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT replace(replace(token, '_', ''), '-', '') AS token, count(DISTINCT path) AS n FROM f GROUP BY 1 HAVING count(DISTINCT path) >= 2 AND length(replace(replace(token, '_', ''), '-', '')) >= 3""")
def domain_clusters(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").join(views.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    suffix = F.when(k == 0, "_service").when(k == 1, "Controller").otherwise("")
    return metrics.domain_clusters(c.select(F.concat("c_mktsegment", F.lit("/"), F.lower(F.substring_index("n_name", " ", 1)), suffix, F.lit(".py")).alias("path")))


@query("""WITH c AS (SELECT 'f' || l_suppkey AS path, 'r' || (l_partkey % 30) AS target, CASE l_returnflag WHEN 'A' THEN 'saveAll' WHEN 'N' THEN 'findOne' ELSE 'deleteById' END AS fn FROM lineitem)
SELECT target, count(DISTINCT path) AS n_callers, array_to_string(list_sort(list(DISTINCT path)), ',') AS callers FROM c WHERE fn <> 'findOne' AND CAST(substr(target, 2) AS INTEGER) % 2 = 0 GROUP BY target""")
def write_ownership(spark, sf_dir):
    f = F.col("l_returnflag")
    calls = views.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("path"), F.concat(F.lit("r"), (F.col("l_partkey") % 30).cast("string")).alias("target"), F.when(f == "A", "saveAll").when(f == "N", "findOne").otherwise("deleteById").alias("fn"))
    roles = spark.range(30).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") % 2 == 0, "Repository").otherwise("Service").alias("role"))
    return metrics.write_owners(calls, roles).withColumn("callers", F.array_join("callers", ","))


@query("""WITH n AS (SELECT p_partkey AS id FROM part UNION ALL SELECT p_partkey FROM part WHERE p_size = 1), e AS (SELECT l_partkey AS source, l_suppkey + 1950 AS target, l_returnflag AS type, l_linenumber AS line FROM lineitem), l AS (SELECT p_partkey AS path, p_size % 7 AS len FROM part)
SELECT 'dangling' AS problem, count(*) AS n FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) WHERE id NOT IN (SELECT id FROM n)
UNION ALL SELECT 'duplicate-node', count(*) FROM (SELECT id FROM n GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'duplicate-relation', count(*) FROM (SELECT 1 FROM e GROUP BY source, target, type HAVING count(*) > 1)
UNION ALL SELECT 'evidence-line', count(*) FROM e JOIN l ON source = path WHERE line < 1 OR line > len""")
def graph_audit(spark, sf_dir):
    p, l = views.table(spark, sf_dir, "part"), views.table(spark, sf_dir, "lineitem")  # noqa: E741
    nodes = p.select(F.col("p_partkey").alias("id")).union(p.where("p_size = 1").select("p_partkey"))
    edges = l.select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1950).alias("target"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("line"))
    return metrics.audit(nodes, edges, p.select("p_partkey", F.col("p_size") % 7))
