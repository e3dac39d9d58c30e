"""Queries that join facts of different kinds."""

from pyspark.sql import functions as F

from tessera.operators import linkage as ops
from tessera.plans.registry import registry
from tessera.sources import views

QUERIES, ORACLES, query = registry()


@query("""WITH d AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(d.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'unused' WHEN d.key IS NULL THEN 'undefined' ELSE 'used' END AS status, coalesce(d.n, 0) AS n_defined, coalesce(r.n, 0) AS n_referenced FROM d FULL JOIN r ON d.key = r.key""")
def config_linkage(spark, sf_dir):
    l = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_returnflag")  # noqa: E741
    return ops.config_keys(l.where("l_returnflag = 'A'"), l.where("l_returnflag = 'R'"))


@query("""WITH p AS (SELECT event_id AS id, event_type AS transport, CAST(floor(value) AS BIGINT) AS channel, user_id AS file FROM events WHERE event_id % 2 = 0), s AS (SELECT DISTINCT event_type AS transport, CAST(floor(value) AS BIGINT) AS channel, user_id AS file FROM events WHERE event_id % 2 = 1),
j AS (SELECT p.id, count(s.file) AS n, min(s.file) AS t FROM p LEFT JOIN s ON p.transport = s.transport AND p.channel = s.channel AND p.file <> s.file GROUP BY p.id)
SELECT id, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, coalesce(CASE WHEN n = 1 THEN t END, -1) AS target FROM j""")
def pubsub_links(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("transport"), F.floor("value").alias("channel"), F.col("user_id").alias("file"))
    out = ops.message_links(e.where("id % 2 = 0"), e.where("id % 2 = 1"))
    return out.select("id", "status", F.coalesce("target", F.lit(-1)).alias("target"))


@query("""WITH d AS (SELECT lower(p_brand) AS k, count(*) AS n, min(p_partkey) AS declared FROM part WHERE p_size > 47 GROUP BY 1 HAVING count(*) = 1), u AS (SELECT p_partkey AS id, p_brand AS name FROM part)
SELECT id, coalesce(declared, -1) AS declared FROM u LEFT JOIN d ON lower(name) = k""")
def sql_table_links(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    uses, decl = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")), p.where("p_size > 47").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    return ops.unique_by_name(uses, decl).select("id", F.coalesce("declared", F.lit(-1)).alias("declared"))


@query("""SELECT event_type AS method, user_id % 50 AS path, count(DISTINCT (user_id, event_id % 5)) AS n FROM events GROUP BY 1, 2 HAVING count(DISTINCT (user_id, event_id % 5)) > 1""")
def route_collisions(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 50).alias("path"), F.col("user_id").alias("file"), (F.col("event_id") % 5).alias("line"))
    return ops.collisions(e)


@query("""WITH s AS (SELECT user_id AS file, event_id AS span, event_id AS start, event_id + CAST(floor(value) AS BIGINT) * 20 AS e FROM events WHERE event_type = 'view'), p AS (SELECT user_id AS file, event_id AS point FROM events WHERE event_type <> 'view'),
r AS (SELECT point, span, row_number() OVER (PARTITION BY point ORDER BY e - start, span) AS n FROM p LEFT JOIN s ON p.file = s.file AND start <= point AND point <= e)
SELECT point, coalesce(span, -1) AS span FROM r WHERE n = 1""")
def innermost_span(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "event_id", "event_type", "value")
    spans = e.where("event_type = 'view'").select("file", F.col("event_id").alias("span"), F.col("event_id").alias("start"), (F.col("event_id") + F.floor("value") * 20).alias("end"))
    points = e.where("event_type <> 'view'").select("file", F.col("event_id").alias("point"), F.col("event_id").alias("at"))
    return ops.innermost(points, spans, "file").select("point", F.coalesce("span", F.lit(-1)).alias("span"))


@query("""WITH s AS (SELECT l_orderkey AS trace, l_linenumber AS span, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 - (l_suppkey % 2) END AS parent FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_suppkey)),
x AS (SELECT s.trace, CASE WHEN s.parent IS NULL THEN 'root' WHEN p.span IS NULL THEN 'orphan' ELSE 'linked' END AS status FROM s LEFT JOIN s p ON s.trace = p.trace AND s.parent = p.span)
SELECT trace, count(*) AS spans, count(*) FILTER (status = 'linked') AS links, count(*) FILTER (status = 'orphan') AS orphans FROM x GROUP BY trace""")
def trace_summary(spark, sf_dir):
    l = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").alias("span")).agg(F.min("l_suppkey").alias("s"))  # noqa: E741
    spans = l.select("trace", "span", F.when(F.col("span") > 1, F.col("span") - 1 - F.col("s") % 2).cast("int").alias("parent"))
    return ops.parent_links(spans).groupBy("trace").agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "linked").alias("links"), F.count_if(F.col("status") == "orphan").alias("orphans"))


@query("""SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey + 1 FROM orders)""")
def orphan_tables(spark, sf_dir):
    c, o = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "orders")
    keys = o.select(F.col("o_custkey").alias("source"), (F.col("o_custkey") + 1).alias("target"))
    names = c.select(F.col("c_custkey").alias("name"), "c_name")
    return ops.orphans(names, keys).select(F.col("c_name").alias("name"))


@query("""WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'react' WHEN 1 THEN 'org.x:junit' WHEN 2 THEN 'mysql-connector-java' WHEN 3 THEN 'unheard' ELSE 'Spring_Boot.starter' END AS name FROM part)
SELECT name, CASE name WHEN 'react' THEN 'MIT' WHEN 'org.x:junit' THEN 'EPL-2.0' WHEN 'mysql-connector-java' THEN 'GPL-2.0' ELSE 'unknown' END AS licence, CASE name WHEN 'react' THEN 'permissive' WHEN 'org.x:junit' THEN 'permissive' WHEN 'mysql-connector-java' THEN 'copyleft' ELSE 'unknown' END AS class,
  CASE WHEN contains(name, ':') THEN 'unmappable' WHEN name IN ('react', 'Spring_Boot.starter') THEN 'used' ELSE 'unused' END AS usage, count(*) AS n FROM p GROUP BY 1, 2, 3, 4""")
def package_licences(spark, sf_dir):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "react").when(k == 1, "org.x:junit").when(k == 2, "mysql-connector-java").when(k == 3, "unheard").otherwise("Spring_Boot.starter")
    p = views.table(spark, sf_dir, "part").select(name.alias("name"))
    imports = spark.createDataFrame([("react",), ("spring-boot-starter",)], "name string")
    out = ops.usage(ops.licence_class(p), imports, ~F.contains("name", F.lit(":")))
    return out.groupBy("name", "licence", "class", F.when(F.col("used").isNull(), "unmappable").when(F.col("used"), "used").otherwise("unused").alias("usage")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_partkey AS test, l_suppkey AS source, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS r FROM lineitem)
SELECT test, source, CAST(max(r) AS INTEGER) AS rank, CASE max(r) WHEN 3 THEN 'imports' WHEN 2 THEN 'path-convention' ELSE 'filename-convention' END AS how FROM c GROUP BY 1, 2""")
def test_links(spark, sf_dir):
    f = F.col("l_returnflag")
    c = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("test"), F.col("l_suppkey").alias("source"), F.when(f == "A", 3).when(f == "N", 2).otherwise(1).alias("rank"), F.when(f == "A", "imports").when(f == "N", "path-convention").otherwise("filename-convention").alias("how"))
    return ops.ranked_links(c)


@query("""SELECT lower(n_name) AS key, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS columns FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def merged_schema(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").join(views.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = c.groupBy(F.col("n_name").alias("name"), "c_mktsegment").agg(F.min("c_custkey").alias("ord")).select("name", "ord", F.array("c_mktsegment").alias("columns"))
    return ops.merged_tables(found).select("key", F.array_join("columns", ",").alias("columns"))


@query("""SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id) WHERE n_chars <= 12000 AND trim(text) <> ''""")
def unindexed_files(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").where("n_chars <= 12000 AND trim(text) <> ''")
    return d.join(views.table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")
