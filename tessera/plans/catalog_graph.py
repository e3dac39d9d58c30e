"""Queries of the graph family."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import layer_gap
from tessera.operators import graph, metrics, model
from tessera.plans.registry import registry
from tessera.plans.storage import stored
from tessera.sources import views

QUERIES, ORACLES, query = registry()

EDGES = """
e AS (
  SELECT 'part/' || l_partkey AS source, 'supplier/' || l_suppkey AS target, 'import' AS type,
    CASE min(l_returnflag) WHEN 'A' THEN 'inferred' WHEN 'N' THEN 'ambiguous' ELSE 'resolved' END AS resolution, min(l_linenumber) AS line
  FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'import', 'resolved', 1 FROM supplier
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'import', 'resolved', 1 FROM customer
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 'import', 'resolved', 1 FROM nation)"""
HANDOFFS = """
h AS (SELECT DISTINCT user_id AS source, nx AS target FROM (
  SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NOT NULL AND user_id <> nx)"""


def named(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(f"""WITH RECURSIVE {EDGES},
b AS (SELECT target AS a, source AS b, max(CASE resolution WHEN 'resolved' THEN 3 ELSE 2 END) AS r FROM e WHERE resolution <> 'ambiguous' GROUP BY 1, 2),
p1 AS (SELECT b AS node, r, [a, b] AS via FROM b WHERE a IN ('region/1', 'nation/3')), l1 AS (SELECT node, max(r) AS r, arg_min(via, (-r, via)) AS via FROM p1 WHERE node NOT IN ('region/1', 'nation/3') GROUP BY node),
p2 AS (SELECT b.b AS node, least(l1.r, b.r) AS r, list_append(l1.via, b.b) AS via FROM l1 JOIN b ON l1.node = b.a), l2 AS (SELECT node, max(r) AS r, arg_min(via, (-r, via)) AS via FROM p2 WHERE node NOT IN ('region/1', 'nation/3') AND node NOT IN (SELECT node FROM l1) GROUP BY node),
p3 AS (SELECT b.b AS node, least(l2.r, b.r) AS r, list_append(l2.via, b.b) AS via FROM l2 JOIN b ON l2.node = b.a), l3 AS (SELECT node, max(r) AS r, arg_min(via, (-r, via)) AS via FROM p3 WHERE node NOT IN ('region/1', 'nation/3') AND node NOT IN (SELECT node FROM l1) AND node NOT IN (SELECT node FROM l2) GROUP BY node),
x AS (SELECT *, 1 AS distance FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3)
SELECT node, CAST(distance AS INTEGER) AS distance, CASE r WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, array_to_string(via, '>') AS via, 'complete' AS status FROM x""")
def change_impact(spark, sf_dir):
    return graph.change_impact(views.edges(spark, sf_dir), named(spark, "region/1", "nation/3")).withColumn("via", F.array_join("via", ">"))


@query(f"WITH {EDGES} SELECT DISTINCT source AS node FROM e WHERE resolution = 'ambiguous' AND target = 'supplier/1'")
def possible_direct_impact(spark, sf_dir):
    return graph.possible_direct(views.edges(spark, sf_dir), named(spark, "supplier/1"))


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e),
w AS (SELECT 'nation/5' AS seed, 'nation/5' AS node, 0 AS d UNION SELECT seed, u.b, d + 1 FROM w JOIN u ON w.node = u.a WHERE d < 2)
SELECT seed, node, CAST(min(d) AS INTEGER) AS distance FROM w GROUP BY seed, node""")
def bfs_neighbourhood(spark, sf_dir):
    return graph.bounded_bfs(views.edges(spark, sf_dir), named(spark, "nation/5"), 2, "both")


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e),
w AS (SELECT node AS seed, node, 0 AS d FROM (VALUES ('region/0'), ('supplier/2')) t(node) UNION SELECT seed, u.b, d + 1 FROM w JOIN u ON w.node = u.a WHERE d < 3)
SELECT seed, node, CAST(min(d) AS INTEGER) AS distance FROM w GROUP BY seed, node HAVING node LIKE 'nation/%'""")
def hop_distances(spark, sf_dir):
    return graph.bounded_bfs(views.edges(spark, sf_dir), named(spark, "region/0", "supplier/2"), 3, "both").where(F.col("node").startswith("nation/"))


DEGREE = """d AS (SELECT node, sum(i) AS n_in, sum(o) AS n_out FROM (
  SELECT source AS node, 0 AS i, 1 AS o FROM (SELECT DISTINCT source, target FROM e) UNION ALL SELECT target, 1, 0 FROM (SELECT DISTINCT source, target FROM e)) GROUP BY node)"""


@query(f"WITH {EDGES}, {DEGREE} SELECT node, CAST(n_in AS BIGINT) AS n_in, CAST(n_out AS BIGINT) AS n_out, CAST(n_in + n_out AS BIGINT) AS degree FROM d ORDER BY degree DESC, node LIMIT 25")
def important_nodes(spark, sf_dir):
    d = graph.degrees(views.edges(spark, sf_dir)).withColumn("degree", F.col("n_in") + F.col("n_out"))
    return d.orderBy(F.desc("degree"), "node").limit(25)


@query(f"WITH {HANDOFFS} SELECT x.source AS a, x.target AS b FROM h x JOIN h y ON x.source = y.target AND x.target = y.source WHERE x.source < x.target")
def mutual_pairs(spark, sf_dir):
    return graph.mutual_pairs(views.handoffs(spark, sf_dir))


GROUPS = "g AS (SELECT 'supplier/' || s_suppkey AS node, n_name AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'part/' || p_partkey, p_brand FROM part)"


def groups(spark, sf_dir):
    t = lambda n: views.table(spark, sf_dir, n)
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("node"), F.col("n_name").alias("grp"))
    return s.union(t("part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")), "p_brand"))


@query(f"WITH {EDGES}, {GROUPS} SELECT a.grp AS from_group, b.grp AS to_group, count(*) AS n_edges FROM e JOIN g a ON e.source = a.node JOIN g b ON e.target = b.node WHERE a.grp <> b.grp GROUP BY 1, 2")
def module_edges(spark, sf_dir):
    return graph.module_edges(views.edges(spark, sf_dir), groups(spark, sf_dir))


@query(f"""WITH {EDGES}, {GROUPS}, m AS (SELECT a.grp AS f, b.grp AS t FROM e JOIN g a ON e.source = a.node JOIN g b ON e.target = b.node WHERE a.grp <> b.grp)
SELECT f AS module, count(DISTINCT t) AS n_modules, count(*) AS n_edges FROM m GROUP BY f HAVING count(DISTINCT t) >= 4""")
def weak_boundaries(spark, sf_dir):
    m = graph.module_edges(views.edges(spark, sf_dir), groups(spark, sf_dir))
    return m.groupBy(F.col("from_group").alias("module")).agg(F.count("*").alias("n_modules"), F.sum("n_edges").alias("n_edges")).where("n_modules >= 4")


SINK_VALUE = 150
LEVELS = {"region": 0, "nation": 1, "supplier": 2, "customer": 2, "part": 4}
LEVEL_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEVELS.items())


def crossings(spark, sf_dir):
    kind = lambda c: F.substring_index(c, "/", 1)
    return views.edges(spark, sf_dir).where("resolution = 'resolved'").select("source", "target", kind("source").alias("from_layer"), kind("target").alias("to_layer"), layer_gap(kind("source"), kind("target"), LEVELS).alias("gap"))


@query(f"""WITH {EDGES} SELECT from_layer, to_layer, count(*) AS n_violations FROM (SELECT DISTINCT source, target, split_part(source, '/', 1) AS from_layer, split_part(target, '/', 1) AS to_layer FROM e WHERE resolution = 'resolved')
WHERE (CASE from_layer {LEVEL_SQL} END) - (CASE to_layer {LEVEL_SQL} END) > 1 GROUP BY 1, 2""")
def layer_violations(spark, sf_dir):
    bad = crossings(spark, sf_dir).where("gap > 1").dropDuplicates(["source", "target"])
    return bad.groupBy("from_layer", "to_layer").agg(F.count("*").alias("n_violations"))


@query(f"""WITH {EDGES}, r AS (SELECT (CASE split_part(source, '/', 1) {LEVEL_SQL} END) - (CASE split_part(target, '/', 1) {LEVEL_SQL} END) > 1 AS bad FROM e WHERE resolution = 'resolved'),
s AS (SELECT count(*) FILTER (bad) AS n_bad, count(*) AS n_edges FROM r)
SELECT n_bad, n_edges, round(n_bad * 100.0::DOUBLE / n_edges, 1) AS pct, CASE WHEN n_bad * 100.0 / n_edges >= 20 THEN 'high' WHEN n_bad * 100.0 / n_edges >= 8 THEN 'medium' ELSE 'low' END AS level FROM s""")
def drift(spark, sf_dir):
    s = crossings(spark, sf_dir).agg(F.count_if(F.col("gap") > 1).alias("n_bad"), F.count("*").alias("n_edges"))
    pct = F.col("n_bad") * F.lit(100.0) / F.col("n_edges")
    return s.select("n_bad", "n_edges", F.round(pct, 1).alias("pct"), F.when(pct >= 20, "high").when(pct >= 8, "medium").otherwise("low").alias("level"))


@query(f"""WITH {EDGES} SELECT source, count(DISTINCT target) AS n FROM e WHERE resolution = 'resolved' AND (CASE split_part(source, '/', 1) {LEVEL_SQL} END) - (CASE split_part(target, '/', 1) {LEVEL_SQL} END) > 1 GROUP BY source ORDER BY n DESC, source LIMIT 5""")
def drift_offenders(spark, sf_dir):
    return metrics.drift_offenders(crossings(spark, sf_dir))


@query(f"""WITH {EDGES}, s AS (SELECT DISTINCT target AS root, source AS node FROM e),
a AS (SELECT root, node, 1 AS d FROM s UNION ALL SELECT x.root, y.node, 2 FROM s x JOIN s y ON x.node = y.root
  UNION ALL SELECT x.root, z.node, 3 FROM s x JOIN s y ON x.node = y.root JOIN s z ON y.node = z.root),
n AS (SELECT root, node, min(d) AS d FROM a WHERE root <> node GROUP BY 1, 2)
SELECT root AS node, count(*) FILTER (d = 1) AS direct, count(*) FILTER (d > 1) AS transitive,
  round(sum(CASE d WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE / 3 END), 1) AS impact,
  CASE WHEN count(*) FILTER (d = 1) >= 8 THEN 'critical' WHEN count(*) FILTER (d = 1) >= 4 THEN 'high' WHEN count(*) FILTER (d = 1) >= 2 THEN 'medium' ELSE 'low' END AS level
FROM n GROUP BY root""")
def blast_radius(spark, sf_dir):
    return graph.blast_radius(views.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e),
w AS (SELECT node, 1 AS batch FROM n WHERE node NOT IN (SELECT target FROM e) UNION SELECT e.target, w.batch + 1 FROM w JOIN e ON w.node = e.source)
SELECT node, CAST(max(batch) AS INTEGER) AS batch, false AS in_cycle FROM w GROUP BY node""")
def migration_order(spark, sf_dir):
    e = views.edges(spark, sf_dir)
    return graph.migration_order(e.select(F.col("source").alias("node")).union(e.select("target")), e)


@query(f"""WITH RECURSIVE {HANDOFFS}, r AS (SELECT source AS a, target AS b FROM h UNION SELECT r.a, h.target FROM r JOIN h ON r.b = h.source)
SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""")
def strongly_connected(spark, sf_dir):
    return graph.strongly_connected(views.handoffs(spark, sf_dir))


@query(f"""WITH RECURSIVE {HANDOFFS}, r AS (SELECT source AS a, target AS b FROM h UNION SELECT r.a, h.target FROM r JOIN h ON r.b = h.source),
c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
e AS (SELECT s.component AS a, t.component AS b FROM h LEFT JOIN c s ON h.source = s.node LEFT JOIN c t ON h.target = t.node),
n AS (SELECT component, count(*) AS n_nodes, array_to_string(list_slice(list(node ORDER BY node), 1, 5), ',') AS members FROM c GROUP BY component)
SELECT component, n_nodes, members, (SELECT count(*) FROM e WHERE a = component AND b = component) AS n_edges, (SELECT count(*) FROM e WHERE b = component AND a IS DISTINCT FROM component) AS n_in,
  (SELECT count(*) FROM e WHERE a = component AND b IS DISTINCT FROM component) AS n_out FROM n""")
def cycle_summaries(spark, sf_dir):
    found = graph.cycle_summaries(views.handoffs(spark, sf_dir))
    return found.select("component", "n_nodes", F.array_join("members", ",").alias("members"), "n_edges", "n_in", "n_out")


#: Rounds of least neighbours, over twice as many as the graph is wide.
ROUNDS = "".join(f", l{i + 1} AS (SELECT l.node, least(min(l.c), min(m.c)) AS c FROM l{i} l JOIN u ON l.node = u.a JOIN l{i} m ON u.b = m.node GROUP BY l.node)" for i in range(12))


@query(f"""WITH {EDGES}, u AS MATERIALIZED (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), l0 AS (SELECT DISTINCT a AS node, a AS c FROM u){ROUNDS.replace(" AS (", " AS MATERIALIZED (")}
SELECT node, c AS component FROM l12""")
def connected_components(spark, sf_dir):
    return graph.connected(views.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e),
w AS (SELECT node FROM n WHERE node LIKE 'customer/%' UNION SELECT e.target FROM w JOIN e ON w.node = e.source)
SELECT node FROM n WHERE node NOT IN (SELECT node FROM w)""")
def unreachable(spark, sf_dir):
    e = views.edges(spark, sf_dir)
    nodes = e.select(F.col("source").alias("node")).union(e.select("target"))
    return graph.unreachable(nodes, e, nodes.where("node LIKE 'customer/%'"))


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT DISTINCT target AS a, source AS b FROM e),
w AS (SELECT 'supplier/' || s_suppkey AS seed, 'supplier/' || s_suppkey AS node, 0 AS d FROM supplier WHERE s_acctbal < 0 UNION SELECT seed, u.b, d + 1 FROM w JOIN u ON w.node = u.a WHERE d < 8)
SELECT node, count(DISTINCT seed) AS n_seeds, CAST(min(d) AS INTEGER) AS nearest FROM w WHERE d > 0 GROUP BY node""")
def risk_propagation(spark, sf_dir):
    seeds = views.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("node"))
    reach = graph.bounded_bfs(views.edges(spark, sf_dir), seeds, 8, "in").where("distance > 0")
    return reach.groupBy("node").agg(F.count("*").alias("n_seeds"), F.min("distance").alias("nearest"))


#: One hop after another: the edge of greatest weight to a node that the path lacks.
HOPS = "".join(f", p{i + 1} AS (SELECT start, list_append(path, arg_min(target, (-(target % 17), target))) AS path FROM p{i} JOIN h ON h.source = path[-1] AND NOT list_contains(path, target) GROUP BY start, path)" for i in range(6))


@query(f"""WITH {HANDOFFS}, t AS (SELECT source AS start FROM h GROUP BY source ORDER BY count(*) DESC, source LIMIT 5), p0 AS (SELECT start, [start] AS path FROM t){HOPS}
{" UNION ALL ".join(f"SELECT start, {i} AS hop, path[-1] AS node FROM p{i}" for i in range(7))}""")
def flow_trace(spark, sf_dir):
    weighted = views.handoffs(spark, sf_dir).withColumn("weight", F.col("target") % 17)
    top = graph.degrees(views.handoffs(spark, sf_dir)).orderBy(F.desc("n_out"), "node").limit(5).select("node")
    return graph.greedy_trace(weighted, top)


@query(f"""WITH {EDGES}, s AS (SELECT DISTINCT source AS a, target AS b FROM e),
p AS (SELECT x.a || '>' || x.b AS path FROM s x WHERE x.a IN ('part/1', 'part/2') UNION ALL SELECT x.a || '>' || x.b || '>' || y.b FROM s x JOIN s y ON x.b = y.a WHERE x.a IN ('part/1', 'part/2')
  UNION ALL SELECT x.a || '>' || x.b || '>' || y.b || '>' || z.b FROM s x JOIN s y ON x.b = y.a JOIN s z ON y.b = z.a WHERE x.a IN ('part/1', 'part/2')) SELECT path FROM p""")
def path_enumeration(spark, sf_dir):
    return graph.simple_paths(views.edges(spark, sf_dir), named(spark, "part/1", "part/2")).select(F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {EDGES}, s AS (SELECT DISTINCT source AS a, target AS b FROM e), n AS (SELECT DISTINCT a AS start FROM s WHERE a LIKE 'supplier/%'),
p(start, path) AS (SELECT start, [start] FROM n UNION ALL SELECT start, list_append(path, b) FROM p JOIN s ON a = path[-1] AND NOT list_contains(path, b) WHERE len(path) <= 3),
t AS (SELECT *, EXISTS (SELECT 1 FROM s WHERE a = path[-1] AND NOT list_contains(path, b)) AS more FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path), path) AS n, count(*) OVER (PARTITION BY start) AS c FROM t WHERE len(path) > 1 AND (NOT more OR len(path) = 4)),
z AS (SELECT start, bool_or(more AND len(path) = 4) AS beyond FROM t GROUP BY start)
SELECT start, array_to_string(path, '>') AS path, CASE WHEN beyond OR coalesce(c, 0) > 30 THEN 'partial' ELSE 'complete' END AS status FROM z LEFT JOIN (SELECT * FROM r WHERE n <= 30) USING (start)""")
def first_paths(spark, sf_dir):
    e = views.edges(spark, sf_dir)
    starts = e.where(F.startswith("source", F.lit("supplier/"))).select(F.col("source").alias("node")).distinct()
    return graph.first_paths(e, starts, depth=3).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {EDGES} SELECT source, target, resolution, line FROM e WHERE source = 'supplier/3' OR target = 'supplier/3'")
def direct_connections(spark, sf_dir):
    return views.edges(spark, sf_dir).where("source = 'supplier/3' OR target = 'supplier/3'").select("source", "target", "resolution", "line")


@query(f"""WITH {EDGES}, n AS (SELECT 'part/' || p_partkey AS node FROM part WHERE p_size < 40 UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier)
SELECT source, target FROM e WHERE source LIKE 'part/%' AND source NOT IN (SELECT node FROM n)""")
def dangling_edges(spark, sf_dir):
    name = lambda k, c: F.concat(F.lit(f"{k}/"), F.col(c).cast("string")).alias("source")
    known = views.table(spark, sf_dir, "part").where("p_size < 40").select(name("part", "p_partkey"))
    return views.edges(spark, sf_dir).where("source LIKE 'part/%'").join(known, "source", "left_anti").select("source", "target")


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT 'part/1' AS node, 0 AS d UNION SELECT e.target, d + 1 FROM w JOIN e ON w.node = e.source WHERE d < 4 AND e.type = 'import'),
m AS (SELECT node, CAST(min(d) AS INTEGER) AS distance FROM w GROUP BY node) SELECT *, CASE WHEN (SELECT count(*) FROM m) > 200 THEN 'partial' ELSE 'complete' END AS status FROM m ORDER BY distance, node LIMIT 200""")
def model_slice(spark, sf_dir):
    return model.slice_of(views.edges(spark, sf_dir), named(spark, "part/1"), ["import"])


@query(f"""WITH {EDGES}, b AS (SELECT source AS node, target AS other FROM e UNION SELECT target, source FROM e), d AS (SELECT node, count(*) AS degree FROM b GROUP BY node)
SELECT node, CASE WHEN node = 'supplier/4' THEN 0 WHEN node IN (SELECT node FROM b WHERE other = 'supplier/4') THEN 1 ELSE 2 END AS tier, degree FROM d ORDER BY tier, degree DESC, node LIMIT 80""")
def visible_window(spark, sf_dir):
    return model.visible_window(views.edges(spark, sf_dir), named(spark, "supplier/4"))


@query(f"""WITH {EDGES}, b AS (SELECT target AS a, source AS b FROM e WHERE resolution <> 'ambiguous'), l AS (SELECT 'test/' || l_orderkey AS test, 'supplier/' || l_suppkey AS source, l_linenumber % 3 + 1 AS rank FROM lineitem),
h AS (SELECT 'nation/3' AS node, 0 AS hops UNION ALL SELECT DISTINCT b, 1 FROM b WHERE a = 'nation/3'), m AS (SELECT test, hops, rank FROM l JOIN h ON l.source = h.node),
r AS (SELECT test, min(hops) AS hops FROM m GROUP BY test) SELECT test, CAST(hops AS INTEGER) AS hops, CAST(max(rank) AS INTEGER) AS rank FROM m JOIN r USING (test, hops) GROUP BY test, hops""")
def test_recommendation(spark, sf_dir):
    l = views.table(spark, sf_dir, "lineitem")  # noqa: E741
    links = l.select(F.concat(F.lit("test/"), F.col("l_orderkey").cast("string")).alias("test"), F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("source"), (F.col("l_linenumber") % 3 + 1).alias("rank"))
    return model.recommended_tests(views.edges(spark, sf_dir), named(spark, "nation/3"), links)


@query(f"""WITH {EDGES}, o AS (SELECT 'supplier/' || s_suppkey AS path, s_suppkey % 4 AS g FROM supplier WHERE s_suppkey % 9 <> 0), n AS (SELECT 'supplier/' || s_suppkey AS path, CASE WHEN s_suppkey % 25 = 0 THEN -1 ELSE s_suppkey % 4 END AS g FROM supplier WHERE s_suppkey % 7 <> 0),
s AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.g <> n.g THEN 'modified' END AS status FROM o FULL JOIN n ON o.path = n.path),
x AS (SELECT DISTINCT source AS node FROM e JOIN s ON e.target = s.path WHERE status IN ('modified', 'removed') AND resolution <> 'ambiguous' AND source LIKE 'part/%')
SELECT path AS node, status AS why FROM s WHERE status IN ('added', 'modified') UNION ALL SELECT node, 'affected' FROM x""")
def incremental_plan(spark, sf_dir):
    s, k = views.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    path = F.concat(F.lit("supplier/"), k.cast("string")).alias("path")
    old = s.where(k % 9 != 0).select(path, (k % 4).alias("digest"))
    new = s.where(k % 7 != 0).select(path, F.when(k % 25 == 0, -1).otherwise(k % 4).alias("digest"))
    return model.incremental_plan(old, new, views.edges(spark, sf_dir), depth=1)


@query(f"""WITH {HANDOFFS}, b AS (SELECT user_id AS f, sum(CASE event_type WHEN 'error' THEN 1 ELSE 0 END) AS bad, max(value) AS top FROM events GROUP BY 1), s AS (SELECT f FROM b WHERE bad > 0 AND f IN (SELECT source FROM h)), k AS (SELECT f FROM b WHERE top > {SINK_VALUE}),
l1 AS (SELECT DISTINCT s.f, target AS t FROM s JOIN h ON s.f = source), l2 AS (SELECT DISTINCT f, target AS t FROM l1 JOIN h ON l1.t = source), l3 AS (SELECT DISTINCT f, target AS t FROM l2 JOIN h ON l2.t = source)
SELECT f AS source, t AS sink FROM (SELECT f, f AS t FROM s UNION SELECT * FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3) WHERE t IN (SELECT f FROM k)""")
def flows_across_calls(spark, sf_dir):
    """Sources are the functions with an error, sinks those with a high value, of all."""
    h = stored(views.handoffs(spark, sf_dir), "handoffs")  # ordered once, not in each round
    by = views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("function")).agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.max("value").alias("top"))
    sources = by.where("bad > 0").join(h.select(F.col("source").alias("function")), "function", "left_semi")
    return model.flows_across_calls(sources.select("function"), h.toDF("caller", "callee"), by.where(f"top > {SINK_VALUE}").select("function"), traces=False)
