"""Queries over scalar rules, function measures, exports and formats, each through its operator."""

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import extract, metrics, model, text
from tessera.plans.catalog_code import API, C, N, SRV, union
from tessera.plans.catalog_text import PATHS, paths
from tessera.plans.registry import registry
from tessera.sources import repository, views

QUERIES, ORACLES, query = registry()


@query("""SELECT p_partkey AS id, p_partkey % 4 IN (1, 2) AS is_binary FROM part""")
def binary_files(spark, sf_dir):
    """Plain, with a NUL, with 3 % of control characters, and with one of them in 4,000."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    body = F.when(k == 0, name).when(k == 1, F.concat(name, F.expr("char(0)"))).when(k == 2, F.concat(F.repeat(F.lit("x"), 97), F.repeat(F.expr("char(1)"), 3))).otherwise(F.concat(F.repeat(F.lit("y"), 3999), F.expr("char(1)")))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.clearly_binary(body).alias("is_binary"))


@query(f"""WITH {PATHS} SELECT CASE p_partkey % 12 WHEN 0 THEN 'services' WHEN 1 THEN 'tests' WHEN 2 THEN 'web' WHEN 3 THEN 'util' WHEN 4 THEN 'data' WHEN 5 THEN 'config' WHEN 6 THEN 'keys' WHEN 7 THEN '..' WHEN 8 THEN 'app' WHEN 9 THEN 'docs' WHEN 10 THEN 'dist' ELSE 'root' END AS module, count(*) AS n FROM p GROUP BY 1""")
def module_groups(spark, sf_dir):
    return paths(spark, sf_dir).groupBy(S.module_of(F.col("path")).alias("module")).agg(F.count("*").alias("n"))


#: A path by an order's status: the path, its module, group, folder, tier and service.
PLACES = {
    "F": ("backend/src/main/java/com/acme/service/billing/Bill.java", "billing", "service", "backend/src/main/java/com/acme/service/billing", "Application / API", None),
    "O": ("services/shop/src/cart/index.ts", "cart", "services/shop", "services/shop/src/cart", "Unclassified", "services/shop"),
    "P": ("readme.md", "root", "root", "(root)", "Data definitions", None),
}


@query("SELECT path, module, grp, folder, tier, service, count(*) AS n FROM orders JOIN (VALUES " + ", ".join("('" + k + "', " + ", ".join("NULL" if x is None else f"'{x}'" for x in v) + ")" for k, v in PLACES.items()) + ") t(s, path, module, grp, folder, tier, service) ON o_orderstatus = s GROUP BY ALL")
def path_groups(spark, sf_dir):
    status, c = F.col("o_orderstatus"), F.col("path")
    path = F.when(status == "F", PLACES["F"][0]).when(status == "O", PLACES["O"][0]).otherwise(PLACES["P"][0])
    o = views.table(spark, sf_dir, "orders").select(path.alias("path"), F.when(status == "P", "model").otherwise("none").alias("layer"))
    made = {"path": c, "module": S.module_of(c), "grp": S.file_group(c), "folder": S.folder_of(c), "tier": S.tier(c, F.col("layer")), "service": S.service_candidate(c)}
    return o.select(*(v.alias(k) for k, v in made.items())).groupBy(*made).agg(F.count("*").alias("n"))


#: A function by an order's status, and whether its name is found fault with.
NAMED = {"F": ("a.py", "doThing", "", "def doThing(): pass", True), "O": ("B.java", "B", "B", "public B() {}", False), "P": ("c.jsx", "Panel", "", "function Panel() {}", False)}


@query("SELECT o_orderkey AS line, 'doThing' AS name, 'snake_case' AS expected FROM orders WHERE o_orderstatus = 'F'")
def naming_findings(spark, sf_dir):
    status = F.col("o_orderstatus")
    part = lambda k: F.when(status == "F", NAMED["F"][k]).when(status == "O", NAMED["O"][k]).otherwise(NAMED["P"][k])
    f = views.table(spark, sf_dir, "orders").select(part(0).alias("path"), part(1).alias("name"), F.col("o_orderkey").alias("line"), part(2).alias("class"), F.lit("function").alias("type"), part(3).alias("code"))
    return metrics.naming_findings(f).select("line", "name", "expected")


#: A function by an order's status, its language, and its lines, parameters, nesting, branches, cognitive weight and returns.
SHAPES = {
    "F": ("python", "def f(self, a, b):\n    # if not counted\n    for x in a:\n        if x and b:\n            return 'if'\n    return 0\n", (5, 2, 2, 4, 5, 2), ""),
    "O": ("javascript", "function g(a, b, c, d, e, f) {\n  return a;\n}", (3, 6, 0, 1, 0, 1), "params"),
    "P": ("javascript", "function h(x) {\n  if (x && y) {\n    return 1; // for while\n  }\n}", (5, 1, 1, 3, 2, 1), ""),
}


def shaped(spark, sf_dir):
    status = F.col("o_orderstatus")
    part = lambda k: F.when(status == "F", SHAPES["F"][k]).when(status == "O", SHAPES["O"][k]).otherwise(SHAPES["P"][k])
    f = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.lit("f").alias("name"), part(0).alias("language"), part(1).alias("code"))
    return metrics.maintainability(f)


FIGURES = ", ".join(f"CASE o_orderstatus WHEN 'F' THEN {SHAPES['F'][2][i]} WHEN 'O' THEN {SHAPES['O'][2][i]} ELSE {SHAPES['P'][2][i]} END AS {n}" for i, n in enumerate(("lines", "params", "nesting", "complexity", "cognitive", "returns")))


@query(f"SELECT 'o' || o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'python' ELSE 'javascript' END AS language, {FIGURES}, CASE o_orderstatus WHEN 'O' THEN 'params' ELSE '' END AS over FROM orders")
def function_shapes(spark, sf_dir):
    return shaped(spark, sf_dir).drop("name").withColumn("over", F.array_join("over", ","))


@query(f"""WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'python' ELSE 'javascript' END AS language, o_orderstatus = 'O' AS bad, {FIGURES} FROM orders)
SELECT language, count(*) AS n, round(avg(lines), 1) AS avg_lines, CAST(sum(complexity) AS BIGINT) AS complexity, count(*) FILTER (bad) AS n_over FROM s GROUP BY language""")
def shapes_by_language(spark, sf_dir):
    return metrics.by_language(shaped(spark, sf_dir))


@query("""WITH c AS (SELECT CASE event_type WHEN 'click' THEN 'dead' WHEN 'view' THEN 'cycle' WHEN 'purchase' THEN 'large' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1)
SELECT CASE kind WHEN 'cycle' THEN 1 WHEN 'dead' THEN 4 ELSE 5 END AS rank, CASE kind WHEN 'cycle' THEN 'Break dependency cycles' WHEN 'dead' THEN 'Remove functions that nothing calls' ELSE 'Divide large files' END AS title, n FROM c WHERE kind <> 'other' AND n >= CASE kind WHEN 'cycle' THEN 1 WHEN 'dead' THEN 10 ELSE 3 END""")
def suggestion_cards(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "click", "dead").when(t == "view", "cycle").when(t == "purchase", "large").otherwise("other")
    return metrics.suggestions(views.table(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")))


@query(union(
    f"SELECT {API} AS path, 'curl -X GET ''http://localhost:8080/nations/{{id}}/n' || k || '''' AS curl FROM {N}",
    f"SELECT {SRV}, 'curl -X POST ''http://localhost:8080/login/' || k || ''' -H ''Content-Type: application/json'' -d ''{{}}''' FROM {C}",
))
def endpoint_commands(spark, sf_dir):
    e = extract.facts(views.code(spark, sf_dir)).where("kind = 'endpoint'").select(F.col("path").alias("file"), F.col("owner").alias("method"), F.col("name").alias("path"), (F.col("detail") == "true").alias("auth"))
    return repository.curl(e).select(F.col("file").alias("path"), "curl")


@query(f"""SELECT '/login/' || k AS path, '{{"post":{{"summary":"POST /login/' || k || '","secured":false}}}}' AS operations FROM {C} UNION ALL SELECT '/nations/{{id}}/n' || k, '{{"get":{{"summary":"GET /nations/{{id}}/n' || k || '","secured":false}}}}' FROM {N}""")
def openapi(spark, sf_dir):
    e = extract.facts(views.code(spark, sf_dir)).where("kind = 'endpoint'").select(F.col("owner").alias("method"), F.col("name").alias("path"), (F.col("detail") == "true").alias("auth"))
    return repository.openapi_paths(e)


@query("""WITH f AS (SELECT event_id, event_type, 'f' || user_id || '.py' AS path, CAST(event_id % 40 AS INTEGER) AS line, CASE WHEN value > 80 THEN 'error' WHEN value > 30 THEN 'warning' ELSE 'note' END AS level FROM events)
SELECT '{"ruleId":"' || event_type || '","level":"' || level || '","message":{"text":"t' || event_id || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '"},"region":{"startLine":' || greatest(1, line) || '}}}]}' AS result FROM f""")
def sarif_results(spark, sf_dir):
    v = F.col("value")
    f = views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ruleId"), F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), (F.col("event_id") % 40).cast("int").alias("line"),
        F.when(v > 150, "critical").when(v > 80, "high").when(v > 30, "medium").otherwise("low").alias("severity"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"),
    )
    return repository.sarif(f)


@query("""WITH t AS (SELECT 'nation' || n_nationkey AS name, '  nation' || n_nationkey || ' {' || chr(10) || '    string id' || chr(10) || '    string region' || chr(10) || '  }' || chr(10) || '  region' || n_regionkey || ' ||--o{ nation' || n_nationkey || ' : region' AS t FROM nation)
SELECT 'erDiagram' || chr(10) || string_agg(t, chr(10) ORDER BY name) AS diagram FROM t""")
def er_diagram(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    link = F.struct(F.lit("region").alias("column"), name("region", "n_regionkey").alias("target"))
    return repository.mermaid_er(views.table(spark, sf_dir, "nation").select(name("nation", "n_nationkey").alias("name"), F.array(F.lit("id"), F.lit("region")).alias("columns"), F.array(link).alias("keys")))


@query("""SELECT 'u' || user_id AS id, max(ts) AS created_at FROM events GROUP BY user_id ORDER BY created_at DESC, id LIMIT 20 OFFSET 20""")
def recent_page(spark, sf_dir):
    r = views.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id")).agg(F.max("ts").alias("created_at"), F.lit("blob").alias("analysis_snapshot"))
    return repository.page(r, 20, 20)


#: Lines of a file by an order's status, and the guard that they hold: line, outcome, score.
GUARDS = {"F": "if total > limit:\n  raise ValueError\n", "O": "if cache:\n  log()\n  status = 'done'\n", "P": "while x:\n  throw y\n"}


@query("""SELECT 'o' || o_orderkey AS path, 1 AS line, CASE o_orderstatus WHEN 'F' THEN 'if total > limit:' ELSE 'if cache:' END AS guard, CASE o_orderstatus WHEN 'F' THEN 'refuse' ELSE 'transition' END AS outcome, CASE o_orderstatus WHEN 'F' THEN 3 ELSE 0 END AS score
FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def business_rules(spark, sf_dir):
    status = F.col("o_orderstatus")
    body = F.when(status == "F", GUARDS["F"]).when(status == "O", GUARDS["O"]).otherwise(GUARDS["P"])
    files = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), body.alias("content"))
    return model.business_rules(views.lines(files))


@query("""WITH p AS (SELECT a.p_partkey AS id, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT id, CASE WHEN a = b THEN true ELSE false END AS same FROM p""")
def similar_names(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    pairs = p.join(p.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return text.lcs_ratio(pairs).select("id", (F.col("ratio") == 1).alias("same"))
