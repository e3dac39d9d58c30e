"""Queries over jobs, budgets, stored analyses, chunks and hints."""

import uuid

from pyspark.sql import functions as F

from tessera.operators import extract, findings, retrieval, text
from tessera.plans.catalog_code import API, B, C, FIRST, JAVA, N, P, R, S, SRV, SUP, SVC, TEST, UTIL, WEB, extracted, union
from tessera.plans.registry import registry
from tessera.plans.storage import measured, shared_dir
from tessera.sources import cache, repository, revisions, views
from tessera.streaming import jobs

QUERIES, ORACLES, query = registry()

JOBS = """j AS (SELECT event_id AS id, user_id AS repository, CASE event_type WHEN 'view' THEN 'DELETE' ELSE 'INDEX' END AS operation, CASE event_id % 4 WHEN 0 THEN 'DEAD' WHEN 1 THEN 'RETRY' ELSE 'RUNNING' END AS status,
  CAST(event_id % 9 AS INTEGER) AS attempts, event_id % 3 AS revision FROM events), r AS (SELECT DISTINCT user_id AS id, user_id % 3 AS now FROM events WHERE user_id % 10 <> 0)"""


def queue(spark, sf_dir):
    e, k = views.table(spark, sf_dir, "events"), F.col("event_id") % 4
    j = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("repository"), F.when(F.col("event_type") == "view", "DELETE").otherwise("INDEX").alias("operation"),
        F.when(k == 0, "DEAD").when(k == 1, "RETRY").otherwise("RUNNING").alias("status"), (F.col("event_id") % 9).cast("int").alias("attempts"), (F.col("event_id") % 3).alias("revision"),
    )
    return j, e.where("user_id % 10 <> 0").select(F.col("user_id").alias("id"), (F.col("user_id") % 3).alias("revision")).distinct()


@query(f"""WITH {JOBS}, x AS (SELECT j.*, coalesce(operation = 'INDEX' AND status = 'DEAD' AND now = revision, false) AS replayed FROM j LEFT JOIN r ON j.repository = r.id)
SELECT id, CASE WHEN replayed THEN 'PENDING' ELSE status END AS status, CAST(CASE WHEN replayed THEN 0 ELSE attempts END AS INTEGER) AS attempts, replayed FROM x""")
def replay_dead(spark, sf_dir):
    return jobs.replay_dead(*queue(spark, sf_dir)).select("id", "status", "attempts", "replayed")


@query(f"""WITH {JOBS} SELECT j.id, CASE WHEN operation = 'INDEX' AND now = revision THEN 'index' WHEN operation = 'DELETE' AND now IS NULL THEN 'delete' ELSE 'skip' END AS action FROM j LEFT JOIN r ON j.repository = r.id""")
def job_dispatch(spark, sf_dir):
    return jobs.dispatched(*queue(spark, sf_dir)).select("id", "action")


@query()
def budget_log(spark, sf_dir):
    """A limiter an event type; every third event finishes or cancels the reservation of the event two before."""
    e, k = views.table(spark, sf_dir, "events"), F.col("event_id") % 3
    op = F.when(k < 2, "reserve").when(F.col("event_id") % 2 == 0, "finish").otherwise("cancel")
    ticket = F.when(k < 2, F.col("event_id")).otherwise(F.col("event_id") - 2)
    log = e.select(F.col("event_type").alias("limiter"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), op.alias("op"), ticket.alias("ticket"), F.round(F.col("value") * 1000).alias("tokens"))
    return jobs.budget_log(log)


@query("""WITH f AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type, event_id % 3 AS m, event_id % 2 AS g, user_id % 25 AS k FROM events)
SELECT id, 'quality.' || event_type AS "ruleId", 'quality' AS category, CASE m WHEN 0 THEN 'high' ELSE 'info' END AS severity, 'INFERENCE' AS confidence, 'detected' AS status, event_type AS title,
  CASE g WHEN 0 THEN 'api/n' ELSE 'n' END || k || '.py' AS path, CASE m WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 99 END AS start, CASE m WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 99 END AS "end",
  CASE m WHEN 0 THEN 'app = FastAPI()' WHEN 1 THEN '# from .decoy import nothing' END AS evidence, CASE WHEN m < 2 THEN 'api/n' || k || '.py' END AS source FROM f""")
@measured
def normalized_findings(spark, sf_dir):
    m, g, k = F.col("event_id") % 3, F.col("event_id") % 2, (F.col("user_id") % 25).cast("string")
    f = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.when(m == 0, "HIGH").when(m == 1, "odd").alias("severity"),
        F.concat(F.when(g == 0, "api/n").otherwise("n"), k, F.lit(".py")).alias("filePath"), F.when(m == 0, 3).when(m == 1, 4).otherwise(99).alias("lineNumber"),
    )
    return findings.normalized(f, views.code(spark, sf_dir))


@query(union(
    f"SELECT {API} AS path, 'get_n' || k AS name, 'Nation' || k AS class_name, 'api/util' || r || '.py' AS imports FROM {N}", f"SELECT {API}, 'run', 'Nation' || k, 'api/util' || r || '.py' FROM {N}",
    f"SELECT {TEST}, 'test_n' || k, NULL, {API} FROM {N}", f"SELECT {UTIL}, unnest(['helper' || k, '_unused' || k, 'pick' || k]), 'Base' || k, '' FROM {R}", f"SELECT {WEB}, 'nation' || k, NULL, '' FROM {N}",
    f"SELECT {SUP}, unnest(['supplier' || k, 'load' || k]), NULL, 'web/n' || r || '.js' FROM {S}", f"SELECT {JAVA}, 'run' || k, 'P' || k, 'src/main/java/app/svc/S' || r || '.java' FROM {P}",
    f"SELECT {SVC}, 'go' || k, 'S' || k, '' FROM {B}", f"SELECT {FIRST}, 'useRegion' || k, NULL, {WEB} FROM {R}", f"SELECT 'bad/r' || k || '.py', 'broken' || k, NULL, '' FROM {R}",
))
def chunk_metadata(spark, sf_dir):
    files, found = extracted(spark, sf_dir)
    of = lambda kind: found.where(F.col("kind") == kind).select("path", "name", "line")
    out = retrieval.chunk_metadata(of("function"), of("class"), extract.resolve_imports(files, found))
    return out.select("path", "name", "class_name", F.array_join("imports", ",").alias("imports"))


QUESTION = "What do n3.py and api/n1.py do, and who calls s2.js or private.pem?"


@query(f"SELECT path, contains(lower('{QUESTION}'), path) AS exact FROM (SELECT {API} AS path FROM {N} WHERE k IN (1, 3) UNION ALL SELECT {SUP} FROM {S} WHERE k = 2) ORDER BY exact DESC, path LIMIT 3")
def mentioned_files(spark, sf_dir):
    return retrieval.mentioned_files(views.code(spark, sf_dir), QUESTION)


#: Functions by an order's status.
BODIES = {
    "F": "f = open(p)\nread(f)\nf.close()", "O": "c = getConnection(x)\nif (ready) { go(); }\nif (!ready) { stop(); }", "P": "beginTransaction(); update();\nif (!db.ok) throw x\nif (db.ok) done()",
}


def bodies(spark, sf_dir):
    status = F.col("o_orderstatus")
    code = F.when(status == "F", BODIES["F"]).when(status == "O", BODIES["O"]).otherwise(BODIES["P"])
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), code.alias("code"))


@query("""SELECT o_orderkey AS id, o_orderstatus IN ('F', 'O') AS acquires, o_orderstatus = 'F' AS releases, false AS scoped, o_orderstatus = 'O' AS cleanup_gap, CASE WHEN o_orderstatus IN ('F', 'O') THEN 0 ELSE 1 END AS tx_starts, 0 AS tx_ends,
  o_orderstatus NOT IN ('F', 'O') AS tx_gap, CASE WHEN o_orderstatus IN ('F', 'O') THEN 0 ELSE 1 END AS throws, false AS catches FROM orders""")
def lifetime_hints(spark, sf_dir):
    return text.lifetime_hints(bodies(spark, sf_dir))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'ready' ELSE 'db.ok' END AS variable FROM orders WHERE o_orderstatus <> 'F'")
def opposite_guards(spark, sf_dir):
    return text.opposite_guards(bodies(spark, sf_dir))


@query("""WITH f AS (SELECT n_regionkey AS id, list({'path': 'n' || n_nationkey, 'content': n_name} ORDER BY 'n' || n_nationkey) AS files FROM nation GROUP BY 1),
e AS (SELECT n_regionkey AS id, list({'source': 's' || s_suppkey, 'target': 'n' || n_nationkey, 'type': 'import'} ORDER BY 's' || s_suppkey) AS dependencies FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN '{"kept": ' || r_regionkey || ' }' ELSE CAST(to_json({'files': files, 'dependencies': coalesce(dependencies, [])}) AS VARCHAR) END AS snapshot FROM region JOIN f ON f.id = r_regionkey LEFT JOIN e ON e.id = r_regionkey""")
def snapshot_read_back(spark, sf_dir):
    t = lambda n: views.table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    repos = t("region").select(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit('{"kept": '), F.col("r_regionkey").cast("string"), F.lit(" }"))).alias("analysis_snapshot"))
    files = t("nation").select(F.col("n_regionkey").alias("repository"), name("n", "n_nationkey").alias("path"), F.col("n_name").alias("content"))
    both = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    edges = both.select(F.col("n_regionkey").alias("repository"), name("s", "s_suppkey").alias("source"), name("n", "n_nationkey").alias("target"), F.lit("import").alias("type"))
    return repository.read_back(repos, files, edges)


@query("""SELECT n_regionkey AS id, CAST(to_json({'id': n_regionkey, 'files': list({'path': 'n' || n_nationkey, 'loc': n_nationkey} ORDER BY 'n' || n_nationkey)}) AS VARCHAR) AS json FROM nation GROUP BY n_regionkey""")
def analysis_json(spark, sf_dir):
    one = F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("content"), F.col("n_nationkey").alias("loc"))
    a = views.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("files"), F.lit("all").alias("fileContents"))
    out = repository.analysis_json(a)
    return out.select(F.get_json_object("json", "$.id").cast("int").alias("id"), "json")


@query("""SELECT 'src/p' || p_partkey || '.js' AS path, p_name AS content FROM part""")
def source_export(spark, sf_dir):
    p, name = views.table(spark, sf_dir, "part"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".js"))
    first = p.select(F.concat(F.lit("./src//"), name).alias("path"), F.col("p_name").alias("content"), F.lit(1).alias("seq"))
    return repository.source_export(first.union(p.select(F.concat(F.lit("src\\"), name), F.lit("later"), F.lit(2))))


@query(f"SELECT path, CASE kind WHEN 0 THEN -1 ELSE 9 END AS n_lines FROM (SELECT {SRV} AS path, k % 2 AS kind FROM {C})")
def cached_extraction(spark, sf_dir):
    """Even files were read before, at this content; odd ones at another."""
    files = views.code(spark, sf_dir).where("path LIKE 'srv/%'")
    even = F.regexp_extract("path", r"(\d+)\.js", 1).cast("long") % 2 == 0
    cache = files.select("path", F.sha2(F.when(even, F.col("content")).otherwise("old"), 256).alias("key"), F.lit(-1).alias("n_lines"))
    count = lambda new: new.select("path", F.regexp_count("content", F.lit("\n")).alias("n_lines"))
    return repository.with_cache(files, cache, count).select("path", "n_lines")


@query("""WITH u AS (SELECT user_id, event_type, event_id, CAST(floor(abs(value)) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events),
k AS (SELECT *, row_number() OVER w AS n, sum(coalesce(size, 0)) OVER w AS total FROM u WHERE r = 1 WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC))
SELECT user_id AS scope, event_type AS key, event_id AS at, size FROM k WHERE n <= 3 AND total <= 120""")
def cache_budget(spark, sf_dir):
    """Events read as uses of a user's cache."""
    uses = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("key"), F.col("event_id").alias("at"), F.floor(F.abs("value")).alias("size"))
    return cache.kept(uses, entries=3, budget=120)


@query("""SELECT source AS repository, CAST(2 AS INTEGER) AS revision, count(*) FILTER (lang = 'en') AS n_files, coalesce(sum(octet_length(encode(text))) FILTER (lang = 'en'), 0)::BIGINT AS n_bytes
FROM documents WHERE source IS NOT NULL GROUP BY source""")
def replaced_repositories(spark, sf_dir):
    """Documents read as files of their sources: all are committed, then all sources are replaced by their English ones."""
    d = views.files(spark, sf_dir).join(views.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repository")), "doc_id").where("repository IS NOT NULL").select("repository", "path", "content", "language")
    where = f"{shared_dir(spark)}/tessera-revisions-{uuid.uuid4().hex}"
    revisions.commit(d, where)
    revisions.commit(d.where("language = 'en'"), where, d.select("repository"))
    size = revisions.current(spark, where).groupBy("repository").agg(F.sum(F.octet_length("content")).alias("n_bytes"))
    return revisions.entries(spark, where).join(size, "repository", "left").select("repository", "revision", "n_files", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))
