"""Queries over file contents and paths."""

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import text as ops
from tessera.plans.registry import registry
from tessera.sources import views

QUERIES, ORACLES, query = registry()

PATHS = """p AS (SELECT *, CASE p_partkey % 12 WHEN 0 THEN 'src/services/A' || p_partkey || '.java' WHEN 1 THEN 'tests/test_' || p_partkey || '.py' WHEN 2 THEN 'web/components/B' || p_partkey || '.tsx' WHEN 3 THEN 'lib/util/helper' || p_partkey || '.js'
  WHEN 4 THEN 'data/model_' || p_partkey || '.py' WHEN 5 THEN 'config/settings.py' WHEN 6 THEN 'keys/private' || p_partkey || '.pem' WHEN 7 THEN '../up' || p_partkey || '.js' WHEN 8 THEN 'app/user_repository' || p_partkey || '.py' WHEN 9 THEN 'docs/x' || p_partkey || '.md' WHEN 10 THEN 'dist/b' || p_partkey || '.js' ELSE 'main' || p_partkey || '.go' END AS path FROM part)"""


def paths(spark, sf_dir):
    k, name = F.col("p_partkey") % 12, F.col("p_partkey").cast("string")
    shapes = ["src/services/A{}.java", "tests/test_{}.py", "web/components/B{}.tsx", "lib/util/helper{}.js", "data/model_{}.py", "config/settings.py", "keys/private{}.pem", "../up{}.js", "app/user_repository{}.py", "docs/x{}.md", "dist/b{}.js", "main{}.go"]
    out = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        out = F.when(k == i, F.concat(F.lit(shape.split("{}")[0]), *([name, F.lit(shape.split("{}")[1])] if "{}" in shape else []))).otherwise(out)
    return views.table(spark, sf_dir, "part").withColumn("path", out)


@query(f"""WITH {PATHS} SELECT CASE p_partkey % 12 WHEN 0 THEN 'services' WHEN 1 THEN 'test' WHEN 2 THEN 'components' WHEN 3 THEN 'utils' WHEN 4 THEN 'data' WHEN 5 THEN 'config' ELSE 'other' END AS layer,
  CASE p_partkey % 12 WHEN 1 THEN 'test-or-fixture' WHEN 9 THEN 'example' WHEN 10 THEN 'generated-or-vendor' ELSE 'application' END AS class, p_partkey % 12 = 6 AS sensitive, p_partkey % 12 <> 7 AS valid, split_part(regexp_replace(path, '^src/', ''), '/', 1) AS top, count(*) AS n
FROM p GROUP BY ALL""")
def path_classes(spark, sf_dir):
    p = paths(spark, sf_dir)
    return p.groupBy(S.layer(F.col("path")).alias("layer"), S.source_class(F.col("path")).alias("class"), S.sensitive_path(F.col("path")).alias("sensitive"), S.valid_path(F.col("path")).alias("valid"), F.substring_index(F.regexp_replace("path", "^src/", ""), "/", 1).alias("top")).agg(F.count("*").alias("n"))


@query(f"""WITH {PATHS} SELECT CASE WHEN p_partkey % 12 = 1 THEN 'Test' WHEN p_size > 45 THEN 'Service' WHEN p_partkey % 12 = 3 THEN 'Util' WHEN p_partkey % 12 = 4 THEN 'Entity/Model' WHEN p_partkey % 12 = 5 THEN 'Config' WHEN p_partkey % 12 = 8 THEN 'Repository' ELSE 'Other' END AS role,
  CASE WHEN p_partkey % 12 = 1 OR p_size > 45 THEN 'FACT' WHEN p_partkey % 12 IN (3, 4, 5, 8) THEN 'INFERENCE' ELSE 'UNCERTAIN' END AS confidence, count(*) AS n FROM p GROUP BY 1, 2""")
def file_roles(spark, sf_dir):
    content = F.when(F.col("p_size") > 45, "@Service class X").otherwise("plain")
    r = paths(spark, sf_dir).select(S.file_role(F.col("path"), content).alias("r"))
    return r.groupBy("r.role", "r.confidence").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '[?#].*$', '') AS p FROM pages) SELECT CASE WHEN regexp_replace(p, '/+$', '') = '' THEN '/' ELSE regexp_replace(p, '/+$', '') END AS path, count(*) AS n FROM x GROUP BY 1""")
def contract_paths(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").groupBy(S.contract_path(F.col("url")).alias("path")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT source AS repository, doc_id AS seq, source || '/' || (doc_id % 900) || '.txt' AS path, text FROM documents), x AS (SELECT *, row_number() OVER (PARTITION BY repository, path ORDER BY seq) AS n FROM d)
SELECT repository, coalesce(CASE WHEN n > 1 THEN 'duplicate-path' END, 'taken') AS reason, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM x GROUP BY 1, 2""")
def prepare_files(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.col("source").alias("repository"), F.col("doc_id").alias("seq"), F.concat(F.col("source"), F.lit("/"), (F.col("doc_id") % 900).cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return ops.prepared(d).groupBy("repository", F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count("*").alias("files"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


NOTES = [("secret", r"(?i)\b(password|secret|api[_-]?key|token)\s*[=:]"), ("mail", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), ("licence", "License"), ("address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b")]
CASES = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in NOTES)
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


@query(f"""WITH {LINES} SELECT * FROM (SELECT doc_id, CAST(line AS INTEGER) AS line, CASE {CASES} END AS rule FROM l) WHERE rule IS NOT NULL""")
def line_rules(spark, sf_dir):
    f = views.table(spark, sf_dir, "documents")
    return ops.scan(views.lines(f, "doc_id", "text"), NOTES, "doc_id")


@query("""SELECT page_id, len(regexp_extract_all(html, '<img\\b')) AS images, len(regexp_extract_all(html, '\\balt=')) AS alts, len(regexp_extract_all(html, '<script\\b')) AS scripts FROM pages""")
def page_checks(spark, sf_dir):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return views.table(spark, sf_dir, "pages").select("page_id", n(r"<img\b").alias("images"), n(r"\balt=").alias("alts"), n(r"<script\b").alias("scripts"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)\bBearer\s+[A-Za-z0-9_.~+/-]{10,}={0,2}')) AS bearer, len(regexp_extract_all(text, '\b(?:sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|AIza[0-9A-Za-z_-]{25,}|AKIA[0-9A-Z]{16})\b')) AS tokens FROM documents""")
def redaction_counts(spark, sf_dir):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return views.table(spark, sf_dir, "documents").select("doc_id", n(ops.BEARER).alias("bearer"), n(ops.TOKENS).alias("tokens"))


@query()
def redacted_text(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(ops.redacted(F.col("text")).cast("binary"), 256).alias("sha256"))


@query("""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: x <> '') AS t FROM documents), s0 AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(list_slice(t, i, i + 4), ' ')))) AS s FROM t WHERE len(t) >= 5),
s AS (SELECT min(id) AS id, s FROM s0 GROUP BY s), p AS (SELECT id, unnest(s) AS h FROM s), r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1), m AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM p x JOIN p y ON x.h = y.h AND x.id < y.id WHERE x.h IN (SELECT h FROM r) GROUP BY 1, 2),
j AS (SELECT a, b, i, len(x.s) AS n, len(y.s) AS k FROM m JOIN s x ON a = x.id JOIN s y ON b = y.id) SELECT a, b, round(i::DOUBLE / (n + k - i), 4) AS similarity FROM j WHERE round(i::DOUBLE / (n + k - i), 4) >= 0.82""")
def clone_pairs(spark, sf_dir):
    return ops.clone_pairs(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code")))


@query(r"""WITH c AS (SELECT source AS file, regexp_replace(text, '[A-Za-z_]\w*', 'I', 'g') AS c, text FROM documents),
k AS (SELECT file, len(regexp_extract_all(c, '\?')) || ':' || len(regexp_extract_all(c, 'I\(')) || ':' || CAST(floor(length(c) / 50) AS BIGINT) AS fingerprint FROM c)
SELECT fingerprint, count(*) AS n, count(DISTINCT file) AS n_files FROM k GROUP BY fingerprint HAVING count(DISTINCT file) > 1""")
def duplicate_groups(spark, sf_dir):
    return ops.fingerprint_groups(views.table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("text").alias("code")))


@query(f"""WITH c AS (SELECT conv_id, role, {" OR ".join(f"regexp_matches(coalesce(text, ''), '{p}')" for p in S.INJECTIONS)} AS bad FROM conversations) SELECT conv_id, count(*) FILTER (bad AND role = 'user') AS flagged, count(*) AS n FROM c GROUP BY conv_id""")
def guardrails(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count_if(S.injection(F.col("text")) & (F.col("role") == "user")).alias("flagged"), F.count("*").alias("n"))


@query("""WITH w AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')) AS s, regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g') AS c FROM part)
SELECT p_partkey, regexp_full_match(s, '_{0,2}[a-z][a-z0-9_]*') AS snake, regexp_full_match(c, '_?[a-z][a-zA-Z0-9]*') AS camel FROM w""")
def naming(spark, sf_dir):
    w = views.table(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_")).alias("s"), F.regexp_replace("p_name", "[^A-Za-z0-9]+", "").alias("c"))
    return w.select("p_partkey", S.snake_case(F.col("s")).alias("snake"), S.camel_case(F.col("c")).alias("camel"))


@query("""WITH p AS (SELECT lang || '/' || source || '/' || (doc_id % 20) AS path, n_chars FROM documents), x AS (SELECT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS folder, n_chars FROM p) SELECT folder, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM x GROUP BY folder""")
def file_tree(spark, sf_dir):
    p = views.table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", (F.col("doc_id") % 20).cast("string")).alias("path"), "n_chars")
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    return p.select(F.explode(folders).alias("folder"), "n_chars").groupBy("folder").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, line, length(text) > 80 AS fn, lag(starts_with(text, 'Licensed') OR length(text) < 40) OVER (PARTITION BY doc_id ORDER BY line) AS doc FROM l)
SELECT doc_id, count(*) FILTER (fn) AS functions, count(*) FILTER (fn AND doc) AS documented FROM k GROUP BY doc_id""")
def doc_coverage(spark, sf_dir):
    from pyspark.sql import Window as W

    l = views.lines(views.table(spark, sf_dir, "documents"), "doc_id", "text")  # noqa: E741
    doc = F.lag(F.startswith("text", F.lit("Licensed")) | (F.length("text") < 40)).over(W.partitionBy("doc_id").orderBy("line"))
    k = l.select("doc_id", (F.length("text") > 80).alias("fn"), doc.alias("doc"))
    return k.groupBy("doc_id").agg(F.count_if("fn").alias("functions"), F.count_if(F.col("fn") & F.col("doc")).alias("documented"))


SECRET_LIST = ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in ops.SECRETS)


@query(f"""WITH {LINES} SELECT * FROM (SELECT doc_id, CAST(line AS INTEGER) AS line, unnest([{SECRET_LIST}]) AS title FROM l WHERE NOT regexp_matches(text, '{ops.SAMPLE}')) WHERE title IS NOT NULL""")
def advanced_secrets(spark, sf_dir):
    return ops.secrets(views.lines(views.table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
