"""The engine's fact tables as views over the given relational tables, and readers for real repositories."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source (importer), target (imported), type, resolution, line: parts on suppliers, those and customers on
    nations, nations on regions."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    parts = t("lineitem").groupBy(name("part", "l_partkey").alias("source"), name("supplier", "l_suppkey").alias("target")).agg(
        F.when(F.min("l_returnflag") == "A", "inferred").when(F.min("l_returnflag") == "N", "ambiguous").otherwise("resolved").alias("resolution"),
        F.min("l_linenumber").cast("int").alias("line"),
    )
    fixed = lambda df, s, d: df.select(s.alias("source"), d.alias("target"), F.lit("resolved").alias("resolution"), F.lit(1).alias("line"))
    out = (
        parts.select("source", "target", "resolution", "line")
        .union(fixed(t("supplier"), name("supplier", "s_suppkey"), name("nation", "s_nationkey")))
        .union(fixed(t("customer"), name("customer", "c_custkey"), name("nation", "c_nationkey")))
        .union(fixed(t("nation"), name("nation", "n_nationkey"), name("region", "n_regionkey")))
    )
    return out.withColumn("type", F.lit("import"))


def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: from a user to the user of the next event of that type; has cycles."""
    order = W.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.lead("user_id").over(order).alias("next"))
    return e.where("next IS NOT NULL AND user_id <> next").select(F.col("user_id").alias("source"), F.col("next").alias("target")).distinct()


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ruleId, path, line, severity, confidence, value, ts of events read as findings."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("ruleId"),
        F.concat(F.lit("src/m"), (F.col("user_id") % 7).cast("string"), F.lit("/f"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"),
        (F.col("event_id") % 40).cast("int").alias("line"),
        F.when(v > 150, "critical").when(v > 80, "high").when(v > 30, "medium").when(v > 10, "low").otherwise("info").alias("severity"),
        F.when(F.col("event_id") % 3 == 0, "FACT").when(F.col("event_id") % 3 == 1, "INFERENCE").otherwise("UNCERTAIN").alias("confidence"),
        "value", "ts",
    )


def lines(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, line (from 1), text of every line."""
    return files.select(key, F.posexplode(F.split(content, "\n")).alias("n", "text")).select(key, (F.col("n") + 1).alias("line"), "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, language of documents read as files."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"), F.col("lang").alias("language"), "doc_id",
    )


#: Templates of small source files made from rows; {k} is the row's key, {r} its parent's. path, content.
CODE = {
    "nation": (
        ("api/n{k}.py", "from fastapi import FastAPI\nfrom .util{r} import helper{r}\napp = FastAPI()\n# from .decoy import nothing\n@app.get('/nations/{id}/n{k}')\ndef get_n{k}(id):\n    return helper{r}(id) + helper{r}(1)\n\nclass Nation{k}(Base{r}):\n    def run(self):\n        return get_n{k}(2)\n"),
        ("web/n{k}.js", "export function nation{k}(x) {\n  return x;\n}\n"),
        ("tests/test_n{k}.py", "from api.n{k} import get_n{k}\n\ndef test_n{k}():\n    assert get_n{k}(1)\n"),
        ("db/n{k}.sql", "CREATE TABLE nation{k} (id INT, name TEXT, region_id INT REFERENCES region{r});\n"),
    ),
    "region": (
        ("api/util{k}.py", "class Base{k}:\n    pass\n\ndef helper{k}(x):\n    return x\n\ndef _unused{k}():\n    return None\n\ndef pick{k}(x):\n    if x and x > 1:  # if or\n        return x\n    return 'for'\n"),
        ("web/index{k}.js", "export { nation{k} as first } from './n{k}';\nexport const useRegion{k} = () => null;\n"),
        ("db/r{k}.sql", "CREATE TABLE region{k} (id INT, name TEXT);\n"),
        ("pkg/r{k}/package.json", '{"dependencies": {"lib{k}": "^1.{k}"}, "devDependencies": {"vite": "5"}}'),
        ("pkg/r{k}/requirements.txt", "flask==2.{k}\n# none\nrequests>=2\n"),
        ("bad/r{k}.py", "def broken{k}(:\n  pass\n"),
    ),
    "supplier": (
        ("web/s{k}.js", "import { nation{r} } from './n{r}';\nexport function supplier{k}(x) {\n  return nation{r}(x);\n}\nexport function load{k}(id) {\n  return fetch(`/nations/${id}/n{r}`);\n}\n"),
    ),
    "part": (
        ("src/main/java/app/b{r}/P{k}.java", "package app.b{r};\nimport app.svc.S{r};\npublic class P{k} extends S{r} {\n  public void run{k}() {\n    go{r}();\n  }\n}\n"),
    ),
    "customer": (
        ("srv/c{k}.js", "router.post('/login/{k}', (req, res) => {\n  const q = req.body.q;\n  db.query(q);\n});\nbus.publish('topic.{r}');\ndb.run(\"SELECT * FROM nation{r}\");\nconst password = 'live-value-{k}';\n// eval(q)\nvar old = eval(q);\n"),
    ),
    "brand": (("src/main/java/app/svc/S{k}.java", "package app.svc;\npublic class S{k} {\n  public void go{k}() {\n  }\n}\n"),),
}
BRANDS = 25
#: Rows of keys from which a partition's files are made.
KEYS_A_PARTITION = 8_192


def spread(keys: DataFrame) -> DataFrame:
    """Rows of keys (k) dealt out by number. A million of them lie in a few MB, so in one or two tasks as they are read, but
    the texts made from them are a thousand times the work."""
    return keys.repartition(keys.count() // KEYS_A_PARTITION + 1, "k")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of source files made from all rows of nation, region, supplier, part and customer, whose facts the
    tables tell."""
    t = lambda n: table(spark, sf_dir, n)
    keys = {
        "nation": t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")),
        "region": t("region").select(F.col("r_regionkey").alias("k"), F.lit(0).alias("r")),
        "supplier": t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("r")),
        "part": t("part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % BRANDS).alias("r")),
        "customer": t("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("r")),
        "brand": spark.range(BRANDS).select(F.col("id").alias("k"), F.lit(0).alias("r")),
    }
    rows = functools.reduce(DataFrame.union, (df.select(F.lit(name).alias("of"), "k", "r") for name, df in keys.items()))
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{k}"), F.col("k").cast("string")), F.lit("{r}"), F.col("r").cast("string"))
    made = F.coalesce(*(F.when(F.col("of") == name, F.array(*(F.struct(fill(p).alias("path"), fill(c).alias("content")) for p, c in files_))) for name, files_ in CODE.items()))
    return spread(rows).select(F.explode(made).alias("f")).select("f.*")


#: Files whose inputs pass through calls, by the row's key: two calls to an operation, a clean argument in the tainted one's place, and
#: four calls. Names, decoys and empty lines differ by row; {k} is the key, {n} as many empty lines as its last digit.
FLOWS = (
    "function handle{k}(req, db) {{n}\n  const q = req.query.name;\n  const safe = 'req.query.x';\n  return first{k}(safe, q, db);\n}\nfunction first{k}(a, b, db) {\n  const c = `${b} and ${a}`;\n  return second{k}(c, db);\n}\nfunction second{k}(sql, db) {\n  db.query(sql);\n}\n",
    "function handle{k}(req, db) {{n}\n  const q = req.query.name;\n  return first{k}(q, 'x', db);\n}\nfunction first{k}(a, b, db) {\n  // const b = a;\n  return second{k}(b, db);\n}\nfunction second{k}(sql, db) {\n  db.query(sql);\n}\n",
    "function handle{k}(req) {{n}\n  one{k}(req.body.x);\n}\nfunction one{k}(a) {\n  two{k}(a);\n}\nfunction two{k}(a) {\n  three{k}(a);\n}\nfunction three{k}(a) {\n  four{k}(a);\n}\nfunction four{k}(a) {\n  eval(a);\n}\n",
)


def flow_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of a file of FLOWS for each row of customer and supplier."""
    key = lambda t, c, p: table(spark, sf_dir, t).select(F.col(c).alias("k"), F.lit(p).alias("p"))
    rows = spread(key("customer", "c_custkey", "flow/c").union(key("supplier", "s_suppkey", "flow/s")))
    body = F.get(F.array(*map(F.lit, FLOWS)), (F.col("k") % 3).cast("int"))
    filled = F.replace(F.replace(body, F.lit("{k}"), F.col("k").cast("string")), F.lit("{n}"), F.repeat(F.lit("\n"), (F.col("k") % 10).cast("int")))
    return rows.select(F.concat("p", F.col("k").cast("string"), F.lit(".js")).alias("path"), filled.alias("content"))


#: A workspace: packages that give their files by maps, a configuration inherited from above, classes with bases elsewhere. By nation,
#: region and supplier; {n} is as many empty lines as the key's last digit, {q} the key modulo 5. table, key, parent, path, content.
WORKSPACE = (
    ("nation", "n_nationkey", "n_regionkey", "ws/n{k}/package.json", '{"name": "@ws/n{k}", "exports": {".": {"types": "./none.d.ts", "import": "./src/index.js"}, "./api/*": "./src/*.js"}}'),
    ("nation", "n_nationkey", "n_regionkey", "ws/n{k}/tsconfig.json", '{"extends": "../tsconfig.base.json", /* own */ "compilerOptions": {}}'),
    ("nation", "n_nationkey", "n_regionkey", "ws/n{k}/src/index.ts", "export * from './base.js';\n"),
    ("nation", "n_nationkey", "n_regionkey", "ws/n{k}/src/base.ts", "{n}export class Base{k} {\n  keep(x) {\n    return x;\n  }\n  run(x) {\n    return this.keep(x);\n  }\n}\n"),
    ("region", "r_regionkey", "r_regionkey", "ws/shared/m{k}.ts", "{n}function inner{k}() {\n  return 1;\n}\nexport { inner{k} as mark };\n"),
    (
        "supplier", "s_suppkey", "s_nationkey", "ws/n{r}/app/s{k}.ts",
        "{n}import { Base{r} as Parent } from '@ws/n{r}';\nimport * as shared from '~/m{q}';\nimport { Base{r} } from '@ws/n{r}/api/base';\nexport class Own{k} extends Parent {\n  run(x: Base{r}) {\n    return super.run(x) + this.keep(x) + shared.mark();\n  }\n}\n"
        "const o = new Own{k}();\no.run(1);\no.keep(2);\nunknown.run(3);\nfunction use{k}(o: Base{r}) {\n  o.run(4); // o.keep(5)\n}\n",
    ),
)


def workspace_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of WORKSPACE for all rows of its tables, and of the configuration above them."""
    out = spark.range(1).select(F.lit("ws/tsconfig.base.json").alias("path"), F.lit('{"compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["./shared/*"]}}}').alias("content"))
    for name, key, parent, path, content in WORKSPACE:
        rows = table(spark, sf_dir, name).select(F.col(key).alias("k"), F.col(parent).alias("r"))
        marks = {"{k}": F.col("k").cast("string"), "{r}": F.col("r").cast("string"), "{q}": (F.col("k") % 5).cast("string"), "{n}": F.repeat(F.lit("\n"), (F.col("k") % 10).cast("int"))}
        fill = lambda s: functools.reduce(lambda c, m: F.replace(c, F.lit(m[0]), m[1]), marks.items(), F.lit(s))  # noqa: E731, B023
        out = out.union(rows.select(fill(path), fill(content)))
    return out
