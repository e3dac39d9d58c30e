"""Reading repositories and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.storage import stored


def read_repository(spark: SparkSession, root: str, repository: str) -> DataFrame:
    """repository, seq, path, content of all files below root, read whole by Spark from any store."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.substring_index("path", base.split("/")[-1] + "/", -1), "^/+", "") if base else F.col("path")
    rows = raw.select(F.lit(repository).alias("repository"), path.alias("path"), F.expr("decode(content, 'UTF-8')").alias("content"))
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("repository").orderBy("path")))


def ingest(files: DataFrame, path: str) -> None:
    """Replaces the repositories that files holds, and no others; a path twice in one is refused."""
    twice = files.groupBy("repository", "path").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate path {twice[0]['path']}")
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository").parquet(path)


def page(repositories: DataFrame, offset: int = 0, size: int = 20) -> DataFrame:
    """Recent repositories first, without their snapshots; 1 to 100 a page."""
    columns = [c for c in repositories.columns if c != "analysis_snapshot"]
    return repositories.select(*columns).orderBy(F.desc("created_at"), "id").offset(offset).limit(max(1, min(100, size)))


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF result (JSON) a finding: ruleId, path, line, severity, title."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    region = F.struct(F.greatest(F.lit(1), "line").alias("startLine"))
    place = F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region"))
    return findings.select(F.to_json(F.struct("ruleId", level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"))).alias("result"))


def mermaid_er(tables: DataFrame) -> DataFrame:
    """One row: an ER diagram of tables (name, columns array<string>, keys array<struct<column, target>>)."""
    head = F.concat(F.lit("  "), F.col("name"), F.lit(" {\n"), F.array_join(F.transform("columns", lambda c: F.concat(F.lit("    string "), c)), "\n"), F.lit("\n  }"))
    links = F.array_join(F.transform("keys", lambda k: F.concat(F.lit("  "), k["target"], F.lit(" ||--o{ "), F.col("name"), F.lit(" : "), k["column"])), "\n")
    body = tables.select("name", F.concat_ws("\n", head, F.when(F.size("keys") > 0, links)).alias("t"))
    rows = body.agg(F.sort_array(F.collect_list(F.struct("name", "t"))).alias("r"))
    return rows.select(F.concat(F.lit("erDiagram\n"), F.array_join(F.col("r.t"), "\n")).alias("diagram"))


def curl(endpoints: DataFrame, host: str = "http://localhost:8080") -> DataFrame:
    """endpoints with a command line for each."""
    body = F.when(F.col("method").isin("POST", "PUT", "PATCH"), " -H 'Content-Type: application/json' -d '{}'").otherwise("")
    auth = F.when(F.col("auth"), " -H 'Authorization: Bearer <token>'").otherwise("")
    return endpoints.withColumn("curl", F.concat(F.lit("curl -X "), F.col("method"), F.lit(f" '{host}"), F.col("path"), F.lit("'"), auth, body))


def openapi_paths(endpoints: DataFrame) -> DataFrame:
    """path, operations: an OpenAPI path item (JSON) by method."""
    item = F.struct(F.lower("method").alias("key"), F.struct(F.concat_ws(" ", "method", "path").alias("summary"), F.col("auth").alias("secured")).alias("value"))
    by = endpoints.groupBy("path").agg(F.array_sort(F.collect_set(item)).alias("items"))
    return by.select("path", F.to_json(F.map_from_entries("items")).alias("operations"))


def unified_model(files: DataFrame, facts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, kind, name, path, line) and edges (id, type, source, target, resolution) under stable ids."""
    from tessera.functions.scalars import fnv1a

    ident = lambda kind, *c: F.concat(F.lit(f"{kind}:"), fnv1a(F.concat_ws("|", *c)))
    whole = files.select(ident("file", F.col("path")).alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), "path", F.lit(1).alias("line"))
    parts = facts.where("kind IN ('function', 'class', 'endpoint', 'table', 'dependency')").select(
        F.concat(F.col("kind"), F.lit(":"), fnv1a(F.concat_ws("|", "kind", "path", "name", F.col("line").cast("string")))).alias("id"), "kind", "name", "path", "line"
    )
    links = edges.select(ident("edge", F.col("type"), F.col("source"), F.col("target"), F.col("line").cast("string"), F.col("resolution")).alias("id"), "type", ident("file", F.col("source")).alias("source"), ident("file", F.col("target")).alias("target"), "resolution")
    return whole.unionByName(parts).dropDuplicates(["id"]), links.dropDuplicates(["id"])


def read_back(repositories: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """id, snapshot: the JSON that was stored, as it is; where none is, one made from the tables. files and edges have a
    repository; a snapshot is one string, so a repository's rows meet in it."""
    f = files.groupBy(F.col("repository").alias("id")).agg(F.array_sort(F.collect_list(F.struct("path", F.col("content")))).alias("files"))
    e = edges.groupBy(F.col("repository").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source", "target", "type"))).alias("dependencies"))
    bare = repositories.where("analysis_snapshot IS NULL").select("id").join(f, "id", "left").join(e, "id", "left")
    made = bare.select("id", F.to_json(F.struct(F.coalesce("files", F.array().cast("array<struct<path:string,content:string>>")).alias("files"), F.coalesce("dependencies", F.array().cast("array<struct<source:string,target:string,type:string>>")).alias("dependencies"))).alias("made"))
    return repositories.join(made, "id", "left").select("id", F.coalesce("analysis_snapshot", "made").alias("snapshot"))


def remove(spark: SparkSession, path: str, repository: str) -> bool:
    """Deletes a repository's partition of a table that ingest() writes; False if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/repository={repository}")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_index(chunks: DataFrame, path: str) -> None:
    """Replaces the chunks of the repositories that these are of. chunks: repository, path, content, embedding, model, ..."""
    chunks.where("trim(content) <> ''").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository").parquet(path)


def analysis_json(analysis: DataFrame) -> DataFrame:
    """One JSON a row of analysis, without the contents of files (fileContents, and content within files)."""
    fields = []
    for f in analysis.schema.fields:
        if f.name == "files" and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            fields.append(F.transform("files", lambda x: x.dropFields("content")).alias("files"))
        elif f.name != "fileContents":
            fields.append(F.col(f"`{f.name}`"))
    return analysis.select(F.to_json(F.struct(*fields)).alias("json"))


def source_export(files: DataFrame) -> DataFrame:
    """path, content of files under canonical paths (forward slashes, no dot segments at the front), the first of each by seq."""
    path = F.regexp_replace(F.regexp_replace(F.translate("path", "\\", "/"), "/{2,}", "/"), r"^(\./|/)+", "")
    return files.groupBy(path.alias("path")).agg(F.min_by("content", "seq").alias("content"))


def with_cache(files: DataFrame, cache: DataFrame, extract) -> DataFrame:
    """path, key and the facts of all files: from the cache (key, path, facts...) where a file of that path and content was
    read before, else from extract(files). key is the SHA-256 of the content."""
    keyed = files.withColumn("key", F.sha2(F.coalesce("content", F.lit("")), 256))
    seen = cache.select("path", "key").distinct()
    old = cache.join(keyed.select("path", "key"), ["path", "key"], "left_semi")
    new = extract(keyed.join(seen, ["path", "key"], "left_anti").drop("key")).join(keyed.select("path", "key"), "path")
    return old.unionByName(new.select(*old.columns))


def postman_items(endpoints: DataFrame) -> DataFrame:
    """One collection item (JSON) an endpoint: method, path, auth; parameters as :name."""
    url = F.concat(F.lit("{{baseUrl}}"), F.regexp_replace("path", r"\{(\w+)\}|<(?:\w+:)?(\w+)>", ":$1$2"))
    header = F.when(F.col("auth"), F.array(F.struct(F.lit("Authorization").alias("key"), F.lit("Bearer {{token}}").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    request = F.struct("method", header.alias("header"), url.alias("url"))
    return endpoints.select(F.to_json(F.struct(F.concat_ws(" ", "method", "path").alias("name"), request.alias("request"))).alias("item"))


def sarif_log(findings: DataFrame) -> DataFrame:
    """seq, line: the lines of one SARIF 2.1.0 document, in order of seq, to be written as text. Results stay spread: a line
    before the first one opens the document, and each result but the first by id starts with a comma."""
    body = stored(sarif(findings).select(F.monotonically_increasing_id().alias("n"), "result"), "sarif")
    first = body.agg(F.min("n")).first()[0]
    rows = body.select((F.col("n") + 1).alias("seq"), F.concat(F.when(F.col("n") == F.lit(first), "").otherwise(","), F.col("result")).alias("line"))
    rules = findings.groupBy("ruleId").agg(F.lit(1)).select(F.struct(F.col("ruleId").alias("id")).alias("r")).agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("rules"))
    head = F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"tessera","rules":'), F.col("rules"), F.lit('}},"results":['))
    ends = findings.sparkSession.range(1).select(F.lit(2**62).alias("seq"), F.lit("]}]}").alias("line"))
    return rules.select(F.lit(0).cast("long").alias("seq"), head.alias("line")).union(rows).union(ends)
