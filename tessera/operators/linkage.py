"""Joining facts of different kinds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def config_keys(defined: DataFrame, referenced: DataFrame) -> DataFrame:
    """key, n_defined, n_referenced, status: used, unused (only defined) or undefined (only referenced)."""
    d, r = defined.groupBy("key").agg(F.count("*").alias("n_defined")), referenced.groupBy("key").agg(F.count("*").alias("n_referenced"))
    status = F.when(F.col("n_referenced").isNull(), "unused").when(F.col("n_defined").isNull(), "undefined").otherwise("used")
    return d.join(r, "key", "full_outer").select("key", status.alias("status"), F.coalesce("n_defined", F.lit(0)).alias("n_defined"), F.coalesce("n_referenced", F.lit(0)).alias("n_referenced"))


def message_links(publishers: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Each publisher's status: linked (one other file subscribes to its transport and channel), ambiguous, unmatched.

    Subscribing files are counted per channel, not joined out: what is needed is whether there is one besides the own.
    """
    known = subscribers.where("transport <> 'unknown'").groupBy("transport", "channel").agg(F.count_distinct("file").alias("n"), F.min("file").alias("lo"), F.max("file").alias("hi"))
    own = subscribers.where("transport <> 'unknown'").select("transport", "channel", "file").distinct().withColumn("own", F.lit(1))
    p = publishers.join(known, ["transport", "channel"], "left").join(own, ["transport", "channel", "file"], "left")
    others = F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))
    other = F.when(others == 1, F.when(F.col("lo") == F.col("file"), F.col("hi")).otherwise(F.col("lo")))
    status = F.when(others == 1, "linked").when(others > 1, "ambiguous").otherwise("unmatched")
    return p.select(*publishers.columns, status.alias("status"), other.alias("target"))


def unique_by_name(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """Uses joined to what is declared under their name in lower case, where only one is."""
    one = declared.groupBy(F.lower("name").alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("declared")).where("n = 1")
    return uses.join(one.select("k", "declared"), F.lower(F.col("name")) == F.col("k"), "left").drop("k")


def route_match(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """call, route, kind: exact (same method, same segments, :param on either side fits any), suffix (two segments or
    more from the end, best and unique) or method-mismatch. Candidates meet by segment count or by their last segment."""
    seg = lambda df, p: df.withColumn(f"{p}s", F.split(F.regexp_replace(F.col(f"{p}path"), "^/|/$", ""), "/")).withColumn(f"{p}n", F.size(f"{p}s"))
    c, r = seg(calls.select(F.col("call"), F.col("method").alias("cmethod"), F.col("path").alias("cpath")), "c"), seg(routes.select(F.col("route"), F.col("method").alias("rmethod"), F.col("path").alias("rpath")), "r")
    fits = lambda a, b: (a == b) | (a == ":param") | (b == ":param")
    # by count and first segment; those that start with a parameter are joined apart, by count alone
    first = lambda a: F.get(a, F.lit(0))
    wild_c, wild_r = first(F.col("cs")) == ":param", first(F.col("rs")) == ":param"
    met = c.where(~wild_c).join(r.where(~wild_r), (F.col("cn") == F.col("rn")) & (first(F.col("cs")) == first(F.col("rs"))))
    met = met.unionByName(c.where(wild_c).join(r, F.col("cn") == F.col("rn"))).unionByName(c.where(~wild_c).join(r.where(wild_r), F.col("cn") == F.col("rn")))
    same = met.where(F.forall(F.zip_with("cs", "rs", fits), lambda x: x))
    exact = same.groupBy("call").agg(
        F.count_if(F.col("cmethod") == F.col("rmethod")).alias("n"), F.min(F.when(F.col("cmethod") == F.col("rmethod"), F.col("route"))).alias("route"),
        F.count("*").alias("any_n"), F.min("route").alias("any_route"),
    )
    tail = lambda a: F.element_at(a, -1)
    common = F.aggregate(F.zip_with(F.reverse("cs"), F.reverse("rs"), lambda a, b: F.coalesce(fits(a, b), F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda z, ok: F.struct((z["n"] + (z["on"] & ok).cast("int")).alias("n"), (z["on"] & ok).alias("on")), lambda z: z["n"])
    near = c.where(tail("cs") != ":param").join(r.where(tail("rs") != ":param"), (tail("cs") == tail("rs")) & (F.col("cmethod") == F.col("rmethod"))).withColumn("common", common).where("common >= 2")
    best = near.withColumn("top", F.max("common").over(W.partitionBy("call"))).where("common = top").groupBy("call").agg(F.count("*").alias("m"), F.min("route").alias("suffix_route"))
    kind = F.when(F.col("n") >= 1, "exact").when(F.col("m") == 1, "suffix").when(F.col("any_n") == 1, "method-mismatch").otherwise("none")
    out = c.select("call").join(exact, "call", "left").join(best, "call", "left").withColumn("kind", kind)
    return out.select("call", "kind", F.when(F.col("kind") == "exact", F.col("route")).when(F.col("kind") == "suffix", F.col("suffix_route")).when(F.col("kind") == "method-mismatch", F.col("any_route")).alias("route"))


def swept(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over starts of spans and points, by key and place: each point with the shortest open span. The heap holds the open
    spans of one key; those that have ended go when they come to its top."""
    key, heap = None, []
    for batch in rows:
        points, spans = [], []
        for k, at, is_point, end, point, span in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                key, heap = k, []
            if not is_point:
                heapq.heappush(heap, (end - at, span, end))
                continue
            while heap and at is not None and heap[0][2] < at:
                heapq.heappop(heap)
            points.append(point)
            spans.append(heap[0][1] if heap and at is not None else None)
        yield pa.RecordBatch.from_arrays([pa.array(points, batch.schema.field("point").type), pa.array(spans, batch.schema.field("span").type)], names=["point", "span"])


def innermost(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """point and the shortest span of its key that holds it (ties: least span id). points: key, point, at; spans: key,
    span, start, end. Points and starts of spans are sorted together and swept once; no point meets all spans of its key.
    A point without key or place, or in no span, has none."""
    kind = {f.name: f.dataType for f in [*points.schema, *spans.schema]}
    none = lambda c: F.lit(None).cast(kind[c]).alias(c)
    p = points.select(F.col(key).alias("key"), F.col("at").cast("long"), F.lit(True).alias("is_point"), F.lit(None).cast("long").alias("end"), "point", none("span"))
    s = spans.where(F.col(key).isNotNull() & F.col("span").isNotNull() & (F.col("start") <= F.col("end")))
    s = s.select(F.col(key).alias("key"), F.col("start").cast("long").alias("at"), F.lit(False).alias("is_point"), F.col("end").cast("long"), none("point"), "span")
    both = s.unionByName(p).repartition("key").sortWithinPartitions("key", "at", "is_point")
    return both.mapInArrow(swept, T.StructType([T.StructField("point", kind["point"]), T.StructField("span", kind["span"])]))


def parent_links(spans: DataFrame) -> DataFrame:
    """trace, span, status: root, linked or orphan."""
    ids = spans.select("trace", F.col("span").alias("parent"), F.lit(1).alias("found")).distinct()
    status = F.when(F.col("parent").isNull(), "root").when(F.col("found").isNull(), "orphan").otherwise("linked")
    return spans.join(ids, ["trace", "parent"], "left").select("trace", "span", status.alias("status"))


def orphans(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """Tables that no foreign key leaves or reaches. keys: source, target."""
    used = keys.select(F.col("source").alias("name")).union(keys.select("target"))
    return tables.join(used, "name", "left_anti")


def collisions(routes: DataFrame) -> DataFrame:
    """method, path, n of routes declared at more than one place."""
    return routes.groupBy("method", "path").agg(F.count_distinct("file", "line").alias("n")).where("n > 1")


def merged_tables(found: DataFrame) -> DataFrame:
    """One row a table name in lower case: the first source's spelling, all columns and keys. found: name, ord, columns."""
    return found.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "ord").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns"))


def ranked_links(candidates: DataFrame) -> DataFrame:
    """The surest link of each test and source. candidates: test, source, how, rank (3 high)."""
    return candidates.groupBy("test", "source").agg(F.max("rank").alias("rank"), F.max_by("how", F.struct("rank", "how")).alias("how"))


#: Licences of well-known packages, and which licences are copyleft.
LICENCES = {
    "react": "MIT", "react-dom": "MIT", "vue": "MIT", "express": "MIT", "lodash": "MIT",
    "axios": "MIT", "flask": "BSD-3-Clause", "django": "BSD-3-Clause", "requests": "Apache-2.0",
    "numpy": "BSD-3-Clause", "pandas": "BSD-3-Clause", "spring-boot-starter": "Apache-2.0",
    "serde": "MIT OR Apache-2.0", "clap": "MIT OR Apache-2.0", "rails": "MIT", "phoenix": "MIT",
    "junit": "EPL-2.0", "mysql-connector-java": "GPL-2.0", "org.springframework:spring-core": "Apache-2.0",
}
COPYLEFT = "(?i)^(GPL|AGPL|LGPL|CC-BY-SA|MPL)"


def licence_class(packages: DataFrame) -> DataFrame:
    """Adds licence and class (copyleft, permissive, unknown) of packages: name."""
    known = F.create_map(*(F.lit(x) for kv in LICENCES.items() for x in kv))
    licence = F.coalesce(F.try_element_at(known, F.col("name")), F.try_element_at(known, F.element_at(F.split("name", ":"), -1)))
    kind = F.when(licence.isNull(), "unknown").when(licence.rlike(COPYLEFT), "copyleft").otherwise("permissive")
    return packages.select("*", F.coalesce(licence, F.lit("unknown")).alias("licence"), kind.alias("class"))


def usage(packages: DataFrame, imports: DataFrame, mappable: Column) -> DataFrame:
    """Adds used: true, false, or null where the package's import name can't be told."""
    seen = imports.select(F.regexp_replace(F.lower("name"), "[-_.]", "").alias("k")).distinct().withColumn("hit", F.lit(True))
    k = F.regexp_replace(F.lower(F.col("name")), "[-_.]", "")
    return packages.withColumn("k", k).join(seen, "k", "left").withColumn("used", F.when(mappable, F.coalesce("hit", F.lit(False)))).drop("k", "hit")


def unnamed(tables: DataFrame, files: DataFrame) -> DataFrame:
    """Of tables (name, path) those that no other file's text names as a word. Files give their distinct words once, so names
    meet them by an equi join."""
    words = files.select(F.col("path").alias("file"), F.explode(F.array_distinct(F.split("content", r"\W+"))).alias("name"))
    used = tables.join(words, "name").where("path <> file").select("name", "path").distinct()
    return tables.join(used, ["name", "path"], "left_anti")
