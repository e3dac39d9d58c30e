"""From clients to routes, from routes to handlers, and along calls from there; who calls a function, and which tests do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import contract_path, source_class
from tessera.operators.graph import bounded_bfs
from tessera.plans.storage import stored

NEAR, DEPTH, MOST_STEPS = 10, 6, 120


def key_of(found: DataFrame) -> DataFrame:
    """path, name, line, end_line, key of every function."""
    return found.where("kind = 'function'").select("path", "name", "line", "end_line", F.concat_ws("|", "path", "line", "name").alias("key"))


def client_calls(found: DataFrame) -> DataFrame:
    """call, method, path of what clients send, as contracts; call: file and line."""
    return found.where("kind = 'client'").select(F.concat_ws("|", "path", "line").alias("call"), F.col("owner").alias("method"), contract_path(F.col("name")).alias("path"))


def server_routes(found: DataFrame) -> DataFrame:
    """route, method, path of all endpoints, as contracts; route: file and line."""
    return found.where("kind = 'endpoint'").select(F.concat_ws("|", "path", "line", "owner").alias("route"), F.col("owner").alias("method"), contract_path(F.col("name")).alias("path"))


def handlers(files: DataFrame, found: DataFrame) -> DataFrame:
    """method, route, path, line, handler, basis of every endpoint.

    Where routes are registered by calls, the handler is the one function in the file of the name that is passed. Elsewhere it is
    the shortest function around the route, if no other is as short; else the next one within NEAR lines, if only blank
    lines, comments and decorators stand between.
    """
    e = found.where("kind = 'endpoint'").select("path", "line", F.col("owner").alias("method"), F.col("name").alias("route"), F.col("mode").alias("framework")).distinct()
    f, registered = key_of(found), F.col("framework").isin("express", "fastify", "koa")
    given = found.where("kind = 'route-handler'").select("path", "line", "name")
    one = f.groupBy("path", "name").agg(F.count("*").alias("n"), F.min("key").alias("handler")).where("n = 1")
    named = e.where(registered).join(given, ["path", "line"]).join(one, ["path", "name"]).select("path", "line", "method", "route", "handler", F.lit("named-argument").alias("basis"))

    near = e.where(~registered).join(f.select("path", "key", F.col("line").alias("start"), F.col("end_line").alias("end")), "path")
    around = near.where("start <= line AND line <= end AND end > start").withColumn("size", F.col("end") - F.col("start"))
    order = ["path", "line", "method", "route"]
    least = around.groupBy(*order).agg(F.min(F.struct("size", "key")).alias("a"), F.min("size").alias("size"))
    tied = around.groupBy(*order, "size").agg(F.count("*").alias("n"))
    within = least.join(tied, [*order, "size"]).where("n = 1").select(*order, F.col("a.key").alias("handler"), F.lit("around").alias("basis"))

    after = near.where(f"start > line AND start - line <= {NEAR}").join(files.select("path", F.split("content", "\n").alias("lines")), "path")
    between = F.slice("lines", F.col("line") + 1, F.col("start") - F.col("line") - 1)
    after = after.where(F.forall(between, lambda t: t.rlike(r"^\s*($|#|//|@)"))).join(within.select(*order), order, "left_anti")
    nearest = after.groupBy(*order).agg(F.min(F.struct("start", "key")).alias("a")).select(*order, F.col("a.key").alias("handler"), F.lit("next").alias("basis"))
    return e.select(*order).join(named.unionByName(within).unionByName(nearest), order, "left").withColumn("basis", F.coalesce("basis", F.lit("unresolved")))


def steps_of(calls: DataFrame) -> DataFrame:
    """source, target of resolved calls between functions."""
    return calls.where("resolution = 'resolved' AND caller IS NOT NULL").select(F.col("caller").alias("source"), "target").where("source <> target").distinct()


def endpoint_flows(handled: DataFrame, calls: DataFrame, depth: int = DEPTH, most: int = MOST_STEPS) -> DataFrame:
    """handler, function, hops, status of what each handler reaches by resolved calls, its first `most` steps; bounded where
    there is more."""
    edges = stored(steps_of(calls), "calls")
    reach = stored(bounded_bfs(edges, handled.where("handler IS NOT NULL").select(F.col("handler").alias("node")), depth), "flows")
    ends = reach.where(F.col("distance") == depth).join(edges.select(F.col("source").alias("node")).distinct(), "node", "left_semi").select("seed").distinct().withColumn("deeper", F.lit(True))
    sizes = reach.groupBy("seed").agg((F.count("*") - 1 > most).alias("wide"))
    rank = F.row_number().over(W.partitionBy("seed").orderBy("distance", "node"))
    kept = reach.withColumn("n", rank).where(F.col("n") <= most + 1).join(sizes, "seed").join(ends, "seed", "left")
    status = F.when(F.col("wide") | F.coalesce("deeper", F.lit(False)), "bounded-static-path").otherwise("static-path")
    return kept.select(F.col("seed").alias("handler"), F.col("node").alias("function"), F.col("distance").alias("hops"), status.alias("status"))


def caller_impact(calls: DataFrame, changed: DataFrame, most: int | None = None) -> DataFrame:
    """function, hops, relationship, via (functions from the changed one on), status: all who call the changed functions, by
    resolved calls; of paths of least length the first by name. With `most` that many callers, the nearest, as partial if there are more."""
    back = stored(steps_of(calls).select(F.col("target").alias("a"), F.col("source").alias("b")), "callers")
    level = changed.select("function").distinct().select("function", F.lit(0).alias("hops"), F.array("function").alias("via"))
    seen, hops = stored(level, "callers"), 0
    level = seen
    while True:
        hops += 1
        ends = level.join(back, F.col("function") == F.col("a")).groupBy("b").agg(F.min("via").alias("via"))
        new = ends.join(seen.select(F.col("function").alias("b")), "b", "left_anti")
        level = stored(new.select(F.col("b").alias("function"), F.lit(hops).alias("hops"), F.array_append("via", F.col("b")).alias("via")), "callers")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    kind = F.when(F.col("hops") == 1, "direct-caller").otherwise("transitive-caller")
    out, status = seen.where("hops > 0").select("function", "hops", kind.alias("relationship"), "via"), "complete"
    if most is not None:
        status = "partial" if out.count() > most else "complete"
        out = out.orderBy("hops", "function").limit(most)
    return out.withColumn("status", F.lit(status))


def test_function_links(calls: DataFrame) -> DataFrame:
    """function, test, n: functions outside of tests that a test file calls, and how many call sites there do."""
    of = F.substring_index("target", "|", 1)
    is_test = lambda path: source_class(path) == "test-or-fixture"
    used = calls.where("resolution = 'resolved'").withColumn("file", of).where(is_test(F.col("path")) & ~is_test(F.col("file")))
    return used.groupBy(F.col("target").alias("function"), F.col("path").alias("test")).agg(F.count("*").alias("n"))


def error_handling(flows: DataFrame, files: DataFrame) -> DataFrame:
    """start, n_hops, n_handled, pct of flows (start, hop, path): the share of hops whose file handles errors anywhere."""
    handled = files.select("path", F.col("content").rlike(r"\b(try|catch|except|rescue)\b").alias("handled"))
    hops = flows.join(handled, "path", "left").groupBy("start").agg(F.count("*").alias("n_hops"), F.count_if(F.coalesce("handled", F.lit(False))).alias("n_handled"))
    return hops.withColumn("pct", F.round(F.col("n_handled") * 100 / F.col("n_hops")).cast("int"))


def engineering_impact(edges: DataFrame, changed: DataFrame, rules: DataFrame, depth: int = 5, most: int | None = None) -> DataFrame:
    """node, hops, rules, status: what depends on the changed nodes by sure edges, with the business rules (node, rule) of each. With
    `most` that many nodes are kept besides the changed ones, the nearest, as partial if there are more."""
    sure = edges.where("resolution NOT IN ('ambiguous', 'unresolved')")
    kept = stored(bounded_bfs(sure, changed, depth, "in").groupBy("node").agg(F.min("distance").alias("hops")), "impact")
    status = "complete"
    if most is not None:
        status = "partial" if kept.where("hops > 0").count() > most else "complete"
        kept = kept.orderBy("hops", "node").limit(most + changed.select("node").distinct().count())
    by = rules.join(kept.select("node"), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return kept.join(by, "node", "left").select("node", "hops", F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), F.lit(status).alias("status"))
