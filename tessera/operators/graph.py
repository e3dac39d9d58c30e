"""Bounded traversals and structure of dependency graphs. Edges point from importer (source) to imported (target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.plans.storage import stored


def edge_rank() -> Column:
    return F.when(F.col("resolution") == "resolved", 3).when(F.col("resolution") == "inferred", 2).otherwise(1)



def arcs(edges: DataFrame, direction: str) -> DataFrame:
    """a, b of steps a -> b, without self-loops. direction: out, in (reverse) or both."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    steps = {"out": out, "in": back, "both": out.union(back)}[direction]
    return steps.where("a <> b").distinct()


def bounded_bfs(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """seed, node, distance (0 for the seed) within `depth` hops, of all seeds at once.

    A round joins the frontier with the edges and drops what is known; rounds are written to the shared folder, so
    plans stay short, and end when nothing is new.
    """
    steps = stored(arcs(edges, direction), "arcs") if depth > 2 else arcs(edges, direction)
    seen = stored(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("distance", F.lit(0)), "bfs")
    for d in range(1, depth + 1):
        ends = seen.where(F.col("distance") == d - 1).join(steps, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        new = stored(ends.join(seen, ["seed", "node"], "left_anti").withColumn("distance", F.lit(d)), "bfs")
        if new.isEmpty():
            break
        seen = seen.union(new)
    return seen


def change_impact(edges: DataFrame, changed: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """node, distance, confidence, via, status of what depends on the changed nodes, by resolved and inferred edges.

    A path is as sure as its weakest edge; of paths of least depth the surest counts (ties: the first by name), and via is its
    nodes from the changed one on. With `most` the nearest nodes are kept, as partial if there are more.
    """
    used = edges.where(F.col("resolution").isin("resolved", "inferred") & (F.col("source") != F.col("target")))
    back = used.select(F.col("target").alias("a"), F.col("source").alias("b"), edge_rank().alias("rank")).groupBy("a", "b").agg(F.max("rank").alias("rank"))
    back = stored(back, "impact")
    level = changed.select("node").distinct().select("node", F.lit(3).alias("rank"), F.lit(0).alias("distance"), F.array("node").alias("via"))
    seen = level
    for d in range(1, depth + 1):
        ends = level.withColumnRenamed("rank", "so_far").join(back, F.col("node") == F.col("a"))
        path = F.struct((-F.least("so_far", "rank")).alias("weak"), "via")
        best = ends.groupBy("b").agg(F.min(path).alias("p")).select(F.col("b").alias("node"), (-F.col("p.weak")).alias("rank"), F.lit(d).alias("distance"), F.array_append("p.via", F.col("b")).alias("via"))
        level = stored(best.join(seen, "node", "left_anti"), "impact")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    sure = F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low")
    out = seen.where("distance > 0").select("node", "distance", sure.alias("confidence"), "via")
    if most is None:
        return out.withColumn("status", F.lit("complete"))
    status = "partial" if out.count() > most else "complete"
    return out.orderBy("distance", "node").limit(most).withColumn("status", F.lit(status))


def possible_direct(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes with an ambiguous edge to a changed one."""
    return edges.where(F.col("resolution") == "ambiguous").join(changed.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out by distinct neighbours."""
    ends = edges.select("source", "target").where("source <> target").distinct()
    both = ends.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(ends.select("target", F.lit(1), F.lit(0)))
    return both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """a < b that depend on each other; one pass over the edges."""
    pair = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") < F.col("target")).alias("up"))
    return pair.groupBy("a", "b").agg(F.bool_or("up").alias("u"), F.bool_or(~F.col("up")).alias("d")).where("u AND d").select("a", "b")


def module_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """from_group, to_group, n_edges between groups; groups: node, grp."""
    g = lambda side, name: groups.select(F.col("node").alias(side), F.col("grp").alias(name))
    both = edges.join(g("source", "from_group"), "source").join(g("target", "to_group"), "target")
    return both.where("from_group <> to_group").groupBy("from_group", "to_group").agg(F.count("*").alias("n_edges"))


def blast_radius(edges: DataFrame) -> DataFrame:
    """node, direct, transitive (within 3 hops), impact, level of every node that something depends on."""
    roots = edges.where("source <> target").select(F.col("target").alias("node"))
    near = bounded_bfs(edges, roots, 3, "in").where("distance > 0").select(F.col("seed").alias("root"), "node", F.col("distance").alias("d"))
    out = near.groupBy("root").agg(
        F.sum((F.col("d") == 1).cast("long")).alias("direct"), F.sum((F.col("d") > 1).cast("long")).alias("transitive"),
        F.sum(F.when(F.col("d") == 1, 1.0).when(F.col("d") == 2, 0.5).otherwise(1 / 3)).alias("x"),
    )
    level = F.when(F.col("direct") >= 8, "critical").when(F.col("direct") >= 4, "high").when(F.col("direct") >= 2, "medium").otherwise("low")
    return out.select(F.col("root").alias("node"), "direct", "transitive", F.round("x", 1).alias("impact"), level.alias("level"))


def migration_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, batch, in_cycle: each batch has the nodes whose importers are all in earlier ones; what can't be ordered
    (cycles and what they import) is the last batch. A round lowers the counts of open importers and writes one table."""
    known = nodes.select("node").distinct()
    live = edges.select("source", "target").distinct().join(known.toDF("source"), "source", "left_semi").join(known.toDF("target"), "target", "left_semi")
    live = stored(live, "order")
    open_ = live.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"))
    state, done, batch = stored(known.join(open_, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n")), "order"), None, 1
    while True:
        ready = state.where("n = 0").select("node", F.lit(batch).alias("batch"), F.lit(False).alias("in_cycle"))
        if ready.isEmpty():
            rest = state.select("node", F.lit(batch).alias("batch"), F.lit(True).alias("in_cycle"))
            return done.union(rest) if done is not None else rest
        done = ready if done is None else done.union(ready)
        less = live.join(ready.select(F.col("node").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("k"))
        state = stored(state.where("n > 0").join(less, "node", "left").select("node", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")), "order")
        batch += 1


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every component with a cycle: of two nodes or more, or one with an edge to itself.

    Rounds of trimming (nodes without an edge in or out can't lie on a cycle) and of colouring: each node takes the
    greatest node that reaches it; a colour's component is what reaches its root within the colour.
    """
    live = stored(edges.select("source", "target").where("source <> target").distinct(), "scc")
    alone = edges.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("component")).distinct()
    found = None
    while True:
        before = -1
        while (n := live.count()) not in (0, before):
            before = n
            ins, outs = live.select(F.col("target").alias("source")).distinct(), live.select(F.col("source").alias("target")).distinct()
            live = stored(live.join(ins, "source", "left_semi").join(outs, "target", "left_semi").select("source", "target"), "scc")
        if n == 0:
            break
        colour = stored(live.select(F.col("source").alias("node")).distinct().withColumn("c", F.col("node")), "scc")
        while True:
            told = live.join(colour, F.col("source") == F.col("node")).groupBy("target").agg(F.max("c").alias("m"))
            new = stored(colour.join(told, F.col("node") == F.col("target"), "left").select("node", F.greatest("c", F.coalesce("m", "c")).alias("c")), "scc")
            changed = new.withColumnRenamed("c", "d").join(colour, "node").where("c <> d").isEmpty()
            colour = new
            if changed:
                break
        side = lambda s: colour.select(F.col("node").alias(s), F.col("c").alias("c"))
        same = stored(live.join(side("source"), "source").join(side("target"), ["target", "c"]).select("source", "target", "c"), "scc")
        seen = stored(colour.where("node = c"), "scc")
        front = seen
        while True:
            front = stored(same.join(front, [same.target == front.node, same.c == front.c]).select(F.col("source").alias("node"), same.c).distinct().join(seen, ["node", "c"], "left_anti"), "scc")
            if front.isEmpty():
                break
            seen = stored(seen.union(front), "scc")
        found = seen if found is None else found.union(seen)
        gone = seen.select("node")
        live = stored(live.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"), "scc")
    if found is None:
        return alone
    by = found.groupBy("c").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
    several = stored(found.join(by, "c").select("node", "component"), "scc")
    return several.union(alone.join(several, "node", "left_anti"))


def condensation(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of components: node, component, layer of every node, and source, target, n of the edges between components.

    A component outside all cycles is its node. Its layer is the length of the longest path that ends in it. Each round settles the
    components whose predecessors are all settled, and joins their edges alone; a graph of components has no cycle, so all are.
    """
    cycles = strongly_connected(edges)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    held = stored(nodes.join(cycles, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "held")
    side = lambda c, n: held.select(F.col("node").alias(c), F.col("component").alias(n))
    across = edges.select("source", "target").join(side("source", "a"), "source").join(side("target", "b"), "target").where("a <> b")
    links = stored(across.groupBy("a", "b").agg(F.count("*").alias("n")).select(F.col("a").alias("source"), F.col("b").alias("target"), "n"), "links")
    waits = stored(links.groupBy(F.col("target").alias("component")).agg(F.count("*").alias("left")), "waits")
    front = stored(held.select("component").distinct().join(waits, "component", "left_anti"), "front")
    layers, layer = front.withColumn("layer", F.lit(0)), 0
    while True:
        layer += 1
        told = front.join(links, F.col("component") == F.col("source")).groupBy("target").agg(F.count("*").alias("done")).withColumnRenamed("target", "component")
        waits = stored(waits.join(told, "component", "left").select("component", (F.col("left") - F.coalesce("done", F.lit(0))).alias("left")), "waits")
        front = stored(waits.where("left = 0").select("component"), "front")
        if front.isEmpty():
            break
        waits = waits.where("left > 0")
        layers = layers.union(front.withColumn("layer", F.lit(layer)))
    return held.join(layers, "component").select("node", "component", "layer"), links


def cycle_summaries(edges: DataFrame, most: int = 5) -> DataFrame:
    """component, n_nodes, n_edges (within), n_in, n_out (to others), members (the least `most`) of every component with a cycle."""
    cycles = stored(strongly_connected(edges), "cycles")
    side = lambda c, n: cycles.select(F.col("node").alias(c), F.col("component").alias(n))
    e = edges.select("source", "target").distinct().join(side("source", "a"), "source", "left").join(side("target", "b"), "target", "left")
    inner = F.col("a").eqNullSafe(F.col("b"))
    ends = e.where(inner & F.col("a").isNotNull()).select(F.col("a").alias("component"), F.lit("within").alias("w")).union(e.where(~inner & F.col("b").isNotNull()).select("b", F.lit("in"))).union(e.where(~inner & F.col("a").isNotNull()).select("a", F.lit("out")))
    counts = ends.groupBy("component").agg(F.count_if(F.col("w") == "within").alias("n_edges"), F.count_if(F.col("w") == "in").alias("n_in"), F.count_if(F.col("w") == "out").alias("n_out"))
    rank = F.row_number().over(W.partitionBy("component").orderBy("node"))  # ranked and cut before any is gathered
    members = cycles.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    size = cycles.groupBy("component").agg(F.count("*").alias("n_nodes"))
    return size.join(counts, "component").join(members, "component").select("component", "n_nodes", "n_edges", "n_in", "n_out", "members")


def connected(edges: DataFrame) -> DataFrame:
    """node, component of the undirected graph."""
    return components(edges.select(F.col("source").alias("u"), F.col("target").alias("v")))


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes that no root reaches: one traversal from all roots together, to its end or within `depth` edges."""
    start = roots.select("node").distinct()
    seen = stored(start, "reach")
    front, steps, d = seen, stored(arcs(edges, "out"), "reach"), 0
    while depth is None or d < depth:
        d += 1
        front = stored(front.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"), "reach")
        if front.isEmpty():
            break
        seen = seen.union(front)
        if d % 20 == 0:  # a long chain must not become a plan of as many tables
            seen = stored(seen, "reach")
    return nodes.select("node").distinct().join(seen, "node", "left_anti")


def greedy_trace(edges: DataFrame, starts: DataFrame, depth: int = 6) -> DataFrame:
    """start, hop, node: from each start the edge of greatest weight (ties: least target), never to a node twice.
    edges: source, target, weight."""
    path = starts.select(F.col("node").alias("start"), F.array("node").alias("path"), F.lit(True).alias("open"))
    steps = stored(edges.groupBy("source", "target").agg(F.sum("weight").alias("weight")), "trace")
    for _ in range(depth):
        ends = path.where("open").join(steps, F.element_at("path", -1) == F.col("source")).where(~F.array_contains("path", F.col("target")))
        best = ends.groupBy("start").agg(F.min_by("target", F.struct(-F.col("weight"), "target")).alias("next"))
        path = stored(path.join(best, "start", "left").select("start", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("next"))).alias("path"), (F.col("open") & F.col("next").isNotNull()).alias("open")), "trace")
    return path.select("start", F.posexplode("path").alias("hop", "node"))


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """path (array), status of every simple path of 1 to `depth` edges from the starts; with `most` the first ones, shortest
    first, and partial if there are more. Levels are written, so that no path is made twice."""
    steps, level, out = stored(arcs(edges, "out"), "paths"), starts.select(F.array("node").alias("path")), None
    for _ in range(depth):
        ends = level.join(steps, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b")))
        level = stored(ends.select(F.array_append("path", F.col("b")).alias("path")), "paths")
        out = level if out is None else out.union(level)
    if most is None:
        return out.withColumn("status", F.lit("complete"))
    status = "partial" if out.count() > most else "complete"
    return out.orderBy(F.size("path"), "path").limit(most).withColumn("status", F.lit(status))


def first_paths(edges: DataFrame, starts: DataFrame, depth: int = 6, most: int = 30, visits: int = 12_000) -> DataFrame:
    """start, path, status: of the paths that can't go on (every next node is on them, or they have `depth` edges) the first `most` of
    each start, shorter first, then by their nodes. A start's paths grow level by level; a level keeps what `visits` allows of them
    in that order, and no level is made for a start that has its paths. status: partial if anything was left out, also beyond
    `depth`; not-found for a start that no edge touches. A start without a path has one row without one."""
    steps, s = stored(arcs(edges, "out"), "paths"), starts.select(F.col("node").alias("start")).distinct()
    touched = edges.select("source").union(edges.select("target")).distinct().toDF("start")
    level = stored(s.select("start", F.array("start").alias("path")), "paths")
    ledger = stored(s.select("start", F.lit(1).cast("long").alias("used"), F.lit(0).cast("long").alias("ended"), F.lit(False).alias("cut")), "ledger")
    out, turn = None, W.partitionBy("start").orderBy("path")
    for d in range(depth + 1):
        grown = level.join(steps, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("start", "path", "b")
        grown = stored(grown, "grown")
        done = level if d == depth else level.join(grown.select("start", "path").distinct(), ["start", "path"], "left_anti")
        done = done.where(F.size("path") > 1)
        out = done if out is None else out.union(done)
        more = grown.groupBy("start").agg(F.count("*").alias("more")).join(done.groupBy("start").agg(F.count("*").alias("done")), "start", "full")
        told = ledger.join(more, "start", "left").fillna(0, ["more", "done"]).withColumn("ended", F.col("ended") + F.col("done"))
        left_out = (F.col("ended") > most) | ((F.col("ended") == most) & (F.col("more") > 0)) | (F.col("used") + F.col("more") > visits) | ((F.col("more") > 0) & F.lit(d == depth))
        told = stored(told.select("start", F.least(F.lit(visits), F.col("used") + F.col("more")).alias("used"), "ended", (F.col("cut") | left_out).alias("cut"), (F.lit(visits) - F.col("used")).alias("room")), "ledger")
        ledger = told.drop("room")
        if d == depth or grown.isEmpty():
            break
        open_ = grown.select("start", F.array_append("path", F.col("b")).alias("path")).join(told.where((F.col("ended") < most) & (F.col("room") > 0)).select("start", "room"), "start")
        level = stored(open_.withColumn("n", F.row_number().over(turn)).where((F.col("n") <= visits) & (F.col("n") <= F.col("room"))).select("start", "path"), "paths")
    rank = F.row_number().over(W.partitionBy("start").orderBy(F.size("path"), "path"))
    first = out.withColumn("n", rank).where(F.col("n") <= most).select("start", "path")
    status = F.when(F.col("known").isNull(), "not-found").when(F.col("cut"), "partial").otherwise("complete")
    return ledger.join(touched.withColumn("known", F.lit(True)), "start", "left").join(first, "start", "left").select("start", "path", status.alias("status"))


def duplicate_call_sites(calls: DataFrame) -> DataFrame:
    """caller, path, line, name, n of calls that a function makes more than once on a line."""
    return calls.groupBy("caller", "path", "line", "name").agg(F.count("*").alias("n")).where("n > 1")
