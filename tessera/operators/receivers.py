"""What the receiver of a call is: an object of a known class, the class around the call or its bases, or a module.

Variables have types by scope, classes a lookup order over their bases, modules the names they export, also through other
modules. Each of these is a table; a call meets them by equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import dropped, stored

EVERYWHERE = 2**31 - 1
#: Languages whose methods are called without a receiver inside their class.
IMPLICIT = ("java", "kotlin", "scala", "csharp")
#: Languages where a name alone never means a method.
EXPLICIT = ("python", "javascript", "typescript")


def class_spans(found: DataFrame) -> DataFrame:
    """path, name, span, start, end, bases of all classes; span names one."""
    return found.where("kind = 'class'").select("path", "name", F.concat_ws("|", "path", "line", "name").alias("span"), F.col("line").alias("start"), F.col("end_line").alias("end"), F.col("detail").alias("bases"))


def exported(found: DataFrame, spread: DataFrame, given: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, name, key: what each file gives to others by which name: its own symbols (path, name, key), by other names where an
    export says so, and those of files whose names it gives on, all or some, along chains of any length; cycles of files end."""
    own = found.where("kind = 'export'").select("path", "name", F.col("detail").alias("given"))
    base = symbols.union(own.join(symbols, ["path", "name"]).select("path", F.col("given").alias("name"), "key")).distinct()
    again = found.where("kind = 'reexport'").select("path", F.col("line").alias("at"), F.col("owner").alias("exported"), F.col("detail").alias("given")).join(spread, ["path", "at"])
    passed = own.join(given, ["path", "name"]).where("exported <> '*'").select("path", "exported", "given", "target")
    steps = stored(again.select("path", "exported", "given", "target").union(passed).distinct(), "exports")
    new = stored(base, "exports")
    rounds = [new]
    while True:
        ours = new.toDF("target", "known", "key")
        one = steps.where("exported <> '*'").join(ours, (steps.target == ours.target) & (steps.exported == ours.known)).select("path", F.col("given").alias("name"), "key")
        every = steps.where("exported = '*' AND given = '*'").join(ours.where("known <> 'default'"), "target").select("path", F.col("known").alias("name"), "key")
        out = rounds[0]
        for r in rounds[1:]:
            out = out.union(r)
        new = stored(one.union(every).distinct().join(out, ["path", "name", "key"], "left_anti"), "exports")
        if new.isEmpty():
            out = stored(out, "exports")
            dropped(found.sparkSession, new, steps, *rounds)
            return out
        rounds.append(new)


def named_classes(wanted: DataFrame, classes: DataFrame, given: DataFrame, reach: DataFrame, exports: DataFrame) -> DataFrame:
    """path, name, span: the class that a name means in a file: the file's own, one imported by that name, one of a file that it
    imports or shares a package with. The first step with candidates decides; several in it mean none."""
    own = wanted.join(classes.select("path", "name", "span"), ["path", "name"]).withColumn("step", F.lit(0))
    bound = wanted.join(given, ["path", "name"]).join(exports.toDF("target", "exported", "span"), ["target", "exported"]).select("path", "name", "span").withColumn("step", F.lit(1))
    near = wanted.join(reach, "path").join(classes.select(F.col("path").alias("target"), "name", "span"), ["target", "name"]).select("path", "name", "span").withColumn("step", F.lit(2))
    by = own.unionByName(bound).unionByName(near).groupBy("path", "name", "step").agg(F.count_distinct("span").alias("n"), F.min("span").alias("span"))
    return by.groupBy("path", "name").agg(F.min_by(F.struct("n", "span"), "step").alias("b")).where("b.n = 1").select("path", "name", "b.span")


def base_names(classes: DataFrame) -> DataFrame:
    """path, span, rank, name of each base that a class names, in order, without packages and type arguments."""
    plain = F.regexp_replace(F.regexp_replace("bases", r"<[^<>]*>", ""), r"<[^<>]*>", "")
    parts = classes.select("path", "span", F.posexplode(F.split(plain, r"\s*,\s*|\s+(?:implements|extends|with)\s+")).alias("rank", "b"))
    return parts.select("path", "span", "rank", F.regexp_extract("b", r"(\w+)\s*(?:\(.*)?$", 1).alias("name")).where("name <> ''")


def lookup_order(bases: DataFrame, first: bool = False) -> DataFrame:
    """span, base, order: every class that a class inherits from; methods are looked up by ascending order. bases: span, base, rank.
    A class that is met on several ways keeps its last place, so it comes after all that inherit from it (first: its first
    place); classes that inherit from themselves end. One round a level, each written."""
    best = F.min if first else F.max
    step = bases.toDF("base", "next", "rank")
    frontier = stored(bases.where("span <> base").groupBy("span", "base").agg(best("rank").alias("rank")).select("span", "base", F.array("rank").alias("order"), F.array("span", "base").alias("seen")), "bases")
    out = frontier
    while True:
        met = frontier.join(step, "base").where(~F.array_contains("seen", F.col("next"))).select("span", F.col("next").alias("base"), F.struct(F.concat("order", F.array("rank")).alias("order"), F.concat("seen", F.array("next")).alias("seen")).alias("s"))
        frontier = stored(met.groupBy("span", "base").agg(best("s").alias("s")).select("span", "base", "s.order", "s.seen"), "bases")
        if frontier.isEmpty():
            return stored(out.groupBy("span", "base").agg(best("order").alias("order")), "order")
        out = out.union(frontier)


def typed_scopes(found: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """path, variable, type, start, end: what is known of variables, and the lines where it holds: the function or class around the
    declaration, else the file. What a class declares also holds for this.variable and self.variable. functions: path, span, start, end."""
    from tessera.operators.linkage import innermost

    t = found.where("kind = 'typed'").select("path", F.col("name").alias("variable"), F.regexp_extract("owner", r"(\w+)$", 1).alias("type"), "line", F.concat_ws("|", "path", "seq").alias("point"))
    points = t.select("path", "point", F.col("line").alias("at"))
    of = lambda spans, name: innermost(points, spans.select("path", "span", "start", "end"), "path").join(spans.groupBy("span").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias(name)), "span").select("point", name)
    t = t.join(of(functions, "f"), "point", "left").join(of(classes, "c"), "point", "left")
    member = F.col("variable").rlike(r"^(?:this|self|cls)\.")
    length = lambda s: s["end"] - s["start"]
    in_class = F.col("c").isNotNull() & (member | F.col("f").isNull() | (length(F.col("c")) < length(F.col("f"))))
    whole = F.struct(F.lit(0).alias("start"), F.lit(EVERYWHERE).alias("end"))
    scope = F.when(in_class, F.col("c")).when(member, whole).otherwise(F.coalesce("f", whole))
    names = F.when(in_class & ~member, F.array("variable", F.concat(F.lit("this."), "variable"), F.concat(F.lit("self."), "variable"))).otherwise(F.array("variable"))
    return t.select("path", F.explode(names).alias("variable"), "type", scope.alias("s")).select("path", "variable", "type", "s.start", "s.end").distinct()


def receiver_types(calls: DataFrame, scopes: DataFrame) -> DataFrame:
    """call, path, type, types: the type of a call's receiver where its innermost scope is, and how many types it has there; else the
    class that the receiver names or makes."""
    from tessera.operators.linkage import innermost

    key, place = F.concat_ws("|", "path", "variable").alias("variable"), F.concat_ws("-", "start", "end").alias("span")
    points = calls.select(F.concat_ws("|", "path", "receiver").alias("variable"), F.col("call").alias("point"), F.col("line").alias("at"))
    spans = scopes.select(key, place, "start", "end").distinct()
    held = innermost(points, spans, "variable").where("span IS NOT NULL").toDF("call", "span")
    known = scopes.select("path", F.col("variable").alias("receiver"), place, "type").distinct()
    typed = calls.join(held, "call").join(known, ["path", "receiver", "span"]).select("call", "path", "type")
    typed = typed.join(typed.groupBy("call").agg(F.count_distinct("type").alias("types")), "call")
    made = calls.select("call", "path", F.regexp_extract("receiver", r"^([A-Z]\w*)(?:\(.*\))?$", 1).alias("type"), F.lit(1).alias("types")).where("type <> ''")
    return typed.unionByName(made.join(typed.select("call"), "call", "left_anti"))


def is_language(path: Column, *names: str) -> Column:
    from tessera.operators.extract import language_of

    return language_of(path).isin(*names)


def method_targets(found: DataFrame, calls: DataFrame, given: DataFrame, reach: DataFrame, functions: DataFrame, classes: DataFrame, exports: DataFrame) -> DataFrame:
    """call, key, n: the functions that calls mean by their receivers, and how many candidates there are. calls: call, path, name,
    line, receiver; functions: path, name, key, owner, line, end_line; exports: path, name, key of functions and classes.

    this, self, cls: the class around the call; super: its bases; a module: what it exports; a variable: its type's class. In a
    class and its bases the first with a method of the name decides. A variable of several types is ambiguous."""
    from tessera.operators.linkage import innermost

    spans = classes.select("path", "span", "start", "end")
    inside = functions.where("owner IS NOT NULL").select("path", F.concat(F.lit("f|"), "key").alias("point"), F.col("line").alias("at")).distinct()
    implicit = F.col("receiver").isNull() & is_language(F.col("path"), *IMPLICIT)
    bound = calls.where(F.col("receiver").isin("this", "self", "cls", "super", "super()") | implicit)
    at = stored(innermost(inside.union(bound.select("path", F.concat(F.lit("c|"), "call"), "line")), spans, "path").where("span IS NOT NULL"), "around")
    around = lambda kind, name: at.where(F.startswith("point", F.lit(kind))).select(F.substring("point", 3, EVERYWHERE).alias(name), "span")
    methods = functions.select("key", "name").distinct().join(around("f|", "key"), "key").select(F.col("span").alias("base"), "name", "key")

    scopes = typed_scopes(found, functions.select("path", F.col("key").alias("span"), F.col("line").alias("start"), F.col("end_line").alias("end")), classes)
    types = stored(receiver_types(calls.where(F.col("receiver").isNotNull()), scopes), "types")
    bases = base_names(classes)
    wanted = types.select("path", F.col("type").alias("name")).union(bases.select("path", "name")).distinct()
    meant = stored(named_classes(wanted, classes, given, reach, exports), "meant")
    order = lookup_order(bases.join(meant.toDF("path", "name", "base"), ["path", "name"]).select("span", "base", "rank").distinct())
    line = order.union(classes.select("span", "span", F.expr("CAST(array() AS array<int>)")).distinct())

    here = bound.join(around("c|", "call"), "call").select("call", "name", "span", F.startswith("receiver", F.lit("super")).alias("up"), F.lit(1).alias("types"))
    there = types.join(meant.withColumnRenamed("name", "type"), ["path", "type"]).join(calls.select("call", "name"), "call").select("call", "name", "span", F.lit(False).alias("up"), "types")
    held = here.withColumn("up", F.coalesce("up", F.lit(False))).unionByName(there).join(line, "span").where("NOT up OR span <> base").join(methods, ["base", "name"])
    first = held.groupBy("call", "span").agg(F.min("order").alias("order"))
    by_class = held.join(first, ["call", "span", "order"]).select("call", "key", "types")

    module = given.select("path", F.col("name").alias("receiver"), "target", "exported")
    last = F.regexp_extract("target", r"([^/]+?)(?:/__init__)?\.py$", 1)
    module = module.where((F.col("exported") == "*") | (is_language(F.col("path"), "python") & ((F.col("exported") == last) | (F.col("exported") == F.col("receiver")))))
    by_module = calls.join(module, ["path", "receiver"]).join(exports.toDF("target", "name", "key"), ["target", "name"]).join(functions.where("owner IS NULL").select("key").distinct(), "key", "left_semi").select("call", "key", F.lit(1).alias("types"))
    both = by_class.union(by_module.join(by_class.select("call"), "call", "left_anti"))
    return both.groupBy("call").agg(F.greatest(F.count_distinct("key"), F.max("types").cast("long")).alias("n"), F.min("key").alias("key"))
