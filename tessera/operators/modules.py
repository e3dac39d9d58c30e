"""Which file a module specifier of JavaScript or TypeScript means: by its path, by the mappings of the nearest configuration and
those that it extends, or by the maps of packages in the same repository.

Configurations and packages are found from a file by its folders, each a key; no specifier meets all of them.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.receivers import lookup_order

#: What a path without an extension may stand for, and what TypeScript means by an extension of compiled code. Fixed values.
VARIANTS = ("", ".ts", ".tsx", ".mts", ".cts", ".d.ts", ".d.mts", ".d.cts", ".js", ".jsx", ".mjs", ".cjs", ".json", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs")
COMPILED = {"js": (".ts", ".tsx", ".d.ts"), "jsx": (".tsx", ".d.ts"), "mjs": (".mts", ".d.mts"), "cjs": (".cts", ".d.cts")}
#: Conditions of package maps, preferred first. Fixed values.
CONDITIONS = ("import", "browser", "node", "default", "require", "types", "typings")
SCRIPT = r"\.(?:js|jsx|mjs|cjs|ts|tsx|mts|cts|vue|svelte)$"


def entries(part) -> list[tuple]:
    """A table's entries; other shapes have none."""
    return list(part.items()) if isinstance(part, dict) else []


def folder_of(path: str) -> str:
    return path.rsplit("/", 1)[0] if "/" in path else ""


def joined(folder: str, rest: str) -> str | None:
    """A path from a folder; None above the repository."""
    parts: list[str] = []
    for p in f"{folder}/{rest}".split("/"):
        if p == "..":
            if not parts:
                return None
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def config_facts(path: str, content: str) -> list[tuple]:
    """A configuration, comments and trailing commas allowed: its base folder, what it extends, each of its path mappings."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", content)
    whole = dict(entries(json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))))
    options, folder, above = dict(entries(whole.get("compilerOptions"))), folder_of(path), whole.get("extends")
    base = joined(folder, options["baseUrl"]) if isinstance(options.get("baseUrl"), str) else None
    out = [("config", path, folder, 1, 1, base, None, "manifest")]
    listed = [a for a in (above if isinstance(above, list) else [above]) if isinstance(a, str)]
    for rank, name in enumerate(reversed(listed)):  # what is named last wins
        at = joined(folder, name) if name.startswith(".") else joined("node_modules", name) if not name.startswith("/") else None
        for n, given in enumerate([at] if at and at.endswith(".json") else [f"{at}.json", f"{at}/tsconfig.json"] if at else []):
            out.append(("extends", path, given, 1, 1, None, json.dumps({"rank": rank, "n": n}), "manifest"))
    for pattern, values in entries(options.get("paths")):
        if isinstance(values, list):
            out += [("path-mapping", path, pattern, 1, 1, v, str(n), "manifest") for n, v in enumerate(values) if isinstance(v, str)]
    return out


def chosen(value) -> str | None:
    """The file of a package map's entry: the first of a list that has one, or of its conditions in order of preference."""
    if isinstance(value, str):
        return value or None
    named = dict(entries(value))
    options = value if isinstance(value, list) else [*(named[c] for c in CONDITIONS if c in named), *(v for k, v in named.items() if k not in CONDITIONS)]
    return next(filter(None, map(chosen, options)), None)


def package_facts(path: str, body: dict) -> list[tuple]:
    """A package's name, and what its maps make of each subpath (from exports, else from its entry) and private name (imports)."""
    given = body.get("exports")
    if "exports" not in body:
        entry = next((body[k] for k in ("types", "typings", "module", "main") if body.get(k) and isinstance(body[k], str)), "./index.js")
        given = {".": entry, "./*": "./*"}
    elif not any(str(k).startswith((".", "#")) for k, _ in entries(given)):
        given = {".": given}
    name = body["name"] if isinstance(body.get("name"), str) else None
    out = [("package-root", path, folder_of(path), 1, 1, name, None, "manifest")]
    private = [(k, v) for k, v in entries(body.get("imports")) if k.startswith("#")]
    return out + [("package-map", path, k, 1, 1, chosen(v), None, "manifest") for k, v in [*entries(given), *private]]


def normal(path: Column) -> Column:
    """A path without . and .., null where it leaves the repository."""
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1))
    step = lambda a, p: F.when(p == "..", up(a)).when(p.isin("", "."), a).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("CAST(array() AS array<string>)"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def variants(base: Column, source: Column) -> Column:
    """Paths that base may mean in a source file, in order."""
    stem, extension = F.regexp_replace(base, r"\.\w+$", ""), F.regexp_extract(base, r"\.(\w+)$", 1)
    whole, none = F.array(*(F.concat(base, F.lit(v)) for v in VARIANTS)), F.expr("CAST(array() AS array<string>)")
    typed = none
    for x, endings in COMPILED.items():
        typed = F.when(extension == x, F.array(*(F.concat(stem, F.lit(e)) for e in endings))).otherwise(typed)
    return F.concat(F.when(source.rlike(r"\.(?:ts|tsx|mts|cts)$"), typed).otherwise(none), whole)


def nearest(sources: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the innermost of the folders in roots around each file. Every folder above a file is a key."""
    parts = F.split(F.concat(F.lit("/"), folder(F.col("path"))), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.filter(F.slice(parts, 1, n), lambda p: p != ""), "/"))
    met = sources.select("path", F.explode(F.array_distinct(above)).alias("root")).join(roots.select("root").distinct(), "root")
    return met.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def effective(found: DataFrame) -> DataFrame:
    """root, prefix, suffix, star, value, n, anchor: the mappings that hold in a configuration's folder, its own and those that it
    inherits. Of one pattern the nearest along extends wins; values start from the base folder of where they stand. A base folder
    is a mapping of any name, tried last. Configurations that extend each other end."""
    config = found.where("kind = 'config'").select(F.col("path").alias("span"), F.col("name").alias("root"), F.col("owner").alias("base_url"))
    more = found.where("kind = 'extends'").select(F.col("path").alias("span"), F.col("name").alias("base"), F.from_json("detail", "rank int, n int").alias("d"))
    met = more.join(config.select(F.col("span").alias("base")), "base").groupBy("span", "d.rank").agg(F.min_by("base", "d.n").alias("base"))
    order = lookup_order(met.select("span", "base", "rank"), first=True).select("span", "base", "order")
    line = order.union(config.select("span", "span", F.expr("CAST(array() AS array<int>)"))).distinct()
    urls = line.join(config.select(F.col("span").alias("base"), "base_url"), "base").where("base_url IS NOT NULL").groupBy("span").agg(F.min_by("base_url", "order").alias("base_url"))
    own = found.where("kind = 'path-mapping'").select(F.col("path").alias("base"), F.col("name").alias("pattern"), F.struct(F.col("detail").cast("int").alias("n"), F.col("owner").alias("value")).alias("v"))
    anchors = config.select("span", "root").join(urls, "span", "left").select(F.col("span").alias("base"), F.coalesce("base_url", "root").alias("anchor"))
    own = own.groupBy("base", "pattern").agg(F.sort_array(F.collect_list("v")).alias("vs")).join(anchors, "base")
    held = line.join(own, "base").groupBy("span", "pattern").agg(F.min_by(F.struct("vs", "anchor"), "order").alias("b"))
    rows = held.select("span", "pattern", "b.anchor", F.explode("b.vs").alias("v")).select("span", "pattern", "anchor", "v.n", "v.value")
    rows = rows.unionByName(urls.select("span", F.lit("*").alias("pattern"), F.col("base_url").alias("anchor"), F.lit(1_000_000).alias("n"), F.lit("*").alias("value")))
    star = F.contains("pattern", F.lit("*"))
    return rows.join(config.select("span", "root"), "span").select("root", F.substring_index("pattern", "*", 1).alias("prefix"), F.when(star, F.expr("substring(pattern, locate('*', pattern) + 1)")).otherwise("").alias("suffix"), star.alias("star"), "value", "n", "anchor")


def fits(name: Column) -> Column:
    """Whether a name is of a pattern's shape (prefix, star, suffix)."""
    whole = F.startswith(name, F.col("prefix")) & F.endswith(name, F.col("suffix")) & (F.length(name) >= F.length("prefix") + F.length("suffix"))
    return F.when(F.col("star"), whole).otherwise(name == F.col("prefix"))


def filled(target: Column, name: Column) -> Column:
    """A pattern's target with what the star stands for."""
    inner = F.substring(name, F.length("prefix") + 1, F.length(name) - F.length("prefix") - F.length("suffix"))
    at = F.locate("*", target)
    return F.when(F.col("star") & (at > 0), F.concat(F.substring(target, F.lit(1), at - 1), inner, F.substring(target, at + 1, F.length(target)))).otherwise(target)


def head(name: Column) -> Column:
    return F.regexp_extract(name, r"^([^/]*)", 1)


def by_config(imports: DataFrame, found: DataFrame) -> DataFrame:
    """path, seq, line, rank, base: what names mean by the nearest configuration: longest prefix, then suffix, then order."""
    maps = effective(found).withColumn("head", F.when(F.col("star") & ~F.contains("prefix", F.lit("/")), "*").otherwise(head(F.col("prefix"))))
    roots = found.where("kind = 'config'").select(F.col("name").alias("root"))
    asked = imports.join(nearest(imports.select("path").distinct(), roots), "path").withColumn("head", F.explode(F.array(head(F.col("name")), F.lit("*"))))
    met = asked.join(maps, ["root", "head"]).where(fits(F.col("name")))
    rank = F.array(F.lit(1), -F.length("prefix"), -F.length("suffix"), F.col("n"))
    return met.select("path", "seq", "line", rank.alias("rank"), normal(F.concat_ws("/", "anchor", filled(F.col("value"), F.col("name")))).alias("base"))


def by_package(imports: DataFrame, found: DataFrame) -> DataFrame:
    """path, seq, line, rank, base: what names mean by a package here. #names belong to the nearest package, others to the package
    of that name (of several, the deepest). An exact key decides, else the longest prefix, then suffix; a key without a file
    means none. Targets stay in their package."""
    roots = found.where("kind = 'package-root'").select(F.col("path").alias("manifest"), F.col("name").alias("root"), F.col("owner").alias("package"))
    star = F.contains("name", F.lit("*"))
    maps = found.where("kind = 'package-map'").select(
        F.col("path").alias("manifest"), F.substring_index("name", "*", 1).alias("prefix"), F.when(star, F.expr("substring(name, locate('*', name) + 1)")).otherwise("").alias("suffix"), star.alias("star"), F.col("owner").alias("value"),
    )
    private = imports.where(F.startswith("name", F.lit("#")))
    scoped = private.join(nearest(private.select("path").distinct(), roots), "path").join(roots.select("root", "manifest"), "root").withColumn("sub", F.col("name"))
    name = F.regexp_extract("name", r"^(@[^/]+/[^/]+|[^@/.#][^/]*)", 1)
    named = roots.where("package IS NOT NULL").groupBy("package").agg(F.max_by(F.struct("manifest", "root"), F.struct(F.length("root"), "root")).alias("m"))
    public = imports.withColumn("package", name).where("package <> ''").join(named, "package").select(*imports.columns, F.col("m.root").alias("root"), F.col("m.manifest").alias("manifest"), F.concat(F.lit("."), F.expr("substring(name, length(package) + 1)")).alias("sub"))
    met = scoped.select(*imports.columns, "root", "manifest", "sub").unionByName(public).join(maps, "manifest").where(fits(F.col("sub")))
    best = F.struct(F.col("star"), -F.length("prefix"), -F.length("suffix"))
    one = met.groupBy("path", "seq", "line", "root").agg(F.min_by(filled(F.col("value"), F.col("sub")), best).alias("target"))
    inside = one.where("target IS NOT NULL").where(~F.startswith("target", F.lit("/")) & ~F.array_contains(F.split("target", "/"), ".."))
    return inside.select("path", "seq", "line", F.array(*map(F.lit, (2, 0, 0, 0))).alias("rank"), normal(F.concat_ws("/", "root", "target")).alias("base"))


def module_targets(imports: DataFrame, found: DataFrame) -> DataFrame:
    """path, seq, line, rank, target of what imports (path, seq, line, name) of scripts may mean, least rank first. A relative
    name is a path; others go by configuration, then by package, then from src where they begin with @/."""
    scripts = imports.where(F.col("path").rlike(SCRIPT)).select("path", "seq", "line", "name")
    near, far = scripts.where(F.startswith("name", F.lit("."))), scripts.where(~F.startswith("name", F.lit(".")))
    row = lambda df, n, base: df.select("path", "seq", "line", F.array(*map(F.lit, (n, 0, 0, 0))).alias("rank"), normal(base).alias("base"))
    relative = row(near, 0, F.concat_ws("/", folder(F.col("path")), F.col("name")))
    usual = row(far.where(F.startswith("name", F.lit("@/"))), 3, F.concat(F.lit("src/"), F.expr("substring(name, 3)")))
    every = relative.union(usual).union(by_config(far, found)).union(by_package(far, found)).where("base <> ''")
    return every.select("path", "seq", "line", "rank", F.posexplode(variants(F.col("base"), F.col("path"))).alias("n", "target")).select("path", "seq", "line", F.concat("rank", F.array("n")).alias("rank"), "target")
