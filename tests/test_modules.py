"""Module specifiers on small repositories: nearest and inherited configurations, package maps, extensions of compiled code."""

import json

import pytest

from tessera.operators import extract, modules


def edges(spark, files: dict) -> set:
    df = spark.createDataFrame([(p, c if isinstance(c, str) else json.dumps(c)) for p, c in files.items()], "path string, content string")
    found = extract.facts(df).cache()
    return {(r.source, r.line, r.target) for r in extract.resolve_imports(df, found).collect()}


PATHS = lambda pattern, *values, **more: {"compilerOptions": {"paths": {pattern: list(values)}, **more}}


def test_nearest_and_inherited_configurations(spark):
    got = edges(spark, {
        "tsconfig.json": PATHS("@/*", "src/*", baseUrl="."), "src/shared.ts": "", "apps/web/src/shared.ts": "", "apps/web/tsconfig.json": PATHS("@/*", "src/*", baseUrl="."),
        "apps/web/main.ts": "import { a } from '@/shared';\n", "apps/other.ts": "import { a } from '@/shared';\n",
        # inherited, the nearest of one pattern wins, values start where they stand, and a cycle ends
        "lib/cfg/base.json": "{}", "lib/cfg/tsconfig.base.json": {"extends": "../tsconfig.json", **PATHS("@base/*", "../src/*")}, "lib/cfg/tsconfig.last.json": PATHS("@x", "one.ts"),
        "lib/cfg/tsconfig.first.json": PATHS("@x", "two.ts"), "lib/cfg/one.ts": "", "lib/cfg/two.ts": "",
        "lib/tsconfig.json": {"extends": ["./cfg/tsconfig.base", "./cfg/tsconfig.first", "./cfg/tsconfig.last.json", "./gone"]},
        "lib/src/a.ts": "", "lib/use.ts": "import '@base/a';\nimport '@x';\nimport '@/shared';\n",
    })
    assert got == {("apps/web/main.ts", 1, "apps/web/src/shared.ts"), ("apps/other.ts", 1, "src/shared.ts"), ("lib/use.ts", 1, "lib/src/a.ts"), ("lib/use.ts", 2, "lib/cfg/one.ts")} | {
        ("lib/use.ts", 3, "src/shared.ts")
    }  # by the usual folder, as no mapping of the nearest configuration fits


def test_packages(spark):
    core = {
        "name": "@demo/core", "exports": {".": {"types": "./src/index.d.ts", "import": "./src/index.js"}, "./utils/*": "./src/utils/*.js", "./utils/own/*": None, "./out": "../../x.ts"},
        "imports": {"#internal/*": ["", {"node": "./src/internal/*.js"}], "#one": {"odd": "./src/one.ts"}},
    }
    got = edges(spark, {
        "packages/core/package.json": core, "packages/core/src/index.ts": "", "packages/core/src/utils/format.ts": "", "packages/core/src/utils/own/a.ts": "",
        "packages/core/src/internal/run.ts": "", "packages/core/src/one.ts": "", "packages/core/src/in.ts": "import '#internal/run';\nimport '#one';\nimport '#gone';\n", "x.ts": "",
        "packages/plain/package.json": {"name": "plain", "main": "lib/start"}, "packages/plain/lib/start.js": "", "packages/plain/deep/b.ts": "",
        "packages/string/package.json": {"name": "text", "exports": "./t.js"}, "packages/string/t.js": "", "old/package.json": {"name": "text"}, "odd/package.json": "[]",
        "apps/main.ts": "import '@demo/core';\nimport '@demo/core/utils/format';\nimport '@demo/core/utils/own/a';\nimport '@demo/core/out';\nimport 'plain';\nimport 'plain/deep/b';\nimport 'text';\nimport 'text/t.js';\nimport 'react';\nimport '#one';\n",
    })
    assert {(line, t) for s, line, t in got if s == "apps/main.ts"} == {
        (1, "packages/core/src/index.ts"), (2, "packages/core/src/utils/format.ts"), (5, "packages/plain/lib/start.js"), (6, "packages/plain/deep/b.ts"), (7, "packages/string/t.js"),
    }
    assert {(line, t) for s, line, t in got if s != "apps/main.ts"} == {(1, "packages/core/src/internal/run.ts"), (2, "packages/core/src/one.ts")}


def test_compiled_extensions(spark):
    got = edges(spark, {"a.ts": "import './b.js';\nimport './c.mjs';\nimport './d.jsx';\nimport '../up';\n", "b.ts": "", "b.js": "", "c.mts": "", "d.tsx": "", "e.js": "import './b.js';\n"})
    assert got == {("a.ts", 1, "b.ts"), ("a.ts", 2, "c.mts"), ("a.ts", 3, "d.tsx"), ("e.js", 1, "b.js")}


@pytest.mark.parametrize("folder, rest", [("", "a"), ("a/b", "./c"), ("a/b", "../../c"), ("a", "../../c"), ("a", "b/../.."), ("", "..")])
def test_normal_paths(spark, folder, rest):
    from pyspark.sql import functions as F

    assert spark.range(1).select(modules.normal(F.lit(f"{folder}/{rest}")).alias("p")).first().p == modules.joined(folder, rest)
