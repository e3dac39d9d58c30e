"""Readers, ingest and exports."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import extract
from tessera.sources import repository as R


def test_read_and_ingest(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("x = 1\n")
    (root / "b.txt").write_text("é")
    got = R.read_repository(spark, str(root), "one")
    assert {(r.path, r.content) for r in got.collect()} == {("src/a.py", "x = 1\n"), ("b.txt", "é")}
    out = str(tmp_path / "files")
    R.ingest(got, out)
    R.ingest(got.withColumn("repository", F.lit("two")), out)
    R.ingest(got.limit(1), out)
    assert {r.repository: r["count"] for r in spark.read.parquet(out).groupBy("repository").count().collect()} == {"one": 1, "two": 2}
    with pytest.raises(ValueError):
        R.ingest(got.union(got), out)


def test_exports(spark):
    f = spark.createDataFrame([("r1", "a.py", 0, "critical", "t"), ("r2", "b.py", 4, "low", "u")], "ruleId string, path string, line int, severity string, title string")
    got = [json.loads(r.result) for r in R.sarif(f).collect()]
    assert [g["level"] for g in got] == ["error", "note"] and got[0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    t = spark.createDataFrame([("orders", ["id", "user_id"], [("user_id", "users")]), ("users", ["id"], [])], "name string, columns array<string>, keys array<struct<column string, target string>>")
    assert "users ||--o{ orders : user_id" in R.mermaid_er(t).first()["diagram"]
    e = spark.createDataFrame([("GET", "/x", False), ("POST", "/x", True)], "method string, path string, auth boolean")
    assert json.loads(R.openapi_paths(e).first()["operations"]).keys() == {"get", "post"}
    assert "Bearer" in R.curl(e).where("auth").first()["curl"]


def test_model_ids_are_stable(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n")], "path string, content string")
    edges = spark.createDataFrame([("a.py", "b.py", "import", 1, "resolved")], "source string, target string, type string, line int, resolution string")
    a, b = (R.unified_model(files, extract.facts(files), edges) for _ in range(2))
    assert sorted(a[0].collect()) == sorted(b[0].collect()) and a[0].count() == 2 and a[1].count() == 1
