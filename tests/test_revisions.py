"""Commits of repositories: whole or not at all, empty ones too, stale writers fail."""

import pytest

from tessera.sources import revisions


def rows(spark, *given):
    return spark.createDataFrame(list(given), "repository string, path string, content string")


def names(spark, *given):
    return spark.createDataFrame([(g,) for g in given], "repository string")


def held(spark, path, revision=None):
    return sorted((r.repository, r.path, r.content) for r in revisions.current(spark, path, revision).collect())


def test_commits(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert revisions.head(spark, path) == 0
    assert revisions.commit(rows(spark, ("a", "x", "1"), ("a", "y", None), ("b b/c=%", "x", "2")), path) == 1
    before = revisions.current(spark, path)
    assert revisions.commit(rows(spark, ("a", "z", "3")), path, names(spark, "a", "new")) == 2
    assert held(spark, path) == [("a", "z", "3"), ("b b/c=%", "x", "2")]
    assert sorted(r.path for r in before.collect()) == ["x", "x", "y"] and len(held(spark, path, 1)) == 3
    assert revisions.commit(rows(spark), path, names(spark, "a")) == 3  # became empty
    assert held(spark, path) == [("b b/c=%", "x", "2")]
    jobs = {(r.repository, r.revision, r.n_files) for r in revisions.entries(spark, path).collect()}
    assert jobs == {("a", 3, 0), ("b b/c=%", 1, 1), ("new", 2, 0)}


def test_stale_writers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    revisions.commit(rows(spark, ("a", "x", "1"), ("b", "x", "1")), path)
    seen = revisions.head(spark, path)
    assert revisions.commit(rows(spark, ("a", "x", "2")), path, since=seen) == 2
    assert revisions.commit(rows(spark, ("b", "x", "2")), path, since=seen) == 3  # of another repository
    with pytest.raises(revisions.StaleWriter):
        revisions.commit(rows(spark, ("a", "x", "3")), path, since=seen)
    assert held(spark, path) == [("a", "x", "2"), ("b", "x", "2")] and revisions.head(spark, path) == 3
    assert len(list((tmp_path / "t" / "data").glob("commit=*"))) == 3 and not list((tmp_path / "t" / "staging").iterdir())


@pytest.mark.parametrize("given, only", [([("a", "x", "1"), ("a", "x", "2")], None), ([(None, "x", "1")], None), ([("a", "x", "1")], "b")])
def test_refused(spark, tmp_path, given, only):
    path = f"file://{tmp_path}/t"
    with pytest.raises(ValueError):
        revisions.commit(rows(spark, *given), path, names(spark, only) if only else None)
    assert revisions.head(spark, path) == 0 and not list((tmp_path / "t").glob("data/*"))


def test_race_and_vacuum(spark, tmp_path, monkeypatch):
    """Another writer takes the revision between the look and the rename."""
    path, first, moved = f"file://{tmp_path}/t", [True], revisions._moved

    def late(s, source, target):
        if "/log/" in target and first:
            first.clear()
            revisions.commit(rows(spark, ("other", "x", "0")), path)
        return moved(s, source, target)

    monkeypatch.setattr(revisions, "_moved", late)
    assert revisions.commit(rows(spark, ("a", "x", "1")), path) == 2
    assert held(spark, path) == [("a", "x", "1"), ("other", "x", "0")]
    revisions.commit(rows(spark, ("a", "x", "2")), path)
    revisions.commit(rows(spark, ("a", "x", "3")), path)
    assert revisions.vacuum(spark, path, keep=2) == 1 and held(spark, path, 3) == [("a", "x", "2"), ("other", "x", "0")]
    assert held(spark, path) == [("a", "x", "3"), ("other", "x", "0")]
