"""Two states of a tree, compared by digests of folders."""

from __future__ import annotations

from graphloom.operators import merkle


def state(spark, folder, files):
    return merkle.TreeState(spark, str(folder)).write(spark.createDataFrame(list(files.items()), "rel_fname string, digest string"))


def test_changed_files_and_folders_that_stay_closed(spark, tmp_path):
    old = {f"same/{i}/{k}.py": f"{i}{k}" for i in range(5) for k in range(3)} | {"a.py": "1", "src/b.py": "2", "src/deep/er/c.py": "3", "src/deep/er/d.py": None, "gone/x.py": "4", "kind": "5", "swap/p.py": "6", "swap/q.py": "7"}
    new = {k: v for k, v in old.items() if k not in ("gone/x.py", "kind")} | {"a.py": "1+", "src/deep/er/c.py": "3+", "fresh/y.py": "8", "kind/z.py": "9", "swap/p.py": "7", "swap/q.py": "6"}
    changes, opened = merkle.changed_files(state(spark, tmp_path / "old", old), state(spark, tmp_path / "new", new))
    assert {(r.rel_fname, r.change) for r in changes.collect()} == {
        ("a.py", "changed"), ("src/deep/er/c.py", "changed"), ("gone/x.py", "removed"), ("fresh/y.py", "added"), ("kind", "removed"), ("kind/z.py", "added"), ("swap/p.py", "changed"), ("swap/q.py", "changed"),
    }
    assert {r.path for r in opened.collect()} == {"", "src", "src/deep", "src/deep/er", "gone", "fresh", "kind", "swap"}
    same, none = merkle.changed_files(state(spark, tmp_path / "o2", old), state(spark, tmp_path / "o3", dict(reversed(old.items()))))
    assert same.count() == 0 and none.count() == 0
    root = merkle.digests(spark.createDataFrame([("x/y", "1"), ("x/y", "1")], "rel_fname string, digest string")).filter("depth = 0").first()
    assert root.files == 1 and root.path == "" and root.parent is None
