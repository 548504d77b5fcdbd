"""The source tree as a data source: what filters keep from being opened or listed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan, StringEndsWith, StringStartsWith

from graphloom.sources import scan, tree


def grow(root):
    files = {f"src/p{i}/q{j}/f{k}.py": f"def f{k}(): pass\n" * (k + 1) for i in range(4) for j in range(3) for k in range(3)}
    files |= {"a.py": "x = 1\n", ".hidden/b.py": "", "node_modules/c.js": "no", "src/x.egg-info/d.py": "no", "gen/e.py": "no", "src/p1/big.txt": "y" * 5000, ".gitignore": "gen/\n*.log\n", "src/t.log": "no"}
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "src" / "up").symlink_to(root)
    return {n: t for n, t in files.items() if "no" != t}


def test_the_scan_equals_the_walk(spark, tmp_path, monkeypatch):
    files = grow(tmp_path)
    got = {r.rel_fname: (r.length, bytes(r.content)) for r in scan.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {n: (len(t), t.encode()) for n, t in files.items()} and set(got) == {r.rel_fname for r in tree.tree_files(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(scan, "PLANNED_FOLDERS", 1)
    assert {r.rel_fname for r in scan.scan_tree(spark, f"file://{tmp_path}", "").collect()} == set(files) | {"gen/e.py", "src/t.log"}
    assert scan.scan_tree(spark, str(tmp_path), content=False).filter("content IS NOT NULL").count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    files = grow(tmp_path)
    all_ = scan.scan_tree(spark, str(tmp_path))
    names = lambda df: {r.rel_fname for r in df.collect()}
    assert names(all_.filter("rel_fname = 'src/p1/big.txt'")) == {"src/p1/big.txt"}
    assert names(all_.filter(F.col("rel_fname").isin("a.py", "gen/e.py", "gone.py", "node_modules/c.js", "../a.py"))) == {"a.py"}
    assert names(all_.filter(F.startswith("rel_fname", F.lit("src/p1/")) & (F.col("length") < 40) & F.endswith("rel_fname", F.lit("1.py")))) == {n for n, t in files.items() if n.startswith("src/p1/") and len(t) < 40 and n.endswith("1.py")}
    assert names(all_.filter("rel_fname = 'a.py' AND rel_fname = '.gitignore'")) == set()


def test_nothing_else_is_opened_or_listed(tmp_path, monkeypatch):
    grow(tmp_path)
    opened, listed = [], []
    open_, list_ = scan.Reader._open, scan.Reader._listed
    monkeypatch.setattr(scan.Reader, "_open", lambda self, store, path: (opened.append(path), open_(self, store, path))[1])
    monkeypatch.setattr(scan.Reader, "_listed", lambda self, folder: (listed.append(folder), list_(self, folder))[1])

    def run(*filters):
        opened.clear(), listed.clear()
        reader = scan.SourceTree({"path": str(tmp_path)}).reader(None)
        left = list(reader.pushFilters(list(filters)))
        return left, sorted(r for p in reader.partitions() for b in reader.read(p) for r in b.column("rel_fname").to_pylist())

    assert run(EqualTo(("rel_fname",), "src/p1/q1/f0.py")) == ([], ["src/p1/q1/f0.py"]) and len(opened) == 1 and not listed
    assert run(StringStartsWith(("rel_fname",), "src/p2/q")) == ([], [f"src/p2/q{j}/f{k}.py" for j in range(3) for k in range(3)])
    assert len(opened) == 9 and set(listed) == {"", "src", "src/p2", "src/p2/q0", "src/p2/q1", "src/p2/q2"}
    assert run(GreaterThan(("length",), 1000)) == ([], ["src/p1/big.txt"]) and len(opened) == 1
    left, got = run(LessThan(("length",), 7), StringEndsWith(("rel_fname",), ".py"))
    assert len(left) == 1 and got == [".hidden/b.py", "a.py"]
