"""Parsing, discovery and ignore rules."""

from __future__ import annotations

from graphloom.operators import vectors as V
from graphloom.sources import parse, script, tree

PY = '''@wrap(1)
def outer(x):
    def inner():
        return helper(x)
    return x.run(inner())


class Box:
    async def open(self):
        pass
'''
JS = """import x from 'x';
const add = (a, b) => a + b;
function main(n) { const s = `t ${add(1, 2)}`; return obj.run(s, /re(x)/g); }
class Box {
  constructor() { this.init(); }
  open(a) { return add(a, "}"); }
  handler = () => { main(1); };
}
const api = { get: function () { return main(2); }, put: (v) => v };
module.exports.stop = function stop() {};
function* gen() { yield add(1, 2); }
Box.Close = open;
Object.assign(Box, { Item, Other: main });
const Whole = Object.assign(Box, { Item });
const lib = require('lib'); // add(3)
"""
TSX = "export function View(): JSX.Element { return <Panel><Menu.Item x={go()} /><div /></Panel>; }\n"


def test_python_tags():
    t = parse.extract_tags("a.py", PY)
    assert [(x.name, x.start_line) for x in t if x.kind == "def"] == [("outer", 1), ("inner", 2), ("open", 8)]
    assert sorted(x.name for x in t if x.kind == "ref") == ["helper", "inner", "run", "wrap"]
    outer = next(x for x in t if x.name == "outer")
    assert PY.encode()[outer.start_byte : outer.end_byte].startswith(b"def outer")
    assert parse.extract_tags("a.py", "def broken(:") == [] and parse.extract_tags("a.rb", PY) == []


def test_script_tags_and_aliases():
    t = parse.extract_tags("a.js", JS)
    defs, refs = [x.name for x in t if x.kind == "def"], sorted(x.name for x in t if x.kind == "ref")
    assert sorted(defs) == ["add", "gen", "get", "main", "open", "put", "stop", "stop"]  # a class field is one in TypeScript only
    assert [x.name for x in parse.extract_tags("a.ts", JS) if x.name == "handler"] == ["handler"]
    assert refs.count("add") == 3 and refs.count("main") == 2 and "require" not in refs and "run" in refs
    assert parse.extract_aliases("a.js", JS) == [("Close", "open"), ("Whole", "Box")]


def test_components_by_case():
    t = parse.extract_tags("a.tsx", TSX)
    assert [x.name for x in t if x.kind == "def"] == ["View"]
    assert sorted(x.name for x in t if x.kind == "ref") == ["Menu", "Panel", "go"]


def test_discovery_and_graph(spark, tmp_path):
    for name, text in {"src/a.py": "def f():\n    g()\n", "src/b.py": "def g():\n    pass\n", "node_modules/x.js": "function no() {}", "x.egg-info/y.py": "def no(): pass", "gen/z.py": "def no(): pass", "notes.txt": "f()"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = tree.discover(spark, str(tmp_path), "gen/\n")
    assert sorted(r.rel_fname for r in files.collect()) == ["src/a.py", "src/b.py"]
    from graphloom.operators import graph as G

    g = G.call_graph(tree.parse_tags(files), tree.parse_aliases(files)).collect()
    assert [(x.caller_name, x.callee_name, x.confident) for x in g] == [("f", "g", True)]


def test_ignore_rules(spark):
    rules = tree.ignore_rules("*.log\n!keep.log\n/top\ndocs/**/x.md\n")
    df = spark.createDataFrame([("a/b.log",), ("keep.log",), ("top/q",), ("a/top",), ("docs/a/x.md",)], "p string")
    from pyspark.sql import functions as F

    assert [r.p for r in df.filter(tree.ignored(F.col("p"), rules)).collect()] == ["a/b.log", "top/q", "docs/a/x.md"]


def test_chunks():
    assert [(a, b) for a, b, _ in V.chunk_lines(["x"] * 25)] == [(0, 12), (12, 24), (24, 25)]
    assert [(a, b, len(t)) for a, b, t in V.chunk_lines(["y" * 1050])] == [(0, 1, 500), (0, 1, 500), (0, 1, 50)]
    assert list(V.chunk_lines(["", "  "])) == []
    assert [(a, b) for a, b, _ in V.chunk_lines(["a" * 300, "b" * 300])] == [(0, 1), (1, 2)]


def test_embedding_keeps_order_and_checks_counts(spark):
    import pytest

    chunks = spark.createDataFrame([("f", i, i + 1, f"t{i}") for i in range(150)], "rel_fname string, start_line int, end_line int, text string")
    assert V.embed_chunks(chunks).count() == 150
    with pytest.raises(Exception, match="vectors"):
        V.embed_chunks(chunks, lambda texts: []).collect()


def test_typed_shapes():
    """Types, signatures and default values define nothing; what follows them is found."""
    text = """
const f: Map<string, (a: number) => void> = (a) => go(a);
const g = (x?: { a: () => void }): x is Foo<Bar<string>> => stop(x);
type T = { [K in keyof U]?: (x: K) => V } | ((a: string) => asserts a is B);
interface I<A extends (x: any) => any> extends J<A> { (x: A): void; new (x: A): I<A>; m?<B>(b: B): B; readonly p: () => void }
declare function ext(a: string): void;
enum E { A = one(), B = 1 << 2 }
class C { static x = (a) => a; declare y: () => void; accessor z = 1; static { init(); } async *it<T>(this: C, @In() a?: T) { yield* all(a); } 'quoted'() {} [comp()]() {} set v(x) {} }
const h = async <T extends object>(x: T): Promise<void> => { await x?.m?.(1); };
export default async function () { for await (const x of list()) { const { a = () => 1, ...b } = x; } }
const n = cond ? { a: () => 1 } : (b as Fn)(2);
const k = function named<T>(this: T) { return new Map<string, Foo>([[1, call(2)]]); };
let s = a / b / c; const r = /['"`{(]/.test(s) ? `${(() => deep(`x${1}`))()}` : 'no()';
o.p.q = async () => {}; o['r'] = () => {}; x ||= () => {};
if (a) b(); else c();
do { d(); } while (e());
"""
    t = parse.extract_tags("a.ts", text)
    assert [x.name for x in t if x.kind == "def"] == ["f", "g", "x", "it", "v", "h", "a", "k", "named", "q"]
    assert sorted(x.name for x in t if x.kind == "ref") == sorted(["go", "stop", "one", "init", "In", "all", "comp", "m", "list", "call", "test", "deep", "b", "c", "d", "e"])
    assert parse.extract_tags("m.ts", "export interface A { f: (x) => void }\nexport type B = () => A;\nexport enum D { X }\n") == []


def test_lines_and_bytes_of_wide_text():
    text = "// é𝄞\nconst ü = () => {\n  run('é');\n};\n"
    t = {x.name: x for x in parse.extract_tags("a.js", text)}
    assert (t["ü"].start_line, t["ü"].end_line, t["run"].start_line) == (1, 3, 2)
    assert text.encode()[t["run"].start_byte : t["run"].end_byte].decode() == "run('é')"
    assert text.encode()[t["ü"].start_byte : t["ü"].end_byte].decode().startswith("ü = () =>")


def test_broken_sources_end(spark):
    import random

    rng = random.Random(3)
    pieces = ["function f(", "{", "}", "(", ")", "[", "]", "<", ">", "`", "${", "=>", "class A", "x", "=", ":", ",", ";", "'", "/", "<A", "/>", "async", "new", "type T =", "@", "\n", "return", "?"]
    for _ in range(400):
        text = " ".join(rng.choices(pieces, k=25))
        for name in ("a.ts", "a.tsx", "a.js"):
            parse.extract_tags(name, text)
            parse.extract_aliases(name, text)


def test_a_language_can_be_registered(spark):
    from graphloom.sources import manifest

    before = list(manifest.LANGUAGES)
    try:
        ruby = manifest.Language("ruby", (".rb",), ("vendor",), parser="ruby")
        parse.register(ruby, parse.Parser(lambda text, language: [parse.Tag(w, "def", i, i, 0, 0, "function") for i, line in enumerate(text.splitlines()) for w in [line.partition("def ")[2]] if w]))
        files = spark.createDataFrame([("a.rb", b"x\ndef one\ndef two\n"), ("vendor/b.rb", b"def no\n")], "rel_fname string, content binary")
        kept = tree.with_language(files.filter(~tree.in_excluded_dir(files["rel_fname"])))
        assert [(r.name, r.start_line) for r in tree.parse_tags(kept).collect()] == [("one", 1), ("two", 2)]
    finally:
        manifest.LANGUAGES[:] = before
        parse.PARSERS.pop("ruby", None)


def test_the_root_ignore_file_is_read(spark, tmp_path):
    for name, text in {".gitignore": "gen/\n", "a.py": "def f(): pass\n", "gen/b.py": "def g(): pass\n", "sub/.gitignore": "c.py\n", "sub/c.py": "def h(): pass\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "sub" / "__init__.py").write_text("")
    (tmp_path / "sub" / "up").symlink_to(tmp_path)
    assert sorted(r.rel_fname for r in tree.discover(spark, str(tmp_path)).collect()) == ["a.py", "sub/__init__.py", "sub/c.py"]
    assert sorted(r.rel_fname for r in tree.tree_paths(spark, str(tmp_path)).collect()) == [".gitignore", "a.py", "sub/.gitignore", "sub/__init__.py", "sub/c.py"]
    assert sorted(r.rel_fname for r in tree.discover(spark, f"file://{tmp_path}", "").collect()) == ["a.py", "gen/b.py", "sub/__init__.py", "sub/c.py"]


def test_ignore_patterns_by_a_table(spark):
    """Pattern, paths that it ignores, paths that it does not."""
    from pyspark.sql import functions as F

    table = [
        ("[ab].js", ["a.js", "x/b.js"], ["c.js", "ab.js", "a.jsx"]),
        ("[a-c]x", ["ax", "cx", "bx/y"], ["dx", "-x"]),
        ("[!a-c]x", ["dx", "q/zx"], ["ax", "/x"]),
        ("[^a]b", ["cb"], ["ab"]),
        ("[]x]y", ["]y", "xy"], ["y", "zy"]),
        ("[a\\]]z", ["az", "]z"], ["\\z"]),
        ("[-a]q", ["-q", "aq"], ["bq"]),
        ("[[:digit:][:upper:]]*.log", ["1.log", "Ab.log"], ["ab.log"]),
        ("[z-a]w", [], ["aw", "zw", "w"]),
        ("a[b", ["a[b"], ["ab", "a"]),
        ("\\#note", ["#note"], ["note"]),
        ("\\!keep", ["!keep"], ["keep"]),
        ("\\*.c", ["*.c"], ["a.c"]),
        ("q\\?", ["q?"], ["qa"]),
        ("sp\\ ", ["sp "], ["sp"]),
        ("trail  ", ["trail"], ["trail  "]),
        ("a?c", ["abc", "d/axc"], ["a/c", "ac"]),
        ("foo/*", ["foo/a", "foo/b/c"], ["foo", "x/foo/a"]),
        ("**/foo", ["foo", "a/foo", "a/b/foo/x"], ["afoo", "foox"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "x/a/b"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/xb", "ab"]),
        ("a**b", ["ab", "axxb"], ["a/b"]),
        ("/top.txt", ["top.txt"], ["x/top.txt"]),
        ("dir/", ["dir/a", "x/dir/b"], ["dir"]),
        ("x.y+(z)", ["x.y+(z)"], ["xay+(z)", "x.yy(z)"]),
        ("[&&a]k", ["&k", "ak"], ["bk"]),
        ("# comment", [], ["# comment", "comment"]),
    ]
    paths = sorted({p for _, yes, no in table for p in yes + no})
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select("p", *[tree.ignored(F.col("p"), tree.ignore_rules(t)).alias(f"t{i}") for i, (t, _, _) in enumerate(table)]).collect()
    hit = {(i, r.p) for r in got for i in range(len(table)) if r[f"t{i}"]}
    assert {(t, p) for i, (t, yes, _) in enumerate(table) for p in yes if (i, p) not in hit} == set()
    assert {(t, p) for i, (t, _, no) in enumerate(table) for p in no if (i, p) in hit} == set()
    assert tree.ignore_rules("!\n/\n\n") == [] and [k for k, _ in tree.ignore_rules("*.a\n!b.a\n")] == [True, False]


def test_copies_of_a_text_are_parsed_once_in_a_task(spark, tmp_path, monkeypatch):
    """A text of two languages is two; texts beyond what a task keeps are parsed again; rows come for every copy."""
    monkeypatch.setattr(tree, "KEPT_CHARS", 20)
    log = tmp_path / "log"
    texts = [("a.js", "f(1)"), ("b.js", "f(1)"), ("c.ts", "f(1)"), ("d.js", ""), ("e/a.js", "f(1)"), ("g.js", "f(2)" * 9), ("h.js", "f(3)"), ("i.js", "f(1)"), ("k.js", "f(1)")]

    def parse(registry, path, text):
        with log.open("a") as f:
            f.write(path + "\n")
        return tuple(zip(*registry.tags(path, text), strict=True)) if not text else (["n"] * 2, ["t"] * 2)

    files = spark.createDataFrame([(p, t.encode()) for p, t in texts], "rel_fname string, content binary").coalesce(1)
    out = [tuple(r) for r in tree._parsed(files, tree.ALIAS_SCHEMA, parse).collect()]
    assert out == [(p, "n", "t") for p, t in texts if t for _ in range(2)]
    assert log.read_text().split() == ["a.js", "c.ts", "d.js", "g.js", "h.js", "i.js"]


def test_a_text_that_can_hold_no_alias_is_not_parsed_for_aliases(monkeypatch):
    for text in ("Box.Close = table", "Box?.Close=table", "a . /* b */ c // d\n = e", "a.#p = b", "a.$ = b", "const M = Object.assign(Box, {})", "const M = Object // c\n .assign(Box)"):
        assert script.may_alias(text)
    monkeypatch.setattr(parse, "Script", None)
    for text in ("", "function f() { return g(1); }", "a.b == c", "a.b => c", "x = a.b(c)", "let assigned = 1.5", "a." + "// " * 5_000 + "\n" + "/* " * 5_000):
        assert parse.extract_aliases("a.ts", text) == []
