"""A small source tree of our own with the tags, aliases and edges that it must give, written down by hand."""

from __future__ import annotations

FILES = {
    "web/list.ts": """import { fetchAll } from './api';
type Handler = (event: Event) => void;
interface Options { onDone: (n: number) => void; cb(x: string): string }
export const first: Handler = (event) => fetchAll<Event>(event);
export abstract class Store<T extends object> extends base(Mixin)<T> {
  @logged save(item: T): void { this.write<T>(item); }
  @retry(3) load = async (id: string): Promise<T> => { return fetchAll(id); };
  abstract drop(): void;
  get(key: string) { return this.read(key)!; }
  #secret() { return first(null); }
  constructor(private size = measure()) { super(); }
}
export function pick(a: string): string;
export function pick(a: any) { return a < 1 && fetchAll > (a) ? first : (new Store<any>()).get(a as string); }
namespace Inner { export function deep(x: unknown): x is string { return first?.(x); } }
""",
    "web/api.js": """const lib = require('lib');
export async function fetchAll(what) { return tag`a ${inner(`b ${what}`)}`; }
function* walk() { yield inner(1); }
const table = { get: function () { return walk(); }, put: (v) => v, run() { return table.get(); }, 'odd': () => 1 };
table.later = function later() { return /re(x)/.test(fetchAll(2)); };
class Box { handler = () => { walk(); }; constructor() { this.open(); } open(a = () => walk()) { return inner(a, "}"); } }
const gen = function* hidden() {};
Box.Close = table;
const Menu = Object.assign(Box, { Item: walk });
function later2(self, click) { self.onClick = click; const M = Object.assign(self, click); }
""",
    "web/view.tsx": """export function View({ items = none() }: Props): JSX.Element {
  const close = () => log("it's");
  return <Panel head={<Title size={measure()} />} {...rest()}>it's {close()} <Menu.Item onPick={() => pick(1)} /><div>{"<Fake />"}</div></Panel>;
}
export const wrap = <T,>(x: T) => (x ? <View /> : <></>);
""",
    "tool/run.py": """@retry(3)
def outer(x):
    def inner():
        return helper(x)
    return x.run(inner())


class Box:
    async def open(self):
        return (lambda: outer(1))()
""",
    "tool/broken.py": "def broken(:\n",
    "tool/notes.rb": "def ruby; end\n",
}

_D, _R = "def", "ref"
#: (file, name, kind, first line, last line), lines from 0; repeated rows are tags of their own.
TAGS = [
    ("web/list.ts", "first", _D, 3, 3), ("web/list.ts", "fetchAll", _R, 3, 3), ("web/list.ts", "base", _R, 4, 4), ("web/list.ts", "save", _D, 5, 5), ("web/list.ts", "write", _R, 5, 5), ("web/list.ts", "load", _D, 6, 6),
    ("web/list.ts", "retry", _R, 6, 6), ("web/list.ts", "fetchAll", _R, 6, 6), ("web/list.ts", "get", _D, 8, 8), ("web/list.ts", "read", _R, 8, 8), ("web/list.ts", "first", _R, 9, 9), ("web/list.ts", "measure", _R, 10, 10),
    ("web/list.ts", "pick", _D, 13, 13), ("web/list.ts", "get", _R, 13, 13), ("web/list.ts", "deep", _D, 14, 14), ("web/list.ts", "first", _R, 14, 14),
    ("web/api.js", "fetchAll", _D, 1, 1), ("web/api.js", "tag", _R, 1, 1), ("web/api.js", "inner", _R, 1, 1), ("web/api.js", "walk", _D, 2, 2), ("web/api.js", "inner", _R, 2, 2), ("web/api.js", "get", _D, 3, 3), ("web/api.js", "walk", _R, 3, 3),
    ("web/api.js", "put", _D, 3, 3), ("web/api.js", "run", _D, 3, 3), ("web/api.js", "get", _R, 3, 3), ("web/api.js", "later", _D, 4, 4), ("web/api.js", "later", _D, 4, 4), ("web/api.js", "test", _R, 4, 4), ("web/api.js", "fetchAll", _R, 4, 4),
    ("web/api.js", "walk", _R, 5, 5), ("web/api.js", "open", _R, 5, 5), ("web/api.js", "open", _D, 5, 5), ("web/api.js", "walk", _R, 5, 5), ("web/api.js", "inner", _R, 5, 5), ("web/api.js", "assign", _R, 8, 8), ("web/api.js", "later2", _D, 9, 9), ("web/api.js", "assign", _R, 9, 9),
    ("web/view.tsx", "View", _D, 0, 3), ("web/view.tsx", "none", _R, 0, 0), ("web/view.tsx", "close", _D, 1, 1), ("web/view.tsx", "log", _R, 1, 1), ("web/view.tsx", "Panel", _R, 2, 2), ("web/view.tsx", "Title", _R, 2, 2), ("web/view.tsx", "measure", _R, 2, 2),
    ("web/view.tsx", "rest", _R, 2, 2), ("web/view.tsx", "close", _R, 2, 2), ("web/view.tsx", "Menu", _R, 2, 2), ("web/view.tsx", "pick", _R, 2, 2), ("web/view.tsx", "wrap", _D, 4, 4), ("web/view.tsx", "View", _R, 4, 4),
    ("tool/run.py", "retry", _R, 0, 0), ("tool/run.py", "outer", _D, 1, 4), ("tool/run.py", "inner", _D, 2, 3), ("tool/run.py", "helper", _R, 3, 3), ("tool/run.py", "run", _R, 4, 4), ("tool/run.py", "inner", _R, 4, 4), ("tool/run.py", "open", _D, 8, 9), ("tool/run.py", "outer", _R, 9, 9),
]
ALIASES = [("web/api.js", "Close", "table"), ("web/api.js", "Menu", "Box")]
#: (caller's file, caller, callee's file, callee, weight, confident): a name of one definition, or one of the same file, is sure.
EDGES = [
    ("web/list.ts", "first", "web/api.js", "fetchAll", 1, True), ("web/list.ts", "load", "web/api.js", "fetchAll", 1, True), ("web/list.ts", "deep", "web/list.ts", "first", 1, True),
    ("web/list.ts", "pick", "web/list.ts", "get", 1, True), ("web/list.ts", "pick", "web/api.js", "get", 1, False),
    ("web/api.js", "fetchAll", "tool/run.py", "inner", 1, True), ("web/api.js", "walk", "tool/run.py", "inner", 1, True), ("web/api.js", "get", "web/api.js", "walk", 1, True), ("web/api.js", "run", "web/api.js", "get", 1, True), ("web/api.js", "run", "web/list.ts", "get", 1, False),
    ("web/api.js", "later", "web/api.js", "fetchAll", 1, True), ("web/api.js", "open", "web/api.js", "walk", 1, True), ("web/api.js", "open", "tool/run.py", "inner", 1, True),
    ("web/view.tsx", "View", "web/view.tsx", "close", 1, True), ("web/view.tsx", "View", "web/list.ts", "pick", 1, True), ("web/view.tsx", "wrap", "web/view.tsx", "View", 1, True),
    ("tool/run.py", "outer", "tool/run.py", "inner", 1, True), ("tool/run.py", "outer", "web/api.js", "run", 1, True), ("tool/run.py", "open", "tool/run.py", "outer", 1, True),
]


def values(rows: list[tuple], *columns: str) -> str:
    """SQL of a fixed table."""
    quote = lambda v: str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({', '.join(columns)})"
