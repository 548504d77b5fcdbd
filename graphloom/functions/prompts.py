"""Prompts as Column expressions: the context bundle, the two stages of an explanation, and summaries of files and clusters."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import related_section

#: What a model is told before every explanation.
SYSTEM = (
    "You explain one function of a code base to a reader who is new to it. Say only what the source, the listed callers and the listed callees show. "
    "Answer the reasoning step in plain sentences, then give one JSON object with the fields role_tag, one_liner, why_it_exists, used_by, calls, side_effects and risk_note. "
    "used_by and calls hold names from the lists and no others; side_effects has one entry an effect; risk_note is null unless the source shows a risk."
)
SUMMARY_SYSTEM = "You write two to four plain sentences on what a group of functions is for. The roles and sentences given for each function hold; do not contradict or repeat them, and say so if the functions look unrelated."

#: The labels of the prompts' parts, and what stands for a role or a summary that is not there.
SOURCE, CALLERS, CALLEES, BUNDLE, REASONING, JSON = "Function source:\n", "\n\nKnown callers: ", "\nKnown callees: ", "\nContext bundle:\n", "\n\nReasoning:", "\n\nJSON:"
FILE, FUNCTIONS, ROOT, PURPOSE = "File: ", "\n\nFunctions:\n", "Root function: ", "\n\nPurpose paragraph:"
NO_ROLE, NO_SUMMARY, NO_ROOT = "unknown role", "no summary available", "  (not yet indexed)"

_FIELDS = ("role_tag", "one_liner", "why_it_exists", "used_by", "calls", "side_effects", "risk_note")


def _example(source: str, callers: list[str], callees: list[str], bundle: str, reasoning: str, *answer: object) -> str:
    slot = f"{SOURCE}{source}{CALLERS}{json.dumps(callers)}{CALLEES}{json.dumps(callees)}{BUNDLE}{bundle}{REASONING}"
    return f"{slot} {reasoning}\n\n{json.dumps(dict(zip(_FIELDS, answer, strict=True)), indent=2)}"


_NONE = "Retrieved context (0), background only:\n  none"
#: Six worked answers: a pure helper, a writer, a guard with a caller, an entry point, a generic wrapper, a function of no neighbours.
EXAMPLES = (
    _example("def area(w, h):\n    return w * h", ["paint_cost"], [], f"Callers (1):\n  - paint_cost (rooms.py:12)\nCallees (0):\n  none\n{_NONE}", "It multiplies two numbers; paint_cost needs the surface of a wall.",
             "geometry helper", "Multiplies a width by a height.", "paint_cost needs the surface that is to be painted.", ["paint_cost"], [], [], None),
    _example("def keep(row):\n    with open('rows.txt', 'a') as f:\n        f.write(row)", ["on_submit"], [], f"Callers (1):\n  - on_submit (form.py:4)\nCallees (0):\n  none\n{_NONE}", "It appends to a file on disk, without a lock.",
             "row writer", "Appends a row to rows.txt.", "on_submit keeps what a visitor sent.", ["on_submit"], [], ["appends to rows.txt"], "Two writers at once may mix their rows."),
    _example("function check(age) {\n  if (age < 0) throw new RangeError('age');\n}", ["register"], [], f"Callers (1):\n  - register (people.js:30)\nCallees (0):\n  none\n{_NONE}", "It rejects negative ages before register goes on.",
             "input validator", "Throws if an age is negative.", "register relies on it to keep impossible ages out.", ["register"], [], [], None),
    _example("async function start() {\n  const db = await connect();\n  serve(db);\n}", [], ["connect", "serve"], f"Callers (0):\n  none\nCallees (2):\n  - connect (db.js:1)\n  - serve (http.js:9)\n{_NONE}", "Nothing in the code calls it; it opens the store and begins to serve.",
             "entry point", "Connects to the database and starts the server.", "It ties connect and serve together when the program begins.", [], ["connect", "serve"], ["opens a connection", "starts a server"], None),
    _example("const once = <T>(f: () => T) => { let v: T; let done = false; return () => (done ? v : ((done = true), (v = f()))); };", ["loadConfig"], [], f"Callers (1):\n  - loadConfig (config.ts:3)\nCallees (0):\n  none\n{_NONE}", "It remembers the first result, so f runs once.",
             "caching wrapper", "Wraps a function so that it runs at most once.", "loadConfig should read its file a single time.", ["loadConfig"], [], [], None),
    _example("def is_blank(s):\n    return not s.strip()", [], [], f"Callers (0):\n  none\nCallees (0):\n  none\n{_NONE}", "It has no neighbours; it tests a string for visible characters.",
             "text helper", "Tells whether a string holds nothing but spaces.", "A small test of its own, used from outside of the indexed code if at all.", [], [], [], None),
)
RULE = "\n\n---\n\n"


def retrieved_section(chunks: Column) -> Column:
    """Lines about array<struct<rel_fname, start_line, end_line, text>>: lines are shown from 1, texts indented."""
    lines = lambda c: F.concat(
        F.lit("  - "), c["rel_fname"], F.lit(":"), (c["start_line"] + 1).cast("string"), F.lit("-"), c["end_line"].cast("string"), F.lit("\n      "), F.array_join(F.split(c["text"], "\n", -1), "\n      ")
    )
    n = F.size(chunks)
    head = F.concat(F.lit("Retrieved context ("), n.cast("string"), F.lit("), background only:"))
    return F.concat(head, F.lit("\n"), F.when(n == 0, "  none").otherwise(F.array_join(F.transform(chunks, lines), "\n")))


def context_bundle(callers: Column, callers_omitted: Column, callees: Column, callees_omitted: Column, retrieved: Column) -> Column:
    """The three sections of a function's context; arrays as related_section() and retrieved_section() take them."""
    return F.concat_ws("\n", related_section("caller", callers, callers_omitted), related_section("callee", callees, callees_omitted), retrieved_section(retrieved))


def input_slot(source: Column, callers: Column, callees: Column, bundle: Column) -> Column:
    """The part of both stages that is about the function itself; callers and callees are arrays of names."""
    return F.concat(F.lit(SOURCE), source, F.lit(CALLERS), F.to_json(callers), F.lit(CALLEES), F.to_json(callees), F.lit(BUNDLE), bundle, F.lit(REASONING))


def reasoning_prompt(source: Column, callers: Column, callees: Column, bundle: Column) -> Column:
    """First stage: worked answers, then the function; the model goes on in free text up to a brace."""
    return F.concat(F.lit(RULE.join(EXAMPLES) + RULE), input_slot(source, callers, callees, bundle))


def json_prompt(source: Column, callers: Column, callees: Column, bundle: Column, reasoning: Column) -> Column:
    """Second stage: the function with the reasoning of the first; the model answers with the JSON object."""
    return F.concat(input_slot(source, callers, callees, bundle), F.lit(" "), F.trim(F.coalesce(reasoning, F.lit(""))), F.lit(JSON))


NO_CALLERS = "  none"


def _given(x: Column, default: str) -> Column:
    return F.coalesce(F.when(F.trim(x) != "", x), F.lit(default))


def summary_line(name: Column, role: Column, one_liner: Column, depth: Column | None = None) -> Column:
    place = F.lit("") if depth is None else F.concat(F.lit("depth "), F.coalesce(depth.cast("string"), F.lit("?")), F.lit(", "))
    return F.concat(F.lit("  - "), name, F.lit(" ("), place, _given(role, NO_ROLE), F.lit("): "), _given(one_liner, NO_SUMMARY))


def file_summary_prompt(rel_fname: Column, functions: Column) -> Column:
    """functions: array<struct<name, role_tag, one_liner>> in rank order."""
    lines = F.transform(functions, lambda f: summary_line(f["name"], f["role_tag"], f["one_liner"]))
    return F.concat(F.lit(FILE), rel_fname, F.lit(FUNCTIONS), F.array_join(lines, "\n"), F.lit(PURPOSE))


def cluster_summary_prompt(name: Column, role: Column, one_liner: Column, callers: Column) -> Column:
    """callers: array<struct<name, role_tag, one_liner, depth>> in rank order; role and one_liner are null where the root has none yet."""
    return cluster_prompt_of(name, role, one_liner, F.when(F.size(callers) == 0, NO_CALLERS).otherwise(cluster_lines(callers)))


def cluster_lines(callers: Column) -> Column:
    """The callers' lines; where many roots have the same callers, make them once."""
    return F.array_join(F.transform(callers, lambda c: summary_line(c["name"], c["role_tag"], c["one_liner"], c["depth"])), "\n")


def cluster_prompt_of(name: Column, role: Column, one_liner: Column, listed: Column) -> Column:
    """cluster_summary_prompt() with cluster_lines() made before, or NO_CALLERS."""
    known = F.concat(F.lit("  ("), _given(role, NO_ROLE), F.lit("): "), _given(one_liner, NO_SUMMARY))
    root = F.when((F.trim(F.coalesce(role, F.lit(""))) == "") & (F.trim(F.coalesce(one_liner, F.lit(""))) == ""), NO_ROOT).otherwise(known)
    return F.concat(F.lit(ROOT), name, F.lit("\n"), root, F.lit("\n\nKnown callers, direct or through others, most important first:\n"), listed, F.lit(PURPOSE))
