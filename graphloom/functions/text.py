"""Scalar functions as Column expressions: keys and hashes, ids, labels, settings, report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Role categories in their order of precedence, with the substrings of a role that name them and an icon.
ROLES = [
    ("validator", ["valid", "guard", "sanitiz", "verify", "check"], "✅"),
    ("persister", ["persist", "store", "database", "db", "repository", "reader", "writer", "loader", "fetch", "save", "cache"], "💾"),
    ("middleware", ["middleware", "interceptor", "wrapper", "decorator"], "🔀"),
    ("handler", ["handler", "route", "controller", "endpoint", "listener", "callback", "dispatch"], "🔧"),
    ("test", ["test", "mock", "stub", "fixture", "spec"], "🧪"),
    ("config", ["config", "setup", "init", "bootstrap", "factory"], "⚙️"),
    ("utility", ["util", "helper", "format", "pars", "convert", "transform", "serializ"], "🧰"),
]
GENERIC_ICON, PENDING_TITLE = "❔", "○ not indexed yet"


def _any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def fn_id(rel_file: Column, qualified: Column) -> Column:
    return F.concat(rel_file, F.lit("::"), qualified)


def cache_key(source: Column, context_hash: Column, model: Column, embedding: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(source, context_hash, model, embedding, prompt), 256)


def set_hash(member: Column, separator: str = "") -> Column:
    """Aggregate: hash of the members in order, whatever order they came in."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(member)), separator), 256)


def id_file(x: Column) -> Column:
    """What stands before the first '::'; without one, the whole id."""
    return F.substring_index(x, "::", 1)


def id_qualified(x: Column) -> Column:
    """What stands after the first '::'; without one, the whole id."""
    at = F.instr(x, "::")
    return F.when(at > 0, F.substring(x, at + 2, F.length(x))).otherwise(x)


def id_name(x: Column) -> Column:
    """The bare name: after the last '::', without a '#n' and without what encloses it."""
    bare = F.regexp_replace(F.substring_index(x, "::", -1), r"#[0-9]+$", "")
    name = F.substring_index(bare, ".", -1)
    return F.when(name == "", x).otherwise(name)


def role_category(role: Column) -> Column:
    low, out = F.lower(role), None
    for name, words, _ in ROLES:
        out = F.when(_any_of(low, words), name) if out is None else out.when(_any_of(low, words), name)
    return out.otherwise("generic")


def role_icon(category: Column) -> Column:
    icons = F.create_map(*[F.lit(x) for name, _, icon in ROLES for x in (name, icon)])
    return F.coalesce(F.element_at(icons, category), F.lit(GENERIC_ICON))


def binary_head(content: Column) -> Column:
    """Whether the first 1,024 bytes hold a NUL or are not valid UTF-8 (a character cut at their end counts)."""
    head = F.substring(content, 1, 1024).cast("string")
    return F.contains(head, F.lit("\x00")) | ~F.is_valid_utf8(head)


def lens_title(role: Column, cached: Column) -> Column:
    named = F.when(F.trim(F.coalesce(role, F.lit(""))) == "", "Unknown").otherwise(role)
    return F.when(~cached, PENDING_TITLE).otherwise(F.concat(role_icon(role_category(named)), F.lit(" "), named))


def duration(ms: Column) -> Column:
    minutes = F.floor(ms / 60000 + 0.5)
    hours, rest = F.floor(minutes / 60).cast("string"), F.pmod(minutes, F.lit(60))
    text = F.when(rest > 0, F.concat(hours, F.lit("h "), rest.cast("string"), F.lit("m"))).otherwise(F.concat(hours, F.lit("h")))
    return F.when(minutes < 1, "under a minute").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(text)


#: Seconds of the units in which an age is told.
UNITS = [("year", 31536000), ("month", 2592000), ("day", 86400), ("hour", 3600), ("minute", 60)]


def age(seconds: Column) -> Column:
    """'3 days ago' of an age in seconds; null stays null."""
    out = None
    for name, size in UNITS:
        n = F.floor(seconds / size)
        text = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        out = F.when(n >= 1, text) if out is None else out.when(n >= 1, text)
    return F.when(seconds.isNotNull(), out.otherwise("just now"))


def short_path(path: Column, most: int) -> Column:
    """The path cut in its middle to at most `most` characters; the file's name stays whole where it fits."""
    parts = F.split(path, "/", -1)
    base = F.element_at(parts, -1)
    room = F.lit(most) - F.length(base) - 2
    joined = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    front = F.filter(joined, lambda x: (F.length(x) <= room) & (F.size(parts) > 1))
    last = F.coalesce(F.get(front, F.size(front) - 1), F.lit(""))
    front_text = F.when(last == "", F.substring(path, F.lit(1), room)).otherwise(last)
    return F.when(F.length(path) <= most, path).when(room <= 0, F.concat(F.lit("…"), F.right(base, F.lit(most - 1)))).otherwise(F.concat(front_text, F.lit("…/"), base))


def first_sentence(x: Column) -> Column:
    first = F.get(F.split(x, r"(?<=[.!?])\s"), 0)
    return F.when(first == "", x).otherwise(first)


def table_cell(x: Column) -> Column:
    return F.replace(x, F.lit("|"), F.lit("\\|"))


def detail_line(role: Column, one_liner: Column) -> Column:
    return F.concat_ws(" — ", F.when(F.trim(role) != "", role), F.when(F.trim(one_liner) != "", one_liner))


def poll_interval(in_flight: Column, idle_seconds: Column) -> Column:
    return F.when((in_flight > 0) | (idle_seconds < 2.0), 0.02).otherwise(0.25)


def restart_delay(attempt: Column) -> Column:
    """Milliseconds before a restart; null once five were tried."""
    return F.when(attempt < 5, F.least(2000 * F.pow(F.lit(2), attempt - 1), F.lit(30000))).cast("long")


def failure_cause(spawn_error: Column, has_child: Column, ended: Column) -> Column:
    return F.when(spawn_error, "spawn-failed").when(~has_child, "unknown").when(ended, "process-crashed").otherwise("slow-first-index")


def top_n_setting(x: Column) -> Column:
    return F.when(x >= 1, F.floor(x)).otherwise(200).cast("long")


def flush_setting(x: Column) -> Column:
    return F.when(x >= 5, x).otherwise(25.0)


def loopback(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.regexp_replace(host, r"^\[|\]$", "").isin("localhost", "127.0.0.1", "::1")


def function_like(kind: Column, detail: Column) -> Column:
    return kind.isin("Function", "Method", "Constructor") | (kind.isin("Variable", "Field", "Property") & detail.rlike(r"=>|\bfunction\b"))


def subsequence_match(text: Column, query: str) -> Column:
    """Rank of a fuzzy match: 2 for a substring, 1 for the characters in order, 0 for none; case is ignored."""
    import re

    low = F.lower(text)
    spread = "(?s)" + ".*".join(re.escape(c) for c in query.lower())
    return F.when(F.contains(low, F.lit(query.lower())), 2).when(low.rlike(spread), 1).otherwise(0)


def freshness(dirty: Column, stale: Column) -> Column:
    return F.when(dirty, "dirty").when(stale, "stale").otherwise("fresh")


def keep_known(names: Column, known: Column) -> Column:
    """names without those that known lacks; order and repeats stay."""
    return F.filter(names, lambda n: F.array_contains(known, n))


#: Substrings that mark a placeholder.
PLACEHOLDERS = ["n/a", "tbd", "todo", "and more", "etc."]
#: The words of a denial.
_NEGATION = r"(?:\bno\b|\bnot\b|\bnone\b|\bnever\b|\bwithout\b|\bdoesn'?t\b|\bdoes\s+not\b|\bdon'?t\b|\bdo\s+not\b)"
#: Patterns of an answer that contradicts itself or repeats the instructions' own words.
NO_CALLEES = "(?i)" + _NEGATION + r"[^.]{0,20}\bcall(?:s|ees?|ing)?\b"
NO_CALLERS = "(?i)" + _NEGATION + r"[^.]{0,20}\bcallers?\b"
BOILERPLATE = [
    r"(?i)\b(?:reads?|reading|writes?|writing)\s+(?:a|the)?\s*file\b",
    r"(?i)\bsend(?:s|ing)?\s+(?:a|the)?\s*message\s+or\s+notification\b",
    r"(?i)\bmutat(?:es?|ing)\s+(?:a|the)?\s*parameter\s+or\s+global\b",
]


def _text_issues(role: Column, one_liner: Column, why: Column, risk: Column) -> list[Column]:
    found = [F.when(F.regexp_count(F.trim(one_liner), F.lit(r"[.!?](\s|$)")) > 1, "one_liner of several sentences")]
    for field, x in (("role_tag", role), ("one_liner", one_liner), ("why_it_exists", why), ("risk_note", risk)):
        found += [F.when(F.contains(F.lower(x), F.lit(p)), f"{field} has {p}") for p in PLACEHOLDERS]
    return found


def quality_issues(role: Column, one_liner: Column, why: Column, risk: Column) -> Column:
    """Defects of an explanation's texts, as an array of names."""
    empty = [F.when(F.trim(F.coalesce(x, F.lit(""))) == "", f"empty {name}") for name, x in (("role_tag", role), ("one_liner", one_liner))]
    return F.array_compact(F.array(*empty, *_text_issues(role, one_liner, why, risk)))


#: The fields that an explanation must have.
REQUIRED = ("role_tag", "one_liner", "why_it_exists", "used_by", "calls", "side_effects", "risk_note")


def json_kind(answer: Column, field: str) -> Column:
    """The kind of a field of a JSON object: STRING, VOID (null), ARRAY<STRING>, BIGINT, ...; null where the field is missing or the text is no object."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(answer), f"$.{field}", "variant"))


def json_string(answer: Column, field: str) -> Column:
    """A field of a JSON object if it is a string, else null: numbers and objects are not read as text."""
    return F.when(json_kind(answer, field) == "STRING", F.try_variant_get(F.try_parse_json(answer), f"$.{field}", "string"))


def json_issues(answer: Column) -> Column:
    """Defects of an explanation as JSON text, as an array of names: missing fields alone if there are any, else wrong kinds and the texts' own."""
    role, one, why, risk = (json_string(answer, f) for f in ("role_tag", "one_liner", "why_it_exists", "risk_note"))
    missing = F.array_compact(F.array(*[F.when(json_kind(answer, f).isNull(), f"missing field: {f}") for f in REQUIRED]))
    kinds = [F.when(F.trim(F.coalesce(x, F.lit(""))) == "", f"{f} is empty or no string") for f, x in (("role_tag", role), ("one_liner", one))]
    kinds += [F.when(~json_kind(answer, f).isin("ARRAY<STRING>", "ARRAY<VOID>"), f"{f} is no list of strings") for f in ("used_by", "calls", "side_effects")]
    kinds += [F.when(~json_kind(answer, "risk_note").isin("STRING", "VOID"), "risk_note is neither a string nor null")]
    return F.when(F.size(missing) > 0, missing).otherwise(F.array_compact(F.array(*kinds, *_text_issues(role, one, why, risk))))


def quality_notes(why: Column, effects: Column, used_by: Column, calls: Column, given: Column) -> Column:
    """Doubts about an explanation that a reader should look at, as an array of names."""
    joined = F.array_join(effects, " ")
    hits = sum((joined.rlike(p).cast("int") for p in BOILERPLATE), F.lit(0))
    found = [
        F.when(F.exists(effects, lambda e: F.regexp_count(e, F.lit(",")) >= 2), "effects joined by commas"),
        F.when(hits >= 2, "boilerplate effects"),
        F.when((F.size(calls) > 0) & why.rlike(NO_CALLEES), "denies its callees"),
        F.when((F.size(used_by) > 0) & why.rlike(NO_CALLERS), "denies its callers"),
        F.when(F.contains(F.lower(why), F.lit("unknown")), "says unknown"),
        F.when((F.size(given) > 0) & ~F.exists(given, lambda g: F.contains(why, g)), "names no neighbour"),
    ]
    return F.array_compact(F.array(*found))


#: The lines of a section of callers or callees.
TOP_LINE, FULL_LINE, NO_LINE = "  Most significant (top 3, ranked by importance):", "  Full list (most significant first):", "  none"


def related_section(noun: str, related: Column, omitted: Column) -> Column:
    """Lines about callers or callees: struct<name, file, line> in rank order, and how many are left out."""
    line = lambda indent: lambda c: F.concat(F.lit(indent), c["name"], F.lit(" ("), c["file"], F.lit(":"), c["line"].cast("string"), F.lit(")"))
    n = F.size(related)
    top = F.concat(F.array(F.lit(TOP_LINE)), F.transform(F.slice(related, 1, 3), line("    - ")), F.array(F.lit(FULL_LINE)))
    rows = F.concat(F.when(n > 3, top).otherwise(F.array().cast("array<string>")), F.transform(related, line("  - ")))
    more = F.when(omitted > 0, F.array(F.concat(F.lit("  ... and "), omitted.cast("string"), F.lit(f" more {noun}(s) not shown")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit(f"{noun.capitalize()}s ("), n.cast("string"), F.lit("):")))
    return F.array_join(F.concat(head, F.when(n == 0, F.array(F.lit(NO_LINE))).otherwise(F.concat(rows, more))), "\n")


#: The tiers of a context.
CALL_GRAPH_ONLY, WITH_RETRIEVAL = "call_graph_only", "call_graph_and_retrieval"


def context_tier(retrieved: Column) -> Column:
    """Whether retrieval added anything to a function's context; a failed or missing one counts as none."""
    return F.when(F.coalesce(F.size(retrieved), F.lit(0)) > 0, WITH_RETRIEVAL).otherwise(CALL_GRAPH_ONLY)


def context_hash(callers: Column, callers_omitted: Column, callees: Column, callees_omitted: Column, retrieved: Column | None = None) -> Column:
    """Hash of a function's context, in any order: struct<name, file, line> arrays, and retrieved, array<struct<rel_fname, start_line, end_line, text>>.

    Left-out counts take part where they are not zero.
    """
    part = lambda kind: lambda c: F.concat(F.lit(f"{kind}:"), c["file"], F.lit(":"), c["name"], F.lit(":"), c["line"].cast("string"))
    none = F.array().cast("array<string>")
    left = lambda kind, n: F.when(n > 0, F.array(F.concat(F.lit(f"{kind}_omitted:"), n.cast("string")))).otherwise(none)
    chunk = lambda c: F.concat(F.lit("retrieved:"), c["rel_fname"], F.lit(":"), c["start_line"].cast("string"), F.lit(":"), c["end_line"].cast("string"), F.lit(":"), c["text"])
    found = none if retrieved is None else F.transform(retrieved, chunk)
    chunks = F.concat(F.transform(callers, part("caller")), left("callers", callers_omitted), F.transform(callees, part("callee")), left("callees", callees_omitted), found)
    return F.sha2(F.array_join(F.array_sort(F.transform(chunks, lambda c: F.sha2(c, 256))), ""), 256)


#: The titles of a copied explanation's sections, and what stands for no side effects.
WHY, USED_BY, CALLS, EFFECTS, RISK, NO_EFFECTS = "Why it exists", "Used by", "Calls", "Side effects", "Risk", "None detected -- pure function"


def copy_text(name: Column, why: Column, used_by: Column, calls: Column, effects: Column, risk: Column) -> Column:
    section = lambda title, body: F.concat(F.lit(f"\n\n{title}:\n"), body)
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    listed = F.array_join(F.transform(effects, lambda e: F.concat(F.lit("- "), e)), "\n")
    return F.concat(
        name, F.when(F.coalesce(why, F.lit("")) != "", section(WHY, why)).otherwise(""), F.when(some(used_by), section(USED_BY, F.array_join(used_by, ", "))).otherwise(""),
        F.when(some(calls), section(CALLS, F.array_join(calls, ", "))).otherwise(""), section(EFFECTS, F.when(some(effects), listed).otherwise(NO_EFFECTS)),
        F.when(F.coalesce(risk, F.lit("")) != "", section(RISK, risk)).otherwise(""),
    )


def hover_text(role: Column, one_liner: Column, fresh: Column) -> Column:
    return F.concat(F.lit("#### "), F.coalesce(role, F.lit("Unknown")), F.lit(" · *"), fresh, F.lit("*\n\n**"), F.coalesce(one_liner, F.lit("")), F.lit("**\n\n---\n"))


#: Fixed value: where a model is asked for unless a setting says otherwise.
DEFAULT_ENDPOINT = "http://localhost:11434"


def endpoint_setting(url: Column) -> Column:
    """struct<url, rejected>: a model endpoint if its host is this machine, else the default with the value that was rejected; an unset one is the default."""
    given = F.trim(F.coalesce(url, F.lit("")))
    ok = (given != "") & loopback(given)
    return F.struct(F.when(ok, given).otherwise(DEFAULT_ENDPOINT).alias("url"), F.when((given != "") & ~ok, given).alias("rejected"))


#: What ends a line, as the widest of the usual definitions has it.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def split_lines(text: Column) -> Column:
    """The lines of a text, without their ends; an end at the end begins no line, and an empty or null text has none."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def blank(line: Column) -> Column:
    """Whether a line holds nothing but white space, of any script."""
    return ~line.rlike("(?U)[^\\s\x1c-\x1f\x85]")


#: Seconds for which the way back to a caller is kept.
BACK_SECONDS = 15


def back_target_live(set_at_us: Column, now_us: Column, seconds: int = BACK_SECONDS) -> Column:
    """Whether a way back that was set then still holds now; one that was never set does not."""
    return F.coalesce(now_us - set_at_us < seconds * 1_000_000, F.lit(False))


#: Seconds between heartbeats, and misses in a row that end a process.
HEARTBEAT_SECONDS, HEARTBEAT_MISSES = 7, 3


def heartbeat_action(misses: Column, pending: Column) -> Column:
    """What a heartbeat does: 'skip' while requests are pending, 'restart' after HEARTBEAT_MISSES misses in a row, else 'ping'."""
    return F.when(pending > 0, "skip").when(misses >= HEARTBEAT_MISSES, "restart").otherwise("ping")
