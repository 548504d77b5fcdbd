"""Quality rules as a short-circuit cascade, in DataFrame operations only.

The cost and the rejections of each rule are estimated on a seeded sample; rules then run by falling rejection per
cost, and a text that one rule rejects is not measured for the next. The order never changes which texts are kept.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import quoted

#: Expected rows of the sample on which costs and rejections are estimated, and its seed.
SAMPLE_ROWS, SEED = 2000, 42
WINDOW = 8
SPACES = " \t\n\x0b\f\r"
_GAP, _WORD, _SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value evaluated once a row, though body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words within windows of WINDOW words that occur twice or more in the text, the first included."""
    n = F.size(words)

    def windows(h: Column) -> Column:
        """Hashes of all windows, of the hashes of their words, each made once."""
        return F.transform(F.slice(h, 1, n - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(at: Column) -> Column:
        widths = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), p + WINDOW) - p))
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.when(k == 0, F.get(s, k + 1)["h"] == x["h"]).otherwise(F.get(s, k - 1)["h"] == x["h"]))), lambda x: x["i"]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(_let(pairs, repeated), covered))

    return F.when(n < WINDOW + 1, 0).otherwise(_let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), count))


def metric(name: str) -> Column:
    """A metric over the columns text and words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD))
    return {
        "n_words": lambda: F.size("words"),
        "word_chars": lambda: F.length(F.array_join("words", "")),
        "n_symbols": lambda: F.regexp_count(text, F.lit(_SYMBOL)),
        "n_lines": lambda: F.size(lines),
        "n_dup_lines": lambda: _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_double_marks": lambda: F.floor((F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))) / 2),
        "n_repeat_words": lambda: _let(F.col("words"), _repeat_words),
    }[name]().cast("long")


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which a condition, in SQL over the named metrics, holds."""

    name: str
    metrics: tuple[str, ...]
    rejects: str


#: Conditions in whole numbers, so that every engine judges alike.
RULES = (
    Rule("short_or_long_words", ("n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("double_marks", ("n_words", "n_double_marks"), "10 * n_double_marks > n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 30 * n_words"),
)
BASE = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


#: Metrics that the contract wants of every text, whatever the verdict.
WANTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What a metric reads once for each text, and the work a unit of it takes, relative to a character looked at (fixed values).
COSTS = {
    "n_words": ("chars", 0.1), "word_chars": ("chars", 0.5), "n_symbols": ("chars", 1.0), "n_lines": ("chars", 1.0), "n_dup_lines": ("chars", 1.5), "n_double_marks": ("chars", 0.3), "n_repeat_words": ("words", 40.0),
}


@dataclass(frozen=True)
class Estimate:
    """What a sample tells: mean units a text, and how many of its texts each set of rules rejects."""

    units: dict[str, float]
    rejected: dict[frozenset[str], int]

    def cost(self, rule: Rule, measured: set[str]) -> float:
        """Work of a text that reaches the rule, without metrics already measured; at least a comparison."""
        return 1.0 + sum(self.units[COSTS[m][0]] * COSTS[m][1] for m in rule.metrics if m not in measured)


def _with_words(documents: DataFrame, *columns: Column) -> DataFrame:
    return documents.select(*columns, F.col("text"), words_of(F.col("text")).alias("words"))


def estimate(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> Estimate:
    """Costs and rejections of the rules on a seeded random sample of about sample_rows texts (all, if there are no more), in one job."""
    total = documents.count()
    rows = _with_words(documents.filter(F.rand(seed) < sample_rows / max(total, 1)))  # by row, so that no text's copies come in together
    names = sorted({m for r in rules for m in r.metrics})
    rows = rows.select(F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.size("words").alias("gl_words"), *[metric(n).alias(n) for n in names])
    rows = rows.select("chars", "gl_words", F.array(*[F.when(F.expr(r.rejects), r.name) for r in rules]).alias("hit"))
    got = rows.groupBy(F.array_compact("hit").alias("hit")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("gl_words").alias("words")).collect()  # a row for each set of rules that reject a sampled text
    n = max(1, sum(r.n for r in got))
    return Estimate({"chars": sum(r.chars for r in got) / n, "words": sum(r.words for r in got) / n}, dict(Counter({frozenset(r.hit): r.n for r in got})))


def order_rules(known: Estimate, rules: tuple[Rule, ...] = RULES, measured: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by falling rejections per cost: again and again the one that rejects most of the sampled texts still in, for the work that its metrics add.

    measured: metrics that are there in any case. Ties fall to the rule that stands first, so reruns agree.
    """
    left, have, rejected, out = list(rules), set(measured), dict(known.rejected), []
    while left:
        best = max(left, key=lambda r: (sum(n for hit, n in rejected.items() if r.name in hit) / known.cost(r, have), -rules.index(r)))
        out.append(best)
        left.remove(best)
        have |= set(best.metrics)
        rejected = {hit: n for hit, n in rejected.items() if best.name not in hit}
    return out


def _run(rows: DataFrame, ordered: list[Rule], measured: set[str]) -> DataFrame:
    """rows(text, words, gl_out, measured metrics) through the rules: gl_out names the first that rejects; a metric is evaluated only for texts that reach its rule."""
    for r in ordered:
        for name in r.metrics:
            if name not in measured:
                rows = rows.withColumn(name, F.when(F.col("gl_out").isNull(), metric(name)))
                measured = measured | {name}
        rows = rows.withColumn("gl_out", F.coalesce("gl_out", F.when(F.expr(r.rejects), r.name)))
    return rows


def cascade(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents with rejected_by (null: kept); a metric is evaluated only for texts that reach its rule.

    Defined cases: a null text has no words and no lines; texts of any length are measured whole; repeated rows are
    judged each on its own; tables may be empty; all columns of documents pass through, whatever their names, but for
    one named rejected_by, which is replaced.
    """
    ordered = order_rules(estimate(documents, rules), rules)
    rows = documents.drop("rejected_by")
    out = _with_words(rows, F.struct(*[F.col(quoted(c)) for c in rows.columns]).alias("gl_row")).withColumn("gl_out", F.lit(None).cast("string"))
    return _run(out, ordered, set()).select("gl_row.*", F.col("gl_out").alias("rejected_by"))


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the metrics of WANTED, base_failed and kept of each row of documents(doc_id, text).

    The wanted metrics are measured once for every text. Texts that fail BASE go no further; the others run through
    the cascade, in which the metrics that only rules want are measured for the texts that reach them. Defined cases:
    see cascade.
    """
    ordered = order_rules(estimate(documents, rules), rules, WANTED)
    rows = _with_words(documents, F.col("doc_id"))
    rows = rows.select("doc_id", "text", "words", *[metric(n).alias(n) for n in WANTED]).withColumn("base_failed", F.expr(BASE))
    rows = _run(rows.withColumn("gl_out", F.when(F.col("base_failed"), "base")), ordered, set(WANTED))
    return rows.select("doc_id", *WANTED, "base_failed", F.col("gl_out").isNull().alias("kept"))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS pos, words FROM w
), h AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 7], ' ') AS window_words FROM g
), r AS (
  SELECT doc_id, pos FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, window_words) > 1
), c AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM r, (SELECT unnest(range(8)) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    floor((length(text) - length(replace(text, '!!', ''))) / 2)::BIGINT AS n_double_marks,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AND NOT 10 * n_symbols > n_words
  AND NOT 10 * n_double_marks > n_words AND NOT 10 * n_dup_lines > 3 * n_lines AS kept FROM b
"""
