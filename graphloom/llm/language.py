"""Language identification by bit-sliced Bloom filters over n-grams.

One Bloom filter a language, stored bit-sliced: slot s holds a mask with a bit for each language whose filter has s
set, in as many words of 64 bits as the languages need. An n-gram's masks, and-ed over its hash functions, tell at once all languages that contain it. A text's counts of
set bits by language, corrected for each filter's false positives, decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import packed, small_batches
from graphloom.llm.textops import mix, utf8

#: Bytes in an n-gram of the normalised text (lower case, runs of other than letters made one space).
GRAM = 4
#: The most frequent n-grams of each language's training texts that enter its filter.
GRAMS_A_LANGUAGE = 4000
#: Bound on the training rows of each language (expected count of a hash sample; all rows below it).
TRAIN_ROWS = 4000
#: Slots of a filter for each n-gram in it, and hash functions.
SLOTS_A_GRAM, HASHES = 16, 3
#: Bound on the number of languages, whose n-grams the driver holds: more are an error, none is left out.
MAX_LANGUAGES = 4096
#: Seed of the draw of training rows.
SEED = 42
UNKNOWN = "und"


def _normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, has a letter) of the normalised texts, each between two spaces."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    letter = np.asarray(pc.match_substring_regex(text, r"\p{L}"))
    text = pc.replace_substring_regex(pc.utf8_lower(text), r"[^\p{L}\p{M}]+", " ")
    text = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.utf8_trim(text, " "), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    raw, offsets = utf8(text)
    return raw, offsets, letter


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as 32-bit integers, for each text the index of its first one)."""
    count = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    if len(raw) < GRAM:
        return np.zeros(0, np.uint32), first
    four = raw[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        four |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    keep = np.ones(len(raw) + 1, dtype=bool)
    for k in range(1, GRAM):
        keep[np.maximum(offsets[1:] - k, offsets[:-1])] = False  # n-grams that would run into the next text
    return four[keep[: len(four)]], first


@dataclass
class Filters:
    languages: list[str]
    slots: list[np.ndarray]  # a mask of languages for each slot, 64 languages an array
    false_rate: np.ndarray  # by language

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """The languages that contain each n-gram, as masks of 64 languages each."""
        h = mix(grams.astype(np.uint64) + np.uint64(1))
        low, high, top = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1), np.uint64(len(self.slots[0]) - 1) if self.slots else np.uint64(0)
        at = [((low + np.uint64(k) * high) & top).astype(np.int64) for k in range(HASHES)]
        out = [part[at[0]] for part in self.slots]
        for masks, part in zip(out, self.slots, strict=True):
            for x in at[1:]:
                masks &= part[x]
        return out

    def counts(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(languages x texts): how many of each text's n-grams a language's filter holds."""
        out = np.zeros((len(self.languages), len(first) - 1), np.int64)
        for part, masks in enumerate(self.masks(grams)):
            for i in range(64 * part, min(64 * part + 64, len(self.languages))):
                hits = np.concatenate(([0], np.cumsum((masks >> masks.dtype.type(i % 64)) & masks.dtype.type(1), dtype=np.int64)))
                out[i] = hits[first[1:]] - hits[first[:-1]]
        return out


def build_filters(learned: dict[str, list[int] | np.ndarray]) -> Filters:
    """Filters of the given n-grams by language."""
    languages = sorted(learned)
    most = max([1, *map(len, learned.values())])
    n = 1 << (most * SLOTS_A_GRAM - 1).bit_length()
    kinds = ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64))
    widths = [min(64, len(languages) - a) for a in range(0, len(languages), 64)]
    out = Filters(languages, [np.zeros(n, next(t for t, bits in kinds if w <= bits)) for w in widths], np.zeros(len(languages)))
    for i, lang in enumerate(languages):
        slots = out.slots[i // 64]
        bit = slots.dtype.type(1 << i % 64)
        h = mix(np.asarray(learned[lang], dtype=np.uint64) + np.uint64(1))
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            slots[((low + np.uint64(k) * high) & np.uint64(n - 1)).astype(np.int64)] |= bit
        out.false_rate[i] = (np.count_nonzero(slots & bit) / n) ** HASHES
    return out


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Filters:
    """Filters from labelled(text, lang); rows with a null lang or text teach nothing. More than MAX_LANGUAGES languages are an error.

    Each language is learned from a seeded random sample of about train_rows rows (all, where it has no more): a
    documented bound on what a classifier is fitted to. Each row is drawn on its own, whatever ids or texts it shares
    with others. N-gram counts are summed on the executors; the driver gets at most GRAMS_A_LANGUAGE of each language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(by_lang) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, train_rows / r.n)) for r in by_lang], "s_lang string, share double")
    sample = rows.withColumn("u", F.rand(SEED)).join(F.broadcast(shares), (F.col("lang") == F.col("s_lang")) & (F.col("u") < F.col("share")))  # at most MAX_LANGUAGES rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            raw, offsets, _ = _normal(batch.column("text"))
            grams, first = _grams(raw, offsets)
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                own = np.concatenate([grams[first[i] : first[i + 1]] for i in range(len(langs)) if langs[i] == lang])
                seen.setdefault(lang, Counter()).update(dict(zip(*(x.tolist() for x in np.unique(own, return_counts=True)), strict=True)))
        for lang, c in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c)), "gram": pa.array(list(c), pa.int64()), "n": pa.array(list(c.values()), pa.int64())})

    total = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = total.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= GRAMS_A_LANGUAGE)
    lists = top.groupBy("lang").agg(F.collect_list("gram").alias("grams")).toArrow()  # at most GRAMS_A_LANGUAGE a language
    grams = lists.column("grams").combine_chunks()
    return build_filters({lang: grams[i].values.to_numpy() for i, lang in enumerate(lists.column("lang").to_pylist())})


def annotate(documents: DataFrame, filters: Filters) -> DataFrame:
    """(gl_row, lang_pred, score, grams) of each row of documents(text, ...): gl_row holds the row itself, whatever its columns' names.

    score is the winner's corrected share of the text's n-grams, 0 to 1; grams is their number. Ties fall to the first
    language by code point. A null text or one without a letter is UNKNOWN with score 0, as is every text if nothing
    was learned. Texts of any length are read whole; repeated rows are judged each on its own; nothing is shuffled; an
    empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    rows = packed(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*filters.languages, UNKNOWN]
        for batch in batches:
            raw, offsets, letter = _normal(pc.struct_field(batch.column("gl_row"), "text"))
            grams, first = _grams(raw, offsets)
            n, rate = np.diff(first), filters.false_rate[:, None]
            share = np.clip((filters.counts(grams, first) - rate * n) / np.maximum(n * (1 - rate), 1e-9), 0, 1)
            none = len(names) - 1
            best = np.where(letter, np.argmax(share, axis=0), none) if none else np.zeros(len(n), np.int64)
            score = np.where(best < none, share[np.minimum(best, none - 1), np.arange(len(n))], 0.0) if none else np.zeros(len(n))
            arrays = [batch.column("gl_row"), pa.array([names[k] for k in best.tolist()], pa.string()), pa.array(score), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["gl_row", "lang_pred", "score", "grams"])

    found = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("grams", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema, *found]))


def predict(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of each row of documents(doc_id, text); see annotate."""
    return annotate(documents.select("doc_id", "text"), filters).select("gl_row.doc_id", "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """fit() on the rows that are not held out, then predict() on all rows; with the column held_out.

    Defined cases: a null doc_id is not held out; a null lang or text teaches nothing; repeated rows teach as often as
    they occur and are judged each on its own; other columns are ignored, whatever their names; an empty table gives
    no rows. See annotate for texts.
    """
    filters = fit(documents.filter(~held_out(F.col("doc_id"))))
    return predict(documents, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
