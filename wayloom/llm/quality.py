"""Per-document text statistics, their robust scores within a language, and a flag for what isn't prose.

1. The words of all documents are counted by language; a language's common words
   are those that make up half of its running text. Nothing about a language is
   given beforehand.
2. The statistics of each document come from its whole text, by counting classes
   of letters in numpy, a batch of texts at a time (the same in Column expressions
   took twice the processor time of a loop over texts, see ``letters``).
3. All documents' statistics go into mergeable KLL quantile sketches, one for
   each statistic and language, built map-side and merged by Spark; medians and
   quartiles turn each value into a robust z-score.
4. The length of a document's vector of suspect scores goes into one more sketch,
   whose outer fence marks the tail: what lies beyond isn't prose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm import letters
from wayloom.session import checkpointed

# Three-letter language codes (ISO 639-2, both forms) and their two-letter ones.
CODES = {
    "ara": "ar", "ben": "bn", "bul": "bg", "cat": "ca", "ces": "cs", "chi": "zh", "cze": "cs", "dan": "da", "deu": "de", "dut": "nl", "ell": "el", "eng": "en",
    "est": "et", "fin": "fi", "fra": "fr", "fre": "fr", "ger": "de", "gre": "el", "heb": "he", "hin": "hi", "hrv": "hr", "hun": "hu", "ind": "id", "ita": "it",
    "jpn": "ja", "kor": "ko", "lav": "lv", "lit": "lt", "nld": "nl", "nor": "no", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "slk": "sk",
    "slo": "sk", "slv": "sl", "spa": "es", "esp": "es", "srp": "sr", "swe": "sv", "tur": "tr", "ukr": "uk", "vie": "vi", "zho": "zh",
}
UNKNOWN = "und"
#: A language's common words make up this share of its running text, and none less than LEAST_SHARE (so there are at most 1,000).
COMMON_TEXT, LEAST_SHARE = 0.5, 0.001
#: Documents that a declared language needs for words and sketches of its own; codes have two or three letters, so there are at most 18,252.
LEAST_DOCUMENTS = 30
#: Words in which variety is measured, so that it doesn't fall with length.
WINDOW = 24
#: The outer fence of the length of score vectors: so many quartile distances above the upper quartile (Tukey's "far out").
FENCE = 3.0
#: A single statistic is named beyond this score.
NAMED = 3.0

_WORD = r"[\p{L}\p{M}]+"


@dataclass(frozen=True)
class Tail:
    """Which side of a statistic is suspect (+1 high, -1 low), and of what count it is a share (a score is never finer than half of one such thing in a text of median size)."""

    side: int
    of: str | None = None


#: The statistics that tell prose from lists, tables and junk, and their tails.
TAILS = {
    "common_share": Tail(-1, "words"),
    "symbol_ratio": Tail(+1, "chars"),
    "digit_ratio": Tail(+1, "words"),
    "token_length": Tail(+1),
    "item_breaks": Tail(+1, "breaks"),
    "separator_ratio": Tail(+1, "words"),
    "comma_ratio": Tail(+1, "words"),
    "word_variety": Tail(-1),
    "sentence_length": Tail(+1),
}
#: Statistics that are scored and reported but flag nothing.
REPORTED = {"words": Tail(+1), "mean_word_length": Tail(+1), "lines": Tail(+1), "punctuated_lines": Tail(-1)}
SCORED = REPORTED | TAILS
STATISTICS = [*SCORED]
#: Sizes whose medians set the finest score; they are sketched too.
SIZES = ["chars", "breaks"]


def declared(code: Column) -> Column:
    """The declared language in two letters where it has such a code, else in three; null for what is no code."""
    short = F.lower(F.regexp_extract(F.trim(code), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    table = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.when(F.length(short) > 0, F.coalesce(F.try_element_at(table, short), short))


def words_of(text: Column) -> Column:
    """The words of a text in lower case, without digits and marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def common_words(documents: DataFrame) -> dict[str, list[str]]:
    """The common words of each declared language with LEAST_DOCUMENTS documents, learned from all of ``documents`` (``text, lang``).

    Words are counted map-side first; where half of the running text is reached
    is read off sums over classes of equal frequency, so no language's words
    meet in one task. The driver sees at most 1,000 words a language.
    """
    coded = documents.select(declared(F.col("lang")).alias("language"), "text").where("language is not null and text is not null")
    many = [r.language for r in coded.groupBy("language").count().where(F.col("count") >= LEAST_DOCUMENTS).collect()]
    counts = checkpointed(coded.where(F.col("language").isin(many)).select("language", F.explode(words_of(F.col("text"))).alias("word")).groupBy("language", "word").agg(F.count("*").alias("n"))) if many else None
    if counts is None:
        return {}
    classes = counts.withColumn("class", F.floor(F.log2("n") * 8)).groupBy("language", "class").agg(F.sum("n").alias("n"))
    every = Window.partitionBy("language")
    above = every.orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = classes.withColumns({"above": F.coalesce(F.sum("n").over(above), F.lit(0)), "all": F.sum("n").over(every)}).where(F.col("above") < COMMON_TEXT * F.col("all"))
    cut = kept.groupBy("language").agg(F.min("class").alias("class"), F.max("all").alias("all"))
    rows = counts.join(F.broadcast(cut), "language").where((F.floor(F.log2("n") * 8) >= F.col("class")) & (F.col("n") >= LEAST_SHARE * F.col("all"))).select("language", "word").collect()
    return {language: sorted(r.word for r in rows if r.language == language) for language in sorted(many)}


#: Letters measured at a time, so that a worker's memory is bounded by them or by the longest text.
CHUNK = 4_000_000


def _measure_batches(common: dict[str, list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = sorted(common)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [letters.hashes(common[n]) for n in names]
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate([[0], np.searchsorted(size, np.arange(CHUNK, size[-1], CHUNK)) + 1, [len(size)]])) if len(size) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(lo, hi - lo)
                stats, held = letters.measure(part.column("text"), known, WINDOW)
                declared_as = [n if n in common else None for n in part.column("language").to_pylist()]
                best = held.argmax(axis=1) if len(names) else np.zeros(len(part), dtype=int)
                language = [d or (names[b] if len(names) and held[k, b] > 0 else UNKNOWN) for k, (d, b) in enumerate(zip(declared_as, best.tolist()))]
                columns = [part.column("doc_id"), pa.array(language, pa.string()), *(pa.array(stats[n]) for n in [*STATISTICS, *SIZES])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "language", *STATISTICS, *SIZES])

    return measure


def text_statistics(documents: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """``doc_id, language``, the statistics and the sizes; one row for each row of ``documents`` (``doc_id, text, lang``).

    A text of no declared language that has words of its own in ``common`` is
    given the language most of whose common words it holds, or ``und``. Shares of
    short texts are drawn towards a middling value by a few imagined words, so
    that three words alone are no extreme. Null and empty texts have no words.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), declared(F.col("lang")).alias("language"))
    return rows.mapInArrow(_measure_batches(common), f"doc_id {kind}, language string, " + ", ".join(f"{s} double" for s in [*STATISTICS, *SIZES]))


def _sketches(stats: DataFrame) -> DataFrame:
    """One row a language with a sketch of each statistic and size, and one of all together for texts of no known language."""
    names = [*STATISTICS, *SIZES]
    each = stats.where("words > 0").groupBy("language").agg(F.count("*").alias("_n"), *[F.kll_sketch_agg_double(s).alias(s) for s in names])
    merged = each.agg(*[F.kll_merge_agg_double(s).alias(s) for s in names]).select(F.lit(UNKNOWN).alias("language"), *names)
    return each.where(F.col("language") != UNKNOWN).select("language", *names).unionByName(merged)


def score_texts(documents: DataFrame, fence: float = FENCE) -> DataFrame:
    """The statistics of each document, their robust z-scores (``z_...``), ``far_out``, ``limit`` and ``tails``.

    ``z`` is positive towards the suspect side of a statistic. ``far_out`` is the
    length of the vector of positive scores (those of REPORTED don't count);
    ``limit`` is the same for all documents: the upper quartile of ``far_out`` and
    ``fence`` quartile distances more. Beyond it a document is no natural prose, and ``tails`` names the statistics that say so,
    at least the one furthest out (empty for prose). A record counts once: rows
    repeating a ``doc_id`` with the same text and language are one, a null id is
    an id. Null or empty text gives zero words and no tails. Texts of a language
    with too few documents for sketches are held against all together.
    """
    rows = documents.select("doc_id", "text", "lang")
    stats = checkpointed(text_statistics(rows, common_words(rows))).distinct()
    sketches = checkpointed(_sketches(stats))  # one row a language: bounded whatever the input

    def quantile(name: str, share: float) -> Column:
        return F.kll_sketch_get_quantile_double(F.col(name), F.lit(share))

    def width(name: str, tail: Tail) -> Column:
        spread = (quantile(name, 0.75) - quantile(name, 0.25)) / 1.349
        one = 0.5 / F.greatest(quantile(tail.of, 0.5), F.lit(1.0)) if tail.of else F.lit(0.0)
        return F.greatest(spread, one, 0.05 * F.abs(quantile(name, 0.5)), F.lit(1e-6))

    bounds = sketches.select("language", *[quantile(s, 0.5).alias(f"mid_{s}") for s in SCORED], *[width(s, t).alias(f"width_{s}") for s, t in SCORED.items()])
    scored = stats.join(F.broadcast(bounds), "language", "left")
    z = {s: F.coalesce((F.col(s) - F.col(f"mid_{s}")) / F.col(f"width_{s}") * t.side, F.lit(0.0)) for s, t in SCORED.items()}
    out = scored.select("doc_id", "language", *STATISTICS, *[v.alias(f"z_{s}") for s, v in z.items()])
    square = sum((F.pow(F.greatest(F.col(f"z_{s}"), F.lit(0.0)), 2) for s in TAILS), F.lit(0.0))
    out = out.withColumn("far_out", F.when(F.col("lines") > 0, F.sqrt(square)).otherwise(0.0))
    sketch = out.where("lines > 0").agg(F.kll_sketch_agg_double("far_out").alias("q"))
    low, high = quantile("q", 0.25), quantile("q", 0.75)
    out = out.join(F.broadcast(sketch.select((high + fence * (high - low)).alias("limit"))))
    furthest = F.greatest(*[F.col(f"z_{s}") for s in TAILS])
    named = F.array_compact(F.array(*[F.when((F.col(f"z_{s}") > NAMED) | (F.col(f"z_{s}") == furthest), F.lit(s)) for s in TAILS]))
    return out.withColumn("tails", F.when(F.col("far_out") > F.col("limit"), named).otherwise(F.array().cast("array<string>")))
