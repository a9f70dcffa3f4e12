"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed base rules (too few words, repeated 8-word windows) come first.  Beside them each (lang, source)
group gets its own thresholds from mergeable quantile sketches (``percentile_approx``: partial
sketches per task, merged in the shuffle, so a group that holds a third of the rows costs its task a
few kilobytes per map task).  A row is an outlier where a ratio lies more than ``SPREAD`` interquartile
ranges, and at least a fixed slack, beyond the quartiles of its group.  For repetition, words equal to the word before them, the
limit of the row's whole language bounds the group's: a source full of it doesn't lift its own limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, leave, materialize, packed_rows, unpacked_rows

WINDOW = 8
MIN_WORDS = 20
SPREAD = 3.0
ACCURACY = 1000
#: ratio -> (least distance from the quartile: below, above); None: that side has no limit.
SLACK: dict[str, tuple[float | None, float | None]] = {
    "symbols_per_word": (None, 0.25),
    "dup_line_share": (None, 0.5),
    "mean_word_chars": (2.0, 3.0),
    "adjacent_share": (None, 0.2),
}
#: Ratios whose limits the whole language's bound.
BOUNDED = ("adjacent_share",)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUTPUT = ["doc_id", *BASE, "base_failed", "kept"]


def features(rows: DataFrame) -> DataFrame:
    """Add to (doc_id, text, lang, source) the base counts and the ratios of SLACK, prefixed ``__q_``."""
    q = {n: f"__q_{n}" for n in [*BASE, "words", "grams", "sorted", "pairs", "starts", "again", "lines", "n_lines"]}
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    df = rows.withColumn(q["words"], words).withColumn(q["n_words"], F.size(q["words"]).cast("long"))
    starts = F.sequence(F.lit(1), F.greatest(F.col(q["n_words"]) - (WINDOW - 1), F.lit(1)).cast("int"))
    df = df.withColumn(q["grams"], F.when(F.col(q["n_words"]) > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(q["words"]), i, F.lit(WINDOW))))))
    df = df.withColumn(q["sorted"], F.sort_array(q["grams"]))
    ordered = F.col(q["sorted"])
    twice = F.exists(F.zip_with(F.slice(ordered, 2, F.size(ordered) - 1), F.slice(ordered, 1, F.size(ordered) - 1), lambda a, b: a == b), lambda x: x)
    df = df.withColumn(q["pairs"], F.when(F.size(ordered) > 1, F.when(twice, F.sort_array(F.transform(F.col(q["grams"]), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    pairs, n = F.col(q["pairs"]), F.size(q["pairs"])
    same = lambda p, i, d: F.coalesce(F.get(pairs, i + d)["h"] == p["h"], F.lit(False))
    df = df.withColumn(q["starts"], F.when(pairs.isNotNull(), F.sort_array(F.transform(F.filter(pairs, lambda p, i: same(p, i, -1) | same(p, i, 1)), lambda p: p["i"]))))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["sum"] + (p + WINDOW - F.greatest(a["end"], p))).alias("sum"), (p + WINDOW).alias("end"))
    df = df.withColumn(q["n_repeat_words"], F.coalesce(F.aggregate(F.col(q["starts"]), zero, step, lambda a: a["sum"]), F.lit(0).cast("long")))
    ws = F.col(q["words"])
    again = F.zip_with(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: a == b)
    df = df.withColumn(q["again"], F.size(F.filter(again, lambda x: x)))
    df = df.withColumn(q["lines"], F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(q["n_lines"], F.size(q["lines"]))
    df = df.withColumn(q["n_dup_lines"], (F.size(q["lines"]) - F.size(F.array_distinct(q["lines"]))).cast("long"))
    df = df.withColumn(q["word_chars"], F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"))
    df = df.withColumn(q["n_symbols"], (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
    words_n = F.greatest(F.col(q["n_words"]), F.lit(1)).cast("double")
    return df.withColumns(
        {
            "__q_symbols_per_word": F.col(q["n_symbols"]) / words_n,
            "__q_dup_line_share": F.col(q["n_dup_lines"]) / F.greatest(F.col(q["n_lines"]), F.lit(1)).cast("double"),
            "__q_mean_word_chars": F.col(q["word_chars"]) / words_n,
            "__q_adjacent_share": F.col(q["again"]) / words_n,
            "__q_base_failed": (F.col(q["n_words"]) < MIN_WORDS) | (100 * F.col(q["n_repeat_words"]) > 30 * F.col(q["n_words"])),
        }
    ).drop(*(q[n] for n in ("words", "grams", "sorted", "pairs", "starts", "again", "lines", "n_lines")))


def _limits(df: DataFrame, by: list[str], ratios: tuple[str, ...]) -> DataFrame:
    """Least and greatest value of each ratio by group."""
    aggs = [F.percentile_approx(F.col(f"__q_{r}"), [0.25, 0.75], ACCURACY).alias(f"__q_of_{r}") for r in ratios]
    limits = []
    for r in ratios:
        below, above = SLACK[r]
        low, high = F.col(f"__q_of_{r}")[0], F.col(f"__q_of_{r}")[1]
        limits.append((F.lit(None).cast("double") if below is None else low - F.greatest(F.lit(below), SPREAD * (high - low))).alias(f"__q_min_{r}"))
        limits.append((F.lit(None).cast("double") if above is None else high + F.greatest(F.lit(above), SPREAD * (high - low))).alias(f"__q_max_{r}"))
    return df.groupBy(*by).agg(*aggs).select(*by, *limits)


def thresholds(df: DataFrame) -> DataFrame:
    """Limits of each (lang, source) group over the rows that pass the base rules; those of BOUNDED ratios no wider than their language's."""
    good = df.filter(~F.col("__q_base_failed"))
    groups = _limits(good, ["__q_lang", "__q_source"], tuple(SLACK))
    langs = _limits(good, ["__q_lang"], BOUNDED).select("__q_lang", *(F.col(f"__q_{m}_{r}").alias(f"__q_lang_{m}_{r}") for r in BOUNDED for m in ("min", "max")))
    out = groups.join(langs, "__q_lang")
    for r in BOUNDED:  # greatest and least leave out nulls
        out = out.withColumns({f"__q_min_{r}": F.greatest(f"__q_min_{r}", f"__q_lang_min_{r}"), f"__q_max_{r}": F.least(f"__q_max_{r}", f"__q_lang_max_{r}")})
    return out.select(*groups.columns)


def _judged(held: DataFrame) -> DataFrame:
    """Join each row's group limits to it and add ``__q_kept``.

    The limits, a row per group, are written first: their size is then known, so Spark broadcasts them
    where they are small, and otherwise can split a large group's side of the join.
    """
    within = F.lit(True)
    for r in SLACK:
        within &= F.coalesce(F.col(f"__q_{r}") >= F.col(f"__q_min_{r}"), F.lit(True)) & F.coalesce(F.col(f"__q_{r}") <= F.col(f"__q_max_{r}"), F.lit(True))
    return held.join(leave(materialize(thresholds(held), "limits")), ["__q_lang", "__q_source"], "left").withColumn("__q_kept", ~F.col("__q_base_failed") & within)


def _keys() -> dict[str, Column]:
    """Group keys without nulls, so that joins need no null-safe comparison."""
    return {f"__q_{c}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source")}


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept per row.

    docs has doc_id, text, lang, source; other columns are ignored, whatever their names.  Null text has no words and so fails
    the base rules; null langs and sources are groups of their own; repeated rows stay, each with its
    verdict; an empty table stays empty.  Texts count whole, however long.  Counts are computed once and written without texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    held = leave(materialize(features(rows.withColumns(_keys())).drop("text", "lang", "source"), "quality"))
    return _judged(held).select("doc_id", *(F.col(f"__q_{c}").alias(c) for c in OUTPUT[1:]))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_report keeps, with all their columns as they were, whatever their names.

    Null and empty texts go, an empty table stays empty, repeated rows share their verdict and all stay or go, and texts count whole.
    Rows are written once with their counts, texts included, for there is no key to join verdicts by; that
    table is left (common.leave) until the result has been written.
    """
    rows = packed_rows(docs, "text", "lang", "source")
    held = leave(materialize(features(rows.withColumns(_keys())).drop("text", "lang", "source"), "quality"))
    return unpacked_rows(_judged(held).filter("__q_kept"), docs.columns)
