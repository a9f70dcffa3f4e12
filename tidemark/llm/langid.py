"""Language identification by interpolated Kneser-Ney character models.

One 4-gram model per language over folded characters (letters in lower case, everything else a
blank, runs of blanks one).  A 4-gram of 16-bit codes is its own 64-bit hash, so the models of all
languages are sorted arrays of keys with a row of values for each language, and a text costs one
binary search per character for all languages together.  The language with the least mean
cross-entropy per character wins.  Rejection is calibrated on training texts that the models don't learn from: a text whose
cross-entropy is above the 99.5th percentile of its language's own held-back texts is marked.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

ORDER = 4
#: Characters of training text per language, about; rows are drawn by a hash of doc_id.
TRAIN_CHARS = 3_000_000
#: Labels that get a model, those with most characters, and characters of training text in all: what the driver holds.
MAX_LANGS = 1000
ALL_CHARS = 48_000_000
#: One training text in so many is held back to calibrate the rejection.
HELD = 8
DISCOUNT = 0.75
#: A uniform share over this many symbols ends the interpolation.
ALPHABET = 512


def fold_table() -> np.ndarray:
    """Code point (16 bits) -> folded code, 32 for what isn't a letter."""
    out = np.full(1 << 16, 32, np.uint64)
    for c in range(1 << 16):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


def folded(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each text led by ORDER - 1 blanks, and the text of each code."""
    pad = " " * (ORDER - 1)
    joined = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = table[np.where(joined < 1 << 16, joined, 32)]
    codes[joined >= 1 << 16] = 0xFFFF  # letters beyond the first plane share a code
    lengths = np.fromiter((len(t) + len(pad) for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    first = np.zeros(len(codes), bool)
    starts = np.cumsum(lengths) - lengths
    for k in range(len(pad)):
        first[starts + k] = True
    blank = codes == 32
    keep = first | ~(blank & np.concatenate(([True], blank[:-1])))
    return codes[keep], owner[keep]


def keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Packed n-gram ending at each position from ORDER - 1 on."""
    out = np.zeros(max(0, len(codes) - ORDER + 1), np.uint64)
    for k in range(ORDER - n, ORDER):
        out = (out << np.uint64(16)) | codes[k : len(codes) - ORDER + 1 + k]
    return out


def scored(owner: np.ndarray) -> np.ndarray:
    """Positions from ORDER - 1 on whose whole n-gram lies in one text."""
    return owner[ORDER - 1 :] == owner[: len(owner) - ORDER + 1]


def sums(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, inv = np.unique(groups, return_inverse=True)
    return uniq, np.bincount(inv, values, len(uniq))


def lookup(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted key in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


class KneserNey:
    """Interpolated Kneser-Ney probabilities of one language, from counts of 4-grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []
        for n in range(ORDER, 0, -1):
            ctx = grams >> np.uint64(16)
            c, total = sums(ctx, counts.astype(float))
            _, kinds = sums(ctx, np.ones(len(ctx)))
            self.levels.append((n, grams, counts.astype(float), c, total, kinds))
            if n > 1:  # continuation counts: distinct left neighbours of the shorter gram
                grams, counts = np.unique(grams & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True)

    def prob(self, wanted: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Of n-grams: the last character's probability after the others."""
        if n == 0:
            return np.full(len(wanted), 1 / ALPHABET)
        _, grams, counts, ctx, total, kinds = self.levels[ORDER - n]
        lower = self.prob(wanted & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
        at, there = lookup(ctx, wanted >> np.uint64(16))
        g, seen = lookup(grams, wanted)
        top = np.where(seen, np.maximum(counts[g] - DISCOUNT, 0), 0) if len(counts) else 0
        with np.errstate(divide="ignore", invalid="ignore"):
            full = (top + DISCOUNT * kinds[at] * lower) / total[at]
        return np.where(there, full, lower)


def fit(texts: dict[str, list[str]]) -> dict:
    """Sorted keys of all orders with a log probability per language."""
    table, langs, models, own = fold_table(), sorted(texts), [], []
    for lang in langs:
        few = len(texts[lang]) < 2 * HELD  # too few to hold any back
        codes, owner = folded([t for i, t in enumerate(texts[lang]) if few or i % HELD], table)
        grams, counts = np.unique(keys(codes, ORDER)[scored(owner)], return_counts=True)
        models.append(KneserNey(grams, counts))
        codes, owner = folded([t for i, t in enumerate(texts[lang]) if few or not i % HELD], table)
        own.append((keys(codes, ORDER)[scored(owner)], owner[ORDER - 1 :][scored(owner)]))
    out = {"langs": langs, "keys": [], "logs": []}
    union = np.unique(np.concatenate([m.levels[0][1] for m in models])) if models else np.empty(0, np.uint64)
    for n in range(ORDER, 0, -1):
        out["keys"].append(union)
        out["logs"].append(np.stack([-np.log2(m.prob(union, n)) for m in models], 1).astype(np.float32) if len(union) else np.empty((0, len(models)), np.float32))
        if n > 1:
            union = np.unique(union & np.uint64((1 << 16 * (n - 1)) - 1))
    # back-off weights of contexts, for 4-grams that no language has seen
    for n in range(ORDER, 1, -1):
        ctx = np.unique(np.concatenate([m.levels[ORDER - n][3] for m in models])) if models else np.empty(0, np.uint64)
        weights = []
        for m in models:
            _, _, _, c, total, kinds = m.levels[ORDER - n]
            at, there = lookup(c, ctx)
            weights.append(np.where(there, -np.log2(DISCOUNT * kinds[at] / total[at]), 0.0))
        out.setdefault("ctx", []).append(ctx)
        out.setdefault("weights", []).append(np.stack(weights, 1).astype(np.float32) if models and len(ctx) else np.empty((0, len(models)), np.float32))
    out["fold"] = table
    cut = []
    for j, (k, who) in enumerate(own):
        h = cross_entropy(out, k, who, int(who.max()) + 1 if len(who) else 0)[:, j]
        h = h[np.isfinite(h)]
        cut.append(float(np.quantile(h, 0.995)) if len(h) else np.inf)
    out["cut"] = np.array(cut)
    return out


def costs(model: dict, wanted: np.ndarray, n: int = ORDER) -> np.ndarray:
    """Bits of each n-gram's last character, a column per language."""
    if n == 0:
        return np.full((len(wanted), len(model["langs"])), np.log2(ALPHABET), np.float32)
    at, there = lookup(model["keys"][ORDER - n], wanted)
    out = model["logs"][ORDER - n][at] if len(model["keys"][ORDER - n]) else np.zeros((len(wanted), len(model["langs"])), np.float32)
    miss = np.flatnonzero(~there)
    if len(miss):
        rest = wanted[miss]
        low = costs(model, rest & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
        if n > 1:
            c, known = lookup(model["ctx"][ORDER - n], rest >> np.uint64(16))
            if len(model["ctx"][ORDER - n]):
                low = low + model["weights"][ORDER - n][c] * known[:, None]
        out[miss] = low
    return out


def cross_entropy(model: dict, k: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    """Mean bits per character of n texts, a column per language; nan without characters."""
    bits = costs(model, k)
    count = np.bincount(who, minlength=n)
    with np.errstate(invalid="ignore"):
        return np.stack([np.bincount(who, bits[:, j], n) / count for j in range(bits.shape[1])], 1) if bits.shape[1] else np.empty((n, 0))


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and rejection of each text."""
    alive = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if not alive or not model["langs"]:
        return lang, score, rejected
    codes, owner = folded([texts[i] for i in alive], model["fold"])
    ok = scored(owner)
    h = cross_entropy(model, keys(codes, ORDER)[ok], owner[ORDER - 1 :][ok], len(alive))
    n = np.bincount(owner[ORDER - 1 :][ok], minlength=len(alive))
    best = h.argmin(1)
    # the posterior under equal priors, tempered because characters aren't independent
    gap = (h - h.min(1, keepdims=True)) * np.minimum(n, 200)[:, None] * 0.2
    post = 1 / np.exp2(-np.minimum(gap, 60)).sum(1)
    for i, b, p, hh in zip(alive, best, post, h.min(1), strict=True):
        lang[i], score[i], rejected[i] = model["langs"][b], float(min(1.0, p)), bool(hh > model["cut"][b])
    return lang, score, rejected


def training_rows(docs: DataFrame, train_chars: int) -> DataFrame:
    """Labelled rows outside the held-out fold, about train_chars characters of each language.

    Each language's rate comes from a sum with map-side partials, a number per language that goes into the plan;
    rows are then picked by a hash of doc_id, so no text is sorted, gathered or shuffled.  Of more than
    ``MAX_LANGS`` labels those with most characters are learned, ties by name, and many labels share ``ALL_CHARS``.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select("doc_id", "text", "lang")
    totals = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).orderBy(F.desc("chars"), "lang").limit(MAX_LANGS).collect()
    if not totals:
        return rows.select("lang", "text")
    train_chars = min(train_chars, ALL_CHARS // len(totals))
    chars = F.element_at(F.create_map(*(F.lit(x) for r in totals for x in (r.lang, float(r.chars)))), F.col("lang"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(unit * chars < train_chars).select("lang", "text")  # labels without a model have no entry and so no row


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected.

    docs has doc_id, text, lang; models learn from the text and lang of rows that aren't held out
    (``crc32(doc_id) % 5 <> 0``), about ``train_chars`` characters per language, and predictions use
    text alone.  ``und`` with score 0 where text is null or has no letter, and everywhere if there is
    nothing to learn from.  A null doc_id isn't held out.  Repeated rows stay.  Whole texts are scored, however long;
    other columns, also ones named as the results are, are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    texts: dict[str, list[str]] = {}
    for r in training_rows(docs, train_chars).toLocalIterator():  # bounded by train_chars a language
        texts.setdefault(r.lang, []).append(r.text)
    for t in texts.values():
        t.sort()
    sent = docs.sparkSession.sparkContext.broadcast(fit(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            lang, score, rejected = predict(sent.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
