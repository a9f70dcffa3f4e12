"""Scoring by an interpolated modified Kneser-Ney bigram model that Spark counts over the corpus itself.

Texts are dealt to batches once.  A batch first sends its distinct words' hashes, with their training counts, to the shards of words, which
find the words that would share a code and give them codes of their own.  Then it sends its distinct word pairs, as sorted and packed word codes with their
training counts, to the shards of the model in one shuffle; a shard's pairs follow from a hash of both words, so a very common word
is spread over all shards.  A shard merges its pieces to one sorted array of pair hashes with counts, written to the
shared folder and memory-mapped, and looks the pieces' pairs up in it by binary search.  From its
pairs it also sends each first word's sum and numbers of counts 1, 2 and 3 or more, and each second word's number of
left neighbours, to the shards of words, which answer the batches' words alike.  A shard's file goes when its task has answered, unless a folder to
keep the model in is given.  Discounts come
from counts of counts, some numbers per shard.  Last, every batch meets its answers and its texts become rows.

The order is two, for disk: of these corpora's pairs most are distinct, and of triples nearly all (README gives figures).
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import data_parts, dealt, discard, even_keys, hash_words, materialize, mix, release, trimmed_group, trimmed_pair
from tidemark.session import scratch_root

#: Reserved words hold a blank, so that no word of a text equals them.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" <s>", b" </s>"))
#: Bytes of text in a batch, and of text per shard of the model, about.
BATCH_BYTES, SHARD_BYTES = 11 << 20, 14 << 20
#: Pairs or tokens worked on at once where a batch or a shard needs some numbers for each, so that those never stand for all.
STEP = 1 << 18
#: Base probability: added to every count.
ADDED = 0.1
#: Discounts where the counts of counts give none.
FALLBACK = (0.5, 1.0, 1.5)
STATS = ("den", "n1", "n2", "n3", "left")


def code_bytes(text_bytes: int) -> int:
    """Bytes of a word's code in pairs: if each 16 bytes of text were a word of their own, one in 4,096 would share its code with another."""
    return min(8, max(4, -(-(max(1, text_bytes >> 4).bit_length() + 12) // 8)))


#: Hashes, sorted, of words that would share a code with another, and the codes they have instead.
Shared = tuple[np.ndarray, np.ndarray]


def coding(h: np.ndarray, width: int, shared: Shared) -> np.ndarray:
    """Codes of words: the first bytes of their hashes, or what shared says."""
    codes = h >> np.uint64(64 - 8 * width)
    if len(shared[0]) and len(h):
        at = np.minimum(np.searchsorted(shared[0], h), len(shared[0]) - 1)
        codes = np.where(shared[0][at] == h, shared[1][at], codes)
    return codes


def shared_codes(h: np.ndarray, number: int, shards: int, width: int) -> Shared:
    """For one shard's distinct words, hashes sorted: those whose code an earlier word has, each with a code of the shard that no word has."""
    codes = h >> np.uint64(64 - 8 * width)
    again = np.flatnonzero(codes[1:] == codes[:-1]) + 1 if len(h) else np.empty(0, np.int64)
    given: dict[int, int] = {}

    def free(c: int) -> bool:
        at = int(np.searchsorted(codes, np.uint64(c)))
        return c not in given and not (at < len(codes) and int(codes[at]) == c)

    inside = lambda c: 0 <= c < 1 << 8 * width and (c << 64 - 8 * width >> 32) * shards >> 32 == number
    for i in again:
        for step in (1, -1):
            c = int(codes[i]) + step
            while inside(c) and not free(c):
                c += step
            if inside(c):
                break
        else:
            raise ValueError("a shard of words has no free code")
        given[c] = int(h[i])
    return h[again], np.array(list(given), np.uint64)


def packed(a: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers as planes of bytes, lowest first: high planes of small numbers compress to nothing."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(b: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def leanly(*columns: np.ndarray) -> bytes:
    """Whole numbers, as many in each column, each column packed in the bytes that its largest takes, and these widths before all."""
    widths = [max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1 for a in columns]
    return b"".join([bytes(widths), *(packed(a, w) for a, w in zip(columns, widths, strict=True))])


def columned(b: bytes | pa.Buffer, number: int) -> list[np.ndarray]:
    """What leanly packed."""
    b = memoryview(b)
    widths = list(b[:number])
    n = (len(b) - number) // sum(widths)
    starts = number + n * np.cumsum([0, *widths[:-1]])
    return [unpacked(b[k : k + n * w], w) for k, w in zip(starts.tolist(), widths, strict=True)]


def deltas(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=np.uint64(0))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes, equally wide."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) + w)


def steps(n: int) -> Iterator[slice]:
    """0 to n in slices of STEP."""
    return (slice(k, min(k + STEP, n)) for k in range(0, n, STEP))


def buffers(column: pa.ChunkedArray) -> list[pa.Buffer]:
    """The column's binary values where they lie; to_pylist would copy them."""
    return [x.as_buffer() for x in column]


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of values over each."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[at], *(np.add.reduceat(v[order], at) for v in values))


def found(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Values of keys by binary search in the sorted table, 0 where a key isn't in it."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    order = np.argsort(keys)  # searches in order stay near the last one's place
    keys = keys[order]
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    out = np.empty(len(keys), np.int64)
    out[order] = np.where(table[at] == keys, values[at], 0)
    return out


class Shards:
    """Arrays in the shared folder, memory-mapped where that is a mounted folder, else read from its store."""

    def __init__(self, root: str, keep: bool = False):
        self.root, self.keep = root, keep

    def _local(self) -> str | None:
        url = urlparse(self.root)
        return unquote(url.path) if url.scheme in ("", "file") else None

    def mapped(self, *arrays: np.ndarray) -> list[np.ndarray]:
        """Write the columns of a shard, and give them back as maps of the file; a task that runs again writes a file of its own.

        A file that isn't kept loses its name at once, and its room when the maps go.
        """
        out, name = [], uuid.uuid4().hex
        for k, a in enumerate(arrays):
            if not len(a):
                out.append(a)
            elif (root := self._local()) is not None:
                os.makedirs(root, exist_ok=True)
                np.save(f"{root}/{name}-{k}.npy", a)
                out.append(np.load(f"{root}/{name}-{k}.npy", mmap_mode="r"))
                if not self.keep:
                    os.unlink(f"{root}/{name}-{k}.npy")
            elif not self.keep:
                out.append(a)
            else:
                store, path = fs.FileSystem.from_uri(f"{self.root}/{name}-{k}.npy")
                np.save(held := io.BytesIO(), a)
                store.create_dir(os.path.dirname(path))
                with store.open_output_stream(path) as f:
                    f.write(held.getvalue())
                out.append(a)
        return out


def tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Every word's place among the distinct ones, how many words each text has, and the distinct words, lower-cased; Arrow's ASCII functions take A-Z and white space alone."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # blanks at an end leave an empty word there
    blanks = np.flatnonzero(~np.asarray(real))
    sizes = np.asarray(pc.list_value_length(split)).astype(np.int64)
    del split
    if len(blanks):
        sizes -= np.bincount(np.searchsorted(np.cumsum(sizes), blanks, side="right"), minlength=len(sizes))
        words = words.filter(real)
    del real
    words = words.dictionary_encode()
    return np.asarray(words.indices), sizes, words.dictionary


def spelled_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of the words, of which a step's are Python's at a time; to_pylist takes ten times as long."""
    return np.concatenate([np.empty(0, np.uint64), *(hash_words(words[x].cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()) for x in steps(len(words)))])


class Batch:
    """Tokens of texts: lower-cased words, then one end for each text; without ``paired`` their words alone."""

    def __init__(self, texts: pa.Array, trains: np.ndarray, paired: bool = True):
        places, sizes, spelled = tokenized(texts)
        self.sizes = sizes + 1
        n, ends = len(places) + len(sizes), np.cumsum(self.sizes) - 1
        starts = ends + 1 - self.sizes
        self.trains = np.repeat(trains, self.sizes)
        # local numbers follow the order of hashes, so pairs of numbers are ordered as pairs of hashes are; each distinct word is hashed once
        words, rank = np.unique(np.append(spelled_hashes(spelled), END) if n else np.empty(0, np.uint64), return_inverse=True)
        del spelled
        at_begin = int(np.searchsorted(words, BEGIN))
        rank = rank.astype(np.int32)
        rank += rank >= at_begin
        local = np.empty(n, np.int32)
        within = np.ones(n, bool)
        within[ends] = False
        local[within] = rank[places]
        local[ends] = rank[-1:]
        del places, within
        self.words = np.insert(words, at_begin, BEGIN) if n else words
        self.local = local
        if not paired:
            return
        self.pair = np.empty(n, np.int64)
        self.pair[1:] = local[:-1]
        self.pair[starts] = at_begin
        self.pair *= len(self.words)
        self.pair += local
        pairs = self.pair << 1  # whether a token is learned from is its last bit
        pairs |= self.trains
        pairs.sort()
        new = np.ones(n, bool)
        new[1:] = pairs[1:] ^ pairs[:-1] > 1
        at = np.flatnonzero(new)
        self.pairs = pairs[at]
        self.pairs >>= 1
        pairs &= 1
        #: Training counts of the distinct pairs.
        self.counts = np.add.reduceat(pairs, at) if n else pairs

    @property
    def owner(self) -> np.ndarray:
        """Each token's text."""
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def coded(self, codes: np.ndarray, which: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words of some distinct pairs, by the codes of the batch's words."""
        pairs = self.pairs[which]
        return codes[pairs // len(codes)], codes[pairs % len(codes)]

    def dealt(self, codes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs' stable order by shard, and where each shard begins."""
        shard = np.empty(len(self.pairs), np.uint16 if shards < 1 << 16 else np.int64)
        for x in steps(len(shard)):
            shard[x] = shard_of(pair_hash(*self.coded(codes, x)), shards)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def at(self, tokens: slice = slice(None)) -> np.ndarray:
        """Tokens' places among the distinct pairs."""
        pair = self.pair[tokens]
        order = np.argsort(pair)  # searches in order stay near the last one's place
        out = np.empty(len(order), np.int64)
        out[order] = np.searchsorted(self.pairs, pair[order])
        return out


PIECE = pa.schema([("shard", pa.int64()), ("batch", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("count", pa.binary())])
PIECE_DDL = "shard long, batch long, first binary, second binary, count binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _batch(table: pa.Table, paired: bool = True) -> Batch:
    return Batch(table["text"].combine_chunks(), ~np.asarray(table["held_out"].combine_chunks().to_numpy(zero_copy_only=False), bool), paired)


def word_pieces(table: pa.Table, shards: int) -> pa.Table:
    """Of one batch: its distinct words with their training counts, a row for each shard they go to."""
    b = _batch(table, False)
    number = table["batch"][0].as_py()
    counts = np.bincount(b.local[b.trains], minlength=len(b.words)).astype(np.uint64)
    cut = np.searchsorted(shard_of(b.words, shards), np.arange(shards + 1))
    rows = []
    for s in np.flatnonzero(np.diff(cut)):
        x = slice(cut[s], cut[s + 1])
        rows.append(("word", int(s), number, packed(deltas(b.words[x])), leanly(counts[x])))
    return _table(rows, ANSWER)


def word_group(table: pa.Table, shards: int, width: int) -> pa.Table:
    """A shard's pieces of words, handed on, and its words that would share a code."""
    h = np.unique(np.concatenate([np.cumsum(unpacked(x)) for x in table["key"].to_pylist()]))
    number = table["shard"][0].as_py()
    hashes, codes = shared_codes(h, number, shards, width)
    out = pa.Table.from_arrays([table[c].combine_chunks() for c in ANSWER.names], schema=ANSWER)
    return pa.concat_tables([out, _table([("shared", number, -1, packed(hashes), packed(codes))], ANSWER)]) if len(hashes) else out


def pieces(table: pa.Table, shards: int, width: int, shared: Shared) -> pa.Table:
    """Of one batch: its distinct pairs with their training counts, a row for each shard they go to."""
    b = _batch(table)
    del b.local, b.pair, b.trains
    number = table["batch"][0].as_py()
    rows = []
    codes = coding(b.words, width, shared)
    order, cut = b.dealt(codes, shards)
    for s in np.flatnonzero(np.diff(cut)):
        x = order[cut[s] : cut[s + 1]]
        v, w = b.coded(codes, x)
        rows.append((int(s), number, packed(deltas(v), width), packed(w, width), leanly(b.counts[x])))
    return _table(rows, PIECE)


ANSWER = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("batch", pa.int64()), ("key", pa.binary()), ("value", pa.binary())])
ANSWER_DDL = "kind string, shard long, batch long, key binary, value binary"


def _kinds(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, how many are 3 or more, how many there are, and their sum."""
    return np.array([*((counts == k).sum() for k in (1, 2, 3, 4)), (counts >= 3).sum(), len(counts), counts.sum()], np.int64)


def small(counts: np.ndarray) -> np.ndarray:
    """Counts in the least type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts


def pair_shard(table: pa.Table, shards: int, width: int, store: Shards) -> pa.Table:
    """One shard of pairs: its sorted array, the batches' counts by it, and what it tells of its words."""
    shift, low = np.uint64(64 - 8 * width), np.uint64((1 << 8 * width) - 1)  # a word with a code of its own can be out of order
    numbers, first, second = table["batch"].to_pylist(), buffers(table["first"]), buffers(table["second"])
    c = np.concatenate([small(columned(x, 1)[0]) for x in buffers(table["count"])])
    number = table["shard"][0].as_py()
    v, w, h = (np.empty(len(c), np.uint64) for _ in range(3))
    cut = np.concatenate(([0], np.cumsum([x.size // width for x in first])))
    parts = [slice(i, j) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    for x, a, b in zip(parts, first, second, strict=True):
        v[x] = np.cumsum(unpacked(a, width)) & low
        w[x] = unpacked(b, width)
    for x in steps(len(h)):
        h[x] = pair_hash(v[x], w[x])
    kept = np.flatnonzero(c)
    g = h[kept]
    order = np.argsort(g)
    kept, g = kept[order], g[order]
    del order
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    at = np.flatnonzero(new)
    once, g, c = kept[at], g[at], c[kept]
    keys, counts = store.mapped(g, small(np.add.reduceat(c, at, dtype=np.int64)) if len(at) else np.empty(0, np.uint8))
    v, w = v[once], w[once]
    del g, c, kept, new, at, once
    rows = [("pair", number, n, b"", leanly(found(keys, counts, h[x]))) for n, x in zip(numbers, parts, strict=True)]
    del h
    rows.append(("pairs", number, -1, b"", _kinds(np.asarray(counts).astype(np.int64)).astype("<i8").tobytes()))
    c = np.asarray(counts).astype(np.int64)
    firsts = summed(v, c, *((c == k).astype(np.int64) for k in (1, 2)), (c >= 3).astype(np.int64))
    for kind, (codes, *values) in (("first", firsts), ("second", summed(w, np.ones(len(w), np.int64)))):
        cut = np.searchsorted(shard_of(codes << shift, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            x = slice(cut[s], cut[s + 1])
            rows.append((kind, int(s), -1, packed(deltas(codes[x]), width), leanly(*(a[x] for a in values))))
    return _table(rows, ANSWER)


def word_shard(words: pa.Table, told: pa.Table, width: int, shared: Shared, store: Shards) -> pa.Table:
    """One shard of words: sorted arrays of counts and of what pairs tell, and the batches' answers by them."""
    parts = [(n, np.cumsum(unpacked(a)), columned(c, 1)[0]) for n, a, c in zip(words["batch"].to_pylist(), buffers(words["key"]), buffers(words["value"]), strict=True)]
    if not parts:
        return _table([], ANSWER)
    number = words["shard"][0].as_py()
    h, c = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    keys, counts = store.mapped(*summed(h[c > 0], c[c > 0].astype(np.int64)))
    sides: dict[str, list] = {"first": [], "second": []}
    for kind, key, value in zip(told["kind"].to_pylist(), buffers(told["key"]), buffers(told["value"]), strict=True):
        sides[kind].append((np.cumsum(unpacked(key, width)), *(x.view(np.int64) for x in columned(value, 4 if kind == "first" else 1))))
    firsts = summed(*(np.concatenate(x) for x in zip(*sides["first"], strict=True))) if sides["first"] else [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4]
    seconds = summed(*(np.concatenate(x) for x in zip(*sides["second"], strict=True))) if sides["second"] else [np.empty(0, np.uint64), np.empty(0, np.int64)]
    fkeys, *fvalues = store.mapped(*firsts)
    skeys, left = store.mapped(*seconds)
    rows = []
    for n, h, _ in parts:
        code = coding(h, width, shared)
        rows.append(("word", number, n, b"", leanly(found(keys, counts, h), *(found(fkeys, v, code) for v in fvalues), found(skeys, left, code))))
    rows.append(("words", number, -1, b"", np.concatenate((_kinds(np.asarray(counts)), _kinds(np.asarray(left)))).astype("<i8").tobytes()))
    return _table(rows, ANSWER)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3, 4 (modified Kneser-Ney); FALLBACK where one is missing."""
    n1, n2, n3, n4 = (int(x) for x in n[:4])
    if min(n1, n2, n3, n4) == 0:
        return np.array([0.0, *FALLBACK])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(x if 0 < x <= k else f for k, x, f in zip((1, 2, 3), d, FALLBACK, strict=True))])


def probabilities(pair: np.ndarray, first: dict[str, np.ndarray], left: np.ndarray, totals: dict[str, np.ndarray]) -> np.ndarray:
    """P(second | first) of pairs: pair counts, statistics of the first words, left neighbours of the second words."""
    d2, d1 = discounts(totals["pairs"]), discounts(totals["left"])
    kinds, m, v = int(totals["pairs"][5]), totals["left"], int(totals["words"][5])
    low = np.full(len(left), 1 / (v + 1))
    if kinds:
        spare = (d1[1] * int(m[0]) + d1[2] * int(m[1]) + d1[3] * int(m[4])) / kinds
        low = (left - d1[np.minimum(left, 3)]) / kinds + spare / (v + 1)
    den = np.maximum(first["den"], 1)
    spare = (d2[1] * first["n1"] + d2[2] * first["n2"] + d2[3] * first["n3"]) / den
    return np.where(first["den"] > 0, (pair - d2[np.minimum(pair, 3)]) / den + spare * low, low)


def score_batch(table: pa.Table, told: pa.Table, shards: int, width: int, shared: Shared, totals: dict[str, np.ndarray]) -> pa.Table:
    """A row per text of a batch, from the answers to its pairs and words."""
    b = _batch(table)
    del b.counts, b.trains
    order, cut = b.dealt(coding(b.words, width, shared), shards)
    pair = np.zeros(len(order), np.int64)
    columns: list[tuple] = []
    for kind, s, value in sorted(zip(told["kind"].to_pylist(), told["shard"].to_pylist(), buffers(told["value"]), strict=True), key=lambda x: x[:2]):
        if kind == "pair":
            pair[order[cut[s] : cut[s + 1]]] = columned(value, 1)[0]
        else:
            columns.append(columned(value, 1 + len(STATS)))
    del order
    word = {k: np.concatenate(x).astype(np.int64) for k, x in zip(("count", *STATS), zip(*columns, strict=True), strict=True)}
    del columns
    n = max(1, len(b.words))
    logs = np.empty(len(pair))
    for x in steps(len(logs)):
        v, w = b.pairs[x] // n, b.pairs[x] % n
        logs[x] = np.log10(probabilities(pair[x], {k: word[k][v] for k in STATS[:4]}, word["left"][w], totals))
    del pair
    tokens, kinds = int(totals["words"][6]), int(totals["words"][5])
    base = np.log10((word["count"] + ADDED) / (tokens + ADDED * (kinds + 1)))
    owner, seen = b.owner, (word["count"] > 0).astype(np.int64)
    known, base_score, score = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows), np.zeros(table.num_rows)
    for x in steps(len(owner)):  # at() adds in the order of tokens, so that slices don't show in the sums
        for sums, values in ((known, seen[b.local[x]]), (base_score, base[b.local[x]]), (score, logs[b.at(x)])):
            np.add.at(sums, owner[x], values)
    return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": b.sizes, "n_known": known, "train_tokens": np.full(table.num_rows, tokens), "base_score": base_score, "score": score})


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score_corpus(docs: DataFrame, batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES, model_dir: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs has doc_id and text; the model learns from whole texts of rows whose crc32(doc_id as text) modulo 10 isn't 0,
    and of rows without doc_id.  Null and empty texts have one token, the end, and are learned like others.  score and base_score
    are log10 probabilities of whole texts.  Repeated rows count as often as they are there.  With nothing to learn from every
    probability is 1.  An empty table gives no rows; other columns are ignored, whatever their names.  A task holds one
    batch of about batch_bytes of text, or one text if that is longer, or one shard of the model.  The sorted arrays of the model stay in model_dir, if given.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = data_parts(docs, "text", batch_bytes) if total else 1
    shards, width = max(1, -(-total // shard_bytes)), code_bytes(total)
    keys = F.array(*map(F.lit, even_keys(parts))) if parts <= 4096 else None
    slot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    batch = F.element_at(keys, slot + 1) if keys is not None else slot
    texts = dealt(docs.withColumns({"held_out": held_out("doc_id"), "batch": batch.cast("int")}), parts, "batch")
    store = Shards(model_dir or f"{scratch_root(spark)}/lm-{uuid.uuid4().hex}", model_dir is not None)
    wide = lambda t: t.set_column(t.schema.get_field_index("batch"), "batch", t["batch"].cast(pa.int64()))
    sent = texts.groupBy("batch").applyInArrow(trimmed_group(lambda t: word_pieces(wide(t), shards)), ANSWER_DDL)
    spelled = materialize(sent.groupBy("shard").applyInArrow(trimmed_group(lambda t: word_group(t, shards, width)), ANSWER_DDL), "spelled")
    release(spark)
    twice = [(unpacked(bytes(r.key)), unpacked(bytes(r.value))) for r in spelled.filter("kind = 'shared'").select("key", "value").collect()]  # few words, see code_bytes
    twice = [np.concatenate(c) for c in zip(*twice, strict=True)] or [np.empty(0, np.uint64)] * 2
    order = np.argsort(twice[0])
    shared = (twice[0][order], twice[1][order])
    sent = texts.groupBy("batch").applyInArrow(trimmed_group(lambda t: pieces(wide(t), shards, width, shared)), PIECE_DDL)
    pairs = materialize(sent.groupBy("shard").applyInArrow(trimmed_group(lambda t: pair_shard(t, shards, width, store)), ANSWER_DDL), "pairs")
    release(spark)
    told = pairs.filter("kind in ('first', 'second')")
    words = materialize(spelled.filter("kind = 'word'").groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(trimmed_pair(lambda a, b: word_shard(a, b, width, shared, store)), ANSWER_DDL), "words")
    discard(spelled)
    release(spark)
    sums: dict[str, np.ndarray] = {"pairs": np.zeros(7, object), "words": np.zeros(7, object), "left": np.zeros(7, object)}
    for r in pairs.filter("kind = 'pairs'").union(words.filter("kind = 'words'")).select("kind", "value").toLocalIterator():  # some numbers per shard
        x = np.frombuffer(r.value, "<i8").astype(object)
        sums[r.kind] = sums[r.kind] + x[:7]
        if r.kind == "words":
            sums["left"] = sums["left"] + x[7:]
    answers = pairs.filter("kind = 'pair'").union(words.filter("kind = 'word'")).withColumn("batch", F.col("batch").cast("int"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = materialize(texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(trimmed_pair(lambda a, b: score_batch(a, b, shards, width, shared, sums)), schema), "scores")
    discard(texts, pairs, words)
    return out
