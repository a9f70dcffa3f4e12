"""Token counts of whole texts under a public byte-level BPE vocabulary.

Two tiers of pre-token lengths, both on the map side, so that no pre-token is shuffled:

1. a broadcast table of the pre-tokens that are vocabulary entries, hence bounded by the vocabulary
   (50,257 entries, about 0.6 MB), as joined strings and a byte of length each;
2. a cache in each worker for the rest, filled by the library itself and emptied at ``CACHE`` entries.

Texts with a character outside ``SAFE`` or with a special string go to the library whole, because
there its own tables of character classes and of added tokens decide.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: The pre-token pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point all Unicode versions of the last twenty years agree on the classes.
SAFE = "ɐ"
CACHE = 400_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def frequent_lengths(name: str) -> tuple[str, bytes]:
    """The broadcast tier: vocabulary entries that are a pre-token by themselves, and their token counts."""
    tok, pattern = load_tokenizer(name), regex.compile(PRETOKEN)
    pieces = []
    for entry in tok.get_vocab(with_added_tokens=False):
        piece = tok.decoder.decode([entry])
        if "�" not in piece and "\0" not in piece and piece < SAFE and max(piece, default=SAFE) < SAFE and pattern.findall(piece) == [piece]:
            pieces.append(piece)
    counts = bytes(min(255, len(e)) for e in tok.encode_batch_fast(pieces, add_special_tokens=False))
    return "\0".join(pieces), counts


class Lengths(dict):
    """Pre-token -> number of tokens; a missing one is encoded and kept."""

    def __init__(self, frequent: tuple[str, bytes], tok):
        super().__init__(zip(frequent[0].split("\0"), frequent[1], strict=True))
        self.tok, self.frequent, self.full = tok, frequent, len(self) + CACHE

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.full:
            self.clear()
            self.update(zip(self.frequent[0].split("\0"), self.frequent[1], strict=True))
        n = self[piece] = len(self.tok.encode(piece, add_special_tokens=False))
        return n


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as the empty text: 0 bytes, 0 tokens, not over the limit.  Repeated rows and null
    ids stay, one row each.  Other columns of docs are ignored, whatever their names.
    ``tokenizer`` is a name that ``public_tokenizers.path`` knows on driver and executors.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, split = load_tokenizer(tokenizer), regex.compile(PRETOKEN).findall
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        lengths = Lengths(sent.value, tok)
        for b in slices(batches, "text", 1 << 23):
            sizes, counts = [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                if text and (max(text) >= SAFE or any(s in text for s in special)):
                    counts.append(len(tok.encode(text, add_special_tokens=False)))
                else:
                    counts.append(sum(map(lengths.__getitem__, split(text))))
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
