"""Encoding of a corpus with a public byte-level BPE vocabulary.

The encoder is the prefix dynamic programme: for every byte prefix of a word it
keeps the one token that can end a valid encoding of that prefix. A token that
ends at byte ``i`` is that token if the encoding of the prefix before it ends in
a token with which it forms a compatible pair, i.e. byte-pair merging of the two
together gives the two back. The table of last tokens makes appends exact and
local edits cheap: only positions after the first changed byte are recomputed.

Defined results: null and empty text give an empty list; blank text is encoded;
text of special tokens is ordinary text; repeated rows of one key give one row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.session import one_row_per_key

VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Split of the public vocabulary's authors into words before byte pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose ids one Python worker keeps; more only costs encoding again.
CACHE_WORDS = 400_000


class PrefixEncoder:
    """Byte-pair encoder over a rank table, by the last token of each prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self._pairs: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain byte-pair merging; used for token pairs only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        known = self._pairs.get(pair)
        if known is None:
            known = self._pairs[pair] = self.merge(left + right) == [left, right]
            if len(self._pairs) > CACHE_WORDS:
                self._pairs.clear()
        return known

    @lru_cache(maxsize=65536)  # noqa: B019 - one encoder lives as long as its worker
    def _whole(self, token: bytes) -> bool:
        return self.merge(token) == [token]

    def prefixes(self, word: bytes, known: list[bytes] | None = None, start: int = 0) -> list[bytes]:
        """The last token of each prefix of ``word``; entry 0 is empty.

        ``known`` is the table of a word that agrees with this one on its first
        ``start`` bytes.
        """
        last: list[bytes] = list(known[: start + 1]) if known else [b""]
        ranks, compatible = self.ranks, self.compatible
        for end in range(len(last), len(word) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = word[begin:end]
                if token not in ranks:
                    continue
                if (begin == 0 and self._whole(token)) or (begin and compatible(last[begin], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return last

    def tokens(self, last: list[bytes]) -> list[int]:
        at, out = len(last) - 1, []
        while at:
            out.append(self.ranks[last[at]])
            at -= len(last[at])
        return out[::-1]

    def encode(self, word: bytes) -> list[int]:
        if word in self.ranks and self._whole(word):
            return [self.ranks[word]]
        return self.tokens(self.prefixes(word))

    def append(self, last: list[bytes], word: bytes, more: bytes) -> list[bytes]:
        """The table of ``word + more`` from that of ``word``."""
        return self.prefixes(word + more, last, len(word))

    def edit(self, last: list[bytes], old: bytes, new: bytes) -> list[bytes]:
        """The table of ``new`` from that of ``old``: work starts at the first change."""
        same = next((i for i, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
        return self.prefixes(new, last, same)


@lru_cache(maxsize=4)
def load_encoder(directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> PrefixEncoder:
    with open(f"{directory}/{name}", "rb") as lines:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})


def encode_table(df: DataFrame, key: str, column: str, directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of ``column``, one row for each key.

    The vocabulary file is read where the driver is and shipped to the executors.
    """
    df.sparkSession.sparkContext.addFile(f"{directory}/{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encoder, split = load_encoder(SparkFiles.getRootDirectory(), name), regex.compile(PATTERN).findall
        cache: dict[str, list[int]] = {}

        class Words(dict):
            def __missing__(self, word: str) -> list[int]:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                ids = encoder.encode(word.encode("utf-8"))
                if len(word) < 200:
                    self[word] = ids
                return ids

        cache = Words()
        for batch in batches:
            offsets, flat = [0], []
            extend = flat.extend
            for text in batch.column(1).to_pylist():
                if text:
                    for word in split(text):
                        extend(cache[word])
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    rows = one_row_per_key(df.select(key, F.col(column).alias("__text")), key)
    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, ids array<int>")
