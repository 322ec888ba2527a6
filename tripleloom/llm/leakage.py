"""Evaluation passages leaking into a training corpus.

Passages and documents become streams of letters and digits (width, case, spacing,
line breaks and punctuation are gone) and sets of their character shingles. The
set join orders the shingles of each passage by rarity, counted over all
documents, and joins only the prefix that any document with enough overlap must
meet in at least ``j`` places. A length bound and a count bound over the whole
set follow. Verification is exact: shingle matches of the pair are chained along
their diagonals into stretches of the passage, and the words inside the best one
or two stretches, in order in both texts, are counted.

The passages are a fixed table; it is broadcast only if it has at most
``PASSAGE_LIMIT`` rows and is split into blocks of that many rows beyond it.

Defined results: null, empty and letterless texts match nothing; repeated rows give
one row; passages shorter than ``WIDTH`` characters match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from tripleloom.llm.shingles import alnum_table, folded, inside, rolling, stream

WIDTH = 8
#: Overlap that half a passage keeps if more than one word in ten differs.
OVERLAP = 0.20
#: Places in which the rarity-ordered prefix must be met, as a share of the set.
MEET = 0.15
#: Share of the passage's words that one or two stretches must span.
LEAST = 0.48
#: A stretch goes on over a gap of so many characters and a shift of so many.
GAP, SHIFT = 36, 14
#: Share of a stretch's words that must match exactly.
PURITY = 0.8
PASSAGE_LIMIT = 5_000


class PassageIndex:
    """Shingles of passages, with postings in a compressed sparse layout."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        codes, offsets = stream(texts, alnum_table())
        hashes = rolling(codes, WIDTH)
        size, first = inside(offsets, WIDTH, len(hashes))
        self.codes = [codes[offsets[i] : offsets[i + 1]] for i in range(len(ids))]
        self.hashes = [hashes[first[i] : first[i] + size[i]] for i in range(len(ids))]
        self.word_ends = []
        for text in texts:
            lengths = [sum(c.isalnum() for c in w) for w in re.split(r"[^\w]+", folded(text).replace("_", " "))]
            self.word_ends.append(np.cumsum([n for n in lengths if n]))
        # words that end up to, and that begin before, each character
        self.word_counts = []
        for codes_of, ends in zip(self.codes, self.word_ends, strict=True):
            characters = np.arange(len(codes_of) + 3)
            begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            self.word_counts.append((np.searchsorted(ends, characters, "right").tolist(), np.searchsorted(begins, characters, "left").tolist()))
        sets = [np.unique(h) for h in self.hashes]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.vocabulary = np.unique(np.concatenate(sets)) if sets and sum(map(len, sets)) else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(ids)), self.sizes)
        code = np.searchsorted(self.vocabulary, np.concatenate(sets)) if len(item) else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.posting_item, self.posting_code = item[order], code[order]
        self.starts = np.searchsorted(self.posting_code, np.arange(len(self.vocabulary) + 1))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._slot(self.vocabulary)] = True
        self.in_prefix = np.ones(len(self.posting_item), bool)
        self.mask = np.zeros(len(self.vocabulary), bool)
        self.item_codes = []
        for hashes in self.hashes:
            codes_here = np.searchsorted(self.vocabulary, hashes)
            order = np.argsort(codes_here, kind="stable")
            self.item_codes.append((codes_here[order], order))

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(40)) & np.uint64((1 << 22) - 1)

    def order_by_rarity(self, frequency: np.ndarray) -> None:
        """Keeps in each passage's prefix all but its most frequent shingles."""
        rank = np.lexsort((self.posting_code, frequency[self.posting_code], self.posting_item))
        begin = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        place = np.empty(len(rank), int)
        place[rank] = np.arange(len(rank))
        place -= begin[self.posting_item]
        length = self.sizes - np.ceil(OVERLAP * self.sizes) + np.ceil(MEET * self.sizes)
        self.in_prefix = place < length[self.posting_item]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are in the vocabulary, and their codes."""
        if not len(self.vocabulary):
            return np.zeros(0, int), np.zeros(0, int)
        at = np.flatnonzero(self.bits[self._slot(hashes)])
        code = np.searchsorted(self.vocabulary, hashes[at])
        code[code == len(self.vocabulary)] = 0
        hit = self.vocabulary[code] == hashes[at]
        return at[hit], code[hit]

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Passages whose prefix and whole set the distinct ``codes`` meet often enough."""
        counts = self.starts[codes + 1] - self.starts[codes]
        total = int(counts.sum())
        if not total:
            return np.zeros(0, int)
        slots = np.repeat(self.starts[codes] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
        items = self.posting_item[slots]
        whole = np.bincount(items, minlength=len(self.ids))
        prefix = np.bincount(items[self.in_prefix[slots]], minlength=len(self.ids))
        return np.flatnonzero((whole >= OVERLAP * self.sizes) & (prefix >= MEET * self.sizes) & (self.sizes > 0))


def _stretches(pairs_doc: np.ndarray, pairs_item: np.ndarray) -> list[tuple[int, int, int, int, list]]:
    """Chains of shingle matches: (item begin, item end, doc begin, doc end, runs).

    Runs are the item's matched intervals inside the chain.
    """
    order = np.lexsort((pairs_item, pairs_doc))
    open_chains: list[list] = []  # item begin, item end, doc begin, doc end, matched characters, runs
    done: list[tuple[int, int, int, int, list]] = []
    # maximal runs along one diagonal first
    d, p = pairs_doc[order], pairs_item[order]
    diagonal = d - p
    run_order = np.lexsort((d, diagonal))
    d, p, diagonal = d[run_order], p[run_order], diagonal[run_order]
    breaks = np.flatnonzero((np.diff(d) != 1) | (np.diff(diagonal) != 0)) + 1
    begins = np.concatenate(([0], breaks))
    ends = np.concatenate((breaks, [len(d)])) - 1
    runs = sorted((int(d[b]), int(d[e]) + WIDTH, int(p[b]), int(p[e]) + WIDTH) for b, e in zip(begins, ends, strict=True))
    for d0, d1, p0, p1 in runs:
        best, at = -1, None
        for chain in open_chains:
            gap_d, gap_p = d0 - chain[3], p0 - chain[1]
            if -WIDTH <= gap_d <= GAP and -WIDTH <= gap_p <= GAP and abs(gap_d - gap_p) <= SHIFT and p1 > chain[1] and chain[4] > best:
                best, at = chain[4], chain
        if at is None:
            open_chains.append([p0, p1, d0, d1, p1 - p0, [(p0, p1)]])
        else:
            at[4] += p1 - max(p0, at[1])
            at[5].append((p0, p1))
            at[1], at[3] = p1, max(at[3], d1)
        if len(open_chains) > 64:
            done += [(*c[:4], c[5]) for c in open_chains if c[3] < d0 - GAP]
            open_chains = [c for c in open_chains if c[3] >= d0 - GAP]
    done += [(*c[:4], c[5]) for c in open_chains]
    return done


def leaked_share(index: PassageIndex, item: int, at: np.ndarray, codes: np.ndarray) -> float:
    """Share of the passage's words in the best one or two stretches of a document.

    ``at`` and ``codes``: positions and codes of the document's shingles that are in any passage.
    """
    ordered, places = index.item_codes[item]
    mask = index.mask
    mask[ordered] = True
    chosen = np.flatnonzero(mask[codes])
    mask[ordered] = False
    # positional bound: two windows of the passage's length must hold the overlap
    where = at[chosen]
    most = int((np.searchsorted(where, where + int(1.3 * len(places)) + WIDTH, "right") - np.arange(len(where))).max(initial=0))
    if 2 * most < OVERLAP * index.sizes[item]:
        return 0.0
    low = np.searchsorted(ordered, codes[chosen], "left")
    counts = np.searchsorted(ordered, codes[chosen], "right") - low
    doc = np.repeat(at[chosen], counts)
    slots = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(len(doc))
    ends = index.word_ends[item]
    begins = np.concatenate(([0], ends[:-1]))
    words = len(ends)
    if not words or not len(doc):
        return 0.0
    # no more words can match in stretches than match anywhere in the document
    change = np.zeros(len(index.codes[item]) + 1, np.int64)
    met = np.unique(places[slots])
    change[met] += 1
    change[met + WIDTH] -= 1
    covered = np.concatenate(([0], np.cumsum(np.cumsum(change)[:-1] > 0)))
    if int((covered[ends] - covered[begins] == ends - begins).sum()) < PURITY * LEAST * words:
        return 0.0
    ended, begun = index.word_counts[item]
    chains = []
    for p0, p1, d0, d1, runs in _stretches(doc, places[slots]):
        # words that begin and end inside, give or take two characters
        spanned = ended[p1 + 2] - begun[max(p0 - 2, 0)]
        if spanned >= 3 and p1 - p0 >= 1.5 * WIDTH:
            chains.append((spanned, p0, p1, d0, d1, runs))
    chains.sort(key=lambda c: -c[0])
    if sum(c[0] for c in chains[:2]) < LEAST * words:
        return sum(c[0] for c in chains[:2]) / words
    good = []
    for spanned, p0, p1, d0, d1, runs in chains:
        exact = np.zeros(words, bool)
        for a, b in runs:
            exact[np.searchsorted(begins, a, "left") : np.searchsorted(ends, b, "right")] = True
        if exact.sum() >= PURITY * spanned:
            good.append((p0, p1, d0, d1, spanned))
    if not good:
        return 0.0
    best = good[0][4]
    for i, first in enumerate(good):
        if 2 * first[4] <= best:
            break  # no later pair can be better: they are sorted by length
        for second in good[i + 1 :]:
            if first[4] + second[4] <= best:
                break
            a, b = (first, second) if first[0] <= second[0] else (second, first)
            if b[0] >= a[1] - WIDTH and b[2] >= a[3] - WIDTH:
                best = first[4] + second[4]
                break
    return best / words


def _each_document(batch_text: list[str | None], index: PassageIndex):
    """(row, positions of the shingles that are in any passage, their codes) of each document with some."""
    codes, offsets = stream(batch_text, alnum_table())
    hashes = rolling(codes, WIDTH)
    size, first = inside(offsets, WIDTH, len(hashes))
    at, code = index.lookup(hashes)
    left, right = np.searchsorted(at, first), np.searchsorted(at, first + size)
    for row in np.flatnonzero(right > left):
        yield row, at[left[row] : right[row]] - first[row], code[left[row] : right[row]]


def shingle_frequency(documents: DataFrame, column: str, index_of) -> DataFrame:
    """(code, n): in how many documents each passage shingle is, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        total = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches:
            for _, _, code in _each_document(batch.column(0).to_pylist(), index):
                total[np.unique(code)] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["code", "n"])

    return documents.select(column).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def leaked(documents: DataFrame, doc_key: str, column: str, passages: DataFrame, item_key: str, passage: str) -> DataFrame:
    """(doc_key, item_key): documents that hold at least half of a passage."""
    spark = documents.sparkSession
    items = passages.where(F.col(passage).isNotNull()).select(item_key, passage).dropDuplicates([item_key])
    total = items.count()
    blocks = max(1, -(-total // PASSAGE_LIMIT))
    parts = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == block).orderBy(item_key).collect() if blocks > 1 else items.orderBy(item_key).collect()
        parts.append(_leaked_block(spark, documents, doc_key, column, [r[0] for r in rows], [r[1] for r in rows], item_key, dict(passages.dtypes)[item_key]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _leaked_block(spark, documents, doc_key, column, ids, texts, item_key, item_type) -> DataFrame:
    shared = spark.sparkContext.broadcast((ids, texts))
    item_arrow = to_arrow_type(_parse_datatype_string(item_type))
    cache: dict[str, PassageIndex] = {}

    def index_of() -> PassageIndex:
        if "index" not in cache:
            cache["index"] = PassageIndex(*shared.value)
        return cache["index"]

    size = len(PassageIndex(ids, texts).vocabulary)
    frequency = np.zeros(size, np.int64)
    # one number for each passage shingle: bounded by the passages, not by the corpus
    for row in shingle_frequency(documents, column, index_of).toLocalIterator():
        frequency[row[0]] = row[1]
    rarity = spark.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PassageIndex(*shared.value)
        index.order_by_rarity(rarity.value)
        for batch in batches:
            rows, items = [], []
            for row, at, code in _each_document(batch.column(1).to_pylist(), index):
                for item in index.candidates(np.unique(code)):
                    if leaked_share(index, item, at, code) >= LEAST:
                        rows.append(row)
                        items.append(index.ids[item])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, item_arrow)], names=[doc_key, item_key])

    return documents.select(F.col(doc_key), F.col(column).alias("__text")).mapInArrow(run, f"{doc_key} {dict(documents.dtypes)[doc_key]}, {item_key} {item_type}").distinct()
