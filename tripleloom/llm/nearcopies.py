"""Near-duplicate records with small edits.

A record is the set of its character pieces. Its signature is ``SEGMENTS * CELLS``
one-permutation minimum hashes, seen as a word of ``CELLS`` symbols in each of
``SEGMENTS`` segments; a symbol ("bit") of two records agrees with the probability
of their Jaccard similarity. Segments are so few and long that similar records
differ in at most one symbol of some segment. Each segment is indexed under its
deletion variants, one for each symbol left out, and variants are joined by
equality: two records that differ in one symbol of a segment share the variant
without it. Candidates pass a packed comparison of the whole signatures and an
exact Jaccard check of their pieces.

With five symbols a segment and sixteen segments, a pair of similarity J meets
with probability 1 - (1 - J^5 - 5 J^4 (1-J))^16: 0.964 at 0.5, 0.998 at 0.6 and
over 0.9999 at 0.7.

Exact copies (equal piece streams) are one class before anything is joined, so a
group of copies adds one signature. Pairs of copies exist only in the result.

Defined results: a record with fewer characters than a piece has no pieces and is
in no pair; null messages, contents and quotes count as empty; rows that repeat a
key count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.components import components
from tripleloom.llm.shingles import folded, inside, rolling, stream
from tripleloom.session import BROADCAST_KEY_LIMIT, materialise, rows_of_keys

WIDTH = 5
SIMILARITY = 0.5
SEGMENTS, CELLS = 16, 5
SYMBOLS = SEGMENTS * CELLS
#: Longs of the packed signature, each of 16 symbols cut to four bits.
PACKED = 3
#: Pairs whose packed signatures agree in fewer symbols are dropped unseen: 3.3 deviations under the mean at 0.5.
LEAST_SYMBOLS = 14
#: A variant of about so many rows is hot; it is guessed from one id in ``SAMPLED`` and spread over ``SALTS`` blocks.
HOT, SAMPLED, SALTS = 4096, 64, 16


def _space_table() -> np.ndarray:
    table = np.ones(0x110000, bool)
    for o in [*range(0x3001), 0xFEFF]:
        if chr(o).isspace():
            table[o] = False
    return table


_KEEP: list[np.ndarray] = []


def _keep() -> np.ndarray:
    if not _KEEP:
        _KEEP.append(_space_table())
    return _KEEP[0]


def pieces(text: str) -> set[str]:
    """Runs of five characters of the text in NFKC and lower case without white space."""
    plain = "".join(folded(text).split())
    return {plain[i : i + WIDTH] for i in range(len(plain) - WIDTH + 1)}


def jaccard(a: str, b: str) -> float:
    x, y = pieces(a), pieces(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, symbols, size) of each text.

    One permutation: a piece's hash chooses a cell and the least value of a cell is
    its symbol; an empty cell takes the next filled one's, as usual, with its distance.
    """
    codes, offsets = stream(texts, _keep())
    hashes = rolling(codes, WIDTH)
    size, first = inside(offsets, WIDTH, len(hashes))
    n = len(texts)
    digests = np.zeros(n, np.int64)
    symbols = np.zeros((n, SYMBOLS), np.uint64)
    row = np.repeat(np.arange(n), size)
    total = int(size.sum())
    if total:
        at = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
        h = hashes[at]
        # the order of pieces counts for the digest: copies are equal streams
        place = np.arange(total) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
        mixed = (h ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xA0761D6478BD642F)
        filled = np.flatnonzero(size)
        digests[filled] = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), np.concatenate(([0], np.cumsum(size[filled])[:-1]))).view(np.int64)
        cell = row * SYMBOLS + ((h >> np.uint64(40)) % np.uint64(SYMBOLS)).astype(np.int64)
        value = (h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(8)
        least = np.full(n * SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, cell, value)
        first_filled = least.reshape(n, SYMBOLS)
        symbols = first_filled.copy()
        vacant = first_filled == np.iinfo(np.uint64).max
        empty = vacant.copy()
        empty[size == 0] = False
        for step in range(1, SYMBOLS):
            if not empty.any():
                break
            donor = np.roll(first_filled, -step, axis=1)
            usable = empty & ~np.roll(vacant, -step, axis=1)
            symbols[usable] = donor[usable] + np.uint64(step * 0x5851F42D)
            empty &= ~usable
    return digests, symbols, size


def _packed(symbols: np.ndarray) -> list[np.ndarray]:
    nibbles = ((symbols * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(60)).astype(np.uint64)
    out = []
    for k in range(PACKED):
        word = np.zeros(len(symbols), np.uint64)
        for j in range(16):
            word |= nibbles[:, k * 16 + j] << np.uint64(4 * j)
        out.append(word.view(np.int64))
    return out


def variant_index(classes: DataFrame) -> DataFrame:
    """(variant, id): 64-bit keys of the deletion variants, (segment, symbol left out, the other symbols)."""
    parts = classes.select("id", F.posexplode("segments").alias("segment", "word"))
    keys = [F.xxhash64(F.lit(out), "segment", *[f"word.s{j}" for j in range(CELLS) if j != out]) for out in range(CELLS)]
    return parts.select(F.explode(F.array(*keys)).alias("variant"), "id")


SIGNATURE_SCHEMA = "key string, digest long, size int, segments array<struct<" + ",".join(f"s{j}:int" for j in range(CELLS)) + ">>, " + ", ".join(f"w{k} long" for k in range(PACKED))


def signed(rows: DataFrame) -> DataFrame:
    """Signatures of rows (key, text); texts without pieces are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                digest, symbols, size = signatures(part.column(1).to_pylist())
                have = np.flatnonzero(size)
                symbols = symbols[have]
                words = ((symbols * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(-1, CELLS)
                offsets = pa.array(np.arange(0, (len(have) + 1) * SEGMENTS, SEGMENTS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(have)),
                        pa.array(digest[have]),
                        pa.array(size[have].astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, j])) for j in range(CELLS)], names=[f"s{j}" for j in range(CELLS)])),
                        *[pa.array(w) for w in _packed(symbols)],
                    ],
                    names=["key", "digest", "size", "segments", *[f"w{k}" for k in range(PACKED)]],
                )

    return rows.select("key", "text").mapInArrow(run, SIGNATURE_SCHEMA)


def _agreeing(a: str, b: str) -> Column:
    """Symbols in which two packed signatures agree."""
    differing = []
    for k in range(PACKED):
        x = f"({a}.w{k} ^ {b}.w{k})"
        differing.append(F.expr(f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)"))
    return F.lit(16 * PACKED) - reduce(lambda p, q: p + q, differing)


def _meeting(index: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of ids that share a variant, a < b, of rows (variant, id).

    Hot variants are guessed from a hashed sample of the ids, which only decides how the
    work is spread: their rows are split into ``SALTS`` blocks and every row meets every
    block, so that no task holds a whole hot variant. All other rows join by the variant.
    """
    sampled = index.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).groupBy("variant").count()
    hot = materialise(sampled.where(F.col("count") >= HOT // SAMPLED).select("variant"), "near-copy-hot")

    def pairs(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        x, y = left.alias("l"), right.alias("r")
        same = reduce(lambda p, q: p & q, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on])
        return x.join(y, same & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))

    if hot.limit(1).count() == 0:
        return pairs(index, index, "variant").distinct()
    cold = rows_of_keys(index, hot, "variant", present=False)
    placed = rows_of_keys(index, hot, "variant").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    everywhere = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs(cold, cold, "variant").unionByName(pairs(everywhere, placed, "variant", "block")).distinct()


def near_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Near copies among rows (key, text).

    Returns (members, pairs): ``members`` (key, class) holds each key with pieces and
    the key that stands for its class of exact copies; ``pairs`` (class_a, class_b,
    similarity) the classes of similarity ``SIMILARITY`` or more.
    """
    signature = materialise(signed(rows).withColumn("id", F.monotonically_increasing_id()), "near-copy-signatures")
    # one key stands for each class of copies; only keys and digests are aggregated
    least = signature.groupBy("digest").agg(F.min(F.struct("key", "id")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = materialise(least, "near-copy-repeated")
    few = repeated.limit(BROADCAST_KEY_LIMIT + 1).count() <= BROADCAST_KEY_LIMIT
    named = signature.select("key", "id", "digest").join(F.broadcast(repeated) if few else repeated, "digest", "left")
    members = named.select("key", "id", F.coalesce("first.key", "key").alias("class"), F.coalesce("first.id", "id").alias("class_id"))
    spare = materialise(members.where("id != class_id"), "near-copy-spare")
    classes = rows_of_keys(signature, spare.select("id"), "id", present=False)
    met = _meeting(variant_index(classes))
    packed = signature.select("id", "key", "size", *[f"w{k}" for k in range(PACKED)])
    x, y = packed.alias("x"), packed.alias("y")
    close = (
        met.join(x, F.col("a") == F.col("x.id"))
        .join(y, F.col("b") == F.col("y.id"))
        # a set can't be similar to one more than twice its size; sizes here count repeated pieces, hence the slack
        .where((F.least("x.size", "y.size") * 3 >= F.greatest("x.size", "y.size")) & (_agreeing("x", "y") >= LEAST_SYMBOLS))
        .select(F.col("x.key").alias("p"), F.col("y.key").alias("q"))
    )
    close = materialise(close, "near-copy-candidates")
    wanted = close.select(F.explode(F.array("p", "q")).alias("key")).distinct()
    texts = rows_of_keys(rows, wanted, "key").dropDuplicates(["key"])
    return members.select("key", "class").distinct(), _verified(close, texts)


def record_classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, class_id, links): each key with the least key of its connected class and its number of linked classes of copies.

    Links of a key are the pairs of its class of exact copies; copies are not expanded.
    """
    ends = pairs.select(F.col("class_a").alias("class")).unionByName(pairs.select(F.col("class_b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    roots = components(members.select(F.col("class").alias("id")).distinct(), pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    out = members.join(roots.withColumnRenamed("id", "class"), "class").join(ends, "class", "left")
    return out.select("key", F.col("root").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _verified(close: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("key").alias("p"), F.col("text").alias("text_p"))
    b = texts.select(F.col("key").alias("q"), F.col("text").alias("text_q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            share = [jaccard(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = [i for i, s in enumerate(share) if s >= SIMILARITY]
            yield pa.RecordBatch.from_arrays(
                [pa.array([min(p[i], q[i]) for i in keep], pa.string()), pa.array([max(p[i], q[i]) for i in keep], pa.string()), pa.array([share[i] for i in keep], pa.float64())],
                names=["class_a", "class_b", "similarity"],
            )

    return close.join(a, "p").join(b, "q").select("p", "q", "text_p", "text_q").mapInArrow(run, "class_a string, class_b string, similarity double")


def record_text(qa: DataFrame) -> DataFrame:
    """(key, text): all contents of messages, then all quotes of evidence, joined."""
    contents = F.transform(F.coalesce(F.col("messages"), F.array()), lambda m: F.coalesce(m["content"], F.lit("")))
    quotes = F.transform(F.coalesce(F.col("evidence"), F.array()), lambda e: F.coalesce(e["quote"], F.lit("")))
    return qa.where(F.col("conversation_id").isNotNull()).select(F.col("conversation_id").alias("key"), F.concat(F.array_join(contents, ""), F.array_join(quotes, "")).alias("text"))


def repeated_records(qa: DataFrame) -> DataFrame:
    """(conversation_id_a, conversation_id_b): all pairs of near copies, smaller first."""
    members, pairs = near_copies(record_text(qa))
    spare = materialise(members.where("key != class"), "near-copy-members")
    # all keys of the classes that have copies; any other class stands for itself
    keys = spare.unionByName(spare.select(F.col("class").alias("key"), "class").distinct())

    def with_copies(df: DataFrame, column: str) -> DataFrame:
        # the pairs are named once, so that each is compared once
        named = df.join(keys.select(F.col("class").alias(column), "key"), column, "left")
        return named.withColumn(column, F.coalesce("key", column)).drop("key")

    across = with_copies(with_copies(pairs.select("class_a", "class_b"), "class_a"), "class_b").select(F.col("class_a").alias("ka"), F.col("class_b").alias("kb"))
    # pairs inside a class of copies are the result itself
    first = spare.select(F.col("class").alias("ka"), F.col("key").alias("kb"))
    a, b = spare.alias("a"), spare.alias("b")
    others = a.join(b, (F.col("a.class") == F.col("b.class")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("ka"), F.col("b.key").alias("kb"))
    both = across.unionByName(first).unionByName(others)
    return both.select(F.least("ka", "kb").alias("conversation_id_a"), F.greatest("ka", "kb").alias("conversation_id_b")).distinct()


def classed_records(qa: DataFrame) -> DataFrame:
    """(conversation_id, class_id, links): one row for each record with pieces."""
    members, pairs = near_copies(record_text(qa))
    # links and components both read the pairs; they are compared once
    return record_classes(members, materialise(pairs, "near-copy-pairs")).withColumnRenamed("key", "conversation_id")
