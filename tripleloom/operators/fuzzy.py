"""Fuzzy scores over distinct pairs, in Arrow batches."""

from __future__ import annotations

import math
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tripleloom.functions.text import n2, ngrams


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    """Share (0..100) of characters kept by insertions and deletions alone."""
    if not a and not b:
        return 100.0
    return 200.0 * common_length(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of the longer, also cut at its ends."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    letters = set(short)
    best = 0.0
    for end in range(1, len(long) + n):
        begin = max(0, end - n)
        window = long[begin : min(end, len(long))]
        edge = window[-1] if end <= len(long) else window[0]
        if edge in letters:
            best = max(best, ratio(short, window))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """Of white-space tokens as sets; 100 if they meet and one side has nothing more."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = " ".join(p for p in (both, left) if p), " ".join(p for p in (both, right) if p)
    scores = [ratio(one, two)]
    if both:
        scores += [ratio(both, one), ratio(both, two)]
    return max(scores)


def weighted_ratio(a: str, b: str) -> float:
    """Of texts without spaces: whole, or for unlike lengths the scaled best part."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return ratio(a, b)
    scale = 0.6 if longer > 8 else 0.9
    return max(ratio(a, b), partial_ratio(a, b) * scale)


def grounded(value: str, evidence: str) -> bool:
    """Similar (0.98) to its evidence, with the same numbers in order; the argument order counts."""
    return re.findall(r"\d+", value) == re.findall(r"\d+", evidence) and SequenceMatcher(None, value, evidence).ratio() >= 0.98


def _pairwise(function):
    @pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


indel_ratio = _pairwise(ratio)
token_sets = _pairwise(token_set_ratio)
weighted = _pairwise(weighted_ratio)
sequence_ratio = _pairwise(lambda a, b: SequenceMatcher(None, a, b).ratio())


@lru_cache(maxsize=100_000)
def _trigrams(plain: str) -> tuple[Counter, float]:
    grams = Counter([plain] if 0 < len(plain) <= 3 else [plain[i : i + 3] for i in range(len(plain) - 2)])
    return grams, math.sqrt(sum(n * n for n in grams.values()))


def trigram_cosine(a: str, b: str) -> float:
    (x, nx), (y, ny) = _trigrams(a), _trigrams(b)
    if not nx or not ny:
        return 0.0
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    return sum(n * large.get(g, 0) for g, n in small.items()) / (nx * ny)


@pandas_udf(DoubleType())
def _lexical(a: pd.Series, b: pd.Series, plain_a: pd.Series, plain_b: pd.Series) -> pd.Series:
    out = []
    for x, y, p, q in zip(a, b, plain_a, plain_b, strict=True):
        out.append(None if x is None or y is None else max(ratio(p, q) / 100, token_set_ratio(x, y) / 100, trigram_cosine(p, q)))
    return pd.Series(out, dtype="float64")


def lexical_similarity(a: Column, b: Column) -> Column:
    """Greatest of the plain ratio, the token-set ratio of the raw texts and the trigram cosine; 0..1."""
    return _lexical(a, b, n2(a), n2(b))


def combined_score(lexical: Column, semantic: Column) -> Column:
    return F.round(F.lit(0.45) * lexical + F.lit(0.55) * semantic, 6)


def variant_suspects(terms: DataFrame, suffixes: tuple[str, ...] = ("대학", "학과", "학부", "전공")) -> DataFrame:
    """(term, alternative): rare terms of which a much commoner one of the same suffix and length is close.

    terms: (term, n). Equality on suffix and length comes first, the score after.
    """
    suffix = F.coalesce(*[F.when(F.col("term").endswith(s), F.lit(s)) for s in suffixes])
    rows = terms.where(~F.col("term").contains(" ") & (F.length("term") >= 4)).withColumn("suffix", suffix).where("suffix is not null").withColumn("size", F.length("term"))
    a = rows.select("term", "n", "suffix", "size")
    b = rows.select(F.col("term").alias("other"), F.col("n").alias("m"), "suffix", "size")
    pairs = a.join(b, ["suffix", "size"]).where("term != other and m >= greatest(5, 3 * n)")
    close = pairs.withColumn("score", sequence_ratio("term", "other")).where("score >= 0.8")
    return close.groupBy("term").agg(F.max(F.struct("m", "other")).alias("best")).select("term", F.col("best.other").alias("alternative"))


def typo_corrections(words: DataFrame, source: DataFrame) -> DataFrame:
    """(word, other): the one near source word of each unsupported word; best 0.75, next at most 0.67.

    words: (word); source: (word). Words meet on a shared two-character piece, which
    any pair of that similarity has.
    """
    pieces = lambda df, name: df.select(F.col("word").alias(name), F.explode(F.array_distinct(ngrams(F.col("word"), 2))).alias("piece"))
    pairs = pieces(words.join(source, "word", "left_anti").distinct(), "word").join(pieces(source.distinct(), "other"), "piece").select("word", "other").distinct()
    scored = pairs.where("abs(length(word) - length(other)) <= 3").withColumn("score", sequence_ratio("word", "other"))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "other"))
    two = scored.withColumn("place", place).where("place <= 2")
    best = two.groupBy("word").agg(F.max(F.when(F.col("place") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("place") == 1, F.col("other"))).alias("other"))
    return best.where("best >= 0.75 and coalesce(second, 0) <= 0.67").select("word", "other")


def close_matches(words: DataFrame, source: DataFrame, top: int = 3, cutoff: float = 0.65) -> DataFrame:
    """(word, other, score, place): the best source words of each word. words, source: (word).

    Words meet on a shared two-character piece and a compatible length before they are scored.
    """
    pieces = lambda df, name: df.select(F.col("word").alias("w")).distinct().select(F.col("w").alias(name), F.explode(F.array_distinct(ngrams(F.col("w"), 2))).alias("piece"))
    pairs = pieces(words, "word").join(pieces(source, "other"), "piece").select("word", "other").distinct()
    # a ratio of c needs 2 * min / sum of the lengths of at least c
    pairs = pairs.where(2 * F.least(F.length("word"), F.length("other")) >= cutoff * (F.length("word") + F.length("other")))
    scored = pairs.withColumn("score", sequence_ratio("word", "other")).where(F.col("score") >= cutoff)
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), F.desc("other")))
    return scored.withColumn("place", place).where(F.col("place") <= top)


def replaced_words(texts: DataFrame, corrections: DataFrame) -> DataFrame:
    """(text_id, text, n): whole words of texts (text_id, text) replaced by corrections (word, other), with their number."""
    parts = texts.select("text_id", F.posexplode(F.split("text", r"(?<=[가-힣A-Za-z])(?![가-힣A-Za-z])|(?<![가-힣A-Za-z])(?=[가-힣A-Za-z])")).alias("place", "word"))
    fixed = parts.join(corrections.select("word", "other"), "word", "left")
    piece = F.struct("place", F.coalesce("other", "word").alias("t"))
    return fixed.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p.t), "").alias("text"), F.count("other").alias("n"))
