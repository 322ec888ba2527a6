"""Text normalisers, n-grams, numbers and hashes as column expressions.

The normalisers differ on purpose; each has its own number. Only those with a
compatibility normalisation leave the JVM, as Arrow batches.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

KEPT = "[^0-9a-z가-힣]"
#: White space in Unicode's sense, which the JVM's \\s is not.
SPACE = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def n1(c: Column) -> Column:
    """Compatibility form, lower case, only digits, Latin and Hangul."""
    return F.regexp_replace(F.lower(nfkc(c)), KEPT, "")


def n2(c: Column) -> Column:
    """As n1 without compatibility form."""
    return F.regexp_replace(F.lower(c), KEPT, "")


def n3(c: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def n4(c: Column) -> Column:
    """Without white space and the marks of Markdown."""
    return F.regexp_replace(c, "(?:" + SPACE + "|[|`*_#])+", "")


def n5(c: Column) -> Column:
    """Compatibility form without white space."""
    return F.regexp_replace(nfkc(c), SPACE + "+", "")


def n6(c: Column) -> Column:
    """Full case folding, only digits, Latin and Hangul."""
    return F.regexp_replace(casefold(c), KEPT, "")


def n7(c: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(c), SPACE + "+", "")


def n8(c: Column) -> Column:
    """Without white space, case folded."""
    return casefold(F.regexp_replace(c, SPACE + "+", ""))


def n9(c: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(c, SPACE + "+", "")


def number_tokens(c: Column) -> Column:
    """Numbers in order, without leading zeros."""
    found = F.regexp_extract_all(c, F.lit("([0-9]+)"), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))


def ngrams(c: Column, n: int) -> Column:
    """Runs of n characters in order; a text of n or fewer is one, an empty one none."""
    size = F.length(c)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: c.substr(i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(c)).otherwise(cut)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def multiset_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays as multisets; empty gives 0."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x)).cast("double")
    total = lambda xs: F.aggregate(F.array_distinct(xs), F.lit(0.0), lambda acc, x: acc + count(xs, x) * count(xs, x))
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda acc, x: acc + count(a, x) * count(b, x))
    norm = F.sqrt(total(a)) * F.sqrt(total(b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; different lengths, empty or zero vectors give 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def short_hash(c: Column, size: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, size)


def stable_json(fields: dict[str, Column]) -> Column:
    """Compact JSON of string fields with sorted keys; a null field is null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.array(v.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(v.cast("string")))) - 2), F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def internal_id(c: Column) -> Column:
    """The last part of an IRI as an identifier of at most 64 signs that begins with a letter."""
    last = F.regexp_extract(c, "([^/#:]*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(last, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    named = F.when(plain.rlike("^[A-Za-z]"), plain).otherwise(F.concat(F.lit("e-"), plain))
    return F.substring(named, 1, 64)
