"""Visually identical text with different characters.

``canonical`` gives the one form: compatibility normalisation in composed form,
look-alike letters mapped to the script of their word, white space mapped to the
ordinary space, default-ignorable characters removed and, if asked, full case
folding. It runs once for each distinct value of an Arrow batch.

Defined results: null stays null and is never a changed record; empty text stays
empty; text that is only white space becomes ordinary spaces; line feeds and tabs
are layout and stay; repeated rows give equal results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default-ignorable code points that occur in running text.
IGNORABLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f"
    "\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
#: Joiners and selectors that build emoji are right where they stand.
_IGNORE = re.compile(f"[{IGNORABLE}]")
_EMOJI_JOIN = re.compile("(?<=[←-⯿〰〽\U0001f000-\U0001faff\ufe0f])[\u200d\ufe0f]|[\ufe0f](?=⃣)")
_SPACE = re.compile("[\u0085\u00a0\u000b\u000c\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Anything that can need a change lies outside ASCII and the precomposed syllables.
SUSPECT_JAVA = "[^\\x00-\\x0a\\x0d-\\x7f\\uac00-\\ud7a3]|[\\x0b\\x0c]"

# Cyrillic and Greek letters that look like Latin ones.
CONFUSABLE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "а": "a", "в": "b", "е": "e", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n",
    "ϲ": "c", "ѵ": "v", "ь": "b", "ʏ": "y", "ɡ": "g", "ɑ": "a",
}
_BACK = {"Cyrillic": {}, "Greek": {}}
for _odd, _latin in CONFUSABLE.items():
    _name = "Cyrillic" if "Ѐ" <= _odd <= "ԯ" else "Greek" if "Ͱ" <= _odd <= "Ͽ" else None
    if _name:
        _BACK[_name].setdefault(_latin, _odd)
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏɐ-ʯḀ-ỿ"
_GREEK = "Ͱ-ͳͶ-ͽΆ-Ͽἀ-\u1fff"
_CYRILLIC = "Ѐ-ԯ"
_RUN = re.compile(f"[{_LATIN}{_GREEK}{_CYRILLIC}]+")
_HAS = {"Latin": re.compile(f"[{_LATIN}]"), "Greek": re.compile(f"[{_GREEK}]"), "Cyrillic": re.compile(f"[{_CYRILLIC}]")}
_ODD = re.compile(f"[{_GREEK}{_CYRILLIC}]")


def _one_script(match: re.Match) -> str:
    word = match[0]
    counts = {name: len(p.findall(word)) for name, p in _HAS.items()}
    present = [name for name, n in counts.items() if n]
    if len(present) < 2:
        return word
    # a word is Latin unless a letter of the other script has no Latin look-alike
    foreign = [c for c in word if _ODD.match(c) and c not in CONFUSABLE]
    if not foreign:
        return "".join(CONFUSABLE.get(c, c) for c in word)
    script = max((n for n in present if n != "Latin"), key=lambda n: counts[n])
    return "".join(_BACK[script].get(c, c) for c in word)


def canonical(text: str | None, fold: bool = False) -> str | None:
    """The one form of ``text``; with ``fold`` also without case."""
    if text is None:
        return None
    if not text.isascii():
        kept = _EMOJI_JOIN.sub("\ue000", text) if "\u200d" in text or "\ufe0f" in text else text
        kept = _IGNORE.sub("", kept)
        if "\ue000" in kept and "\ue000" not in text:
            joins = iter(_EMOJI_JOIN.findall(text))
            kept = re.sub("\ue000", lambda _: next(joins, ""), kept)
        kept = _SPACE.sub(" ", kept)
        kept = unicodedata.normalize("NFKC", kept)
        if _ODD.search(kept):
            kept = _RUN.sub(_one_script, kept)
        text = kept
    else:
        text = text.replace("\x0b", " ").replace("\x0c", " ")
    return unicodedata.normalize("NFKC", text.casefold()) if fold else text


def _distinct_apply(column: pa.ChunkedArray | pa.Array, fold: bool) -> pa.Array:
    coded = column.dictionary_encode()
    values = [canonical(v, fold) for v in coded.dictionary.to_pylist()]
    return pa.array(values, pa.string()).take(coded.indices)


def canonicalise(df: DataFrame, column: str, out: str = "canonical", fold: bool = True) -> DataFrame:
    """``df`` with the canonical form of ``column`` under ``out`` (replaced if there).

    Rows without a suspect character never leave the JVM.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])
    base = df.drop(out) if out != column and out in df.columns else df
    suspect = F.coalesce(F.col(column).rlike(SUSPECT_JAVA), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = _distinct_apply(batch.column(batch.schema.get_field_index(column)), fold)
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            columns[out] = done
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    plain = base.where(~suspect).withColumn(out, F.lower(column) if fold else F.col(column)).select([f.name for f in schema.fields])
    return base.where(suspect).mapInArrow(run, schema).unionByName(plain)


def changed_records(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys (as strings) of the records whose ``column`` has a character to change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            odd = pa.array([v is not None and canonical(v) != v for v in coded.dictionary.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(odd.take(coded.indices))], names=["record_id"])

    rows = df.where(F.col(column).rlike(SUSPECT_JAVA)).select(F.col(key).cast("string").alias("record_id"), F.col(column).alias("value"))
    return rows.mapInArrow(run, "record_id string").distinct()
