"""Keyword-stuffed and link-list pages.

A page is cut into tokens with their character lengths. Three measures mark
stretches of it as matter other than sentences:

* links: addresses, anchors with their labels, and tags, in runs that no sentence
  interrupts;
* periods: runs in which every token equals the one a fixed lag before it, at least
  ``PERIODS`` times over (positional autocorrelation at each lag of the window), whatever
  their words;
* regular recurrence: for each term the gaps between its occurrences and, over
  the page, the share of positions whose token comes again within a lag window, or
  within about the term's own gap if its gaps are even (positional autocorrelation).
  Sentences repeat words rarely and at uneven gaps; stuffed lists repeat terms at even ones;
* bare lists: runs of distinct nouns without the particles, endings and function
  words of sentences, whose entries carry no numbers that tell them apart.

A page is reported if such stretches hold more than half of its characters.
Defined results: null, empty and blank pages are not reported; repeated rows give
one row; a text of any length is read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.lookalike import SUSPECT_JAVA, canonical

#: A position is dense if so large a share of the window around it recurs within the lag window.
WINDOW, LAGS, DENSE = 12, 24, 0.62
#: A term of so many gaps or more, whose deviation is at most this part of their mean, recurs in a cycle of any length.
CYCLES, EVEN = 2, 0.6
#: Times that a period of at most ``LAGS`` tokens is repeated, and tokens that the repetition holds at least.
PERIODS, PERIOD_LEAST = 4, 16
#: Tokens that a run of distinct nouns has at least.
LIST = 24
SHARE = 0.5

_SUSPECT = re.compile(SUSPECT_JAVA)
# Signs of links and tags.
_LINK = re.compile(r"(?:https?://|www\.)\S+|[\w.-]+\.(?:com|net|org|kr|example|test|invalid|info|shop|biz|xyz)(?:/\S*)?", re.I)
_ANCHOR = re.compile(r"<a\s[^>]*>.*?</a>|!?\[[^\[\]\n]{0,80}\]\([^()\s]*\)", re.I | re.S)
_LABELLED = re.compile(
    r"(?:[▶▷►★☆※◆■●•·>#*-]+\s*)?[^\n.!?:▶]{0,40}?\s*[:\-–—|→]\s*(?:(?:https?://|www\.)\S+)", re.I
)
_TAG = re.compile(r"#[^\s#]{2,40}|\[(?:특가|sale|hot|광고|ad|best)\]\s*\S+(?:\s[\d,.]+\s?(?:원|won|usd|\$|€)?)?|\S+★\S+|[$€£₩]\s?[\d,.]+", re.I)
_TOKEN = re.compile(r"[^\s·•|/,;▶★☆■◆●]+")
_WORD = re.compile(r"[^\W_]+")
# Words and endings that sentences need.
_FUNCTION = set(
    "the of to and a an in is are be for with on at by may must not from before after this that your you can or than if when until no as have has was were will who which its "
    "le la les des du de un une est sont et à au aux avec pour par pas que qui dans doit el los las del es son y con se debe en al "
    "của là được các cho không phải có trong trước sau với này sẽ và".split()
)
_ENDING = re.compile(r"(?:은|는|이|가|을|를|에|에서|에게|으로|로|와|과|의|도|만|까지|부터|보다|마다|이나|거나|하여|하고|하며|하면|한다|된다|있다|없다|이다|니다|세요|어요|아요|인가요|나요|할|한|하는|되는|있는|없는|때|수|뒤|중)$")
_LAST = set("은는이가을를에서게로와과의도만지터다나고며면할한는을때수뒤중요")
_NUMBERED = re.compile(r"\d")
_CJK_SENTENCE = re.compile(r"[぀-ゟ]{2}|[的了在是须将应不前于]")


def _clean(text: str) -> str:
    return canonical(text) if _SUSPECT.search(text) else text


def _spans(text: str) -> np.ndarray:
    """Characters that belong to links, anchors or tags."""
    mask = np.zeros(len(text), bool)
    patterns = []
    if "](" in text or "<a" in text or "<A" in text:
        patterns.append(_ANCHOR)
    if "://" in text or "www." in text:
        patterns += [_LABELLED, _LINK]
    if any(sign in text for sign in "#★[$€£₩"):
        patterns.append(_TAG)
    for pattern in patterns:
        for m in pattern.finditer(text):
            mask[m.start() : m.end()] = True
    return mask


_CLAUSE = re.compile(r"(?<![^.!?\n])[^.!?\n]++[.!?](?=\s|$)")

_ENTRY = re.compile(r"^[ \t]*(?:[-*|•][ \t]*)?([^\n:|\t–—]{1,40}?)(?:[ \t]*[:|\t–—]|[ \t]-[ \t])[ \t]*\S[^\n]*", re.M)


def _sentence_places(text: str) -> list[tuple[int, int]]:
    """Ended runs of at least five words, capitalised or with a verb's ending, that hardly repeat a word."""
    out = []
    for m in _CLAUSE.finditer(text):
        clause = m[0].lstrip(" \t-*•0123456789")
        if not 12 <= len(clause) <= 400 or not (clause[0].isupper() or clause[-2:-1] in ("다", "요", "까")):
            continue
        words = clause.casefold().split()
        if len(words) >= 5 and len(set(words)) >= 0.8 * len(words):
            out.append(m.span())
    return out


def _entry_places(text: str) -> list[tuple[int, int]]:
    """Lines of a glossary or table: a head, a separator and more, if the heads tell the lines apart."""
    found = list(_ENTRY.finditer(text))
    heads = {m[1].strip().casefold() for m in found}
    return [m.span() for m in found] if len(found) >= 3 and len(heads) >= 0.8 * len(found) else []


def recurrence(keys: list[str]) -> np.ndarray:
    """For each token: whether it comes again within the lag window, or within its term's own even gap, on either side."""
    n = len(keys)
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(k, len(ids)) for k in keys), np.int64, n)
    order = np.argsort(codes, kind="stable")
    term, gap = codes[order[1:]], np.diff(order)
    inside = term == codes[order[:-1]]
    term, gap, left, right = term[inside], gap[inside], order[:-1][inside], order[1:][inside]
    # lags scaled to the term: a cycle of any length gives gaps of about its length
    count = np.bincount(term, minlength=len(ids))
    mean = np.bincount(term, gap, len(ids)) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(term, gap.astype(float) ** 2, len(ids)) / np.maximum(count, 1) - mean**2, 0))
    lags = np.where((count >= CYCLES) & (spread <= EVEN * mean), np.maximum(2 * mean, LAGS), LAGS)
    near = gap <= lags[term]
    again = np.zeros(n, bool)
    again[left[near]] = True
    again[right[near]] = True
    return again


def periodic(keys: list[str]) -> np.ndarray:
    """Tokens of runs that repeat with one lag of the window, ``PERIODS`` times over after the first."""
    n = len(keys)
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(k, len(ids)) for k in keys), np.int64, n)
    out = np.zeros(n, bool)
    for lag in range(1, min(LAGS, n // (PERIODS + 1)) + 1):
        same = codes[lag:] == codes[:-lag]
        least = max(PERIODS * lag, PERIOD_LEAST)
        if int(same.sum()) < least:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for begin, end in zip(edges[::2], edges[1::2], strict=True):
            if end - begin >= least:
                out[begin : end + lag] = True
    return out


def _smooth(flags: np.ndarray) -> np.ndarray:
    width = min(WINDOW, len(flags))
    total = np.convolve(flags.astype(float), np.ones(width), "same")
    size = np.convolve(np.ones(len(flags)), np.ones(width), "same")
    return total / size


def stuffed_share(text: str | None) -> float:
    """Share of the page's visible characters in links, tags and keyword runs."""
    if not text or not text.strip():
        return 0.0
    text = _clean(text)
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32) > 32
    spam = _spans(text) & letters
    at, keys, closed, ending, numbered = [], [], [], [], []
    for m in _TOKEN.finditer(text):
        raw = m[0]
        word = _WORD.findall(raw)
        key = "".join(word).casefold()
        if not key:
            continue
        at.append((m.start(), m.end()))
        keys.append(key)
        bare = raw.rstrip(".!?,;:)]\"'”’。")
        closed.append(key in _FUNCTION or len(raw) > 14 and bool(_CJK_SENTENCE.search(raw)))
        ending.append(bare[-1:] in _LAST and len(bare) > 1 and bool(_ENDING.search(bare)))
        numbered.append(bool(_NUMBERED.search(key)))
    n = len(keys)
    if n >= 8:
        again = recurrence(keys)
        placed = np.zeros(n, bool)
        for begin, end in _sentence_places(text):
            first = bisect_left(at, (begin, 0))
            first -= first > 0 and at[first - 1][1] > begin
            for i in range(first, bisect_left(at, (end, 0))):
                closed[i] = placed[i] = True
        # a noun may look like a word with a particle, but words of sentences come again less often
        function = np.array(closed) | (np.array(ending) & ~again)
        digits = np.array(numbered)
        # particles recur in sentences too; only terms count
        dense = _smooth(again & ~function & ~digits)
        near_function = _smooth(function)
        near_digits = _smooth(digits)
        counts = Counter(keys)
        gaps = _regularity(keys, counts)
        even = np.array([gaps.get(k, 0.0) for k in keys])
        stuffed = (dense >= DENSE) & (near_function < 0.15) & (near_digits < 0.45)
        stuffed |= (dense >= DENSE - 0.12) & (_smooth(even) > 0.2) & (near_function < 0.12) & (near_digits < 0.3)
        stuffed |= (dense >= DENSE - 0.2) & (near_function < 0.05) & (near_digits < 0.2) & ~(np.array(closed))
        told = np.array([bool(_CJK_SENTENCE.search(k)) for k in keys])
        for begin, end in _entry_places(text):
            told[bisect_left(at, (begin, 0)) : bisect_left(at, (end, 0))] = True
        stuffed |= periodic(keys)
        stuffed |= _bare_list(np.array(closed) | np.array(ending) | told, digits)
        for i in np.flatnonzero(stuffed & ~placed):
            spam[at[i][0] : at[i][1]] = True
    spam &= letters
    total = int(letters.sum())
    return float(spam.sum()) / total if total else 0.0


def _bare_list(function: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Tokens of runs of at least ``LIST`` tokens almost without function words, endings and numbers, recurring or not."""
    bare = (_smooth(function) < 0.15) & (_smooth(digits) < 0.15) & ~digits
    edges = np.flatnonzero(np.diff(np.concatenate(([0], bare.view(np.int8), [0]))))
    out = np.zeros(len(bare), bool)
    for begin, end in zip(edges[::2], edges[1::2], strict=True):
        if end - begin >= LIST:
            out[begin:end] = True
    return out


def _regularity(keys: list[str], counts: Counter) -> dict[str, float]:
    """Terms of at least six occurrences whose gaps are more even than chance, and short or a cycle's.

    Occurrences thrown at random have a coefficient of variation of about 1.
    """
    places: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        if counts[k] >= 6:
            places.setdefault(k, []).append(i)
    out = {}
    for k, p in places.items():
        gap = np.diff(p)
        if gap.std() <= (1.1 if gap.mean() <= LAGS else EVEN) * gap.mean():
            out[k] = 1.0
    return out


def mostly_sentences(text: str) -> bool:
    """Whether sentences without links hold at least half of the visible characters.

    No token of a sentence place is ever part of a keyword run, so ``stuffed_share`` is
    at most ``SHARE`` then and need not be measured.
    """
    text = _clean(text)
    safe = sum(len("".join(text[begin:end].split())) for begin, end in _sentence_places(text))
    total = len("".join(text.split()))
    if safe < (1 - SHARE) * total:
        return False
    return safe - int(_spans(text).sum()) >= (1 - SHARE) * total


def stuffed(text: str | None) -> bool:
    """Whether more than half of the page is matter other than sentences."""
    return bool(text) and not mostly_sentences(text) and stuffed_share(text) > SHARE


def stuffed_pages(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key): pages of which more than half is keywords, links or tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([stuffed(t) for t in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=[key])

    rows = df.where(F.col(column).isNotNull()).select(F.col(key), F.col(column).alias("__text"))
    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}").distinct()
