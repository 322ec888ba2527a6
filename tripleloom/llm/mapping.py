"""Mapping of free-entered values to a canonical list.

The reference list is cut into tokens: words, and for compounds the parts its own
labels share (learnt from the list). Each distinct value is read as a choice of
notations (identifier, code, label, translation, keys typed in the wrong layout,
initials). The tokens of all other values, words and the pieces of compounds, are made
distinct over the whole table, and each is joined once to the reference vocabulary by
edit distance. The repaired tokens are joined back to their values, combined with soft
TF-IDF and rank whole entries; a value is mapped to the best of the entries whose
letters are within the letter bound of its own, or is outside the list.

The list is a fixed table; ``REFERENCE_LIMIT`` rows are the proven bound for its
broadcast, a longer list is refused. Values and tokens are worked on once each, whatever
their number of rows.

Defined results: null, empty and letterless values are unmatched; ties go to the
entry of the expected type, then to the higher soft TF-IDF score, then to the
smaller iri; repeated rows give one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.lookalike import canonical
from tripleloom.llm.names import Nearest, edit_distance, jamo
from tripleloom.session import materialise

UNMATCHED = "UNMATCHED"
REFERENCE_LIMIT = 10_000
#: Letters (jamo) that may differ, as a share of the entry's form's, or of the value's and two more if another form of the entry has as many; and at least.
SHARE, LEAST = 0.28, 2

# The two-set layout, keys by letter in the order of the code points.
_LEADS = "r R s e E f a q Q t T d w W c z x v g".split()
_VOWELS = "k o i O j p u P h hk ho hl y n nj np nl b m ml l".split()
_TAILS = " r R rt s sw sg e f fr fa fq ft fx fv fg a q qt t T d w c z x v g".split(" ")
# Decorations of typed values.
_BEFORE = re.compile(r"^(?:우리|한별누리대학교|한별누리대|hbu|the)\s+", re.I)
_AFTER = re.compile(r"(?:\s*\((?:서울|본교|hbu|학부|대학원)\)|\s+쪽|(?<=[가-힣]{3})요|\s+(?:담당|관련))$", re.I)
_EDGE = " \t\r\n\"'“”‘’`<>.,;:!?/·"
_LOCAL = re.compile(r"^(?:.*[:#/])?([a-z]+)[-_ ]*0*(\d+)$", re.I)
_IRI_LIKE = re.compile(r"^(?:urn:|https?:|[a-z]{2,6}:)\S*$", re.I)


def to_hangul(keys: str) -> str | None:
    """The syllables that the keys type in the two-set layout; None if other signs are in it."""
    lead, vowel, tail = ({k: i for i, k in enumerate(t) if k} for t in (_LEADS, _VOWELS, _TAILS))
    fold = lambda c: c if c in "QWERTOP" else c.lower()
    letters = [fold(c) for c in keys if not c.isspace()]
    out: list[str] = []
    i, n = 0, len(letters)
    while i < n:
        if letters[i] not in lead or i + 1 >= n:
            return None
        l, i = lead[letters[i]], i + 1
        if i + 1 < n and letters[i] + letters[i + 1] in vowel:
            v, i = vowel[letters[i] + letters[i + 1]], i + 2
        elif letters[i] in vowel:
            v, i = vowel[letters[i]], i + 1
        else:
            return None
        t = 0
        for size in (2, 1):
            part = "".join(letters[i : i + size])
            after = letters[i + size] if i + size < n else ""
            if len(part) == size and part in tail and not (after and after in vowel):
                t, i = tail[part], i + size
                break
        out.append(chr(0xAC00 + l * 588 + v * 28 + t))
    return "".join(out)


def _shared(labels: list[str], start: bool) -> set[str]:
    """Beginnings (or ends) of labels that enough different signs follow (or precede)."""
    beside: dict[str, set[str]] = defaultdict(set)
    for label in labels:
        for size in range(2, len(label)):
            part, sign = (label[:size], label[size]) if start else (label[-size:], label[-size - 1])
            beside[part].add(sign)
    return {p for p, signs in beside.items() if len(signs) >= (3 if start else 5)}


class ReferenceIndex:
    """Vocabulary, notations and soft TF-IDF weights of a reference list."""

    def __init__(self, rows: list[tuple[str, str | None, str | None, str | None, str | None]]):
        rows = [r for r in rows if r[0]]
        self.iris = [r[0] for r in rows]
        self.types = [r[4] for r in rows]
        self.by_local: dict[tuple[str, int], int] = {}
        self.exact: dict[str, list[int]] = defaultdict(list)
        self.codes: dict[str, int] = {}
        self.forms: list[tuple[str, int]] = []
        self.initials: dict[str, list[int]] = defaultdict(list)
        single = [self.letters(r[1]) for r in rows if r[1] and " " not in r[1].strip()]
        starts, ends = _shared(single, True), _shared(single, False)
        self.entry_tokens: list[list[tuple[str, ...]]] = []
        for i, (iri, label, other, code, _) in enumerate(rows):
            local = _LOCAL.match(iri)
            if local:
                self.by_local[(local[1].lower(), int(local[2]))] = i
            if code:
                self.codes[self.letters(code)] = i
            tokens = []
            for text in (label, other):
                key = self.letters(text)
                if not key:
                    continue
                self.exact[key].append(i)
                self.forms.append((jamo(key), i))
                parts = self._cut(text, starts, ends)
                tokens.append(tuple(parts))
                if text == label and len(parts) == 3 and " " not in text.strip():
                    for last in {parts[2][0], parts[2][-1]}:
                        self.initials[parts[0][0] + parts[1][0] + last].append(i)
            self.entry_tokens.append(tokens)
        frequency = Counter(t for forms in self.entry_tokens for parts in forms for t in set(parts))
        total = sum(map(len, self.entry_tokens)) or 1
        self.idf = {t: math.log(1 + total / n) for t, n in frequency.items()}
        self.vocabulary = sorted(self.idf)
        self.token_letters = {t: jamo(t) for t in self.vocabulary}
        self.longest = max(map(len, self.vocabulary), default=1)
        self.by_sign: dict[tuple[str, int], list[str]] = defaultdict(list)
        for t in self.vocabulary:
            for at, sign in enumerate(t):
                self.by_sign[(sign, at)].append(t)
        self.with_token: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, forms in enumerate(self.entry_tokens):
            for parts in forms:
                norm = math.sqrt(sum(self.idf[t] ** 2 for t in parts)) or 1.0
                for t in set(parts):
                    self.with_token[t].append((i, self.idf[t] / norm))
        self.of_entry: dict[int, list[str]] = defaultdict(list)
        for form, i in self.forms:
            self.of_entry[i].append(form)
        self.repair = lru_cache(maxsize=100_000)(self._repair)

    @staticmethod
    def letters(text: str | None) -> str:
        return "".join(c for c in canonical(text or "", True) if c.isalnum())

    @staticmethod
    def _cut(text: str, starts: set[str], ends: set[str]) -> list[str]:
        words = re.findall(r"[^\W_]+", canonical(text, True))
        if len(words) != 1 or not re.search("[가-힣]", text):
            return words
        word = words[0]
        first = max((s for s in starts if word.startswith(s) and len(word) >= len(s) + 2), key=len, default="")
        last = max((s for s in ends if word.endswith(s) and len(word) >= len(first) + len(s) + 1), key=len, default="")
        middle = word[len(first) : len(word) - len(last)]
        return [p for p in (first, middle, last) if p]

    # ---- tokens -----------------------------------------------------------
    def _repair(self, token: str) -> tuple[tuple[str, float], ...]:
        """Vocabulary tokens within edit distance of ``token``, with their similarity."""
        if token in self.idf:
            return ((token, 1.0),)
        letters = jamo(token)
        most = 1 if len(letters) < 5 else max(2, min(3, len(letters) // 3))
        # a mistyped token keeps one of its signs about where it was
        if len(token) > 1 and not any((sign, at + shift) in self.by_sign for at, sign in enumerate(token) for shift in (-1, 0, 1)):
            return ()
        near = self.near_tokens.within(letters, most)
        return tuple(sorted(((self.vocabulary[i], 1 - d / max(len(letters), len(self.near_tokens.forms[i]))) for d, i in near), key=lambda x: (-x[1], x[0])))

    @cached_property
    def near_tokens(self) -> Nearest:
        return Nearest([self.token_letters[t] for t in self.vocabulary])

    @cached_property
    def near_forms(self) -> Nearest:
        return Nearest([form for form, _ in self.forms])

    @cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each form, and of its entry's longest form."""
        longest = [max(map(len, self.of_entry[i])) for _, i in self.forms]
        return np.array([len(form) for form, _ in self.forms], int), np.array(longest, int)

    def bounds(self, size: int) -> np.ndarray:
        """Letters in which a value of ``size`` letters may differ from each form."""
        own, longest = self.sizes
        return np.maximum(LEAST, (SHARE * np.maximum(own, np.minimum(longest, size + 2))).astype(int))

    @cached_property
    def longest_form(self) -> int:
        """Letters of the longest value that can be within the letter bound of an entry."""
        longest = max((len(form) for form, _ in self.forms), default=0)
        return longest + max(LEAST, int(SHARE * longest))

    def pieces(self, text: str) -> list[str]:
        """Everything that ``tokens`` may ask about ``text``, for the join with the vocabulary."""
        words = re.findall(r"[^\W_]+", text)
        if not re.search("[가-힣]", text):
            return sorted(set(words))
        word = "".join(words)
        return sorted({word[i:j] for i in range(len(word)) for j in range(i + 1, min(len(word), i + self.longest + 1) + 1)})

    def tokens(self, text: str, repair) -> list[str]:
        """Words of the value; a compound is cut where its parts repair best."""
        words = re.findall(r"[^\W_]+", text)
        if not re.search("[가-힣]", text):
            return words
        word = "".join(words)
        n = len(word)
        best: list[tuple[float, list[str]]] = [(0.0, [])]
        for end in range(1, n + 1):
            options = []
            for begin in range(max(0, end - self.longest - 1), end):
                piece = word[begin:end]
                fixed = repair(piece) if end - begin > 1 else ()
                gain = (fixed[0][1] ** 3) * (end - begin) - 0.2 if fixed else -0.1 * (end - begin)
                options.append((best[begin][0] + gain, begin, piece))
            score, begin, piece = max(options, key=lambda o: (o[0], len(o[2])))
            best.append((score, [*best[begin][1], piece]))
        return best[n][1]

    def rank(self, text: str, repair=None) -> list[tuple[float, int]]:
        """Entries by soft TF-IDF of the repaired tokens; ``repair`` gives a token's repairs."""
        repair = repair or self.repair
        scores: dict[int, float] = defaultdict(float)
        weights, total = [], 0.0
        for token in self.tokens(text, repair):
            fixed = repair(token)
            if not fixed:
                total += 4.0
                continue
            weights.append(fixed)
            total += self.idf[fixed[0][0]] ** 2
        for fixed in weights:
            best: dict[int, float] = {}
            for t, similarity in fixed:
                for i, weight in self.with_token[t]:
                    best[i] = max(best.get(i, 0.0), similarity * self.idf[t] * weight)
            for i, s in best.items():
                scores[i] += s
        norm = math.sqrt(total) or 1.0
        return sorted(((s / norm, i) for i, s in scores.items()), key=lambda x: (-x[0], self.iris[x[1]]))

    # ---- whole values -------------------------------------------------------
    def identifier(self, value: str) -> int | None | str:
        """Entry of an identifier; UNMATCHED for one of no entry, None if it is none."""
        text = unquote(canonical(value)).strip(_EDGE)
        local = _LOCAL.match(text)
        if local and (":" in text or "/" in text or "#" in text or re.match(r"^[a-z]+[-_]", text, re.I)):
            at = self.by_local.get((local[1].lower(), int(local[2])))
            if at is not None:
                return at
            if self.letters(text) not in self.codes:
                return UNMATCHED
        return UNMATCHED if _IRI_LIKE.match(text) else None

    def _swapped(self, key: str) -> list[int]:
        """Entries whose label is the value with two neighbouring characters swapped."""
        for i in range(len(key) - 1):
            hit = self.exact.get(key[:i] + key[i + 1] + key[i] + key[i + 2 :])
            if hit:
                return hit
        return []

    def match(self, value: str | None, kind: str | None = None) -> str:
        """The iri meant by ``value``, or UNMATCHED."""
        iri, text = self.read(value, kind)
        return iri if iri is not None else self.nearest(text, kind)

    def read(self, value: str | None, kind: str | None = None) -> tuple[str | None, str | None]:
        """(iri or UNMATCHED, None) if a notation decides, else (None, the text whose tokens are to be repaired)."""
        found = self._read(value, kind)
        return (None, found[1:]) if found.startswith("\0") else (found, None)

    def nearest(self, text: str, kind: str | None = None, repair=None) -> str:
        near = self._near(text, self.letters(text), kind, repair=repair)
        return UNMATCHED if near is None else self.iris[near]

    def _read(self, value: str | None, kind: str | None) -> str:
        if not value:
            return UNMATCHED
        found = self.identifier(value)
        if found is not None:
            return found if isinstance(found, str) else self.iris[found]
        text = canonical(value).strip(_EDGE)
        for _ in range(3):
            text = _AFTER.sub("", _BEFORE.sub("", text).strip(_EDGE)).strip(_EDGE)
        key = self.letters(text)
        if not key:
            return UNMATCHED
        code = re.match(r"^([a-z]{2,3}\d+)", key)
        if code:
            digits = code[1]
            if digits in self.codes:
                return self.iris[self.codes[digits]]
            if key == digits:
                return UNMATCHED
            key = key[len(digits) :]
            text = re.sub(r"^[A-Za-z]+[-_ ]*[A-Za-z]*\d+\s*", "", text)
        tail = re.search(r"([a-z]{2,3}\d{2,})$", key)
        if tail and tail[1] in self.codes:
            return self.iris[self.codes[tail[1]]]
        hits, typed = self.exact.get(key), None
        if not hits and re.fullmatch(r"[A-Za-z\s]+", text):
            typed = to_hangul(text)
            if typed:
                hits = self.exact.get(typed)
                if not hits:
                    close = self._near(typed, typed, kind, strict=True)
                    if close is not None:
                        return self.iris[close]
        if hits:
            return self.iris[self._of_type(hits, kind)]
        initials = self.initials.get(key)
        if initials:
            chosen = sorted(set(initials))
            return self.iris[self._of_type(chosen, kind)]
        swapped = self._swapped(key)
        if swapped:
            return self.iris[self._of_type(swapped, kind)]
        text = text.casefold()
        # keys with more slips, unless the letters as they stand are near an entry
        close = self._near(typed, typed, kind) if typed else None
        if close is not None and self._near(text, key, kind) is None:
            return self.iris[close]
        # a value too long for any entry needs no repair
        return UNMATCHED if not 3 <= len(jamo(key)) <= self.longest_form else f"\0{text}"

    def _of_type(self, entries: list[int], kind: str | None) -> int:
        return min(entries, key=lambda i: (kind is not None and self.types[i] != kind, self.iris[i]))

    def _near(self, text: str, key: str, kind: str | None, strict: bool = False, repair=None) -> int | None:
        """The best entry within the letter bound; all entries are compared."""
        letters = jamo(key)
        if len(letters) < 3:
            return None
        most = self.bounds(len(letters))
        best: dict[int, int] = {}
        for d, at in self.near_forms.within(letters, np.minimum(most, 2) if strict else most):
            best.setdefault(self.forms[at][1], d)
        if not best:
            return None
        scores = {i: score for score, i in self.rank(text, repair)}
        return min(((d, kind is not None and self.types[i] != kind, -scores.get(i, 0.0), self.iris[i], i) for i, d in best.items()))[-1]


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(record_table, record_id, iri) of rows (record_table, record_id, value, kind)."""
    spark = values.sparkSession
    rows = [tuple(r) for r in reference.select("iri", "label", "alt_label", "code", "term_type").limit(REFERENCE_LIMIT + 1).collect()]
    if len(rows) > REFERENCE_LIMIT:
        raise ValueError(f"the reference list has more than {REFERENCE_LIMIT} entries")
    shared = spark.sparkContext.broadcast(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ReferenceIndex(shared.value)
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            done = [index.read(v, k) for v, k in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i for i, _ in done], pa.string()), pa.array([t for _, t in done], pa.string())], names=["value", "kind", "iri", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ReferenceIndex(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index.pieces(t) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["text", "tokens"])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ReferenceIndex(shared.value)
        for batch in batches:
            tokens, repairs = [], []
            for token in batch.column(0).to_pylist():
                fixed = index._repair(token)
                if fixed:
                    tokens.append(token)
                    repairs.append([{"t": t, "s": s} for t, s in fixed])
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(repairs, pa.list_(pa.struct([("t", pa.string()), ("s", pa.float64())])))], names=["token", "repairs"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ReferenceIndex(shared.value)
        for batch in batches:
            iris = []
            for text, kind, own in zip(*(batch.column(i).to_pylist() for i in (2, 1, 3)), strict=True):
                known = {o["token"]: tuple((r["t"], r["s"]) for r in o["repairs"]) for o in own or []}
                iris.append(index.nearest(text, kind, lambda token, known=known: known.get(token, ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(iris, pa.string())], names=["value", "kind", "iri"])

    # few bytes but much work: spread over the cores, whatever the size of the shuffle
    parts = 2 * spark.sparkContext.defaultParallelism
    first = materialise(values.select("value", "kind").distinct().repartition(parts).mapInArrow(read, "value string, kind string, iri string, text string"), "mapped-values")
    texts = first.where("text is not null").select("text").distinct()
    asked = materialise(texts.mapInArrow(cut, "text string, tokens array<string>").select("text", F.explode("tokens").alias("token")), "mapped-tokens")
    mended = asked.select("token").distinct().repartition(parts).mapInArrow(mend, "token string, repairs array<struct<t:string,s:double>>")
    own = asked.join(mended, "token").groupBy("text").agg(F.collect_list(F.struct("token", "repairs")).alias("own"))
    unsure = first.where("text is not null").join(own, "text", "left").select("value", "kind", "text", "own")
    chosen = unsure.mapInArrow(choose, "value string, kind string, iri string")
    mapped = first.where("text is null").select("value", "kind", "iri").unionByName(chosen)
    v, m = values.alias("v"), mapped.alias("m")
    joined = v.join(m, F.col("v.value").eqNullSafe(F.col("m.value")) & F.col("v.kind").eqNullSafe(F.col("m.kind")), "left")
    return joined.select("v.record_table", "v.record_id", F.coalesce("m.iri", F.lit(UNMATCHED)).alias("iri")).distinct()


#: Types of entities that are in the list's scope.
SCOPE = ("hbu:Department", "hbu:Course", "hbu:AdministrativeAction", "hbu:Place")


def free_values(mentions: DataFrame, choices: DataFrame, entities: DataFrame) -> DataFrame:
    """(record_table, record_id, value, kind) of the three tables' free values."""
    asked = mentions.select(F.lit("query_terms").alias("record_table"), F.col("mention_id").alias("record_id"), F.col("mention").alias("value"), F.col("expected_type").alias("kind"))
    chosen = choices.where("selected_iri is not null").select(
        F.lit("term_choices").alias("record_table"), F.col("mention_id").alias("record_id"), F.col("selected_iri").alias("value"), F.lit(None).cast("string").alias("kind")
    )
    scope = F.array(*[F.lit(s) for s in SCOPE])
    kinds = F.filter("types", lambda t: F.array_contains(scope, t))
    labelled = entities.where(F.size(kinds) > 0).select(
        F.lit("candidate_entities").alias("record_table"), F.col("name_id").alias("record_id"), F.col("label").alias("value"), F.get(kinds, 0).alias("kind")
    )
    return asked.unionByName(chosen).unionByName(labelled)
