"""Variant spellings of names typed by people.

Labels are parsed into the parts of a name: the name, field and kind of a body; given
name, middle initial and surname of a person. The parts that many labels share (kinds,
fields, given names, usual lengths of a body's name) are learnt from counts over all
labels. Parts may be missing, abbreviated, reordered or decorated.

A node is a full name as parsed, not a part of it: a body's name and field, or a person's
given name, middle initial and surname. Nodes are linked by a radius join in a metric
space: pivots are drawn from the names, every name is assigned to the cell of its nearest
pivot and, by the triangle inequality, visits every cell whose pivot is not farther than the
nearest one's distance plus twice the radius. A name carries its cells as bits and is not
copied into them. Names within one edit, and those whose neighbouring characters changed
places, meet in a common deletion variant; of those that meet, names that visit each
other's cells are compared by edit distance (of syllables or letters), the others only
with the swapped name. Its joins are shuffled whatever their size, so that no table is
held by the driver.

A name with a part missing (an initial, a bare surname, a nickname, no field) is linked
only if all complete names it may stand for are one entity; an ambiguous one stays alone.
Connected nodes are one entity.

Defined results: null and empty labels, and labels without a letter, link to nothing;
equal labels link; repeated rows give one pair. Two given names that are both common
are different names, however alike they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.components import components
from tripleloom.llm.lookalike import canonical
from tripleloom.session import materialise, shuffled

#: Edits within which two names are one, beside an exchange of neighbours; jamo in which Hangul names may differ then.
RADIUS, JAMO_RADIUS = 1, 3
#: Pivots of a kind of names, and names for which one is drawn. More names make larger cells, whose joins are equi-joins.
PIVOTS, PER_PIVOT = 32, 16_384
#: Least share of all labels for a part, and the share beyond which a longer suffix explains a shorter one.
PART_SHARE, EXPLAINED = 0.004, 0.55
#: Longest suffix that is counted as a part; with the share it bounds the number of learnt parts (a label has so many suffixes).
LONGEST_PART = 7
#: Least share of the labels for a given name, of a body's names for a usual length, and of a name's labels for a field of its own.
GIVEN_SHARE, LENGTH_SHARE, FIELD_SHARE = 0.003, 0.05, 0.25
#: A given name of at most so many letters may be a nickname.
NICKNAME = 6

# Decorations that belong to no name.
_TITLE = re.compile(r"\b(?:dr|prof|professor|mr|mrs|ms|sir)\b\.?|교수님?|박사님?|선생님?|님$", re.I)
_NOISE = re.compile(r"^\s*\([^()]{1,12}\)|(?<=\S)\s*(?:담당|소속|귀중)\s*$", re.I)
#: An abbreviation in brackets at the end, and a school before the name.
_TRAILING = re.compile(r"\([A-Za-z]{1,8}\)\s*$|^\s*\S+대학교\s+(?=\S)")
_ASIDE = "네쪽"
_QUOTES = re.compile(r"[\"'“”‘’`]")
_CONNECTING = {"of", "the", "for", "and", "at", "de", "du", "der", "des", "et", "und"}
_HANGUL = re.compile("[가-힣]")


@lru_cache(maxsize=200_000)
def jamo(text: str) -> str:
    """Syllables as initial, medial and final letters."""
    out = []
    for c in text:
        o = ord(c) - 0xAC00
        if 0 <= o < 11172:
            out.append(chr(0x1100 + o // 588) + chr(0x1161 + o % 588 // 28) + (chr(0x11A7 + o % 28) if o % 28 else ""))
        else:
            out.append(c)
    return "".join(out)


def edit_distance(a: str, b: str, most: int = 99) -> int:
    """Levenshtein distance; beyond ``most`` any larger number."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        best = i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            best = min(best, row[j])
        if best > most:
            return most + 1
    return row[-1]


def _plain(label: str | None) -> str:
    """A body's label without decorations."""
    text = _QUOTES.sub("", canonical(label or "")).strip()
    for _ in range(2):
        text = _TRAILING.sub("", _NOISE.sub("", text)).strip()
    return text


class Nearest:
    """Forms within an edit distance; letters that can't be matched bound the distance from below."""

    def __init__(self, forms: list[str]):
        self.forms = forms
        self.column = {c: i for i, c in enumerate(sorted({c for f in forms for c in f}))}
        self.bags = np.zeros((len(forms), len(self.column) + 1), np.int16)
        for i, form in enumerate(forms):
            for c in form:
                self.bags[i, self.column[c]] += 1

    def within(self, text: str, most: int | np.ndarray) -> list[tuple[int, int]]:
        """(distance, index), nearest first; ``most`` is one for all forms or one for each."""
        most = np.broadcast_to(most, len(self.forms))
        bag = np.zeros(len(self.column) + 1, np.int16)
        for c in text:
            bag[self.column.get(c, -1)] += 1
        more = self.bags - bag
        lower = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
        near = ((edit_distance(text, self.forms[i], int(most[i])), int(i)) for i in np.flatnonzero(lower <= most))
        return sorted(x for x in near if x[0] <= most[x[1]])


# ---- parts learnt from counts over all labels --------------------------------


def _suffix_counts(labels: DataFrame, strip: tuple[str, ...] = ()) -> DataFrame:
    """(suffix, n) of the letters of each organisation label, after a stripped kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        kinds = sorted(strip, key=len, reverse=True)
        for batch in batches:
            for label in batch.column(0).to_pylist():
                letters = "".join(_HANGUL.findall(_plain(label)))
                if strip:
                    kind = next((k for k in kinds if letters.endswith(k) and len(letters) >= len(k) + 6), None)
                    if kind is None:
                        continue
                    letters = letters[: -len(kind)]
                for size in range(1, LONGEST_PART + 1):
                    if size <= len(letters):
                        counts[letters[-size:]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["suffix", "n"])

    return labels.mapInArrow(run, "suffix string, n long").groupBy("suffix").agg(F.sum("n").alias("n"))


def _own_suffixes(counts: dict[str, int], least: float, shortest: int) -> list[str]:
    """Suffixes that no longer one explains."""
    extended: dict[str, int] = {}
    for s, n in counts.items():
        if len(s) > 1:
            extended[s[1:]] = max(extended.get(s[1:], 0), n)
    own = [(n, s) for s, n in counts.items() if len(s) >= shortest and n >= least and extended.get(s, 0) <= EXPLAINED * n]
    return [s for _, s in sorted(own, reverse=True)]


def learn_parts(labels: DataFrame) -> tuple[list[str], list[str], list[int]]:
    """(kinds, fields, usual lengths of the name) of organisations.

    Only suffixes above the share leave the executors: at most ``LONGEST_PART / (PART_SHARE / 2)``.
    """
    labels = labels.select("label").where("label is not null")
    total = max(1, labels.count())

    def frequent(counts: DataFrame) -> dict[str, int]:
        least = max(3, PART_SHARE * total * 0.5)
        return {r[0]: r[1] for r in counts.where(F.col("n") >= least).collect()}

    ends = frequent(_suffix_counts(labels))
    kinds = _own_suffixes(ends, max(3, 2 * PART_SHARE * total), 2)
    before = frequent(_suffix_counts(labels, tuple(kinds))) if kinds else {}
    fields = _own_suffixes(before, max(3, PART_SHARE * total * 0.75), 3)
    # a part found in both places is what it is more often
    fields = [f for f in fields if f not in kinds or before[f] >= ends[f]]
    kinds = [k for k in kinds if k not in fields and not any(k != f and k.startswith(f) for f in fields)]
    return kinds, fields, _name_lengths(labels, kinds, fields)


def _name_lengths(labels: DataFrame, kinds: list[str], fields: list[str]) -> list[int]:
    """Lengths that names before a known field and kind often have."""
    if not kinds or not fields:
        return []
    form = f"^([가-힣]{{2,12}}?)(?:{'|'.join(sorted(fields, key=len, reverse=True))})(?:{'|'.join(sorted(kinds, key=len, reverse=True))})$"
    counts = labels.select(F.length(F.regexp_extract("label", form, 1)).alias("size")).where("size > 0").groupBy("size").count().collect()
    total = sum(r["count"] for r in counts)
    return sorted(r["size"] for r in counts if r["count"] >= LENGTH_SHARE * total)


# The forms in which the place of the given name is certain.
_GIVEN_FORMS = (
    r"^([A-Za-z][\w-]+) [A-Za-z]\.? [A-Za-z][\w-]+$",
    r"^[A-Za-z][\w-]+, ([A-Za-z][\w-]{2,})(?: [A-Za-z]\.)?$",
    r"^([A-Za-z][\w-]+) \"\w+\" [A-Za-z][\w-]+$",
    r"^([A-Za-z][\w-]+) [A-Za-z][\w-]+ 교수$",
    r"^(?:Dr|Prof)\. ([A-Za-z][\w-]{2,}) [A-Za-z][\w-]+$",
)


def learn_given(labels: DataFrame) -> list[str]:
    """Given names: what stands in a given name's place often enough, over all labels; at most ``1 / GIVEN_SHARE``."""
    found = F.lower(F.coalesce(*[F.nullif(F.regexp_extract("label", form, 1), F.lit("")) for form in _GIVEN_FORMS]))
    counts = labels.select(found.alias("given")).where("given is not null").groupBy("given").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return [r[0] for r in counts.where(F.col("count") >= max(2, GIVEN_SHARE * total)).orderBy(F.desc("count"), "given").collect()]


# ---- parsing -------------------------------------------------------------------


class OrganisationParser:
    """Label -> (core, field, kind); core is empty if there is no name."""

    def __init__(self, kinds: list[str], fields: list[str], lengths: list[int]):
        self.kinds, self.fields = kinds, fields
        self.lengths = lengths or [4]
        sizes = {n + d for n in self.lengths for d in (-1, 0, 1, 2) if n + d >= 2}
        #: Lengths to try, with what an unusual one costs.
        self.sizes = sorted((min(2.5 * abs(n - m) for m in self.lengths), n) for n in sizes)
        self.sizes.sort(key=lambda x: (x[0], -x[1]))
        self.long_kinds = sorted((k for k in kinds if len(k) > 1), key=len, reverse=True)
        self.by_rest: dict[str, tuple[str | None, str | None]] = {}
        shorts = {f: {f} | self._short(f) for f in fields}
        kind_shorts = {k: {k} | ({k[:2], k[-1], k[-2:], k[0] + k[-1]} if len(k) > 2 else set()) | ({k[0]} if len(k) > 1 else set()) for k in kinds}
        for k in kinds:
            for ks in kind_shorts[k]:
                self.by_rest.setdefault(ks, (None, k))
        for f in fields:
            for fs in shorts[f]:
                self.by_rest.setdefault(fs, (f, None))
                for k in kinds:
                    for ks in kind_shorts[k]:
                        self.by_rest.setdefault(fs + ks, (f, k))
        for f in fields:  # whole forms win over abbreviations that look the same
            self.by_rest[f] = (f, None)
            for k in kinds:
                self.by_rest[f + k] = (f, k)
        self.whole = [(jamo(f + k), f, k) for f in fields for k in self.long_kinds] + [(jamo(f), f, None) for f in fields] + [(jamo(k), None, k) for k in self.long_kinds]
        self._known: dict[str, tuple[int, str | None, str | None]] = {}
        self.characters = {c for form, _, _ in self.whole_texts() for c in form}
        self._near = Nearest([w[0] for w in self.whole])

    def whole_texts(self) -> Iterator[tuple[str, str | None, str | None]]:
        for f in self.fields:
            yield f, f, None
        for k in self.long_kinds:
            yield k, None, k

    def _nearest(self, letters: str, most: int) -> tuple[int, str | None, str | None]:
        """The whole form nearest to ``letters``, if within ``most``."""
        near = self._near.within(letters, most)
        return (near[0][0], *self.whole[near[0][1]][1:]) if near else (99, None, None)

    @staticmethod
    def _short(field: str) -> set[str]:
        out = {field[:2]}
        if len(field) >= 4:
            out |= {field[0] + field[2], field[0] + field[-2], field[0] + field[-1], field[:1] + field[3:4]}
        return {s for s in out if len(s) >= 2}

    def rest(self, text: str) -> tuple[int, str | None, str | None]:
        """(cost, field, kind) of what follows a name."""
        if not text:
            return 1, None, None
        known = self._known.get(text)
        if known is None:
            hit = self.by_rest.get(text)
            if hit:
                known = (0, *hit)
            else:
                best: tuple[int, str | None, str | None] = (99, None, None)
                # a mistyped part keeps all but two of its syllables
                likely = 2 <= len(text) <= 14 and sum(c in self.characters for c in text) >= len(text) - 2
                if likely:
                    best = self._nearest(jamo(text), 4 if len(text) >= 5 else 2 if len(text) >= 3 else 1)
                if likely and best[0] == 99 and len(text) >= 4:  # swapped neighbours
                    for i in range(len(text) - 1):
                        hit = self.by_rest.get(text[:i] + text[i + 1] + text[i] + text[i + 2 :])
                        if hit:
                            best = (2, *hit)
                            break
                if likely and best[0] == 99 and len(text) >= 5:  # a typed field before a short kind, or the reverse
                    for i in range(2, len(text)):
                        left, right = self.by_rest.get(text[:i]), self.by_rest.get(text[i:])
                        if left and left[0] and left[1] is None and i < len(text):
                            best = (3, left[0], None)
                        elif right and right[1] and i >= 3:
                            best = min(best, (4, None, right[1]), key=lambda b: b[0])
                known = best
            if len(self._known) < 300_000:
                self._known[text] = known
        return known

    def parse(self, label: str | None) -> tuple[str, str | None, str | None]:
        text = re.sub(r"[(),·/\[\]]", " ", _plain(label))
        if 2 * len(_HANGUL.findall(text)) < sum(c.isalpha() for c in text):
            # other scripts: the words in one order, connecting words aside
            words = [w for w in re.findall(r"[^\W_]+", text.casefold()) if w not in _CONNECTING]
            return " ".join(sorted(words)), None, None
        tokens = ["".join(_HANGUL.findall(t)) for t in text.split()]
        tokens = [t for t in tokens if t]
        if not tokens:
            return "", None, None
        if not self.whole:
            return "".join(tokens), None, None
        # which token begins with the name: the one that is worst explained as field and kind
        parts: list[tuple[int, str | None, str | None]] = [self.rest(t) for t in tokens]
        best: tuple[float, str, str | None, str | None] | None = None
        for i, token in enumerate(tokens):
            others = [p for j, p in enumerate(parts) if j != i]
            other_cost = sum(min(p[0], 12) for p in others)
            if parts[i][0] == 0 and len(tokens) > 1 and len(token) > 1:
                other_cost += 8
            joined = "".join(tokens[i + 1 :])
            for unusual, size in self.sizes:
                if best is not None and best[0] <= unusual - 2.5:
                    break
                if size > len(token):
                    continue
                after = token[size:]
                cost, f, k = self.rest(after) if after else (0, None, None)
                if after and others and len(tokens) > i + 1 and cost > 1:
                    # a space typed inside the field
                    c2, f2, k2 = self.rest(after + joined)
                    if c2 < cost and i == 0:
                        cost, f, k, extra = c2, f2, k2, sum(min(p[0], 12) for p in parts[:i])
                        total = cost + extra + unusual
                        if best is None or total < best[0]:
                            best = (total, token[:size], f, k)
                        continue
                total = min(cost, 12) + other_cost + unusual
                if token[size - 1 : size] in set(_ASIDE) and size - 1 in self.lengths:
                    total -= 2.5
                for _, fo, ko in others:
                    f, k = f or fo, k or ko
                if best is None or total < best[0]:
                    best = (total, token[:size], f, k)
        if best is None:
            return ("".join(tokens), None, None) if len("".join(tokens)) >= 3 else ("", None, None)
        core = best[1]
        if core[-1] in _ASIDE and len(core) - 1 in self.lengths:
            core = core[:-1]
        # a space inside the name
        if len(tokens) > 1 and len(tokens[0]) < min(self.lengths) - 1 and best[0] > 6:
            glued = self.parse("".join(tokens))
            if glued[0]:
                return glued
        return core, best[2], best[3]


class PersonParser:
    """Label -> (surname, given name or None, whether it is a common one, initial, middle initial, quoted nickname)."""

    def __init__(self, given: list[str]):
        self.given = given
        self._set = set(given)
        self._nearest = Nearest(given)
        self._near: dict[str, str | None] = {}

    def _as_given(self, token: str) -> str | None:
        if token in self._set:
            return token
        if token not in self._near:
            near = self._nearest.within(token, 2) if len(token) >= 5 else []
            near.sort(key=lambda x: (self.given[x[1]][0] != token[0], x))
            if len(self._near) < 300_000:
                self._near[token] = self.given[near[0][1]] if near else None
            return self.given[near[0][1]] if near else None
        return self._near[token]

    def parse(self, label: str | None) -> tuple:
        text = canonical(label or "")
        quoted = re.search(r"[\"“”‘’]([^\W\d_]{2,})[\"“”‘’]", text)
        nick = quoted[1].casefold() if quoted else None
        text = re.sub(r"[\"'“”‘’(][^\"'“”‘’()]*[\"'“”‘’)]", " ", text)
        text = _TITLE.sub(" ", text).strip(" .,")
        # a name typed without its space
        text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z]{2,})", " ", text)
        text = text.casefold()
        head, comma, tail = text.partition(",")
        words = lambda s: re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", s)
        left, right = words(head), words(tail)
        tokens = left + right
        long = [t for t in tokens if len(t) > 2]
        initials = [t for t in tokens if len(t) <= 2]
        if not long:
            return "", None, False, None, None, None
        middle = initials[-1][0] if initials and (len(long) > 1 or len(initials) > 1) else None
        if len(long) == 1:
            whole = long[0]
            for g in self.given:
                if not initials and len(g) >= 6 and whole.startswith(g) and len(whole) >= len(g) + 4:
                    return whole[len(g) :].strip("-"), g, True, g[0], None, nick
            return whole, None, False, initials[0][0] if initials else None, middle, nick
        known = [self._as_given(t) for t in long]
        if comma and left and len(left[-1]) > 2:
            surname = left[-1]
            rest = [(t, k) for t, k in zip(long, known, strict=True) if t != surname]
            first = next(((t, k) for t, k in rest if k), rest[0] if rest else (None, None))
        elif known[-1] and not known[0]:
            surname, first = long[0], (long[-1], known[-1])
        else:
            surname, first = long[-1], (long[0], known[0])
        given = first[1] or first[0]
        return surname, given, bool(first[1]), given[0] if given else None, middle, nick


# ---- linking -------------------------------------------------------------------

NODE = "name_id long, kind string, core string, letters string, part string, extra string, given string, known boolean, initial string, middle string, nick string"


def parse_names(labels: DataFrame, kinds: list[str], fields: list[str], lengths: list[int], given: list[str]) -> DataFrame:
    """Parsed rows of rows (name_id, kind, label); core is a body's name or a person's surname."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        organisations, persons = OrganisationParser(kinds, fields, lengths), PersonParser(given)
        for batch in batches:
            out = []
            for key, kind, label in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == "person":
                    core, *rest = persons.parse(label)
                    about = (None, None, *rest)
                else:
                    core, part, extra = organisations.parse(label)
                    about = (part, extra, None, False, None, None, None)
                if core:
                    out.append((key, kind, core, jamo(core), *about))
            columns = list(zip(*out, strict=True)) if out else [[]] * 11
            types = [pa.int64(), *[pa.string()] * 6, pa.bool_(), *[pa.string()] * 3]
            names = [f.split()[0] for f in NODE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return labels.select("name_id", "kind", "label").mapInArrow(run, NODE)


def near_names(nodes: DataFrame) -> DataFrame:
    """(a, b, x, y): pairs of nodes (id, name, about) whose names are within the radius or have two neighbours exchanged.

    ``x`` and ``y`` are the nodes' ``about``. Names under three characters must be equal.
    """
    nodes = materialise(nodes, "near-names")
    wanted = min(PIVOTS, max(1, nodes.count() // PER_PIVOT))
    # pivots are drawn by the hash of their name: at most PIVOTS strings leave the executors
    pivots = [r[0] for r in nodes.select("name").distinct().orderBy(F.xxhash64("name"), "name").limit(wanted).collect()] or [""]
    table = F.array(*[F.lit(p) for p in pivots])
    cells = nodes.select("id", "name", "about", F.transform(table, lambda p: F.levenshtein(F.col("name"), p)).alias("d")).withColumn("nearest", F.array_min("d"))
    home = F.expr("shiftleft(1L, cast(array_position(d, nearest) - 1 as int))")
    visits = F.expr(f"aggregate(transform(d, (far, i) -> if(far <= nearest + {2 * RADIUS}, shiftleft(1L, i), 0L)), 0L, (x, y) -> x | y)")
    place = F.sequence(F.lit(1), F.length("name"))
    shorter = F.transform(place, lambda i: F.concat(F.col("name").substr(F.lit(1), i - 1), F.col("name").substr(i + 1, F.length("name"))))
    variants = F.explode(F.array_distinct(F.when(F.length("name") >= 3, F.concat(F.array("name"), shorter)).otherwise(F.array("name"))))
    keyed = cells.select("id", "name", "about", home.alias("home"), visits.alias("visits"), variants.alias("variant"))
    keyed = keyed.withColumn("variant", F.xxhash64("variant"))
    h, v = keyed.alias("h"), shuffled(keyed.alias("v"))
    meet = (F.col("h.variant") == F.col("v.variant")) & (F.col("h.id") < F.col("v.id"))
    within = F.expr(f"(h.home & v.visits) != 0 and (v.home & h.visits) != 0 and levenshtein(h.name, v.name, {RADIUS}) >= 0")
    # exchanged neighbours share the variant that lacks one of them
    pair = F.sequence(F.lit(1), F.greatest(F.length("h.name") - 1, F.lit(1)))
    n = F.col("h.name")
    turned = F.transform(pair, lambda i: F.concat(n.substr(F.lit(1), i - 1), n.substr(i + 1, F.lit(1)), n.substr(i, F.lit(1)), n.substr(i + 2, F.length(n))))
    swapped = (F.length("h.name") == F.length("v.name")) & F.array_contains(turned, F.col("v.name"))
    out = [F.col("h.id").alias("a"), F.col("v.id").alias("b"), F.col("h.about").alias("x"), F.col("v.about").alias("y")]
    return h.join(v, meet & (within | swapped)).select(*out).dropDuplicates(["a", "b"])


def _only(df: DataFrame, key: str, target: str) -> DataFrame:
    """(a, b): keys all of whose targets are one, with it."""
    return df.groupBy(F.col(key).alias("a")).agg(F.min(target).alias("b"), F.max(target).alias("other")).where("b = other").select("a", "b")


def _owner(df: DataFrame, target: str) -> DataFrame:
    """(a, b): the owners of incomplete names (id, core, meant, target, owner_given).

    All must be one entity; for a surname that no complete name has, misspelt owners of
    one common given name are.
    """
    found = df.groupBy("id").agg(
        F.min(target).alias("least"), F.max(target).alias("most"), F.max(F.col("core") != F.col("meant")).alias("odd"),
        F.min("owner_given").alias("g"), F.max("owner_given").alias("h"), (F.count("owner_given") == F.count("*")).alias("all"),
    )
    found = found.where("least = most or (odd and `all` and g = h)")
    return found.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("least", "most"))).alias("b"))


def _agree(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def _settled(pairs: DataFrame, part: str) -> DataFrame:
    """(a, b): pairs that both have ``part``, equal, or both lack it; a node that lacks it is linked only if its partners agree on it."""
    x, y = F.col(f"x.{part}"), F.col(f"y.{part}")
    sure = pairs.where(x.eqNullSafe(y)).select("a", "b")
    loose = pairs.where(x.isNull() != y.isNull())
    ends = loose.select(F.when(x.isNull(), F.col("a")).otherwise(F.col("b")).alias("bare"), F.when(x.isNull(), F.col("b")).otherwise(F.col("a")).alias("full"), F.coalesce(x, y).alias("value"))
    agreed = _only(ends, "bare", "value").select(F.col("a").alias("bare"))
    return sure.unionByName(ends.join(shuffled(agreed), "bare").select(F.col("bare").alias("a"), F.col("full").alias("b")))


def body_edges(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (name_id, id), edges (a, b)) of organisations."""
    counts = parsed.groupBy("core", "part", "extra").agg(F.count("*").alias("n"), F.first("letters").alias("letters"))
    counts = materialise(counts, "name-bodies")
    # a field that few labels of a name have is a slip of theirs; a name without a field takes the name's only one
    fields = counts.where("part is not null").groupBy("core", "part").agg(F.sum("n").alias("n"))
    most = fields.groupBy("core").agg(F.sum("n").alias("total"), F.max_by("part", F.struct("n", "part")).alias("main"))
    own = fields.join(shuffled(most), "core").select("core", "part", F.when(F.col("n") >= F.greatest(F.lit(2), FIELD_SHARE * F.col("total")), F.col("part")).otherwise(F.col("main")).alias("field"))
    sole = own.groupBy("core").agg(F.min("field").alias("least"), F.max("field").alias("sole")).where("least = sole").select("core", "sole")
    named = parsed.select("name_id", "core", "part", "extra", "letters").join(shuffled(own), ["core", "part"], "left").join(shuffled(sole), "core", "left")
    named = named.withColumn("field", F.coalesce("field", "sole")).withColumn("id", F.xxhash64(F.lit("org"), "core", "field"))
    rows = materialise(named.select("name_id", "id", "core", "letters", "field", "extra"), "name-body-rows")
    kinds = rows.groupBy("id", "core", "letters", "field", "extra").count()
    nodes = kinds.groupBy("id", "core", "letters", "field").agg(F.max_by("extra", F.struct(F.col("extra").isNotNull(), "count", "extra")).alias("extra"))
    pairs = near_names(nodes.select("id", F.col("core").alias("name"), F.struct("core", "letters", "field", "extra").alias("about")))
    close = F.expr(f"levenshtein(x.letters, y.letters, {JAMO_RADIUS}) >= 0") | (F.length("x.core") == F.length("y.core")) & F.expr("translate(x.core, y.core, '') = ''")
    pairs = pairs.where(close & _agree(F.col("x.extra"), F.col("y.extra")) & _agree(F.col("x.field"), F.col("y.field")))
    return rows.select("name_id", "id"), _settled(materialise(pairs, "name-body-pairs"), "field")


def person_edges(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (name_id, id), edges (a, b)) of persons."""
    named = parsed.withColumn("id", F.xxhash64(F.lit("person"), "core", "given", "initial", "middle"))
    rows = named.select("name_id", "id")
    nodes = materialise(named.groupBy("id", "core", "given", "initial", "middle").agg(F.max("known").alias("known"), F.min("nick").alias("nick")), "name-persons")
    full = nodes.where("given is not null")
    about = F.struct("given", "known", "middle")
    pairs = near_names(full.select("id", F.concat_ws(" ", "given", "core").alias("name"), about.alias("about")))
    other_given = F.col("x.known") & F.col("y.known") & (F.col("x.given") != F.col("y.given"))
    strict = materialise(_settled(materialise(pairs.where(~other_given & _agree(F.col("x.middle"), F.col("y.middle"))), "name-person-pairs"), "middle"), "name-person-edges")
    roots = components(full, strict)
    # one row for each spelling of a complete name, with its entity and the entity's middle initial
    spelt = full.select("id", "core", "given", "known", "initial", "middle").join(shuffled(roots), "id")
    middles = spelt.groupBy("root").agg(F.max("middle").alias("root_middle"))
    entities = materialise(spelt.select("core", "given", "known", "initial", "root").distinct().join(shuffled(middles), "root"), "name-entities")
    # a nickname: a shorter form with the given name's beginning, or learnt from names that quote it
    nicks = entities.where(F.length("given") <= NICKNAME).select(F.col("known").alias("common"), "core", F.col("given").alias("nick"), F.col("root").alias("own"), F.col("root_middle").alias("own_middle"))
    known = entities.where("known").select("core", "given", "root", "root_middle", F.col("given").substr(1, 2).alias("start"))
    same_start = nicks.where("not common").withColumn("start", F.col("nick").substr(1, 2)).join(shuffled(known), ["core", "start"]).where(F.length("given") >= F.length("nick") + 2)
    learnt = full.where("known and nick is not null").select("given", "nick").distinct()
    quoted = nicks.join(shuffled(learnt), "nick").join(shuffled(known), ["core", "given"])
    columns = ["own", "own_middle", "root", "root_middle"]
    called = same_start.select(columns).unionByName(quoted.select(columns)).where((F.col("own") != F.col("root")) & _agree(F.col("own_middle"), F.col("root_middle")))
    by_nick = materialise(_only(called, "own", "root"), "name-nicks")
    # from here on a nickname's names are those of its owner
    owned = entities.join(shuffled(by_nick.select(F.col("a").alias("root"), "b")), "root", "left").withColumn("root", F.coalesce("b", "root"))
    keyed = owned.select("core", "initial", "root", "root_middle", F.when(F.col("known"), F.col("given")).alias("owner_given")).distinct()
    bare = nodes.where("given is null")
    # a surname that no complete name has is read as those near it
    surnames = entities.select("core").distinct().withColumn("whole", F.lit(True))
    lost = bare.select("core").distinct().join(shuffled(surnames), "core", "left_anti").withColumn("whole", F.lit(False))
    about = F.struct("core", "whole")
    beside = near_names(surnames.unionByName(lost).select(F.xxhash64("core").alias("id"), F.col("core").alias("name"), about.alias("about"))).where("x.whole != y.whole")
    near = beside.select(F.expr("if(x.whole, y.core, x.core)").alias("core"), F.expr("if(x.whole, x.core, y.core)").alias("meant"))
    read = materialise(near.unionByName(surnames.select("core", F.col("core").alias("meant"))), "name-surnames")
    bare = materialise(bare.select("id", "core", "initial", "middle").join(shuffled(read), "core", "left").withColumn("meant", F.coalesce("meant", "core")), "name-bare")
    # an initial and a surname
    initials = bare.where("initial is not null")
    keyed_as = keyed.withColumnRenamed("core", "meant")
    meant = initials.join(shuffled(keyed_as), ["meant", "initial"]).where(_agree(F.col("middle"), F.col("root_middle")))
    by_initial = materialise(_owner(meant, "root"), "name-initials")
    # initials without a complete name are entities of their own, those without a middle initial the only one of theirs
    alone = initials.select("id", "core", "initial", "middle").distinct().join(shuffled(meant.select("id").distinct()), "id", "left_anti")
    alone = materialise(alone, "name-alone")
    with_middle = alone.where("middle is not null").select("core", "initial", F.col("id").alias("with"))
    by_middle = materialise(_only(alone.where("middle is null").join(shuffled(with_middle), ["core", "initial"]), "id", "with"), "name-middles")
    # a bare surname
    no_given = F.lit(None).cast("string").alias("owner_given")
    owners = keyed.select("core", F.col("root").alias("owner"), "owner_given").unionByName(alone.where("middle is not null").select("core", F.col("id").alias("owner"), no_given))
    owners = owners.unionByName(alone.where("middle is null").join(shuffled(by_middle.select(F.col("a").alias("id"))), "id", "left_anti").select("core", F.col("id").alias("owner"), no_given)).distinct()
    by_surname = materialise(_owner(bare.where("initial is null").join(shuffled(owners.withColumnRenamed("core", "meant")), "meant"), "owner"), "name-surname-owners")
    edges = strict
    for more in (by_initial, by_middle, by_surname, by_nick):
        edges = edges.unionByName(more)
    return rows, edges


def link_names(labels: DataFrame) -> DataFrame:
    """(name_id_a, name_id_b) of rows (name_id, kind in org/person, label): all pairs of one entity."""
    labels = labels.where("label is not null and name_id is not null")
    kinds, fields, lengths = learn_parts(labels.where("kind = 'org'"))
    given = learn_given(labels.where("kind = 'person'"))
    parsed = materialise(parse_names(labels, kinds, fields, lengths, given).distinct(), "names-parsed")
    body_rows, bodies = body_edges(parsed.where("kind = 'org'"))
    person_rows, persons = person_edges(parsed.where("kind = 'person'"))
    rows = body_rows.unionByName(person_rows)
    roots = components(rows.select("id").distinct(), bodies.unionByName(persons))
    members = materialise(rows.join(shuffled(roots), "id").select("name_id", "root").distinct(), "name-members")
    a, b = members.alias("a"), shuffled(members.alias("b"))
    linked = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.name_id") < F.col("b.name_id")))
    return linked.select(F.col("a.name_id").alias("name_id_a"), F.col("b.name_id").alias("name_id_b")).distinct()


def name_rows(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """(name_id, kind, label) of the persons and organisations in the two tables."""
    people = F.array_contains("types", "foaf:Person")
    bodies = F.array_contains("types", "org:Organization")
    from_entities = entities.where(people | bodies).select("name_id", F.when(bodies, "org").otherwise("person").alias("kind"), "label")
    from_terms = terms.where("upstream_parent_iri = 'org:OrganizationalUnit'").select("name_id", F.lit("org").alias("kind"), "label")
    return from_entities.unionByName(from_terms)
