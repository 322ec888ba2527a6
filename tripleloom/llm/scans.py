"""Noise in text from scanned pages.

Two passes over the pages. The first counts, over all pages, the words (once for each
distinct text) and the short lines that stand alone. Correction candidates of a word come from an inverted
join on character q-grams: its rarest q-grams meet those of commoner words, pairs
of close edit distance stay. Gradient-boosted trees rank the candidates and accept
a replacement. Classifiers over pairs of neighbouring lines tell a word broken at
a line end from a dash, and furniture (running titles) from text. The second pass
repairs each page: joins, drops furniture and page numbers, replaces misread words
and digits, and flows the lines into paragraphs.

All models are fitted here on bounded samples: ``SAMPLE_WORDS`` common words with
synthetic misreadings or hyphens and about ``SAMPLE_PAGES`` pages whose lines are
labelled by their surroundings. Counts, candidates and repairs cover all pages and
words: what a page has to look up (shares of words, templates, corrections, compounds)
is broadcast if it is counted few, else joined to the pages that ask for it.

Defined results: null stays null without noise; empty stays empty; look-alike
characters are brought to their one form first and are no noise; repeated rows
give equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.llm.lookalike import SUSPECT_JAVA, canonical
from tripleloom.llm.names import edit_distance, jamo
from tripleloom.session import materialise

#: Bounds of the samples the models are fitted on.
SAMPLE_WORDS, SAMPLE_PAGES = 1_500, 2_000
#: A word is corrected only to one at least so many times as common.
RATIO = 8
#: Entries up to this number are broadcast; more are joined to the pages that look them up.
CORRECTION_LIMIT = 200_000
#: Rarest q-grams that are probed: one edit destroys two, two edits side by side three.
Q, PROBES = 2, 4
SHORT_LINE = 60

_SUSPECT = re.compile(SUSPECT_JAVA)
_MARKER = re.compile(r"^\[(?:BLOCK|ROW) [^\]\n]*\] ?", re.M)
_BREAK = re.compile(r"([가-힣A-Za-z])[-¬‐][ \t]*\n[ \t]*([가-힣A-Za-z])")
#: A hyphenated word inside a line, and the halves of one at a line end.
_COMPOUND = re.compile(r"(?<![\w-])(?:[A-Za-z]+|[가-힣]+)-(?:[A-Za-z]+|[가-힣]+)(?![\w-])")
_BROKEN = re.compile(r"([A-Za-z]+|[가-힣]+)[-¬‐][ \t]*\n[ \t]*([A-Za-z]+|[가-힣]+)")
_WORD = re.compile(r"[가-힣]+|[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*")
_ADDRESS = re.compile(r"https?://\S+|\]\([^)\s]*\)|<[^<>\n]{1,200}>|`[^`\n]*`|\\[A-Za-z]+|&[A-Za-z#0-9]+;|\$[^$\n]*\$")
# The forms of a line that is only a page number; digits may be misread.
_N = r"[0-9lIOoSBZ]{1,4}"
_PAGE_NUMBER = re.compile(
    rf"^[ \t]*(?:[-–—·~|*\[(<]+[ \t]*)?(?:(?:page|pg\.?|p\.?|쪽|페이지|면)[ \t]*)?{_N}(?:[ \t]*(?:/|of|중)[ \t]*{_N})?(?:[ \t]*(?:쪽|페이지|면|page))?(?:[ \t]*[-–—·~|*\])>]+)?[ \t]*$",
    re.I,
)
_HAS_DIGIT = re.compile(r"\d")
# Digits read as letters, in numbers and in codes.
_RUN = re.compile(r"(?<![A-Za-z0-9])(?=[0-9lIOoSBZ]*[lIOoSBZ])(?=[lIOoSBZ]*[0-9])[0-9lIOoSBZ]+(?![A-Za-z0-9])")
_UNIT = re.compile(r"(?<![A-Za-z0-9.])[lIOoSBZ]{1,3}(?=(?:학점|학년|학기|월|일|명|호|층|번|회|과목|시간|시|분|년|점|건|부|쪽|개|단계|만원|주차|%|:\d))")
_CODE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2,4}(?=[0-9lIOSBZ]{3,5}(?![A-Za-z0-9]))(?=[0-9lIOSBZ]*[0-9])(?=[0-9lIOSBZ]*[lIOSZ]|[0-9]+[0-9lIOSBZ]*B)[0-9lIOSBZ]+")
_DIGIT_OF = str.maketrans("lIOoSBZ", "1100582")
_ENDED = re.compile(r"[.!?。:;)\]}>|=`~*]\s*$|^\s*$")
_MARKUP_LINE = re.compile(r"^\s*(?:[#>|!{}\\<*+`=~]|-\s|-{3,}|\d+\.\s|\[\[|\{\{)")
# Medial, final and initial jamo and letters that look alike in print.
_ALIKE = {
    frozenset(p)
    for p in (
        (0x1169, 0x1173), (0x1161, 0x1175), (0x1162, 0x1166), (0x116E, 0x1172), (0x116F, 0x1171), (0x116A, 0x116C), (0x1167, 0x1165),
        (0x1163, 0x1161), (0x1165, 0x1175), (0x116D, 0x1169), (0x11B7, 0x11B8), (0x11BC, 0x11B7), (0x110E, 0x110C),
        (0x1100, 0x110F), (0x1103, 0x1110), (0x1107, 0x1111),
    )
}
_LATIN_ALIKE = (("m", "rn"), ("h", "b"), ("l", "1"), ("i", "1"), ("o", "0"), ("s", "5"), ("e", "c"), ("d", "cl"), ("w", "vv"), ("b", "6"), ("z", "2"), ("l", "i"), ("u", "ii"), ("n", "ri"), ("g", "9"), ("t", "f"))
_PARTICLE = re.compile(r"(?:은|는|이|가|을|를|와|과|도|로|으로|의|에|만)$")


def _clean(text: str) -> str:
    return canonical(text) if _SUSPECT.search(text) else text


def _lines(text: str) -> list[tuple[str, str]]:
    """(marker, line) of each line."""
    out = []
    for line in text.split("\n"):
        m = _MARKER.match(line)
        out.append((m[0], line[m.end() :]) if m else ("", line))
    return out


def template(line: str) -> str:
    """A line without case, spacing and numbers, for counting."""
    return re.sub(r"[0-9lIOoSBZ]*\d[0-9lIOoSBZ]*", "9", " ".join(line.split())).casefold()


def short_line(line: str) -> bool:
    """Whether a line may be furniture by its form alone."""
    plain = line.strip()
    return 0 < len(plain) <= SHORT_LINE and not _MARKUP_LINE.match(plain) and not _PAGE_NUMBER.match(plain) and not re.search(r"[.!?。,;]$|[-¬]$|[<>{}\\`]|\]\(|\[\[", plain)


def line_words(line: str) -> list[str]:
    return re.findall(r"[가-힣]+|[a-z]+|9", template(line))


# ---- first pass ------------------------------------------------------------------


def page_counts(rows: DataFrame) -> DataFrame:
    """(kind, key, n, alone) over all rows (record_id, text, page).

    kind w: a word and how often it is read in distinct texts, so that copies of a page
    don't make its misreadings common; kind t: a word of a line and how often it stands
    in a short line (alone) and anywhere (n); kind l: a short line's template; kind h: a
    word with a hyphen inside a line; kind b: the two halves at a hyphenated line end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        more: Counter = Counter()
        alone: Counter = Counter()
        anywhere: Counter = Counter()
        templates: Counter = Counter()
        compounds: Counter = Counter()
        broken: Counter = Counter()
        for batch in batches:
            for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                lines = _lines(_clean(text))
                kept = []
                for i, (marker, line) in enumerate(lines):
                    if marker == "" and _PAGE_NUMBER.match(line) and _HAS_DIGIT.search(line):
                        continue
                    kept.append(line)
                    if marker == "" and short_line(line) and not _setext(lines, i) and not _continues(lines, i):
                        templates[template(line)] += copies
                        for w in set(line_words(line)):
                            alone[w] += copies
                whole = "\n".join(kept)
                for m in _COMPOUND.finditer(whole):
                    compounds[m[0].casefold()] += 1
                for m in _BROKEN.finditer(whole):
                    broken[f"{m[1]}-{m[2]}".casefold()] += 1
                body = _ADDRESS.sub(" ", _BREAK.sub(r"\1\2", whole))
                found = _WORD.findall(body)
                words.update(found)
                if copies > 1:
                    more.update({w: n * (copies - 1) for w, n in Counter(found).items()})
        for w, n in words.items():
            anywhere[w.casefold()] += n + more[w]
        out = [("w", w, n, 0) for w, n in words.items()] + [("l", t, n, 0) for t, n in templates.items()]
        out += [("t", t, anywhere.get(t, 0), n) for t, n in alone.items()]
        out += [("h", t, n, 0) for t, n in compounds.items()] + [("b", t, n, 0) for t, n in broken.items()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "key", "n", "alone"])

    texts = rows.groupBy("text").agg(F.count("*").alias("copies"))
    return texts.mapInArrow(run, "kind string, key string, n long, alone long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone"))


def _setext(lines: list[tuple[str, str]], i: int) -> bool:
    """A title underlined by the next line."""
    return i + 1 < len(lines) and bool(re.match(r"^\s*(?:={3,}|-{3,})\s*$", lines[i + 1][1]))


def _continues(lines: list[tuple[str, str]], i: int) -> bool:
    """The line before ends in a dash after a space or in a broken word."""
    return i > 0 and bool(re.search(r"[-–—¬]\s*$", lines[i - 1][1])) and not _PAGE_NUMBER.match(lines[i - 1][1])


# ---- gradient-boosted ranking ------------------------------------------------------


class BoostedTrees:
    """Gradient boosting of depth-two trees for a yes/no answer, in NumPy."""

    def __init__(self, rounds: int = 60, rate: float = 0.25, bins: int = 24):
        self.rounds, self.rate, self.bins = rounds, rate, bins
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        score = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 2)[1:-1])) for f in range(x.shape[1])]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p) + 1e-6
            root = self._split(x, gradient, weight, cuts, np.ones(len(y), bool))
            if root is None:
                break
            f, c = root
            tree, left = [(f, c)], x[:, f] <= c
            for side in (left, ~left):
                inner = self._split(x, gradient, weight, cuts, side)
                values = []
                for part in ([side & (x[:, inner[0]] <= inner[1]), side & (x[:, inner[0]] > inner[1])] if inner else [side, side]):
                    value = self.rate * gradient[part].sum() / (weight[part].sum() + 1.0) if part.any() else 0.0
                    values.append(float(value))
                tree.append((inner or (0, math.inf), values))
            self.trees.append(tree)
            score += self._tree(tree, x)
        return self

    @staticmethod
    def _split(x, gradient, weight, cuts, rows):
        best, at = 1e-6, None
        g, h = gradient[rows], weight[rows]
        if len(g) < 4:
            return None
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(x.shape[1]):
            column = x[rows, f]
            for c in cuts[f]:
                left = column <= c
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
                if gain > best:
                    best, at = gain, (f, float(c))
        return at

    @staticmethod
    def _tree(tree, x: np.ndarray) -> np.ndarray:
        (f, c), (left, lv), (right, rv) = tree
        go = x[:, f] <= c
        return np.where(go, np.where(x[:, left[0]] <= left[1], lv[0], lv[1]), np.where(x[:, right[0]] <= right[1], rv[0], rv[1]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._tree(tree, x)
        return 1 / (1 + np.exp(-score))


def alike(word: str, other: str) -> float:
    """1 if the two differ in one printed look-alike, 0.5 in two, else 0."""
    if word == other:
        return 0.0
    if "가" <= other[:1] <= "힣" or "가" <= word[:1] <= "힣":
        if len(word) != len(other):
            return 0.0
        n = 0
        for a, b in zip(word, other, strict=True):
            if a == b:
                continue
            x, y = jamo(a), jamo(b)
            if len(x) != len(y):
                return 0.0
            odd = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
            if len(odd) != 1 or frozenset((ord(odd[0][0]), ord(odd[0][1]))) not in _ALIKE:
                return 0.0
            n += 1
        return {1: 1.0, 2: 0.5}.get(n, 0.0)
    a, b = word.casefold(), other.casefold()
    for right, wrong in _LATIN_ALIKE:
        for good, bad in ((right, wrong), (wrong, right)):
            at = b.find(good)
            while at >= 0:
                if b[:at] + bad + b[at + len(good) :] == a:
                    return 1.0
                at = b.find(good, at + 1)
    # several single-letter misreadings
    if len(a) == len(b):
        odd = [(p, q) for p, q in zip(a, b, strict=True) if p != q]
        table = {frozenset((r, w)) for r, w in _LATIN_ALIKE if len(r) == len(w) == 1}
        if odd and all(frozenset(o) in table for o in odd):
            return 1.0 if len(odd) == 1 else 0.5 if len(odd) == 2 else 0.25
    return 0.0


def features(word: str, n: int, other: str, m: int) -> list[float]:
    """Of a correction of ``word``, read n times, to ``other``, read m times."""
    a, b = jamo(word), jamo(other)
    return [
        math.log((m + 1) / (n + 1)),
        math.log(n + 1),
        float(abs(len(a) - len(b))),
        float(edit_distance(a, b, 4)),
        alike(word, other),
        float(bool(_PARTICLE.search(word)) and bool(_PARTICLE.search(other)) and word[:-1] == other[:-1]),
        float(len(other)),
        float(any(c.isdigit() for c in word)),
    ]


def _corrupted(word: str, random: np.random.Generator) -> str | None:
    """One synthetic misreading of ``word``."""
    if "가" <= word[0] <= "힣":
        options = []
        for i, c in enumerate(word):
            o = ord(c) - 0xAC00
            lead, vowel, tail = o // 588, o % 588 // 28, o % 28
            for pair in _ALIKE:
                x, y = sorted(pair)
                for was, now in ((x, y), (y, x)):
                    if was == 0x1161 + vowel and 0x1161 <= now <= 0x1175:
                        options.append((i, lead, now - 0x1161, tail))
                    elif was == 0x1100 + lead and 0x1100 <= now <= 0x1112:
                        options.append((i, now - 0x1100, vowel, tail))
                    elif tail and was == 0x11A7 + tail and 0x11A8 <= now <= 0x11C2:
                        options.append((i, lead, vowel, now - 0x11A7))
        if not options:
            return None
        i, lead, vowel, tail = options[random.integers(len(options))]
        return word[:i] + chr(0xAC00 + lead * 588 + vowel * 28 + tail) + word[i + 1 :]
    options = [(right, wrong, at) for right, wrong in _LATIN_ALIKE for at in range(len(word)) if word.startswith(right, at)]
    if not options:
        return None
    right, wrong, at = options[random.integers(len(options))]
    return word[:at] + wrong + word[at + len(right) :]


def fit_ranker(words: list[tuple[str, int]]) -> BoostedTrees:
    """Trees that tell synthetic misreadings of common words from true neighbours."""
    random = np.random.default_rng(7)
    words = words[:SAMPLE_WORDS]
    counts = dict(words)
    x, y = [], []
    for word, n in words:
        if len(word) < 2:
            continue
        for _ in range(3):
            wrong = _corrupted(word, random)
            if wrong and wrong not in counts:
                seen = max(1, int(n * 10 ** random.uniform(-3.2, -1.2)))
                x.append(features(wrong, seen, word, n))
                y.append(1)
        # other words: endings and neighbours that are right however rare
        for particle in ("은", "을", "와", "도", "의", "에", "로"):
            if "가" <= word[0] <= "힣":
                stem = word[:-1] if _PARTICLE.search(word) and len(word) > 2 else word
                seen = "을" if particle != "을" else "은"
                x.append(features(stem + particle, max(1, int(n * 10 ** random.uniform(-3, -0.3))), stem + seen, n))
                y.append(0)
        for _ in range(2):
            i = int(random.integers(len(word)))
            other = words[int(random.integers(len(words)))][0]
            made = word[:i] + other[int(random.integers(len(other)))] + word[i + 1 :]
            if made != word and not alike(made, word):
                x.append(features(made, max(1, int(n * 10 ** random.uniform(-3, -0.3))), word, n))
                y.append(0)
    by_form: dict[str, list[str]] = {}
    for word, _ in words:
        for i in range(len(word)):
            by_form.setdefault(word[:i] + "\0" + word[i + 1 :], []).append(word)
    for same in by_form.values():
        for a in same[:6]:
            for b in same[:6]:
                if a != b and counts[a] < counts[b]:
                    x.append(features(a, counts[a], b, counts[b]))
                    y.append(0)
    if len(set(y)) < 2:
        x += [features("힉점", 1, "학점", 100), features("학점을", 50, "학점은", 60)]
        y += [1, 0]
    return BoostedTrees().fit(np.array(x, float), np.array(y, float))


def candidates(words: DataFrame) -> DataFrame:
    """(word, n, other, m): commoner words that share a rare q-gram and are close, for each word."""
    grams = F.transform(F.sequence(F.lit(1), F.length("marked") - (Q - 1)), lambda i: F.col("marked").substr(i, F.lit(Q)))
    marked = words.where(F.length("word") > 1).withColumn("marked", F.concat(F.lit("^"), F.col("word"), F.lit("$")))
    exploded = marked.select("word", "n", "letters", F.explode(F.array_distinct(grams)).alias("gram"))
    frequency = exploded.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = exploded.join(frequency, "gram").withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("df", "gram")))
    # a common q-gram is split by the length of the words, which differs by one at most
    size = F.length("word")
    probe = ranked.where(F.col("place") <= PROBES).select("gram", "word", "n", "letters", F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    index = exploded.select("gram", size.alias("size"), F.col("word").alias("other"), F.col("n").alias("m"), F.col("letters").alias("other_letters"))
    close = (F.col("m") >= RATIO * F.col("n")) & (F.col("word") != F.col("other"))
    return probe.join(index, ["gram", "size"]).where(close & F.expr("levenshtein(letters, other_letters, 2) >= 0")).select("word", "n", "other", "m").distinct()


def corrections(counts: DataFrame) -> DataFrame:
    """(word, other): the accepted correction of each misread word."""
    rows = counts.where("kind = 'w' and length(key) between 2 and 40").select(F.col("key").alias("word"), "n")
    sample = [(r[0], r[1]) for r in rows.where("n >= 8").orderBy(F.desc("n"), "word").limit(SAMPLE_WORDS).collect()]
    ranker = fit_ranker(sample)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([jamo(w).casefold() for w in batch.column(0).to_pylist()], pa.string())], names=["word", "n", "letters"])

    words = materialise(rows.mapInArrow(spelt, "word string, n long, letters string"), "scan-words")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n, other, m = (batch.column(i).to_pylist() for i in range(4))
            rows = [features(*r) for r in zip(word, n, other, m, strict=True)]
            p = ranker.probability(np.array(rows, float)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(p)], names=["word", "other", "m", "p"])

    ranked = candidates(words).mapInArrow(rank, "word string, other string, m long, p double")
    best = ranked.groupBy("word").agg(F.max_by("other", F.struct("p", "m", "other")).alias("other"), F.max("p").alias("p"))
    return best.where("p >= 0.5").select("word", "other")


# ---- compounds at a line end -----------------------------------------------------


def _join_features(compound: int, joined: int, left: int, right: int) -> list[float]:
    return [1.0, math.log(1 + compound), math.log(1 + joined), math.log(1 + min(left, right)), math.log((1 + compound) / (1 + joined))]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier whose classes count alike."""
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    w = np.zeros(x.shape[1])
    for _ in range(400):
        p = 1 / (1 + np.exp(-(x @ w)))
        w += 0.8 * (x.T @ (balance * (y - p)) / len(y) - 0.001 * w)
    return w


def fit_joins(words: list[tuple[str, int]], compounds: list[tuple[str, int]]) -> np.ndarray:
    """Weights that tell a compound, which keeps its hyphen at a line end, from a broken word.

    Broken words are common words cut anywhere; compounds are the hyphenated words of
    lines, as seen a few times and often.
    """
    random = np.random.default_rng(11)
    counts = dict(words)
    x, y = [], []
    for word, n in words:
        if len(word) >= 4:
            cut = int(random.integers(1, len(word)))
            x.append(_join_features(0, n, counts.get(word[:cut], 0), counts.get(word[cut:], 0)))
            y.append(0.0)
            x.append(_join_features(0, 0, 0, counts.get(word[cut:], 0)))
            y.append(0.0)
    for word, n in compounds:
        left, right = word.split("-", 1)
        x.append(_join_features(n, counts.get(left + right, 0), counts.get(left, 0), counts.get(right, 0)))
        y.append(1.0)
    # compounds of a language without any in the sample
    for n in (1, 3, 10, 100):
        x.append(_join_features(n, 0, n, n))
        y.append(1.0)
        x.append(_join_features(n, 20 * n, n, n))
        y.append(0.0)
    return _logistic(np.array(x), np.array(y))


def compounds_at_line_ends(counts: DataFrame) -> DataFrame:
    """(key): pairs "left-right" met at line ends that are compounds and keep their hyphen."""
    bounded = lambda kind, least: [(r[0], r[1]) for r in counts.where(f"kind = '{kind}' and n >= {least}").orderBy(F.desc("n"), "key").limit(SAMPLE_WORDS).select("key", "n").collect()]
    w = fit_joins(bounded("w", 8), bounded("h", 2))
    met = counts.where("kind = 'b'").select("key").join(counts.where("kind = 'h'").select("key", F.col("n").alias("compound")), "key")
    left, right = F.substring_index("key", "-", 1), F.substring_index("key", "-", -1)
    words = counts.where("kind = 'w'").select(F.lower("key").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    for name, column in (("joined", F.concat(left, right)), ("left_n", left), ("right_n", right)):
        met = met.withColumn("word", column).join(words.withColumnRenamed("n", name), "word", "left").drop("word").fillna(0, [name])
    log = F.log1p
    score = w[0] + w[1] * log("compound") + w[2] * log("joined") + w[3] * log(F.least("left_n", "right_n")) + w[4] * F.log((1 + F.col("compound")) / (1 + F.col("joined")))
    return met.where(score > 0).select("key")


# ---- line pairs ------------------------------------------------------------------


class LineModel:
    """Logistic classifiers of line pairs: broken words and furniture."""

    def __init__(self, share: dict[str, float], templates: dict[str, int]):
        self.share, self.templates = share, templates
        self.header = np.zeros(8)

    def header_features(self, lines: list[tuple[str, str]], i: int) -> list[float]:
        line = lines[i][1].strip()
        words = line_words(line)
        shares = sorted((self.share.get(w, 0.0) for w in words if w != "9"), reverse=True) or [0.0]
        before = next((t for _, t in reversed(lines[:i]) if t.strip() and not _PAGE_NUMBER.match(t)), "")
        return [
            1.0,
            shares[0],
            sum(shares) / len(shares),
            min(math.log(1 + self.templates.get(template(line), 0)), 4.0) / 4.0,
            float(bool(before) and not _ENDED.search(before)),
            float(len(words) <= 8),
            float(bool(re.search(r"(?:다|요|며|고|은|는|이|가|을|를|에|의|로|와|과)$", line))),
            float(lines[i][0] != ""),
        ]

    def fit(self, samples: list[list[float]], labels: list[float]) -> LineModel:
        if len(set(labels)) < 2:
            self.header = np.array([-5.0, 5.0, 2.0, 1.0, 0.5, 0.0, -1.5, -2.0])
        else:
            self.header = _logistic(np.array(samples, float), np.array(labels, float))
        return self

    def is_header(self, lines: list[tuple[str, str]], i: int) -> bool:
        if lines[i][0] or not short_line(lines[i][1]) or _setext(lines, i) or _continues(lines, i):
            return False
        f = self.header_features(lines, i)
        # a title has a word that mostly stands alone, whatever the fitted weights
        return f[1] >= 0.4 and float(np.dot(self.header, f)) > 0


def line_facts(counts: DataFrame) -> DataFrame:
    """(kind, key, value): shares of words that stand alone (s) and counts of repeated short lines (l), of all pages."""
    share = counts.where("kind = 't' and alone >= 3 and alone >= 0.02 * n").select(F.lit("s").alias("kind"), "key", F.least(F.lit(1.0), F.col("alone") / F.greatest("n", "alone", F.lit(1))).alias("value"))
    return share.unionByName(counts.where("kind = 'l' and n >= 2").select("kind", "key", F.col("n").cast("double").alias("value")))


def fit_lines(pages: list[str], facts: dict[str, dict[str, float]]) -> np.ndarray:
    """Weights of the furniture classifier, fitted on lines labelled by what their words do elsewhere."""
    model = LineModel(facts["s"], facts["l"])
    samples, labels = [], []
    for text in pages:
        lines = _lines(_clean(text))
        for i, (marker, line) in enumerate(lines):
            if marker or not short_line(line) or _setext(lines, i) or _continues(lines, i):
                continue
            f = model.header_features(lines, i)
            # sure cases only: words that hardly stand anywhere else, or words that mostly do
            if f[1] >= 0.8 and f[3] > 0.3:
                samples.append(f)
                labels.append(1.0)
            elif f[1] < 0.3:
                samples.append(f)
                labels.append(0.0)
    # what a sentence cut by furniture leaves behind
    samples += [[1.0, s, s / 2, t, float(s > 0.2), 1.0, 1.0, 0.0] for s in (0.0, 0.1, 0.2, 0.3) for t in (0.0, 0.3, 0.6, 1.0)]
    labels += [0.0] * 16
    return model.fit(samples, labels).header


def line_keys(text: str | None) -> list[tuple[str, str]]:
    """(kind, key) of the facts that the lines of a page look up."""
    if not text:
        return []
    asked: set[tuple[str, str]] = set()
    for marker, line in _lines(_clean(text)):
        if marker == "" and short_line(line):
            asked.add(("l", template(line)))
            asked.update(("s", w) for w in line_words(line))
    return sorted(asked)


# ---- second pass -----------------------------------------------------------------


def repair_page(text: str | None, model: LineModel, fixed: dict[str, str], compounds: set[str] | frozenset[str] = frozenset()) -> tuple[str | None, list[str]]:
    """The page as paragraphs, and the kinds of noise in it."""
    if not text:
        return text, []
    noise: set[str] = set()
    lines = _lines(_clean(text))
    kept: list[tuple[str, str, bool]] = []  # marker, line, whether furniture stood before
    cut = False
    fence = False
    for i, (marker, line) in enumerate(lines):
        if re.match(r"^\s*(?:```|~~~)", line):
            fence = not fence
        if not fence and not marker and _PAGE_NUMBER.match(line) and _HAS_DIGIT.search(line.translate(_DIGIT_OF)) and (_HAS_DIGIT.search(line) or len(line.strip()) > 1):
            noise.add("pageno")
            if re.search(r"[lIOoSBZ]", re.sub(r"(?i)page|of|pg", "", line)):
                noise.add("misread")
            cut = True
            continue
        if not fence and model.is_header(lines, i):
            noise.add("header")
            if _misread_numbers(line)[1] or any(w in fixed for w in _WORD.findall(line)):
                noise.add("misread")
            cut = True
            continue
        kept.append((marker, line, cut))
        cut = False
    out: list[str] = []
    for marker, line, after_furniture in kept:
        previous = out[-1] if out else ""
        m = re.search(r"([가-힣A-Za-z])[-¬‐][ \t]*$", previous)
        if m and not marker and re.match(r"\s*[가-힣A-Za-z]", line):
            pair = _BROKEN.search(previous[-200:].rstrip() + "\n" + line.lstrip()[:200])
            kept_hyphen = pair is not None and f"{pair[1]}-{pair[2]}".casefold() in compounds
            if not kept_hyphen:
                noise.add("hyphen")
            out[-1] = previous[: m.end(1)] + ("-" if kept_hyphen else "") + line.lstrip()
        elif after_furniture and previous.strip() and line.strip() and not marker and not _ENDED.search(previous) and not _MARKUP_LINE.match(line):
            out[-1] = previous.rstrip() + " " + line.lstrip()
        else:
            out.append(marker + line)
    flowed = "\n".join(out)
    parts = []
    at = 0
    for m in _ADDRESS.finditer(flowed):
        parts += [_replace(flowed[at : m.start()], fixed, noise), m[0]]
        at = m.end()
    parts.append(_replace(flowed[at:], fixed, noise))
    return "".join(parts), sorted(noise)


def _misread_numbers(text: str) -> tuple[str, bool]:
    seen = False

    def digits(m: re.Match) -> str:
        nonlocal seen
        seen = True
        return m[0].translate(_DIGIT_OF)

    def code(m: re.Match) -> str:
        nonlocal seen
        seen = True
        head = re.match(r"[A-Z]+?(?=[0-9lIOSBZ]{3,5}$)", m[0])
        return head[0] + m[0][head.end() :].translate(_DIGIT_OF) if head else m[0]

    text = _RUN.sub(digits, text)
    text = _UNIT.sub(digits, text)
    return _CODE.sub(code, text), seen


def _replace(text: str, fixed: dict[str, str], noise: set[str]) -> str:
    if not text:
        return text

    def word(m: re.Match) -> str:
        other = fixed.get(m[0])
        if other is None:
            return m[0]
        noise.add("misread")
        return other

    masked = _MARKER.sub("", text)
    plain, seen = _misread_numbers(masked)
    if seen:
        noise.add("misread")
        text = "\n".join(_misread_numbers(line)[0] if not _MARKER.match(line) else _MARKER.match(line)[0] + _misread_numbers(_MARKER.sub("", line))[0] for line in text.split("\n"))
    if any(w in fixed for w in set(_WORD.findall(plain))):
        text = "\n".join((_MARKER.match(line)[0] if _MARKER.match(line) else "") + _WORD.sub(word, _MARKER.sub("", line)) for line in text.split("\n"))
    return text


class _Asked(dict):
    """No corrections; keeps the words it is asked for."""

    def __init__(self):
        super().__init__()
        self.words: set[str] = set()

    def __contains__(self, word) -> bool:
        self.words.add(word)
        return False

    def get(self, word, default=None):
        self.words.add(word)
        return default


def looked_up(text: str | None, model: LineModel, compounds: set[str]) -> list[str]:
    """The words that ``repair_page`` looks up among the corrections."""
    asked = _Asked()
    repair_page(text, model, asked, compounds)
    return sorted(asked.words)


FACT = "array<struct<kind:string,key:string,value:double>>"


def _sampled(rows: DataFrame) -> list[str]:
    """About ``SAMPLE_PAGES`` texts of several lines, by the hash of their key; only those leave the executors."""
    several = rows.where("text like '%\n%'")
    part = max(1, several.count() // SAMPLE_PAGES)
    return [r[0] for r in several.where(F.pmod(F.xxhash64("record_id"), F.lit(part)) == 0).select("text").orderBy(F.xxhash64("text")).limit(2 * SAMPLE_PAGES).collect()]


def _joined(pages: DataFrame, asked: DataFrame, entries: DataFrame, out: str) -> DataFrame:
    """``pages`` (.., row) with the ``entries`` (kind, key, ..) that ``asked`` (row, kind, key) names, as an array ``out``."""
    own = asked.join(entries, ["kind", "key"]).groupBy("row").agg(F.collect_list(F.struct(*entries.columns)).alias(out))
    return pages.join(own, "row", "left")


def repair_pages(rows: DataFrame) -> DataFrame:
    """(record_table, record_id, repaired, noise) of rows (record_table, record_id, text)."""
    spark = rows.sparkSession
    counts = materialise(page_counts(rows), "scan-counts")
    facts = line_facts(counts)
    fixes = materialise(corrections(counts), "scan-corrections")
    kept = materialise(compounds_at_line_ends(counts), "scan-compounds")
    sample = _sampled(rows)
    shared: dict[str, dict] = {}
    total = facts.limit(CORRECTION_LIMIT + 1).count() + fixes.limit(CORRECTION_LIMIT + 1).count() + kept.limit(CORRECTION_LIMIT + 1).count()
    wanted = facts
    if total > CORRECTION_LIMIT:
        # the classifier is fitted with the facts of its sample only
        keys = sorted({k for text in sample for k in line_keys(text)})
        wanted = facts.join(spark.createDataFrame(keys or [("", "")], "kind string, key string"), ["kind", "key"])
    shared = {"s": {}, "l": {}}
    for r in wanted.toLocalIterator():
        shared[r["kind"]][r["key"]] = r["value"]
    header = fit_lines(sample, shared)
    schema = "record_table string, record_id string, repaired string, noise array<string>"

    def emit(batch: pa.RecordBatch, done: list[tuple[str | None, list[str]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.list_(pa.string()))], names=["record_table", "record_id", "repaired", "noise"])

    def model_of(share: dict[str, float], templates: dict[str, float]) -> LineModel:
        model = LineModel(share, templates)
        model.header = header
        return model

    if total <= CORRECTION_LIMIT:
        known = spark.sparkContext.broadcast((shared["s"], shared["l"], {r[0]: r[1] for r in fixes.toLocalIterator()}, {r[0] for r in kept.toLocalIterator()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            share, templates, fixed, compounds = known.value
            model = model_of(share, templates)
            for batch in batches:
                yield emit(batch, [repair_page(t, model, fixed, compounds) for t in batch.column(2).to_pylist()])

        return rows.select("record_table", "record_id", "text").mapInArrow(run, schema)
    # too many to broadcast: each page gets its own facts and compounds, then the corrections its repair looks up
    pages = materialise(rows.select("record_table", "record_id", "text").withColumn("row", F.monotonically_increasing_id()), "scan-pages")

    def ask_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [line_keys(t) + [("b", f"{m[1]}-{m[2]}".casefold()) for m in _BROKEN.finditer(_clean(t or ""))] for t in batch.column(1).to_pylist()]
            keys = [[{"kind": a, "key": b} for a, b in page] for page in asked]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string())])))], names=["row", "keys"])

    asked = pages.select("row", "text").mapInArrow(ask_lines, "row long, keys array<struct<kind:string,key:string>>").select("row", F.inline("keys")).distinct()
    entries = facts.unionByName(kept.select(F.lit("b").alias("kind"), "key", F.lit(1.0).alias("value")))
    pages = materialise(_joined(pages, asked, entries, "facts"), "scan-facts")

    def own_model(own: list[dict] | None) -> tuple[LineModel, set[str]]:
        by_kind: dict[str, dict] = {"s": {}, "l": {}, "b": {}}
        for f in own or []:
            by_kind[f["kind"]][f["key"]] = f["value"]
        return model_of(by_kind["s"], by_kind["l"]), set(by_kind["b"])

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [looked_up(t, *own_model(f)) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["row", "words"])

    words = pages.select("row", "text", "facts").mapInArrow(ask_words, "row long, words array<string>").select("row", F.lit("c").alias("kind"), F.explode("words").alias("key"))
    fixed = fixes.select(F.lit("c").alias("kind"), F.col("word").alias("key"), "other")

    def run_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            done = []
            for text, own, fixes_of in zip(*columns, strict=True):
                model, compounds = own_model(own)
                done.append(repair_page(text, model, {f["key"]: f["other"] for f in fixes_of or []}, compounds))
            yield emit(batch, done)

    return _joined(pages, words, fixed, "own").select("record_table", "record_id", "text", "facts", "own").mapInArrow(run_own, schema)


def page_rows(units: DataFrame, restorations: DataFrame) -> DataFrame:
    """(record_table, record_id, text) of both tables."""
    a = units.select(F.lit("evidence_units").alias("record_table"), F.col("unit_id").alias("record_id"), "text")
    b = restorations.select(F.lit("restorations").alias("record_table"), F.col("restoration_id").alias("record_id"), F.col("markdown").alias("text"))
    return a.unionByName(b)


def scan_noise(rows: DataFrame) -> DataFrame:
    """(record_table, record_id, noise): one row for each record and kind of noise."""
    return repair_pages(rows).select("record_table", "record_id", F.explode("noise").alias("noise")).distinct()
