"""Broken prompt and response pairs.

Responses and the sentences of all evidence are brought to one key (letters and digits
only) and sorted by text over the whole table, in ranges of keys. Neighbours' common
prefixes are compared: an unended response whose next sentence begins with all of it is
a shortened version, one that equals it is whole. Lengths at which unended responses
pile up over the whole corpus (a length limit) make the following check tolerant of
edits. A shortened version is a truncated answer if a sentence of its own evidence
completes it. Copies, refusals and languages are found by rules.

The first defect that applies of empty, refusal, copied, other_language and
truncated is given. Defined results: a null or letterless response is empty; a
null question is compared as empty text; without evidence nothing is truncated;
repeated rows give one row.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.session import BROADCAST_KEY_LIMIT, materialise

#: An unended length is a spike if it has so many responses and so many times the mean of its neighbours.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_WINDOW = 20, 4.0, 10
#: Similarity of a response to the beginning of a sentence that counts as shortened, at and off a spike.
NEAR_AT_SPIKE, NEAR = 0.75, 0.85
SHORTEST_CUT = 6
#: Keys of a sorted range, and ranges that the sampled splitters make at most.
RANGE_KEYS, RANGES = 20_000, 2_000

# How an answer is declined.
_REFUSAL = re.compile(
    r"(?:답변|답|대답|응답|회신|안내|도움|말씀)\S{0,3}\s*(?:드릴|드리|할|해\s?드릴|해\s?드리|해드리|하)\S{0,2}\s*(?:수\s*(?:가\s*)?없|지\s*못|기\s*(?:어렵|곤란|힘))\S*(?:습니다|니다|어요|아요|요|질문|주제|내용)|"
    r"(?:도와|알려|답해|설명해|응답해|대답해|처리해)\s*드(?:릴|리)\S{0,2}\s*(?:수\s*(?:가\s*)?없|지\s*못|기\s*(?:어렵|곤란|힘))|"
    r"답변을?\s*거절|답변이\s*(?:곤란|불가|어렵)|(?:안내|답변|응답)[이가]?\s*불가능(?:합니다|해요)|권한이\s*없\S*\s*답변|말씀드릴\s*수\s*있는\s*내용이\s*없|제\s*능력\s*밖|"
    r"대답을?\s*드리지\s*못|응답해?\s*드리지\s*못|답을?\s*드릴\s*수\s*없|답변드릴\s*수\s*없|"
    r"\b(?:i|we)\s+(?:can(?:no|')t|can not|am not able to|are not able to|am unable to|must decline to|will not|won't|have to decline)\s+(?:\w+\s+){0,3}?(?:help|answer|assist|provide|respond|discuss|comment|share)|"
    r"(?:^|[.!;,]\s*|\b(?:i|we|i'm|we're|am|are|must|have to)\s+)(?:unable|not able|decline|refuse)\s+to\s+(?:answer|help|assist|respond|comment)\b(?!\s+the\s+(?:phone|door|call))|beyond what i can|"
    r"\b(?:outside|beyond|not within|not in)\s+(?:of\s+)?(?:my|our)\s+(?:remit|scope|competence|expertise|area|power|abilit|capabilit)|no comment\b|"
    r"\b(?:ich|wir)\b[^.!?]{0,40}\bnicht\s+(?:beantworten|helfen|weiterhelfen|antworten|sagen)|\b(?:kann|können|darf|möchte)\s+(?:ich|wir)\b[^.!?]{0,40}\bnicht\s+(?:beantworten|helfen|weiterhelfen|antworten|sagen)|"
    r"\bnon posso (?:rispondere|aiutar|fornire)|\bnão posso (?:responder|ajudar|fornecer)|\bik kan (?:u |je )?(?:hier|dit|die vraag)[^.!?]{0,30}niet\b|не могу (?:ответить|помочь|предоставить)|not (?:something|a question) i can|i'?m sorry,? but i|i'?d rather not|no answer can be given|"
    r"je (?:ne peux pas|ne suis pas en mesure|refuse|ne saurais)|je suis désolé|désolé,? (?:mais )?je|no puedo (?:responder|ayudar|contestar|proporcionar)|lo siento,? (?:pero )?no|no me es posible|"
    r"(?:tôi|chúng tôi) (?:không thể|rất tiếc|xin phép không)|xin lỗi,? (?:nhưng )?(?:tôi|chúng tôi)|"
    r"(?:お答え|回答|お手伝い|ご案内|返答|対応)(?:する(?:こと(?:は|が))?)?(?:いた)?(?:でき(?:ません|かねます)|しかねます|致しかねます)|お答えを控え|(?:无法|不能|没法|難以|无权)(?:为您)?(?:回答|提供|解答|协助|帮助|答复)|拒绝回答|抱歉[,，]",
    re.I,
)
# Typical declining sentences, for those with typing errors.
_DECLINES = (
    "제가 답변드릴 수 없는 질문입니다", "이 요청은 도와드릴 수 없습니다", "그 부분은 안내가 불가능합니다", "답변을 거절할 수밖에 없습니다",
    "말씀드릴 수 있는 내용이 없습니다", "제공된 정보만으로는 대답을 드리지 못합니다", "알려 드릴 권한이 없어 답변이 곤란합니다",
    "정책상 응답해 드리지 못하는 주제입니다", "그 내용은 답해 드리기 어렵습니다", "제 능력 밖의 질문이라 답을 드릴 수 없어요",
    "I'm sorry, but I can't help with that request", "I must decline to answer", "Unfortunately I am not able to answer this question",
    "As an assistant I cannot provide an answer to that", "Sorry, this is beyond what I can respond to",
)
# Labels before a repeated question.
_LABEL = re.compile(r"^(?:질문\s*내용|문의\s*내용|질의\s*내용|질문|문의|질의|물음|문|question|query|prompt|user|q)(?:\s*[:.\-–—)]\s*|\s+(?=\S))", re.I)
# Frequent words that tell languages in Latin letters apart.
_WORDS = {
    "en": set("the of to and a in is are be for with on at by may must not from students student after before this that your you can or than if when until no how what".split()),
    "fr": set("le la les des du de un une est sont et à au aux avec pour par pas que qui dans doit doivent chaque avant après sans cours plus être ne sur en ce".split()),
    "es": set("el la los las de del un una es son y a con para por no que en se debe deben antes después sin cada más al su como hay".split()),
    "de": set("der die das und ist sind ein eine nicht mit für auf dem den vor nach muss müssen darf kann wird werden bei ersten jeder ohne oder zu im zum zur".split()),
    "it": set("il lo gli della delle nel alla sono deve devono dopo prima senza ogni anche essere".split()),
    "pt": set("os uma não são deve devem antes depois sem cada mais até pelo pela dos das".split()),
    "nl": set("het een niet van voor naar moet moeten zijn worden elke zonder ook bij dit".split()),
    "vi": set("và của là được các cho không phải có trong trước sau một những với này sẽ học sinh viên kỳ tối đa ngày tháng nộp vào bản thì dưới mỗi".split()),
}
_PAREN = re.compile(r"[(（\[【][^()（）\[\]【】]*[)）\]】]")
_CODE = re.compile(r"\b[A-Za-z]{1,5}[-_]?\d[\w-]*|\b[A-Z][A-Z/&.-]{0,6}\b")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[^\s마보]다)\s+(?=\S)|\n+")
_ENDED = re.compile(r"(?:[^.…\s][.!?。！？][\"'”’)\]]*|다|요|까|오|함|음)$")
_TAIL_NOTE = re.compile(r"(?<=[다요까.!?])\s*[(（\[][^()（）\[\]]{1,60}[)）\]]\s*$")
_CUT = re.compile(r"[\s.…,;:\-–—~·]+$")


_NO_KEY = re.compile(r"[\W_]+")


def key_of(text: str | None) -> str:
    """Letters and digits of ``text`` in compatibility form without case."""
    if not text:
        return ""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _NO_KEY.sub("", text.casefold())


def is_empty(text: str | None) -> bool:
    return not any(c.isalnum() for c in text or "")


def is_refusal(text: str) -> bool:
    plain = unicodedata.normalize("NFKC", text).replace("’", "'")
    if _REFUSAL.search(plain):
        return True
    if len(plain) > 160 or any(c.isdigit() for c in plain):
        return False
    for sentence in re.split(r"(?<=[.!?;])\s+", plain):
        said = key_of(sentence)
        letters = Counter(said)
        for known, bag in _DECLINE_KEYS:
            # no more can be common than letters are
            if sum((letters & bag).values()) < 0.85 * len(known):
                continue
            if 0.7 <= len(said) / len(known) <= 1.9:
                blocks = SequenceMatcher(None, known, said, False).get_matching_blocks()
                if sum(b.size for b in blocks) >= 0.85 * len(known):
                    return True
    return False


_DECLINE_KEYS = [(key_of(s), Counter(key_of(s))) for s in _DECLINES]


def is_copy(question: str | None, answer: str, evidence: _Evidence) -> bool:
    """Nothing but the question: labelled, re-punctuated, repeated or lightly edited."""
    asked, said = key_of(question), key_of(_LABEL.sub("", unicodedata.normalize("NFKC", answer).strip(" \"'“”‘’[]()<>「」\n\t")))
    if len(asked) < 4 or not said:
        return False
    if len(said) % len(asked) == 0 and said == asked * (len(said) // len(asked)):
        return True
    if len(said) >= 8 and said in asked and 2 * len(said) >= len(asked) and not any(said in e for e in evidence.keys):
        return True
    if key_of(answer) == asked:
        return True
    for times in {1, max(1, round(len(said) / len(asked)))}:
        whole = asked * times
        if not 0.75 <= len(said) / len(whole) <= 1.25:
            continue
        blocks = [b for b in SequenceMatcher(None, whole, said, False).get_matching_blocks() if b.size > 1]
        same = sum(b.size for b in blocks)
        # what is added must lie inside, not after: a real answer may follow the question
        if blocks and same >= 0.85 * max(len(said), len(whole)) and blocks[-1].b + blocks[-1].size >= len(said) - 2:
            return True
    return False


# Blocks of scripts that stand for a language here.
_SCRIPTS = (("el", "\u0370", "\u03ff"), ("ru", "\u0400", "\u052f"), ("hy", "\u0530", "\u058f"), ("he", "\u0590", "\u05ff"), ("ar", "\u0600", "\u06ff"), ("hi", "\u0900", "\u097f"), ("bn", "\u0980", "\u09ff"),
            ("ta", "\u0b80", "\u0bff"), ("th", "\u0e00", "\u0e7f"), ("ka", "\u10a0", "\u10ff"), ("km", "\u1780", "\u17ff"))


def _script(c: str) -> str | None:
    return next((lang for lang, first, last in _SCRIPTS if first <= c <= last), None) if c > "\u036f" else None


_OTHER_SCRIPTS = re.compile("[" + "".join(f"{first}-{last}" for _, first, last in _SCRIPTS) + "]")
_COUNTED = {"ko": re.compile("[가-힣]"), "kana": re.compile("[\u3040-\u30ff]"), "han": re.compile("[一-鿿]"), "latin": re.compile("(?![가-힣\u3040-\u30ff一-鿿])[^\\W\\d_]")}


def language_of(text: str | None) -> str | None:
    """ko, ja, zh, vi, fr, es or en; None if names and abbreviations are all there is."""
    plain = _CODE.sub(" ", _PAREN.sub(" ", unicodedata.normalize("NFKC", text or "")))
    counts = {name: len(pattern.findall(plain)) for name, pattern in _COUNTED.items()}
    weight = counts["ko"] * 3 + counts["kana"] * 3 + counts["han"] * 3
    if _OTHER_SCRIPTS.search(plain):
        other = Counter(script for c in plain if (script := _script(c)))
        foreign = sum(other.values())
        counts["latin"] -= foreign
        if foreign > weight + counts["latin"]:
            return other.most_common(1)[0][0]
    total = weight + counts["latin"]
    if not total:
        return None
    if counts["ko"] * 3 >= 0.5 * total:
        return "ko"
    if (counts["kana"] + counts["han"]) * 3 >= 0.5 * total:
        return "ja" if counts["kana"] else "zh"
    words = re.findall(r"[^\W\d_]+", plain)
    scores = {lang: sum(w.casefold() in known for w in words) for lang, known in _WORDS.items()}
    if re.search("[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]", plain, re.I):
        scores["vi"] += 3
    best = max(scores, key=lambda k: (scores[k], k == "en"))
    return best if scores[best] else None


def is_other_language(question: str | None, answer: str) -> bool:
    asked, said = language_of(question), language_of(answer)
    if not asked or not said or asked == said:
        return False
    plain = _CODE.sub(" ", _PAREN.sub(" ", answer))
    if said in {"ja", "zh"}:
        return sum("぀" <= c <= "鿿" for c in plain) >= 4
    return len(re.findall(r"[^\W\d_]+", plain)) >= 3


class _Evidence:
    """Sentences of a record's evidence as sorted keys with their ends."""

    def __init__(self, quotes: list[str | None]):
        self.quotes = quotes

    @cached_property
    def keys(self) -> list[str]:
        return [key_of(q) for q in self.quotes if q]

    @cached_property
    def starts(self) -> list[tuple[str, list[int]]]:
        """(text from a sentence to its quote's end, ends of the sentences in it), sorted."""
        out: list[tuple[str, list[int]]] = []
        for quote in self.quotes:
            keys = [k for k in (key_of(s) for s in _SENTENCE.split(quote or "")) if k]
            for i in range(len(keys)):
                ends, total = [], 0
                for k in keys[i:]:
                    total += len(k)
                    ends.append(total)
                out.append(("".join(keys[i:]), ends))
        return sorted(out)

    def shortened(self, answer: str, near: float, state: str | None = "inside") -> bool:
        """The answer begins with a sentence and ends inside one.

        ``state``: what the sorted neighbours say of the answer's last piece, inside a
        sentence, a whole one, or neither; only the first can break off without an edit.
        """
        answer = _TAIL_NOTE.sub("", answer)
        if _ENDED.search(answer.rstrip()) and not answer.rstrip().endswith(("..", "…")):
            return False
        cut = _CUT.sub("", answer)
        if re.search(r"[^\s마보]다$|니다$", cut):
            return False
        said = key_of(cut)
        if len(said) < SHORTEST_CUT:
            return False
        if state == "whole":
            return False
        at = bisect_right(self.starts, said, key=lambda x: x[0])
        if at < len(self.starts) and self.starts[at][0].startswith(said):
            return state == "inside" and len(said) not in self.starts[at][1]
        if at and self.starts[at - 1][0] == said or any(said in k for k in self.keys):
            return False  # whole sentences, or a value from inside one
        if len(said) < 3 * SHORTEST_CUT:
            return False
        best = 0.0
        for text, ends in self.starts:
            window = text[: len(said) + max(4, len(said) // 8)]
            if len(window) <= len(said) * 0.8:
                continue
            matcher = SequenceMatcher(None, window, said, False)
            if matcher.quick_ratio() < near - 0.1:
                continue
            blocks = [b for b in matcher.get_matching_blocks() if b.size]
            same = sum(b.size for b in blocks)
            score = same / len(said)
            if score >= near and score > best and blocks[0].b <= 3:
                best = score
                stop = blocks[-1].a + blocks[-1].size
                # the alignment's end must lie clearly before the end of its sentence
                rest = min((e - stop for e in ends if e >= stop - 1), default=0)
                verdict = rest >= 3
        return best > 0 and verdict


def defect_of(question: str | None, answer: str | None, quotes: list[str | None], near: float = NEAR, state: str | None = "inside") -> str | None:
    """The first defect of the pair, or None for a sound one."""
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    evidence = _Evidence(quotes)
    if is_copy(question, answer, evidence):
        return "copied"
    if is_other_language(question, answer):
        return "other_language"
    return "truncated" if evidence.shortened(answer, near, state) else None


def length_spikes(rows: DataFrame) -> DataFrame:
    """(n): lengths at which unended responses pile up, from counts of all rows."""
    counts = (
        rows.where(~F.coalesce(F.col("answer").rlike(r"[.!?。다요][\"')\]]*\s*$"), F.lit(True)))
        .groupBy(F.length("answer").alias("n"))
        .agg(F.count("*").alias("rows"))
    )
    # the window runs over one row for each distinct length, split into blocks of lengths
    blocks = counts.withColumn("block", F.explode(F.array(F.expr("n div 1000"), F.expr(f"(n + {SPIKE_WINDOW}) div 1000"))))
    near = Window.partitionBy("block").orderBy("n").rangeBetween(-SPIKE_WINDOW, SPIKE_WINDOW)
    around = (F.sum("rows").over(near) - F.col("rows")) / (2 * SPIKE_WINDOW)
    return blocks.withColumn("around", around).where((F.col("rows") >= SPIKE_LEAST) & (F.col("rows") > SPIKE_TIMES * F.col("around"))).select("n").distinct()


def pair_rows(qa: DataFrame) -> DataFrame:
    """(conversation_id, question, answer, quotes) of each record."""
    messages = F.col("messages")
    size = F.coalesce(F.size(messages), F.lit(0))
    question = F.when(size >= 2, F.get(messages, size - 2)["content"])
    return qa.select("conversation_id", question.alias("question"), F.col("reference_answer").alias("answer"), F.col("evidence.quote").alias("quotes"))


# The same sentences and keys as in Python, for the sort in the JVM.
_SENTENCE_JAVA = r"(?<=[.!?。！？])\s+|(?<=[^\s마보]다)\s+(?=\S)|\n+"
_KEY_JAVA = r"[^\p{L}\p{N}]+"


def _key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, _KEY_JAVA, ""))


def with_piece(rows: DataFrame) -> DataFrame:
    """Rows with ``piece``: the key of the last sentence of an unended answer, else null."""
    bare = F.regexp_replace(F.regexp_replace("answer", r"(?<=[다요까.!?])\s*[(（\[][^()（）\[\]]{1,60}[)）\]]\s*$", ""), r"[\s.…,;:\-–—~·]+$", "")
    last = F.element_at(F.split(bare, _SENTENCE_JAVA), -1)
    ended = F.col("answer").rlike(r"[^.…\s][.!?。！？][\"'”’)\]]*\s*$")
    piece = _key(last)
    return rows.withColumn("piece", F.when(~F.coalesce(ended, F.lit(True)) & (F.length(piece) >= SHORTEST_CUT), piece))


def sentence_keys(rows: DataFrame) -> DataFrame:
    """(key): keys of all sentences of the evidence."""
    quotes = rows.select(F.explode("quotes").alias("quote")).where("quote is not null")
    return quotes.select(F.explode(F.split("quote", _SENTENCE_JAVA)).alias("sentence")).select(_key(F.col("sentence")).alias("key")).where("key != ''")


def shortened_pieces(rows: DataFrame) -> DataFrame:
    """(piece, state) of rows (.., piece, quotes): pieces that some sentence begins with (inside) or equals (whole).

    Pieces and sentences are sorted together, in ranges between splitters that are
    sentences of a hashed sample: if a piece and the sentence after it lie in two ranges,
    the splitter between them begins with the piece too. The splitters only decide how
    the work is spread.
    """
    spark = rows.sparkSession
    total = rows.count()
    wanted = min(RANGES, total * 5 // RANGE_KEYS)
    splitters: list[str] = []
    if wanted:
        part = max(1, total // (20 * wanted))
        sample = sentence_keys(rows.where(F.pmod(F.xxhash64("conversation_id"), F.lit(part)) == 0)).distinct().orderBy(F.xxhash64("key")).limit(20 * wanted).toArrow().column(0).to_pylist()
        sample.sort()
        splitters = sample[:: max(1, len(sample) // wanted)]
    shared = spark.sparkContext.broadcast(splitters)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at = [bisect_right(known, k) for k in batch.column(0).to_pylist()]
            following = [known[i] if i < len(known) else None for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(following, pa.string())], names=["key", "sentence", "range", "following"])

    pieces = rows.select(F.col("piece").alias("key")).where("key is not null").distinct().withColumn("sentence", F.lit(False))
    both = sentence_keys(rows).distinct().withColumn("sentence", F.lit(True)).unionByName(pieces)
    placed = both.mapInArrow(place, "key string, sentence boolean, range int, following string")
    # from the end of a range backwards, the last sentence seen is the next neighbour
    order = Window.partitionBy("range").orderBy(F.desc("key"), F.desc("sentence")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = placed.withColumn("next", F.last(F.when(F.col("sentence"), F.col("key")), ignorenulls=True).over(order)).where(~F.col("sentence"))
    after = after.withColumn("next", F.coalesce("next", "following")).where(F.expr("startswith(next, key)"))
    return after.select(F.col("key").alias("piece"), F.when(F.col("next") == F.col("key"), "whole").otherwise("inside").alias("state"))


def broken_pairs(qa: DataFrame) -> DataFrame:
    """(conversation_id, defect): each broken pair with its first defect."""
    rows = pair_rows(qa)
    spikes = length_spikes(rows).withColumn("spike", F.lit(True))
    # at most one length in SPIKE_WINDOW can be a spike of lengths that exist
    rows = rows.withColumn("n", F.length("answer")).join(spikes, "n", "left") if spikes.limit(1).count() else rows.withColumn("spike", F.lit(None).cast("boolean"))
    rows = with_piece(rows.select("conversation_id", "question", "answer", "quotes", "spike"))
    states = materialise(shortened_pieces(rows), "pair-pieces")
    few = states.limit(BROADCAST_KEY_LIMIT + 1).count() <= BROADCAST_KEY_LIMIT
    rows = rows.join(F.broadcast(states) if few else states, "piece", "left").select("conversation_id", "question", "answer", "quotes", "spike", "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, defects = [], []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                defect = defect_of(row[1], row[2], row[3] or [], NEAR_AT_SPIKE if row[4] else NEAR, row[5])
                if defect:
                    keys.append(row[0])
                    defects.append(defect)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(defects, pa.string())], names=["conversation_id", "defect"])

    return rows.mapInArrow(run, "conversation_id string, defect string").distinct()
