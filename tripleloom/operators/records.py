"""Validation and selection of question-answer records.

records: (conversation_id, topic, question_type, dialogue_mode, style_source_ids,
messages, query_ir, reference_answer, evidence, ..) as the pipeline writes them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from tripleloom.functions.text import SPACE, n5, n6, number_tokens, short_hash
from tripleloom.session import BROADCAST_KEY_LIMIT

CONTEXTUAL = ("contextual_followup", "user_correction", "clarification", "confirmation")
MODE_WEIGHTS = {"standalone": 6}


# Types of questions, traces of the parser's review, the one clarifying question and signs of a correction.
QUESTION_TYPES = (
    "direct_fact", "deadline", "time_range", "eligibility", "procedure", "yes_no", "min_max", "prerequisite", "exception", "restriction", "comparison", "condition_chain", "ordering",
    "negative_question", "consequence", "what_if", "list", "clarification", "contextual_followup", "user_correction", "confirmation",
)
METADATA = r"(?i)검수\s*필요|자동\s*승인|OCR|마크다운"
CLARIFYING = "어떤 조건을 기준으로 확인할까요?"
CORRECTION = "아니|정정|잘못|다시|제가 말한"
#: Numbers that an answer may name without evidence.
FREE_NUMBERS = ("2", "2026")


def conversation_issues(records: DataFrame, known_types: tuple[str, ...] | None = None, known_styles: Column | None = None, foreign: str | None = None, locator: str | None = None) -> DataFrame:
    """(conversation_id, issues): the broken rules of each record, in order.

    ``known_types`` and ``known_styles`` (an array) are not checked if absent, nor are
    ``foreign``, a pattern of what must not leak into a text, and ``locator``, the
    pattern of an evidence's locator. If the records have a column ``context``, quotes
    must stand in it.
    """
    m = F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>"))
    n = F.size(m)
    roles = F.transform(m, lambda x: x.role)
    text_of = lambda xs: F.array_join(F.transform(xs, lambda x: F.coalesce(x.content, F.lit(""))), " ")
    content = lambda i: F.coalesce(F.get(m, i).content, F.lit(""))
    answer = F.coalesce("reference_answer", F.lit(""))
    plain_answer, plain_last = n5(answer), n5(content(n - 1))
    same_side = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(roles, i) == F.get(roles, i - 1))
    everything = F.concat(text_of(m), F.lit(" "), answer)
    e = F.coalesce("evidence", F.array().cast("array<struct<source_unit_id:string,locator:string,quote:string>>"))
    evidence = F.array_join(F.transform(e, lambda x: F.coalesce(x.quote, F.lit(""))), " ")
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"([0-9]+)"), 1)
    loose = F.array_except(F.array_except(numbers(answer), numbers(evidence)), F.array(*[F.lit(x) for x in FREE_NUMBERS]))
    asked = text_of(F.filter(m, lambda x: x.role == "user"))
    later = text_of(F.filter(F.slice(m, 3, F.greatest(n, F.lit(1))), lambda x: x.role == "user"))
    years = F.regexp_extract_all(asked, F.lit(r"저는\s*(\d)\s*학년"), 1)
    mode, kind = F.coalesce("dialogue_mode", F.lit("standalone")), F.coalesce("question_type", F.lit(""))
    contextual = mode.isin(*CONTEXTUAL)
    never = F.lit(False)
    styles = F.coalesce("style_source_ids", F.array().cast("array<string>"))
    context = n5(F.col("context")) if "context" in records.columns else None
    rules = [
        (~kind.isin(*known_types) if known_types else never, "question type"),
        ((F.size(styles) < 1) | (F.size(F.array_except(styles, known_styles)) > 0 if known_styles is not None else never), "style ids"),
        (n < 2, "fewer than two messages"),
        ((n >= 2) & ~((F.get(roles, F.lit(0)) == "user") & (F.get(roles, n - 1) == "assistant")), "first and last role"),
        ((n >= 2) & same_side, "roles do not alternate"),
        ((n >= 1) & ((plain_answer == "") | (plain_last == "") | ~(F.contains(plain_last, plain_answer) | F.contains(plain_answer, plain_last))), "answer and last message"),
        (everything.rlike(foreign) if foreign else never, "foreign content"),
        (everything.rlike("[¿¡]"), "foreign marks"),
        (everything.rlike(METADATA), "review metadata"),
        ((mode == "standalone") & (n != 2), "standalone length"),
        ((mode == "standalone") & kind.isin(*CONTEXTUAL), "standalone with a contextual type"),
        (contextual & (n < 4), "contextual length"),
        (contextual & (kind != mode), "mode and type differ"),
        (~contextual & (mode != "standalone"), "unknown mode"),
        ((mode == "clarification") & (n >= 2) & ~F.contains(content(F.lit(1)), F.lit("?")), "clarification asks nothing"),
        ((mode == "clarification") & (n >= 2) & (content(F.lit(1)) != CLARIFYING), "clarification in other words"),
        (contextual & (mode != "clarification") & (n >= 2) & (n5(content(F.lit(1))) != plain_answer), "intermediate answer"),
        ((mode == "user_correction") & ~later.rlike(CORRECTION), "no correction"),
        (F.col("query_ir").isNull() | F.col("query_ir.intent").isNull() | F.col("query_ir.subject").isNull() | F.col("query_ir.constraints").isNull() | F.col("query_ir.requested_fields").isNull(), "query ir"),
        (F.size(e) < 1, "no evidence"),
        (F.exists(e, lambda x: (F.trim(F.coalesce(x.quote, F.lit(""))) == "") | ~F.contains(context, F.regexp_replace(x.quote, SPACE + "+", ""))) if context is not None else never, "quote not in the context"),
        (F.exists(e, lambda x: ~F.coalesce(x.locator, F.lit("")).rlike(locator)) if locator else never, "evidence locator"),
        ((F.trim(answer) != "") & ~F.contains(n5(evidence), plain_answer), "answer not in the evidence"),
        (F.size(loose) > 0, "unsupported numbers"),
        (F.trim(answer).startswith("아니요") & answer.rlike("(?<!불)가능"), "negative but possible"),
        ((F.size(years) > 0) & ~F.coalesce(F.regexp(answer, F.concat(F.element_at(years, -1), F.lit(r"\s*학년"))), F.lit(True)), "stated school year"),
    ]
    return records.select("conversation_id", F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules])).alias("issues"))


def fingerprints(records: DataFrame) -> DataFrame:
    """(conversation_id, question, query, bundle): short hashes for distinctness.

    Of the last user message; of the query as JSON with sorted keys; of the evidence ids,
    an id that is missing being the hash of locator and quote.
    """
    m = F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>"))
    asked = F.coalesce(F.element_at(F.filter(m, lambda x: x.role == "user"), -1).content, F.lit(""))
    text = lambda c: F.coalesce(F.expr("substring(to_json(array({0})), 2, length(to_json(array({0}))) - 2)".format(c)), F.lit("null"))
    pair = lambda x: F.concat(F.to_json(F.array(x.key)).substr(F.lit(2), F.length(F.to_json(F.array(x.key))) - 2), F.lit(":"), F.to_json(F.array(x.value)).substr(F.lit(2), F.length(F.to_json(F.array(x.value))) - 2))
    constraints = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries("query_ir.constraints")), pair), ","), F.lit("}"))
    query = F.concat(
        F.lit('{"constraints":'), F.coalesce(constraints, F.lit("null")), F.lit(',"intent":'), text("query_ir.intent"),
        F.lit(',"requested_fields":'), F.coalesce(F.to_json("query_ir.requested_fields"), F.lit("null")), F.lit(',"subject":'), text("query_ir.subject"), F.lit("}"),
    )
    squeezed = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", ""))
    ids = F.transform(F.coalesce("evidence", F.array().cast("array<struct<source_unit_id:string,locator:string,quote:string>>")), lambda x: F.coalesce(F.nullif(F.trim(x.source_unit_id), F.lit("")), short_hash(F.concat(squeezed(x.locator), F.lit("\n"), squeezed(x.quote)), 16)))
    return records.select("conversation_id", short_hash(n6(asked), 16).alias("question"), short_hash(F.lower(n5(query)), 16).alias("query"), short_hash(F.array_join(F.array_sort(ids), "\n"), 16).alias("bundle"))


def repeated_flags(prints: DataFrame, order: str = "conversation_id") -> DataFrame:
    """(conversation_id, repeated): all but the first of equal questions."""
    place = F.row_number().over(Window.partitionBy("question").orderBy(order))
    return prints.select("conversation_id", (place > 1).alias("repeated"))


def flattened_messages(records: DataFrame) -> DataFrame:
    """(conversation_id, turn, role, content)."""
    return records.select("conversation_id", F.posexplode("messages").alias("turn", "m")).select("conversation_id", "turn", "m.role", "m.content")


def issue_histogram(issues: DataFrame, top: int = 8) -> DataFrame:
    """(issue, n): the commonest issues."""
    return issues.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(top)


def type_coverage(records: DataFrame) -> DataFrame:
    """(question_type, n)."""
    return records.groupBy("question_type").agg(F.count("*").alias("n"))


def fact_distinct(records: DataFrame, wanted: int) -> list[str]:
    """Conversation ids of a greedy selection in which no question, query or evidence bundle comes twice.

    records: (conversation_id, passed, issues INT, mode, question_type, round, question,
    query, bundle). The candidates are first reduced in parallel to the best of each
    (question, query, bundle, mode, question_type); the fold itself is sequential by definition.
    """
    # records of one question, query, bundle, mode and type can only stand in for each other
    rank = Window.partitionBy("question", "query", "bundle", "mode", "question_type").orderBy("issues", "round", "conversation_id")
    best = records.where("passed").withColumn("place", F.row_number().over(rank)).where("place = 1").drop("place")
    pdf = best.select("conversation_id", "issues", "mode", "question_type", "round", "question", "query", "bundle").toPandas()
    used: set[tuple[str, str]] = set()
    modes: dict[str, int] = {}
    types: dict[str, int] = {}
    out: list[str] = []
    rows = pdf.to_dict("records")
    while len(out) < wanted:
        open_rows = [r for r in rows if not any((k, r[k]) in used for k in ("question", "query", "bundle"))]
        if not open_rows:
            raise ValueError(f"only {len(out)} of {wanted} records are distinct")
        pick = min(open_rows, key=lambda r: (r["issues"] > 0, r["issues"], modes.get(r["mode"], 0) / MODE_WEIGHTS.get(r["mode"], 1), types.get(r["question_type"], 0), r["round"], r["conversation_id"]))
        out.append(pick["conversation_id"])
        used |= {(k, pick[k]) for k in ("question", "query", "bundle")}
        modes[pick["mode"]] = modes.get(pick["mode"], 0) + 1
        types[pick["question_type"]] = types.get(pick["question_type"], 0) + 1
        rows = open_rows
    return out


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text))


def _grams(text: str) -> set[str]:
    return {text} if len(text) <= 5 else {text[i : i + 5] for i in range(len(text) - 4)}


def _overlap(x: set[str], y: set[str]) -> bool:
    common = len(x & y)
    return common >= 0.72 * (len(x) + len(y) - common)


def _same_text(a: str, b: str) -> bool:
    x, y = _squeezed(a), _squeezed(b)
    return x in y or y in x or _overlap(_grams(x), _grams(y))


@pandas_udf(BooleanType())
def _same_texts(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _same_text(x, y) for x, y in zip(a, b, strict=True)], dtype="object")


def similar_evidence(pairs: DataFrame) -> DataFrame:
    """Pairs (locator_a, quote_a, locator_b, quote_b, ..) of evidence that says the same.

    If both have an id (columns id_a, id_b), equal ids alone count; else one locator and
    equality, containment or a five-character Jaccard of at least 0.72. Pairs are to be
    joined by locator or id first; null quotes say nothing.
    """
    with_ids = {"id_a", "id_b"} <= set(pairs.columns)
    known = F.col("id_a").isNotNull() & F.col("id_b").isNotNull() if with_ids else F.lit(False)
    near = pairs.where(~known & (F.col("locator_a") == F.col("locator_b"))).where(_same_texts("quote_a", "quote_b"))
    return near.unionByName(pairs.where(known & (F.col("id_a") == F.col("id_b")))) if with_ids else near


#: Quotes of one locator that one task compares; those of a larger one are split into parts of about this size.
QUOTE_BLOCK = 4096
#: Quotes that are hashed, or compared with all others, at once.
STRIP = 256


def _gram_bits(texts: list[str], bits: int) -> np.ndarray:
    """Of each text ``bits`` bits as words, those set that its runs of five characters hash to."""
    out = np.zeros((len(texts), bits // 64), np.uint64)
    for at in range(0, len(texts), STRIP):
        some = texts[at : at + STRIP]
        sizes = np.array([len(t) for t in some])
        codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(some)), sizes)
        start = np.flatnonzero(np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)) >= 5)
        code = np.zeros(len(start), np.uint64)
        for k in range(5):
            code = (code + codes[start + k]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        marks = np.zeros((len(some), bits), bool)
        marks[row[start], (code % np.uint64(bits)).astype(np.int64)] = True
        out[at : at + STRIP] = np.packbits(marks, axis=1).view(np.uint64)
    return out


def _candidates(texts: list[str], first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of places (one in ``first``, one in ``second``) whose texts may say the same; no pair that does is left out.

    Bits differ in no more places than sets of runs. A text within another has none of its
    own; at a Jaccard of 0.72 at most 0.28 / 1.72 of both sets' sizes differ.
    """
    sizes = np.array([max(len(t) - 4, 1) for t in texts])
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * sizes.mean())), 8, 12))
    words = _gram_bits(texts, bits)
    count = np.bitwise_count(words).sum(axis=1, dtype=np.int32)
    share = (sizes * 0.1628 + 0.5).astype(np.float32)
    same = first is second
    columns = np.ascontiguousarray(words[second].T)
    for at in range(0, len(first), STRIP):
        a, after = first[at : at + STRIP], at if same else 0
        b = second[after:]
        apart = np.zeros((len(a), len(b)), np.uint16)
        for k in range(bits // 64):
            apart += np.bitwise_count(words[a, k][:, None] ^ columns[k, after:])
        may = (apart <= share[a][:, None] + share[b]) | (apart == abs(count[a][:, None] - count[b]))
        for i, j in zip(*(x.tolist() for x in np.nonzero(may)), strict=True):
            if not same or i < j:
                yield a[i].item(), b[j].item()


def _similar_in(quotes: list[str], first: np.ndarray, second: np.ndarray) -> list[tuple[str, str]]:
    texts = [_squeezed(q) for q in quotes]
    grams: dict[int, set[str]] = {}
    out = []
    for i, j in _candidates(texts, first, second):
        x, y = texts[i], texts[j]
        if x not in y and y not in x:
            for k in (i, j):
                if k not in grams:
                    grams[k] = _grams(texts[k])
            if not _overlap(grams[i], grams[j]):
                continue
        out.append((min(quotes[i], quotes[j]), max(quotes[i], quotes[j])))
    return out


def similar_quotes(quotes: DataFrame, block: int = QUOTE_BLOCK) -> DataFrame:
    """(locator, quote_a, quote_b), ``quote_a`` the lesser: what ``similar_evidence`` keeps of the pairs of different quotes of one locator.

    The pairs are not built: a locator's quotes meet in one task, which compares hashed
    bits and reads the texts only of those that can pass. Quotes of a locator with more
    than ``block`` are split by hash, and every two parts meet.
    """
    kind = dict(quotes.dtypes)["locator"]
    rows = quotes.select("locator", "quote").where("locator is not null and quote is not null")
    large = rows.groupBy("locator").count().where(F.col("count") > block).select("locator", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    many = large.limit(BROADCAST_KEY_LIMIT + 1).count()
    rows = rows.distinct()
    if many:
        rows = rows.join(F.broadcast(large) if many <= BROADCAST_KEY_LIMIT else large, "locator", "left")
        parts = F.coalesce("parts", F.lit(1))
        rows = rows.select("locator", "quote", F.pmod(F.xxhash64("quote"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    else:
        rows = rows.withColumns({"part": F.lit(0), "other": F.lit(0)})
    rows = rows.select("locator", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "quote")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        locator, low, high = key
        part, texts = group["part"].to_numpy(), group["quote"].to_pylist()
        first = np.flatnonzero(part == low.as_py())
        second = first if low == high else np.flatnonzero(part == high.as_py())
        found = _similar_in(texts, first, second)
        columns = [pa.array([x[k] for x in found], pa.string()) for k in (0, 1)]
        return pa.table({"locator": pa.array([locator.as_py()] * len(found), group["locator"].type), "quote_a": columns[0], "quote_b": columns[1]})

    return rows.groupBy("locator", "low", "high").applyInArrow(run, f"locator {kind}, quote_a string, quote_b string")


def rotation(index: Column, names: list[str]) -> Column:
    """Styles, types or modes taken in turn."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(index, F.lit(len(names))) + 1).cast("int"))


def summary(records: pd.DataFrame) -> str:
    """A Markdown preview with counts."""
    lines = [f"# {len(records)} records", "", f"- question types: {records['question_type'].nunique()}"]
    lines += [f"- {mode}: {n}" for mode, n in records["dialogue_mode"].value_counts().sort_index().items()]
    return "\n".join(lines)


def unsupported_numbers(answer: Column, evidence: Column) -> Column:
    return F.array_except(number_tokens(answer), number_tokens(evidence))


def bundle_messages(bundles: DataFrame) -> DataFrame:
    """(bundle_id, turn, role, content): roles in turn from the user; forced assistant turns; the answer at the end.

    bundles: (bundle_id, mode, contents ARRAY<STRING>, answer). In a clarification the
    second turn is the one clarifying question, in another contextual mode the answer; a
    null answer forces nothing.
    """
    forced = F.when(F.col("mode") == "clarification", F.lit(CLARIFYING)).when(F.col("mode").isin(*CONTEXTUAL), F.col("answer"))
    said = F.transform("contents", lambda c, i: F.when((i == 1) & forced.isNotNull(), forced).otherwise(c))
    whole = F.concat(said, F.array("answer"))
    rows = bundles.select("bundle_id", F.posexplode(whole).alias("turn", "content"))
    return rows.select("bundle_id", "turn", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"), "content")


def finalised(records: DataFrame, order: str) -> DataFrame:
    """(record_id, duplicate, status) of records (order, text, json, issues): all but the first of equal texts are flagged."""
    place = F.row_number().over(Window.partitionBy(F.regexp_replace("text", SPACE + "+", "")).orderBy(order))
    duplicate = place > 1
    rows = records.select(F.substring(F.sha2("json", 256), 1, 16).alias("record_id"), duplicate.alias("duplicate"), F.size("issues").alias("n"))
    return rows.select("record_id", "duplicate", F.when(F.col("duplicate") | (F.col("n") > 0), "failed").otherwise("passed").alias("status"))


def coverage_summary(records: DataFrame, known: tuple[str, ...] = QUESTION_TYPES) -> DataFrame:
    """(types, least, most, missing): counts of the known question types."""
    counts = type_coverage(records.where(F.col("question_type").isin(*known)))
    out = counts.agg(F.count("*").alias("types"), F.min("n").alias("least"), F.max("n").alias("most"), F.collect_set("question_type").alias("seen"))
    return out.select("types", "least", "most", F.sort_array(F.array_except(F.array(*[F.lit(k) for k in known]), "seen")).alias("missing"))


def preview_counts(records: DataFrame) -> DataFrame:
    """(name, n): records, their distinct question types, queries and bundles, and the records of each mode.

    records: (question_type, dialogue_mode, query, bundle).
    """
    totals = records.agg(F.count("*").alias("records"), F.count_distinct("question_type").alias("question types"), F.count_distinct("query").alias("queries"), F.count_distinct("bundle").alias("bundles"))
    names = ("records", "question types", "queries", "bundles")
    first = totals.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("n")) for n in names])))
    return first.unionByName(records.groupBy(F.concat(F.lit("mode "), F.coalesce("dialogue_mode", F.lit(""))).alias("name")).agg(F.count("*").alias("n")))
