"""From mentions to terms, and from answers to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.text import multiset_cosine, n1, n2, ngrams
from tripleloom.operators.fuzzy import weighted
from tripleloom.operators.graph import SCHEMA_TYPES, class_closure, label_index
from tripleloom.sources.star import TYPE

LEAST_SCORE, TOP = 45.0, 5
CHOICE_SCORE, CHOICE_CONFIDENCE = 60.0, 0.70


def term_candidates(mentions: DataFrame, triples: DataFrame, top: int = TOP) -> DataFrame:
    """(mention_id, iri, label, score): the best labelled resources of each mention.

    mentions: (mention_id, mention, expected_type). The type filter, with the class
    hierarchy, comes before any score; each distinct pair of texts is scored once.
    """
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o_value").alias("cls"))
    schema = types.where(F.col("cls").isin(*SCHEMA_TYPES)).select("s").distinct()
    resources = label_index(triples).join(schema, "s", "left_anti").select("s", F.explode("labels").alias("label")).withColumn("key", n1(F.col("label")))
    above = types.join(class_closure(triples), "cls").select("s", F.col("ancestor").alias("expected_type"))
    wide = above.unionByName(types.select("s", F.col("cls").alias("expected_type"))).distinct()
    asked = mentions.withColumn("mention_key", n1(F.col("mention")))
    typed = asked.where("expected_type is not null").join(wide, "expected_type").join(resources, "s")
    free = asked.where("expected_type is null").crossJoin(resources)
    columns = ["mention_id", "mention_key", "s", "label", "key"]
    pairs = typed.select(columns).unionByName(free.select(columns))
    scored = pairs.withColumn("raw", weighted("mention_key", "key")).where(F.col("raw") >= LEAST_SCORE)
    best = scored.groupBy("mention_id", "s").agg(F.max(F.struct("raw", "label")).alias("m")).select("mention_id", F.col("s").alias("iri"), F.col("m.label").alias("label"), F.round("m.raw", 2).alias("score"))
    place = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "label", "iri"))
    return best.withColumn("place", place).where(F.col("place") <= top).drop("place")


def exact_resolutions(candidates: DataFrame) -> DataFrame:
    """(mention_id, iri): mentions of which exactly one candidate scores 100."""
    full = candidates.where("score = 100")
    return full.groupBy("mention_id").agg(F.count("*").alias("n"), F.first("iri").alias("iri")).where("n = 1").select("mention_id", "iri")


def admitted_choices(choices: DataFrame, candidates: DataFrame) -> DataFrame:
    """(mention_id, iri): a chosen term that is a candidate, close and sure enough, and chosen once.

    choices: (mention_id, iri, confidence).
    """
    once = choices.groupBy("mention_id").agg(F.count("*").alias("n"), F.first("iri").alias("iri"), F.first("confidence").alias("confidence")).where("n = 1")
    good = candidates.where(F.col("score") >= CHOICE_SCORE).select("mention_id", "iri")
    return once.where(F.col("confidence") >= CHOICE_CONFIDENCE).join(good, ["mention_id", "iri"], "left_semi").select("mention_id", "iri")


def repaired_citations(cited: Column, rows: Column) -> Column:
    """Row indices counted from 0; a list from 1 is shifted if only that fits."""
    one_based = F.forall(cited, lambda i: (i >= 1) & (i <= rows)) & F.exists(cited, lambda i: i >= rows)
    return F.when(one_based, F.transform(cited, lambda i: i - 1)).otherwise(cited)


# Phrases of an answer that has not enough evidence.
INSUFFICIENT = ("확인할 수 없", "판단할 수 없", "알 수 없", "포함되어 있지 않", "추가 확인")


def answer_issues(answer: Column, cited: Column, rows: Column, insufficient: Column) -> Column:
    """Issues of a grounded answer: rows cited that are not there, and words that deny its own flag."""
    phrase = answer.rlike("|".join(INSUFFICIENT))
    found = F.array(F.when(F.exists(cited, lambda i: (i < 0) | (i >= rows)), "citation out of range"), F.when(~insufficient & phrase, "answer says it is insufficient"))
    return F.array_compact(found)


def source_pages(cited_pages: Column) -> Column:
    """Last parts of the cited pages' names, in order of first sight."""
    return F.array_distinct(F.transform(F.filter(cited_pages, lambda p: p.isNotNull()), lambda p: F.element_at(F.split(p, ":"), -1)))


def few_shot(examples: DataFrame, text: str, limit: int = 4, required: str | None = None) -> DataFrame:
    """(place, example_id, category): the examples nearest to a text, and always the first without facts.

    examples: (example_id, category, text, at), ``at`` being their order. Only ``limit``
    rows leave the executors. The required category replaces the last if it is absent.
    """
    plain, asked = n2(F.col("text")), n2(F.lit(text))
    scored = examples.where("category != 'no_fact'").select("example_id", "category", multiset_cosine(ngrams(plain, 3), ngrams(asked, 3)).alias("score"))
    none = examples.where("category = 'no_fact'").orderBy("at").limit(1).select("example_id", "category").collect()
    best = scored.orderBy(F.desc("score"), "example_id")
    chosen = [(r["example_id"], r["category"]) for r in best.limit(max(0, limit - len(none))).collect()]
    if required and all(c != required for _, c in chosen):
        forced = [(r["example_id"], r["category"]) for r in best.where(F.col("category") == required).limit(1).collect()]
        chosen = chosen[: len(chosen) - len(forced)] + forced if chosen else forced
    rows = [(i, *r) for i, r in enumerate(chosen + [(r["example_id"], r["category"]) for r in none])]
    return examples.sparkSession.createDataFrame(rows, "place int, example_id string, category string")
