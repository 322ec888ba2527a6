"""Canonical pages, and the question pipeline with stand-in models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tripleloom.operators import graph, pages
from tripleloom.plans.ask import QuestionAnswering
from tripleloom.sparql.compile import TRIPLES
from tripleloom.sparql.gate import Draft


def test_blocks_and_context(spark):
    rows = [(1, "paragraph", 10, 0, 90, 10, "가"), (1, "paragraph", 12, 15, 95, 25, "나"), (1, "paragraph", 10, 60, 90, 70, "다"), (1, "footer", 0, 900, 10, 910, "7"), (1, "note", 10, 210, 50, 220, "※")]
    merged = pages.merge_blocks(spark.createDataFrame(rows, "page int, kind string, x0 int, y0 int, x1 int, y1 int, text string"))
    assert [r["text"] for r in merged.orderBy("block").collect()] == ["가 나", "다", "※", "7"]
    table = spark.createDataFrame([("t", 1, 100, 200)], "table_id string, page int, y0 int, y1 int")
    row = pages.table_context(table, merged).first()
    assert row["before"] == ["가 나", "다"] and row["after"] == ["※"]


def test_rendering_and_checks(spark):
    items = [(1, 0, 0, "heading", "표 하나", None, True), (1, 5, 0, "paragraph", "글", None, True), (1, 9, 0, "table", "| a |", "표 하나", False)]
    df = spark.createDataFrame(items, "page int, y0 int, x0 int, kind string, text string, title string, accepted boolean")
    assert pages.render_page(df).first()["markdown"] == "글\n\n### 표 하나\n\n⚠️ | a |"
    check = spark.createDataFrame([("3학점 과목 새말", "3학점 과목 옛말")], "m string, s string").select(pages.restoration_check(F.col("m"), F.col("s")).alias("c")).first()["c"]
    assert check["unsupported_numbers"] == [] and check["unsupported_words"] == ["새말"] and check["word_coverage"] == pytest.approx(0.666667)
    assert pages.align_table(["| a | b |", "| --- | :--- |", "| 1 |"], 3, [2, 1]) == ["| a |  | b |", "| --- | --- | --- |", "| 1 |  |  |"]
    assert pages.table_width_issues("| a | b |\n| --- | --- |\n| 1 |\n| 1 | 2 |") == [3]
    tokens = spark.createDataFrame([(1, 0.99, True), (1, 0.5, True), (2, 0.95, True)], "page int, confidence double, matched boolean")
    assert {r["page"]: r["status"] for r in pages.page_summary(tokens).collect()} == {1: "needs_review", 2: "verified"}
    assert tuple(pages.document_counts(spark.createDataFrame([("d", "failed"), ("d", "generated")], "document string, status string")).first()) == ("d", 1, 0, 0, 1)


NS = {"h": "urn:h:"}
K = "urn:query-term:dept"
GOOD = Draft(f"PREFIX h: <urn:h:> SELECT ?c ?sourcePage WHERE {{ ?r h:of <{K}> ; h:credits ?c ; h:page ?sourcePage }}", {K: ("해양정책학과", None)})


@pytest.fixture(scope="module")
def rules(spark):
    rows = [("urn:r:d1", graph.PREF, "literal", "해양정책학과"), ("urn:h:1", "urn:h:of", "iri", "urn:r:d1"), ("urn:h:1", "urn:h:credits", "literal", "130"), ("urn:h:1", "urn:h:page", "iri", "urn:page:page-001")]
    rows += [("urn:h:2", "urn:h:of", "iri", "urn:r:d2"), ("urn:r:d2", graph.PREF, "literal", "도시경영학과"), ("urn:r:d3", graph.PREF, "literal", "도시경영학부")]
    return spark.createDataFrame([(*r, "", "", "x") for r in rows], TRIPLES)


def pipeline(rules, draft=None, choose=None, answer=None):
    return QuestionAnswering(rules, NS, draft or (lambda *_: GOOD), choose or (lambda *_: []), answer or (lambda *_: ("130학점이다.", [1], False)), resource_root="urn:r:")


def test_answered(rules):
    t = pipeline(rules).ask("몇 학점인가요?")
    assert (t.status, t.cited, t.pages, t.executions) == ("answered", [0], ["page-001"], 1)


def test_other_ends(rules):
    seen = []
    bad = Draft("PREFIX h: <urn:h:> SELECT ?x WHERE { ?x h:madeUp ?y }")
    t = pipeline(rules, draft=lambda q, c, feedback: seen.append(feedback) or bad).ask("?")
    assert t.status == "query_generation_failed" and len(seen) == 2 and "madeUp" in seen[1][0]
    loose = Draft(GOOD.sparql, {K: ("도시경영", None)})
    assert pipeline(rules, draft=lambda *_: loose).ask("?").status == "term_unresolved"
    t = pipeline(rules, draft=lambda *_: loose, choose=lambda p, o: [(K, "urn:r:d2", 0.9)]).ask("?")
    assert t.status == "no_result" and t.executions == 1
    assert pipeline(rules, draft=lambda *_: loose, choose=lambda p, o: [(K, "urn:r:d2", 0.4)]).ask("?").status == "term_unresolved"
    assert pipeline(rules, answer=lambda *_: ("x", [9], False)).ask("?").status == "answer_generation_failed"
    assert pipeline(rules, answer=lambda *_: ("정보가 없다.", [], True)).ask("?").status == "no_result"
