"""Core operators and sources on small fixtures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripleloom.functions import text as X
from tripleloom.operators import facts, fuzzy, graph, linking, reconcile, records, segments, tables, vectors
from tripleloom.session import one_row_per_key, rows_of_keys
from tripleloom.sources import files, turtle
from tripleloom.sparql.compile import TRIPLES


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


# ---- packages: the three package rules ----------------------------------------------------


@pytest.fixture
def package(tmp_path):
    (tmp_path / "pages").mkdir()
    for name, text in (("profile.ttl", "<urn:p> a <urn:C> ."), ("pages/page-001.ttl", "<urn:a> <urn:q> <urn:b> ."), ("pages/page-002.ttl", "<urn:b> <urn:q> 'x'@ko .")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    return tmp_path


def test_package_order_and_triples(spark, package):
    assert [f.stem for f in turtle.ontology_files(package)] == ["profile", "page-001", "page-002"]
    rows = turtle.read_package(spark, package).collect()
    assert len(rows) == 3 and {r["component"] for r in rows} == {"profile", "page-001", "page-002"}


def test_package_contiguity(package):
    (package / "pages/page-002.ttl").rename(package / "pages/page-003.ttl")
    with pytest.raises(turtle.TurtleError, match="contiguous"):
        turtle.ontology_files(package)


def test_package_foreign_file(package):
    (package / "published.ttl").write_text("", encoding="utf-8")
    with pytest.raises(turtle.TurtleError, match="Unexpected Turtle"):
        turtle.ontology_files(package)


def test_turtle_round_trip(spark):
    text = '@prefix e: <urn:e:> . e:a e:p "q\\"uo\\nte", \'\'\'long "x"\'\'\'@en ; a e:C . e:a e:n -5, 2.5, true ; e:b [ e:c e:d ] .'
    rows = turtle.parse_turtle(text)
    df = spark.createDataFrame(rows, TRIPLES)
    again = turtle.parse_turtle("\n".join(r["value"] for r in turtle.ntriples(df).collect()))
    assert {r[:6] for r in rows} == {r[:6] for r in again} and len(rows) == 8
    with pytest.raises(turtle.TurtleError):
        turtle.parse_turtle("x:y x:z x:w .")


# ---- text and scores ----------------------------------------------------------------------


def test_normalisers(spark):
    value = "  Ｈello　세계 | **굵게** ß_1 "
    got = {n: one(spark, f, value) for n, f in (("n1", X.n1), ("n2", X.n2), ("n3", X.n3), ("n4", X.n4), ("n5", X.n5), ("n6", X.n6), ("n7", X.n7), ("n8", X.n8), ("n9", X.n9))}
    assert got == {
        "n1": "hello세계굵게1", "n2": "ello세계굵게1", "n3": "Ｈello 세계 | **굵게** ß_1", "n4": "Ｈello세계굵게ß1", "n5": "Hello세계|**굵게**ß_1", "n6": "ello세계굵게ss1",
        "n7": "ｈello세계|**굵게**ß_1", "n8": "ｈello세계|**굵게**ss_1", "n9": "Ｈello세계|**굵게**ß_1",
    }


def test_ngrams_and_numbers(spark):
    assert one(spark, lambda c: X.ngrams(c, 3), "abcd") == ["abc", "bcd"]
    assert one(spark, lambda c: X.ngrams(c, 3), "ab") == ["ab"] and one(spark, lambda c: X.ngrams(c, 3), "") == []
    assert one(spark, X.number_tokens, "007 and 10, 0") == ["7", "10", "0"]
    row = spark.createDataFrame([(["a", "a", "b"], ["a", "c"], [1.0, 0.0], [1.0, 1.0], [1.0])], "x array<string>, y array<string>, u array<double>, v array<double>, w array<double>")
    out = row.select(X.multiset_cosine(F.col("x"), F.col("y")), X.jaccard(F.col("x"), F.col("y")), X.vector_cosine(F.col("u"), F.col("v")), X.vector_cosine(F.col("u"), F.col("w"))).first()
    assert [round(v, 6) for v in out] == [0.632456, 0.333333, 0.707107, 0.0]


def test_ratios():
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("abc", "") == 0 and fuzzy.ratio("abcd", "abxd") == 75
    assert fuzzy.weighted_ratio("", "a") == 0 and fuzzy.weighted_ratio("ab", "abc") == fuzzy.partial_ratio("ab", "abc") * 0.9
    assert fuzzy.weighted_ratio("abc", "abcd") == fuzzy.ratio("abc", "abcd") and fuzzy.weighted_ratio("a", "abcdefghij") == 60
    assert fuzzy.token_set_ratio("a b", "b a c") == 100 and fuzzy.token_set_ratio("", "a") == 0
    brute = lambda a, b: max(len([c for c in s]) for s in [""] + [x for x in _subsequences(a) if _is_sub(x, b)])
    assert fuzzy.common_length("banana", "ananas") == brute("banana", "ananas") == 5


def _subsequences(a):
    return {"".join(c for k, c in enumerate(a) if m >> k & 1) for m in range(1 << len(a))}


def _is_sub(x, b):
    at = iter(b)
    return all(c in at for c in x)


def test_stable_json(spark):
    row = spark.createDataFrame([('q"x', None)], "b string, a string").select(X.stable_json({"b": F.col("b"), "a": F.col("a")})).first()[0]
    assert row == '{"a":null,"b":"q\\"x"}'


# ---- graph ------------------------------------------------------------------------------------


def test_labels_prefer_hangul(spark):
    pref, alt = graph.PREF, graph.ALT
    rows = [("s", pref, "literal", " Name ", "", "", ""), ("s", alt, "literal", "이름 긴것", "", "", ""), ("s", alt, "literal", "이름", "", "", ""), ("s", alt, "literal", " ", "", "", "")]
    df = spark.createDataFrame(rows, TRIPLES)
    assert graph.representative_labels(df).first()["label"] == "이름"
    assert graph.label_index(df).first()["labels"] == ["Name", "이름", "이름 긴것"]


def test_closure_on_a_cycle(spark):
    rows = [(a, graph.SUBCLASS, "iri", b, "", "", "") for a, b in (("x", "y"), ("y", "x"), ("y", "z"))]
    got = {tuple(r) for r in graph.class_closure(spark.createDataFrame(rows, TRIPLES)).collect()}
    assert got == {(a, b) for a in "xy" for b in "xyz"} | {("z", "z")}


def test_pages_and_same_graph(spark):
    page = F.concat(F.lit("urn:page:"), F.substring("component", -3, 3))
    rows = [("s", "urn:sp", "iri", "urn:page:001", "", "", "page-001"), ("t", "urn:sp", "iri", "urn:page:002", "", "", "page-001"), ("urn:page:001", graph.TYPE, "iri", "urn:Page", "", "", "page-001"), ("u", "urn:x", "iri", "v", "", "", "page-002")]
    df = spark.createDataFrame(rows, TRIPLES)
    assert [r["s"] for r in graph.page_mismatches(df, "urn:sp", page).collect()] == ["t"]
    assert [r["component"] for r in graph.missing_pages(df, "urn:Page", page).collect()] == ["page-002"]
    assert graph.same_graph(df, df.unionByName(df)) and not graph.same_graph(df, df.limit(2))
    assert graph.implicit_classes(spark.createDataFrame([("새 것",), ("urn:x",), ("a",), (None,)], "label string"), spark.createDataFrame([("a",)], "label string")).count() == 1


def test_linking(spark):
    rows = [(f"urn:d{i}", graph.PREF, "literal", x, "", "", "") for i, x in enumerate(["해양정책학과", "해양통신공학과", "도시경영학과"])] + [(f"urn:d{i}", graph.TYPE, "iri", "urn:Dept", "", "", "") for i in range(2)]
    df = spark.createDataFrame(rows, TRIPLES)
    asked = spark.createDataFrame([(1, "해양 정책학과", "urn:Dept"), (2, "도시경영학과", "urn:Dept"), (3, "도시경영학과", None)], "mention_id long, mention string, expected_type string")
    found = linking.term_candidates(asked, df)
    top = {(r["mention_id"], r["iri"]): r["score"] for r in found.collect()}
    assert top[(1, "urn:d0")] == 100.0 and (2, "urn:d2") not in top and top[(3, "urn:d2")] == 100.0
    assert {tuple(r) for r in linking.exact_resolutions(found).collect()} == {(1, "urn:d0"), (3, "urn:d2")}
    choices = spark.createDataFrame([(1, "urn:d0", 0.9), (3, "urn:d2", 0.5), (2, "urn:nope", 0.99)], "mention_id long, iri string, confidence double")
    assert {tuple(r) for r in linking.admitted_choices(choices, found).collect()} == {(1, "urn:d0")}


def test_citations(spark):
    df = spark.createDataFrame([([1, 2], 2), ([1], 2), ([0, 1], 2), ([], 2)], "c array<int>, n int")
    assert [r[0] for r in df.select(linking.repaired_citations(F.col("c"), F.col("n"))).collect()] == [[0, 1], [1], [0, 1], []]
    pages = spark.createDataFrame([(["urn:p:page-2", None, "urn:q:page-1", "x:page-2"],)], "p array<string>")
    assert pages.select(linking.source_pages(F.col("p"))).first()[0] == ["page-2", "page-1"]
    issues = spark.createDataFrame([("자료로는 확인할 수 없습니다", [5], 2, False)], "a string, c array<int>, n int, i boolean")
    assert issues.select(linking.answer_issues(F.col("a"), F.col("c"), F.col("n"), F.col("i"))).first()[0] == ["citation out of range", "answer says it is insufficient"]


# ---- segments ------------------------------------------------------------------------------------


def test_markdown_segments(spark):
    pages = [("d", 1, "# 장\n\n글 하나\n\n| a \\| b | c |\n| --- | :---: |\n| 1 | 2 |"), ("d", 2, "|  |  |\n|---|---|\n| 3 | 4 |\n\n## 절\n끝")]
    rows = segments.segment_pages(spark.createDataFrame(pages, "document string, page int, text string")).orderBy("page", "line_start").collect()
    by = {r["locator"]: r for r in rows}
    assert by["page-001:block-0001"]["section_path"] == ["장"]
    assert by["page-002:table-01:row-0001"]["header"] == ["a \\| b", "c"]
    assert by["page-002:table-01:row-0000"]["continuation_of"] == "page-001:table-01"
    assert by["page-002:block-0001"]["section_path"] == ["장", "절"]
    with pytest.raises(ValueError, match="ragged"):
        list(segments.segment_document([(1, "| a | b |\n| --- | --- |\n| 1 |")]))
    assert segments.push_heading(["A"], 3, "C") == ["A", "", "C"]


def test_html_grid(spark):
    html = "<table><tr><th rowspan=2>A<th colspan=2>B&nbsp;C</tr><tr><td>1<td>2</tr><tr><td>x</table><table><tr><td><table><tr><td>in</table></table>"
    grids = segments.html_tables(html)
    assert grids[0] == [["A", "B C", "B C"], ["A", "1", "2"], ["x", "", ""]] and len(grids) == 3
    df = segments.table_grid(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert df.where("table_id = 0 and row = 1 and column = 2").first()["value"] == "2"
    assert segments.html_text("<p>a<br>b</p><script>x</script><style>y</style>c&nbsp;d") == "a\nb\nc d"


def test_selections(spark):
    df = spark.createDataFrame([("u", i, f"l{i}", "가" * 500, i == 0) for i in range(6)], "unit_id string, place int, locator string, quote string, header boolean")
    assert sorted((r["chunk"], len(r["locators"])) for r in segments.chunk_locators(df).collect()) == [(0, 2), (1, 2), (2, 2)]
    assert sorted(len(r["locators"]) for r in segments.row_batches(df).collect()) == [1, 1, 4]
    lines = spark.createDataFrame([(1, "a", "같은 문장이 두 번 나온다 그러면 그 가운데 하나만 남는다"), (2, "a", "같은 문장이  두 번 나온다 그러면 그 가운데 하나만 남는다"), (3, "b", "# 제목은 증거가 아니므로 빠지고 남지 않는다"), (4, "b", "짧다")], "place int, locator string, line string")
    assert segments.evidence_units(lines).count() == 1
    assert one(spark, segments.style_tags, "Hola, ¿cuándo puedo pedir una cita si no tengo plazo?") == ["greeting", "first_person", "time", "yes_no", "conditional", "explicit_question"]
    assert one(spark, segments.style_tags, "휴학") == ["fragment"] and one(spark, segments.style_tags, "휴학 신청은 다음 주") == ["fragment"] and one(spark, segments.style_tags, "휴학 신청은 다음 주 월요일에 합니다") == ["other"]


# ---- tables ------------------------------------------------------------------------------------------


def test_cells(spark):
    grid = [("t", 0, 0, True, False), ("t", 0, 1, False, True), ("t", 1, 0, False, False), ("t", 1, 1, False, False)]
    cells = tables.physical_cells(spark.createDataFrame(grid, "table_id string, row int, column int, joins_right boolean, joins_down boolean"))
    rows = {r["cell"]: r for r in cells.collect()}
    assert not rows[0]["rectangular"] and rows[1]["row"] == 1 and len(rows) == 2
    flat = spark.createDataFrame([("t", 0, 0, 0, 2, 1, True), ("t", 1, 0, 1, 1, 1, True), ("t", 2, 1, 1, 1, 1, True)], "table_id string, cell int, row int, column int, rowspan int, colspan int, rectangular boolean")
    texts = spark.createDataFrame([("t", 0, "위"), ("t", 1, "")], "table_id string, cell int, text string")
    modes = {(r["base_row"], r["base_column"]): r["mode"] for r in tables.materialised_rows(flat, texts).collect()}
    assert modes == {(0, 0): "direct", (1, 0): "rowspan_inheritance", (0, 1): "empty", (1, 1): "empty"}


def test_token_assignment(spark):
    tokens = spark.createDataFrame([(1, "t1", 10, 10, 20, 20, "a"), (1, "t2", 110, 10, 120, 20, "b"), (1, "t3", 500, 10, 520, 20, "c")], "page int, token_id string, x0 int, y0 int, x1 int, y1 int, text string")
    bands = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 200)], "page int, band int, low int, high int")
    got = {r["token_id"]: (r["base_row"], r["base_column"]) for r in tables.assign_tokens(tokens, bands, bands).collect()}
    assert got == {"t1": (0, 0), "t2": (0, 1)}


def test_values_and_links(spark):
    df = spark.createDataFrame([("3학점",), ("3 학점 이상",), ("미지정",), (" ",), ("월",)], "x string").select(tables.typed_value(F.col("x")).alias("v"))
    assert [(r["v"]["kind"], r["v"]["value_int"], r["v"]["comparator"]) for r in df.collect()] == [("integer", 3, "="), ("integer", 3, ">="), ("not_designated", None, None), ("empty", None, None), ("string", None, None)]
    t = spark.createDataFrame([("a", "d", 1, "제목", "s"), ("b", "d", 2, None, "s"), ("c", "d", 3, "", "s"), ("e", "d", 2, "x", "s")], "table_id string, document string, page int, title string, signature string")
    assert {tuple(r) for r in tables.continued_tables(t).collect()} == {("b", "a")}


# ---- facts ----------------------------------------------------------------------------------------------


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2031, 3, 3), "3월 3일", "2031년"), (dt.date(2031, 3, 3), "3월", "2031년"), (dt.date(2032, 2, 1), "2월 1일", "2031학년도"), (dt.date(2033, 2, 1), "2월 1일", "2031학년도")], "d date, q string, g string")
    assert [r[0] for r in df.select(facts.date_supported(F.col("d"), F.col("q"), F.col("g"))).collect()] == [True, False, True, False]
    year = spark.createDataFrame([(dt.date(2020, 9, 1), "2031학년도 2학기 학사일정"), (dt.date(2020, 2, 1), "2031학년도 2학기"), (dt.date(2020, 2, 1), "x")], "d date, g string")
    assert [r[0].year for r in year.select(facts.school_year(F.col("d"), F.col("g"))).collect()] == [2031, 2032, 2020]
    stamp = spark.createDataFrame([(dt.date(2031, 12, 31), 24, 0), (dt.date(2031, 1, 2), 9, 5), (dt.date(2031, 1, 2), 25, 0)], "d date, h int, m int")
    assert [r[0] for r in stamp.select(facts.local_stamp(F.col("d"), F.col("h"), F.col("m"))).collect()] == ["2032-01-01T00:00:00+09:00", "2031-01-02T09:05:00+09:00", None]
    cases = [
        ("3월 5일(목) 12:00 ~ 13월 9일 10:00", "2031학년도", ["2032-03-05T12:00:00+09:00"]), ("2031. 9. 1. 09:30", "", ["2031-09-01T09:30:00+09:00"]), ("9월 1일 10:00", "", []),
        ("9월 1일 10:00 - 24:00", "2031학년도 2학기", ["2031-09-01T10:00:00+09:00", "2031-09-02T00:00:00+09:00"]), ("2월 30일 10:00", "2031학년도", []), ("9월 1일 9시", "2031학년도", []),
    ]
    df = spark.createDataFrame([(q, g) for q, g, _ in cases], "q string, g string")
    assert [r[0] for r in df.select(facts.source_datetimes(F.col("q"), F.col("g"))).collect()] == [c for _, _, c in cases]
    typed = ["2031-09-01T10:00", "2031-09-01T24:00", "2031-09-01T10:00:00Z", "2031-09-01T10:00:05+09:00", "2031-9-1", "2031-02-30T10:00"]
    df = spark.createDataFrame([(t,) for t in typed], "t string")
    assert [r[0] for r in df.select(facts.normalised_datetime(F.col("t"))).collect()] == ["2031-09-01T10:00:00+09:00", "2031-09-02T00:00:00+09:00", None, "2031-09-01T10:00:05+09:00", None, None]


ENTITIES = "unit_id string, entity_id string, label string, identifier string, types array<string>"
FACTS = "unit_id string, fact_id int, subject string, predicate string, object_kind string, object_value string, locator string, quote string, grounding string, confidence double"


def test_fact_rules(spark):
    entities = spark.createDataFrame([("u", "e1", "학과", "X9", ["urn:C"]), ("u", "e2", "없는 것", None, ["urn:Z"]), ("u", "1x", "", None, [])], ENTITIES)
    rows = [
        ("u", 1, "e1", "urn:n", "integer", "5", "l", "5명", "5명", 1.0), ("u", 2, "e1", "urn:n", "integer", "5", "l", "5명", "5명", 1.0), ("u", 3, "e1", "urn:n", "integer", "6", "l", "5명", "5명", 2.0),
        ("u", 4, "e9", "urn:o", "entity", "e1", "l", "q", "g", 1.0), ("u", 5, "e1", "urn:o", "entity", "e1", "l", "q", "g", 1.0), ("u", 6, "e1", "urn:b", "boolean", "true", "l", "가능하다", "가능하다", 1.0), ("u", 7, "e1", "urn:b", "boolean", "true", "l", "불가하다", "불가하다", 1.0),
    ]
    f = spark.createDataFrame(rows, FACTS)
    assert {r["fact_id"] for r in facts.valid_facts(f, entities).collect()} == {1, 6}
    terms = spark.createDataFrame([("urn:C", "class", [], []), ("urn:n", "datatype_property", ["urn:C"], ["http://x#integer"]), ("urn:o", "object_property", ["urn:D"], [])], "iri string, kind string, domains array<string>, ranges array<string>")
    units = spark.createDataFrame([("u", "학과 글")], "unit_id string, text string")
    issues = {r["issue"] for r in facts.candidate_issues(units, entities, f, terms).collect()}
    assert {"bad entity id", "entity without label", "entity without type", "unknown entity type", "undeclared subject", "unknown predicate", "relation to itself", "number not in the quote", "confidence outside 0..1", "subject outside the domain", "repeated fact", "label not in the unit", "identifier not in the unit", "yes without a cue"} <= issues
    assert {r["entity_id"] for r in facts.referenced_entities(entities, f).collect()} == {"e1"}
    kept = {r["entity_id"]: r["identifier"] for r in facts.grounded_entities(entities, units).collect()}
    assert kept["e1"] is None and "e2" not in kept


def test_coverage_and_merge(spark):
    at = lambda *xs: spark.createDataFrame([("u", x) for x in xs], "unit_id string, locator string")
    r = facts.coverage(at("a", "b", "c"), at("a"), at("b"), at("z").limit(0)).first()
    assert r["unresolved"] == ["c"] and not r["complete"]
    b = spark.createDataFrame([("u", "e", 2, "나중", ["y", "x"]), ("u", "e", 1, "먼저", ["x"])], "unit_id string, entity_id string, batch int, label string, types array<string>")
    m = facts.merged_entities(b).first()
    assert m["label"] == "먼저" and m["types"] == ["x", "y"]
    alias = spark.createDataFrame([("n", "urn:n"), ("o", "urn:o1"), ("o", "urn:o2")], "alias string, iri string")
    f = spark.createDataFrame([("n", 1), ("o", 2)], "predicate string, k int")
    assert {tuple(r) for r in facts.expand_references(f, alias).collect()} == {("urn:n", 1), ("o", 2)}


# ---- reconciliation, records -------------------------------------------------------------------------------


def test_alignment(spark):
    columns = "kind string, term_key string, iri string, lexical double, embedding double, combined double, compatible boolean, same_label boolean"
    up = spark.createDataFrame([("class", "t1", "urn:u", 1.0, 1.0, 1.0, True, True), ("class", "t2", "urn:u", 0.7, 0.8, 0.79, True, False), ("class", "t3", "urn:u", 0.1, 0.1, 0.1, True, False)], columns)
    local = spark.createDataFrame([("class", "t4", "t3", 0.99, 0.99, 0.99, True, False), ("class", "t4", "t1", 1.0, 1.0, 1.0, True, False)], columns)
    got = {r["term_key"]: (r["target"], r["status"]) for r in reconcile.align_terms(up, local).collect()}
    assert got == {"t1": ("urn:u", "auto"), "t2": ("urn:u", "review"), "t3": (None, "distinct"), "t4": ("t3", "auto")}
    p = spark.createDataFrame([("수강 가능", "수강 불가"), ("가능", "불가능"), ("x", "불가")], "a string, b string")
    assert [r[0] for r in p.select(reconcile.polarity_compatible(F.col("a"), F.col("b"))).collect()] == [False, True, True]


def test_publication(spark):
    a = spark.createDataFrame([("x", "urn:c1", "auto", "urn:t", "urn:d", "l", "d"), ("y", "urn:c2", "review", "urn:t", "urn:d2", "l", "d")], "alignment_id string, candidate_iri string, status string, target_iri string, distinct_iri string, label string, definition string")
    none = spark.createDataFrame([], "alignment_id string, decision string, target_iri string, amended_label string, amended_definition string, seq int")
    with pytest.raises(Exception, match="pending alignment"):
        reconcile.resolved_alignments(a, none).collect()
    done = spark.createDataFrame([("y", "merge", None, None, None, 1), ("y", "amend", None, "새 이름", None, 2)], none.schema)
    got = {r["candidate_iri"]: (r["target"], r["label"]) for r in reconcile.resolved_alignments(a, done).collect()}
    assert got == {"urn:c1": ("urn:t", "l"), "urn:c2": ("urn:d2", "새 이름")}
    draft = spark.createDataFrame([("urn:cand:1", "p", "iri", "urn:cand:2", "", "", "u")], TRIPLES)
    mapping = spark.createDataFrame([("urn:cand:1", "urn:r:1")], "iri string, target string")
    with pytest.raises(ValueError, match="left"):
        reconcile.publish(draft.limit(0), draft, mapping, draft.limit(0), "urn:cand:")


def test_embeddings(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    cache = spark.createDataFrame([("ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb",)], "key string")
    missing = reconcile.missing_embeddings(texts, cache)
    assert [r["vector"] for r in reconcile.embed_missing(missing, lambda xs: [[float(len(x))] for x in xs]).collect()] == [[1.0]]


def test_greedy_selection(spark):
    rows = [("a", True, 0, "standalone", "t", 1, "q1", "i1", "b1"), ("b", True, 0, "standalone", "t", 1, "q1", "i2", "b2"), ("c", True, 1, "x", "u", 1, "q3", "i3", "b3"), ("d", False, 0, "x", "u", 1, "q4", "i4", "b4")]
    df = spark.createDataFrame(rows, "conversation_id string, passed boolean, issues int, mode string, question_type string, round int, question string, query string, bundle string")
    assert records.fact_distinct(df, 2) == ["a", "c"]
    with pytest.raises(ValueError, match="distinct"):
        records.fact_distinct(df, 3)


# ---- files, keys, streams -------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert sorted(r["k"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not an object"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "k int").collect()
    (tmp_path / "q.csv").write_text("Pregunta;x\n¿uno?;1\n;2\ndos;3\n", encoding="utf-8-sig")
    assert [tuple(r) for r in files.style_questions(spark, str(tmp_path / "q.csv")).orderBy("style_id").collect()] == [("style-0001", "¿uno?"), ("style-0003", "dos")]
    (tmp_path / "m.md").write_text("하나\n\n---\n\n둘")
    assert [(r["page"], r["text"]) for r in files.read_pages(spark, str(tmp_path / "m.md")).orderBy("page").collect()] == [(1, "하나"), (2, "둘")]
    assert files.parse_pages("1-3, 7") == [1, 2, 3, 7] and files.parse_pages("all") is None
    for bad in ("", "4-1", "x"):
        with pytest.raises(ValueError):
            files.parse_pages(bad)
    preview = spark.createDataFrame([("머리\n## 인쇄 페이지 4 (PDF 8)\n글\n## 인쇄 페이지 5 (PDF 9)\n둘",)], "value string")
    assert [tuple(r) for r in files.preview_sections(preview, [5]).collect()] == [(5, 9, "둘")]
    pages = spark.createDataFrame([("d", 1, "a"), ("d", 3, "b")], "document string, page int, text string")
    manifest = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], "document string, page int, sha256 string")
    assert {r["issue"] for r in files.manifest_issues(pages, manifest).collect()} == {"changed page", "missing page", "unlisted page", "page sequence"}


def test_keys(spark, monkeypatch):
    import tripleloom.session as session

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    for limit in (50_000, 0):
        monkeypatch.setattr(session, "BROADCAST_KEY_LIMIT", limit)
        assert sorted(str(r["k"]) for r in one_row_per_key(df, "k").collect()) == ["1", "2", "None"]
        wanted = df.where("k = 1").select("k").distinct()
        assert rows_of_keys(df, wanted, "k").count() == 2 and rows_of_keys(df.where("k is not null"), wanted, "k", False).count() == 1


def test_streams(spark, tmp_path):
    from tripleloom.streaming import logs

    source = tmp_path / "log"
    spark.createDataFrame([("u1", 1, "a"), ("u2", 2, "b"), ("u1", 3, "c"), (None, 4, "d")], "k string, seq int, v string").write.json(str(source))
    stream = logs.latest_stream(logs.read_log(spark, str(source), "k string, seq int, v string"), "k", "seq", "v")
    logs.run_to_memory(stream, "latest", "complete", str(tmp_path / "ck"))
    assert {(r["k"], r["v"]) for r in spark.table("latest").collect()} == {("u1", "c"), ("u2", "b")}


# ---- operators of the second round ---------------------------------------------------------------------


def test_notice_needs_its_parts(spark):
    good = "<div class='board-default-view'><p class='subject'><strong>제목</strong> 부제</p><p class='datetime'>2031</p><div class='content'><p>가</p><p>나 &amp; 다</p></div></div>"
    made = segments.parse_notice(good)
    assert (made["title"], made["published_at"], made["body"], made["tables"]) == ("제목", "2031", "가\n나 & 다", [])
    for bad in ("", "<div class='content'>x</div>", good.replace("datetime", "other")):
        with pytest.raises(ValueError):
            segments.parse_notice(bad)


def test_few_shot_forces_a_category(spark):
    rows = [("a", "rule", "졸업 학점 기준", 1), ("b", "rule", "졸업 학점 조건", 2), ("c", "table", "수강 일정", 3), ("z", "no_fact", "안내", 4), ("y", "no_fact", "제목", 5)]
    df = spark.createDataFrame(rows, "example_id string, category string, text string, at int")
    order = lambda r: [x["example_id"] for x in r.orderBy("place").collect()]
    assert order(linking.few_shot(df, "졸업 학점", 3)) == ["a", "b", "z"]
    assert order(linking.few_shot(df, "졸업 학점", 3, "table")) == ["a", "c", "z"]
    assert linking.few_shot(df.limit(0), "x").count() == 0


def test_close_matches_equal_brute_force(spark):
    from difflib import SequenceMatcher

    words, source = ["해양정첵학과", "도시경영", "xx"], ["해양정책학과", "해양통신공학과", "도시경영학과", "도시정책학과"]
    found = {(r["word"], r["other"]) for r in fuzzy.close_matches(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in source], "word string")).collect()}
    exact = {(w, o) for w in words for o in sorted(source, key=lambda o: -SequenceMatcher(None, w, o).ratio())[:3] if SequenceMatcher(None, w, o).ratio() >= 0.65}
    assert found == exact and len(exact) >= 2


def test_keys_and_decisions(spark):
    columns = spark.createDataFrame([("t", 0), ("t", 1), ("t", 2)], "table_id string, base_column int")
    keys = spark.createDataFrame([("t", 0, "name"), ("t", 1, "name"), ("t", 9, "Bad key"), ("t", 2, None)], "table_id string, base_column int, key string")
    assert {r["issue"] for r in tables.key_issues(columns, keys).collect()} == {"repeated key", "unknown column", "bad key", "missing column"}
    assert tables.key_issues(columns.limit(0), keys.limit(0)).count() == 0
    d = spark.createDataFrame([(1, "accept", "success", True, None), (2, "reject", None, None, " "), (3, None, None, None, None), (4, "amend", "success", None, "x")], "decision_id int, decision string, status string, complete boolean, reason string")
    assert {r["decision_id"]: r["issues"] for r in reconcile.unit_decision_issues(d).collect()} == {1: [], 2: ["no reason"], 3: ["unknown decision"], 4: ["candidate is not complete"]}


def test_median_and_blocks(spark):
    t = spark.createDataFrame([(1, 10), (1, 30), (1, 20), (1, 40), (2, 5)], "page int, height int")
    assert {(r["page"], r["median_height"]) for r in tables.median_heights(t).collect()} == {(1, 30), (2, 5)}


def test_provenance_leaves_nulls_out(spark):
    schema = "unit_id string, document_id string, locator string, content_hash string, source_status string, source_hash string, source_issues array<string>, text string, pdf_page int, printed_page int, created_at timestamp_ntz"
    df = spark.createDataFrame([("u 1", "d", None, None, "ok", None, ["x", "x"], None, None, 3, None), ("u 1", "d", None, None, "ok", None, None, None, None, 3, None)], schema)
    made = {(r["p"].split("#")[-1].split(":")[-1].split("/")[-1], r["o_value"]) for r in graph.provenance(df, "r").collect()}
    assert ("sourceIssue", "x") in made and ("printedPage", "3") in made and not {p for p, _ in made} & {"pdfPage", "locator", "text"}
    assert graph.provenance(df.limit(0), "r").count() == 0


def test_nearest_vectors_equal_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "BASE_BLOCK", 11)
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0]), (63, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("raw", F.lit("clash"))

    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return 0.0
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 12) if n else 0.0

    exact = {(i, j) for i, a in rows[:20] for j in [j for _, j in sorted((-cosine(a, b), j) for j, b in rows if j != i)][:3]}
    assert {(r["id"], r["other"]) for r in vectors.top_similar(df.where("id < 20"), df, "id", "v", 3).collect()} == exact
    assert vectors.top_similar(df.limit(0), df, "id", "v", 3).count() == 0


def test_similar_quotes_equal_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(7)
    base = ["".join(rng.choice("가나다라ab12 ") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    edited = [t[: (k := rng.randint(0, len(t)))] + rng.choice(["", "ａ", "x y", "나"]) + t[k + rng.randint(0, 3) :] for t in base for _ in range(3)]
    inside = [t[rng.randint(0, 20) : rng.randint(20, 60)] for t in base] + ["가", "ㄱ", "ａｂ", "ab", "aaaaa", "aaaaaaaaaa", "", " "] + [t * 9 for t in base[:3]]
    rows = [(rng.choice(["p", "p", "q", "r"]), t) for t in base + edited + inside] * 2 + [(None, "ab"), (None, "abc"), ("p", None)]
    df = spark.createDataFrame(rows, "locator string, quote string")
    known = {(p, t) for p, t in rows if p is not None and t is not None}
    exact = sorted((p, a, b) for p, a in known for q, b in known if p == q and a < b and records._same_text(a, b))
    assert len(exact) > 200 and len({t for _, t in known}) > 250
    monkeypatch.setattr(records, "STRIP", 16)
    for block in (40, 5000):
        assert sorted(map(tuple, records.similar_quotes(df, block).collect())) == exact
    assert records.similar_quotes(df.limit(0)).count() == 0


def test_similar_evidence_reads_few_of_the_pairs(spark, tmp_path):
    import random

    from tripleloom.plans.document_queries import QUERIES

    rng = random.Random(3)
    quotes = ["".join(rng.choices("가나다라마바사아자차카타파하", k=200)) for _ in range(1000)]
    quotes += [q[:150] for q in quotes[:5]] + [q[:100] + "x" + q[100:] for q in quotes[5:10]]
    schema = "conversation_id string, evidence array<struct<source_unit_id:string,locator:string,quote:string>>"
    spark.createDataFrame([(str(i), [(None, "page", q)]) for i, q in enumerate(quotes)], schema).write.parquet(str(tmp_path / "qa_records.parquet"))
    made = QUERIES["similar_evidence"](spark, str(tmp_path))
    assert made.count() == 10
    # the half million pairs are not built, and hardly more than the right ones are read
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    import numpy as np

    everything = np.arange(len(quotes))
    assert len(list(records._candidates(quotes, everything, everything))) <= 15
