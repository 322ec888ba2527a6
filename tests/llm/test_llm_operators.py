"""The training-data operators on small fixtures: meaning, edge cases, brute force."""

from __future__ import annotations

import base64
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tripleloom.llm import components, leakage, lookalike, mapping, markup, names, nearcopies, pairs, scans, stuffing, tokenise

QA = "conversation_id string, messages array<struct<role:string,content:string>>, evidence array<struct<source_unit_id:string,locator:string,quote:string>>, reference_answer string"


def rows(df):
    return {tuple(r) for r in df.collect()}


# ---- near copies ---------------------------------------------------------------------


def _texts(seed: int, n: int) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("가나다라마바사아자차카타파하") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    out = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(60)]
        out.append((f"k{i:03d}", " ".join(base)))
        if i % 3 == 0:
            edited = list(base)
            for _ in range(rng.randint(1, 9)):
                edited[rng.randrange(60)] = rng.choice(words)
            out.append((f"k{i:03d}x", " ".join(edited)))
        if i % 10 == 0:
            out.append((f"k{i:03d}y", " ".join(base).replace(" ", "  ").upper()))
    return out


def test_near_copies_match_brute_force(spark):
    texts = _texts(5, 60)
    qa = spark.createDataFrame([(k, [("user", t)], [], "a") for k, t in texts], QA)
    found = rows(nearcopies.repeated_records(qa))
    exact = {(a, b) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if nearcopies.jaccard(x, y) >= 0.5}
    exact = {tuple(sorted(p)) for p in exact}
    assert len(exact) > 20
    assert found <= exact
    assert len(found) >= 0.97 * len(exact)


def test_near_copies_edge_cases(spark):
    long = "복수전공을 승인받은 학생은 " * 400
    data = [
        ("a", [("user", long)], None, None), ("b", [("user", long)], [], None), ("a", [("user", long)], None, None), ("c", None, None, None),
        ("d", [("user", None)], [("u", "l", None)], ""), ("e", [("user", "짧")], [], ""), (None, [("user", long)], None, None),
    ]
    qa = spark.createDataFrame(data, QA).withColumn("key", F.lit(1)).withColumn("text", F.lit("clash"))
    assert rows(nearcopies.repeated_records(qa)) == {("a", "b")}
    assert rows(nearcopies.repeated_records(qa.limit(0))) == set()


def test_classes_have_one_row_for_each_record(spark):
    texts = _texts(7, 40)
    qa = spark.createDataFrame([(k, [("user", t)], [], "a") for k, t in texts], QA)
    near = {tuple(sorted((a, b))) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if nearcopies.jaccard(x, y) >= 0.5}
    found = {r["conversation_id"]: (r["class_id"], r["links"]) for r in nearcopies.classed_records(qa).collect()}
    assert set(found) == {k for k, _ in texts}
    assert all(found[a][0] == found[b][0] for a, b in near) and len({c for c, _ in found.values()}) == 40


def test_hot_variants_are_split_without_loss(spark, monkeypatch):
    texts = _texts(13, 50)
    qa = spark.createDataFrame([(k, [("user", t)], [], "a") for k, t in texts], QA)
    plain = rows(nearcopies.repeated_records(qa))
    monkeypatch.setattr(nearcopies, "HOT", 2)
    monkeypatch.setattr(nearcopies, "SAMPLED", 1)
    assert rows(nearcopies.repeated_records(qa)) == plain and len(plain) > 15


def test_pairs_are_compared_once(spark):
    """What compares texts ran again wherever the result named its pairs: four times in repeated_records."""
    texts = _texts(11, 20)
    near = [(a, b) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if nearcopies.jaccard(x, y) >= 0.5]
    # k000 and k000y are copies; so are k010 and k010y and one more
    qa = spark.createDataFrame([(k, [("user", t)], [], "a") for k, t in [*texts, ("k010z", dict(texts)["k010"])]], QA)
    pairs, classes = nearcopies.repeated_records(qa), nearcopies.classed_records(qa)
    for found, comparisons in ((pairs, 1), (classes, 0)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == comparisons
    found = rows(pairs)
    assert {tuple(sorted(p)) for p in near} <= found and pairs.count() == len(found)
    assert {("k000", "k000x"), ("k000x", "k000y"), ("k000", "k000y"), ("k010", "k010z"), ("k010y", "k010z")} <= found


def test_third_of_all_rows_are_copies(spark):
    texts = _texts(9, 30)
    copies = [(f"z{i:02d}", texts[0][1]) for i in range(15)]
    qa = spark.createDataFrame([(k, [("user", t)], [], "a") for k, t in texts + copies], QA)
    found = rows(nearcopies.repeated_records(qa))
    assert sum(a.startswith("z") and b.startswith("z") for a, b in found) == 15 * 14 // 2


# ---- markup -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "languages", "shown"),
    [
        ("<p>하나<br>둘</p><ul><li>가<li>나</ul>", ["html"], "- 가"),
        ("A &amp; B", ["html"], "A & B"),
        ("## 제목\n\n- 하나\n- [x] 둘", ["markdown"], "제목"),
        ("| a | b |\n| --- | --- |\n| 1 | <b> |", ["markdown"], "a | b"),
        ("```\n<p>x</p> [[y]]\n```", ["markdown"], "<p>x</p>"),
        ("== 제목 ==\n[[분류:가]] {{안내문|2030}} '''굵게'''", ["wiki"], "제목"),
        ('{| class="wikitable"\n! 과목 !! 학점\n|-\n| 가 || 3\n|}', ["wiki"], "과목 | 학점"),
        ("평점은 $G = \\frac{a}{b}$ 이다. \\textbf{굵게}", ["latex"], "G = \\frac{a}{b}"),
        ("\\begin{itemize}\n\\item 하나\n\\end{itemize}", ["latex"], "- 하나"),
        ("정원이 50 < 60 이면, 48$ 정도, <표 3>, 정원* 표시, C# 5*2, HBC_83_A, R&D [제2호]", [], "50 < 60"),
        ("- 75 -\n— 3 —\n[70]", [], "- 75 -"),
        ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", ["html"], "a | b"),
        ("<script>hidden()</script>보임<!-- 숨김 -->", ["html"], "보임"),
    ],
)
def test_markup(text, languages, shown):
    clean, found = markup.clean_markup(text)
    assert found == languages
    assert shown in clean
    assert "hidden" not in clean


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ('<div style="display:none">hidden</div><p hidden>hidden</p><span aria-hidden="true">hidden</span>seen', "seen"),
        ("<table><tr><td>A<table><tr><td>in1</td><td>in2</td></tr></table></td><td>B</td></tr><tr><td>C</td><td>D</td></tr></table>", "A (in1 | in2) | B\nC             | D"),
        ("<ol start=3><li>one<ul><li>a<li>b</ul><li>two</ol>", "3. one\n  - a\n  - b\n4. two"),
        ("<ul><li><p>para</p></li><li>b</li></ul>", "- para\n- b"),
        ("<table><tr><td rowspan=2>r</td><td colspan='2'>c</td></tr><tr><td>x</td><td>y</td></tr></table>", "r | c |\n  | x | y"),
        ("x \\frac{1}{2} y \\textbf{\\emph{z}}", "x \\frac{1}{2} y z"),
        ("\\begin{tabular}{ll}\na & b \\\\ \\hline\n1 & \\textbf{2} \\\\\n\\end{tabular}", "a | b\n1 | 2"),
        ("\\begin{verbatim}\n\\textbf{x}\n\\end{verbatim}", "    \\textbf{x}"),
        ("\\begin{enumerate}\n\\item a\n\\begin{itemize}\n\\item b\n\\end{itemize}\n\\item c\n\\end{enumerate}", "1. a\n  - b\n2. c"),
        ("## h\n*it* and _em_ but 5*2 a_b_c", "h\n\nit and em but 5*2 a_b_c"),
        ("정원* 표시, 비고* 표시", "정원* 표시, 비고* 표시"),
        ("| a \\| b | **c** |\n| --- | --- |\n| 1 | 2 |", "a | b | c\n1     | 2"),
        ("<p>x<p>y</b></i> z", "x\n\ny z"),
    ],
)
def test_markup_layout(text, shown):
    assert markup.clean_markup(text)[0].strip("\n") == shown


def test_markup_table(spark):
    data = [("1", None), ("2", ""), ("3", "그냥 글"), ("4", "**굵게**"), ("4", "**굵게**"), ("5", "<b>x</b> " * 3000)]
    df = spark.createDataFrame(data, "id string, body string").withColumn("record_id", F.lit("clash")).withColumn("markups", F.lit("clash"))
    assert rows(markup.markup_found(df, "id", "body")) == {("4", "markdown"), ("5", "html")}
    clean = {r["record_id"]: r["clean_text"] for r in markup.render_markup(df, "id", "body").collect()}
    assert clean["1"] is None and clean["2"] == "" and clean["3"] == "그냥 글" and clean["4"] == "굵게"
    assert markup.markup_found(df.limit(0), "id", "body").count() == 0


def test_markup_filter_is_no_narrower_than_the_reader(spark):
    texts = ["제목\n---\n본문", "목록\n  - 하나\n  - 둘", " 1. 하나\n 2. 둘", "#\t제목", "-\t하나", "＃ 제목", "＜b＞굵게＜/b＞", "#\u00a0제목", "a | b\n--- | ---\n1 | 2", "본문만\u200b 있다.", "본문만 있다."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    read = {(str(i), m) for i, t in enumerate(texts) for m in markup.clean_markup(t)[1]}
    assert rows(markup.markup_found(df, "id", "body")) == read and {r[0] for r in read} >= {str(i) for i in range(8)}
    clean = {r["record_id"]: r["clean_text"] for r in markup.render_markup(df, "id", "body").collect()}
    assert clean["9"] == texts[9] and clean["10"] == texts[10]


# ---- pairs --------------------------------------------------------------------------------

EVIDENCE = ["첫 문장은 여기에서 끝난다. 통합화학특강은 체육역사학부 과목으로서 신청자가 96명 미만일 때 폐강할 수 있다. 마지막 문장이다."]


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("폐강 기준이 몇 명이에요?", None, "empty"),
        ("폐강 기준이 몇 명이에요?", " \u200b—…", "empty"),
        ("폐강 기준이 몇 명이에요?", "죄송합니다. 제가 답변드릴 수 없는 질문입니다.", "refusal"),
        ("Where is the desk?", "I must decline to answer; please ask something else.", "refusal"),
        ("폐강 기준이 몇 명이에요?", "질문: 폐강기준이 몇 명이에요", "copied"),
        ("폐강 기준이 몇 명이에요?", "폐강 기준이 몇 명이에요? 폐강 기준이 몇 명이에요?", "copied"),
        ("폐강 기준이 몇 명이에요?", "폐강 기준이 몇 명이에요? 96명 미만", None),
        ("폐강 기준이 몇 명이에요?", "Students may carry over nine credits in the spring term.", "other_language"),
        ("Where should the form be handed in?", "신청 확인서는 정보전산팀에 제출하여야 한다.", "other_language"),
        ("What is the limit?", "Le dossier doit être déposé avant le 19 juin.", "other_language"),
        ("폐강 기준이 몇 명이에요?", "通合化学特讲的名额为96名。", "other_language"),
        ("폐강 기준이 몇 명이에요?", "통합화학특강은 체육역사학부 과목으로서 신청자가", "truncated"),
        ("폐강 기준이 몇 명이에요?", "통합화학특강은 체육역사학부 과목으로서 신청…", "truncated"),
        ("폐강 기준이 몇 명이에요?", "통합화학특강은 체육역사학부 과목으로서 신청자가 96명 미만일 때 폐강할 수 있다", None),
        ("폐강 기준이 몇 명이에요?", "96명 미만", None),
        ("폐강 기준이 몇 명이에요?", "안내가 늦어 죄송합니다. 통합화학특강은 체육역사학부 과목으로서 신청자가 96명 미만일 때 폐강할 수 있다.", None),
        ("전화로 되나요?", "전화로는 답변하지 않는다.", None),
    ],
)
def test_defects(question, answer, defect):
    assert pairs.defect_of(question, answer, EVIDENCE) == defect


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("Where is it?", "That is outside my remit.", "refusal"), ("Wo ist das Büro?", "Das kann ich leider nicht beantworten.", "refusal"), ("Who answers?", "Staff were unable to answer the phone before nine.", None),
        ("Where is the office located?", "Das Formular muss vor dem ersten Mai abgegeben werden.", "other_language"), ("Where is the office located?", "Форма должна быть подана до первого мая.", "other_language"),
    ],
)
def test_defects_in_other_languages(question, answer, defect):
    assert pairs.defect_of(question, answer, EVIDENCE) == defect


def test_sorted_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pairs, "RANGE_KEYS", 12)
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choice("가나다라") for _ in range(3)) for _ in range(4)) + "."
    quotes = [[" ".join(sentence() for _ in range(4))] for _ in range(60)]
    answers = [q[0][: rng.randint(8, 70)] for q in quotes] + ["가나다 라가나 다라", "없는 말로 쓴 답", None, ""]
    data = [(f"c{i}", "물음", a, quotes[i] if i < 60 else None) for i, a in enumerate(answers)]
    table = pairs.with_piece(spark.createDataFrame(data, "conversation_id string, question string, answer string, quotes array<string>")).cache()
    keys = {r["key"] for r in pairs.sentence_keys(table).collect()}
    pieces = {r["piece"] for r in table.collect() if r["piece"]}
    exact = {(p, "whole" if p in keys else "inside") for p in pieces if any(k.startswith(p) for k in keys)}
    assert rows(pairs.shortened_pieces(table)) == exact and len(exact) > 20
    table.unpersist()


def test_broken_pairs_table(spark):
    data = [
        ("a", [("user", "무엇인가요?"), ("assistant", "")], None, ""), ("a", [("user", "무엇인가요?"), ("assistant", "")], None, ""), ("b", None, None, None),
        ("c", [("assistant", "답")], [], "답이다."), ("d", [("user", None), ("assistant", "x")], [], "좋은 답이다."),
    ]
    qa = spark.createDataFrame(data, QA).withColumn("question", F.lit(1)).withColumn("n", F.lit(1)).withColumn("spike", F.lit(1))
    assert rows(pairs.broken_pairs(qa)) == {("a", "empty"), ("b", "empty")}
    assert pairs.broken_pairs(qa.limit(0)).count() == 0


def test_length_spikes(spark):
    data = [(str(i), "가" * 40) for i in range(60)] + [(f"x{i}", "나" * (20 + i % 50)) for i in range(100)]
    found = rows(pairs.length_spikes(spark.createDataFrame(data, "conversation_id string, answer string")))
    assert found == {(40,)}


# ---- look-alikes -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("ＨＢＣ４１４８", "HBC4148"), ("가", "가"), ("a\u200bb\xad", "ab"), ("한\u3000글\xa0x", "한 글 x"), ("lеаst", "least"), ("HΒC", "HBC"),
        ("Кафедра", "Кафедра"), ("α 반", "α 반"), ("café naïve", "café naïve"), ("a\tb\nc", "a\tb\nc"), ("", ""), (None, None),
    ],
)
def test_canonical(text, form):
    assert lookalike.canonical(text) == form


def test_changed_records(spark):
    data = [(1, "plain"), (2, "ｗｉｄｅ"), (2, "ｗｉｄｅ"), (3, None), (4, ""), (5, "Кафедра"), (6, "x" * 50000 + "\u200b")]
    df = spark.createDataFrame(data, "id long, label string").withColumn("value", F.lit(1)).withColumn("record_id", F.lit(1))
    assert rows(lookalike.changed_records(df, "id", "label")) == {("2",), ("6",)}
    one = {r["id"]: r["canonical"] for r in lookalike.canonicalise(df.select("id", "label", F.lit(9).alias("canonical")), "label").collect()}
    assert one[2] == "wide" and one[3] is None and one[1] == "plain"
    assert lookalike.changed_records(df.limit(0), "id", "label").count() == 0


# ---- scans ----------------------------------------------------------------------------------------


def test_scan_repair(spark):
    body = "휴학 중인 학생이라도 학점 교환 신청을 정해진 순서에 따라 제출하여야 한다. 재학생은 수업을 듣는다."
    data = [(f"u{i}", body) for i in range(60)]
    words = body.split()  # furniture stands between words, at another place on each page
    data += [(f"h{i}", f"{' '.join(words[: i + 2])}\n학사 규정집 제{i}편\n{' '.join(words[i + 2 :])}") for i in range(6)]
    data += [("hy", "휴학 중인 학생이라도 학점 교-\n환 신청을 낸다."), ("mi", "휴학 중인 힉생이라도 l3학점을 낸다."), ("pg", f"{body}\n- 17 -"), ("ok", "신청 기간 -\n9월 1일부터"), ("nu", None), ("em", ""), ("mi", "휴학 중인 힉생이라도 l3학점을 낸다.")]
    df = spark.createDataFrame(data, "record_id string, text string").withColumn("record_table", F.lit("t")).withColumn("noise", F.lit("clash"))
    found = {(r["record_id"], r["noise"]) for r in scans.scan_noise(df).collect()}
    assert {(f"h{i}", "header") for i in range(6)} <= found
    assert {("hy", "hyphen"), ("mi", "misread"), ("pg", "pageno")} <= found
    assert not {r for r in found if r[0] in ("ok", "nu", "em") or r[0].startswith("u")}
    fixed = {r["record_id"]: r["repaired"] for r in scans.repair_pages(df).collect()}
    assert fixed["hy"] == "휴학 중인 학생이라도 학점 교환 신청을 낸다."
    assert fixed["mi"] == "휴학 중인 학생이라도 13학점을 낸다."
    assert fixed["pg"] == body and fixed["h3"] == body and fixed["nu"] is None
    assert scans.scan_noise(df.limit(0)).count() == 0


def test_copies_of_a_page_do_not_hide_its_misreading(spark):
    words = [a + b for a in ("수업", "과목", "졸업", "등록", "휴학", "복학", "장학", "교직") for b in ("신청", "안내", "명단", "기간", "변경")]
    sound = [(f"s{i}", f"{words[i]} {words[-i]} 담당 학생이라도 {i}일까지 {words[i // 2]} 서류를 낸다.") for i in range(40)]
    copied = [(f"c{i}", "교직 과정을 마친 힉생이라도 추천서를 낸다.") for i in range(20)]
    df = spark.createDataFrame(sound + copied, "record_id string, text string").withColumn("record_table", F.lit("t"))
    found = {(r["record_id"], r["noise"]) for r in scans.scan_noise(df).collect()}
    assert found == {(f"c{i}", "misread") for i in range(20)}
    counts = {(r["kind"], r["key"]): (r["n"], r["alone"]) for r in scans.page_counts(df).collect()}
    assert counts["w", "힉생이라도"] == (1, 0) and counts["w", "학생이라도"] == (40, 0)


def test_compounds_keep_their_hyphen_at_a_line_end(spark):
    lines = [(f"s{i}", f"The well-known desk number {i} is open, and students ask for admission there.") for i in range(12)]
    odd = [("cw", "It is the well-\nknown desk."), ("br", "They ask for admis-\nsion there."), ("ko", "학생이 학점 교-\n환 신청을 낸다.")]
    df = spark.createDataFrame(lines + odd, "record_id string, text string").withColumn("record_table", F.lit("t"))
    done = {r["record_id"]: (r["repaired"], r["noise"]) for r in scans.repair_pages(df).collect()}
    assert done["cw"] == ("It is the well-known desk.", [])
    assert done["br"] == ("They ask for admission there.", ["hyphen"]) and done["ko"][1] == ["hyphen"]


def test_joined_headers_equal_broadcast_ones(spark, monkeypatch):
    words = "휴학 중인 학생이라도 학점 교환 신청을 정해진 순서에 따라 제출하여야 한다. 재학생은 수업을 듣는다.".split()
    data = [(f"h{i}", f"{' '.join(words[: i + 2])}\n학사 규정집 제{i}편\n{' '.join(words[i + 2 :])}") for i in range(8)] + [(f"u{i}", " ".join(words)) for i in range(40)]
    df = spark.createDataFrame(data, "record_id string, text string").withColumn("record_table", F.lit("t"))
    shared = sorted((r["record_id"], r["repaired"], r["noise"]) for r in scans.repair_pages(df).collect())
    monkeypatch.setattr(scans, "CORRECTION_LIMIT", 0)
    assert sorted((r["record_id"], r["repaired"], r["noise"]) for r in scans.repair_pages(df).collect()) == shared
    assert sum("header" in r[2] for r in shared) == 8


def test_joined_corrections_equal_broadcast_ones(spark, monkeypatch):
    sound = [(f"s{i}", f"{chr(0xAC00 + 700 * i)}{chr(0xB098 + 30 * i)} 담당 학생이라도 {i}일까지 서류를 낸다.") for i in range(12)]
    odd = [("ty", "3힉생이라도 낸다."), ("br", "휴가 중인 힉생-\n이라도 낸다."), ("de", unicodedata.normalize("NFD", "힉생이라도 낸다.")), ("zw", "힉생\u200b이라도 낸다."), ("mi", "힉생이라도 낸다."), ("mi", "힉생이라도 낸다."), (None, "또 힉생이라도 낸다."), ("nu", None)]
    df = spark.createDataFrame(sound + odd, "record_id string, text string").withColumn("record_table", F.lit("t"))
    monkeypatch.setattr(scans, "corrections", lambda counts: counts.where("key = '힉생이라도'").select(F.col("key").alias("word"), F.lit("학생이라도").alias("other")).distinct())

    def repaired():
        return sorted((str(r["record_id"]), r["repaired"] or "", r["noise"]) for r in scans.repair_pages(df).collect())

    shared = repaired()
    monkeypatch.setattr(scans, "CORRECTION_LIMIT", 0)
    assert repaired() == shared
    assert {r[0] for r in shared if "misread" in r[2]} == {"ty", "br", "de", "zw", "mi", "None"}


def test_ranker_on_held_out_words():
    rng = random.Random(3)
    words = [("".join(rng.choice("학점정원과목수업년공청간졸생확출교실습") for _ in range(rng.randint(2, 5))), rng.randint(50, 4000)) for _ in range(400)]
    words = sorted(dict(words).items(), key=lambda w: -w[1])
    model = scans.fit_ranker(words[::2])
    import numpy as np

    random_np = np.random.default_rng(1)
    good = [(scans._corrupted(w, random_np), w, n) for w, n in words[1::2]]
    good = [g for g in good if g[0]]
    right = model.probability(np.array([scans.features(c, max(1, n // 100), w, n) for c, w, n in good]))
    other = model.probability(np.array([scans.features(w[:-1] + "을", n // 3, w[:-1] + "은", n) for w, n in words[1::2]]))
    assert (right >= 0.5).mean() > 0.9 and (other < 0.5).mean() > 0.95


# ---- names ------------------------------------------------------------------------------------------

FIELDS = ["산림자원", "수중고고", "뇌인지", "지역문화", "로봇제어", "언어치료", "방송영상", "평생교육"]
KINDS = ["연구센터", "위원회", "학생회", "지원실", "연구원", "협의회"]


def _bodies(n: int, seed: int = 2) -> list[tuple[int, str, int]]:
    rng = random.Random(seed)
    syllables = [chr(0xAC00 + 588 * a + 28 * b + c) for a in (2, 3, 5, 6, 7, 9, 12) for b in (0, 8, 13, 20) for c in (0, 4, 8, 16)]
    out, key = [], 0
    for i in range(n):
        name, field, kind = "".join(rng.choice(syllables) for _ in range(4)), FIELDS[i % 8], KINDS[i % 6]
        for label in (name + field + kind, f"{kind}, {name} {field}", f"{name} {kind} ({field})", f"(부설){name}{field}{kind}", f"{name}{field[0]}{field[2] if len(field) > 3 else field[1]}{kind}"):
            out.append((key, label, i))
            key += 1
    return out


def test_names_link(spark):
    bodies = _bodies(40)
    df = spark.createDataFrame([(k, "org", label) for k, label, _ in bodies] + [(None, "org", "x"), (9001, "org", None), (9002, "org", ""), (0, "org", bodies[0][1])], "name_id long, kind string, label string").withColumn("root", F.lit(1))
    found = rows(names.link_names(df))
    entity = {k: e for k, _, e in bodies}
    truth = {(a, b) for a in entity for b in entity if a < b and entity[a] == entity[b]}
    assert len(found & truth) >= 0.95 * len(truth)
    assert len(found - truth) <= 0.02 * len(truth)
    assert names.link_names(df.limit(0)).count() == 0


def test_persons_link(spark):
    labels = [
        "Katrissa M. Drotitandan", "Drotitandan, Katrissa M.", "K. Drotitandan", "DROTITANDAN, Katrissa", "Drotitandan 교수님", "Katrissa Drotitandna", "Dr. Katrissa Drotitandan",
        "Katrissa H. Mopifanri", "Katrissa \"Kati\" Mopifanri", "Mopifanri Katrissa", "KatrissaMopifanri", "Samothea E. Krasisekro", "Samothea T. Vutidrese",
    ]
    df = spark.createDataFrame([(i, "person", x) for i, x in enumerate(labels)], "name_id long, kind string, label string")
    found = rows(names.link_names(df))
    assert found == {(a, b) for a in range(7) for b in range(a + 1, 7)} | {(a, b) for a in range(7, 11) for b in range(a + 1, 11)}


def _linked(spark, kind, labels):
    df = spark.createDataFrame([(i, kind, x) for i, x in enumerate(labels)], "name_id long, kind string, label string")
    return rows(names.link_names(df))


def test_a_person_is_a_full_name(spark):
    labels = ["Anna Smith", "Robert Smith", "Smith, Carol", "Zoe Q. Smith", "Liam Baker", "Noah Baker", "Baker, Liam", "Smith", "L. Baker", "B. Smith", "Zoe Smith", "Z. Q. Smith", "Anne Miller", "Anna Miller", "Annna Miller"]
    found = _linked(spark, "person", labels)
    # an ambiguous surname stays alone; an initial with one owner does not
    assert {(4, 6), (4, 8), (6, 8), (3, 10), (3, 11), (10, 11)} <= found
    assert not {p for p in found if 7 in p or 9 in p or set(p) & {0, 1, 2} and set(p) != {0}}
    assert (4, 5) not in found and (0, 1) not in found


def test_bodies_in_latin_letters(spark):
    assert _linked(spark, "org", ["Harvard University", "University of Harvard", "Stanford University", "Standford University", "Oxford University"]) == {(0, 1), (2, 3)}


def test_radius_join_is_exact(spark, monkeypatch):
    monkeypatch.setattr(names, "PER_PIVOT", 50)
    rng = random.Random(11)
    cores = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(4, 7))) for _ in range(700)})
    nodes = spark.createDataFrame([(i, c, "x") for i, c in enumerate(cores)], "id long, name string, about string")
    found = {(r["a"], r["b"]) for r in names.near_names(nodes).collect()}
    swapped = {c: {c[:k] + c[k + 1] + c[k] + c[k + 2 :] for k in range(len(c) - 1)} for c in cores}
    exact = {(i, j) for i, a in enumerate(cores) for j, b in enumerate(cores) if i < j and (names.edit_distance(a, b, 1) <= 1 or a in swapped[b])}
    assert found == exact and len(exact) > 50


def test_linking_sends_no_table_to_the_driver(spark):
    def plans():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store = spark._jsparkSession.sharedState().statusStore()
        seen = store.executionsList()
        return {(x := seen.apply(i)).executionId(): x.physicalPlanDescription() for i in range(seen.size())}

    before = plans()
    labels = ["Anna Smith", "Anna Smiht", "Zoe Q. Smith", "Z. Q. Smith", "Smith", "L. Baker", "Liam Baker", "Baker", "B. T. Cole"]
    assert {(0, 1), (2, 3), (5, 6)} <= _linked(spark, "person", labels)
    assert _linked(spark, "org", ["Harvard University", "University of Harvard", "Oxford University"]) == {(0, 1)}
    ran = [plan for key, plan in plans().items() if key not in before]
    assert any("SortMergeJoin" in plan for plan in ran) and not any("BroadcastExchange" in plan for plan in ran)


def test_a_name_is_not_copied_into_the_cells_it_visits(spark, monkeypatch):
    monkeypatch.setattr(names, "PER_PIVOT", 5)
    rng = random.Random(3)
    cores = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(200)})
    nodes = spark.createDataFrame([(i, c, "x") for i, c in enumerate(cores)], "id long, name string, about string")
    plan = names.near_names(nodes)._jdf.queryExecution().optimizedPlan().toString()
    # rows are multiplied by the deletion variants alone
    assert "Generate explode" in plan and "posexplode" not in plan


def test_nearest_forms_equal_brute_force():
    rng = random.Random(2)
    forms = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    near = names.Nearest(forms)
    for text in ("abc", "abcdef", "zzz", ""):
        assert near.within(text, 2) == sorted((d, i) for i, f in enumerate(forms) if (d := names.edit_distance(text, f, 2)) <= 2)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 90) if i != 40], "a long, b long")
    found = {r["id"]: r["root"] for r in components.components(spark.range(92), edges).collect()}
    assert found == {i: 0 if i <= 40 else 41 if i <= 90 else 91 for i in range(92)}


# ---- mapping ---------------------------------------------------------------------------------------

REFERENCE = [
    ("urn:x:dept-000", "해양바이오전공", "Marine Bioscience", "HD410", "hbu:Department"), ("urn:x:dept-001", "해양정책학과", "Marine Policy", "HD417", "hbu:Department"),
    ("urn:x:dept-002", "해양통신공학과", "Marine Telecom", "HD424", "hbu:Department"), ("urn:x:course-000", "기초회로개론", "Basic Circuits Introduction", "HBC2003", "hbu:Course"),
    ("urn:x:course-001", "기초경제개론", "Basic Economics Introduction", "HBC2016", "hbu:Course"), ("urn:x:action-000", "수강신청 정정", "Enrollment Change", "HA101", "hbu:AdministrativeAction"),
]


@pytest.mark.parametrize(
    ("value", "iri"),
    [
        ("해양 바이오전공", "urn:x:dept-000"), ("해양바이오젼공", "urn:x:dept-000"), ("해양정책학", "urn:x:dept-001"), ("hd-417", "urn:x:dept-001"), ("HBC2016 기초경제개론", "urn:x:course-001"),
        ("Marine Telecmo", "urn:x:dept-002"), ("ENROLLMENT-CHANGE", "urn:x:action-000"), ("수강신청정정", "urn:x:action-000"), ("rlchghlfhrofhs", "urn:x:course-000"), ("urn:other:dept_2", "urn:x:dept-002"),
        ("hbu:dept-999", "UNMATCHED"), ("탐험 박물관", "UNMATCHED"), ("없음", "UNMATCHED"), (None, "UNMATCHED"), ("", "UNMATCHED"), ("?!", "UNMATCHED"), ("우리 해양정책학과 쪽", "urn:x:dept-001"),
    ],
)
def test_mapping(value, iri):
    assert mapping.ReferenceIndex(REFERENCE).match(value) == iri


def test_every_entry_is_compared(monkeypatch):
    fields = [a + b for a in ("해양", "산림", "도시", "언어", "체육", "문화", "정보", "지역") for b in ("정책", "통신", "역사", "관리", "공예")]
    reference = [(f"urn:x:dept-{i:03d}", f"{f}학과", f"Dept {i}", f"HD{400 + i}", "hbu:Department") for i, f in enumerate(fields)]
    index = mapping.ReferenceIndex(reference)
    monkeypatch.setattr(index, "rank", lambda text, repair=None: [])  # no token repaired
    assert index.match("지역공에학과") == f"urn:x:dept-{len(fields) - 1:03d}"
    assert index.match("탐험 박물관") == "UNMATCHED"


@pytest.mark.parametrize(
    ("value", "iri"),
    [
        # six of the entry's 25 letters are missing: the bound is a share of the entry's
        ("Basic Circuits Introd", "urn:x:course-000"), ("asic Economics Introdu", "urn:x:course-001"), ("Basic Circuits", "UNMATCHED"),
        # keys of the other layout with three slips
        ("rkcjghlfkrofhs", "urn:x:course-000"),
        # letters are jamo, also of short values
        ("휴핰", "urn:x:action-001"), ("없음", "UNMATCHED"), ("가", "UNMATCHED"),
    ],
)
def test_no_entry_within_the_letter_bound_is_left_out(value, iri):
    assert mapping.ReferenceIndex([*REFERENCE, ("urn:x:action-001", "휴학", None, "HA102", "hbu:AdministrativeAction")]).match(value) == iri


def test_near_forms_equal_brute_force():
    index, rng = mapping.ReferenceIndex(REFERENCE), random.Random(8)
    reached = 0
    for form, _ in index.forms * 8:
        text = "".join(c for c in form if rng.random() > 0.22)
        exact = sorted((d, i) for i, (f, _) in enumerate(index.forms) if (d := names.edit_distance(text, f)) <= max(mapping.LEAST, int(mapping.SHARE * len(f))))
        found = index.near_forms.within(text, index.bounds(len(text)))
        assert set(exact) <= set(found) and all(names.edit_distance(text, index.forms[i][0]) == d for d, i in found)
        reached += sum(d > max(mapping.LEAST, int(mapping.SHARE * (len(text) + 2))) for d, _ in exact)
    assert reached


def test_joined_repairs_equal_direct_ones(spark):
    reference = spark.createDataFrame(REFERENCE, "iri string, label string, alt_label string, code string, term_type string")
    values = ["해양바이오젼공", "해양정책 학콰", "Marine Telecmo", "Basic Econmics Introduction", "기쵸회로개론", "기초경재개론", "수강 신청정쩡", "전혀 다른 말", "marine bioscence"]
    df = spark.createDataFrame([("t", i, v, None) for i, v in enumerate(values)], "record_table string, record_id long, value string, kind string")
    index = mapping.ReferenceIndex(REFERENCE)
    assert rows(mapping.map_values(df, reference)) == {("t", i, index.match(v)) for i, v in enumerate(values)}
    assert all(set(index.tokens(v, index.repair)) <= set(index.pieces(v)) for v in values)


def test_mapping_table(spark):
    reference = spark.createDataFrame(REFERENCE, "iri string, label string, alt_label string, code string, term_type string")
    data = [("t", 1, "해양정책학과", None), ("t", 1, "해양정책학과", None), ("t", 2, None, "hbu:Course"), ("u", 3, "x" * 20000, None)]
    df = spark.createDataFrame(data, "record_table string, record_id long, value string, kind string").withColumn("iri", F.lit("clash"))
    assert rows(mapping.map_values(df, reference)) == {("t", 1, "urn:x:dept-001"), ("t", 2, "UNMATCHED"), ("u", 3, "UNMATCHED")}
    assert mapping.map_values(df.limit(0), reference).count() == 0
    assert rows(mapping.map_values(df.where("record_id = 1"), reference.limit(0))) == {("t", 1, "UNMATCHED")}


# ---- tokens ------------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not os.path.isdir(tokenise.VOCABULARY_DIR), reason="no public vocabularies here")
SAMPLES = ["", "Hello world", "학사경고를 8회 받은 학생은", "  \n\t x", "<|endoftext|> a", "👨‍👩‍👧 é 한자漢字", "zq" * 300, "don't I'll", "\x00\u200b"]


@needs_vocabulary
def test_encoder_equals_the_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(f"{tokenise.VOCABULARY_DIR}/{tokenise.VOCABULARY}", "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenise.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([*enumerate(SAMPLES), (3, SAMPLES[3]), (99, None)], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in tokenise.encode_table(df, "doc_id", "text").collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(SAMPLES)} | {99: []}
    assert all(library.decode(got[i]) == t for i, t in enumerate(SAMPLES))
    assert tokenise.encode_table(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_prefix_table_appends_and_edits():
    encoder = tokenise.load_encoder()
    word, more, other = "abcdefghij학점".encode(), "신청 xyz".encode(), "abcdeXghij학점".encode()
    table = encoder.prefixes(word)
    assert encoder.append(table, word, more) == encoder.prefixes(word + more)
    assert encoder.edit(table, word, other) == encoder.prefixes(other)
    assert encoder.tokens(table) == encoder.encode(word)


# ---- leakage ----------------------------------------------------------------------------------------------


def test_leakage(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("가나다라마바사아자차카타파하거너더러머버") for _ in range(rng.randint(2, 4))) for _ in range(3000)]
    passages = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(12)]
    filler = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, filler(200)) for i in range(50)]
    truth = set()
    for i, (item, text) in enumerate(passages):
        words = text.split()
        whole = list(words)
        for _ in range(5):
            whole[rng.randrange(60)] = rng.choice(vocabulary)
        half = filler(30) + " " + " ".join(words[:18]) + " " + filler(40) + " " + " ".join(words[30:48])
        docs += [(100 + i, filler(50) + " " + " ".join(whole).upper().replace(" ", "\n", 9)), (200 + i, half), (300 + i, filler(40) + " " + " ".join(words[:15]) + filler(60)), (400 + i, "".join(words))]
        truth |= {(100 + i, item), (200 + i, item), (400 + i, item)}
    docs += [(900, None), (901, ""), (902, passages[0][1]), (902, passages[0][1])]
    truth.add((902, 0))
    documents = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(passages + [(50, None), (51, "")], "item_id long, passage string")
    assert rows(leakage.leaked(documents, "doc_id", "text", items, "item_id", "passage")) == truth
    assert leakage.leaked(documents.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert leakage.leaked(documents, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_leakage_with_textual_ids(spark):
    words = [f"낱말{chr(0xAC00 + 97 * i)}{chr(0xAC00 + 31 * i)}" for i in range(60)]
    documents = spark.createDataFrame([("d1", "앞 " + " ".join(words) + " 뒤"), ("d2", "다른 글")], "doc_id string, text string")
    items = spark.createDataFrame([("i1", " ".join(words))], "item_id string, passage string")
    assert rows(leakage.leaked(documents, "doc_id", "text", items, "item_id", "passage")) == {("d1", "i1")}


# ---- stuffing ------------------------------------------------------------------------------------------------

SOUND = "휴학 중인 학생이라도 실전정치연습 영어 강의를 추가 안내 문자를 받은 날부터 게시판에 올려 알린다. 동일 과목을 최근 기록에 따라 학기 말에 일괄 정산한다. "
COURSES = "\n".join(f"HBC{2000 + 13 * i} 과목{chr(0xAC00 + 600 * i)} {i}학점 월 1{i % 10}:00 가온관 {100 + i}호 정원 {20 + i}명" for i in range(15))


@pytest.mark.parametrize(
    ("text", "stuffed"),
    [
        ("코딩 학원 코딩 학원 최저가. 코딩 학원 이벤트 순위. " * 12, True), ("#이사비용 #코딩학원 [특가] 장학대출 44,000원 코딩학원★무료배송 " * 8, True),
        ("\n".join(f"원룸 특가 - https://deal{i}.example/p/{i}" for i in range(20)), True), ("cheap textbooks, exam answers price, cheap textbooks best, exam answers, " * 8, True),
        (SOUND * 4, False), (COURSES, False), (SOUND * 3 + "\n관련 링크\nhttps://a.example/1 https://a.example/2", False), (SOUND + "운전 연수 최저가 운전 연수 문의 " * 15, True),
        ("", False), (None, False), ("   \n", False), ("Students must return 75 borrowed items before the term ends. They may also ask the office for help with the form. " * 4, False),
    ],
)
def test_stuffing(text, stuffed):
    assert (stuffing.stuffed_share(text) > stuffing.SHARE) is stuffed


def test_stuffed_pages(spark):
    spam = "운전 연수 최저가 운전 연수 문의 " * 20
    df = spark.createDataFrame([(1, spam), (1, spam), (2, SOUND), (3, None), (4, "")], "doc_id long, text string").withColumn("__clash", F.lit(1))
    assert rows(stuffing.stuffed_pages(df, "doc_id", "text")) == {(1,)}
    assert stuffing.stuffed_pages(df.limit(0), "doc_id", "text").count() == 0


ENGLISH = "Students must return borrowed items before the term ends. They may also ask the office for help with the form. The library is open until ten on Friday. Fees are due at the end of the month. "
OFFICE = "If you can not be at the office by the end of the term you may ask for it with the form. "
LISTED = "노트북 할인 키보드 헤드폰 모니터 중고 청소 렌탈 대출 보험 상담 견적 학원 코딩 과외 번역 논술 토익 유학 비자 항공 호텔 펜션 렌트 골프 낚시 캠핑 텐트 침낭 등산 신발 양말 장갑 모자 안경 렌즈".split()


@pytest.mark.parametrize(
    "text",
    [
        OFFICE * 4 + "cheap laptops discount headphones wireless keyboards premium monitors " * 13,  # a third of the words are function words
        " ".join(" ".join(LISTED[12 * i : 12 * i + 12] * 2) + f" {end}니다." for i, end in enumerate(("삽", "팝", "줍"))),  # keywords before a short ending
    ],
)
def test_pages_that_mix_sentences_and_keywords_are_measured(text):
    assert stuffing.stuffed(text) and stuffing.stuffed_share(text) > stuffing.SHARE


def test_early_exit_implies_the_share():
    rng = random.Random(9)
    pieces = [ENGLISH, SOUND, COURSES + "\n", "운전 연수 최저가 운전 연수 문의 " * 3, "cheap laptops discount monitors " * 4, "https://a.example/x ", "- — : – Word. ", "3.Foo is the right one to ask for.", "x" * 90 + ".Foo is the right one to ask for. "]
    left = 0
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        left += stuffing.mostly_sentences(text)
        assert stuffing.stuffed(text) is (stuffing.stuffed_share(text) > stuffing.SHARE)
    assert 50 < left < 350


NOUNS = [a + b for a in ("노트북", "키보드", "헤드폰", "모니터", "운동화", "텐트", "냉장고", "책상") for b in ("할인", "중고", "렌탈", "견적", "추천")]


@pytest.mark.parametrize(
    ("text", "stuffed"),
    [
        ("cheap shoes for buy online " * 60, True),  # a period with a function word
        ("cheap shoes for you, buy online for less, " * 40, True),
        (" ".join(f"noun{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)), True),
        (" ".join(NOUNS), True),  # distinct nouns
        (SOUND + " ".join(NOUNS * 3), True),
        (" ".join(LISTED[:30] * 6), True),  # a cycle of 30 terms
        (" ".join(f"{w} 수강강의" if i % 2 else w for i, w in enumerate(LISTED[:30] * 6)), True),  # nouns that look like words with a particle
        (ENGLISH + " ".join(f"item{chr(97 + i)}" for i in range(26)) * 6, True),
        (COURSES * 3, False),
        ("\n".join(f"{a}: {b} {c}" for a, b, c in zip(NOUNS, NOUNS[20:] + NOUNS[:20], LISTED + LISTED[:4], strict=True)), False),  # a glossary
        ("申请表必须提交, 逾期的不予受理, 学生应到办公室, 课程将于下周开始, 成绩在网上公布, 费用不退, 请到教务处办理的, 名单已经公布了, " + "在" + ", 在".join(LISTED[:30]), False),
        (SOUND * 6 + " ".join(NOUNS), False),
        (unicodedata.normalize("NFD", SOUND), False),  # decomposed
    ],
)
def test_noun_lists_and_long_cycles(text, stuffed):
    assert stuffing.stuffed(text) is stuffed
