"""A question's way through draft, link, query and answer, with pluggable models.

The models are functions: ``draft(question, catalog, feedback) -> Draft``,
``choose(pending, candidates) -> [(placeholder, iri, confidence)]`` and
``answer(question, rows, feedback) -> (text, cited, insufficient)``. A draft and an
answer are asked for twice at most, the second time with the reasons of the first
refusal. The query runs exactly once, after every term is resolved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.operators.graph import representative_labels, schema_catalog
from tripleloom.operators.linking import admitted_choices, answer_issues, exact_resolutions, repaired_citations, source_pages, term_candidates
from tripleloom.sparql.gate import Draft, bind_terms, execute, known_iris, safe_select, serialised
from tripleloom.sparql.parser import SparqlError

ATTEMPTS = 2


@dataclass
class Trace:
    question: str
    status: str = "query_generation_failed"
    sparql: str = ""
    terms: dict[str, str] = field(default_factory=dict)
    rows: list[dict] = field(default_factory=list)
    answer: str = ""
    cited: list[int] = field(default_factory=list)
    pages: list[str] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)
    executions: int = 0


class QuestionAnswering:
    def __init__(self, triples: DataFrame, prefixes: dict[str, str], draft: Callable, choose: Callable, answer: Callable, resource_root: str = "", abstract: str | None = None):
        self.triples, self.prefixes = triples, prefixes
        self.draft, self.choose, self.answer = draft, choose, answer
        self.resource_root, self.abstract = resource_root, abstract
        self.known = known_iris(triples).persist()
        self.catalog = [r["line"] for r in schema_catalog(triples, prefixes).collect()]
        self.labels = representative_labels(triples)

    def ask(self, question: str) -> Trace:
        trace = Trace(question)
        try:
            made = self._draft(question, trace)
            if made is None:
                return trace
            made_draft, text = made
            trace.status = "term_unresolved"
            if not self._link(made_draft, trace):
                return trace
            trace.status = "query_execution_failed"
            trace.sparql = safe_select(bind_terms(text, trace.terms))
            trace.executions += 1
            trace.rows = serialised(execute(self.triples, trace.sparql, self.prefixes), self.labels)
        except SparqlError as error:
            trace.issues.append(str(error))
            return trace
        trace.status = "no_result"
        if not trace.rows:
            return trace
        trace.status = "answer_generation_failed"
        return self._answer(question, trace)

    def _draft(self, question: str, trace: Trace) -> tuple[Draft, str] | None:
        for _ in range(ATTEMPTS):
            made = self.draft(question, self.catalog, list(trace.issues))
            try:
                return made, made.check(self.known, self.prefixes, self.resource_root, self.abstract)
            except SparqlError as error:
                trace.issues.append(str(error))
        return None

    def _link(self, made: Draft, trace: Trace) -> bool:
        if not made.terms:
            return True
        spark = self.triples.sparkSession
        names = sorted(made.terms)
        asked = spark.createDataFrame([(i, *made.terms[n]) for i, n in enumerate(names)], "mention_id long, mention string, expected_type string")
        found = term_candidates(asked, self.triples).persist()
        for r in exact_resolutions(found).collect():
            trace.terms[names[r["mention_id"]]] = r["iri"]
        pending = [n for n in names if n not in trace.terms]
        if pending:
            options = {n: [] for n in pending}
            for r in found.collect():
                if names[r["mention_id"]] in options:
                    options[names[r["mention_id"]]].append((r["iri"], r["label"], r["score"]))
            chosen = self.choose({n: made.terms[n] for n in pending}, options)
            rows = [(names.index(n), iri, float(c)) for n, iri, c in chosen if n in pending]
            if rows:
                table = spark.createDataFrame(rows, "mention_id long, iri string, confidence double")
                for r in admitted_choices(table, found).collect():
                    trace.terms[names[r["mention_id"]]] = r["iri"]
        return len(trace.terms) == len(names)

    def _answer(self, question: str, trace: Trace) -> Trace:
        spark = self.triples.sparkSession
        reasons: list[str] = []
        for _ in range(ATTEMPTS):
            text, cited, insufficient = self.answer(question, trace.rows, reasons)
            one = spark.createDataFrame([(text, [int(c) for c in cited], len(trace.rows), bool(insufficient))], "a string, c array<int>, n int, i boolean")
            one = one.withColumn("c", repaired_citations(F.col("c"), F.col("n")))
            row = one.select("c", answer_issues(F.col("a"), F.col("c"), F.col("n"), F.col("i")).alias("issues")).first()
            if not row["issues"]:
                trace.answer, trace.cited = text, list(row["c"])
                pages = [trace.rows[i].get("sourcePage", {}).get("value") for i in trace.cited]
                trace.pages = spark.createDataFrame([(pages,)], "p array<string>").select(source_pages(F.col("p"))).first()[0]
                trace.status = "no_result" if insufficient else "answered"
                return trace
            reasons = list(row["issues"])
        trace.issues += reasons
        return trace
