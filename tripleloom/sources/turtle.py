"""Turtle and N-Triples: parser, package rules, reader and sink."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.sparql.compile import TRIPLES
from tripleloom.sparql.parser import RDF_TYPE, XSD, SparqlError, string_value, tokens, unescape

PAGE = re.compile(r"page-(\d{3})\.ttl")


class TurtleError(ValueError):
    """The text is no Turtle, or the package is not complete."""


class _Turtle:
    def __init__(self, text: str):
        text = re.sub(r"@prefix\b", "PREFIX", re.sub(r"@base\b", "BASE", text))
        try:
            self.tokens = tokens(text)
        except SparqlError as error:
            raise TurtleError(str(error)) from error
        self.at, self.nodes = 0, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.out: list[tuple] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def op(self, *values: str) -> bool:
        kind, value = self.peek()
        return kind == "op" and value in values

    def blank(self) -> tuple:
        self.nodes += 1
        return ("bnode", f"_:n{self.nodes}", "", "")

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if kind == "word" and value.upper() in ("PREFIX", "BASE"):
                self.next()
                if value.upper() == "BASE":
                    self.base = self.next()[1][1:-1]
                else:
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.next()[1][1:-1]
                if self.op("."):
                    self.next()
                continue
            subject = self.term()
            if not self.op("."):
                self.properties(subject)
            if not self.op("."):
                raise TurtleError(f"expected . before {self.peek()[1]!r}")
            self.next()
        return self.out

    def properties(self, subject: tuple) -> None:
        while True:
            kind, value = self.peek()
            if kind == "word" and value == "a":
                self.next()
                verb = RDF_TYPE
            else:
                verb = self.term()[1]
            while True:
                self.out.append((subject[1], verb, *self.term()))
                if not self.op(","):
                    break
                self.next()
            if not self.op(";"):
                return
            while self.op(";"):
                self.next()
            if self.op(".", "]"):
                return

    def term(self) -> tuple:
        kind, value = self.next()
        if kind == "iri":
            inner = unescape(value[1:-1])
            return ("iri", inner if re.match(r"[A-Za-z][\w+.-]*:", inner) else self.base + inner, "", "")
        if kind == "pname":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix}:")
            return ("iri", self.prefixes[prefix] + local, "", "")
        if kind == "bnode":
            return ("bnode", value, "", "")
        if kind == "op" and value == "[":
            node = self.blank()
            if not self.op("]"):
                self.properties(node)
            if self.next()[1] != "]":
                raise TurtleError("expected ]")
            return node
        if kind == "string":
            text = string_value(value)
            if self.peek()[0] == "lang":
                return ("literal", text, "", self.next()[1][1:].lower())
            if self.op("^^"):
                self.next()
                return ("literal", text, self.term()[1], "")
            return ("literal", text, "", "")
        if kind == "op" and value in "+-" and self.peek()[0] == "number":
            number = self.term()
            return ("literal", (value if value == "-" else "") + number[1], number[2], "")
        if kind == "number":
            return ("literal", value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), "")
        if kind == "word" and value in ("true", "false"):
            return ("literal", value, XSD + "boolean", "")
        raise TurtleError(f"unexpected {value!r}")


def parse_turtle(text: str, component: str = "") -> list[tuple]:
    """Distinct triples (s, p, o_kind, o_value, o_datatype, o_lang, component) of a Turtle text."""
    return [(*row, component) for row in dict.fromkeys(_Turtle(text).parse())]


def ontology_files(path: str | Path) -> list[Path]:
    """The files of a package in order: one file, or a profile and pages numbered 001.. without a gap."""
    root = Path(path)
    if root.is_file():
        if root.suffix != ".ttl":
            raise TurtleError(f"{root.name} is no Turtle file")
        return [root]
    profile = root / "profile.ttl"
    if not profile.is_file():
        raise TurtleError("profile.ttl is missing")
    pages = sorted(p for p in (root / "pages").glob("*.ttl") if PAGE.fullmatch(p.name))
    other = [p for p in root.rglob("*.ttl") if p != profile and p not in pages]
    if other:
        raise TurtleError(f"Unexpected Turtle file {other[0].relative_to(root)}")
    if [int(PAGE.fullmatch(p.name)[1]) for p in pages] != list(range(1, len(pages) + 1)) or not pages:
        raise TurtleError("page numbers must be contiguous from 001")
    return [profile, *pages]


def read_package(spark: SparkSession, path: str | Path) -> DataFrame:
    """Triples of a package; each file is parsed in a task, the component is the file's stem."""
    files = ontology_files(path)
    names = spark.createDataFrame([(str(f.resolve()), f.stem, i) for i, f in enumerate(files)], "path string, component string, place int")
    texts = spark.read.format("binaryFile").load([str(f) for f in files]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("content").cast("string").alias("text"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [row for text, component in zip(batch["text"], batch["component"], strict=True) for row in parse_turtle(text, component)]
            yield pd.DataFrame(rows, columns=["s", "p", "o_kind", "o_value", "o_datatype", "o_lang", "component"])

    return texts.join(F.broadcast(names), "path").select("text", "component").mapInPandas(run, TRIPLES)


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): one line for each distinct triple, ready for a text sink."""
    quoted = F.col("o_value")
    for found, made in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(found), F.lit(made))
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.coalesce("o_lang", F.lit("")) != "", F.concat(F.lit("@"), F.col("o_lang"))).when(F.coalesce("o_datatype", F.lit("")) != "", F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), quoted, F.lit('"'), tail)).otherwise(node(F.col("o_value")))
    return triples.select(F.concat_ws(" ", node(F.col("s")), node(F.col("p")), obj, F.lit(".")).alias("value")).distinct()
