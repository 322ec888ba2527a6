"""Algebra tree to DataFrame plan.

Every variable is one column holding a term struct ``(k, v, d, l)``: kind, value,
datatype and language, none of them null; an unbound variable is a null struct. A
sub-plan knows which of its variables are certainly bound, so joins are plain
equi-joins wherever that is known. SPARQL errors are nulls, and nullable booleans
give its three-valued logic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.session import BROADCAST_KEY_LIMIT, materialise
from tripleloom.sparql import parser as P
from tripleloom.sparql.parser import XSD, SparqlError, Var

TERM = T.StructType([T.StructField(n, T.StringType(), False) for n in ("k", "v", "d", "l")])
TRIPLES = "s string, p string, o_kind string, o_value string, o_datatype string, o_lang string, component string"
NUMERIC = [XSD + n for n in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong")]
INTEGERS = [n for n in NUMERIC if n not in (XSD + "decimal", XSD + "double", XSD + "float")]
INTEGER, DECIMAL, DOUBLE, BOOLEAN, STRING = (XSD + n for n in ("integer", "decimal", "double", "boolean", "string"))
DATES = [XSD + n for n in ("date", "dateTime", "dateTimeStamp")]


def name_of(var: Var) -> str:
    return "v_" + re.sub(r"\W", "_", var.name)


def term_column(kind: Column | str, value: Column, datatype: Column | str = "", lang: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("k"), value.alias("v"), lit(datatype).alias("d"), lit(lang).alias("l"))


def constant(term: tuple) -> Column:
    return term_column(term[0], F.lit(term[1]), term[2], term[3])


@dataclass
class Rel:
    """A solution sequence: its variables, and those certainly bound."""

    df: DataFrame
    variables: list[Var]
    certain: set[Var]
    #: Of a single solution made of constants alone: its values. It joins as columns, without a join.
    constants: dict[Var, Column] | None = None


@dataclass
class E:
    """An expression's value: kind term, bool, num (with datatype) or str (with language)."""

    kind: str
    col: Column
    extra: Column | None = None
    #: The exact value of an integer as decimal(38, 0); doubles hold integers up to 2^53 only.
    exact: Column | None = None

    def whole(self) -> Column:
        """The exact value if it is an integer, else null."""
        if self.kind == "term":
            return F.when((self.col.k == "literal") & self.col.d.isin(INTEGERS), self.col.v.try_cast("decimal(38,0)"))
        return self.exact if self.kind == "num" and self.exact is not None else F.lit(None).cast("decimal(38,0)")

    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        if self.kind == "bool":
            made = term_column("literal", self.col.cast("string"), BOOLEAN)
        elif self.kind == "num":
            whole = self.extra == INTEGER
            exact = [] if self.exact is None else [self.exact.cast("string")]
            text = F.when(whole, F.coalesce(*exact, self.col.cast("bigint").cast("string"))).otherwise(self.col.cast("string"))
            made = term_column("literal", text, self.extra)
        else:
            made = term_column("literal", self.col, "", self.extra if self.extra is not None else "")
        return F.when(self.col.isNotNull(), made)

    def num(self) -> Column:
        if self.kind == "num":
            return self.col
        if self.kind == "term":
            return F.when((self.col.k == "literal") & self.col.d.isin(NUMERIC), F.expr("1") * self.col.v.try_cast("double"))
        return F.lit(None).cast("double")

    def datatype(self) -> Column:
        """The numeric datatype: integer stays, other integers become integer."""
        if self.kind == "num":
            return self.extra
        if self.kind == "term":
            d = self.col.d
            return F.when(d.isin(DECIMAL, DOUBLE, XSD + "float"), d).otherwise(F.lit(INTEGER))
        return F.lit(INTEGER)

    def str(self) -> Column:
        if self.kind == "str":
            return self.col
        if self.kind == "term":
            return F.when(self.col.k != "bnode", self.col.v)
        return self.term().v

    def text(self) -> Column:
        """A string literal's text; null for other terms."""
        if self.kind == "str":
            return self.col
        if self.kind == "term":
            return F.when((self.col.k == "literal") & self.col.d.isin("", STRING), self.col.v)
        return F.lit(None).cast("string")

    def lang(self) -> Column:
        if self.kind == "str":
            return self.extra if self.extra is not None else F.lit("")
        return self.col.l if self.kind == "term" else F.lit("")

    def stamp(self) -> Column:
        if self.kind == "term":
            return F.when((self.col.k == "literal") & self.col.d.isin(DATES), self.col.v.try_cast("timestamp"))
        return F.lit(None).cast("timestamp")

    def bool(self) -> Column:
        """Effective boolean value."""
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return (self.col != 0) & ~F.isnan(self.col)
        if self.kind == "str":
            return self.col != ""
        c = self.col
        return (
            F.when(c.k != "literal", F.lit(None).cast("boolean"))
            .when(c.d == BOOLEAN, c.v.isin("true", "1"))
            .when(c.d.isin(NUMERIC), F.coalesce(c.v.try_cast("double") != 0, F.lit(False)))
            .when(c.d.isin("", STRING), c.v != "")
        )


def _has_exists(expr: Any) -> bool:
    return isinstance(expr, tuple) and not isinstance(expr, Var) and (expr[:1] in (("EXISTS",), ("NOT EXISTS",)) or any(_has_exists(x) for x in expr[1:]))


def _variables(expr: Any) -> set[Var]:
    if isinstance(expr, Var):
        return {expr}
    return set().union(*map(_variables, expr)) if isinstance(expr, (tuple, list)) else set()


def order_key(term: Column) -> Column:
    """Unbound, blank nodes, IRIs, literals; numbers and dates by value."""
    e = E("term", term)
    rank = F.when(term.isNull(), 0).when(term.k == "bnode", 1).when(term.k == "iri", 2).otherwise(3)
    return F.struct(rank.alias("rank"), e.num().alias("num"), e.stamp().alias("stamp"), F.coalesce(term.v, F.lit("")).alias("text"))


class Compiler:
    def __init__(self, triples: DataFrame):
        self.triples = triples
        self.spark = triples.sparkSession
        self.fresh = 0

    def hidden(self) -> Var:
        self.fresh += 1
        return Var(f".c{self.fresh}")

    # ---- joins -------------------------------------------------------------------
    def _with_constants(self, rel: Rel, given: Rel) -> Rel:
        """``rel`` joined with a single solution of constants."""
        df, variables = rel.df, list(rel.variables)
        for v, value in given.constants.items():
            if v not in variables:
                df = df.withColumn(name_of(v), value)
                variables.append(v)
            elif v in rel.certain:
                df = df.where(F.col(name_of(v)) == value)
            else:
                df = df.where(F.col(name_of(v)).isNull() | (F.col(name_of(v)) == value)).withColumn(name_of(v), value)
        constants = {**rel.constants, **given.constants} if rel.constants is not None and not set(rel.constants) & set(given.constants) else None
        return Rel(df, variables, rel.certain | set(given.constants), constants)

    def join(self, left: Rel, right: Rel) -> Rel:
        if left.constants is not None:
            return self._with_constants(right, left)
        if right.constants is not None:
            return self._with_constants(left, right)
        shared = [v for v in left.variables if v in right.variables]
        both = [v for v in shared if v in left.certain and v in right.certain]
        loose = [v for v in shared if v not in both]
        if loose and not both:
            return self._split_join(left, right, loose[0])
        renamed = right.df.select(*[F.col(name_of(v)).alias(("r_" if v in shared else "") + name_of(v)) for v in right.variables])
        condition = [F.col(name_of(v)) == F.col("r_" + name_of(v)) for v in both]
        condition += [self._compatible(v) for v in loose]
        joined = left.df.join(renamed, reduce(lambda a, b: a & b, condition)) if condition else left.df.crossJoin(renamed)
        columns = [F.coalesce(name_of(v), "r_" + name_of(v)).alias(name_of(v)) if v in loose else F.col(name_of(v)) for v in left.variables]
        more = [v for v in right.variables if v not in shared]
        return Rel(joined.select(*columns, *[name_of(v) for v in more]), left.variables + more, left.certain | right.certain)

    @staticmethod
    def _compatible(v: Var) -> Column:
        a, b = F.col(name_of(v)), F.col("r_" + name_of(v))
        return (a == b) | a.isNull() | b.isNull()

    def _split_join(self, left: Rel, right: Rel, v: Var) -> Rel:
        """Join on a variable that may be unbound: bound rows by equality, only the unbound ones apart."""
        lefts, rights = self._written_halves(left, v, right), self._written_halves(right, v, left)
        parts = [self.join(lefts[0], rights[0])]
        if v not in left.certain:
            parts += [self.join(lefts[1], half) for half in rights if half is not None]
        if v not in right.certain:
            parts.append(self.join(lefts[0], rights[1]))
        return self.union(parts, certain=left.certain | right.certain)

    def union(self, parts: list[Rel], certain: set[Var] | None = None) -> Rel:
        variables = list(dict.fromkeys(v for p in parts for v in p.variables))
        aligned = [p.df.select(*[F.col(name_of(v)) if v in p.variables else F.lit(None).cast(TERM).alias(name_of(v)) for v in variables]) for p in parts]
        out = reduce(lambda a, b: a.unionByName(b), aligned)
        return Rel(out, variables, certain if certain is not None else set.intersection(*[p.certain for p in parts]))

    def _halves(self, rel: Rel, v: Var) -> tuple[Rel, Rel]:
        """Rows that bind ``v``, and those that don't, without it."""
        c = name_of(v)
        bound = Rel(rel.df.where(F.col(c).isNotNull()), rel.variables, rel.certain | {v})
        return bound, Rel(rel.df.where(F.col(c).isNull()).drop(c), [x for x in rel.variables if x != v], rel.certain - {v})

    def _written_halves(self, rel: Rel, v: Var, other: Rel) -> tuple[Rel, Rel | None]:
        """As ``_halves``, to be joined with ``other``; the second is None if ``v`` is certain.

        ``rel`` is written, not computed for each half. The rows that don't bind ``v`` often
        meet all of ``other`` without a key: a few are broadcast to it, where a product of
        partitions would hold and spill one side for each pair. If either side is so small
        that Spark broadcasts it by itself, that is left to Spark.
        """
        if v in rel.certain:
            return rel, None
        bound, bare = self._halves(Rel(materialise(rel.df, "halves"), rel.variables, rel.certain), v)
        small = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        sizes = [int(str(r.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for r in (bare, other)]
        if min(sizes) > small and bare.df.limit(BROADCAST_KEY_LIMIT + 1).count() <= BROADCAST_KEY_LIMIT:
            bare = Rel(F.broadcast(bare.df), bare.variables, bare.certain)
        return bound, bare

    def left_join(self, left: Rel, right: Rel, conditions: list) -> Rel:
        loose = next((v for v in left.variables if v in right.certain and v not in left.certain), None)
        if loose is not None:
            # rows that bind the variable join by equality, the others without it
            parts = [self.left_join(half, right, conditions) for half in self._written_halves(left, loose, right)]
            return self.union(parts, certain=set(left.certain))
        shared = [v for v in left.variables if v in right.variables]
        if not shared and not any(_has_exists(c) or _variables(c) & set(left.variables) for c in conditions):
            # nothing ties the sides: a product with the rows that pass, or the left side alone
            passing = reduce(lambda df, c: df.where(self.expression(c, self.columns(right)).bool()), conditions, right.df)
            if not passing.isEmpty():
                out = self.join(left, Rel(passing, right.variables, right.certain))
                return Rel(out.df, out.variables, set(left.certain))
            nothing = {name_of(v): F.lit(None).cast(TERM) for v in right.variables}
            return Rel(left.df.withColumns(nothing) if nothing else left.df, left.variables + right.variables, set(left.certain))
        renamed = right.df.select(*[F.col(name_of(v)).alias(("r_" if v in shared else "") + name_of(v)) for v in right.variables])
        merged = list(dict.fromkeys(left.variables + right.variables))
        columns = {v: F.coalesce(name_of(v), "r_" + name_of(v)) if v in shared else F.col(name_of(v)) for v in merged}
        tests = [F.col(name_of(v)) == F.col("r_" + name_of(v)) if v in left.certain and v in right.certain else self._compatible(v) for v in shared]
        # the filter of an optional part belongs to the join condition
        tests += [F.coalesce(self.expression(c, columns).bool(), F.lit(False)) for c in conditions]
        on = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
        joined = left.df.join(renamed, on, "left")
        out = joined.select(*[columns[v].alias(name_of(v)) for v in merged])
        return Rel(out, merged, set(left.certain))

    def anti_or_semi(self, left: Rel, right: Rel, how: str, need_shared: bool, conditions: list = ()) -> Rel:
        shared = [v for v in left.variables if v in right.variables]
        if need_shared and not shared:
            return left
        loose = next((v for v in shared if v in right.certain and v not in left.certain), None)
        if loose is not None:
            bound, bare = self._halves(left, loose)
            parts = [self.anti_or_semi(half, right, how, need_shared, conditions) for half in (bound, bare)]
            return self.union(parts, certain=set(left.certain))
        odd = next((v for v in shared if v in left.certain and v not in right.certain), None)
        if odd is not None and len(shared) > 0 and not conditions:
            with_it, without = self._halves(right, odd)
            if how == "left_anti":
                return self.anti_or_semi(self.anti_or_semi(left, with_it, how, need_shared), without, how, need_shared)
            rest = self.anti_or_semi(left, with_it, "left_anti", False)
            return self.union([self.anti_or_semi(left, with_it, how, need_shared), self.anti_or_semi(rest, without, how, need_shared)], certain=set(left.certain))
        renamed = right.df.select(*[F.col(name_of(v)).alias(("r_" if v in shared else "") + name_of(v)) for v in right.variables])
        tests = [F.col(name_of(v)) == F.col("r_" + name_of(v)) if v in left.certain and v in right.certain else self._compatible(v) for v in shared]
        if need_shared and not any(v in left.certain and v in right.certain for v in shared):
            tests.append(reduce(lambda a, b: a | b, [F.col(name_of(v)).isNotNull() & F.col("r_" + name_of(v)).isNotNull() for v in shared]))
        columns = {v: F.col(name_of(v)) for v in list(left.variables) + [x for x in right.variables if x not in shared]}
        tests += [F.coalesce(self.expression(c, columns).bool(), F.lit(False)) for c in conditions]
        on = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
        return Rel(left.df.join(renamed, on, how), left.variables, left.certain)

    # ---- patterns ------------------------------------------------------------------
    def compile(self, node: Any) -> Rel:
        if isinstance(node, P.BGP):
            return self.bgp(node.patterns)
        if isinstance(node, P.Join):
            return self.join(self.compile(node.left), self.compile(node.right))
        if isinstance(node, P.LeftJoin):
            return self.left_join(self.compile(node.left), self.compile(node.right), node.conditions)
        if isinstance(node, P.Union):
            return self.union([self.compile(p) for p in node.parts])
        if isinstance(node, P.Minus):
            return self.anti_or_semi(self.compile(node.left), self.compile(node.right), "left_anti", True)
        if isinstance(node, P.Filter):
            return self.filter(self.compile(node.child), node.condition)
        if isinstance(node, P.Extend):
            child = self.compile(node.child)
            if node.var in child.variables:
                raise SparqlError(f"?{node.var.name} is already bound")
            if _has_exists(node.expr):
                flagged, expr = self._flagged(child, node.expr)
                value = self.expression(expr, self.columns(child)).term().alias(name_of(node.var))
                return Rel(flagged.df.select(*[name_of(v) for v in child.variables], value), [*child.variables, node.var], child.certain)
            value = self.expression(node.expr, self.columns(child))
            sure = isinstance(node.expr, tuple) and node.expr[:1] in (("iri",), ("literal",))
            constants = {**child.constants, node.var: value.term()} if sure and child.constants is not None else None
            return Rel(child.df.withColumn(name_of(node.var), value.term()), [*child.variables, node.var], child.certain | ({node.var} if sure else set()), constants)
        if isinstance(node, P.Values):
            rows = [[None if t is None else tuple(t) for t in row] for row in node.rows]
            schema = T.StructType([T.StructField(name_of(v), TERM) for v in node.variables])
            certain = {v for i, v in enumerate(node.variables) if all(r[i] is not None for r in node.rows)}
            return Rel(self.spark.createDataFrame(rows, schema), list(node.variables), certain)
        if isinstance(node, P.Select):
            return self.select(node)
        raise SparqlError(f"unsupported pattern {type(node).__name__}")

    @staticmethod
    def columns(rel: Rel) -> dict[Var, Column]:
        return {v: F.col(name_of(v)) for v in rel.variables}

    def filter(self, rel: Rel, condition: Any) -> Rel:
        if isinstance(condition, tuple) and condition[0] == "&&":
            return self.filter(self.filter(rel, condition[1]), condition[2])
        if isinstance(condition, tuple) and condition[0] == "!" and isinstance(condition[1], tuple) and condition[1][0] in ("EXISTS", "NOT EXISTS"):
            inner = condition[1]
            condition = ("EXISTS" if inner[0] == "NOT EXISTS" else "NOT EXISTS", inner[1])
        if isinstance(condition, tuple) and condition[0] in ("EXISTS", "NOT EXISTS"):
            pattern, tests = condition[1], []
            while isinstance(pattern, P.Filter):  # its filters may name outer variables
                tests.append(pattern.condition)
                pattern = pattern.child
            return self.anti_or_semi(rel, self.compile(pattern), "left_semi" if condition[0] == "EXISTS" else "left_anti", False, tests)
        bound = {condition[1]} if isinstance(condition, tuple) and condition[0] == "BOUND" else set()
        if _has_exists(condition):
            flagged, test = self._flagged(rel, condition)
            return Rel(flagged.df.where(self.expression(test, self.columns(rel)).bool()).select(*[name_of(v) for v in rel.variables]), rel.variables, rel.certain)
        return Rel(rel.df.where(self.expression(condition, self.columns(rel)).bool()), rel.variables, rel.certain | bound)

    def _flagged(self, rel: Rel, expr: Any) -> tuple[Rel, Any]:
        """``rel`` with a boolean column for each EXISTS inside ``expr``, and the expression over those columns."""
        if not _has_exists(expr):
            return rel, expr
        if expr[0] not in ("EXISTS", "NOT EXISTS"):
            parts = [expr[0]]
            for part in expr[1:]:
                rel, part = self._flagged(rel, part)
                parts.append(part)
            return rel, tuple(parts)
        row, flag = self.hidden(), f"x_{self.fresh}"
        # numbered once and written: the numbers must not change between the two uses
        rows = materialise(rel.df.withColumn(name_of(row), F.monotonically_increasing_id()), "exists-rows")
        asked = Rel(rows.select(*[name_of(v) for v in rel.variables], name_of(row)), [*rel.variables, row], rel.certain | {row})
        pattern, tests = expr[1], []
        while isinstance(pattern, P.Filter):
            tests.append(pattern.condition)
            pattern = pattern.child
        met = self.anti_or_semi(asked, self.compile(pattern), "left_semi", False, tests).df.select(name_of(row)).distinct().withColumn(flag, F.lit(True))
        found = F.coalesce(F.col(flag), F.lit(False))
        out = rows.join(met, name_of(row), "left").withColumn(flag, found if expr[0] == "EXISTS" else ~found).drop(name_of(row))
        return Rel(out, rel.variables, rel.certain), ("flag", flag)

    def bgp(self, patterns: list) -> Rel:
        if not patterns:
            return Rel(self.spark.range(1).select(), [], set(), {})
        left = list(patterns)
        fixed = lambda p: sum(isinstance(x, tuple) for x in (p.s, p.p, p.o)) + (isinstance(p.s, tuple) or isinstance(p.o, tuple))
        variables = lambda p: {x for x in (p.s, p.p, p.o) if isinstance(x, Var)}
        first = max(left, key=fixed)
        left.remove(first)
        rel = self.pattern(first)
        while left:
            # always a connected pattern if there is one: no cartesian product arises
            after = max(left, key=lambda p: (bool(variables(p) & set(rel.variables)) or not variables(p), fixed(p)))
            left.remove(after)
            rel = self.then(rel, after)
        return rel

    def then(self, rel: Rel, p: P.Pattern) -> Rel:
        """``rel`` joined with a pattern; a reflexive path from or to a bound variable starts from its values."""
        if isinstance(p.p, P.Path) and p.p.kind in ("star", "opt"):
            if isinstance(p.s, Var) and p.s in rel.certain:
                return self._reached(rel, p.s, p.p, p.o, False)
            if isinstance(p.o, Var) and p.o in rel.certain:
                return self._reached(rel, p.o, p.p, p.s, True)
        return self.join(rel, self.pattern(p))

    def _reached(self, rel: Rel, s: Var, path: P.Path, o: Any, back: bool) -> Rel:
        """Solutions extended by the nodes reached from ``s``: itself, and others over one step or more."""
        a, b = Var(".ca"), Var(".cb")
        inner = self.path_pattern(a, path.parts[0], b)
        first, second = (b, a) if back else (a, b)
        pairs = inner.df.select(F.col(name_of(first)).alias("a"), F.col(name_of(second)).alias("b")).distinct()
        pairs = (pairs if path.kind == "opt" else closure(pairs, None)).where(F.col("a") != F.col("b"))
        target = o if isinstance(o, Var) else self.hidden()
        if not isinstance(o, Var):
            pairs = pairs.where(F.col("b") == constant(o))
        if target in rel.variables:
            same = Rel(rel.df.where(F.col(name_of(target)) == F.col(name_of(s))), rel.variables, rel.certain)
        else:
            itself = rel.df.withColumn(name_of(target), F.col(name_of(s)))
            same = Rel(itself if isinstance(o, Var) else itself.where(F.col(name_of(s)) == constant(o)), [*rel.variables, target], rel.certain | {target})
        others = self.join(rel, Rel(pairs.select(F.col("a").alias(name_of(s)), F.col("b").alias(name_of(target))), [s, target], {s, target})) if target != s else Rel(rel.df.limit(0), rel.variables, rel.certain)
        out = self.union([same, others], certain=same.certain & others.certain)
        keep = [v for v in out.variables if isinstance(o, Var) or v != target]
        return Rel(out.df.select(*[name_of(v) for v in keep]), keep, out.certain & set(keep))

    def pattern(self, p: P.Pattern) -> Rel:
        if isinstance(p.p, P.Path):
            return self.path_pattern(p.s, p.p, p.o)
        t = self.triples
        tests: list[Column] = []
        out: list[tuple[Var, Column]] = []
        subject = term_column(F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri"), F.col("s"))
        if isinstance(p.s, tuple):
            tests.append(F.col("s") == p.s[1])
        else:
            out.append((p.s, subject))
        if isinstance(p.p, tuple):
            tests.append(F.col("p") == p.p[1])
        else:
            out.append((p.p, term_column("iri", F.col("p"))))
        if isinstance(p.o, tuple):
            tests += [F.col("o_kind") == p.o[0], F.col("o_value") == p.o[1]]
            if p.o[0] == "literal":
                tests += [F.coalesce("o_datatype", F.lit("")) == p.o[2], F.coalesce("o_lang", F.lit("")) == p.o[3]]
        else:
            out.append((p.o, term_column(F.col("o_kind"), F.col("o_value"), F.coalesce("o_datatype", F.lit("")), F.coalesce("o_lang", F.lit("")))))
        for test in tests:
            t = t.where(test)
        variables: list[Var] = []
        columns: dict[Var, Column] = {}
        for v, c in out:
            if v in columns:
                t = t.where(columns[v] == c)
            else:
                columns[v] = c
                variables.append(v)
        return Rel(t.select(*[columns[v].alias(name_of(v)) for v in variables]), variables, set(variables))

    # ---- property paths --------------------------------------------------------------
    def path_pattern(self, s: Any, path: P.Path, o: Any) -> Rel:
        if path.kind == "link":
            return self.pattern(P.Pattern(s, path.parts[0], o))
        if path.kind == "inverse":
            return self.path_pattern(o, path.parts[0], s)
        if path.kind == "seq":
            nodes = [s, *[self.hidden() for _ in path.parts[1:]], o]
            rel = None
            for part, (a, b) in zip(path.parts, zip(nodes[:-1], nodes[1:], strict=True), strict=True):
                rel = self.path_pattern(a, part, b) if rel is None else self.then(rel, P.Pattern(a, part, b))
            keep = [v for v in rel.variables if not v.name.startswith(".c") or v in (s, o)]
            return Rel(rel.df.select(*[name_of(v) for v in keep]), keep, rel.certain & set(keep))
        if path.kind == "alt":
            return self.union([self.path_pattern(s, part, o) for part in path.parts])
        if path.kind == "neg":
            parts = []
            for back in (False, True):
                named = [t for b, t in path.parts if b == back]
                if named or not back:
                    if back or any(not b for b, _ in path.parts):
                        parts.append(self._negated([t[1] for t in named], *((o, s) if back else (s, o))))
            return self.union(parts)
        return self._closure_pattern(s, path, o)

    def _negated(self, predicates: list[str], s: Any, o: Any) -> Rel:
        outer = self.triples
        try:
            self.triples = outer.where(~F.col("p").isin(predicates)) if predicates else outer
            verb = self.hidden()
            rel = self.pattern(P.Pattern(s, verb, o))
        finally:
            self.triples = outer
        keep = [v for v in rel.variables if v != verb]
        return Rel(rel.df.select(*[name_of(v) for v in keep]), keep, set(keep))

    def _closure_pattern(self, s: Any, path: P.Path, o: Any) -> Rel:
        a, b = Var(".ca"), Var(".cb")
        inner = self.path_pattern(a, path.parts[0], b)
        pairs = inner.df.select(F.col(name_of(a)).alias("a"), F.col(name_of(b)).alias("b")).distinct()
        backward = not isinstance(s, tuple) and isinstance(o, tuple)
        if backward:  # walk from the constant end
            pairs = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
            s, o = o, s
        start = s if isinstance(s, tuple) else None
        if path.kind == "opt":
            found = pairs if start is None else pairs.where(F.col("a") == constant(start))
        else:
            found = closure(pairs, None if start is None else constant(start))
        if path.kind != "plus":
            if start is not None:
                self_pair = self.spark.range(1).select(constant(start).alias("a"), constant(start).alias("b"))
            else:
                nodes = self.triples.select(term_column(F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri"), F.col("s")).alias("a")).union(
                    self.triples.select(term_column(F.col("o_kind"), F.col("o_value"), F.coalesce("o_datatype", F.lit("")), F.coalesce("o_lang", F.lit(""))).alias("a"))
                )
                self_pair = nodes.distinct().select("a", F.col("a").alias("b"))
            found = found.unionByName(self_pair).distinct()
        variables, df = [], found
        if isinstance(o, tuple):
            df = df.where(F.col("b") == constant(o))
        if isinstance(s, Var) and s == o:
            df = df.where(F.col("a") == F.col("b"))
        columns = []
        for v, c in ((s, "a"), (o, "b")):
            if isinstance(v, Var) and v not in variables:
                variables.append(v)
                columns.append(F.col(c).alias(name_of(v)))
        return Rel(df.select(*columns), variables, set(variables))

    # ---- select ----------------------------------------------------------------------
    def select(self, q: P.Select) -> Rel:
        rel = self.compile(q.child)
        extends = list(q.extends)
        order = list(q.order)
        if q.aggregated:
            rel, extends, having, order = self.grouped(rel, q)
            for condition in having:
                rel = self.filter(rel, condition)
        for var, expr in extends:
            if var in rel.variables:
                continue
            rel = Rel(rel.df.withColumn(name_of(var), self.expression(expr, self.columns(rel)).term()), [*rel.variables, var], rel.certain)
        if order:
            keys = [order_key(self.expression(e, self.columns(rel)).term()) for e, _ in order]
            sorts = [k.asc() if up else k.desc() for k, (_, up) in zip(keys, order, strict=True)]
        variables = q.variables if q.variables is not None else [v for v in rel.variables if not v.name.startswith(".")]
        missing = [v for v in variables if v not in rel.variables]
        df = rel.df
        for v in missing:
            df = df.withColumn(name_of(v), F.lit(None).cast(TERM))
        if order:
            df = df.orderBy(*sorts)
        df = df.select(*[name_of(v) for v in variables])
        if q.distinct:
            df = df.distinct()
            if order:
                plain = {v: F.col(name_of(v)) for v in variables}
                if all(isinstance(e, Var) and e in plain for e, _ in order):
                    df = df.orderBy(*[(order_key(plain[e]).asc() if up else order_key(plain[e]).desc()) for e, up in order])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rel(df, list(variables), rel.certain & set(variables))

    def grouped(self, rel: Rel, q: P.Select):
        columns = self.columns(rel)
        keys: list[tuple[Var, Column]] = []
        for var, expr in q.group:
            v = var or self.hidden()
            keys.append((v, columns[expr] if isinstance(expr, Var) and expr in columns else self.expression(expr, columns).term()))
        aggregates: dict[str, tuple[Var, list[Column]]] = {}
        kinds: dict[Var, tuple[str, str | None]] = {}

        def lift(expr: Any) -> Any:
            if not isinstance(expr, tuple):
                return expr
            if expr[:1] == ("agg",):
                text = repr(expr)
                if text not in aggregates:
                    v = self.hidden()
                    made, kind = self.aggregate(expr, columns, name_of(v))
                    aggregates[text] = (v, made)
                    kinds[v] = kind
                return aggregates[text][0]
            if expr[0] in ("iri", "literal", "bnode") and len(expr) == 4 and all(isinstance(x, str) for x in expr):
                return expr
            return (expr[0], *[lift(e) for e in expr[1:]])

        extends = [(v, lift(e)) for v, e in q.extends]
        having = [lift(e) for e in q.having]
        order = [(lift(e), up) for e, up in q.order]
        made = [c for _, cs in aggregates.values() for c in cs]
        named = [c.alias(name_of(v)) for v, c in keys]
        grouped = rel.df.select("*", *[c.alias("g_" + name_of(v)) for v, c in keys]).groupBy(*["g_" + name_of(v) for v, _ in keys]) if keys else rel.df.groupBy()
        out = grouped.agg(*(made or [F.count(F.lit(1)).alias("c_none")]))
        out = out.select(*[F.col("g_" + name_of(v)).alias(name_of(v)) for v, _ in keys], *[F.col(name_of(v)) for v, _ in aggregates.values()])
        variables = [v for v, _ in keys] + [v for v, _ in aggregates.values()]
        del named
        certain = {v for v, _ in keys if v in rel.certain}
        return Rel(out, variables, certain), extends, having, order

    def aggregate(self, expr: tuple, columns: dict[Var, Column], name: str):
        _, function, argument, distinct, separator = expr
        if argument == "*":
            if distinct:
                every = F.struct(*columns.values()) if columns else F.lit(1)
                return [E("num", F.count_distinct(every).cast("double"), F.lit(INTEGER)).term().alias(name)], None
            return [E("num", F.count(F.lit(1)).cast("double"), F.lit(INTEGER)).term().alias(name)], None
        value = self.expression(argument, columns)
        term = value.term()
        if function == "COUNT":
            n = F.count_distinct(term) if distinct else F.count(term)
            return [E("num", n.cast("double"), F.lit(INTEGER)).term().alias(name)], None
        if function in ("SUM", "AVG"):
            number = value.num()
            total = (F.sum_distinct(number) if distinct else F.sum(number)) if function == "SUM" else (F.expr("1") * F.avg(number) if not distinct else F.sum_distinct(number) / F.count_distinct(number))
            whole = F.coalesce(F.min((value.datatype() == INTEGER).cast("int")), F.lit(1)) == 1
            double = F.coalesce(F.max(value.datatype().isin(DOUBLE, XSD + "float").cast("int")), F.lit(0)) == 1
            datatype = F.when(double, DOUBLE).when(whole, INTEGER if function == "SUM" else DECIMAL).otherwise(DECIMAL)
            exact = None
            if function == "SUM" and not distinct:  # exact only if every value is an integer
                exact = F.when(F.count(value.whole()) == F.count(number), F.try_sum(value.whole()))
            return [E("num", F.coalesce(total, F.lit(0.0)), datatype, exact).term().alias(name)], None
        if function in ("MIN", "MAX"):
            pick = F.min_by if function == "MIN" else F.max_by
            return [pick(term, F.when(term.isNotNull(), order_key(term))).alias(name)], None
        if function == "SAMPLE":
            return [F.min_by(term, F.when(term.isNotNull(), order_key(term))).alias(name)], None
        texts = F.collect_set(value.str()) if distinct else F.collect_list(value.str())
        return [E("str", F.array_join(F.sort_array(texts), separator)).term().alias(name)], None

    # ---- expressions -------------------------------------------------------------------
    def expression(self, expr: Any, columns: dict[Var, Column]) -> E:
        from tripleloom.sparql.functions import call

        if isinstance(expr, Var):
            return E("term", columns[expr] if expr in columns else F.lit(None).cast(TERM))
        if expr[0] in ("iri", "literal", "bnode") and len(expr) == 4 and isinstance(expr[1], str):
            if expr[0] == "literal" and expr[2] in NUMERIC:
                if expr[2] in (DECIMAL, DOUBLE, XSD + "float"):
                    return E("num", F.lit(float(expr[1])), F.lit(expr[2]))
                return E("num", F.lit(float(expr[1])), F.lit(INTEGER), F.lit(expr[1]).try_cast("decimal(38,0)"))
            if expr[0] == "literal" and expr[2] in ("", STRING):
                return E("str", F.lit(expr[1]), F.lit(expr[3]))
            return E("term", constant(expr))
        if expr[0] in ("EXISTS", "NOT EXISTS"):
            raise SparqlError("EXISTS is supported in filters and bindings only")
        if expr[0] == "flag":
            return E("bool", F.col(expr[1]))
        if expr[0] == "BOUND":
            return E("bool", columns[expr[1]].isNotNull() if expr[1] in columns else F.lit(False))
        return call(expr[0], [a if isinstance(a, str) else self.expression(a, columns) for a in expr[1:]])


#: Pairs of which the closure is made on the driver, such as a class hierarchy; it has at most their square.
SMALL_CLOSURE = 300


def _small_closure(rows: list) -> list[tuple]:
    """Closure of a few pairs: a walk from each node."""
    after: dict = {}
    for a, b in rows:
        after.setdefault(a, []).append(b)
    out = []
    for a in after:
        seen: dict = {}
        walk = list(after[a])
        while walk:
            b = walk.pop()
            if b not in seen:
                seen[b] = None
                walk += after.get(b, ())
        out += [(a, b) for b in seen]
    return out


def closure(pairs: DataFrame, start: Column | None = None, most: int = 1000) -> DataFrame:
    """Transitive closure of distinct pairs (a, b); cycles give reflexive pairs.

    With ``start`` only pairs from it. At most ``SMALL_CLOSURE`` pairs are closed on the
    driver. More are closed semi-naively: each round is written to the shared folder, and
    it ends when a round finds nothing new.
    """
    few = pairs.select("a", "b").limit(SMALL_CLOSURE + 1).collect()
    if len(few) <= SMALL_CLOSURE:
        made = pairs.sparkSession.createDataFrame(_small_closure([tuple(r) for r in few]), pairs.select("a", "b").schema)
        return made if start is None else made.where(F.col("a") == start)
    edges = materialise(pairs, "closure-edges")
    frontier = edges if start is None else edges.where(F.col("a") == start)
    frontier = materialise(frontier, "closure-round")
    seen = frontier
    for _ in range(most):
        step = frontier.select("a", F.col("b").alias("m")).join(edges.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        frontier = materialise(step.join(seen, ["a", "b"], "left_anti"), "closure-round")
        if frontier.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(frontier)
    raise SparqlError("the closure did not end")


def run_select(triples: DataFrame, query: P.Select) -> DataFrame:
    """Solutions with one term column for each variable, named like it."""
    compiler = Compiler(triples)
    rel = compiler.select(query)
    return rel.df.select(*[F.col(name_of(v)).alias(v.name) for v in rel.variables])


def lexical(df: DataFrame) -> DataFrame:
    """Only the terms' values."""
    return df.select(*[F.col(f"`{c}`").v.alias(c) for c in df.columns])
