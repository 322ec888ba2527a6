"""SPARQL operators and functions as column expressions; an error is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.sparql.compile import BOOLEAN, DATES, DECIMAL, DOUBLE, INTEGER, NUMERIC, STRING, E, term_column
from tripleloom.sparql.parser import XSD, SparqlError


def _compare(op: str, a: E, b: E) -> Column:
    pairs = []
    if "bool" in (a.kind, b.kind):
        x, y = a.bool(), b.bool()
        pairs.append((x.cast("int"), y.cast("int")))
    elif "num" in (a.kind, b.kind):
        pairs += [(a.whole(), b.whole()), (a.num(), b.num())]
    elif "str" in (a.kind, b.kind):
        pairs.append((a.text(), b.text()))
    else:
        pairs += [(a.whole(), b.whole()), (a.num(), b.num()), (a.stamp(), b.stamp()), (a.text(), b.text())]
    tests = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    return F.coalesce(*[tests[op](x, y) for x, y in pairs])


def _equal(a: E, b: E) -> Column:
    if "bool" in (a.kind, b.kind):
        return a.bool() == b.bool()
    if "num" in (a.kind, b.kind):
        number = F.coalesce(a.whole() == b.whole(), a.num() == b.num())
        other = a if a.kind == "term" else b
        if other.kind == "term":  # a number never equals an IRI or a string
            return F.coalesce(number, F.when(other.term().isNotNull(), F.lit(False)))
        return number
    if "str" in (a.kind, b.kind):
        other = a if a.kind == "term" else b
        same = (a.text() == b.text()) & (a.lang() == b.lang())
        return F.coalesce(same, F.when(other.term().isNotNull(), F.lit(False))) if other.kind == "term" else same
    x, y = a.term(), b.term()
    return F.coalesce(a.whole() == b.whole(), a.num() == b.num(), a.stamp() == b.stamp(), x == y)


def _arithmetic(op: str, a: E, b: E) -> E:
    x, y = a.num(), b.num()
    exact = None
    if op == "/":
        value = F.try_divide(x, y)
        whole = F.lit(DECIMAL)
    else:
        value = {"+": x + y, "-": x - y, "*": x * y}[op]
        whole = F.lit(INTEGER)
        exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.whole(), b.whole()).cast("decimal(38,0)")
    da, db = a.datatype(), b.datatype()
    double = da.isin(DOUBLE, XSD + "float") | db.isin(DOUBLE, XSD + "float")
    datatype = F.when(double, DOUBLE).when((da == INTEGER) & (db == INTEGER), whole).otherwise(DECIMAL)
    return E("num", value, datatype, exact)


def _strings(function, *, keep_lang: bool = True):
    def made(args: list[E]) -> E:
        return E("str", function(*[a.text() for a in args]), args[0].lang() if keep_lang else None)

    return made


def _booleans(function):
    return lambda args: E("bool", function(*[a.text() for a in args]))


def _number(function, datatype: str | None = None):
    return lambda args: E("num", function(args[0].num()), F.lit(datatype) if datatype else args[0].datatype())


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def _part(unit):
    return lambda args: E("num", unit(args[0].stamp()).cast("double"), F.lit(INTEGER))


def _substr(args: list[E]) -> E:
    text, start = args[0].text(), args[1].num().cast("int")
    length = args[2].num().cast("int") if len(args) > 2 else F.length(text)
    return E("str", text.substr(start, length), args[0].lang())


def _before(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return F.when(at > 0, F.left(text, at - 1)).when(text.isNotNull() & part.isNotNull(), F.lit(""))


def _after(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return F.when(at > 0, text.substr(at + F.length(part), F.length(text))).when(text.isNotNull() & part.isNotNull(), F.lit(""))


def _flagged(pattern: Column, args: list[E], at: int) -> Column:
    if len(args) <= at:
        return pattern
    return F.concat(F.lit("(?"), args[at].text(), F.lit(")"), pattern)


def _timezone(args: list[E]) -> Column:
    return F.regexp_extract(args[0].term().v, r"(Z|[+-]\d\d:\d\d)$", 1)


def _datatype(a: E) -> E:
    t = a.term()
    value = F.when(t.l != "", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).when(t.d == "", F.lit(STRING)).otherwise(t.d)
    return E("term", F.when(t.k == "literal", term_column("iri", value)))


def _cast(target: str, a: E) -> E:
    text = a.str()
    if target == STRING:
        return E("str", text)
    if target == BOOLEAN:
        low = F.lower(F.trim(text))
        return E("bool", F.when(a.num().isNotNull(), a.num() != 0).when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False)))
    if target in (DECIMAL, DOUBLE, XSD + "float"):
        number = F.trim(text).try_cast("double") if a.kind != "num" else a.num()
        return E("num", number, F.lit(target))
    if target in NUMERIC:
        number = a.num() if a.kind == "num" else F.coalesce(a.num(), F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("double")))
        exact = F.coalesce(a.whole(), F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("decimal(38,0)")))
        return E("num", F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double"), F.lit(INTEGER), exact)
    if target in DATES:
        form = "yyyy-MM-dd" if target == XSD + "date" else "yyyy-MM-dd'T'HH:mm:ss"
        stamp = text.try_cast("timestamp")
        shown = F.when(F.length(text) >= (10 if target == XSD + "date" else 19), F.when(stamp.isNotNull(), F.date_format(stamp, form) if target == XSD + "date" else text))
        return E("term", F.when(shown.isNotNull(), term_column("literal", shown, target)))
    raise SparqlError(f"no cast to {target}")


def call(name: str, args: list) -> E:
    """The value of an operator, function or cast on evaluated arguments."""
    if name == "call":
        return _cast(args[0], args[1])
    if name == "||":
        return E("bool", args[0].bool() | args[1].bool())
    if name == "&&":
        return E("bool", args[0].bool() & args[1].bool())
    if name == "!":
        return E("bool", ~args[0].bool())
    if name == "neg":
        return E("num", -args[0].num(), args[0].datatype())
    if name == "=":
        return E("bool", _equal(*args))
    if name == "!=":
        return E("bool", ~_equal(*args))
    if name in ("<", ">", "<=", ">="):
        return E("bool", _compare(name, *args))
    if name in ("+", "-", "*", "/"):
        return _arithmetic(name, *args)
    if name == "IN":
        return E("bool", reduce(lambda a, b: a | b, [_equal(args[0], x) for x in args[1:]], F.lit(False)))
    if name == "IF":
        return E("term", F.when(args[0].bool().isNull(), F.lit(None)).when(args[0].bool(), args[1].term()).otherwise(args[2].term()))
    if name == "COALESCE":
        return E("term", F.coalesce(*[a.term() for a in args]))
    if name == "SAMETERM":
        return E("bool", args[0].term() == args[1].term())
    if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
        kind = {"ISBLANK": "bnode", "ISLITERAL": "literal"}.get(name, "iri")
        return E("bool", args[0].term().k == kind)
    if name == "ISNUMERIC":
        return E("bool", F.when(args[0].term().isNotNull(), args[0].num().isNotNull()))
    if name == "STR":
        return E("str", args[0].str())
    if name == "LANG":
        return E("str", F.when(args[0].term().k == "literal", args[0].term().l))
    if name == "LANGMATCHES":
        tag, wanted = F.lower(args[0].text()), F.lower(args[1].text())
        return E("bool", F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))))
    if name == "DATATYPE":
        return _datatype(args[0])
    if name in ("IRI", "URI"):
        return E("term", F.when(args[0].str().isNotNull(), term_column("iri", args[0].str())))
    if name == "BNODE":
        label = F.concat(F.lit("_:f"), F.md5(args[0].text())) if args else F.concat(F.lit("_:u"), F.uuid())
        return E("term", F.when(label.isNotNull(), term_column("bnode", label)))
    if name == "STRDT":
        return E("term", F.when(args[0].text().isNotNull(), term_column("literal", args[0].text(), args[1].str())))
    if name == "STRLANG":
        return E("str", args[0].text(), F.lower(args[1].text()))
    if name == "REGEX":
        return E("bool", F.regexp_like(args[0].text(), _flagged(args[1].text(), args, 2)))
    if name == "REPLACE":
        return E("str", F.regexp_replace(args[0].text(), _flagged(args[1].text(), args, 3), args[2].text()), args[0].lang())
    if name == "SUBSTR":
        return _substr(args)
    if name == "STRLEN":
        return E("num", F.length(args[0].text()).cast("double"), F.lit(INTEGER))
    if name == "CONCAT":
        return E("str", F.concat(*[a.text() for a in args]) if args else F.lit(""))
    if name == "TZ":
        return E("str", F.when(args[0].stamp().isNotNull(), _timezone(args)))
    if name == "TIMEZONE":
        zone = _timezone(args)
        hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
        sign = F.when(zone.startswith("-"), "-").otherwise("")
        text = F.when(zone == "Z", "PT0S").otherwise(F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise("")))
        return E("term", F.when(zone != "", term_column("literal", text, XSD + "dayTimeDuration")))
    if name == "NOW":
        return E("term", term_column("literal", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), XSD + "dateTime"))
    if name in ("UUID", "STRUUID"):
        text = F.uuid()
        return E("term", term_column("iri", F.concat(F.lit("urn:uuid:"), text))) if name == "UUID" else E("str", text)
    if name == "RAND":
        return E("num", F.rand(), F.lit(DOUBLE))
    if name in _TABLE:
        return _TABLE[name](args)
    raise SparqlError(f"unknown function {name}")


_TABLE = {
    "UCASE": _strings(F.upper),
    "LCASE": _strings(F.lower),
    "ENCODE_FOR_URI": _strings(lambda t: F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")), keep_lang=False),
    "STRBEFORE": _strings(_before),
    "STRAFTER": _strings(_after),
    "STRSTARTS": _booleans(lambda a, b: a.startswith(b)),
    "STRENDS": _booleans(lambda a, b: a.endswith(b)),
    "CONTAINS": _booleans(lambda a, b: a.contains(b)),
    "ABS": _number(F.abs),
    "CEIL": _number(lambda x: F.ceil(x).cast("double")),
    "FLOOR": _number(lambda x: F.floor(x).cast("double")),
    "ROUND": _number(_half_up),
    "YEAR": _part(F.year),
    "MONTH": _part(F.month),
    "DAY": _part(F.dayofmonth),
    "HOURS": _part(F.hour),
    "MINUTES": _part(F.minute),
    "SECONDS": _part(F.second),
    "MD5": _strings(F.md5, keep_lang=False),
    "SHA1": _strings(F.sha1, keep_lang=False),
    "SHA256": _strings(lambda t: F.sha2(t, 256), keep_lang=False),
    "SHA384": _strings(lambda t: F.sha2(t, 384), keep_lang=False),
    "SHA512": _strings(lambda t: F.sha2(t, 512), keep_lang=False),
}
