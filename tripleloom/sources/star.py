"""The star-schema tables as a triple set."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.session import table

EX = "urn:x:"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, LABEL, SUBCLASS = RDF + "type", RDFS + "label", RDFS + "subClassOf"
PREF, ALT = SKOS + "prefLabel", SKOS + "altLabel"
PREFIXES = {"ex": EX, "rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS, "xsd": XSD}


def _iri(value: Column | str) -> tuple:
    return ("iri", F.lit(value) if isinstance(value, str) else value, "", "")


def _text(value: Column, datatype: str = "", lang: str = "") -> tuple:
    return ("literal", value.cast("string"), datatype, lang)


def facts(df: DataFrame, subject: Column, pairs: list[tuple[str, tuple]], component: str) -> DataFrame:
    """Triples of each row: one for each (predicate, object); a null object gives none.

    Every predicate is a projection of its own: a pattern with a known predicate is
    folded to that projection, so that a scan reads the two columns it needs.
    """
    parts = [
        df.select(subject.alias("s"), F.lit(p).alias("p"), F.lit(o[0]).alias("o_kind"), o[1].alias("o_value"), F.lit(o[2]).alias("o_datatype"), F.lit(o[3]).alias("o_lang"), F.lit(component).alias("component")).where("o_value is not null")
        for p, o in pairs
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _node(name: str, column: str) -> Column:
    return F.concat(F.lit(f"{EX}{name}:"), F.col(column).cast("string"))


PROFILE_CLASSES = ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Party", "Thing")
PROFILE_OBJECT = (("inRegion", "Nation", "Region"), ("inNation", "Party", "Nation"), ("placedBy", "Order", "Customer"))
PROFILE_DATA = (
    ("acctbal", "Party", "decimal"), ("segment", "Customer", "string"), ("brand", "Part", "string"), ("size", "Part", "integer"),
    ("orderDate", "Order", "dateTime"), ("total", "Order", "decimal"), ("status", "Order", "string"),
)


def profile_rows() -> list[tuple]:
    rows = [(EX + c, TYPE, "iri", OWL + "Class") for c in PROFILE_CLASSES]
    rows += [(EX + "Customer", SUBCLASS, "iri", EX + "Party"), (EX + "Supplier", SUBCLASS, "iri", EX + "Party"), (EX + "Party", SUBCLASS, "iri", EX + "Thing")]
    for name, domain, target in PROFILE_OBJECT:
        rows += [(EX + name, TYPE, "iri", OWL + "ObjectProperty"), (EX + name, RDFS + "domain", "iri", EX + domain), (EX + name, RDFS + "range", "iri", EX + target)]
    for name, domain, kind in PROFILE_DATA:
        rows += [(EX + name, TYPE, "iri", OWL + "DatatypeProperty"), (EX + name, RDFS + "domain", "iri", EX + domain), (EX + name, RDFS + "range", "iri", XSD + kind)]
    return rows


PROFILE_COLUMNS = ("s", "p", "o_kind", "o_value", "o_datatype", "o_lang", "component")


def profile(spark: SparkSession) -> DataFrame:
    """The profile's triples as a local relation, whose filters are folded while a query is planned."""
    rows = [(s, p, k, o, "", "", "profile") for s, p, k, o in profile_rows()]
    columns = {c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(PROFILE_COLUMNS)}
    return spark.createDataFrame(pa.table(columns))


def star_triples(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """Triples of the named tables (all if none is named) and of the profile."""
    t = lambda name: table(spark, sf_dir, name)
    stamp = lambda c: F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss")
    makers = {
        "region": lambda: facts(t("region"), _node("region", "r_regionkey"), [(TYPE, _iri(EX + "Region")), (LABEL, _text(F.col("r_name")))], "region"),
        "nation": lambda: facts(
            t("nation"), _node("nation", "n_nationkey"), [(TYPE, _iri(EX + "Nation")), (LABEL, _text(F.col("n_name"))), (EX + "inRegion", _iri(_node("region", "n_regionkey")))], "nation"
        ),
        "customer": lambda: facts(
            t("customer"),
            _node("customer", "c_custkey"),
            [(TYPE, _iri(EX + "Customer")), (PREF, _text(F.col("c_name"))), (EX + "inNation", _iri(_node("nation", "c_nationkey"))), (EX + "acctbal", _text(F.col("c_acctbal"), XSD + "decimal")), (EX + "segment", _text(F.col("c_mktsegment")))],
            "customer",
        ),
        "supplier": lambda: facts(
            t("supplier"),
            _node("supplier", "s_suppkey"),
            [(TYPE, _iri(EX + "Supplier")), (PREF, _text(F.col("s_name"))), (EX + "inNation", _iri(_node("nation", "s_nationkey"))), (EX + "acctbal", _text(F.col("s_acctbal"), XSD + "decimal"))],
            "supplier",
        ),
        "part": lambda: facts(
            t("part"),
            _node("part", "p_partkey"),
            [(TYPE, _iri(EX + "Part")), (PREF, _text(F.col("p_name"))), (ALT, _text(F.col("p_type"))), (EX + "brand", _text(F.col("p_brand"))), (EX + "size", _text(F.col("p_size"), XSD + "integer"))],
            "part",
        ),
        "orders": lambda: facts(
            t("orders"),
            _node("order", "o_orderkey"),
            [
                (TYPE, _iri(EX + "Order")),
                (EX + "placedBy", _iri(_node("customer", "o_custkey"))),
                (EX + "orderDate", _text(stamp("o_orderdate"), XSD + "dateTime")),
                (EX + "total", _text(F.col("o_totalprice"), XSD + "decimal")),
                (EX + "status", _text(F.col("o_orderstatus"))),
            ],
            "orders",
        ),
    }
    chosen = [makers[name]() for name in (tables or makers)]
    return reduce(lambda a, b: a.unionByName(b), [profile(spark), *chosen])
