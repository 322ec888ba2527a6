"""Index, traversal, catalog, integrity and rewriting operators over triples.

``triples`` has the columns s, p, o_kind, o_value, o_datatype, o_lang, component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.session import materialise
from tripleloom.sources.star import ALT, LABEL, OWL, PREF, RDF, RDFS, SUBCLASS, TYPE, XSD
from tripleloom.sparql.compile import closure

SCHEMA_NAME = "http://schema.org/name"
LABELS = (PREF, ALT, LABEL, SCHEMA_NAME)
SCHEMA_TYPES = (OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty")
FACT_COLUMNS = ("s", "p", "o_kind", "o_value", "o_datatype", "o_lang")


def as_set(triples: DataFrame) -> DataFrame:
    """Union with set semantics: one row for each triple, whatever its components."""
    return triples.select(*FACT_COLUMNS).distinct()


def label_index(triples: DataFrame) -> DataFrame:
    """(s, labels): the trimmed, non-empty labels of each subject, sorted."""
    text = F.trim("o_value")
    rows = triples.where(F.col("p").isin(*LABELS) & (F.col("o_kind") == "literal") & (text != "")).select("s", text.alias("label"))
    return rows.groupBy("s").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def representative_labels(triples: DataFrame) -> DataFrame:
    """(s, label): Hangul before others, then the shortest, then the least."""
    label = F.explode("labels").alias("label")
    rows = label_index(triples).select("s", label)
    key = F.struct((~F.col("label").rlike("[가-힣]")).alias("a"), F.length("label").alias("b"), F.col("label").alias("c"))
    return rows.groupBy("s").agg(F.min_by("label", key).alias("label"))


def direct_types(triples: DataFrame) -> DataFrame:
    """(s, types): sorted direct types."""
    return triples.where(F.col("p") == TYPE).groupBy("s").agg(F.sort_array(F.collect_set("o_value")).alias("types"))


def class_closure(triples: DataFrame, *predicates: str) -> DataFrame:
    """(cls, ancestor): reflexive-transitive closure over subclasses (or the given predicates); cycles end."""
    used = predicates or (SUBCLASS,)
    pairs = triples.where(F.col("p").isin(*used) & (F.col("o_kind") == "iri")).select(F.col("s").alias("a"), F.col("o_value").alias("b")).distinct()
    typed = triples.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri") & (F.col("o_value") == OWL + "Class")).select(F.col("s").alias("a"))
    nodes = pairs.select("a").union(pairs.select(F.col("b").alias("a"))).union(typed).distinct()
    reflexive = nodes.select("a", F.col("a").alias("b"))
    return closure(pairs).unionByName(reflexive).distinct().select(F.col("a").alias("cls"), F.col("b").alias("ancestor"))


def instances_of(triples: DataFrame, cls: str) -> DataFrame:
    """(s): subjects whose type is ``cls`` or one of its descendants."""
    below = class_closure(triples).where(F.col("ancestor") == cls).select(F.col("cls").alias("o_value"))
    return triples.where(F.col("p") == TYPE).join(below, "o_value", "left_semi").select("s").distinct()


def curie(column: str, prefixes: dict[str, str]) -> Column:
    """The IRI with a known namespace shortened to its prefix."""
    out = F.col(column)
    for prefix, space in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(F.col(column).startswith(space), F.concat(F.lit(prefix + ":"), F.substring(F.col(column), len(space) + 1, 10_000))).otherwise(out)
    return out


def term_descriptors(triples: DataFrame) -> DataFrame:
    """(iri, kind, label, definition, domains, ranges, parents) of the declared terms."""
    kinds = triples.where((F.col("p") == TYPE) & F.col("o_value").isin(*SCHEMA_TYPES)).groupBy(F.col("s").alias("iri")).agg(F.min("o_value").alias("kind"))
    text = F.col("o_value")
    named = (F.col("p").isin(PREF, LABEL)) & F.coalesce("o_lang", F.lit("")).isin("", "ko", "en")
    described = F.col("p").isin(RDFS + "comment", "http://www.w3.org/2004/02/skos/core#definition")
    shortest = lambda test: F.min_by(F.when(test, text), F.when(test, F.struct(F.length(text), text)))
    values = lambda p: F.sort_array(F.collect_set(F.when(F.col("p") == p, text)))
    about = triples.groupBy(F.col("s").alias("iri")).agg(
        shortest(named).alias("label"), shortest(described).alias("definition"), values(RDFS + "domain").alias("domains"), values(RDFS + "range").alias("ranges"), values(SUBCLASS).alias("parents")
    )
    short = F.when(F.col("kind") == OWL + "Class", "class").when(F.col("kind") == OWL + "ObjectProperty", "object_property").otherwise("datatype_property")
    return kinds.join(about, "iri").select("iri", short.alias("kind"), "label", "definition", "domains", "ranges", "parents")


def schema_catalog(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(line): one line for each declared term, and the properties used without a declaration."""
    terms = term_descriptors(triples)
    joined = lambda c: F.array_join(F.col(c), ",")
    declared = terms.select(
        F.concat_ws(
            " ",
            "kind",
            curie("iri", prefixes),
            F.when(F.size("domains") > 0, F.concat(F.lit("domain="), joined("domains"))),
            F.when(F.size("ranges") > 0, F.concat(F.lit("range="), joined("ranges"))),
        ).alias("line")
    )
    used = triples.select(F.col("p").alias("iri")).distinct().join(terms.select("iri"), "iri", "left_anti")
    return declared.unionByName(used.select(F.concat(F.lit("undeclared "), curie("iri", prefixes)).alias("line")))


# ---- integrity ---------------------------------------------------------------------


def duplicated_triples(triples: DataFrame) -> DataFrame:
    """(s, p, o_kind, o_value, o_datatype, o_lang, components): triples that stand in more than one component.

    Literals of another datatype or language are other triples.
    """
    same = [F.coalesce(c, F.lit("")).alias(c) for c in ("o_datatype", "o_lang")]
    return triples.groupBy("s", "p", "o_kind", "o_value", *same).agg(F.count_distinct("component").alias("components")).where("components > 1")


def undeclared_predicates(triples: DataFrame, root: str) -> DataFrame:
    """(p): local predicates without a declaration as a property."""
    declared = triples.where((F.col("p") == TYPE) & F.col("o_value").isin(OWL + "ObjectProperty", OWL + "DatatypeProperty")).select(F.col("s").alias("p"))
    return triples.where(F.col("p").startswith(root)).select("p").distinct().join(declared, "p", "left_anti")


def undeclared_classes(triples: DataFrame, root: str) -> DataFrame:
    """(cls): local classes used as a type without a declaration."""
    declared = triples.where((F.col("p") == TYPE) & (F.col("o_value") == OWL + "Class")).select(F.col("s").alias("cls"))
    return triples.where((F.col("p") == TYPE) & F.col("o_value").startswith(root)).select(F.col("o_value").alias("cls")).distinct().join(declared, "cls", "left_anti")


def dangling_resources(triples: DataFrame, root: str) -> DataFrame:
    """(o_value): local resources that are named as an object but never described."""
    objects = triples.where((F.col("o_kind") == "iri") & F.col("o_value").startswith(root)).select("o_value").distinct()
    return objects.join(triples.select(F.col("s").alias("o_value")), "o_value", "left_anti")


def page_mismatches(triples: DataFrame, source_page: str, page_of: Column) -> DataFrame:
    """(component, s, pages): subjects of a component whose source pages are not exactly its own."""
    rows = triples.where(F.col("p") == source_page).withColumn("own", page_of)
    grouped = rows.groupBy("component", "s").agg(F.sort_array(F.collect_set("o_value")).alias("pages"), F.first("own").alias("own"))
    return grouped.where(F.col("pages") != F.array("own")).select("component", "s", "pages")


def missing_pages(triples: DataFrame, page_class: str, page_of: Column) -> DataFrame:
    """(component): components that do not declare their own page."""
    declared = triples.where((F.col("p") == TYPE) & (F.col("o_value") == page_class) & (F.col("s") == page_of)).select("component")
    return triples.where("component != 'profile'").select("component").distinct().join(declared, "component", "left_anti")


def graph_counts(triples: DataFrame) -> DataFrame:
    """(component, triples, subjects) and the distinct triples of all under component '*'."""
    each = triples.groupBy("component").agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"))
    whole = as_set(triples).agg(F.lit("*").alias("component"), F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"))
    return each.unionByName(whole.select("component", "triples", "subjects"))


# ---- rewriting -----------------------------------------------------------------------

ASSERTION = "urn:x:assertion:"


def reify(facts: DataFrame) -> DataFrame:
    """Facts (run_id, unit_id, s, p, o_kind, o_value, locator, quote, confidence) as triples.

    Each gives the direct triple and nine about its assertion, whose name is a hash of the fact.
    """
    key = F.concat_ws("\x1f", "run_id", "unit_id", "s", "p", "o_kind", "o_value", "locator")
    node = F.concat(F.lit(ASSERTION), F.substring(F.sha2(key, 256), 1, 24))
    line = lambda s, p, k, v: F.struct(s.alias("s"), F.lit(p).alias("p") if isinstance(p, str) else p.alias("p"), F.lit(k).alias("o_kind") if isinstance(k, str) else k.alias("o_kind"), v.cast("string").alias("o_value"))
    made = F.array(
        line(F.col("s"), F.col("p"), F.col("o_kind"), F.col("o_value")),
        line(node, TYPE, "iri", F.lit(RDF + "Statement")),
        line(node, RDF + "subject", "iri", F.col("s")),
        line(node, RDF + "predicate", "iri", F.col("p")),
        line(node, RDF + "object", F.col("o_kind"), F.col("o_value")),
        line(node, "http://www.w3.org/ns/prov#wasDerivedFrom", "iri", F.concat(F.lit("urn:x:unit:"), F.col("unit_id"))),
        line(node, "http://www.w3.org/ns/prov#wasGeneratedBy", "iri", F.concat(F.lit("urn:x:run:"), F.col("run_id"))),
        line(node, "urn:x:evidenceLocator", "literal", F.col("locator")),
        line(node, "urn:x:evidenceQuote", "literal", F.col("quote")),
        line(node, "urn:x:confidence", "literal", F.col("confidence")),
    )
    return facts.select(F.explode(made).alias("t")).select("t.*").distinct()


def substitute_iris(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Subjects, predicates and IRI objects replaced by mapping (iri, target)."""
    out = triples
    for column in ("s", "p", "o_value"):
        m = mapping.select(F.col("iri").alias("__iri"), F.col("target").alias("__target"))
        on = F.col(column) == F.col("__iri")
        if column == "o_value":
            on = on & (F.col("o_kind") == "iri")
        out = out.join(m, on, "left").withColumn(column, F.coalesce("__target", column)).drop("__iri", "__target")
    return out.select(triples.columns)


def residual_iris(triples: DataFrame, root: str) -> DataFrame:
    """(iri): IRIs under ``root`` that are still anywhere in the graph."""
    every = F.explode(F.array("s", "p", F.when(F.col("o_kind") == "iri", F.col("o_value")))).alias("iri")
    return triples.select(every).where(F.col("iri").startswith(root)).distinct()


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    """Equality of two graphs without blank nodes."""
    x, y = as_set(a), as_set(b)
    return x.exceptAll(y).limit(1).count() == 0 and y.exceptAll(x).limit(1).count() == 0


def transport_resources(triples: DataFrame, root: str) -> DataFrame:
    """(iri, types, labels, facts): resources under ``root`` with their sorted facts."""
    own = triples.where(F.col("s").startswith(root))
    fact = F.struct(F.col("p"), F.col("o_kind"), F.col("o_value"))
    rest = own.where(~F.col("p").isin(TYPE, *LABELS)).groupBy("s").agg(F.sort_array(F.collect_set(fact)).alias("facts"))
    types = direct_types(own)
    return types.join(label_index(own), "s", "full").join(rest, "s", "full").select(F.col("s").alias("iri"), "types", "labels", "facts")


def implicit_classes(labels: DataFrame, known: DataFrame) -> DataFrame:
    """(term_id, label): referenced class labels that no term has and that are no IRI."""
    new = labels.where("label is not null and not label rlike '^[a-z]+:'").select("label").distinct().join(known.select("label"), "label", "left_anti")
    return new.select(F.concat(F.lit("implicit-"), F.substring(F.sha2("label", 256), 1, 12)).alias("term_id"), "label")


def cached_graph(triples: DataFrame) -> DataFrame:
    """The graph written once, sorted by predicate so that bound predicates skip row groups."""
    return materialise(triples.repartitionByRange("p", "s").sortWithinPartitions("p", "s"), "graph")


def page_set_issues(triples: DataFrame, page_class: str, pages: DataFrame) -> DataFrame:
    """(iri, issue): page subjects of the graph against the expected pages (iri)."""
    declared = triples.where((F.col("p") == TYPE) & (F.col("o_value") == page_class)).select(F.col("s").alias("iri")).distinct().withColumn("there", F.lit(True))
    both = declared.join(pages.select("iri").distinct().withColumn("wanted", F.lit(True)), "iri", "full")
    issue = F.when(F.col("there").isNull(), "missing page").when(F.col("wanted").isNull(), "unexpected page")
    return both.select("iri", issue.alias("issue")).where("issue is not null")


def source_texts(triples: DataFrame, predicate: str) -> DataFrame:
    """(s, text): the evidence texts of resources."""
    return triples.where((F.col("p") == predicate) & (F.col("o_kind") == "literal")).select("s", F.col("o_value").alias("text")).distinct()


UNIT, DOCUMENT, RUN, VOCABULARY = "urn:x:unit:", "urn:x:document:", "urn:x:run:", "urn:x:"
PROV, DCTERMS = "http://www.w3.org/ns/prov#", "http://purl.org/dc/terms/"


def _safe(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "-")


def _lines(df: DataFrame, *parts: tuple) -> DataFrame:
    """Triples of rows from (subject, predicate, kind, value, datatype, language); null values give none."""
    made = [
        df.select(s.alias("s"), F.lit(p).alias("p"), F.lit(k).alias("o_kind"), v.cast("string").alias("o_value"), F.lit(d).alias("o_datatype"), F.lit(lang).alias("o_lang")).where("o_value is not null and s is not null")
        for s, p, k, v, d, lang in parts
    ]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def provenance(units: DataFrame, run_id: str) -> DataFrame:
    """Triples about units, their documents and the activity that read them; a set.

    units: (unit_id, document_id, locator, content_hash, source_status, source_hash,
    source_issues, text, pdf_page, printed_page, created_at). Absent values give no triple.
    """
    string, integer = XSD + "string", XSD + "integer"
    unit, document = F.concat(F.lit(UNIT), _safe(F.col("unit_id"))), F.concat(F.lit(DOCUMENT), _safe(F.col("document_id")))
    activity = F.concat(F.lit(f"{RUN}{run_id}:"), _safe(F.col("unit_id")))
    rows = _lines(
        units,
        (unit, TYPE, "iri", F.lit(VOCABULARY + "EvidenceUnit"), "", ""), (unit, DCTERMS + "isPartOf", "iri", document, "", ""), (unit, VOCABULARY + "locator", "literal", F.col("locator"), string, ""),
        (unit, VOCABULARY + "contentHash", "literal", F.col("content_hash"), string, ""), (unit, VOCABULARY + "sourceStatus", "literal", F.col("source_status"), string, ""), (unit, VOCABULARY + "sourceHash", "literal", F.col("source_hash"), string, ""),
        (unit, "http://schema.org/text", "literal", F.col("text"), "", "ko"), (unit, VOCABULARY + "pdfPage", "literal", F.col("pdf_page"), integer, ""), (unit, VOCABULARY + "printedPage", "literal", F.col("printed_page"), integer, ""),
        (document, TYPE, "iri", F.lit(PROV + "Entity"), "", ""), (document, DCTERMS + "identifier", "literal", F.col("document_id"), "", ""), (activity, TYPE, "iri", F.lit(PROV + "Activity"), "", ""),
        (activity, PROV + "generatedAtTime", "literal", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), XSD + "dateTime", ""),
    )
    issues = units.select(unit.alias("s"), F.explode("source_issues").alias("o_value")).select("s", F.lit(VOCABULARY + "sourceIssue").alias("p"), F.lit("literal").alias("o_kind"), "o_value", F.lit(string).alias("o_datatype"), F.lit("").alias("o_lang"))
    return rows.unionByName(issues).distinct()


def entity_triples(entities: DataFrame, types: dict[str, str]) -> DataFrame:
    """Triples of entities (iri, label, identifier, types): label, identifier and each type, prefixed names expanded by ``types``."""
    iri = F.col("iri")
    about = _lines(entities, (iri, LABEL, "literal", F.col("label"), "", "ko"), (iri, DCTERMS + "identifier", "literal", F.col("identifier"), "", ""))
    prefix = F.substring_index("t", ":", 1)
    space = F.coalesce(*[F.when(prefix == p, F.lit(ns)) for p, ns in types.items()])
    typed = entities.select(iri.alias("s"), F.explode("types").alias("t")).select("s", F.lit(TYPE).alias("p"), F.lit("iri").alias("o_kind"), F.coalesce(F.concat(space, F.substring_index("t", ":", -1)), "t").alias("o_value"), F.lit("").alias("o_datatype"), F.lit("").alias("o_lang"))
    return about.unionByName(typed).distinct()


def draft_graph(units: DataFrame, entities: DataFrame, facts: DataFrame, run_id: str, types: dict[str, str]) -> DataFrame:
    """The draft of a run: provenance, entities and reified facts as one set of triples."""
    reified = reify(facts).select("s", "p", "o_kind", "o_value", F.lit("").alias("o_datatype"), F.lit("").alias("o_lang"))
    return provenance(units, run_id).unionByName(entity_triples(entities, types)).unionByName(reified).distinct()


def compatible_types(rows: DataFrame, closure: DataFrame) -> DataFrame:
    """(row_id, compatible) of rows (row_id, types, expected): a type or an ancestor (cls, ancestor) is expected, or nothing is."""
    wide = rows.select("row_id", F.explode("types").alias("cls")).join(closure, "cls", "left").groupBy("row_id").agg(F.array_union(F.collect_set("cls"), F.collect_set("ancestor")).alias("wide"))
    none = F.coalesce(F.size("expected"), F.lit(0)) == 0
    return rows.join(wide, "row_id", "left").select("row_id", (none | F.coalesce(F.arrays_overlap("wide", "expected"), F.lit(False))).alias("compatible"))
