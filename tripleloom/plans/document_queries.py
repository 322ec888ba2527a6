"""Queries over the document, record and graph operators, with SQL twins written by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.functions import text as X
from tripleloom.operators import facts as E
from tripleloom.operators import fuzzy, graph, linking, pages, reconcile, records, segments, tables
from tripleloom.plans.queries import HEAD, _broken_graph, _GRAMS, _order_facts, _questions, _QUESTIONS
from tripleloom.session import checkpoint_dir, materialise, table
from tripleloom.sources import files, turtle
from tripleloom.sources.star import EX, LABEL, PREFIXES, XSD, star_triples
from tripleloom.sparql import gate
from tripleloom.sparql.compile import lexical

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def _one(df: DataFrame, key: str) -> DataFrame:
    """One row of each key; repeated rows have equal content."""
    return df.dropDuplicates([key])


def _sql_one(name: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ingested_at) AS same FROM {name}) WHERE same = 1)"


# ---- SPARQL: the gate and more functions ------------------------------------------------


def sparql(name: str, text: str, used: tuple[str, ...], sql: str, cap: int | None = None, longs: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = lexical(gate.execute(star_triples(spark, sf_dir, *used), HEAD + text, cap=cap))
        for c in longs:
            out = out.withColumn(c, F.col(c).cast("double").cast("bigint"))
        return out

    QUERIES[name] = run
    SQL[name] = sql


sparql("sparql_capped", "SELECT ?c WHERE { ?c a ex:Customer } ORDER BY ?c LIMIT 400", ("customer",), "SELECT 'urn:x:customer:' || c_custkey AS c FROM customer ORDER BY 1 LIMIT 50", cap=50)
sparql("sparql_capped_lower", "SELECT ?c WHERE { ?c a ex:Supplier } ORDER BY DESC(?c) LIMIT 7", ("supplier",), "SELECT 'urn:x:supplier:' || s_suppkey AS c FROM supplier ORDER BY 1 DESC LIMIT 7", cap=50)
sparql(
    "sparql_path_optional",
    "SELECT ?x ?y WHERE { ?x a ex:Nation . ?x ex:inRegion? ?y }",
    ("nation",),
    "SELECT 'urn:x:nation:' || n_nationkey AS x, 'urn:x:nation:' || n_nationkey AS y FROM nation UNION ALL SELECT 'urn:x:nation:' || n_nationkey, 'urn:x:region:' || n_regionkey FROM nation",
)
sparql(
    "sparql_term_functions",
    'SELECT ?n (DATATYPE(?b) AS ?d) (LANG(?l) AS ?g) (isLiteral(?l) AS ?lit) (isIRI(?s) AS ?iri) (STR(STRLANG("x", "ko")) AS ?sl) (LANG(STRLANG("x", "ko")) AS ?tag) (LANGMATCHES(LANG(STRLANG("x", "ko-KR")), "ko") AS ?ok) (DATATYPE(STRDT("5", xsd:integer)) AS ?sd) WHERE { ?s a ex:Supplier ; ex:acctbal ?b ; skos:prefLabel ?l . BIND(STR(?s) AS ?n) }',
    ("supplier",),
    f"SELECT 'urn:x:supplier:' || s_suppkey AS n, '{XSD}decimal' AS d, '' AS g, 'true' AS lit, 'true' AS iri, 'x' AS sl, 'ko' AS tag, 'true' AS ok, '{XSD}integer' AS sd FROM supplier",
)
sparql(
    "sparql_string_functions",
    'SELECT ?l (STRSTARTS(?l, "NATION_1") AS ?a) (STRENDS(?l, "7") AS ?z) (ENCODE_FOR_URI(?l) AS ?u) (STRBEFORE(?l, "_") AS ?b) (STRAFTER(?l, "_") AS ?c) (LCASE(?l) AS ?w) (CONTAINS(?l, "ON_2") AS ?h) WHERE { ?n a ex:Nation ; rdfs:label ?l }',
    ("nation",),
    "SELECT n_name AS l, starts_with(n_name, 'NATION_1')::VARCHAR AS a, ends_with(n_name, '7')::VARCHAR AS z, url_encode(n_name) AS u, split_part(n_name, '_', 1) AS b, split_part(n_name, '_', 2) AS c, lower(n_name) AS w, contains(n_name, 'ON_2')::VARCHAR AS h FROM nation",
)
sparql(
    "sparql_hashes_and_casts",
    'SELECT ?l (MD5(?l) AS ?m) (SHA1(?l) AS ?s) (SHA256(?l) AS ?t) (xsd:integer("12") + 1 AS ?i) (STR(xsd:boolean("true")) AS ?b) (xsd:string(7) AS ?x) (YEAR("2031-09-05T10:20:30"^^xsd:dateTime) AS ?y) (DAY("2031-09-05T10:20:30"^^xsd:dateTime) AS ?d) (HOURS("2031-09-05T10:20:30"^^xsd:dateTime) AS ?h) (MINUTES("2031-09-05T10:20:30"^^xsd:dateTime) AS ?n) WHERE { ?r a ex:Region ; rdfs:label ?l }',
    ("region",),
    "SELECT r_name AS l, md5(r_name) AS m, sha1(r_name) AS s, sha256(r_name) AS t, 13::BIGINT AS i, 'true' AS b, '7' AS x, 2031::BIGINT AS y, 5::BIGINT AS d, 10::BIGINT AS h, 20::BIGINT AS n FROM region",
    longs=("i", "y", "d", "h", "n"),
)
sparql(
    "sparql_optional_chain",
    "SELECT ?c ?o ?p WHERE { ?c a ex:Customer ; ex:segment \"AUTOMOBILE\" OPTIONAL { ?o ex:placedBy ?c ; ex:status \"P\" } OPTIONAL { ?o ex:total ?p FILTER(?p > 300000) } }",
    ("customer", "orders"),
    "WITH l AS (SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'AUTOMOBILE') LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'), big AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000) SELECT 'urn:x:customer:' || c_custkey AS c, 'urn:x:order:' || coalesce(o_orderkey, k) AS o, p::VARCHAR AS p FROM l LEFT JOIN big ON o_orderkey IS NULL OR o_orderkey = k",
)


sparql(
    "sparql_exists_in_expression",
    "SELECT ?c ?rich WHERE { ?c a ex:Customer ; ex:acctbal ?b FILTER(?b > 9000 || EXISTS { ?o ex:placedBy ?c ; ex:total ?t FILTER(?t > 350000) }) BIND(!EXISTS { ?p ex:placedBy ?c ; ex:status \"P\" } && ?b > 0 AS ?rich) }",
    ("customer", "orders"),
    "SELECT 'urn:x:customer:' || c_custkey AS c, (c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'))::VARCHAR AS rich FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)",
)


sparql(
    "sparql_exact_integers",
    "SELECT ?p (?s + 9007199254740993 AS ?a) (?s * 1000000000000000003 AS ?m) (9007199254740993 > 9007199254740992 AS ?gt) (9007199254740993 = 9007199254740992 AS ?eq) WHERE { ?p a ex:Part ; ex:size ?s }",
    ("part",),
    "SELECT 'urn:x:part:' || p_partkey AS p, (p_size::HUGEINT + 9007199254740993)::VARCHAR AS a, (p_size::HUGEINT * 1000000000000000003)::VARCHAR AS m, 'true' AS gt, 'false' AS eq FROM part",
)
sparql(
    "sparql_exact_sum",
    "SELECT ?b (SUM(?big) AS ?t) WHERE { ?p a ex:Part ; ex:brand ?b ; ex:size ?s BIND(?s * 9007199254740993 AS ?big) } GROUP BY ?b",
    ("part",),
    "SELECT p_brand AS b, sum(p_size::HUGEINT * 9007199254740993)::VARCHAR AS t FROM part GROUP BY p_brand",
)


@query("sparql_abstract_class", "SELECT 'urn:x:supplier:' || s_suppkey AS x FROM supplier UNION ALL SELECT 'urn:x:customer:' || c_custkey FROM customer")
def sparql_abstract_class(spark, d):
    text = gate.spread_class(HEAD + "SELECT ?x WHERE { ?x a ex:Party }", EX + "Party", PREFIXES)
    return lexical(gate.execute(star_triples(spark, d, "supplier", "customer"), text, cap=None))


@query("sparql_bound_placeholder", "SELECT 'urn:x:customer:' || c_custkey AS c FROM customer WHERE c_nationkey = 7")
def sparql_bound_placeholder(spark, d):
    text = gate.bind_terms(HEAD + f"SELECT ?c WHERE {{ ?c a ex:Customer ; ex:inNation <{gate.PLACEHOLDER}n> }}", {gate.PLACEHOLDER + "n": EX + "nation:7"})
    return lexical(gate.execute(star_triples(spark, d, "customer"), text, cap=None))


@query("sparql_compacted", "SELECT '{\"c\":\"urn:x:customer:' || c_custkey || '\"' || CASE WHEN o_orderkey IS NULL THEN '' ELSE ',\"o\":\"urn:x:order:' || o_orderkey || '\"' END || '}' AS row FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def sparql_compacted(spark, d):
    text = HEAD + "SELECT ?c ?o WHERE { ?c a ex:Customer OPTIONAL { ?o ex:placedBy ?c ; ex:total ?t FILTER(?t > 300000) } }"
    return gate.compacted(gate.execute(star_triples(spark, d, "customer", "orders"), text, cap=None))


@query("sparql_stored_graph", "SELECT 'urn:x:customer:' || c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def sparql_stored_graph(spark, d):
    stored = graph.cached_graph(star_triples(spark, d, "nation", "customer"))
    return lexical(gate.execute(stored, HEAD + 'SELECT ?c ?n WHERE { ?c ex:segment "BUILDING" ; ex:inNation/rdfs:label ?n }', cap=None))


# ---- graph -----------------------------------------------------------------------------


@query("integrity_duplicates", f"SELECT 'urn:x:nation:0' AS s, '{LABEL}' AS p, 'literal' AS o_kind, n_name AS o_value, '' AS o_datatype, '' AS o_lang, 2::BIGINT AS components FROM nation WHERE n_nationkey = 0")
def integrity_duplicates(spark, d):
    return graph.duplicated_triples(_broken_graph(spark, d))


@query("integrity_pages", "SELECT * FROM (VALUES ('urn:x:page:004', 'unexpected page'), ('urn:x:page:002', 'missing page')) t(iri, issue)")
def integrity_pages(spark, d):
    page = lambda n: (f"{EX}page:{n}", graph.TYPE, "iri", EX + "DocumentPage", "", "", f"page-{n}")
    triples = spark.createDataFrame([page(n) for n in ("001", "003", "004")], "s string, p string, o_kind string, o_value string, o_datatype string, o_lang string, component string")
    wanted = spark.createDataFrame([(f"{EX}page:{n}",) for n in ("001", "002", "003")], "iri string")
    return graph.page_set_issues(triples.unionByName(star_triples(spark, d, "region")), EX + "DocumentPage", wanted)


@query(
    "page_mismatches",
    "SELECT 'orders' AS component, 'urn:x:order:' || o_orderkey AS s, ['urn:x:page:' || o_orderstatus] AS pages FROM orders WHERE o_orderstatus <> 'F'",
)
def page_mismatches(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit(EX + "order:"), F.col("o_orderkey").cast("string")).alias("s"), F.lit(EX + "sourcePage").alias("p"), F.concat(F.lit(EX + "page:"), "o_orderstatus").alias("o_value"), F.lit("orders").alias("component"))
    return graph.page_mismatches(o, EX + "sourcePage", F.lit(EX + "page:F"))


@query(
    "graph_counts",
    "SELECT 'orders' AS component, 5 * count(*) AS triples, count(*) AS subjects FROM orders UNION ALL SELECT 'region', 2 * count(*), count(*) FROM region UNION ALL SELECT 'profile', 41, 18 UNION ALL SELECT '*', (SELECT 5 * count(*) FROM orders) + (SELECT 2 * count(*) FROM region) + 41, (SELECT count(*) FROM orders) + (SELECT count(*) FROM region) + 18",
)
def graph_counts(spark, d):
    return graph.graph_counts(star_triples(spark, d, "region", "orders"))


_ASSERTED = "'urn:x:assertion:' || substr(sha256(concat_ws(chr(31), 'run-1', 'u' || o_custkey, 'urn:x:order:' || o_orderkey, 'urn:x:status', 'literal', o_orderstatus, o_orderpriority)), 1, 24)"
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


@query(
    "reify",
    f"WITH f AS (SELECT {_ASSERTED} AS a, 'urn:x:order:' || o_orderkey AS s, o_orderstatus AS v, o_orderpriority AS q, 'u' || o_custkey AS u FROM orders) "
    f"SELECT s, 'urn:x:status' AS p, 'literal' AS o_kind, v AS o_value FROM f UNION ALL SELECT a, '{_RDF}type', 'iri', '{_RDF}Statement' FROM f UNION ALL SELECT a, '{_RDF}subject', 'iri', s FROM f UNION ALL SELECT a, '{_RDF}predicate', 'iri', 'urn:x:status' FROM f UNION ALL SELECT a, '{_RDF}object', 'literal', v FROM f "
    "UNION ALL SELECT a, 'http://www.w3.org/ns/prov#wasDerivedFrom', 'iri', 'urn:x:unit:' || u FROM f UNION ALL SELECT a, 'http://www.w3.org/ns/prov#wasGeneratedBy', 'iri', 'urn:x:run:run-1' FROM f UNION ALL SELECT a, 'urn:x:evidenceLocator', 'literal', q FROM f UNION ALL SELECT a, 'urn:x:evidenceQuote', 'literal', q FROM f UNION ALL SELECT a, 'urn:x:confidence', 'literal', '1.0' FROM f",
)
def reify(spark, d):
    return graph.reify(_order_facts(spark, d))


@query(
    "transport_resources",
    "SELECT 'urn:x:supplier:' || s_suppkey AS iri, 'urn:x:Supplier' AS types, s_name AS labels, 'urn:x:acctbal literal ' || s_acctbal || '|urn:x:inNation iri urn:x:nation:' || s_nationkey AS facts FROM supplier",
)
def transport(spark, d):
    out = graph.transport_resources(star_triples(spark, d, "supplier"), "urn:x:supplier:")
    facts = F.array_join(F.transform("facts", lambda f: F.concat_ws(" ", f.p, f.o_kind, f.o_value)), "|")
    return out.select("iri", F.array_join("types", ",").alias("types"), F.array_join("labels", ",").alias("labels"), facts.alias("facts"))


@query("compressed_iris", "SELECT iri, CASE WHEN starts_with(iri, 'urn:x:') THEN 'ex:' || substr(iri, 7) ELSE 'rdf:type' END AS short FROM (SELECT 'urn:x:part:' || p_partkey AS iri FROM part UNION ALL SELECT 'urn:x:Part' UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type')")
def compressed_iris(spark, d):
    t = star_triples(spark, d, "part").where((F.col("p") == graph.TYPE) & (F.col("component") == "part"))
    iris = t.select(F.explode(F.array("s", "p", "o_value")).alias("iri")).distinct()
    return iris.select("iri", graph.curie("iri", PREFIXES).alias("short"))


@query("source_texts", "SELECT 'urn:x:part:' || p_partkey AS s, p_name AS text FROM part")
def source_texts(spark, d):
    return graph.source_texts(star_triples(spark, d, "part"), graph.PREF)


@query("implicit_classes", "SELECT DISTINCT 'implicit-' || substr(sha256(label), 1, 12) AS term_id, label FROM query_terms q, (SELECT NULL) WHERE FALSE UNION ALL SELECT DISTINCT 'implicit-' || substr(sha256(mention), 1, 12), mention FROM query_terms WHERE mention IS NOT NULL AND NOT regexp_matches(mention, '^[a-z]+:') AND mention NOT IN (SELECT label FROM reference_terms)")
def implicit_classes(spark, d):
    return graph.implicit_classes(table(spark, d, "query_terms").select(F.col("mention").alias("label")), table(spark, d, "reference_terms").select("label"))


SQL["implicit_classes"] = "SELECT DISTINCT 'implicit-' || substr(sha256(mention), 1, 12) AS term_id, mention AS label FROM query_terms WHERE mention IS NOT NULL AND NOT regexp_matches(mention, '^[a-z]+:') AND mention NOT IN (SELECT label FROM reference_terms)"

_UNIT_LINES = (
    ("unit", _RDF + "type", "iri", "'urn:x:EvidenceUnit'", "", ""), ("unit", "http://purl.org/dc/terms/isPartOf", "iri", "document", "", ""), ("unit", "urn:x:locator", "literal", "locator", "string", ""), ("unit", "urn:x:contentHash", "literal", "content_hash", "string", ""),
    ("unit", "urn:x:sourceStatus", "literal", "source_status", "string", ""), ("unit", "urn:x:sourceHash", "literal", "source_hash", "string", ""), ("unit", "http://schema.org/text", "literal", "text", "", "ko"), ("unit", "urn:x:pdfPage", "literal", "pdf_page::VARCHAR", "integer", ""),
    ("unit", "urn:x:printedPage", "literal", "printed_page::VARCHAR", "integer", ""), ("document", _RDF + "type", "iri", "'http://www.w3.org/ns/prov#Entity'", "", ""), ("document", "http://purl.org/dc/terms/identifier", "literal", "document_id", "", ""), ("activity", _RDF + "type", "iri", "'http://www.w3.org/ns/prov#Activity'", "", ""),
    ("activity", "http://www.w3.org/ns/prov#generatedAtTime", "literal", "strftime(created_at, '%Y-%m-%dT%H:%M:%S')", "dateTime", ""), ("unit", "urn:x:sourceIssue", "literal", "unnest(source_issues)", "string", ""),
)
_SAFE = "regexp_replace({}, '[^A-Za-z0-9_.-]+', '-', 'g')"
_UNIT_BASE = f"u AS (SELECT *, 'urn:x:unit:' || {_SAFE.format('unit_id')} AS unit, 'urn:x:document:' || {_SAFE.format('document_id')} AS document, 'urn:x:run:r1:' || {_SAFE.format('unit_id')} AS activity FROM evidence_units)"
_PROVENANCE = "SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, '{k}' AS o_kind, {v} AS o_value, '{XSD + t if t else ''}' AS o_datatype, '{lang}' AS o_lang FROM u" for s, p, k, v, t, lang in _UNIT_LINES) + ") WHERE o_value IS NOT NULL AND s IS NOT NULL"


@query("provenance", f"WITH {_UNIT_BASE} {_PROVENANCE}")
def provenance(spark, d):
    return graph.provenance(table(spark, d, "evidence_units"), "r1")


_SPACES = {"hbu": "urn:h:", "foaf": "http://xmlns.com/foaf/0.1/", "org": "http://www.w3.org/ns/org#", "owl": "http://www.w3.org/2002/07/owl#"}
_TYPE_IRI = "CASE " + " ".join(f"WHEN starts_with(t, '{p}:') THEN '{ns}' || split_part(t, ':', -1)" for p, ns in _SPACES.items()) + " ELSE t END"


@query(
    "draft_graph",
    f"WITH {_UNIT_BASE}, e AS (SELECT 'urn:x:res:' || name_id AS s, label, identifier, types FROM candidate_entities), f AS (SELECT {_ASSERTED} AS a, 'urn:x:order:' || o_orderkey AS s, o_orderstatus AS v, o_orderpriority AS q, 'u' || o_custkey AS u FROM orders), "
    f"all_lines AS ({_PROVENANCE} UNION ALL SELECT s, '{LABEL}', 'literal', label, '', 'ko' FROM e WHERE label IS NOT NULL UNION ALL SELECT s, 'http://purl.org/dc/terms/identifier', 'literal', identifier, '', '' FROM e WHERE identifier IS NOT NULL UNION ALL SELECT s, '{_RDF}type', 'iri', {_TYPE_IRI}, '', '' FROM (SELECT s, unnest(types) AS t FROM e) UNION ALL SELECT s, p, o_kind, o_value, '', '' FROM ("
    + SQL["reify"].split(" FROM orders) ", 1)[1]
    + ")) SELECT DISTINCT * FROM all_lines",
)
def draft_graph(spark, d):
    entities = table(spark, d, "candidate_entities").select(F.concat(F.lit("urn:x:res:"), F.col("name_id").cast("string")).alias("iri"), "label", "identifier", "types")
    return graph.draft_graph(table(spark, d, "evidence_units"), entities, _order_facts(spark, d), "r1", _SPACES)


@query("turtle_round_trip", "SELECT 'urn:x:nation:' || n_nationkey AS s, n_name AS label, 'urn:x:region:' || n_regionkey AS region FROM nation")
def turtle_round_trip(spark, d):
    import uuid

    folder = f"{checkpoint_dir(spark).rstrip('/')}/tripleloom/nt-{uuid.uuid4().hex}"
    turtle.ntriples(star_triples(spark, d, "nation")).write.text(folder)

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([row for text in pdf["value"] for row in turtle.parse_turtle(text)], columns=["s", "p", "o_kind", "o_value", "o_datatype", "o_lang", "component"])

    back = spark.read.text(folder).mapInPandas(parse, "s string, p string, o_kind string, o_value string, o_datatype string, o_lang string, component string")
    wide = back.where(F.col("s").startswith("urn:x:nation:")).groupBy("s")
    return wide.agg(F.max(F.when(F.col("p") == LABEL, F.col("o_value"))).alias("label"), F.max(F.when(F.col("p") == EX + "inRegion", F.col("o_value"))).alias("region"))


@query("jsonl_round_trip", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def jsonl_round_trip(spark, d):
    import uuid

    folder = f"{checkpoint_dir(spark).rstrip('/')}/tripleloom/jsonl-{uuid.uuid4().hex}"
    files.write_records(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), folder)
    return files.read_jsonl(spark, folder, "o_orderkey bigint, o_orderstatus string, o_orderpriority string")


@query("run_manifest", "SELECT 'nation' AS name, count(*) AS rows, sum(('0x' || substr(md5(concat_ws(chr(31), n_name, n_nationkey::VARCHAR, n_regionkey::VARCHAR)), 1, 8))::BIGINT)::BIGINT AS digest FROM nation UNION ALL SELECT 'orders', count(*), sum(('0x' || substr(md5(concat_ws(chr(31), o_custkey::VARCHAR, o_orderkey::VARCHAR, o_orderstatus)), 1, 8))::BIGINT)::BIGINT FROM orders")
def run_manifest(spark, d):
    return files.run_manifest({"nation": table(spark, d, "nation"), "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")})


# ---- documents ------------------------------------------------------------------------------

_TAG_TESTS = {
    "fragment": f"len(list_filter(regexp_split_to_array(q, '{WS}'), lambda w: w <> '')) <= 4",
    "long_scenario": f"len(list_filter(regexp_split_to_array(q, '{WS}'), lambda w: w <> '')) >= 25",
    "greeting": "regexp_matches(q, '(^|[^\\pL\\pN_])(hola|buenos días|buenas)($|[^\\pL\\pN_])')",
    "first_person": "regexp_matches(q, '(^|[^\\pL\\pN_])(yo|me|mi|estoy|tengo|quiero|he)($|[^\\pL\\pN_])')",
    "time": "regexp_matches(q, '(^|[^\\pL\\pN_])(cuando|cuándo|fecha|plazo)($|[^\\pL\\pN_])')",
    "procedure": "regexp_matches(q, '(^|[^\\pL\\pN_])(como|cómo|donde|dónde|que pasos)($|[^\\pL\\pN_])')",
    "yes_no": "regexp_matches(q, '(^|[^\\pL\\pN_])(puedo|podría|se puede|hay que|tengo que)($|[^\\pL\\pN_])')",
    "conditional": "regexp_matches(q, '(^|[^\\pL\\pN_])si($|[^\\pL\\pN_])')",
    "explicit_question": "(contains(q, '?') OR contains(q, '¿'))",
}
_TAGGED = (
    f"tagged AS (SELECT conversation_id, question, CASE WHEN len(found) = 0 THEN ['other'] ELSE found END AS tags FROM (SELECT conversation_id, question, list_filter(["
    + ", ".join(f"CASE WHEN {test} THEN '{tag}' END" for tag, test in _TAG_TESTS.items())
    + f"], lambda x: x IS NOT NULL) AS found FROM (SELECT *, lower(question) AS q FROM ({_QUESTIONS}))))"
)


@query("style_tags", f"WITH {_TAGGED} SELECT conversation_id, array_to_string(tags, ',') AS tags FROM tagged")
def style_tags(spark, d):
    return _questions(spark, d).select("conversation_id", F.array_join(segments.style_tags(F.col("question")), ",").alias("tags"))


@query(
    "diverse_pick",
    f"WITH {_TAGGED}, one AS (SELECT conversation_id, unnest(tags) AS tag FROM tagged), seats AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY conversation_id) AS turn, list_position(['fragment', 'long_scenario', 'greeting', 'first_person', 'time', 'procedure', 'yes_no', 'conditional', 'explicit_question', 'other'], tag) AS seat FROM one), first AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn, seat) AS n FROM seats) SELECT conversation_id, tag FROM first WHERE n = 1 ORDER BY turn, seat LIMIT 48",
)
def diverse_pick(spark, d):
    return segments.diverse_pick(_questions(spark, d), "conversation_id", "question", 48)


_BLOCKS = (
    "blocks AS (SELECT unit_id, place, regexp_extract(part, '^\\[(BLOCK|ROW) ([^\\]\\n]*)\\] ?', 2) AS locator, lower(regexp_extract(part, '^\\[(BLOCK|ROW) ([^\\]\\n]*)\\] ?', 1)) AS kind, "
    "trim(regexp_replace(regexp_replace(part, '^\\[(BLOCK|ROW) ([^\\]\\n]*)\\] ?', ''), '\\n+$', ''), ' ') AS quote FROM (SELECT unit_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS place FROM (SELECT unit_id, string_split(regexp_replace(text, '(^|\\n)\\[(BLOCK|ROW) ', '\\1' || chr(1) || '[\\2 ', 'g'), chr(1)) AS parts FROM (SELECT DISTINCT unit_id, text FROM evidence_units))) WHERE regexp_matches(part, '^\\[(BLOCK|ROW) [^\\]\\n]*\\] ?'))"
)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return segments.unit_blocks(table(spark, d, "evidence_units").select("unit_id", "text").distinct())


@query("block_quotes", f"WITH {_BLOCKS} SELECT unit_id, locator, kind, quote FROM blocks")
def block_quotes(spark, d):
    return _blocks(spark, d).select("unit_id", "locator", "kind", "quote")


@query(
    "locator_chunks",
    f"WITH RECURSIVE {_BLOCKS}, n AS (SELECT unit_id, locator, length(quote) AS size, row_number() OVER (PARTITION BY unit_id ORDER BY place) AS i FROM blocks), "
    "walk(unit_id, i, chunk, filled, locator) AS (SELECT unit_id, i, 0, size, locator FROM n WHERE i = 1 UNION ALL SELECT n.unit_id, n.i, CASE WHEN filled > 0 AND filled + size > 1200 THEN chunk + 1 ELSE chunk END, CASE WHEN filled > 0 AND filled + size > 1200 THEN size ELSE filled + size END, n.locator FROM walk JOIN n ON n.unit_id = walk.unit_id AND n.i = walk.i + 1) "
    "SELECT unit_id, chunk, array_to_string(list_sort(list(locator)), ',') AS locators FROM walk GROUP BY unit_id, chunk",
)
def locator_chunks(spark, d):
    return segments.chunk_locators(_blocks(spark, d)).select("unit_id", "chunk", F.array_join("locators", ",").alias("locators"))


@query(
    "row_batches",
    f"WITH {_BLOCKS}, m AS (SELECT *, (kind = 'block' OR regexp_matches(quote, '\\d{{1,2}}:\\d{{2}}|\\d{{1,2}}월 ?\\d{{1,2}}일.*\\d{{1,2}}시')) AS alone FROM blocks), r AS (SELECT *, sum((alone OR coalesce(before, TRUE))::INTEGER) OVER (PARTITION BY unit_id ORDER BY place) AS run FROM (SELECT *, lag(alone) OVER (PARTITION BY unit_id ORDER BY place) AS before FROM m)), p AS (SELECT *, (row_number() OVER (PARTITION BY unit_id, run ORDER BY place) - 1) // 4 AS part FROM r) SELECT unit_id, array_to_string(list_sort(list(locator)), ',') AS locators FROM p GROUP BY unit_id, run, part",
)
def row_batches(spark, d):
    rows = _blocks(spark, d).withColumn("header", F.col("kind") == "block")
    return segments.row_batches(rows).select("unit_id", F.array_join("locators", ",").alias("locators"))


@query(
    "evidence_selection",
    f"WITH {_BLOCKS}, l AS (SELECT unit_id || '#' || lpad(place::VARCHAR, 4, '0') AS place, locator, trim(regexp_replace(quote, '\\s*<!--.*?-->\\s*', ' ', 'g'), ' ') AS quote FROM blocks WHERE NOT regexp_matches(quote, '^\\s*(#|\\||-{{3,}}|<!--)') AND length(regexp_replace(quote, '[|\\s*_`#>-]', '', 'g')) >= 20), f AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(quote, '{WS}', '', 'g')) ORDER BY place) AS same FROM l) SELECT locator || '-' || lpad((row_number() OVER (PARTITION BY locator ORDER BY place))::VARCHAR, 3, '0') || '-' || substr(sha256(quote), 1, 10) AS source_unit_id, locator FROM f WHERE same = 1",
)
def evidence_selection(spark, d):
    lines = _blocks(spark, d).select(F.concat_ws("#", "unit_id", F.lpad(F.col("place").cast("string"), 4, "0")).alias("place"), "locator", F.col("quote").alias("line"))
    return segments.evidence_units(lines).select("source_unit_id", "locator")


@query(
    "coverage_sets",
    "WITH u AS (SELECT DISTINCT unit_id, context.locators AS l, map_keys(context.evidence) AS f FROM evidence_units) SELECT unit_id, array_to_string(list_sort(list_distinct(l)), ',') AS target, array_to_string(list_sort(list_distinct(coalesce(f, []))), ',') AS fact, array_to_string(list_sort(list_filter(list_distinct(l), lambda x: NOT list_contains(coalesce(f, []), x))), ',') AS unresolved, len(list_filter(list_distinct(l), lambda x: NOT list_contains(coalesce(f, []), x))) = 0 AS complete FROM u WHERE len(l) > 0",
)
def coverage_sets(spark, d):
    u = _one(table(spark, d, "evidence_units"), "unit_id")
    targets = u.select("unit_id", F.explode("context.locators").alias("locator"))
    found = u.select("unit_id", F.explode(F.map_keys("context.evidence")).alias("locator"))
    none = targets.where(F.lit(False))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return E.coverage(targets, found, none, none).select("unit_id", joined("target"), joined("fact"), joined("unresolved"), "complete")


@query(
    "source_datetimes",
    f"WITH {_BLOCKS}, y AS (SELECT unit_id, locator, quote, TRY_CAST(nullif(regexp_extract(quote, '(\\d{{4}})\\s*학년도', 1), '') AS INTEGER) AS school FROM blocks), "
    "m AS (SELECT unit_id, locator, school, unnest(regexp_extract_all(quote, '(\\d{4}\\s*[.년]\\s*)?\\d{1,2}\\s*[.월]\\s*\\d{1,2}\\s*[.일]?\\s*(\\([^)]*\\))?\\s*\\d{1,2}:\\d{2}')) AS t FROM y), "
    "p AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, '^(\\d{4})\\s*[.년]', 1), '') AS INTEGER) AS own, regexp_extract(t, '(\\d{1,2})\\s*[.월]\\s*\\d{1,2}\\s*[.일]?\\s*(\\([^)]*\\))?\\s*\\d{1,2}:\\d{2}$', 1)::INTEGER AS mo, regexp_extract(t, '\\d{1,2}\\s*[.월]\\s*(\\d{1,2})\\s*[.일]?\\s*(\\([^)]*\\))?\\s*\\d{1,2}:\\d{2}$', 1)::INTEGER AS da, regexp_extract(t, '(\\d{1,2}):\\d{2}$', 1)::INTEGER AS h, regexp_extract(t, ':(\\d{2})$', 1)::INTEGER AS mi FROM m), "
    "q AS (SELECT *, TRY_CAST(lpad(coalesce(own, school + CASE WHEN mo <= 3 THEN 1 ELSE 0 END)::VARCHAR, 4, '0') || '-' || lpad(mo::VARCHAR, 2, '0') || '-' || lpad(da::VARCHAR, 2, '0') AS DATE) AS day FROM p) "
    "SELECT DISTINCT unit_id, locator, CASE WHEN h = 24 AND mi = 0 THEN strftime(day + 1, '%Y-%m-%d') || 'T00:00' ELSE strftime(day, '%Y-%m-%d') || 'T' || lpad(h::VARCHAR, 2, '0') || ':' || lpad(mi::VARCHAR, 2, '0') END || ':00+09:00' AS at FROM q WHERE day IS NOT NULL AND mi <= 59 AND (h <= 23 OR (h = 24 AND mi = 0))",
)
def source_datetimes(spark, d):
    found = _blocks(spark, d).select("unit_id", "locator", F.explode(E.source_datetimes(F.col("quote"), F.col("quote"))).alias("at"))
    return found.distinct()


@query("typed_datetimes", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') || 'T00:00:00+09:00' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+09:00' END AS at FROM orders")
def typed_datetimes(spark, d):
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    typed = F.when(k == 0, stamp).when(k == 1, F.concat(stamp, F.lit("+09:00"))).when(k == 2, F.concat(day, F.lit("T24:00"))).otherwise(F.concat(stamp, F.lit("Z")))
    return table(spark, d, "orders").select("o_orderkey", E.normalised_datetime(typed).alias("at"))


@query("notice_pages", "SELECT r_regionkey::BIGINT AS page_id, '알림 ' || r_name AS title, '2031.09.0' || (r_regionkey + 1) AS published_at, '첫 줄 ' || r_name || chr(10) || '둘째 줄' || chr(10) || '가' || chr(10) || '나' AS body, 1::INTEGER AS tables FROM region")
def notice_pages(spark, d):
    html = F.concat(
        F.lit("<html><div class='menu'>x</div><div class='board-default-view'><div class='subject'>분류 <strong>알림 "), F.col("r_name"), F.lit("</strong></div><span class='datetime'> 2031.09.0"), (F.col("r_regionkey") + 1).cast("string"),
        F.lit("</span><div class='content'><p>첫&nbsp;줄 "), F.col("r_name"), F.lit("<br>둘째 줄</p><table><tr><td>가</td></tr><tr><td>나</td></tr></table></div></div><div class='content'>no</div></html>"),
    )
    return segments.notices(table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("page_id"), html.alias("html")))


@query("html_grid", "SELECT n_nationkey::BIGINT AS page_id, c.r::INTEGER AS \"row\", c.k::INTEGER AS \"column\", CASE WHEN c.k = 0 THEN n_name WHEN c.r = 0 THEN 'wide' WHEN c.k = 1 THEN n_regionkey::VARCHAR ELSE '' END AS value FROM nation, (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)) c(r, k)")
def html_grid(spark, d):
    html = F.concat(F.lit("<table><tr><td rowspan=2>"), F.col("n_name"), F.lit("<td colspan='2'>wide</td></tr><tr><td>"), F.col("n_regionkey").cast("string"), F.lit("</td></tr></table>"))
    return segments.table_grid(table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("page_id"), html.alias("html"))).select("page_id", "row", "column", "value")


@query("clean_restorations", "SELECT restoration_id, trim(regexp_replace(regexp_replace(markdown, '(?m)^```[a-z]*[ \\t]*$\\n?', '', 'g'), '(?m)^[ \\t]*[-–—·]?[ \\t]*\\d{1,4}[ \\t]*[-–—·]?[ \\t]*$\\n?', '', 'g'), ' ') AS markdown FROM (SELECT DISTINCT restoration_id, markdown FROM restorations) WHERE markdown IS NOT NULL")
def clean_restorations(spark, d):
    rows = table(spark, d, "restorations").select("restoration_id", "markdown").where("markdown is not null").distinct()
    return rows.select("restoration_id", segments.clean_restoration(F.col("markdown")).alias("markdown"))


@query(
    "restatus",
    "SELECT restoration_id, CASE WHEN pdf_page % 5 = 0 THEN 'needs_review' WHEN coalesce(pdf_page, 1) % 2 = 0 AND coalesce(len(n), 0) = 0 AND coalesce(wc, 0) >= 0.98 THEN 'generated' ELSE s END AS status FROM (SELECT DISTINCT restoration_id, pdf_page, validation.unsupported_numbers AS n, validation.word_coverage AS wc, validation.status AS s FROM restorations)",
)
def restatus(spark, d):
    rows = table(spark, d, "restorations").select("restoration_id", "pdf_page", "validation").distinct()
    none, one = F.array().cast("array<string>"), F.array(F.lit("x"))
    alignment = F.when(F.col("pdf_page") % 5 == 0, one).otherwise(none)
    wide = F.when(F.coalesce("pdf_page", F.lit(1)) % 2 == 0, none).otherwise(one)
    status = pages.status_after_alignment(F.col("validation.status"), alignment, wide, F.coalesce("validation.unsupported_numbers", none), none, F.col("validation.word_coverage"))
    return rows.select("restoration_id", status.alias("status"))


@query("document_counts", "SELECT document_id AS document, count(*) FILTER (s = 'generated') AS generated, count(*) FILTER (s = 'needs_review') AS needs_review, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'failed') AS failed FROM (SELECT DISTINCT restoration_id, document_id, validation.status AS s FROM restorations) GROUP BY document_id")
def document_counts(spark, d):
    rows = table(spark, d, "restorations").select("restoration_id", F.col("document_id").alias("document"), F.col("validation.status").alias("status")).distinct()
    return pages.document_counts(rows)


# ---- tables -------------------------------------------------------------------------------------

_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag || ' ' || l_linestatus AS text FROM lineitem"


@query(
    "block_kinds",
    "WITH t AS (SELECT o_custkey AS page, o_orderkey AS line, (o_orderkey * 37) % 1000 AS top, 10 + o_orderkey % 9 AS height, CASE o_orderkey % 6 WHEN 0 THEN '※ 비고' WHEN 1 THEN '1. 항목' WHEN 2 THEN '가) 항목' WHEN 3 THEN o_orderpriority WHEN 4 THEN repeat('긴 문장 ', 20) ELSE '주: 알림' END AS text FROM orders), h AS (SELECT page, list_sort(list(height))[(count(*) // 2 + 1)::INTEGER] AS median FROM t GROUP BY page) SELECT t.page, line, CASE WHEN top >= 900 THEN 'footer' WHEN regexp_matches(text, '^\\s*(※|주\\)|주:|\\*)') THEN 'note' WHEN regexp_matches(text, '^\\s*([■▣◆]|\\d+[.)]|[가-힣][.)])') THEN 'list_item' WHEN length(text) <= 60 AND height >= median * 1.2 THEN 'heading' ELSE 'paragraph' END AS kind FROM t JOIN h ON t.page = h.page",
)
def block_kinds(spark, d):
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, "※ 비고").when(k == 1, "1. 항목").when(k == 2, "가) 항목").when(k == 3, F.col("o_orderpriority")).when(k == 4, F.repeat(F.lit("긴 문장 "), 20)).otherwise("주: 알림")
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("line"), ((F.col("o_orderkey") * 37) % 1000).alias("top"), (F.col("o_orderkey") % 9 + 10).alias("height"), text.alias("text"))
    rows = t.join(tables.median_heights(t), "page")
    return rows.select("page", "line", tables.block_kind(F.col("text"), F.col("top"), F.col("height"), F.lit(1000), F.col("median_height")).alias("kind"))


@query(
    "assigned_tokens",
    "SELECT o_orderkey AS token_id, (o_orderkey * 13 % 600) // 100 AS base_column, (o_orderkey * 7 % 400) // 50 AS base_row FROM orders",
)
def assigned_tokens(spark, d):
    x, y = F.col("o_orderkey") * 13 % 600, F.col("o_orderkey") * 7 % 400
    t = table(spark, d, "orders").select(F.lit(1).alias("page"), F.col("o_orderkey").alias("token_id"), (x - 2).alias("x0"), (y - 1).alias("y0"), (x + 2).alias("x1"), (y + 1).alias("y1"), F.lit("t").alias("text"))
    bands = lambda n, size: spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("band"), (F.col("id") * size).alias("low"), (F.col("id") * size + size - 1).alias("high"))
    return tables.assign_tokens(t, bands(6, 100), bands(8, 50)).select("token_id", "base_column", "base_row")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 4).cast("int").alias("column")).agg(F.min("l_partkey").cast("int").alias("cell"))


_CELLS = "cells AS (SELECT l_orderkey AS table_id, l_linenumber AS \"row\", (l_suppkey % 4)::INTEGER AS \"column\", min(l_partkey)::INTEGER AS cell FROM lineitem GROUP BY ALL)"


@query(
    "materialised_rows",
    f"WITH {_CELLS}, w AS (SELECT *, CASE WHEN cell % 3 = 0 THEN '' ELSE cell::VARCHAR END AS text, 1 + cell % 2 AS down, unnest(range(\"row\", \"row\" + 1 + cell % 2)) AS base_row FROM cells) SELECT table_id, base_row::INTEGER AS base_row, \"column\" AS base_column, text AS value, CASE WHEN text = '' THEN 'empty' WHEN base_row = \"row\" THEN 'direct' ELSE 'rowspan_inheritance' END AS mode FROM w",
)
def materialised_rows(spark, d):
    c = _cells(spark, d).select("table_id", "cell", "row", "column", (F.col("cell") % 2 + 1).alias("rowspan"), F.lit(1).alias("colspan"))
    # one text for each cell of a table
    texts = c.select("table_id", "cell", F.when(F.col("cell") % 3 == 0, "").otherwise(F.col("cell").cast("string")).alias("text")).distinct()
    return tables.materialised_rows(c, texts)


_GRID = f"{_CELLS}, g AS (SELECT table_id, \"row\" AS base_row, \"column\" AS base_column, CASE WHEN cell % 3 = 0 THEN '' WHEN cell % 3 = 1 THEN cell::VARCHAR ELSE 'c' || cell END AS value FROM cells)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("cell") % 3
    return _cells(spark, d).select("table_id", F.col("row").alias("base_row"), F.col("column").alias("base_column"), F.when(k == 0, "").when(k == 1, F.col("cell").cast("string")).otherwise(F.concat(F.lit("c"), F.col("cell").cast("string"))).alias("value"))


@query("header_ends", f"WITH {_GRID}, f AS (SELECT table_id, base_row, count(DISTINCT base_column) AS filled FROM g WHERE value <> '' GROUP BY ALL), w AS (SELECT table_id, max(base_column) + 1 AS width FROM g GROUP BY table_id) SELECT f.table_id, (min(base_row) - 1)::INTEGER AS header_end FROM f JOIN w ON f.table_id = w.table_id WHERE filled >= greatest(2, width - 1) GROUP BY f.table_id")
def header_ends(spark, d):
    return tables.header_end(_grid(spark, d))


@query("anchor_columns", f"WITH {_GRID}, s AS (SELECT table_id, base_column, count(DISTINCT base_row) * (1 - avg(CASE WHEN regexp_matches(value, '^[\\d\\s.,%:~-]+$') THEN 1.0 ELSE 0.0 END)) AS score FROM g WHERE value <> '' GROUP BY ALL) SELECT table_id, base_column AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, base_column DESC) AS n FROM s) WHERE n = 1")
def anchor_columns(spark, d):
    return tables.anchor_column(_grid(spark, d))


@query("header_paths", f"WITH {_GRID}, h AS (SELECT table_id, base_column, list_distinct(list(value ORDER BY base_row, value)) AS seen, list(value ORDER BY base_row, value) AS v FROM g WHERE value <> '' AND base_row <= 3 GROUP BY ALL) SELECT table_id, base_column, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ' > ') AS path FROM h")
def header_paths(spark, d):
    h = _grid(spark, d).where("value != '' and base_row <= 3")
    return tables.header_paths(h.select("table_id", "base_row", F.col("base_column").alias("first_column"), F.col("base_column").alias("last_column"), F.col("value").alias("text")))


@query(
    "inherited_titles",
    "WITH t AS (SELECT p_partkey AS table_id, p_brand AS document, (p_partkey // 3) AS page, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_name END AS title, p_size AS signature FROM part), m AS (SELECT a.table_id, count(*) AS n, min(b.table_id) AS continues FROM t a JOIN t b ON a.document = b.document AND a.page = b.page + 1 AND a.signature = b.signature WHERE a.title = '' GROUP BY a.table_id HAVING count(*) = 1) SELECT t.table_id, coalesce(nullif(t.title, ''), o.title) AS title, m.continues FROM t LEFT JOIN m ON t.table_id = m.table_id LEFT JOIN t o ON o.table_id = m.continues",
)
def inherited_titles(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("table_id"), F.col("p_brand").alias("document"), F.floor(F.col("p_partkey") / 3).alias("page"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_name")).alias("title"), F.col("p_size").alias("signature"))
    return tables.inherited_titles(t)


_KEYS = "k AS (SELECT p_brand AS table_id, p_partkey AS base_column, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_name ELSE lower(regexp_replace(p_name, '[^A-Za-z]+', '_', 'g')) END AS key FROM part WHERE p_partkey % 11 <> 0), c AS (SELECT p_brand AS table_id, p_partkey AS base_column FROM part WHERE p_partkey % 13 <> 0)"


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("base_column"), "p_name")
    made = F.when(F.col("base_column") % 7 == 0, F.lit(None)).when(F.col("base_column") % 5 == 0, F.col("p_name")).otherwise(F.lower(F.regexp_replace("p_name", "[^A-Za-z]+", "_")))
    return p.where("base_column % 13 != 0").select("table_id", "base_column"), p.where("base_column % 11 != 0").select("table_id", "base_column", made.alias("key"))


@query(
    "key_issues",
    f"WITH {_KEYS}, b AS (SELECT coalesce(c.table_id, k.table_id) AS table_id, c.base_column IS NULL AS extra, k.key FROM c FULL JOIN k ON c.table_id = k.table_id AND c.base_column = k.base_column) SELECT DISTINCT * FROM (SELECT table_id, 'unknown column' AS issue FROM b WHERE extra UNION ALL SELECT table_id, 'missing column' FROM b WHERE NOT extra AND key IS NULL UNION ALL SELECT table_id, 'bad key' FROM b WHERE key IS NOT NULL AND NOT regexp_matches(key, '^[a-z][a-z0-9_]*$') UNION ALL SELECT table_id, 'repeated key' FROM k WHERE key IS NOT NULL GROUP BY table_id, key HAVING count(*) > 1)",
)
def key_issues(spark, d):
    return tables.key_issues(*_keys(spark, d))


@query("attached_keys", f"WITH {_KEYS} SELECT c.table_id, c.base_column, 'column_' || c.base_column AS key, k.key AS suggested FROM c LEFT JOIN k ON c.table_id = k.table_id AND c.base_column = k.base_column")
def attached_keys(spark, d):
    return tables.attached_keys(*_keys(spark, d))


@query("geometry_summary", f"WITH {_GRID} SELECT table_id, count(DISTINCT base_row) AS rows, count(DISTINCT base_column) AS columns, string_agg(base_row || ',' || base_column || '=' || value, ';' ORDER BY base_row, base_column) AS cells FROM g GROUP BY table_id")
def geometry_summary(spark, d):
    t = _grid(spark, d).select("table_id", "base_row", "base_column", F.lit(0).alias("y0"), F.lit(0).alias("x0"), F.col("value").alias("text"))
    cells = F.array_join(F.transform("cells", lambda c: F.concat(c.base_row.cast("string"), F.lit(","), c.base_column.cast("string"), F.lit("="), c.text)), ";")
    return tables.geometry_summary(t).select("table_id", "rows", "columns", cells.alias("cells"))


@query("review_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 300000")
def review_rows(spark, d):
    one, none = F.array(F.lit("x")), F.array().cast("array<string>")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", one).otherwise(none).alias("table_issues"), F.when(F.col("o_totalprice") > 300000, one).alias("row_issues"))
    return tables.review_rows(rows).select("o_orderkey")


@query("viewer_matches", f"SELECT DISTINCT e.name_id, coalesce(contains(regexp_replace(u.text, '{WS}', '', 'g'), regexp_replace(e.label, '{WS}', '', 'g')), FALSE) AS matched FROM candidate_entities e JOIN evidence_units u ON e.unit_id = u.unit_id")
def viewer_matches(spark, d):
    e, u = table(spark, d, "candidate_entities").select("name_id", "unit_id", "label"), table(spark, d, "evidence_units").select("unit_id", "text")
    return e.join(u, "unit_id").select("name_id", tables.viewer_match(F.col("label"), F.col("text")).alias("matched")).distinct()


@query("page_summary", "SELECT o_custkey AS page, min(o_totalprice / 600000) AS least_confidence, bool_and(o_orderstatus <> 'P') AS all_matched, CASE WHEN min(o_totalprice / 600000) >= 0.9 AND bool_and(o_orderstatus <> 'P') THEN 'verified' ELSE 'needs_review' END AS status FROM orders GROUP BY o_custkey")
def page_summary(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_totalprice") / 600000).alias("confidence"), (F.col("o_orderstatus") != "P").alias("matched"))
    return pages.page_summary(t)


@query(
    "table_context",
    "WITH b AS (SELECT o_custkey AS page, o_orderkey AS block, o_orderkey * 29 % 1000 AS y0, o_orderkey * 29 % 1000 + 20 AS y1, o_orderpriority AS text, CASE WHEN o_orderstatus = 'F' THEN 'paragraph' WHEN o_orderstatus = 'O' THEN 'note' ELSE 'heading' END AS kind FROM orders), t AS (SELECT c_custkey AS table_id, c_custkey AS page, 400 AS top, 600 AS bottom FROM customer), a AS (SELECT table_id, string_agg(text, '|' ORDER BY y0, text) AS before FROM (SELECT t.table_id, b.text, b.y0, row_number() OVER (PARTITION BY t.table_id ORDER BY y1 DESC, block DESC) AS n FROM t JOIN b ON t.page = b.page WHERE y1 <= top AND top - y1 <= 200) WHERE n <= 3 GROUP BY table_id), z AS (SELECT t.table_id, string_agg(b.text, '|' ORDER BY y0, text) AS after FROM t JOIN b ON t.page = b.page WHERE y0 >= bottom AND y0 - bottom <= 300 AND kind IN ('note', 'paragraph') GROUP BY t.table_id) SELECT t.table_id, coalesce(before, '') AS before, coalesce(after, '') AS after FROM t LEFT JOIN a ON t.table_id = a.table_id LEFT JOIN z ON t.table_id = z.table_id",
)
def table_context(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "paragraph").when(F.col("o_orderstatus") == "O", "note").otherwise("heading")
    y = F.col("o_orderkey") * 29 % 1000
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("block"), y.alias("y0"), (y + 20).alias("y1"), F.col("o_orderpriority").alias("text"), kind.alias("kind"))
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("table_id"), F.col("c_custkey").alias("page"), F.lit(400).alias("y0"), F.lit(600).alias("y1"))
    return pages.table_context(t, b).select("table_id", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


# ---- facts ------------------------------------------------------------------------------------------

_SQUEEZE = f"regexp_replace(@, '({WS[:-1]}|[|`*_#])+', '', 'g')"


@query("grounded_entities", f"SELECT DISTINCT e.name_id, CASE WHEN contains(u.text, e.identifier) THEN e.identifier END AS identifier FROM candidate_entities e JOIN (SELECT DISTINCT unit_id, text FROM evidence_units) u ON e.unit_id = u.unit_id WHERE contains({_SQUEEZE.replace('@', 'u.text')}, {_SQUEEZE.replace('@', 'e.label')})")
def grounded_entities(spark, d):
    e = table(spark, d, "candidate_entities").select("name_id", "unit_id", "entity_id", "label", "identifier", "types")
    return E.grounded_entities(e, table(spark, d, "evidence_units").select("unit_id", "text").distinct()).select("name_id", "identifier").distinct()


@query("merged_entities", "WITH e AS (SELECT DISTINCT unit_id, entity_id, name_id, label, types FROM candidate_entities) SELECT unit_id, entity_id, first(label ORDER BY name_id, label) AS label, array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') AS types FROM e GROUP BY unit_id, entity_id")
def merged_entities(spark, d):
    e = table(spark, d, "candidate_entities").select("unit_id", "entity_id", F.col("name_id").alias("batch"), "label", "types").distinct()
    return E.merged_entities(e).select("unit_id", "entity_id", "label", F.array_join(F.array_sort("types"), ",").alias("types"))


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts and entities of orders: each customer is a unit."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 6
    kind = F.when(k == 0, "integer").when(k == 1, "decimal").when(k == 2, "boolean").when(k == 3, "string").when(k == 4, "entity").otherwise("date")
    value = (
        F.when(k == 0, (F.col("o_orderkey") % 50).cast("string")).when(k == 1, F.concat((F.col("o_orderkey") % 20).cast("string"), F.lit(".5"))).when(k == 2, F.when(F.col("o_orderkey") % 4 == 0, "true").otherwise("false"))
        .when(k == 3, F.col("o_orderpriority")).when(k == 4, F.concat(F.lit("e"), (F.col("o_orderkey") % 3).cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    quote = F.concat(F.lit("수량 "), (F.col("o_orderkey") % 25).cast("string"), F.lit("개 5 "), F.when(F.col("o_orderkey") % 8 == 0, "허용").when(F.col("o_orderkey") % 8 == 2, "금지").otherwise("안내"), F.lit(" "), F.date_format("o_orderdate", "M월 d일"))
    grounding = F.concat(quote, F.lit(" "), F.when(F.col("o_orderstatus") == "F", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("학년도"))).otherwise(""), F.lit(" "), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")))
    facts = o.select(
        F.col("o_custkey").cast("string").alias("unit_id"), F.col("o_orderkey").alias("fact_id"), F.concat(F.lit("e"), (F.col("o_orderkey") % 4).cast("string")).alias("subject"), F.concat(F.lit("p"), k.cast("string")).alias("predicate"), kind.alias("object_kind"),
        value.alias("object_value"), F.lit("loc").alias("locator"), quote.alias("quote"), grounding.alias("grounding"), (F.col("o_totalprice") / 400000).alias("confidence"),
    )
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("unit_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), "c_mktsegment")
    entities = c.select("unit_id", F.concat(F.lit("e"), F.col("i").cast("string")).alias("entity_id"), F.col("c_mktsegment").alias("label"), F.lit(None).cast("string").alias("identifier"), F.when(F.col("i") == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("B"), F.col("c_mktsegment"))).alias("types"))
    return facts, entities


_FACTS = (
    "f AS (SELECT o_custkey::VARCHAR AS unit_id, o_orderkey AS fact_id, 'e' || o_orderkey % 4 AS subject, 'p' || o_orderkey % 6 AS predicate, ['integer', 'decimal', 'boolean', 'string', 'entity', 'date'][(o_orderkey % 6 + 1)::INTEGER] AS kind, "
    "CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 50)::VARCHAR WHEN 1 THEN (o_orderkey % 20) || '.5' WHEN 2 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'true' ELSE 'false' END WHEN 3 THEN o_orderpriority WHEN 4 THEN 'e' || o_orderkey % 3 ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value, "
    "o_orderkey % 25 AS number, CASE o_orderkey % 8 WHEN 0 THEN 'yes' WHEN 2 THEN 'no' ELSE '' END AS cue, o_orderdate AS day, o_orderstatus AS status, o_orderkey % 5 <> 0 AS named, o_totalprice / 400000 AS confidence FROM orders)"
)
#: Numbers of the quote: the quantity, 5, and the month and day.
_IN_QUOTE = "[number, 5, month(day), dayofmonth(day)]"
_VALID = (
    f"CASE kind WHEN 'integer' THEN list_contains({_IN_QUOTE}, TRY_CAST(value AS BIGINT)) WHEN 'decimal' THEN list_contains({_IN_QUOTE}, TRY_CAST(split_part(value, '.', 1) AS BIGINT)) WHEN 'boolean' THEN CASE value WHEN 'true' THEN cue = 'yes' ELSE cue = 'no' END "
    "WHEN 'string' THEN named WHEN 'entity' THEN subject <> value WHEN 'date' THEN status = 'F' END"
)


@query("valid_facts", f"WITH {_FACTS}, v AS (SELECT *, {_VALID} AS good FROM f) SELECT fact_id FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, subject, predicate, kind, value ORDER BY fact_id) AS n FROM v WHERE good AND subject <> 'e3' AND unit_id IN (SELECT c_custkey::VARCHAR FROM customer)) WHERE n = 1")
def valid_facts(spark, d):
    return E.valid_facts(*_facts(spark, d)).select("fact_id")


@query("referenced_entities", f"WITH {_FACTS} SELECT DISTINCT unit_id, e AS entity_id FROM (SELECT unit_id, subject AS e FROM f UNION ALL SELECT unit_id, value FROM f WHERE kind = 'entity') WHERE e <> 'e3' AND unit_id IN (SELECT c_custkey::VARCHAR FROM customer)")
def referenced_entities(spark, d):
    facts, entities = _facts(spark, d)
    return E.referenced_entities(entities, facts).select("unit_id", "entity_id")


@query(
    "candidate_issues",
    f"WITH {_FACTS}, u AS (SELECT c_custkey::VARCHAR AS unit_id, c_mktsegment AS seg FROM customer), g AS (SELECT f.*, u.unit_id IS NOT NULL AS known FROM f LEFT JOIN u ON f.unit_id = u.unit_id) SELECT DISTINCT * FROM ("
    "SELECT unit_id, 'unknown entity type' AS issue FROM u WHERE seg NOT IN ('BUILDING') UNION ALL SELECT unit_id, 'undeclared subject' FROM g WHERE subject = 'e3' OR NOT known UNION ALL SELECT unit_id, 'unknown predicate' FROM g WHERE predicate = 'p5' UNION ALL SELECT unit_id, 'undeclared object' FROM g WHERE kind = 'entity' AND NOT known UNION ALL SELECT unit_id, 'relation to itself' FROM g WHERE kind = 'entity' AND subject = value "
    f"UNION ALL SELECT unit_id, 'number not in the quote' FROM g WHERE kind = 'integer' AND NOT list_contains({_IN_QUOTE}, TRY_CAST(value AS BIGINT)) UNION ALL SELECT unit_id, 'number not in the quote' FROM g WHERE kind = 'decimal' AND NOT list_contains({_IN_QUOTE}, TRY_CAST(split_part(value, '.', 1) AS BIGINT)) UNION ALL SELECT unit_id, 'string not in the grounding' FROM g WHERE kind = 'string' AND NOT named "
    "UNION ALL SELECT unit_id, 'date not supported' FROM g WHERE kind = 'date' AND status <> 'F' UNION ALL SELECT unit_id, 'yes without a cue' FROM g WHERE kind = 'boolean' AND value = 'true' AND cue <> 'yes' UNION ALL SELECT unit_id, 'no without a cue' FROM g WHERE kind = 'boolean' AND value = 'false' AND cue <> 'no' UNION ALL SELECT unit_id, 'confidence outside 0..1' FROM g WHERE confidence > 1 OR confidence < 0 "
    "UNION ALL SELECT unit_id, 'subject outside the domain' FROM g WHERE predicate = 'p3' AND (NOT known OR subject = 'e3' OR subject = 'e0') UNION ALL SELECT unit_id, 'repeated fact' FROM g GROUP BY unit_id, subject, predicate, kind, value HAVING count(*) > 1 UNION ALL SELECT unit_id, 'label not in the unit' FROM u WHERE unit_id::BIGINT % 2 = 1)",
)
def candidate_issues(spark, d):
    facts, entities = _facts(spark, d)
    c = table(spark, d, "customer")
    units = c.select(F.col("c_custkey").cast("string").alias("unit_id"), F.when(F.col("c_custkey") % 2 == 1, "").otherwise(F.col("c_mktsegment")).alias("text"))
    none = []
    rows = [("A", "class", none, none), ("B", "class", none, none), ("BUILDING", "class", none, none), ("p0", "datatype_property", none, [XSD + "integer"]), ("p1", "datatype_property", none, none), ("p2", "datatype_property", none, none), ("p3", "datatype_property", ["B"], none), ("p4", "object_property", none, none)]
    return E.candidate_issues(units, entities, facts, spark.createDataFrame(rows, "iri string, kind string, domains array<string>, ranges array<string>"))


@query(
    "domain_range_issues",
    f"WITH {_FACTS}, g AS (SELECT f.*, unit_id IN (SELECT c_custkey::VARCHAR FROM customer) AS known FROM f) SELECT unit_id, fact_id, 'domain' AS issue FROM g WHERE predicate IN ('p3', 'p4') AND (NOT known OR subject IN ('e0', 'e3')) UNION ALL SELECT unit_id, fact_id, 'range' FROM g WHERE predicate = 'p4' AND (NOT known OR value <> 'e0')",
)
def domain_range_issues(spark, d):
    facts, entities = _facts(spark, d)
    terms = spark.createDataFrame([("p3", ["T"], []), ("p4", ["B"], ["A"])], "iri string, domains array<string>, ranges array<string>")
    closure = spark.createDataFrame([("A", "A"), ("B", "B"), ("B", "T")], "cls string, ancestor string")
    return E.domain_range_issues(facts, entities, terms, closure)


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("u"), F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("b"), F.date_format(F.date_add("o_orderdate", (F.col("o_orderkey") % 5 - 2).cast("int")), "yyyy-MM-dd").alias("e"))
    line = lambda s, p, v: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), v.alias("object_value"))
    i = F.concat(F.lit("i"), "k")
    x, y = F.concat(F.lit("x"), "k"), F.concat(F.lit("y"), "k")
    return o.select(F.col("u").alias("unit_id"), F.inline(F.array(line(i, "begin", x), line(i, "end", y), line(x, "date", F.col("b")), line(y, "date", F.col("e")))))


@query("without_reversed", "SELECT o_custkey::VARCHAR AS unit_id, s AS subject, p AS predicate, v AS object_value FROM (SELECT o_custkey, o_orderkey % 5 AS m, unnest(['i' || o_orderkey, 'i' || o_orderkey, 'x' || o_orderkey, 'y' || o_orderkey]) AS s, unnest(['begin', 'end', 'date', 'date']) AS p, unnest(['x' || o_orderkey, 'y' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate::DATE + (o_orderkey % 5 - 2)::INTEGER, '%Y-%m-%d')]) AS v FROM orders) WHERE p = 'date' OR m >= 2")
def without_reversed(spark, d):
    return E.without_reversed(_intervals(spark, d), "begin", "end", "date").select("unit_id", "subject", "predicate", "object_value")


@query("recovered_instants", "SELECT o_custkey::VARCHAR AS unit_id, c || o_orderkey AS entity_id, CASE c WHEN 'x' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate::DATE + (o_orderkey % 5 - 2)::INTEGER, '%Y-%m-%d') END AS label FROM orders, (VALUES ('x'), ('y')) t(c) WHERE NOT (c = 'x' AND o_orderkey % 3 = 0)")
def recovered_instants(spark, d):
    facts = _intervals(spark, d)
    known = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("unit_id"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("entity_id"))
    return E.recovered_instants(facts, known, ("date",)).select("unit_id", "entity_id", "label")


@query("unwrapped_scalars", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type ELSE '' END AS value FROM events")
def unwrapped_scalars(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("event_type")).when(k == 1, F.to_json(F.struct(F.struct(F.col("event_type").alias("text")).alias("value")))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", E.unwrapped(raw).alias("value"))


@query("expanded_references", "SELECT fact_id, CASE WHEN subject = 'e1' THEN 'urn:x:one' ELSE subject END AS subject FROM (SELECT o_orderkey AS fact_id, 'e' || o_orderkey % 4 AS subject FROM orders)")
def expanded_references(spark, d):
    aliases = spark.createDataFrame([("e1", "urn:x:one"), ("e2", "urn:x:two"), ("e2", "urn:x:other")], "alias string, iri string")
    return E.expand_references(_facts(spark, d)[0], aliases, "subject").select("fact_id", "subject")


# ---- reconciliation -------------------------------------------------------------------------------------

_VECTORS = (
    "v AS (SELECT a.vec_id::VARCHAR AS term_key, b.vec_id::VARCHAR AS iri, CASE WHEN a.label = b.label THEN 0.9 ELSE 0.5 END AS lexical, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS embedding, a.label % 3 = b.label % 3 AS compatible, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), "
    "s AS (SELECT *, round(0.45 * lexical + 0.55 * embedding, 6) AS combined FROM v)"
)


def _vector_scores(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    a = v.where("vec_id % 20 = 0").alias("a")
    pairs = a.join(v.alias("b"), F.col("a.vec_id") != F.col("b.vec_id"))
    rows = pairs.select(
        F.col("a.vec_id").cast("string").alias("term_key"), F.col("b.vec_id").cast("string").alias("iri"), F.when(F.col("a.label") == F.col("b.label"), 0.9).otherwise(0.5).alias("lexical"),
        X.vector_cosine(F.col("a.embedding"), F.col("b.embedding")).alias("embedding"), (F.col("a.label") % 3 == F.col("b.label") % 3).alias("compatible"), F.lit(False).alias("same_label"), F.lit("class").alias("kind"),
    )
    return rows.withColumn("combined", fuzzy.combined_score(F.col("lexical"), F.col("embedding")))


@query("alignment_verdicts", f"WITH {_VECTORS} SELECT term_key, iri, round(combined, 4) AS combined, CASE WHEN compatible AND combined >= 0.93 AND lexical >= 0.85 AND embedding >= 0.9 THEN 'auto' ELSE 'review' END AS status FROM s WHERE combined >= 0.78 OR embedding >= 0.82")
def alignment_verdicts(spark, d):
    s = _vector_scores(spark, d).withColumn("status", reconcile.verdict(F.col("combined"), F.col("lexical"), F.col("embedding"), F.col("compatible"), F.col("same_label")))
    return s.where("status != 'distinct'").select("term_key", "iri", F.round("combined", 4).alias("combined"), "status")


@query("aligned_terms", f"WITH {_VECTORS}, p AS (SELECT *, row_number() OVER (PARTITION BY term_key ORDER BY combined DESC, lexical DESC, iri DESC) AS n FROM s WHERE combined >= 0.78 OR embedding >= 0.82), b AS (SELECT * FROM p WHERE n = 1) SELECT e.vec_id::VARCHAR AS term_key, b.iri AS target, CASE WHEN b.iri IS NULL THEN 'distinct' WHEN b.compatible AND b.combined >= 0.93 AND b.lexical >= 0.85 AND b.embedding >= 0.9 THEN 'auto' ELSE 'review' END AS status FROM embeddings e LEFT JOIN b ON b.term_key = e.vec_id::VARCHAR WHERE e.vec_id % 20 = 0")
def aligned_terms(spark, d):
    s = _vector_scores(spark, d)
    return reconcile.align_terms(s, s.where(F.lit(False)))


_YES, _NO = "(가능|허용|필수|포함|인정)", "(불가|금지|제외|미인정|불허)"


@query("polarity", f"WITH t AS (SELECT DISTINCT conversation_id, reference_answer AS a, evidence[1].quote AS b FROM qa_records), p AS (SELECT conversation_id, regexp_matches(a, '{_YES}') AS ya, regexp_matches(a, '{_NO}') AS na, regexp_matches(b, '{_YES}') AS yb, regexp_matches(b, '{_NO}') AS nb FROM t WHERE a IS NOT NULL AND b IS NOT NULL) SELECT conversation_id, NOT ((ya AND NOT na AND nb AND NOT yb) OR (na AND NOT ya AND yb AND NOT nb)) AS compatible FROM p")
def polarity(spark, d):
    rows = table(spark, d, "qa_records").select("conversation_id", "reference_answer", F.get(F.col("evidence"), 0)["quote"].alias("quote")).distinct().where("reference_answer is not null and quote is not null")
    return rows.select("conversation_id", reconcile.polarity_compatible(F.col("reference_answer"), F.col("quote")).alias("compatible"))


_TERMS = "t AS (SELECT DISTINCT name_id, kind, coalesce(domains, []) AS dm, coalesce(ranges, []) AS rg, label FROM ontology_terms WHERE label IS NOT NULL)"


@query("structure", f"WITH {_TERMS} SELECT a.name_id AS a, b.name_id AS b, a.kind = b.kind AND (a.kind = 'class' OR (((len(a.dm) = 0 AND len(b.dm) = 0) OR list_has_any(a.dm, b.dm)) AND ((len(a.rg) = 0 AND len(b.rg) = 0) OR list_has_any(a.rg, b.rg)))) AS compatible FROM t a JOIN t b ON a.label = b.label AND a.name_id < b.name_id")
def structure(spark, d):
    none = F.array().cast("array<string>")
    t = table(spark, d, "ontology_terms").where("label is not null").select("name_id", "kind", F.coalesce("domains", none).alias("dm"), F.coalesce("ranges", none).alias("rg"), "label").distinct()
    a, b = t.alias("a"), t.alias("b")
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.name_id") < F.col("b.name_id")))
    c = F.col
    return pairs.select(c("a.name_id").alias("a"), c("b.name_id").alias("b"), reconcile.structure_compatible(c("a.kind"), c("b.kind"), c("a.dm"), c("b.dm"), c("a.rg"), c("b.rg")).alias("compatible"))


@query(
    "consolidated_schema",
    "WITH p AS (SELECT p_brand AS target, p_type AS kind, p_name AS label, p_name || ' ' || p_size AS definition, p_type AS dm FROM part), k AS (SELECT target, arg_min(kind, (-n, kind)) AS kind FROM (SELECT target, kind, count(*) AS n FROM p GROUP BY ALL) GROUP BY target) SELECT p.target, any_value(k.kind) AS kind, arg_min(label, (length(label), label)) AS label, arg_min(definition, (length(definition), definition)) AS definition, array_to_string(list_sort(list(DISTINCT dm)), ',') AS domains FROM p JOIN k ON p.target = k.target GROUP BY p.target",
)
def consolidated_schema(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("target"), F.col("p_type").alias("kind"), F.col("p_name").alias("label"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("definition"), F.array("p_type").alias("domains"), F.array().cast("array<string>").alias("ranges"))
    return reconcile.consolidated_schema(p).select("target", "kind", "label", "definition", F.array_join("domains", ",").alias("domains"))


_CHOICE_ROOT = "urn:hbu-chatbot:resource:dept"


@query("grouped_proposals", f"SELECT selected_iri AS target, count(DISTINCT mention_id) AS n, array_to_string(list_sort(list(DISTINCT mention_id::VARCHAR)), ',') AS candidates FROM term_choices WHERE starts_with(selected_iri, '{_CHOICE_ROOT}') GROUP BY selected_iri")
def grouped_proposals(spark, d):
    t = table(spark, d, "term_choices").select(F.col("mention_id").cast("string").alias("candidate_iri"), F.col("selected_iri").alias("target")).where("target is not null")
    return reconcile.grouped_proposals(t.select("candidate_iri"), t, _CHOICE_ROOT).select("target", "n", F.array_join("candidates", ",").alias("candidates"))


@query("stale_inputs", "SELECT coalesce(a.k, b.k)::VARCHAR AS name, CASE WHEN b.k IS NULL THEN 'missing input' WHEN a.k IS NULL THEN 'new input' ELSE 'changed input' END AS issue FROM (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.h <> b.h")
def stale_inputs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("name"), "o_orderstatus")
    was = o.where("k % 3 != 0").select("name", F.col("o_orderstatus").alias("sha256"))
    now = o.where("k % 5 != 0").select("name", F.when(F.col("k") % 7 == 0, "x").otherwise(F.col("o_orderstatus")).alias("sha256"))
    return reconcile.stale_inputs(was, now)


@query("unit_decision_issues", "SELECT event_id AS decision_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'unknown decision' END, CASE WHEN event_type IN ('click', 'error') AND NOT (value >= 20 AND user_id % 2 = 0) THEN 'candidate is not complete' END, CASE WHEN event_type = 'view' AND event_id % 4 <> 0 THEN 'no reason' END], lambda x: x IS NOT NULL), ';') AS issues FROM events")
def unit_decision_issues(spark, d):
    e = table(spark, d, "events")
    decision = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "view", "reject").when(F.col("event_type") == "error", "amend").otherwise(F.col("event_type"))
    rows = e.select(F.col("event_id").alias("decision_id"), decision.alias("decision"), F.when(F.col("value") >= 20, "success").otherwise("failed").alias("status"), (F.col("user_id") % 2 == 0).alias("complete"), F.when(F.col("event_id") % 4 == 0, "because").otherwise(" ").alias("reason"))
    return reconcile.unit_decision_issues(rows).select("decision_id", F.array_join("issues", ";").alias("issues"))


@query("alignment_decision_issues", "SELECT mention_id AS decision_id, array_to_string(list_filter([CASE WHEN mention_id % 2 = 0 AND coalesce(selected_iri, '') = '' THEN 'no target' END, CASE WHEN coalesce(selected_iri, '') <> '' AND NOT regexp_matches(selected_iri, '^(https?://|urn:)[^\\s<>\"]+$') THEN 'bad target' END, CASE WHEN mention_id % 2 = 0 AND (selected_iri IS NULL OR selected_iri NOT IN (SELECT iri FROM reference_terms)) THEN 'target outside the profile' END, CASE WHEN mention_id % 2 = 1 AND coalesce(reason, '') = '' THEN 'no amended text' END], lambda x: x IS NOT NULL), ';') AS issues FROM (SELECT DISTINCT mention_id, selected_iri, reason FROM term_choices)")
def alignment_decision_issues(spark, d):
    t = table(spark, d, "term_choices").select("mention_id", "selected_iri", "reason").distinct()
    rows = t.select(F.col("mention_id").alias("decision_id"), F.when(F.col("mention_id") % 2 == 0, "select_upstream").otherwise("amend").alias("decision"), F.col("selected_iri").alias("target_iri"), F.col("reason").alias("amended_label"), F.col("reason").alias("amended_definition"))
    return reconcile.alignment_decision_issues(rows, table(spark, d, "reference_terms").select("iri")).select("decision_id", F.array_join("issues", ";").alias("issues"))


@query("amended_facts", "SELECT o_orderkey AS fact_id, c_name AS quote FROM orders JOIN customer ON o_custkey = c_custkey")
def amended_facts(spark, d):
    facts = _facts(spark, d)[0]
    evidence = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("unit_id"), F.lit("loc").alias("locator"), F.col("c_name").alias("quote"))
    return reconcile.amended_facts(facts, evidence).select("fact_id", "quote")


@query("resolved_alignments", "WITH l AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1) SELECT 'c' || c_custkey AS candidate_iri, CASE WHEN event_type = 'click' THEN 'd' || c_custkey WHEN event_type IS NOT NULL THEN 's' || c_custkey WHEN c_custkey % 2 = 0 THEN 't' || c_custkey ELSE 's' || c_custkey END AS target, CASE WHEN event_type = 'view' THEN 'amended' ELSE c_name END AS label FROM customer LEFT JOIN l ON c_custkey = user_id")
def resolved_alignments(spark, d):
    key = F.col("c_custkey").cast("string")
    c = table(spark, d, "customer").select(key.alias("alignment_id"), F.concat(F.lit("c"), key).alias("candidate_iri"), F.when(F.col("c_custkey") % 2 == 0, "auto").otherwise("distinct").alias("status"), F.concat(F.lit("t"), key).alias("target_iri"), F.concat(F.lit("s"), key).alias("distinct_iri"), F.col("c_name").alias("label"), F.lit("x").alias("definition"))
    e = table(spark, d, "events")
    user = F.col("user_id").cast("string")
    decision = F.when(F.col("event_type") == "click", "merge").when(F.col("event_type") == "view", "amend").otherwise("keep_separate")
    log = e.select(user.alias("alignment_id"), decision.alias("decision"), F.concat(F.lit("d"), user).alias("target_iri"), F.when(F.col("event_type") == "view", "amended").alias("amended_label"), F.lit(None).cast("string").alias("amended_definition"), F.col("event_id").alias("seq"))
    return reconcile.resolved_alignments(c, log).select("candidate_iri", "target", "label")


# ---- records ----------------------------------------------------------------------------------------------

_RECORDS = "r AS (SELECT DISTINCT conversation_id, question_type, dialogue_mode, style_source_ids, messages, query_ir, reference_answer, evidence FROM qa_records)"
_PLAIN = f"regexp_replace(coalesce(@, ''), '{WS}', '', 'g')"
_TEXTS = "coalesce(array_to_string(list_transform({}, lambda m: coalesce(m.content, '')), ' '), '')"
_CONTEXTUAL = "('contextual_followup', 'user_correction', 'clarification', 'confirmation')"
_RULES = (
    ("n < 2", "fewer than two messages"),
    ("n >= 2 AND NOT (messages[1].role = 'user' AND messages[n].role = 'assistant')", "first and last role"),
    ("n >= 2 AND len(list_filter(range(2, n + 1), lambda i: messages[i].role = messages[i - 1].role)) > 0", "roles do not alternate"),
    ("n >= 1 AND (pa = '' OR pl = '' OR NOT (contains(pl, pa) OR contains(pa, pl)))", "answer and last message"),
    ("regexp_matches(everything, '[¿¡]')", "foreign marks"),
    ("regexp_matches(everything, '(?i)검수\\s*필요|자동\\s*승인|OCR|마크다운')", "review metadata"),
    ("md = 'standalone' AND n <> 2", "standalone length"),
    (f"md = 'standalone' AND qt IN {_CONTEXTUAL}", "standalone with a contextual type"),
    (f"md IN {_CONTEXTUAL} AND n < 4", "contextual length"),
    (f"md IN {_CONTEXTUAL} AND qt <> md", "mode and type differ"),
    (f"md NOT IN {_CONTEXTUAL} AND md <> 'standalone'", "unknown mode"),
    ("md = 'clarification' AND n >= 2 AND NOT contains(second, '?')", "clarification asks nothing"),
    ("md = 'clarification' AND n >= 2 AND second <> '어떤 조건을 기준으로 확인할까요?'", "clarification in other words"),
    (f"md IN {_CONTEXTUAL} AND md <> 'clarification' AND n >= 2 AND {_PLAIN.replace('@', 'second')} <> pa", "intermediate answer"),
    ("md = 'user_correction' AND NOT regexp_matches(later, '아니|정정|잘못|다시|제가 말한')", "no correction"),
    ("query_ir IS NULL OR query_ir.intent IS NULL OR query_ir.subject IS NULL OR query_ir.constraints IS NULL OR query_ir.requested_fields IS NULL", "query ir"),
    ("coalesce(len(evidence), 0) < 1", "no evidence"),
    (f"trim(answer, ' ') <> '' AND NOT contains({_PLAIN.replace('@', 'quotes')}, pa)", "answer not in the evidence"),
    ("len(list_filter(regexp_extract_all(answer, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(quotes, '[0-9]+'), x) AND x NOT IN ('2', '2026'))) > 0", "unsupported numbers"),
    ("starts_with(trim(answer, ' '), '아니요') AND regexp_matches(answer, '(^|[^불])가능')", "negative but possible"),
    ("len(years) > 0 AND NOT regexp_matches(answer, years[-1] || '\\s*학년')", "stated school year"),
)
_ISSUES = (
    f"{_RECORDS}, b AS (SELECT *, coalesce(len(messages), 0) AS n, coalesce(reference_answer, '') AS answer, coalesce(dialogue_mode, 'standalone') AS md, coalesce(question_type, '') AS qt, coalesce(messages[2].content, '') AS second, {_PLAIN.replace('@', 'reference_answer')} AS pa, {_PLAIN.replace('@', 'messages[-1].content')} AS pl, {_TEXTS.format('messages')} || ' ' || coalesce(reference_answer, '') AS everything, "
    f"{_TEXTS.format("list_filter(messages[3:], lambda m: m.role = 'user')")} AS later, coalesce(array_to_string(list_transform(evidence, lambda e: coalesce(e.quote, '')), ' '), '') AS quotes, regexp_extract_all({_TEXTS.format("list_filter(messages, lambda m: m.role = 'user')")}, '저는\\s*(\\d)\\s*학년', 1) AS years FROM r), "
    "i AS (SELECT conversation_id, list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in _RULES) + "], lambda x: x IS NOT NULL) AS issues FROM b)"
)


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return records.conversation_issues(_one(table(spark, d, "qa_records"), "conversation_id"), known_styles=None)


@query("conversation_rules", f"WITH {_ISSUES} SELECT conversation_id, array_to_string(issues, '; ') AS issues FROM i")
def conversation_rules(spark, d):
    return _issues(spark, d).select("conversation_id", F.array_join(F.filter("issues", lambda x: x != "style ids"), "; ").alias("issues"))


@query("issue_histogram", f"WITH {_ISSUES} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM i) GROUP BY issue ORDER BY n DESC, issue LIMIT 8")
def issue_histogram(spark, d):
    return records.issue_histogram(_issues(spark, d).select(F.filter("issues", lambda x: x != "style ids").alias("issues")))


_LAST_ASKED = "lower(coalesce(list_filter(messages, lambda m: m.role = 'user')[-1].content, ''))"
_PRINTS = (
    f"{_RECORDS}, f AS (SELECT conversation_id, substr(sha256(regexp_replace({_LAST_ASKED}, '[^0-9a-z가-힣]', '', 'g')), 1, 16) AS question, "
    f"substr(sha256(lower(regexp_replace('{{\"constraints\":' || coalesce('{{' || array_to_string(list_transform(list_sort(map_entries(query_ir.constraints)), lambda e: to_json(e.key)::VARCHAR || ':' || to_json(e.value)::VARCHAR), ',') || '}}', 'null') || ',\"intent\":' || coalesce(to_json(query_ir.intent)::VARCHAR, 'null') || ',\"requested_fields\":' || coalesce(to_json(query_ir.requested_fields)::VARCHAR, 'null') || ',\"subject\":' || coalesce(to_json(query_ir.subject)::VARCHAR, 'null') || '}}', '{WS}', '', 'g'))), 1, 16) AS query, "
    f"substr(sha256(array_to_string(list_sort(list_transform(coalesce(evidence, []), lambda x: coalesce(nullif(trim(x.source_unit_id, ' '), ''), substr(sha256(lower(regexp_replace(coalesce(x.locator, ''), '{WS}', '', 'g')) || chr(10) || lower(regexp_replace(coalesce(x.quote, ''), '{WS}', '', 'g'))), 1, 16)))), chr(10))), 1, 16) AS bundle FROM r)"
)


@query("fingerprints", f"WITH {_PRINTS} SELECT * FROM f")
def fingerprints(spark, d):
    return records.fingerprints(_one(table(spark, d, "qa_records"), "conversation_id"))


@query("repeated_flags", f"WITH {_PRINTS} SELECT conversation_id, row_number() OVER (PARTITION BY question ORDER BY conversation_id) > 1 AS repeated FROM f")
def repeated_flags(spark, d):
    return records.repeated_flags(records.fingerprints(_one(table(spark, d, "qa_records"), "conversation_id")))


@query(
    "bundle_messages",
    f"WITH {_RECORDS}, c AS (SELECT conversation_id, dialogue_mode AS md, reference_answer AS a, list_concat(list_transform(messages, lambda m: m.content)[:-2], [reference_answer]) AS c FROM r WHERE messages IS NOT NULL), x AS (SELECT conversation_id, md, a, unnest(c) AS content, generate_subscripts(c, 1) - 1 AS turn, len(c) AS n FROM c) SELECT conversation_id AS bundle_id, turn::INTEGER AS turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN turn = 1 AND turn < n - 1 AND md = 'clarification' THEN '어떤 조건을 기준으로 확인할까요?' WHEN turn = 1 AND turn < n - 1 AND md IN {_CONTEXTUAL} THEN coalesce(a, content) ELSE content END AS content FROM x",
)
def bundle_messages(spark, d):
    r = _one(table(spark, d, "qa_records"), "conversation_id").where("messages is not null")
    said = F.transform("messages", lambda m: m.content)
    return records.bundle_messages(r.select(F.col("conversation_id").alias("bundle_id"), F.col("dialogue_mode").alias("mode"), F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))).alias("contents"), F.col("reference_answer").alias("answer")))


@query(
    "finalised_records",
    f"WITH {_RECORDS}, t AS (SELECT conversation_id, substr(sha256(conversation_id), 1, 16) AS record_id, row_number() OVER (PARTITION BY regexp_replace({_TEXTS.format('messages')}, '{WS}', '', 'g') ORDER BY conversation_id) > 1 AS duplicate, coalesce(len(evidence), 0) AS e FROM r) SELECT record_id, duplicate, CASE WHEN duplicate OR e = 0 THEN 'failed' ELSE 'passed' END AS status FROM t",
)
def finalised_records(spark, d):
    r = _one(table(spark, d, "qa_records"), "conversation_id")
    text = F.coalesce(F.array_join(F.transform("messages", lambda m: F.coalesce(m.content, F.lit(""))), " "), F.lit(""))
    bad = F.when(F.coalesce(F.size("evidence"), F.lit(0)) == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return records.finalised(r.select("conversation_id", text.alias("text"), F.col("conversation_id").alias("json"), bad.alias("issues")), "conversation_id")


@query("coverage_summary", f"WITH c AS (SELECT question_type AS q, count(*) AS n FROM (SELECT DISTINCT conversation_id, question_type FROM qa_records) WHERE question_type IN {records.QUESTION_TYPES} GROUP BY 1) SELECT count(*) AS types, min(n) AS least, max(n) AS most, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT unnest({list(records.QUESTION_TYPES)}) AS k) WHERE k NOT IN (SELECT q FROM c)) AS missing FROM c")
def coverage_summary(spark, d):
    rows = table(spark, d, "qa_records").select("conversation_id", "question_type").distinct()
    return records.coverage_summary(rows).select("types", "least", "most", F.array_join("missing", ",").alias("missing"))


@query("similar_evidence", f"WITH {_RECORDS}, e AS (SELECT DISTINCT x.locator AS l, {_PLAIN.replace('@', 'x.quote')} AS q FROM (SELECT unnest(evidence) AS x FROM r) WHERE x.quote IS NOT NULL), g AS (SELECT l, q, list_distinct({_GRAMS.format(c='q', n=5, m=3)}) AS s FROM e) SELECT a.l AS locator, sha256(a.q) AS a, sha256(b.q) AS b FROM g a JOIN g b ON a.l = b.l AND a.q < b.q WHERE contains(a.q, b.q) OR contains(b.q, a.q) OR len(list_intersect(a.s, b.s)) >= 0.72 * len(list_distinct(list_concat(a.s, b.s)))")
def similar_evidence(spark, d):
    e = table(spark, d, "qa_records").select(F.explode("evidence").alias("x")).select(F.col("x.locator").alias("locator"), X.n9(F.col("x.quote")).alias("quote"))
    return records.similar_quotes(e).select("locator", F.sha2("quote_a", 256).alias("a"), F.sha2("quote_b", 256).alias("b"))


@query("style_rotation", "SELECT o_orderkey, ['formal', 'casual', 'short'][(o_orderkey % 3 + 1)::INTEGER] AS style FROM orders")
def style_rotation(spark, d):
    return table(spark, d, "orders").select("o_orderkey", records.rotation(F.col("o_orderkey"), ["formal", "casual", "short"]).alias("style"))


# ---- linking -------------------------------------------------------------------------------------------------


@query("exact_resolutions", "SELECT m::BIGINT AS mention_id, min(i) AS iri FROM (SELECT o_custkey AS m, o_orderkey AS i, o_orderstatus = 'P' AS whole FROM orders) WHERE whole GROUP BY m HAVING count(*) = 1")
def exact_resolutions(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("mention_id"), F.col("o_orderkey").alias("iri"), F.when(F.col("o_orderstatus") == "P", 100.0).otherwise(80.0).alias("score"))
    return linking.exact_resolutions(c)


@query("admitted_choices", "WITH c AS (SELECT mention_id, count(*) AS n, min(selected_iri) AS iri, min(confidence) AS confidence FROM (SELECT DISTINCT mention_id, selected_iri, confidence FROM term_choices WHERE selected_iri IS NOT NULL) GROUP BY mention_id) SELECT mention_id, iri FROM c WHERE n = 1 AND confidence >= 0.7 AND iri IN (SELECT iri FROM reference_terms WHERE length(label) >= 7)")
def admitted_choices(spark, d):
    t = table(spark, d, "term_choices").select("mention_id", F.col("selected_iri").alias("iri"), "confidence").where("iri is not null").distinct()
    r = table(spark, d, "reference_terms").select("iri", F.when(F.length("label") >= 7, 60.0).otherwise(59.9).alias("score"))
    return linking.admitted_choices(t, t.select("mention_id", "iri").join(r, "iri"))


_CITED = "c AS (SELECT o_orderkey AS k, list_transform(range(0, (o_orderkey % 3 + 1)::BIGINT), lambda i: (i + o_orderkey % 2)::INTEGER) AS cited, (1 + o_orderkey % 4)::INTEGER AS rows FROM orders)"


def _cited(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: i + (F.col("o_orderkey") % 2).cast("int")).alias("cited"), (k % 4 + 1).cast("int").alias("rows"), "o_orderstatus")


@query("repaired_citations", f"WITH {_CITED} SELECT k, array_to_string(CASE WHEN list_min(cited) >= 1 AND list_max(cited) <= rows AND list_max(cited) >= rows THEN list_transform(cited, lambda i: i - 1) ELSE cited END, ',') AS cited FROM c")
def repaired_citations(spark, d):
    return _cited(spark, d).select("k", F.array_join(linking.repaired_citations(F.col("cited"), F.col("rows")).cast("array<string>"), ",").alias("cited"))


@query("answer_issues", "SELECT conversation_id, array_to_string(list_filter([CASE WHEN length(a) % 5 >= n THEN 'citation out of range' END, CASE WHEN regexp_matches(a, '확인할 수 없|판단할 수 없|알 수 없|포함되어 있지 않|추가 확인') THEN 'answer says it is insufficient' END], lambda x: x IS NOT NULL), ';') AS issues FROM (SELECT DISTINCT conversation_id, reference_answer AS a, coalesce(len(evidence), 0) AS n FROM qa_records) WHERE a IS NOT NULL")
def answer_issues(spark, d):
    r = table(spark, d, "qa_records").select("conversation_id", F.col("reference_answer").alias("a"), F.coalesce(F.size("evidence"), F.lit(0)).alias("n")).distinct().where("a is not null")
    return r.select("conversation_id", F.array_join(linking.answer_issues(F.col("a"), F.array(F.length("a") % 5), F.col("n"), F.lit(False)), ";").alias("issues"))


@query("source_pages", "WITH e AS (SELECT DISTINCT conversation_id, list_filter(list_transform(evidence, lambda x: x.source_unit_id), lambda x: x IS NOT NULL) AS u FROM qa_records WHERE evidence IS NOT NULL), p AS (SELECT conversation_id, list_transform(u, lambda x: split_part(x, ':', -1)) AS p FROM e) SELECT conversation_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS pages FROM p")
def source_pages(spark, d):
    r = table(spark, d, "qa_records").where("evidence is not null").select("conversation_id", F.transform("evidence", lambda e: e.source_unit_id).alias("u")).distinct()
    return r.select("conversation_id", F.array_join(linking.source_pages(F.col("u")), ",").alias("pages"))


_ASKED = "해양정책학과 졸업 학점"
_ASKED_KEY = "해양정책학과졸업학점"


@query(
    "few_shot",
    f"WITH e AS (SELECT iri AS example_id, CASE WHEN code LIKE 'HA%' THEN 'no_fact' ELSE term_type END AS category, code, regexp_replace(lower(label), '[^0-9a-z가-힣]', '', 'g') AS t FROM reference_terms), g AS (SELECT *, {_GRAMS.format(c='t', n=3, m=1)} AS x, {_GRAMS.format(c="'" + _ASKED_KEY + "'", n=3, m=1)} AS y FROM e), "
    "s AS (SELECT *, list_sum(list_transform(list_distinct(list_intersect(x, y)), lambda k: len(list_filter(x, lambda e: e = k))::DOUBLE * len(list_filter(y, lambda e: e = k)))) / (sqrt(list_sum(list_transform(list_distinct(x), lambda k: len(list_filter(x, lambda e: e = k))::DOUBLE ** 2))) * sqrt(list_sum(list_transform(list_distinct(y), lambda k: len(list_filter(y, lambda e: e = k))::DOUBLE ** 2)))) AS score FROM g WHERE category <> 'no_fact'), "
    "b AS (SELECT example_id, category, row_number() OVER (ORDER BY coalesce(score, 0) DESC, example_id) AS n FROM s) SELECT (n - 1)::INTEGER AS place, example_id, category FROM b WHERE n <= 3 UNION ALL SELECT 3, example_id, category FROM (SELECT example_id, category FROM e WHERE category = 'no_fact' ORDER BY code, example_id LIMIT 1)",
)
def few_shot(spark, d):
    r = table(spark, d, "reference_terms")
    category = F.when(F.col("code").like("HA%"), "no_fact").otherwise(F.col("term_type"))
    return linking.few_shot(r.select(F.col("iri").alias("example_id"), category.alias("category"), F.col("label").alias("text"), F.struct("code", "iri").alias("at")), _ASKED)


@query("close_matches")
def close_matches(spark, d):
    words = table(spark, d, "query_terms").where("mention is not null").select(F.explode(F.split(F.lower("mention"), r"[^0-9a-z가-힣]+")).alias("word")).where("length(word) between 3 and 12").distinct()
    return fuzzy.close_matches(words, table(spark, d, "reference_terms").select(F.lower("label").alias("word")))


@query("replaced_words", "SELECT conversation_id AS text_id, regexp_replace(a, '(^|[^가-힣A-Za-z])(기간)($|[^가-힣A-Za-z])', '\\1기한\\3', 'g') AS text FROM (SELECT DISTINCT conversation_id, reference_answer AS a FROM qa_records) WHERE a IS NOT NULL AND a <> '' AND NOT regexp_matches(a, '기간[^가-힣A-Za-z]기간')")
def replaced_words(spark, d):
    r = table(spark, d, "qa_records").select(F.col("conversation_id").alias("text_id"), F.col("reference_answer").alias("text")).distinct().where("text is not null and text != '' and not text rlike '기간[^가-힣A-Za-z]기간'")
    return fuzzy.replaced_words(r, spark.createDataFrame([("기간", "기한")], "word string, other string")).select("text_id", "text")


# ---- sources and publication ---------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/tripleloom/{name}-{uuid.uuid4().hex}"


@query("style_file", "SELECT 'style-' || lpad((row_number() OVER (ORDER BY n_nationkey))::VARCHAR, 4, '0') AS style_id, '¿' || n_name || '?' AS question FROM nation")
def style_file(spark, d):
    folder = _folder(spark, "csv")
    n = table(spark, d, "nation").orderBy("n_nationkey").coalesce(1)
    n.select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit(" ¿"), F.col("n_name"), F.lit("? ")).alias("Pregunta")).write.option("header", True).csv(folder, sep=";")
    return files.style_questions(spark, folder)


@query("page_file", "SELECT (r_regionkey + 1)::INTEGER AS page, '# ' || r_name AS text FROM region")
def page_file(spark, d):
    folder = _folder(spark, "pages")
    r = table(spark, d, "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: F.concat(F.lit("# "), x.r_name)), files.PAGE_SEPARATOR).alias("value"))
    r.write.text(folder)
    return files.read_pages(spark, folder).select("page", F.trim(F.regexp_replace("text", "\n+$", "")).alias("text"))


@query("preview_sections", "SELECT (n_nationkey + 1)::INTEGER AS printed_page, (n_nationkey + 5)::INTEGER AS pdf_page, n_name AS body FROM nation WHERE n_nationkey < 12")
def preview_sections(spark, d):
    one = F.format_string("## 인쇄 페이지 %d (PDF %d)\n\n%s\n\n", F.col("n_nationkey") + 1, F.col("n_nationkey") + 5, F.col("n_name"))
    text = table(spark, d, "nation").select("n_nationkey", one.alias("part")).agg(F.concat(F.lit("# 앞\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "part"))), lambda x: x.part), "")).alias("value"))
    return files.preview_sections(text, files.parse_pages("1-10,11,12"))


@query(
    "manifest_issues",
    "WITH p AS (SELECT o_custkey AS document, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, sha256(o_orderpriority) AS h FROM orders), own AS (SELECT * FROM p WHERE NOT (page = 2 AND document % 3 = 0)), m AS (SELECT document, page, CASE WHEN document % 7 = 0 AND page = 1 THEN 'x' ELSE h END AS h FROM p WHERE NOT (page = 1 AND document % 5 = 0)), b AS (SELECT coalesce(own.document, m.document) AS document, CASE WHEN own.h IS NULL THEN 'missing page' WHEN m.h IS NULL THEN 'unlisted page' WHEN own.h <> m.h THEN 'changed page' END AS issue FROM own FULL JOIN m ON own.document = m.document AND own.page = m.page) SELECT DISTINCT * FROM (SELECT * FROM b WHERE issue IS NOT NULL UNION ALL SELECT document, 'page sequence' FROM own GROUP BY document HAVING min(page) <> 1 OR max(page) <> count(DISTINCT page))",
)
def manifest_issues(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("document"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), F.col("o_orderpriority").alias("text"))
    listed = o.where("not (page = 1 and document % 5 = 0)").select("document", "page", F.when((F.col("document") % 7 == 0) & (F.col("page") == 1), "x").otherwise(F.sha2("text", 256)).alias("sha256"))
    return files.manifest_issues(o.where("not (page = 2 and document % 3 = 0)"), listed)


@query("unknown_names", "SELECT * FROM (VALUES ('urn:x:Ghost'), ('urn:x:notThere'), ('urn:x:res:one')) t(iri)")
def unknown_names(spark, d):
    text = HEAD + 'SELECT ?x WHERE { ?x a ex:Ghost ; ex:notThere <urn:x:res:one> ; ex:acctbal ?b ; ex:inNation <urn:query-term:n> FILTER(?b > xsd:decimal("1")) }'
    names = gate.unknown_names(text, gate.known_iris(star_triples(spark, d, "customer")), PREFIXES, "urn:x:res:")
    return spark.createDataFrame([(n,) for n in names], "iri string")


@query("compatible_types", "SELECT p_partkey AS row_id, p_size % 4 = 0 OR p_size % 4 = 1 OR (p_size % 4 = 2 AND p_partkey % 2 = 0) AS compatible FROM part")
def compatible_types(spark, d):
    line = lambda s, p, o: (s, p, "iri", o, "", "", "profile")
    rows = [line("A", graph.SUBCLASS, "B"), line("B", graph.SUBCLASS, "C"), line("C", graph.SUBCLASS, "B"), line("q", graph.RDFS + "subPropertyOf", "C")]
    closure = graph.class_closure(spark.createDataFrame(rows, "s string, p string, o_kind string, o_value string, o_datatype string, o_lang string, component string"), graph.SUBCLASS, graph.RDFS + "subPropertyOf")
    k = F.col("p_size") % 4
    expected = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("C"))).when(k == 2, F.array(F.lit("q"), F.lit("z"))).otherwise(F.array(F.lit("z")))
    types = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("A"), F.lit("q"))).otherwise(F.array(F.lit("A")))
    return graph.compatible_types(table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), types.alias("types"), expected.alias("expected")), closure)


@query("token_scopes", f"WITH {_CELLS}, c AS (SELECT DISTINCT table_id, cell, \"row\", \"column\" FROM cells), w AS (SELECT *, unnest(range(\"row\", \"row\" + 2)) AS base_row FROM c) SELECT table_id, cell, base_row::INTEGER AS base_row, \"column\" AS base_column, \"row\" AS first_row, \"row\" + 1 AS last_row FROM w WHERE base_row % 2 = 0")
def token_scopes(spark, d):
    c = _cells(spark, d).distinct().select("table_id", "cell", "row", "column", F.lit(2).alias("rowspan"), F.lit(1).alias("colspan"))
    tokens = tables.cell_coordinates(c).where("base_row % 2 = 0").select("table_id", "base_row", "base_column").distinct()
    return tables.token_scopes(tokens, c).select("table_id", "cell", "base_row", "base_column", "first_row", "last_row")


@query(
    "preview_counts",
    f"WITH {_PRINTS}, q AS (SELECT r.question_type, r.dialogue_mode, f.query, f.bundle FROM r JOIN f ON r.conversation_id = f.conversation_id) SELECT 'records' AS name, count(*) AS n FROM q UNION ALL SELECT 'question types', count(DISTINCT question_type) FROM q UNION ALL SELECT 'queries', count(DISTINCT query) FROM q UNION ALL SELECT 'bundles', count(DISTINCT bundle) FROM q UNION ALL SELECT 'mode ' || coalesce(dialogue_mode, ''), count(*) FROM q GROUP BY dialogue_mode",
)
def preview_counts(spark, d):
    r = _one(table(spark, d, "qa_records"), "conversation_id")
    return records.preview_counts(r.select("conversation_id", "question_type", "dialogue_mode").join(records.fingerprints(r), "conversation_id"))


@query(
    "published_graph",
    f"SELECT 'urn:y:customer:' || c_custkey AS s, '{LABEL}' AS p, c_name AS o_value FROM customer UNION ALL SELECT 'urn:y:customer:' || c_custkey, '{_RDF}type', 'urn:y:Customer' FROM customer UNION ALL SELECT 'urn:y:Customer', '{_RDF}type', 'http://www.w3.org/2002/07/owl#Class' UNION ALL SELECT 'urn:y:', '{_RDF}type', 'http://www.w3.org/2002/07/owl#Ontology' UNION ALL SELECT 'urn:y:Thing', '{_RDF}type', 'http://www.w3.org/2002/07/owl#Class'",
)
def published_graph(spark, d):
    schema = "s string, p string, o_kind string, o_value string, o_datatype string, o_lang string"
    owl = graph.OWL
    made = lambda *rows: spark.createDataFrame([(s, p, k, o, "", "") for s, p, k, o in rows], schema)
    c = table(spark, d, "customer").select(F.concat(F.lit("urn:cand:customer:"), F.col("c_custkey").cast("string")).alias("s"), "c_name")
    about = c.select("s", F.lit(LABEL).alias("p"), F.lit("literal").alias("o_kind"), F.col("c_name").alias("o_value"), F.lit("").alias("o_datatype"), F.lit("").alias("o_lang"))
    typed = c.select("s", F.lit(graph.TYPE).alias("p"), F.lit("iri").alias("o_kind"), F.lit("urn:cand:Customer").alias("o_value"), F.lit("").alias("o_datatype"), F.lit("").alias("o_lang"))
    drafts = about.unionByName(typed).unionByName(made(("urn:cand:Customer", graph.TYPE, "iri", owl + "Class"), ("urn:cand:Customer", LABEL, "literal", "draft")))
    mapping = c.select(F.col("s").alias("iri"), F.regexp_replace("s", "^urn:cand:", "urn:y:").alias("target")).unionByName(spark.createDataFrame([("urn:cand:Customer", "urn:y:Customer")], "iri string, target string"))
    return reconcile.publish(made(("urn:y:Thing", graph.TYPE, "iri", owl + "Class")), drafts, mapping, made(("urn:y:Customer", graph.TYPE, "iri", owl + "Class")), "urn:cand:", made(("urn:y:", graph.TYPE, "iri", owl + "Ontology"))).select("s", "p", "o_value")
