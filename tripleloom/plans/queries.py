"""Queries over the driver's tables, one for each operator family, and their SQL twins.

A SPARQL query runs through the gate and the compiler over triples of the star
schema; its twin is plain SQL on the tables. Row caps are off here: they have tests
of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions import text as X
from tripleloom.operators import facts as E
from tripleloom.operators import fuzzy, graph, linking, reconcile, records, segments, tables, vectors
from tripleloom.session import table
from tripleloom.sources.star import EX, LABEL, PREFIXES, star_triples
from tripleloom.sparql.compile import lexical
from tripleloom.sparql.gate import execute, known_iris

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HEAD = "".join(f"PREFIX {p}: <{ns}>\n" for p, ns in PREFIXES.items())


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def sparql(name: str, text: str, used: tuple[str, ...], sql: str, doubles: tuple[str, ...] = (), longs: tuple[str, ...] = ()) -> None:
    """Registers a SPARQL query; the named columns are cast from their lexical forms."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = lexical(execute(star_triples(spark, sf_dir, *used), HEAD + text, cap=None))
        for c in doubles:
            out = out.withColumn(c, F.round(F.col(c).cast("double"), 4))
        for c in longs:
            out = out.withColumn(c, F.col(c).cast("double").cast("bigint"))
        return out

    QUERIES[name] = run
    SQL[name] = sql


# ---- SPARQL -------------------------------------------------------------------------

sparql(
    "sparql_flagship",
    'SELECT ?cust ?bal ?region WHERE { BIND(5000 AS ?floor) ?cust ex:inNation ?n ; ex:acctbal ?bal ; a ex:Customer . ?n ex:inRegion/rdfs:label ?region FILTER(?bal >= ?floor && (?region = "ASIA" || ?region = "EUROPE")) }',
    ("region", "nation", "customer"),
    "SELECT 'urn:x:customer:' || c_custkey AS cust, round(c_acctbal, 4) AS bal, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 5000 AND r_name IN ('ASIA', 'EUROPE')",
    ("bal",),
)
sparql(
    "sparql_bgp_filter",
    'SELECT ?o ?total ?c WHERE { ?o a ex:Order ; ex:total ?total ; ex:status "F" ; ex:placedBy ?c . ?c ex:segment "BUILDING" FILTER(?total > 200000.0) }',
    ("customer", "orders"),
    "SELECT 'urn:x:order:' || o_orderkey AS o, round(o_totalprice, 4) AS total, 'urn:x:customer:' || o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' AND o_totalprice > 200000",
    ("total",),
)
sparql(
    "sparql_optional",
    "SELECT ?c ?o WHERE { ?c a ex:Customer OPTIONAL { ?o ex:placedBy ?c ; ex:total ?t FILTER(?t > 300000) } }",
    ("customer", "orders"),
    "SELECT 'urn:x:customer:' || c_custkey AS c, 'urn:x:order:' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000",
)
sparql(
    "sparql_optional_bound",
    "SELECT ?c WHERE { ?c a ex:Customer OPTIONAL { ?o ex:placedBy ?c ; ex:total ?t FILTER(?t > 300000) } FILTER(!BOUND(?o)) }",
    ("customer", "orders"),
    "SELECT 'urn:x:customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
)
sparql(
    "sparql_optional_then_join",
    'SELECT ?c ?o ?l WHERE { ?c a ex:Customer ; ex:segment "MACHINERY" OPTIONAL { ?o ex:placedBy ?c ; ex:status "P" } ?o ex:total ?l FILTER(?l > 350000) }',
    ("customer", "orders"),
    "WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'), lj AS (SELECT c_custkey, o_orderkey FROM c LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P') SELECT 'urn:x:customer:' || c_custkey AS c, 'urn:x:order:' || o.o_orderkey AS o, round(o.o_totalprice, 4) AS l FROM lj JOIN orders o ON lj.o_orderkey = o.o_orderkey OR lj.o_orderkey IS NULL WHERE o.o_totalprice > 350000",
    ("l",),
)
sparql(
    "sparql_union",
    "SELECT ?x ?n WHERE { { ?x a ex:Supplier ; ex:inNation ?n } UNION { ?x a ex:Customer ; ex:inNation ?n } ?n rdfs:label \"NATION_7\" }",
    ("nation", "customer", "supplier"),
    "SELECT 'urn:x:supplier:' || s_suppkey AS x, 'urn:x:nation:' || s_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7' UNION ALL SELECT 'urn:x:customer:' || c_custkey, 'urn:x:nation:' || c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'",
)
sparql(
    "sparql_minus",
    'SELECT ?c WHERE { ?c a ex:Customer MINUS { ?o ex:placedBy ?c ; ex:status "F" } }',
    ("customer", "orders"),
    "SELECT 'urn:x:customer:' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)",
)
sparql(
    "sparql_exists",
    "SELECT ?s WHERE { ?s a ex:Supplier ; ex:acctbal ?b ; ex:inNation ?n FILTER EXISTS { ?c a ex:Customer ; ex:inNation ?n ; ex:acctbal ?cb FILTER(?cb < ?b) } FILTER NOT EXISTS { ?s ex:acctbal ?x FILTER(?x < 0) } }",
    ("customer", "supplier"),
    "SELECT 'urn:x:supplier:' || s_suppkey AS s FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < s_acctbal) AND s_acctbal >= 0",
)
sparql(
    "sparql_path_sequence",
    "SELECT ?c ?r WHERE { ?c a ex:Customer ; ex:inNation/ex:inRegion ?r }",
    ("nation", "customer"),
    "SELECT 'urn:x:customer:' || c_custkey AS c, 'urn:x:region:' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
sparql(
    "sparql_path_alternative",
    "SELECT ?p ?l WHERE { ?p a ex:Part ; skos:prefLabel|skos:altLabel ?l }",
    ("part",),
    "SELECT 'urn:x:part:' || p_partkey AS p, p_name AS l FROM part UNION ALL SELECT 'urn:x:part:' || p_partkey, p_type FROM part",
)
sparql(
    "sparql_path_star",
    "SELECT ?x ?cls WHERE { ?x rdf:type/rdfs:subClassOf* ?cls . ?x ex:inNation ?n FILTER(?cls = ex:Party || ?cls = ex:Thing) }",
    ("customer", "supplier"),
    "SELECT x, cls FROM (SELECT 'urn:x:customer:' || c_custkey AS x FROM customer UNION ALL SELECT 'urn:x:supplier:' || s_suppkey FROM supplier), (VALUES ('urn:x:Party'), ('urn:x:Thing')) t(cls)",
)
sparql("sparql_path_plus", "SELECT ?x ?y WHERE { ?x rdfs:subClassOf+ ?y }", ("region",), "SELECT * FROM (VALUES ('urn:x:Customer', 'urn:x:Party'), ('urn:x:Supplier', 'urn:x:Party'), ('urn:x:Party', 'urn:x:Thing'), ('urn:x:Customer', 'urn:x:Thing'), ('urn:x:Supplier', 'urn:x:Thing')) t(x, y)")
sparql(
    "sparql_path_inverse",
    "SELECT ?r ?s WHERE { ?r a ex:Region ; ^ex:inRegion/^ex:inNation ?s . ?s a ex:Supplier }",
    ("region", "nation", "supplier"),
    "SELECT 'urn:x:region:' || n_regionkey AS r, 'urn:x:supplier:' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
sparql(
    "sparql_path_negated",
    "SELECT ?x ?v WHERE { ?x a ex:Nation ; !(rdf:type|ex:inRegion) ?v }",
    ("nation",),
    "SELECT 'urn:x:nation:' || n_nationkey AS x, n_name AS v FROM nation",
)
sparql(
    "sparql_group",
    "SELECT ?r (COUNT(*) AS ?n) (SUM(?b) AS ?total) (AVG(?b) AS ?mean) (MIN(?b) AS ?low) (MAX(?b) AS ?high) WHERE { ?c a ex:Customer ; ex:acctbal ?b ; ex:inNation/ex:inRegion/rdfs:label ?r } GROUP BY ?r",
    ("region", "nation", "customer"),
    "SELECT r_name AS r, count(*) AS n, round(sum(c_acctbal), 4) AS total, round(avg(c_acctbal), 4) AS mean, round(min(c_acctbal), 4) AS low, round(max(c_acctbal), 4) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ("total", "mean", "low", "high"),
    ("n",),
)
sparql(
    "sparql_having",
    "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o ex:placedBy ?c } GROUP BY ?c HAVING(COUNT(?o) >= 15)",
    ("orders",),
    "SELECT 'urn:x:customer:' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15",
    (),
    ("n",),
)
sparql(
    "sparql_order_slice",
    "SELECT ?s ?b WHERE { ?s a ex:Supplier ; ex:acctbal ?b } ORDER BY DESC(?b) ?s LIMIT 10 OFFSET 5",
    ("supplier",),
    "SELECT 'urn:x:supplier:' || s_suppkey AS s, round(s_acctbal, 4) AS b FROM supplier ORDER BY s_acctbal DESC, 'urn:x:supplier:' || s_suppkey LIMIT 10 OFFSET 5",
    ("b",),
)
sparql(
    "sparql_subquery",
    "SELECT ?name ?n WHERE { { SELECT ?k (COUNT(?c) AS ?n) WHERE { ?c a ex:Customer ; ex:inNation ?k } GROUP BY ?k ORDER BY DESC(?n) ?k LIMIT 7 } ?k rdfs:label ?name }",
    ("nation", "customer"),
    "SELECT n_name AS name, n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 'urn:x:nation:' || c_nationkey LIMIT 7) JOIN nation ON c_nationkey = n_nationkey",
    (),
    ("n",),
)
sparql(
    "sparql_distinct",
    "SELECT DISTINCT ?status ?segment WHERE { ?o ex:status ?status ; ex:placedBy/ex:segment ?segment }",
    ("customer", "orders"),
    "SELECT DISTINCT o_orderstatus AS status, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey",
)
sparql(
    "sparql_values",
    'SELECT ?name ?s ?w WHERE { VALUES (?name ?w) { ("NATION_3" 1) ("NATION_7" 2) (UNDEF 3) } ?k rdfs:label ?name ; a ex:Nation . ?s a ex:Supplier ; ex:inNation ?k }',
    ("nation", "supplier"),
    "WITH v AS (SELECT * FROM (VALUES ('NATION_3', 1::BIGINT), ('NATION_7', 2), (NULL, 3)) t(name, w)) SELECT n_name AS name, 'urn:x:supplier:' || s_suppkey AS s, w FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN v ON v.name = n_name OR v.name IS NULL",
    (),
    ("w",),
)
sparql(
    "sparql_functions",
    'SELECT ?p (STRLEN(?l) AS ?size) (UCASE(SUBSTR(?l, 1, 4)) AS ?head) (STRBEFORE(?l, " ") AS ?first) (STRAFTER(?l, " ") AS ?rest) (IF(CONTAINS(?l, "a"), "a", "-") AS ?mark) (REPLACE(?l, "[aeiou]", "*") AS ?masked) (CONCAT(?b, "/", LCASE(?l)) AS ?both) (MD5(?l) AS ?hash) WHERE { ?p skos:prefLabel ?l ; ex:brand ?b ; ex:size ?z FILTER(REGEX(?b, "^brand", "i") && ?z IN (1, 2, 3, 4, 5) && isLiteral(?l) && !isIRI(?l)) }',
    ("part",),
    "SELECT 'urn:x:part:' || p_partkey AS p, length(p_name)::BIGINT AS size, upper(substr(p_name, 1, 4)) AS head, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS first, CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS rest, CASE WHEN contains(p_name, 'a') THEN 'a' ELSE '-' END AS mark, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, p_brand || '/' || lower(p_name) AS both, md5(p_name) AS hash FROM part WHERE regexp_matches(lower(p_brand), '^brand') AND p_size BETWEEN 1 AND 5",
    (),
    ("size",),
)
sparql(
    "sparql_numbers",
    "SELECT ?s (ROUND(?b) AS ?r) (FLOOR(?b) AS ?f) (CEIL(?b) AS ?c) (ABS(?b) AS ?a) (xsd:integer(?b) + 1 AS ?i) (?b / 4 AS ?q) (COALESCE(?none, -1) AS ?d) WHERE { ?s a ex:Supplier ; ex:acctbal ?b }",
    ("supplier",),
    "SELECT 'urn:x:supplier:' || s_suppkey AS s, floor(s_acctbal + 0.5) AS r, floor(s_acctbal) AS f, ceil(s_acctbal) AS c, round(abs(s_acctbal), 4) AS a, trunc(s_acctbal)::BIGINT + 1 AS i, round(s_acctbal / 4, 4) AS q, -1::BIGINT AS d FROM supplier",
    ("r", "f", "c", "a", "q"),
    ("i", "d"),
)
sparql(
    "sparql_dates",
    'SELECT ?y ?m (COUNT(DISTINCT ?c) AS ?customers) WHERE { ?o ex:orderDate ?d ; ex:placedBy ?c BIND(YEAR(?d) AS ?y) BIND(MONTH(?d) AS ?m) FILTER(?d >= "1996-01-01T00:00:00"^^xsd:dateTime) } GROUP BY ?y ?m',
    ("orders",),
    "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2",
    (),
    ("y", "m", "customers"),
)
sparql(
    "sparql_group_concat",
    'SELECT ?r (GROUP_CONCAT(?l; SEPARATOR="|") AS ?names) (SAMPLE(?l) AS ?one) WHERE { ?n ex:inRegion ?k ; rdfs:label ?l . ?k rdfs:label ?r } GROUP BY ?r',
    ("region", "nation"),
    "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names, min(n_name) AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
sparql(
    "sparql_variable_predicate",
    "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s a ex:Order ; ?p ?o } GROUP BY ?p",
    ("orders",),
    "SELECT p, n FROM (SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:x:placedBy', 'urn:x:orderDate', 'urn:x:total', 'urn:x:status']) AS p, count(*) AS n FROM orders)",
    (),
    ("n",),
)

# ---- graph ------------------------------------------------------------------------------

STAR = ("region", "nation", "customer", "supplier", "part", "orders")


@query("label_index", "SELECT 'urn:x:part:' || p_partkey AS s, CASE WHEN trim(p_name) = trim(p_type) THEN trim(p_name) WHEN trim(p_name) < trim(p_type) THEN trim(p_name) || '|' || trim(p_type) ELSE trim(p_type) || '|' || trim(p_name) END AS labels FROM part UNION ALL SELECT 'urn:x:nation:' || n_nationkey, trim(n_name) FROM nation")
def label_index(spark, d):
    return graph.label_index(star_triples(spark, d, "part", "nation")).select("s", F.array_join("labels", "|").alias("labels"))


@query("representative_labels", "SELECT 'urn:x:part:' || p_partkey AS s, CASE WHEN (length(p_name), p_name) <= (length(p_type), p_type) THEN p_name ELSE p_type END AS label FROM part")
def representative_labels(spark, d):
    return graph.representative_labels(star_triples(spark, d, "part"))


@query(
    "class_closure",
    "WITH RECURSIVE e(a, b) AS (VALUES ('urn:x:Customer', 'urn:x:Party'), ('urn:x:Supplier', 'urn:x:Party'), ('urn:x:Party', 'urn:x:Thing')), n AS (SELECT unnest(['urn:x:Region', 'urn:x:Nation', 'urn:x:Customer', 'urn:x:Supplier', 'urn:x:Part', 'urn:x:Order', 'urn:x:Party', 'urn:x:Thing']) AS a), c(a, b) AS (SELECT a, a FROM n UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS cls, b AS ancestor FROM c",
)
def class_closure(spark, d):
    return graph.class_closure(star_triples(spark, d, "region"))


@query("instances_of_class", "SELECT 'urn:x:customer:' || c_custkey AS s FROM customer UNION ALL SELECT 'urn:x:supplier:' || s_suppkey FROM supplier")
def instances_of_class(spark, d):
    return graph.instances_of(star_triples(spark, d, "customer", "supplier"), EX + "Party")


@query("direct_types", "SELECT 'urn:x:order:' || o_orderkey AS s, 'urn:x:Order' AS types FROM orders")
def direct_types(spark, d):
    return graph.direct_types(star_triples(spark, d, "orders")).where(F.col("s").startswith(EX + "order:")).select("s", F.array_join("types", ",").alias("types"))


@query(
    "known_iris",
    "SELECT count(*) AS n FROM (SELECT DISTINCT i FROM (SELECT 'urn:x:customer:' || c_custkey AS i FROM customer UNION ALL SELECT 'urn:x:nation:' || c_nationkey FROM customer UNION ALL SELECT unnest(['urn:x:' || x for x in ['Region', 'Nation', 'Customer', 'Supplier', 'Part', 'Order', 'Party', 'Thing', 'inRegion', 'inNation', 'placedBy', 'acctbal', 'segment', 'brand', 'size', 'orderDate', 'total', 'status']]) UNION ALL SELECT unnest(['rdf:type', 'owl:Class', 'owl:ObjectProperty', 'owl:DatatypeProperty', 'rdfs:subClassOf', 'rdfs:domain', 'rdfs:range', 'xsd:decimal', 'xsd:string', 'xsd:integer', 'xsd:dateTime', 'skos:prefLabel'])))",
)
def known(spark, d):
    return known_iris(star_triples(spark, d, "customer")).agg(F.count("*").alias("n"))


@query("vocabulary_gate", "SELECT iri FROM (VALUES ('urn:x:unknownClass'), ('urn:x:madeUp')) t(iri)")
def vocabulary_gate(spark, d):
    from tripleloom.sparql.gate import iris_of

    asked = sorted(iris_of("SELECT ?x WHERE { ?x a ex:unknownClass ; ex:madeUp ?y ; ex:inNation ?n ; rdf:type ex:Customer }", PREFIXES))
    return spark.createDataFrame([(i,) for i in asked], "iri string").join(known_iris(star_triples(spark, d, "customer")), "iri", "left_anti")


@query(
    "schema_catalog",
    "SELECT line FROM (VALUES ('class ex:Region'), ('class ex:Nation'), ('class ex:Customer'), ('class ex:Supplier'), ('class ex:Part'), ('class ex:Order'), ('class ex:Party'), ('class ex:Thing'), ('object_property ex:inRegion domain=urn:x:Nation range=urn:x:Region'), ('object_property ex:inNation domain=urn:x:Party range=urn:x:Nation'), ('object_property ex:placedBy domain=urn:x:Order range=urn:x:Customer'), ('datatype_property ex:acctbal domain=urn:x:Party range=http://www.w3.org/2001/XMLSchema#decimal'), ('datatype_property ex:segment domain=urn:x:Customer range=http://www.w3.org/2001/XMLSchema#string'), ('datatype_property ex:brand domain=urn:x:Part range=http://www.w3.org/2001/XMLSchema#string'), ('datatype_property ex:size domain=urn:x:Part range=http://www.w3.org/2001/XMLSchema#integer'), ('datatype_property ex:orderDate domain=urn:x:Order range=http://www.w3.org/2001/XMLSchema#dateTime'), ('datatype_property ex:total domain=urn:x:Order range=http://www.w3.org/2001/XMLSchema#decimal'), ('datatype_property ex:status domain=urn:x:Order range=http://www.w3.org/2001/XMLSchema#string'), ('undeclared rdf:type'), ('undeclared rdfs:subClassOf'), ('undeclared rdfs:domain'), ('undeclared rdfs:range'), ('undeclared rdfs:label')) t(line)",
)
def schema_catalog(spark, d):
    return graph.schema_catalog(star_triples(spark, d, "nation"), PREFIXES)


def _broken_graph(spark: SparkSession, d: str) -> DataFrame:
    """The star graph with one fault of each kind."""
    faults = [
        ("urn:x:nation:0", LABEL, "literal", None, "", "", "copy"),
        ("urn:x:region:0", EX + "notDeclared", "literal", "x", "", "", "region"),
        ("urn:x:thing:1", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "iri", EX + "Ghost", "", "", "region"),
        ("urn:x:customer:1", EX + "inNation", "iri", "urn:x:nation:9999", "", "", "customer"),
    ]
    base = star_triples(spark, d, "region", "nation", "customer")
    extra = spark.createDataFrame(faults, "s string, p string, o_kind string, o_value string, o_datatype string, o_lang string, component string").where("o_value is not null")
    again = base.where(f"s = 'urn:x:nation:0' and p = '{LABEL}'").withColumn("component", F.lit("copy"))
    return base.unionByName(extra).unionByName(again)


@query("integrity_undeclared_predicates", "SELECT 'urn:x:notDeclared' AS p")
def integrity_predicates(spark, d):
    return graph.undeclared_predicates(_broken_graph(spark, d), EX)


@query("integrity_undeclared_classes", "SELECT 'urn:x:Ghost' AS cls")
def integrity_classes(spark, d):
    return graph.undeclared_classes(_broken_graph(spark, d), EX)


@query("integrity_dangling", "SELECT o_value FROM (VALUES ('urn:x:nation:9999'), ('urn:x:Ghost')) t(o_value)")
def integrity_dangling(spark, d):
    return graph.dangling_resources(_broken_graph(spark, d), EX)


def _order_facts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.lit("run-1").alias("run_id"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("unit_id"),
        F.concat(F.lit("urn:x:order:"), F.col("o_orderkey").cast("string")).alias("s"),
        F.lit(EX + "status").alias("p"),
        F.lit("literal").alias("o_kind"),
        F.col("o_orderstatus").alias("o_value"),
        F.col("o_orderpriority").alias("locator"),
        F.col("o_orderpriority").alias("quote"),
        F.lit(1.0).alias("confidence"),
    )


@query("iri_substitute", "SELECT 'urn:x:customer:' || c_custkey AS s, CASE WHEN n_regionkey = 0 THEN 'urn:y:nation:' || n_nationkey ELSE 'urn:x:nation:' || n_nationkey END AS o_value FROM customer JOIN nation ON c_nationkey = n_nationkey")
def iri_substitute(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 0")
    key = F.col("n_nationkey").cast("string")
    mapping = n.select(F.concat(F.lit("urn:x:nation:"), key).alias("iri"), F.concat(F.lit("urn:y:nation:"), key).alias("target"))
    return graph.substitute_iris(star_triples(spark, d, "customer"), mapping).where((F.col("p") == EX + "inNation") & (F.col("component") == "customer")).select("s", "o_value")


@query("residual_iris", "SELECT DISTINCT 'urn:x:nation:' || c_nationkey AS iri FROM customer")
def residual(spark, d):
    return graph.residual_iris(star_triples(spark, d, "customer"), "urn:x:nation:")


# ---- text, similarity -----------------------------------------------------------------


@query("term_frequency", "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([가-힣A-Za-z0-9·()_-]+)', 1)) AS term FROM documents) WHERE length(term) >= 2 GROUP BY term HAVING count(*) >= 20")
def term_frequency(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([가-힣A-Za-z0-9·()_-]+)"), 1)).alias("term"))
    return words.where("length(term) >= 2").groupBy("term").agg(F.count("*").alias("n")).where("n >= 20")


@query("number_tokens", "SELECT conversation_id, array_to_string(list_transform(regexp_extract_all(reference_answer, '([0-9]+)', 1), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')), ',') AS numbers FROM (SELECT DISTINCT conversation_id, reference_answer FROM qa_records) WHERE reference_answer IS NOT NULL")
def number_tokens(spark, d):
    rows = table(spark, d, "qa_records").select("conversation_id", "reference_answer").distinct().where("reference_answer is not null")
    return rows.select("conversation_id", F.array_join(X.number_tokens(F.col("reference_answer")), ",").alias("numbers"))


@query("normalised_labels", "SELECT DISTINCT name_id, regexp_replace(lower(label), '[^0-9a-z가-힣]', '', 'g') AS plain, trim(regexp_replace(label, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS spaced FROM candidate_entities WHERE label IS NOT NULL")
def normalised_labels(spark, d):
    return table(spark, d, "candidate_entities").where("label is not null").select("name_id", X.n2(F.col("label")).alias("plain"), X.n3(F.col("label")).alias("spaced")).distinct()


_MENTION_PAIRS = "SELECT DISTINCT q.mention_id, regexp_replace(lower(q.mention), '[^0-9a-z가-힣]', '', 'g') AS a, regexp_replace(lower(r.label), '[^0-9a-z가-힣]', '', 'g') AS b FROM query_terms q JOIN term_choices t ON q.mention_id = t.mention_id JOIN reference_terms r ON t.selected_iri = r.iri WHERE q.mention IS NOT NULL"
_GRAMS = "CASE WHEN length({c}) = 0 THEN []::VARCHAR[] WHEN length({c}) <= {n} THEN [{c}] ELSE list_transform(range(1, length({c}) - {m}), lambda i: substr({c}, i, {n})) END"


def _mention_pairs(spark: SparkSession, d: str) -> DataFrame:
    q, t, r = (table(spark, d, n) for n in ("query_terms", "term_choices", "reference_terms"))
    rows = q.select("mention_id", "mention").join(t.select("mention_id", F.col("selected_iri").alias("iri")), "mention_id").join(r.select("iri", "label"), "iri").where("mention is not null")
    return rows.select("mention_id", X.n2(F.col("mention")).alias("a"), X.n2(F.col("label")).alias("b")).distinct()


@query(
    "ngram_jaccard",
    f"WITH p AS ({_MENTION_PAIRS}), g AS (SELECT mention_id, list_distinct({_GRAMS.format(c='a', n=3, m=1)}) AS x, list_distinct({_GRAMS.format(c='b', n=3, m=1)}) AS y FROM p) SELECT mention_id, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM g",
)
def ngram_jaccard(spark, d):
    return _mention_pairs(spark, d).select("mention_id", F.round(X.jaccard(X.ngrams(F.col("a"), 3), X.ngrams(F.col("b"), 3)), 6).alias("jaccard"))


@query(
    "ngram_cosine",
    f"WITH p AS ({_MENTION_PAIRS}), g AS (SELECT mention_id, b, {_GRAMS.format(c='a', n=3, m=1)} AS x, {_GRAMS.format(c='b', n=3, m=1)} AS y FROM p), c AS (SELECT mention_id, b, list_distinct(list_concat(x, y)) AS v, x, y FROM g), s AS (SELECT mention_id, b, list_sum(list_transform(v, lambda k: len(list_filter(x, lambda e: e = k))::DOUBLE * len(list_filter(y, lambda e: e = k)))) AS dot, list_sum(list_transform(v, lambda k: len(list_filter(x, lambda e: e = k))::DOUBLE ** 2)) AS nx, list_sum(list_transform(v, lambda k: len(list_filter(y, lambda e: e = k))::DOUBLE ** 2)) AS ny FROM c) SELECT mention_id, round(CASE WHEN coalesce(sqrt(nx) * sqrt(ny), 0) = 0 THEN 0.0 ELSE dot / (sqrt(nx) * sqrt(ny)) END, 6) AS cosine FROM s",
)
def ngram_cosine(spark, d):
    return _mention_pairs(spark, d).select("mention_id", F.round(X.multiset_cosine(X.ngrams(F.col("a"), 3), X.ngrams(F.col("b"), 3)), 6).alias("cosine"))


@query(
    "embedding_topk",
    "SELECT vec_id, other, round(score, 5) AS score FROM (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE place <= 5",
)
def embedding_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.top_similar(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5).select("vec_id", "other", F.round("raw", 5).alias("score"))


@query("lexical_similarity")
def lexical_similarity(spark, d):
    q, t, r = (table(spark, d, n) for n in ("query_terms", "term_choices", "reference_terms"))
    rows = q.select("mention_id", "mention").join(t.select("mention_id", F.col("selected_iri").alias("iri")), "mention_id").join(r.select("iri", "label"), "iri").where("mention is not null").distinct()
    return rows.select("mention_id", "iri", F.round(fuzzy.lexical_similarity(F.col("mention"), F.col("label")), 6).alias("score"))


@query("variant_suspects")
def variant_suspects(spark, d):
    words = table(spark, d, "candidate_entities").where("label is not null").groupBy(F.col("label").alias("term")).agg(F.count("*").alias("n"))
    return fuzzy.variant_suspects(words)


@query("term_candidates")
def term_candidates(spark, d):
    from tripleloom.sources.star import ALT, PREF, TYPE

    r = table(spark, d, "reference_terms")
    row = lambda p, c, k: F.struct(F.lit(p).alias("p"), F.lit(k).alias("o_kind"), F.col(c).alias("o_value"))
    triples = r.select(F.col("iri").alias("s"), F.explode(F.array(row(PREF, "label", "literal"), row(ALT, "alt_label", "literal"), row(TYPE, "term_type", "iri"))).alias("t"))
    triples = triples.select("s", "t.*", F.lit("").alias("o_datatype"), F.lit("").alias("o_lang"), F.lit("list").alias("component"))
    asked = table(spark, d, "query_terms").groupBy("mention", "expected_type").agg(F.min("mention_id").alias("mention_id"))
    return linking.term_candidates(asked.where("mention is not null"), triples)


# ---- documents ---------------------------------------------------------------------------


@query("unit_blocks", "SELECT unit_id, count(*) AS blocks, count(*) FILTER (kind = 'ROW') AS rows FROM (SELECT unit_id, unnest(regexp_extract_all(text, '(?m)^\\[(BLOCK|ROW) [^\\]\\n]*\\]', 1)) AS kind FROM (SELECT DISTINCT unit_id, text FROM evidence_units)) GROUP BY unit_id")
def unit_blocks(spark, d):
    blocks = segments.unit_blocks(table(spark, d, "evidence_units").select("unit_id", "text").distinct())
    return blocks.groupBy("unit_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "row").alias("rows"))


@query("round_robin", "SELECT name_id FROM (SELECT name_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY name_id) AS depth FROM (SELECT DISTINCT name_id, document_id FROM candidate_entities WHERE document_id IS NOT NULL)) ORDER BY depth, document_id LIMIT 200")
def round_robin(spark, d):
    rows = table(spark, d, "candidate_entities").select("name_id", "document_id").where("document_id is not null").distinct()
    return segments.round_robin(rows, "document_id", "name_id", 200).select("name_id")


_QUESTIONS = "SELECT DISTINCT conversation_id, messages[len(messages) - 1].content AS question FROM qa_records WHERE len(messages) >= 2 AND messages[len(messages) - 1].content IS NOT NULL"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    rows = table(spark, d, "qa_records").where("size(messages) >= 2").select("conversation_id", F.get(m, F.size(m) - 2)["content"].alias("question"))
    return rows.where("question is not null").distinct()


@query(
    "restoration_status",
    "SELECT restoration_id, CASE WHEN coalesce(len(validation.unsupported_numbers), 0) > 0 OR coalesce(validation.word_coverage, 0) < 0.98 OR coalesce(validation.source_coverage, 0) < 0.98 THEN 'needs_review' ELSE 'passed' END AS status FROM (SELECT DISTINCT restoration_id, validation FROM restorations)",
)
def restoration_status(spark, d):
    rows = table(spark, d, "restorations").select("restoration_id", "validation").distinct()
    none = F.array().cast("array<string>")
    status = segments.restoration_status(F.coalesce("validation.unsupported_numbers", none), none, F.col("validation.word_coverage"), F.col("validation.source_coverage"))
    return rows.select("restoration_id", status.alias("status"))


# ---- tables ---------------------------------------------------------------------------------


@query("islands", "SELECT o_custkey AS grp, min(k) AS first, max(k) AS last FROM (SELECT o_custkey, k, k - row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS run FROM (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS k FROM orders)) GROUP BY o_custkey, run")
def islands(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("k"))
    return tables.islands(o, "grp", "k").select("grp", "first", "last")


@query("band_join", "SELECT o_orderkey, min(b.band) AS band FROM orders JOIN (SELECT k AS band, k * 40000 AS low, k * 40000 + 45000 AS high FROM range(0, 12) t(k)) b ON o_totalprice::BIGINT BETWEEN b.low AND b.high GROUP BY o_orderkey")
def band_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("page"), F.round("o_totalprice").cast("bigint").alias("price"))
    bands = spark.range(12).select(F.lit(1).alias("page"), F.col("id").alias("band"), (F.col("id") * 40000).alias("low"), (F.col("id") * 40000 + 45000).alias("high"))
    return tables.band_join(o, bands, "page", "price", 20000).select("o_orderkey", "band")


@query("reading_order", "SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag || l_linestatus) AS text FROM lineitem GROUP BY l_orderkey")
def reading_order(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("y0"), F.col("l_partkey").alias("x0"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return tables.reading_order(t, "l_orderkey")


@query(
    "typed_values",
    "SELECT conversation_id, CASE WHEN coalesce(regexp_replace(a, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g'), '') = '' THEN 'empty' WHEN regexp_matches(a, '^\\s*(\\d+)\\s*학점\\s*(이상|이하)?\\s*$') THEN 'integer' WHEN trim(a) = '미지정' THEN 'not_designated' ELSE 'string' END AS kind, TRY_CAST(nullif(regexp_extract(a, '^\\s*(\\d+)\\s*학점\\s*(이상|이하)?\\s*$', 1), '') AS INTEGER) AS value FROM (SELECT DISTINCT conversation_id, reference_answer AS a FROM qa_records)",
)
def typed_values(spark, d):
    rows = table(spark, d, "qa_records").select("conversation_id", "reference_answer").distinct()
    v = tables.typed_value(F.col("reference_answer"))
    return rows.select("conversation_id", v.alias("v")).select("conversation_id", "v.kind", F.col("v.value_int").alias("value"))


# ---- facts, reconciliation, records -------------------------------------------------------------


@query("first_facts", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def first_facts(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").cast("string").alias("unit_id"), F.lit("s").alias("subject"), F.lit("p").alias("predicate"), F.lit("integer").alias("object_kind"), F.col("l_linenumber").cast("string").alias("object_value"), F.lit("x").alias("locator"), F.col("l_partkey").alias("fact_id"))
    return E.first_facts(rows).select(F.col("unit_id").cast("bigint").alias("l_orderkey"), F.col("object_value").cast("int").alias("l_linenumber"), F.col("fact_id").alias("l_partkey"))


@query("reversed_intervals", "SELECT DISTINCT o_orderkey AS interval FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate")
def reversed_intervals(spark, d):
    begins = table(spark, d, "orders").select(F.col("o_orderkey").alias("interval"), F.col("o_orderdate").alias("at"))
    ends = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("interval"), F.col("l_shipdate").alias("at"))
    return E.reversed_intervals(begins, ends)


@query(
    "canonical_entities",
    "WITH e AS (SELECT DISTINCT unit_id, entity_id, label, identifier, list_sort(list_distinct(coalesce(types, []))) AS types FROM candidate_entities), s AS (SELECT *, CASE WHEN identifier IS NOT NULL OR len(list_filter(types, lambda t: t NOT IN ('hbu:Department', 'hbu:Course', 'hbu:Place', 'org:Organization', 'foaf:Person', 'hbu:AdministrativeAction'))) = 0 THEN 'global' ELSE 'unit:' || substr(sha256(unit_id), 1, 12) END AS scope FROM e) SELECT DISTINCT concat_ws('#', unit_id, entity_id) AS entity_key, 'urn:x:res:' || substr(regexp_replace(lower(coalesce(label, '')), '[^0-9a-z가-힣]', '', 'g'), 1, 40) || '-' || substr(sha256(coalesce(identifier, '') || '|' || coalesce(label, '') || '|' || array_to_string(types, ',') || '|' || scope), 1, 12) AS canonical_iri, scope FROM s",
)
def canonical_entities(spark, d):
    rows = table(spark, d, "candidate_entities").select("unit_id", "entity_id", "label", "identifier", "types", F.array("unit_id").alias("locators"))
    return reconcile.canonical_entities(rows).select("entity_key", "canonical_iri", "scope").distinct()


@query("latest_by", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events WHERE user_id IS NOT NULL) WHERE place = 1")
def latest_by(spark, d):
    return reconcile.latest_by(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query(
    "review_state",
    "WITH last AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place = 1) SELECT c_custkey::VARCHAR AS unit_id, CASE WHEN c_acctbal < 0 THEN 'incomplete' WHEN event_type IS NULL THEN 'undecided' WHEN value < 10 THEN 'stale' WHEN event_type IN ('click', 'view') THEN 'admitted' ELSE 'rejected' END AS state FROM customer LEFT JOIN last ON c_custkey = user_id",
)
def review_state(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("unit_id"), F.lit("h").alias("candidate_hash"), (F.col("c_acctbal") >= 0).alias("complete"))
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("unit_id"), F.when(F.col("value") < 10, "old").otherwise("h").alias("candidate_hash"), F.when(F.col("event_type").isin("click", "view"), "accept").otherwise("reject").alias("decision"), F.col("event_id").alias("seq")
    )
    return reconcile.review_state(c, e)


@query("resume_set", "SELECT user_id::VARCHAR AS unit_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place = 1 AND event_type = 'purchase'")
def resume_set(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("unit_id"), "event_id", F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("status"), F.lit(True).alias("complete"))
    return reconcile.resume_set(log, "event_id")


@query("missing_embeddings", "SELECT DISTINCT sha256(label) AS key, label AS text FROM ontology_terms WHERE label IS NOT NULL AND label NOT IN (SELECT label FROM candidate_entities WHERE label IS NOT NULL)")
def missing_embeddings(spark, d):
    texts = table(spark, d, "ontology_terms").where("label is not null").select(F.col("label").alias("text"))
    cache = table(spark, d, "candidate_entities").where("label is not null").select(F.sha2("label", 256).alias("key"))
    return reconcile.missing_embeddings(texts, cache)


@query("run_report", "SELECT coalesce(o.k, l.k)::VARCHAR AS unit_id, CASE WHEN o.k IS NULL THEN 'extra draft' WHEN NOT o.f AND l.k IS NOT NULL THEN 'draft of a page without facts' WHEN o.f AND l.k IS NULL THEN 'missing draft' END AS issue FROM (SELECT o_orderkey AS k, o_orderstatus <> 'P' AS f FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k WHERE o.k IS NULL OR (NOT o.f AND l.k IS NOT NULL) OR (o.f AND l.k IS NULL)")
def run_report(spark, d):
    units = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("unit_id"), (F.col("o_orderstatus") != "P").alias("has_facts"), F.lit("h").alias("hash"))
    drafts = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("unit_id"), F.lit("h").alias("hash")).distinct()
    return reconcile.run_report(units, drafts)


@query("type_coverage", "SELECT question_type, count(*) AS n FROM (SELECT DISTINCT conversation_id, question_type FROM qa_records) GROUP BY question_type")
def type_coverage(spark, d):
    return records.type_coverage(table(spark, d, "qa_records").select("conversation_id", "question_type").distinct())


@query("flattened_messages", "SELECT conversation_id, turn::INTEGER AS turn, m.role AS role, m.content AS content FROM (SELECT DISTINCT conversation_id, unnest(range(0, len(messages))) AS turn, unnest(messages) AS m FROM qa_records)")
def flattened_messages(spark, d):
    return records.flattened_messages(table(spark, d, "qa_records").select("conversation_id", "messages").distinct())


@query("review_counters", "SELECT review_status, count(*) AS n, count(*) FILTER (automatic_validation.status = 'passed') AS passed FROM (SELECT DISTINCT conversation_id, review_status, automatic_validation FROM qa_records) GROUP BY review_status")
def review_counters(spark, d):
    rows = table(spark, d, "qa_records").select("conversation_id", "review_status", "automatic_validation").distinct()
    return rows.groupBy("review_status").agg(F.count("*").alias("n"), F.count_if(F.col("automatic_validation.status") == "passed").alias("passed"))
