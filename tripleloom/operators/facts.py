"""Grounding of extracted facts in their evidence.

facts: (unit_id, fact_id, subject, predicate, object_kind, object_value, locator,
quote, grounding, confidence); entities: (unit_id, entity_id, label, identifier, types).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.text import n4, number_tokens

KINDS = ("entity", "string", "integer", "decimal", "boolean", "date", "datetime")
# Cues of a yes and of a no.
POSITIVE, NEGATIVE = "가능|허용|포함|인정|승인|운영", "불가|금지|제외|없|않|못|미운영|불허|처리되지"
# A time of day in the source, the form of a typed one, and the document's offset.
MENTION = r"(?:(\d{4})\s*[.년]\s*)?(\d{1,2})\s*[.월]\s*(\d{1,2})\s*(?:[.일])?\s*(?:\([^)]*\))?\s*(\d{1,2}):(\d{2})"
SAME_DAY = MENTION + r"\s*[-~]\s*(\d{1,2}):(\d{2})"
STAMP = r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2})(?::(\d{2}))?(Z|[+-]\d{2}:\d{2})?$"
OFFSET = "+09:00"
XSD_KIND = {"integer": "integer", "nonNegativeInteger": "integer", "positiveInteger": "integer", "decimal": "decimal", "boolean": "boolean", "date": "date", "dateTimeStamp": "datetime", "dateTime": "datetime", "string": "string"}


def count_of(numbers: Column, x: Column) -> Column:
    return F.size(F.filter(numbers, lambda y: y == x))


def school_year(date: Column, grounding: Column) -> Column:
    """The calendar year of a month in 'N학년도 2학기 학사일정': July to December N, January to March N + 1."""
    year = F.regexp_extract(grounding, r"(\d{4})학년도 ?2학기", 1).try_cast("int")
    month = F.month(date)
    fixed = F.when(month >= 7, year).when(month <= 3, year + 1).otherwise(F.year(date))
    return F.when(year.isNull(), date).otherwise(F.concat_ws("-", F.lpad(fixed.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.dayofmonth(date).cast("string"), 2, "0")).try_cast("date"))


def date_supported(date: Column, quote: Column, grounding: Column) -> Column:
    """Month and day stand in the quote as often as needed, and the year in the grounding or by school year."""
    numbers = number_tokens(quote)
    month, day, year = (part(date).cast("string") for part in (F.month, F.dayofmonth, F.year))
    both = F.when(month == day, count_of(numbers, month) >= 2).otherwise((count_of(numbers, month) >= 1) & (count_of(numbers, day) >= 1))
    implied = F.regexp_extract(grounding, r"(\d{4})\s*학년도", 1).try_cast("int")
    by_school = F.year(date) == implied + F.when(F.month(date) <= 3, 1).otherwise(0)
    return F.coalesce(both & (F.array_contains(number_tokens(grounding), year) | F.coalesce(by_school, F.lit(False))), F.lit(False))


def local_stamp(day: Column, hour: Column, minute: Column, second: Column | None = None) -> Column:
    """ISO text of a local time of the documents; 24:00 is the next day's 00:00, an impossible time null."""
    second = second if second is not None else F.lit(0)
    midnight = (hour == 24) & (minute == 0) & (second == 0)
    date = F.when(midnight, F.date_add(day, 1)).otherwise(day)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    text = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T"), two(F.when(midnight, 0).otherwise(hour)), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit(OFFSET))
    return F.when((midnight | hour.between(0, 23)) & minute.between(0, 59) & second.between(0, 59), text)


def normalised_datetime(c: Column) -> Column:
    """A typed datetime as ISO text at the documents' offset; without an offset it is local, with another it is null."""
    part = lambda i: F.regexp_extract(c, STAMP, i)
    second = F.coalesce(part(4).try_cast("int"), F.lit(0))
    made = local_stamp(part(1).try_cast("date"), part(2).try_cast("int"), part(3).try_cast("int"), second)
    return F.when(part(5).isin("", OFFSET), made)


def source_datetimes(quote: Column, grounding: Column) -> Column:
    """ISO texts of all times of day that the quote names; years come from the mention or the grounding's school year.

    January to March belong to the year after the school year's. Both ends of a range
    within a day count. Impossible times and those without a year are left out.
    """
    school = F.regexp_extract(grounding, r"(\d{4})\s*학년도", 1).try_cast("int")

    def read(pattern: str, hour: int):
        def one(text: Column) -> Column:
            part = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
            month = part(2)
            year = F.coalesce(part(1), school + F.when(month <= 3, 1).otherwise(0))
            day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(3).cast("string"), 2, "0"))
            return F.when(year.isNotNull(), local_stamp(day.try_cast("date"), part(hour), part(hour + 1)))

        return one

    every = lambda pattern, hour: F.transform(F.regexp_extract_all(quote, F.lit(f"({pattern})"), 1), read(pattern, hour))
    found = F.concat(every(MENTION, 4), every(SAME_DAY, 4), every(SAME_DAY, 6))
    return F.sort_array(F.array_distinct(F.array_compact(found)))


def numbers_within(value: Column, evidence: Column) -> Column:
    """Every number of the value stands in the evidence."""
    return F.size(F.array_except(number_tokens(value), number_tokens(evidence))) == 0


def expand_references(facts: DataFrame, aliases: DataFrame, column: str = "predicate") -> DataFrame:
    """``column`` expanded by aliases (alias, iri); an alias of several IRIs stays."""
    single = aliases.distinct().groupBy("alias").agg(F.count("*").alias("n"), F.first("iri").alias("iri")).where("n = 1").select(F.col("alias").alias(column), "iri")
    return facts.join(single, column, "left").withColumn(column, F.coalesce("iri", column)).select(facts.columns)


def valid_facts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts that pass the checks of their kind, one for each five-tuple (the first), with declared ends."""
    value, quote, grounding = F.col("object_value"), F.col("quote"), F.col("grounding")
    date = value.try_cast("date")
    by_kind = (
        F.when(F.col("object_kind") == "entity", F.col("subject") != value)
        .when(F.col("object_kind") == "string", (value != "") & F.contains(n4(grounding), n4(value)))
        .when(F.col("object_kind") == "integer", value.rlike(r"^-?\d+$") & numbers_within(value, quote))
        .when(F.col("object_kind") == "decimal", value.try_cast("double").isNotNull() & numbers_within(value, quote))
        .when(F.col("object_kind") == "boolean", F.when(value == "true", grounding.rlike(POSITIVE)).when(value == "false", grounding.rlike(NEGATIVE)).otherwise(F.lit(False)))
        .when(F.col("object_kind") == "date", date.isNotNull() & date_supported(date, quote, grounding))
        .when(F.col("object_kind") == "datetime", F.array_contains(source_datetimes(quote, grounding), normalised_datetime(value)))
        .otherwise(F.lit(False))
    )
    declared = entities.select("unit_id", F.col("entity_id").alias("subject")).distinct()
    targets = entities.select("unit_id", F.col("entity_id").alias("object_value")).distinct()
    kept = facts.where(by_kind).join(declared, ["unit_id", "subject"], "left_semi")
    known = kept.where("object_kind = 'entity'").join(targets, ["unit_id", "object_value"], "left_semi").select(facts.columns)
    return first_facts(kept.where("object_kind != 'entity'").select(facts.columns).unionByName(known))


def first_facts(facts: DataFrame) -> DataFrame:
    """The first of equal (subject, predicate, kind, value, locator) in a unit."""
    key = ("unit_id", "subject", "predicate", "object_kind", "object_value", "locator")
    return facts.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("fact_id"))).where("place = 1").drop("place")


def referenced_entities(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities that some fact names."""
    named = facts.select("unit_id", F.col("subject").alias("entity_id")).union(facts.where("object_kind = 'entity'").select("unit_id", "object_value")).distinct()
    return entities.join(named, ["unit_id", "entity_id"], "left_semi")


def grounded_entities(entities: DataFrame, units: DataFrame) -> DataFrame:
    """Entities whose label stands in the unit's text; an identifier that does not is dropped. units: (unit_id, text)."""
    rows = entities.join(units.select("unit_id", "text"), "unit_id")
    kept = rows.where(F.contains(n4(F.col("text")), n4(F.col("label"))))
    return kept.withColumn("identifier", F.when(F.contains("text", "identifier"), F.col("identifier"))).select(entities.columns)


def reversed_intervals(begins: DataFrame, ends: DataFrame) -> DataFrame:
    """(interval): intervals that begin after they end. begins, ends: (interval, at)."""
    return begins.alias("b").join(ends.alias("e"), "interval").where(F.col("b.at") > F.col("e.at")).select("interval").distinct()


def merged_entities(batches: DataFrame) -> DataFrame:
    """(unit_id, entity_id, label, types): over batches the first label wins and types are united in order."""
    items = F.array_sort(F.collect_list(F.struct("batch", "label", "types")))
    grouped = batches.groupBy("unit_id", "entity_id").agg(items.alias("i"))
    return grouped.select("unit_id", "entity_id", F.col("i")[0].label.alias("label"), F.array_distinct(F.flatten(F.transform("i", lambda x: x.types))).alias("types"))


def coverage(targets: DataFrame, facts: DataFrame, no_facts: DataFrame, failed: DataFrame) -> DataFrame:
    """(unit_id, target, fact, no_fact, failed, unresolved, complete) of locators. All: (unit_id, locator)."""
    gather = lambda df, name: df.groupBy("unit_id").agg(F.sort_array(F.collect_set("locator")).alias(name))
    out = gather(targets, "target")
    for df, name in ((facts, "fact"), (no_facts, "no_fact"), (failed, "failed")):
        out = out.join(gather(df, name), "unit_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    rest = F.array_except("target", F.array_union("fact", F.array_union("no_fact", "failed")))
    return out.withColumn("unresolved", F.sort_array(rest)).withColumn("complete", (F.size("unresolved") == 0) & (F.size("failed") == 0))


def candidate_issues(units: DataFrame, entities: DataFrame, facts: DataFrame, terms: DataFrame) -> DataFrame:
    """(unit_id, issue): one row for each broken rule of a unit's candidate.

    units: (unit_id, text); terms: (iri, kind, domains, ranges).
    """
    out: list[DataFrame] = []

    def add(rows: DataFrame, issue: str) -> None:
        out.append(rows.select("unit_id", F.lit(issue).alias("issue")))

    add(entities.groupBy("unit_id", "entity_id").count().where("count > 1"), "duplicate entity id")
    add(entities.where(~F.coalesce(F.col("entity_id").rlike(r"^[A-Za-z][A-Za-z0-9_-]{0,63}$"), F.lit(False))), "bad entity id")
    add(entities.where("coalesce(trim(label), '') = ''"), "entity without label")
    add(entities.where("coalesce(size(types), 0) < 1"), "entity without type")
    classes = terms.where("kind = 'class'").select(F.col("iri").alias("type"))
    add(entities.select("unit_id", F.explode("types").alias("type")).join(classes, "type", "left_anti"), "unknown entity type")
    declared = entities.select("unit_id", F.col("entity_id").alias("subject")).distinct()
    add(facts.join(declared, ["unit_id", "subject"], "left_anti"), "undeclared subject")
    predicates = terms.where("kind != 'class'").select(F.col("iri").alias("predicate"), "kind", "domains", "ranges")
    add(facts.join(predicates, "predicate", "left_anti"), "unknown predicate")
    add(facts.where(~F.col("object_kind").isin(*KINDS)), "unknown object kind")
    entity_facts = facts.where("object_kind = 'entity'")
    add(entity_facts.join(declared.withColumnRenamed("subject", "object_value"), ["unit_id", "object_value"], "left_anti"), "undeclared object")
    add(entity_facts.where("subject = object_value"), "relation to itself")
    value, quote, grounding = F.col("object_value"), F.col("quote"), F.col("grounding")
    add(facts.where((F.col("object_kind") == "integer") & ~F.coalesce(value.rlike(r"^-?\d+$"), F.lit(False))), "integer is none")
    add(facts.where((F.col("object_kind") == "decimal") & value.try_cast("double").isNull()), "decimal is none")
    add(facts.where((F.col("object_kind") == "boolean") & ~F.coalesce(value.isin("true", "false"), F.lit(False))), "boolean is none")
    add(facts.where(F.col("object_kind").isin("integer", "decimal") & ~numbers_within(value, quote)), "number not in the quote")
    add(facts.where((F.col("object_kind") == "string") & ((value == "") | ~F.contains(n4(grounding), n4(value)))), "string not in the grounding")
    add(facts.where((F.col("object_kind") == "date") & ~date_supported(value.try_cast("date"), quote, grounding)), "date not supported")
    stamp = normalised_datetime(value)
    add(facts.where((F.col("object_kind") == "datetime") & stamp.isNull()), "datetime not at +09:00")
    add(facts.where((F.col("object_kind") == "datetime") & stamp.isNotNull() & ~F.coalesce(F.array_contains(source_datetimes(quote, grounding), value), F.lit(False))), "datetime not in the quote")
    add(facts.where((value == "true") & (F.col("object_kind") == "boolean") & ~grounding.rlike(POSITIVE)), "yes without a cue")
    add(facts.where((value == "false") & (F.col("object_kind") == "boolean") & ~grounding.rlike(NEGATIVE)), "no without a cue")
    add(facts.where("coalesce(quote, '') = ''"), "no quote")
    add(facts.where("locator is null or grounding is null"), "unknown locator")
    add(facts.where("confidence is null or confidence < 0 or confidence > 1"), "confidence outside 0..1")
    typed = facts.join(predicates, "predicate").join(entities.select("unit_id", F.col("entity_id").alias("subject"), F.col("types").alias("subject_types")), ["unit_id", "subject"], "left")
    add(typed.where((F.size("domains") > 0) & ~F.coalesce(F.arrays_overlap("domains", "subject_types"), F.lit(False))), "subject outside the domain")
    add(typed.where("kind = 'object_property' and object_kind != 'entity'"), "object property without an entity")
    add(typed.where("kind = 'datatype_property' and object_kind = 'entity'"), "datatype property with an entity")
    kinds = F.create_map(*[F.lit(x) for pair in XSD_KIND.items() for x in pair])
    wanted = F.transform("ranges", lambda r: F.element_at(kinds, F.element_at(F.split(r, "#"), -1)))
    add(typed.where((F.col("kind") == "datatype_property") & (F.size("ranges") > 0) & ~F.coalesce(F.array_contains(wanted, F.col("object_kind")), F.lit(True))), "literal outside the range")
    add(facts.groupBy("unit_id", "subject", "predicate", "object_kind", "object_value", "locator").count().where("count > 1"), "repeated fact")
    add(entities.join(units, "unit_id").where(~F.contains(n4(F.col("text")), n4(F.col("label")))), "label not in the unit")
    add(entities.where("identifier is not null").join(units, "unit_id").where(~F.contains("text", "identifier")), "identifier not in the unit")
    return reduce(lambda a, b: a.unionByName(b), out).distinct()


def contract_terms(terms: DataFrame, examples: DataFrame) -> DataFrame:
    """Terms (iri, ..) whose IRI occurs in an example text, and those of their domains and ranges."""
    named = terms.join(examples, F.contains(examples["text"], terms["iri"]), "left_semi")
    near = named.select(F.explode(F.concat(F.coalesce("domains", F.array()), F.coalesce("ranges", F.array()))).alias("iri")).distinct()
    return named.unionByName(terms.join(near, "iri", "left_semi").select(terms.columns)).distinct()


# Wrappers of a scalar, in order.
WRAPPERS = ("entity_id", "value", "text", "ko")


def unwrapped(c: Column, depth: int = 4) -> Column:
    """A JSON scalar without the objects that wrap it; an object of no known wrapper is empty text."""
    for _ in range(depth):
        inner = F.coalesce(*[F.get_json_object(c, f"$.{w}") for w in WRAPPERS], F.lit(""))
        c = F.when(c.rlike(r"^\s*\{"), inner).otherwise(c)
    return c


TIME = "http://www.w3.org/2006/time#"


def recovered_instants(facts: DataFrame, entities: DataFrame, dates: tuple[str, ...]) -> DataFrame:
    """(unit_id, entity_id, label, types): instants that date facts (predicates ``dates``) name but the entities lack."""
    named = facts.where(F.col("predicate").isin(*dates)).select("unit_id", F.col("subject").alias("entity_id"), F.col("object_value").alias("label")).distinct()
    first = named.groupBy("unit_id", "entity_id").agg(F.min("label").alias("label"))
    return first.join(entities.select("unit_id", "entity_id"), ["unit_id", "entity_id"], "left_anti").select("unit_id", "entity_id", "label", F.array(F.lit(TIME + "Instant")).alias("types"))


def admitted_entities(entities: DataFrame, units: DataFrame, classes: DataFrame) -> DataFrame:
    """Entities of a known class (type) whose label stands in the unit, or, for an instant, whose numbers do."""
    known = classes.select(F.col("type")).distinct()
    typed = entities.select("unit_id", "entity_id", F.explode("types").alias("type")).join(known, "type", "left_semi").select("unit_id", "entity_id").distinct()
    rows = entities.join(typed, ["unit_id", "entity_id"], "left_semi").join(units.select("unit_id", "text"), "unit_id")
    instant = F.array_contains("types", TIME + "Instant") & numbers_within(F.col("label"), F.col("text"))
    return rows.where(F.coalesce(F.contains(n4(F.col("text")), n4(F.col("label"))) | instant, F.lit(False))).select(entities.columns)


def domain_range_issues(facts: DataFrame, entities: DataFrame, terms: DataFrame, closure: DataFrame) -> DataFrame:
    """(unit_id, fact_id, issue): ends whose types, with their ancestors (cls, ancestor), miss the property's domain or range.

    terms: (iri, domains, ranges). An empty domain or range admits everything.
    """
    wide = entities.select("unit_id", "entity_id", F.explode("types").alias("cls")).join(closure, "cls", "left").groupBy("unit_id", "entity_id").agg(F.array_union(F.collect_set("cls"), F.collect_set("ancestor")).alias("wide"))
    rows = facts.join(terms.select(F.col("iri").alias("predicate"), "domains", "ranges"), "predicate")
    of = lambda end, name: wide.select("unit_id", F.col("entity_id").alias(end), F.col("wide").alias(name))
    rows = rows.join(of("subject", "subject_types"), ["unit_id", "subject"], "left").join(of("object_value", "object_types"), ["unit_id", "object_value"], "left")
    misses = lambda wanted, have: (F.coalesce(F.size(wanted), F.lit(0)) > 0) & ~F.coalesce(F.arrays_overlap(wanted, have), F.lit(False))
    issues = F.array_compact(F.array(F.when(misses("domains", "subject_types"), "domain"), F.when((F.col("object_kind") == "entity") & misses("ranges", "object_types"), "range")))
    return rows.select("unit_id", "fact_id", F.explode(issues).alias("issue"))


def without_reversed(facts: DataFrame, begin: str, end: str, date: str) -> DataFrame:
    """Facts without the boundaries, and their dates, of intervals that begin after they end."""
    at = facts.where(F.col("predicate") == date).select("unit_id", F.col("subject").alias("instant"), F.col("object_value").alias("at"))
    bound = lambda p: facts.where(F.col("predicate") == p).select("unit_id", F.col("subject").alias("interval"), F.col("object_value").alias("instant")).join(at, ["unit_id", "instant"])
    b, e = bound(begin).alias("b"), bound(end).alias("e")
    bad = b.join(e, (F.col("b.unit_id") == F.col("e.unit_id")) & (F.col("b.interval") == F.col("e.interval")) & (F.col("b.at") > F.col("e.at")))
    bad = bad.select(F.col("b.unit_id").alias("unit_id"), F.col("b.interval").alias("subject")).distinct()
    return facts.where(F.col("predicate").isin(begin, end)).join(bad, ["unit_id", "subject"], "left_anti").select(facts.columns).unionByName(facts.where(~F.col("predicate").isin(begin, end)))
