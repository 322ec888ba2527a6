"""Alignment of terms, canonical entities, publication and review."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.text import n2, short_hash, stable_json, vector_cosine
from tripleloom.operators.fuzzy import combined_score, lexical_similarity
from tripleloom.operators.graph import SCHEMA_TYPES, residual_iris, substitute_iris
from tripleloom.sources.star import TYPE

AUTO_COMBINED, AUTO_LEXICAL, AUTO_EMBEDDING = 0.93, 0.85, 0.90
REVIEW_COMBINED, REVIEW_EMBEDDING = 0.78, 0.82
# Words of yes and of no.
YES, NO = r"가능|허용|필수|포함|인정", r"불가|금지|제외|미인정|불허"


def polarity_compatible(a: Column, b: Column) -> Column:
    """Only a pure yes against a pure no is incompatible."""
    yes, no = (lambda c: c.rlike(YES)), (lambda c: c.rlike(NO))
    pure = lambda c, is_yes: (yes(c) & ~no(c)) if is_yes else (no(c) & ~yes(c))
    return ~((pure(a, True) & pure(b, False)) | (pure(a, False) & pure(b, True)))


def structure_compatible(kind_a: Column, kind_b: Column, domains_a: Column, domains_b: Column, ranges_a: Column, ranges_b: Column) -> Column:
    """Same kind; properties also share domain and range (two empty ones do)."""
    meet = lambda a, b: ((F.size(a) == 0) & (F.size(b) == 0)) | F.arrays_overlap(a, b)
    return (kind_a == kind_b) & ((kind_a == "class") | (F.coalesce(meet(domains_a, domains_b), F.lit(False)) & F.coalesce(meet(ranges_a, ranges_b), F.lit(False))))


def alignment_scores(terms: DataFrame, targets: DataFrame) -> DataFrame:
    """(term_key, iri, lexical, embedding, combined, compatible) of same-kind pairs, computed where they lie.

    terms, targets: (term_key or iri, kind, label, domains, ranges, vector).
    """
    # the pairs are much work for few bytes: the terms are spread over the cores first
    t, u = terms.repartition(2 * terms.sparkSession.sparkContext.defaultParallelism).alias("t"), targets.alias("u")
    pairs = t.join(u, F.col("t.kind") == F.col("u.kind"))
    lexical = lexical_similarity(F.col("t.label"), F.col("u.label"))
    scored = pairs.select(
        "t.term_key",
        "u.iri",
        F.round(lexical, 6).alias("lexical"),
        F.round(vector_cosine(F.col("t.vector"), F.col("u.vector")), 6).alias("embedding"),
        (structure_compatible(F.col("t.kind"), F.col("u.kind"), F.col("t.domains"), F.col("u.domains"), F.col("t.ranges"), F.col("u.ranges")) & polarity_compatible(F.col("t.label"), F.col("u.label"))).alias("compatible"),
        (n2(F.col("t.label")) == n2(F.col("u.label"))).alias("same_label"),
    )
    return scored.withColumn("combined", combined_score(F.col("lexical"), F.col("embedding")))


def verdict(combined: Column, lexical: Column, embedding: Column, compatible: Column, same_label: Column) -> Column:
    auto = compatible & (same_label | ((combined >= AUTO_COMBINED) & (lexical >= AUTO_LEXICAL) & (embedding >= AUTO_EMBEDDING)))
    return F.when(auto, "auto").when((combined >= REVIEW_COMBINED) | (embedding >= REVIEW_EMBEDDING), "review").otherwise("distinct")


def align_terms(upstream_scores: DataFrame, local_scores: DataFrame) -> DataFrame:
    """(term_key, target, status): the best target of each term, upstream or an earlier distinct local.

    The scores are computed in parallel; only the pairs that can decide (combined at
    least the review bound or a same label) reach the ordered fold, which runs once
    for each kind.
    """
    possible = F.col("same_label") | (F.col("combined") >= REVIEW_COMBINED) | (F.col("embedding") >= REVIEW_EMBEDDING)
    u = upstream_scores.withColumn("local", F.lit(False))
    loc = local_scores.withColumn("local", F.lit(True))
    columns = ["kind", "term_key", "iri", "lexical", "embedding", "combined", "compatible", "same_label", "local"]
    rows = u.select(columns).unionByName(loc.select(columns))
    every = rows.select("kind", "term_key").distinct().withColumn("iri", F.lit(None).cast("string"))
    decisive = rows.where(possible).withColumn("status", verdict(F.col("combined"), F.col("lexical"), F.col("embedding"), F.col("compatible"), F.col("same_label")))
    both = decisive.select("kind", "term_key", "iri", "lexical", "combined", "status", "local").unionByName(every, allowMissingColumns=True)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        distinct: set[str] = set()
        out = []
        for key, group in pdf.sort_values("term_key", kind="stable").groupby("term_key", sort=True):
            options = group[group["iri"].notna()]
            options = options[(options["local"] == False) | options["iri"].isin(distinct)]  # noqa: E712
            if len(options):
                best = options.sort_values(["combined", "lexical", "iri"], ascending=False).iloc[0]
                status, target = best["status"], best["iri"]
            else:
                status, target = "distinct", None
            if status == "distinct":
                distinct.add(key)
                target = None
            out.append((key, target, status))
        return pd.DataFrame(out, columns=["term_key", "target", "status"])

    return both.groupBy("kind").applyInPandas(fold, "term_key string, target string, status string")


def local_iri(label: Column, kind: Column, root: str = "urn:x:vocab:") -> Column:
    key = stable_json({"kind": kind, "label": label})
    return F.concat(F.lit(root), F.substring(n2(label), 1, 40), F.lit("-"), short_hash(key, 12))


def alignment_id(candidate: Column, target: Column, kind: Column) -> Column:
    return short_hash(stable_json({"candidate": candidate, "kind": kind, "target": target}), 24)


GLOBAL_TYPES = ("hbu:Department", "hbu:Course", "hbu:Place", "org:Organization", "foaf:Person", "hbu:AdministrativeAction")


def canonical_entities(entities: DataFrame) -> DataFrame:
    """(entity_key, canonical_iri, label, types, scope): the IRI is a function of the key alone.

    entities: (unit_id, entity_id, label, identifier, types, locators).
    """
    types = F.sort_array(F.array_distinct(F.coalesce("types", F.array().cast("array<string>"))))
    wide = F.col("identifier").isNotNull() | (F.size(F.array_except(types, F.array(*[F.lit(t) for t in GLOBAL_TYPES]))) == 0)
    scope = F.when(wide, "global").otherwise(F.concat(F.lit("unit:"), short_hash(F.array_join(F.sort_array("locators"), ","), 12)))
    key = F.concat_ws("|", F.coalesce("identifier", F.lit("")), F.coalesce("label", F.lit("")), F.array_join(types, ","), "scope")
    rows = entities.withColumn("scope", scope).withColumn("key", key)
    return rows.select(
        F.concat_ws("#", "unit_id", "entity_id").alias("entity_key"),
        F.concat(F.lit("urn:x:res:"), F.substring(n2(F.coalesce("label", F.lit(""))), 1, 40), F.lit("-"), short_hash(F.col("key"), 12)).alias("canonical_iri"),
        "label",
        types.alias("types"),
        "scope",
    ).distinct()


def latest_by(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last record of each key; records without a key are passed over."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(sequence)))
    return log.where(F.col(key).isNotNull()).withColumn("__place", place).where("__place = 1").drop("__place")


def review_state(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(unit_id, state): admitted, rejected, stale, incomplete or undecided.

    candidates: (unit_id, candidate_hash, complete); decisions: (unit_id, candidate_hash, decision, seq).
    """
    last = latest_by(decisions, "unit_id", "seq").select("unit_id", F.col("candidate_hash").alias("decided"), "decision")
    state = (
        F.when(~F.col("complete"), "incomplete")
        .when(F.col("decision").isNull(), "undecided")
        .when(F.col("decided") != F.col("candidate_hash"), "stale")
        .when(F.col("decision").isin("accept", "amend"), "admitted")
        .otherwise("rejected")
    )
    return candidates.join(last, "unit_id", "left").select("unit_id", state.alias("state"))


def resume_set(log: DataFrame, seq: str, **expected: str) -> DataFrame:
    """(unit_id): units whose last record succeeded, is complete and has the expected inputs."""
    good = F.col("status").isin("success", "partial") & F.col("complete")
    for name, value in expected.items():
        good = good & (F.col(name) == value)
    return latest_by(log, "unit_id", seq).where(good).select("unit_id")


def resolved_alignments(alignments: DataFrame, decisions: DataFrame) -> DataFrame:
    """(candidate_iri, target, label, definition): decisions applied; one still pending fails.

    alignments: (alignment_id, candidate_iri, status, target_iri, distinct_iri, label, definition).
    """
    last = latest_by(decisions, "alignment_id", "seq").select("alignment_id", "decision", F.col("target_iri").alias("decided_iri"), "amended_label", "amended_definition")
    both = alignments.join(last, "alignment_id", "left")
    pending = (F.col("status") == "review") & F.col("decision").isNull()
    target = (
        F.when(pending, F.raise_error(F.concat(F.lit("pending alignment "), F.col("alignment_id"))).cast("string"))
        .when(F.col("decision").isin("merge", "select_upstream"), F.coalesce("decided_iri", "target_iri"))
        .when(F.col("decision").isin("keep_separate", "amend"), F.col("distinct_iri"))
        .when(F.col("status") == "auto", F.col("target_iri"))
        .otherwise(F.col("distinct_iri"))
    )
    return both.select("candidate_iri", target.alias("target"), F.coalesce("amended_label", "label").alias("label"), F.coalesce("amended_definition", "definition").alias("definition"))


def consolidated_schema(proposals: DataFrame) -> DataFrame:
    """(target, kind, label, definition, domains, ranges): majority kind, shortest label and definition.

    proposals: (target, kind, label, definition, domains, ranges).
    """
    counted = proposals.groupBy("target", "kind").agg(F.count("*").alias("n"))
    kind = counted.groupBy("target").agg(F.min_by("kind", F.struct((-F.col("n")).alias("n"), "kind")).alias("kind"))
    shortest = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.length(c).alias("n"), F.col(c).alias("v"))))
    rest = proposals.groupBy("target").agg(
        shortest("label").alias("label"), shortest("definition").alias("definition"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("domains"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ranges")))).alias("ranges")
    )
    return kind.join(rest, "target")


def publish(profile: DataFrame, drafts: DataFrame, mapping: DataFrame, schema: DataFrame, candidate_root: str, header: DataFrame | None = None) -> DataFrame:
    """The published graph: profile, mapped drafts without candidate schema, local schema and the header.

    Every statement of a draft about a candidate class or property falls out, since the
    consolidated schema takes its place. Candidate IRIs that are left are an error.
    """
    declared = drafts.where((F.col("p") == TYPE) & F.col("o_value").isin(*SCHEMA_TYPES) & F.col("s").startswith(candidate_root)).select("s").distinct()
    mapped = substitute_iris(drafts.join(declared, "s", "left_anti").select(drafts.columns), mapping)
    graph = profile.unionByName(mapped).unionByName(schema)
    graph = (graph if header is None else graph.unionByName(header)).distinct()
    left = residual_iris(graph, candidate_root).limit(5).collect()
    if left:
        raise ValueError(f"candidate IRIs are left: {[r[0] for r in left]}")
    return graph


def run_report(units: DataFrame, drafts: DataFrame) -> DataFrame:
    """(unit_id, issue): units (unit_id, has_facts, hash) against drafts (unit_id, hash)."""
    both = units.alias("u").join(drafts.alias("d"), "unit_id", "full")
    issue = (
        F.when(F.col("u.has_facts").isNull(), "extra draft")
        .when(~F.col("u.has_facts") & F.col("d.hash").isNotNull(), "draft of a page without facts")
        .when(F.col("u.has_facts") & F.col("d.hash").isNull(), "missing draft")
        .when(F.col("u.hash") != F.col("d.hash"), "different draft")
    )
    return both.select("unit_id", issue.alias("issue")).where("issue is not null")


def missing_embeddings(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, text): distinct texts whose hash the cache lacks."""
    return texts.select(F.sha2("text", 256).alias("key"), "text").distinct().join(cache.select("key"), "key", "left_anti")


def embed_missing(missing: DataFrame, embed, size: int = 64) -> DataFrame:
    """(key, vector): ``embed`` on lists of at most ``size`` texts, inside the tasks."""

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), size):
                part = pdf.iloc[start : start + size]
                vectors = embed(list(part["text"]))
                if len(vectors) != len(part):
                    raise ValueError("the model gave another number of vectors")
                yield pd.DataFrame({"key": part["key"], "vector": [list(map(float, v)) for v in vectors]})

    return missing.mapInPandas(run, "key string, vector array<double>")


def grouped_proposals(proposals: DataFrame, mapping: DataFrame, root: str) -> DataFrame:
    """(target, n, candidates): proposals (candidate_iri) by their canonical term (candidate_iri, target) of the local vocabulary."""
    met = proposals.select("candidate_iri").distinct().join(mapping.select("candidate_iri", "target").distinct(), "candidate_iri").where(F.col("target").startswith(root))
    return met.groupBy("target").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("candidate_iri")).alias("candidates"))


def stale_inputs(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(name, issue): recorded hashes (name, sha256) against what is there now (name, sha256)."""
    both = recorded.select("name", F.col("sha256").alias("was")).join(current.select("name", F.col("sha256").alias("now")), "name", "full")
    issue = F.when(F.col("now").isNull(), "missing input").when(F.col("was").isNull(), "new input").when(F.col("was") != F.col("now"), "changed input")
    return both.select("name", issue.alias("issue")).where("issue is not null")


# Decisions about candidates and about alignments, and the form of a target.
UNIT_DECISIONS, ALIGNMENT_DECISIONS = ("accept", "reject", "amend"), ("merge", "keep_separate", "select_upstream", "amend")
TARGET = r"^(?:https?://|urn:)[^\s<>\"]+$"


def unit_decision_issues(decisions: DataFrame) -> DataFrame:
    """(decision_id, issues) of decisions (decision_id, decision, status, complete, reason)."""
    d = F.coalesce("decision", F.lit(""))
    approved = (F.col("status") == "success") & F.coalesce("complete", F.lit(False))
    found = F.array(
        F.when(~d.isin(*UNIT_DECISIONS), "unknown decision"),
        F.when(d.isin("accept", "amend") & ~F.coalesce(approved, F.lit(False)), "candidate is not complete"),
        F.when((d == "reject") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "no reason"),
    )
    return decisions.select("decision_id", F.array_compact(found).alias("issues"))


def alignment_decision_issues(decisions: DataFrame, upstream: DataFrame) -> DataFrame:
    """(decision_id, issues) of decisions (decision_id, decision, target_iri, amended_label, amended_definition); upstream: (iri)."""
    known = upstream.select(F.col("iri").alias("target_iri")).distinct().withColumn("known", F.lit(True))
    d, target = F.coalesce("decision", F.lit("")), F.coalesce("target_iri", F.lit(""))
    given = (F.coalesce("amended_label", F.lit("")) != "") & (F.coalesce("amended_definition", F.lit("")) != "")
    found = F.array(
        F.when(~d.isin(*ALIGNMENT_DECISIONS), "unknown decision"),
        F.when(d.isin("merge", "select_upstream") & (target == ""), "no target"),
        F.when((target != "") & ~target.rlike(TARGET), "bad target"),
        F.when((d == "select_upstream") & F.col("known").isNull(), "target outside the profile"),
        F.when((d == "amend") & ~given, "no amended text"),
    )
    return decisions.join(known, "target_iri", "left").select("decision_id", F.array_compact(found).alias("issues"))


def amended_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts (unit_id, fact_id, locator, ..) with the authoritative quote of their locator (unit_id, locator, quote); without one they fall out."""
    rest = [c for c in facts.columns if c != "quote"]
    return facts.select(rest).join(evidence.select("unit_id", "locator", "quote"), ["unit_id", "locator"]).select(*rest, "quote")
