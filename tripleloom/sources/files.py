"""Readers and sinks for records, styles, Markdown and manifests."""

from __future__ import annotations

import json
import re
from configparser import ConfigParser
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_SEPARATOR = "\n\n---\n\n"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with a fixed schema; blank lines are passed over, a line that is no object fails."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = F.when(~F.ltrim("value").startswith("{"), F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))).cast("string")).otherwise(F.col("value"))
    return lines.select(F.from_json(bad, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def style_questions(spark: SparkSession, path: str, column: str = "Pregunta", prefix: str = "style") -> DataFrame:
    """(style_id, question) of a semicolon CSV; numbers count the file's rows, blank ones too."""
    rows = spark.read.csv(path, sep=";", header=True, encoding="UTF-8", multiLine=True)
    first = rows.columns[0]
    rows = rows.withColumnRenamed(first, first.lstrip("﻿"))
    if column not in rows.columns:
        raise ValueError(f"{path} has no column {column}")
    # rows are numbered inside their partition; the partitions' sizes give the offsets
    marked = rows.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    sizes = marked.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("__first"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = marked.join(F.broadcast(sizes.select("__part", "__first", offset.alias("__offset"))), "__part").withColumn("place", (F.col("__offset") + F.col("__row") - F.col("__first") + 1).cast("int"))
    kept = numbered.select(F.format_string(f"{prefix}-%04d", "place").alias("style_id"), F.trim(column).alias("question"))
    return kept.where("question is not null and question != ''")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(document, page, text): a Markdown file cut at its page separators; an empty page fails."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document"), F.col("value"))
    pages = texts.select("document", F.posexplode(F.split("value", re.escape(PAGE_SEPARATOR))).alias("at", "text"))
    checked = F.when(F.trim("text") == "", F.raise_error(F.lit("empty page")).cast("string")).otherwise(F.col("text"))
    return pages.select("document", (F.col("at") + 1).alias("page"), checked.alias("text"))


def parse_pages(text: str) -> list[int] | None:
    """Page numbers of '1-4,40'; None for 'all'."""
    if text.strip() == "all":
        return None
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m or int(m[2] or m[1]) < int(m[1]) or int(m[1]) < 1:
            raise ValueError(f"bad page list {part!r}")
        out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    if not out:
        raise ValueError("the page list is empty")
    return sorted(out)


def preview_sections(text: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """(printed_page, pdf_page, body) of Markdown with '## 인쇄 페이지 N (PDF M)' headings; text: (value)."""
    parts = text.select(F.explode(F.split("value", r"(?m)(?=^## 인쇄 페이지 )")).alias("part"))
    head = r"^## 인쇄 페이지 (\d+) \(PDF (\d+)\)\s*"
    rows = parts.where(F.col("part").rlike(head)).select(
        F.regexp_extract("part", head, 1).cast("int").alias("printed_page"), F.regexp_extract("part", head, 2).cast("int").alias("pdf_page"), F.regexp_replace(F.regexp_replace("part", head, ""), r"^\s+|\s+$", "").alias("body")
    )
    return rows.where(F.col("printed_page").isin(pages)) if pages else rows


def manifest_issues(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """(document, issue): pages (document, page, text) against manifest (document, page, sha256)."""
    own = pages.select("document", "page", F.sha2("text", 256).alias("found"))
    both = own.join(manifest, ["document", "page"], "full")
    each = both.select("document", F.when(F.col("found").isNull(), "missing page").when(F.col("sha256").isNull(), "unlisted page").when(F.col("found") != F.col("sha256"), "changed page").alias("issue"))
    order = own.groupBy("document").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.count_distinct("page").alias("n")).where("a != 1 or b != n").select("document", F.lit("page sequence").alias("issue"))
    return each.where("issue is not null").unionByName(order).distinct()


def load_settings(path: str | Path, allowed: dict[str, set[str]]) -> dict[str, dict[str, str]]:
    """An INI file with exactly the allowed sections and keys; paths are relative to the file."""
    file = Path(path)
    ini = ConfigParser()
    ini.read_string(file.read_text(encoding="utf-8"))
    if set(ini.sections()) != set(allowed):
        raise ValueError(f"sections must be {sorted(allowed)}")
    out = {}
    for section, keys in allowed.items():
        if set(ini[section]) != keys:
            raise ValueError(f"[{section}] must have exactly {sorted(keys)}")
        out[section] = {k: str((file.parent / v).resolve()) if k.endswith("path") and not Path(v).is_absolute() else v for k, v in ini[section].items()}
    return out


def load_prompt(path: str | Path, variables: set[str]) -> dict:
    """A prompt document whose template names exactly the given variables."""
    document = json.loads(Path(path).read_text(encoding="utf-8"))
    found = set(re.findall(r"\{([a-z_]+)\}", document["template"]))
    if found != variables:
        raise ValueError(f"the template must name {sorted(variables)}, it names {sorted(found)}")
    return document


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON Lines; the committer makes a write all or nothing."""
    df.write.mode("append" if append else "overwrite").json(path)


def published_only(root: str | Path, allowed: set[str]) -> list[str]:
    """Entries of a published folder that do not belong there."""
    return sorted(p.name for p in Path(root).iterdir() if p.name not in allowed)


def run_manifest(outputs: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, digest): number of rows and an order-free digest of each output of a run.

    The digest is the sum of the first 32 bits of the MD5 of each row's fields, so that it
    is computed in one pass with partial sums.
    """
    made = []
    for name, df in outputs.items():
        row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
        made.append(df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias("digest")).select(F.lit(name).alias("name"), "rows", "digest"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the files under a path, to be held against a lock."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
