"""Canonical pages: block merging, table context, rendering, and restoration checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.text import n9, number_tokens
from tripleloom.operators.segments import is_table_start, markdown_cells

#: Neighbouring blocks merge within this shift to the side and this gap downwards.
SIDE, GAP = 60, (-3, 14)
#: Blocks above and below a table that are its context: so far away, so many.
ABOVE, BELOW, CONTEXT = 200, 300, 3

BLOCKS = "page int, block int, kind string, x0 int, y0 int, x1 int, y1 int, text string"


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """A paragraph joins the paragraph, note or list item before it that it touches; the merged box decides about the next."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in pdf.sort_values(["y0", "x0"]).itertuples(index=False):
            last = out[-1] if out else None
            if last and r.kind == "paragraph" and last[2] in ("paragraph", "note", "list_item") and abs(r.x0 - last[3]) <= SIDE and GAP[0] <= r.y0 - last[6] <= GAP[1]:
                last[3:8] = [min(last[3], r.x0), min(last[4], r.y0), max(last[5], r.x1), max(last[6], r.y1), f"{last[7]} {r.text}"]
            else:
                out.append([r.page, len(out), r.kind, r.x0, r.y0, r.x1, r.y1, r.text])
        return pd.DataFrame(out, columns=["page", "block", "kind", "x0", "y0", "x1", "y1", "text"])

    return blocks.select("page", "kind", "x0", "y0", "x1", "y1", "text").groupBy("page").applyInPandas(run, BLOCKS)


def table_context(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """(table_id, before, after): the last blocks above and the notes and paragraphs below.

    tables: (table_id, page, y0, y1); blocks as merged.
    """
    t = tables.select("table_id", F.col("page"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    near = t.join(blocks.where("kind != 'footer'"), "page")
    above = near.where((F.col("y1") <= F.col("top")) & (F.col("top") - F.col("y1") <= ABOVE))
    place = F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("y1"), F.desc("block")))
    ordered = lambda: F.transform(F.array_sort(F.collect_list(F.struct("y0", "text"))), lambda x: x.text)
    before = above.withColumn("place", place).where(F.col("place") <= CONTEXT).groupBy("table_id").agg(ordered().alias("before"))
    below = near.where((F.col("y0") >= F.col("bottom")) & (F.col("y0") - F.col("bottom") <= BELOW) & F.col("kind").isin("note", "paragraph"))
    after = below.groupBy("table_id").agg(ordered().alias("after"))
    none = F.array().cast("array<string>")
    return t.select("table_id").join(before, "table_id", "left").join(after, "table_id", "left").select("table_id", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))


def page_summary(tokens: DataFrame) -> DataFrame:
    """(page, least_confidence, all_matched, status) of tokens (page, confidence, matched)."""
    out = tokens.groupBy("page").agg(F.min("confidence").alias("least_confidence"), F.every("matched").alias("all_matched"))
    return out.withColumn("status", F.when((F.col("least_confidence") >= 0.90) & F.col("all_matched"), "verified").otherwise("needs_review"))


def render_page(items: DataFrame) -> DataFrame:
    """(page, markdown): blocks and tables in reading order.

    items: (page, y0, x0, kind, text, title, accepted); a heading equal to a table's
    title is left out, an unaccepted cell or table is marked.
    """
    titles = items.where("kind = 'table'").groupBy("page").agg(F.collect_set(n9(F.coalesce("title", F.lit("")))).alias("titles"))
    rows = items.join(titles, "page", "left")
    repeated = (F.col("kind") == "heading") & F.coalesce(F.array_contains("titles", n9(F.col("text"))), F.lit(False))
    mark = F.when(~F.coalesce("accepted", F.lit(True)), F.lit("⚠️ ")).otherwise("")
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "text")).when(F.col("kind") == "list_item", F.concat(F.lit("- "), "text")).when(F.col("kind") == "table", F.concat(F.lit("### "), F.coalesce("title", F.lit("")), F.lit("\n\n"), mark, "text")).otherwise(F.concat(mark, F.col("text")))
    kept = rows.where(~repeated).select("page", F.struct("y0", "x0", line.alias("line")).alias("i"))
    return kept.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i.line), "\n\n").alias("markdown"))


# ---- restorations ------------------------------------------------------------------------


def align_table(lines: list[str], columns: int, spans: list[int] | None = None) -> list[str]:
    """Rows of a Markdown table widened to ``columns``: blanks go where spans end, else to the end."""
    out = []
    for k, line in enumerate(lines):
        cells = markdown_cells(line)
        if k == 1 and all(re.fullmatch(r":?-{3,}:?", c) for c in cells):
            out.append("| " + " | ".join(["---"] * columns) + " |")
            continue
        missing = columns - len(cells)
        if missing > 0 and spans and len(spans) == len(cells) and sum(spans) == columns:
            wide: list[str] = []
            for cell, span in zip(cells, spans, strict=True):
                wide += [cell, *[""] * (span - 1)]
            cells = wide
        elif missing > 0:
            cells += [""] * missing
        out.append("| " + " | ".join(cells[:columns]) + " |")
    return out


def table_width_issues(text: str) -> list[int]:
    """Line numbers of table rows whose width differs from their header's."""
    lines, out, i = text.split("\n"), [], 0
    while i + 1 < len(lines):
        if not is_table_start(lines[i], lines[i + 1]):
            i += 1
            continue
        width, j = len(markdown_cells(lines[i])), i + 2
        while j < len(lines) and lines[j].strip().startswith("|"):
            if len(markdown_cells(lines[j])) != width:
                out.append(j + 1)
            j += 1
        i = j
    return out


def restoration_check(markdown: Column, source: Column) -> Column:
    """struct(unsupported_numbers, unsupported_words, word_coverage, source_coverage) of a restored page."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"([가-힣A-Za-z]{2,})"), 1))
    made, given = words(markdown), words(source)
    share = lambda a, b: F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    return F.struct(
        F.array_except(number_tokens(markdown), number_tokens(source)).alias("unsupported_numbers"),
        F.array_except(made, given).alias("unsupported_words"),
        F.round(share(made, given), 6).alias("word_coverage"),
        F.round(share(given, made), 6).alias("source_coverage"),
    )


def document_counts(pages: DataFrame) -> DataFrame:
    """(document, generated, needs_review, pending, failed) of pages (document, status)."""
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return pages.groupBy("document").agg(one("generated"), one("needs_review"), one("pending"), one("failed"))


def status_after_alignment(status: Column, alignment_issues: Column, table_issues: Column, numbers: Column, words: Column, coverage: Column) -> Column:
    """Status of a restoration once its tables are aligned: issues of the alignment always need a review."""
    sound = (F.size(table_issues) == 0) & (F.size(numbers) == 0) & (F.size(words) == 0) & (F.coalesce(coverage, F.lit(0.0)) >= 0.98)
    return F.when(F.size(alignment_issues) > 0, "needs_review").when(sound, "generated").otherwise(status)
