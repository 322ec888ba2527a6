"""Table reconstruction from positioned tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.text import n9


def islands(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, first, last, centre): runs of consecutive integers and their rounded mean."""
    distinct = values.select(group, value).distinct()
    run = F.col(value) - F.row_number().over(Window.partitionBy(group).orderBy(value))
    return distinct.withColumn("run", run).groupBy(group, "run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.round(F.avg(value)).cast("int").alias("centre")).drop("run")


def band_join(points: DataFrame, bands: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """Points (key, value, ..) with the first band (key, band, low, high) that holds them.

    Both sides meet on blocks of ``width``, so the join is an equi-join; a band is
    copied to the blocks it spans.
    """
    low, high = (F.floor(F.col(c) / width) for c in ("low", "high"))
    spread = bands.select(F.col(key), "band", "low", "high", F.explode(F.sequence(low, high)).alias("block"))
    met = points.withColumn("block", F.floor(F.col(value) / width)).join(spread, [key, "block"]).where((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")))
    return met.groupBy(*points.columns).agg(F.min("band").alias("band"))


def assign_tokens(tokens: DataFrame, columns: DataFrame, rows: DataFrame, width: int = 64) -> DataFrame:
    """Tokens (page, token_id, x0, y0, x1, y1, text) with the row and column band of their centre."""
    centred = tokens.withColumn("cx", ((F.col("x0") + F.col("x1")) / 2).cast("int")).withColumn("cy", ((F.col("y0") + F.col("y1")) / 2).cast("int"))
    in_column = band_join(centred, columns, "page", "cx", width).withColumnRenamed("band", "base_column")
    return band_join(in_column, rows, "page", "cy", width).withColumnRenamed("band", "base_row")


def reading_order(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): texts in order of y, then x."""
    items = F.array_sort(F.collect_list(F.struct("y0", "x0", "text")))
    return tokens.groupBy(*keys).agg(F.array_join(F.transform(items, lambda t: t.text), " ").alias("text"))


def merge_cells(nodes: pd.DataFrame, edges: set[tuple[int, int]]) -> list[list[int]]:
    """Connected grid nodes (union of those without a boundary between them)."""
    parent = {int(n): int(n) for n in nodes["node"]}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    groups: dict[int, list[int]] = {}
    for n in parent:
        groups.setdefault(root(n), []).append(n)
    return [sorted(g) for g in groups.values()]


def physical_cells(grid: DataFrame) -> DataFrame:
    """(table_id, cell, row, column, rowspan, colspan, rectangular) of grid nodes (table_id, row, column, joins_right, joins_down)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = int(pdf["column"].max()) + 1
        pdf = pdf.assign(node=pdf["row"] * columns + pdf["column"])
        known = set(pdf["node"])
        edges = {(n, n + 1) for n, j in zip(pdf["node"], pdf["joins_right"], strict=True) if j and n + 1 in known}
        edges |= {(n, n + columns) for n, j in zip(pdf["node"], pdf["joins_down"], strict=True) if j and n + columns in known}
        out = []
        for k, group in enumerate(sorted(merge_cells(pdf, edges))):
            rows, cols = [n // columns for n in group], [n % columns for n in group]
            down, across = max(rows) - min(rows) + 1, max(cols) - min(cols) + 1
            out.append((pdf["table_id"].iloc[0], k, min(rows), min(cols), down, across, down * across == len(group)))
        return pd.DataFrame(out, columns=["table_id", "cell", "row", "column", "rowspan", "colspan", "rectangular"])

    kind = dict(grid.dtypes)["table_id"]
    return grid.groupBy("table_id").applyInPandas(run, f"table_id {kind}, cell int, row int, column int, rowspan int, colspan int, rectangular boolean")


def cell_coordinates(cells: DataFrame) -> DataFrame:
    """Cells with one row for each base coordinate they cover."""
    down = F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1)).alias("base_row")
    rows = cells.select("*", down)
    return rows.select("*", F.explode(F.sequence("column", F.col("column") + F.col("colspan") - 1)).alias("base_column"))


def materialised_rows(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(table_id, base_row, base_column, value, mode): direct, rowspan_inheritance or empty."""
    covered = cell_coordinates(cells).join(texts, ["table_id", "cell"], "left")
    mode = F.when(F.coalesce("text", F.lit("")) == "", "empty").when(F.col("base_row") == F.col("row"), "direct").otherwise("rowspan_inheritance")
    return covered.select("table_id", "base_row", "base_column", F.coalesce("text", F.lit("")).alias("value"), mode.alias("mode"))


def header_end(rows: DataFrame) -> DataFrame:
    """(table_id, header_end): the row before the first with enough filled cells."""
    filled = rows.where("value != ''").groupBy("table_id", "base_row").agg(F.count_distinct("base_column").alias("filled"))
    width = rows.groupBy("table_id").agg((F.max("base_column") + 1).alias("columns"))
    dense = filled.join(width, "table_id").where(F.col("filled") >= F.greatest(F.lit(2), F.col("columns") - 1))
    return dense.groupBy("table_id").agg((F.min("base_row") - 1).alias("header_end"))


def anchor_column(rows: DataFrame) -> DataFrame:
    """(table_id, anchor): the column with the most occupied rows of non-numeric text; a later one wins a tie."""
    numeric = F.col("value").rlike(r"^[\d\s.,%:~-]+$").cast("double")
    score = rows.where("value != ''").groupBy("table_id", "base_column").agg((F.count_distinct("base_row") * (1 - F.avg(numeric))).alias("score"))
    return score.groupBy("table_id").agg(F.max_by("base_column", F.struct("score", "base_column")).alias("anchor"))


def header_paths(header: DataFrame) -> DataFrame:
    """(table_id, base_column, path): header texts (table_id, base_row, first_column, last_column, text) down each column."""
    wide = header.select("table_id", "base_row", "text", F.explode(F.sequence("first_column", "last_column")).alias("base_column"))
    items = F.array_sort(F.collect_list(F.struct("base_row", "text")))
    return wide.groupBy("table_id", "base_column").agg(F.array_join(F.array_distinct(F.transform(items, lambda t: t.text)), " > ").alias("path"))


def continued_tables(tables: DataFrame) -> DataFrame:
    """(table_id, continues): untitled tables whose header signature exactly one table of the page before has.

    tables: (table_id, document, page, title, signature).
    """
    before = tables.select("document", (F.col("page") + 1).alias("page"), "signature", F.col("table_id").alias("continues"))
    untitled = tables.where("title is null or title = ''")
    met = untitled.join(before, ["document", "page", "signature"])
    return met.groupBy("table_id").agg(F.count("*").alias("n"), F.first("continues").alias("continues")).where("n = 1").select("table_id", "continues")


# How a note and a list item begin.
NOTE, LIST_ITEM = r"^\s*(?:※|주\)|주:|\*)", r"^\s*(?:[■▣◆]|\d+[.)]|[가-힣][.)])"
#: A footer begins in the last tenth of its page; a heading is so short and so much higher than the page's median.
FOOTER, HEADING_LENGTH, HEADING_HEIGHT = 0.90, 60, 1.2


def block_kind(text: Column, top: Column, height: Column, page_height: Column, median_height: Column, titled: Column | None = None) -> Column:
    """footer, note, heading, list_item or paragraph; ``titled`` tells the lines of a table's title."""
    return (
        F.when(top >= page_height * FOOTER, "footer")
        .when(text.rlike(NOTE), "note")
        .when(titled if titled is not None else F.lit(False), "heading")
        .when(text.rlike(LIST_ITEM), "list_item")
        .when((F.length(text) <= HEADING_LENGTH) & (height >= median_height * HEADING_HEIGHT), "heading")
        .otherwise("paragraph")
    )


def median_heights(tokens: DataFrame, page: str = "page", height: str = "height") -> DataFrame:
    """(page, median_height): the upper median of the tokens' heights, from counts of each height."""
    counts = tokens.groupBy(page, height).agg(F.count("*").alias("n"))
    up = Window.partitionBy(page).orderBy(height)
    whole = F.sum("n").over(Window.partitionBy(page))
    placed = counts.withColumn("until", F.sum("n").over(up)).withColumn("middle", F.floor(whole / 2) + 1)
    return placed.where(F.col("until") >= F.col("middle")).groupBy(page).agg(F.min(height).alias("median_height"))


def typed_value(c: Column) -> Column:
    """struct(kind, value_int, value_str, unit, comparator) of a cell."""
    credit = r"^\s*(\d+)\s*학점\s*(이상|이하)?\s*$"
    number = F.regexp_extract(c, credit, 1).try_cast("int")
    bound = F.regexp_extract(c, credit, 2)
    none = F.lit(None).cast("string")
    made = lambda kind, i, s, unit, comparator: F.struct(F.lit(kind).alias("kind"), i.alias("value_int"), s.alias("value_str"), unit.alias("unit"), comparator.alias("comparator"))
    return (
        F.when(F.coalesce(n9(c), F.lit("")) == "", made("empty", F.lit(None).cast("int"), none, none, none))
        .when(c.rlike(credit), made("integer", number, none, F.lit("credit"), F.when(bound == "이상", ">=").when(bound == "이하", "<=").otherwise("=")))
        .when(F.trim(c) == "미지정", made("not_designated", F.lit(None).cast("int"), none, none, none))
        .otherwise(made("string", F.lit(None).cast("int"), F.trim(c), none, none))
    )


def row_issues(columns: Column, values: Column, mode: Column, evidence: Column, confidence: Column, matched: Column) -> Column:
    """Grounding issues of a row's cell."""
    found = F.array(
        F.when((mode == "empty") & ((F.coalesce(values, F.lit("")) != "") | (F.size(evidence) > 0)), "empty cell has evidence"),
        F.when((mode != "empty") & (F.size(evidence) == 0), "no evidence"),
        F.when(confidence < 0.90, "low confidence"),
        F.when(~matched, "not in the viewer text"),
        F.when(F.coalesce(columns, F.lit("")) == "", "no column key"),
    )
    return F.array_compact(found)


def key_issues(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(table_id, issue): suggested keys (table_id, base_column, key) against the columns (table_id, base_column)."""
    both = columns.select("table_id", "base_column").distinct().withColumn("there", F.lit(True)).join(keys.select("table_id", "base_column", "key"), ["table_id", "base_column"], "full")
    each = both.select(
        "table_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("there").isNull(), "unknown column"),
                    F.when(F.col("there") & F.col("key").isNull(), "missing column"),
                    F.when(F.col("key").isNotNull() & ~F.col("key").rlike("^[a-z][a-z0-9_]*$"), "bad key"),
                )
            )
        ).alias("issue"),
    )
    repeated = keys.where("key is not null").groupBy("table_id", "key").count().where("count > 1").select("table_id", F.lit("repeated key").alias("issue"))
    return each.unionByName(repeated).distinct()


def attached_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(table_id, base_column, key, suggested): the physical key stays; the suggestion stands beside it."""
    named = F.concat(F.lit("column_"), F.col("base_column").cast("string"))
    return columns.select("table_id", "base_column").distinct().join(keys.select("table_id", "base_column", F.col("key").alias("suggested")), ["table_id", "base_column"], "left").select("table_id", "base_column", named.alias("key"), "suggested")


def inherited_titles(tables: DataFrame) -> DataFrame:
    """(table_id, title, continues): a continued table takes the title of the one it continues.

    tables as for ``continued_tables``.
    """
    owner = tables.select(F.col("table_id").alias("continues"), F.col("title").alias("own_title"))
    linked = continued_tables(tables).join(owner, "continues")
    return tables.select("table_id", "title").join(linked, "table_id", "left").select("table_id", F.coalesce(F.nullif("title", F.lit("")), "own_title").alias("title"), "continues")


def review_rows(rows: DataFrame) -> DataFrame:
    """Rows (.., table_issues, row_issues) with an issue of the table or of the row."""
    return rows.where((F.coalesce(F.size("table_issues"), F.lit(0)) > 0) | (F.coalesce(F.size("row_issues"), F.lit(0)) > 0))


def viewer_match(token: Column, viewer: Column) -> Column:
    """Whether a token's text stands in the viewer's, white space aside."""
    return F.coalesce(F.contains(n9(viewer), n9(token)), F.lit(False))


def geometry_summary(tokens: DataFrame) -> DataFrame:
    """(table_id, rows, columns, cells): physical size and the cells' texts in token order.

    tokens: (table_id, base_row, base_column, y0, x0, text).
    """
    texts = reading_order(tokens, "table_id", "base_row", "base_column")
    cell = F.struct("base_row", "base_column", "text")
    return texts.groupBy("table_id").agg(F.count_distinct("base_row").alias("rows"), F.count_distinct("base_column").alias("columns"), F.sort_array(F.collect_list(cell)).alias("cells"))


def token_scopes(tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """Tokens (table_id, token_id, base_row, base_column) with their cell and the rows and columns it spans."""
    covered = cell_coordinates(cells).select(
        "table_id", "cell", "base_row", "base_column", F.col("row").alias("first_row"), (F.col("row") + F.col("rowspan") - 1).alias("last_row"), F.col("column").alias("first_column"), (F.col("column") + F.col("colspan") - 1).alias("last_column")
    )
    return tokens.join(covered, ["table_id", "base_row", "base_column"])
