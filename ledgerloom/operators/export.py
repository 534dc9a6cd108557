"""Keyset pages of vertices and edges, and the CSV round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.fixpoint import cut
from ledgerloom.plans.ordered import numbered


def _page(vertices: DataFrame, cursor, limit: int, key: str) -> DataFrame:
    d = vertices if cursor is None else vertices.where(F.col(key) > F.lit(cursor))
    return d.orderBy(key).limit(limit)


def vertex_page(vertices: DataFrame, cursor=None, limit: int = 5000, key: str = "id") -> DataFrame:
    """The next ``limit`` rows behind ``cursor`` by key, with next_cursor: a range filter and a bounded top-n, never a full sort."""
    page = _page(vertices, cursor, limit, key)
    return page.join(F.broadcast(next_cursor(page, key)))


def _source_page(edges: DataFrame, vertices: DataFrame | None, key: str, cursor, limit: int) -> DataFrame:
    every = edges.select(key).distinct() if vertices is None else vertices.select(F.col("id").alias(key))
    return _page(every, cursor, limit, key)


def next_cursor(page: DataFrame, key: str = "id") -> DataFrame:
    """(next_cursor): the last key of a page, null behind the last page."""
    return page.agg(F.max(key).alias("next_cursor"))


def edge_page(edges: DataFrame, cursor=None, limit: int = 5000, vertices: DataFrame | None = None) -> DataFrame:
    """Distinct (from_id, to_id, next_cursor) of the next ``limit`` source vertices.

    With ``vertices(id)`` the page counts all vertices of the source's type, also those without edges; a page
    of these alone is one row without ends, so the cursor still moves on.
    """
    page = _source_page(edges, vertices, "from_id", cursor, limit)
    found = edges.join(page, "from_id", "left_semi").select("from_id", "to_id").distinct()
    end = next_cursor(page, "from_id").where("next_cursor is not null")
    return end.join(found, F.lit(True), "left").select("from_id", "to_id", "next_cursor")


def has_paid_page(flows: DataFrame, cursor=None, limit: int = 5000, vertices: DataFrame | None = None) -> DataFrame:
    """(src, edges, next_cursor): flow edges nested by source, for the next ``limit`` sources or vertices; see ``edge_page``."""
    page = _source_page(flows, vertices, "src", cursor, limit)
    each = F.sort_array(F.collect_list(F.struct("dst", "total_amount", "txn_count"))).alias("edges")
    nested = flows.join(page, "src", "left_semi").groupBy("src").agg(each)
    end = next_cursor(page, "src").where("next_cursor is not null")
    return end.join(nested, F.lit(True), "left").select("src", "edges", "next_cursor")


def _paged(vertices: DataFrame, limit: int, key: str) -> DataFrame:
    """(key, page): every vertex with the number of its page, from one pass over stretches of the order."""
    if limit < 1:
        raise ValueError("a page has at least one vertex")
    d = numbered(vertices.select(key).where(F.col(key).isNotNull()).distinct(), [F.col(key)], "place")
    return d.select(key, F.expr(f"place div {limit}").alias("page"))


def _index_of(paged: DataFrame, key: str) -> DataFrame:
    ends = paged.groupBy("page").agg(F.max(key).alias("next_cursor"), F.count(F.lit(1)).alias("n"))
    before = ends.select((F.col("page") + 1).alias("page"), F.col("next_cursor").alias("cursor"))
    return ends.join(before, "page", "left").select("page", "cursor", "next_cursor", "n")


def page_index(vertices: DataFrame, limit: int = 5000, key: str = "id") -> DataFrame:
    """(page, cursor, next_cursor, n) of all pages, from one pass: a page holds the keys in (cursor, next_cursor]."""
    return _index_of(_paged(vertices, limit, key), key)


def edge_pages(edges: DataFrame, vertices: DataFrame, limit: int = 5000) -> DataFrame:
    """(page, next_cursor, from_id, to_id): all pages of a relation at once, each as ``edge_page`` gives it.

    A page whose vertices have no edges is one row without ends; sources that are no vertex have no page.
    """
    paged = cut(_paged(vertices.select(F.col("id").alias("from_id")), limit, "from_id"))
    index = _index_of(paged, "from_id").select("page", "next_cursor")
    found = edges.select("from_id", "to_id").distinct().join(paged, "from_id").join(index, "page")
    bare = index.join(edges.join(paged, "from_id").select("page").distinct(), "page", "left_anti")
    none = bare.select("page", "next_cursor", F.lit(None).alias("from_id"), F.lit(None).alias("to_id"))
    return found.select("page", "next_cursor", "from_id", "to_id").unionByName(none)


def in_page(df: DataFrame, cursor, last, key: str = "id") -> DataFrame:
    """Rows of the page (cursor, last]: a range filter, which file statistics of sorted data turn into skipped files."""
    d = df.where(F.col(key) <= F.lit(last))
    return d if cursor is None else d.where(F.col(key) > F.lit(cursor))


def pages(vertices: DataFrame, limit: int = 5000, key: str = "id"):
    """Iterate over pages, for consumers that cannot read a whole frame: one pass for the index, a range for each page."""
    for p in page_index(vertices, limit, key).orderBy("page").toLocalIterator():
        yield in_page(vertices, p.cursor, p.next_cursor, key).orderBy(key)


def flow_csv_lines(flows: DataFrame, decimals: int = 2) -> DataFrame:
    """Flow edges as the text columns of the exchange file: money and spans in fixed notation, bins joined by ';'."""
    fmt = f"%.{decimals}f"
    at = lambda c: F.expr(f"date_format(timestampadd(SECOND, {c}, TIMESTAMP_NTZ'1970-01-01 00:00:00'), 'yyyy-MM-dd HH:mm:ss')")
    return flows.select(F.col("src").cast("string").alias("from_id"), F.col("dst").cast("string").alias("to_id"), F.format_string(fmt, "total_amount").alias("total_amount"), "txn_count",
                        at("first_ts").alias("first_txn_date"), at("last_ts").alias("last_txn_date"), F.format_string("%.4f", "span_days").alias("span_days"), "num_bins", "bin_days",
                        F.array_join(F.transform("amount_bins", lambda x: F.format_string(fmt, x)), ";").alias("amount_bins"), F.array_join(F.transform("count_bins", lambda x: x.cast("string")), ";").alias("count_bins"))


def split_list(column, kind: str = "double"):
    """A ';'-joined list as an array."""
    return F.transform(F.split(column, ";"), lambda x: x.cast(kind))


def flag(column):
    """1 for the text True, else 0: the loader's conditional column."""
    return F.when(column == "True", 1).otherwise(0)


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """A text file sink: one row, one line."""
    lines.select(column).write.mode("overwrite").text(path)


def artifact(folder: str, kind: str, seed: int, prevalence: float) -> str:
    """Path of an artifact, named after what made it, so that a reader never picks the newest of several."""
    return f"{folder}/{kind}-seed{seed}-prevalence{prevalence:.4f}"


def write_masks(masked: DataFrame, summary: DataFrame, folder: str, seed: int, prevalence: float) -> None:
    """The answer key as Parquet and its summary as CSV."""
    masked.write.mode("overwrite").parquet(artifact(folder, "labels", seed, prevalence))
    summary.write.mode("overwrite").csv(artifact(folder, "summary", seed, prevalence), header=True)


def read_answer_key(spark, folder: str, seed: int, prevalence: float) -> DataFrame:
    """The answer key of one run; a missing one is an error."""
    return spark.read.parquet(artifact(folder, "labels", seed, prevalence))
