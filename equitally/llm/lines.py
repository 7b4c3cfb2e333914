"""Line deduplication by site-relative frequency.

A line is boilerplate on a host if more than ``ratio`` of the host's pages
hold it.  Copies of a page count once on both sides of the ratio, so a page
that was crawled many times is not taken for boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equitally.llm.common import write_table

RATIO = 0.05
MIN_PAGES = 5
#: Splits of a hot host where a table of hosts is too large to broadcast.
SALTS = 32


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def page_key(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, groups: DataFrame | None = None) -> DataFrame:
    """(host, bad): line keys of each host's boilerplate.  A host has at most
    (lines of a page / ratio) of them on average.

    ``pages`` has host and text.  Only hashes are shuffled; distinct (host,
    line, page) triples collapse before the exchange, so a hot line is a count.
    Pages that share a group in ``groups`` (page, group: long; a page at most
    once) count as one.
    """
    def grouped(distinct: DataFrame) -> DataFrame:
        if groups is None:
            return distinct
        return distinct.join(groups, "page", "left").withColumn("page", F.coalesce("group", "page")).drop("group").distinct()

    keyed = pages.where("text is not null").select("host", page_key("text").alias("page"), "text")
    totals = grouped(keyed.select("host", "page").distinct()).groupBy("host").agg(F.count("*").alias("pages"))
    lines = keyed.select("host", "page", F.explode(F.array_distinct(F.transform(
        F.filter(F.split("text", "\n"), lambda l: F.trim(l) != ""), line_key))).alias("line"))
    seen = grouped(lines.distinct()).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    t = totals.select(F.col("host").alias("t_host"), "pages", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t_salt"))
    salt = F.pmod("line", F.lit(SALTS)).cast("int")
    return seen.join(t, F.col("host").eqNullSafe(F.col("t_host")) & (salt == F.col("t_salt"))) \
        .where(F.col("n") / F.col("pages") > ratio).groupBy("host").agg(F.collect_list("line").alias("bad"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, counts: tuple[str, str] = ("n_lines", "n_dropped"),
                     groups: DataFrame | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and two columns
    added: the number of lines and of lines dropped (columns that have the names
    in ``counts`` are replaced, all others ride along).

    Lines are compared without surrounding blanks; blank lines stay.  A null
    text stays null with 0 lines; a text may become empty.  Rows without a host
    form a host of their own.  Repeated rows come back as often as they came; an
    empty table gives no rows.  ``groups``: see ``boilerplate``.
    """
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    # written first: its size is then known, and Spark broadcasts it only if small
    bad = write_table(boilerplate(pages, ratio, min_pages, groups).select(
        F.col("host").alias("__host"), F.col("bad").alias("__bad"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")), "boilerplate")
    others = [c for c in docs.columns if c not in counts]
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in others if c != text_col]), F.lit(SALTS)).cast("int")
    joined = docs.select(*others, deal.alias("__deal")).join(
        bad, F.col(host_col).cast("string").eqNullSafe(F.col("__host")) & (F.col("__deal") == F.col("__salt")), "left")
    every = F.split(F.col(text_col).cast("string"), "\n")
    kept = F.filter(every, lambda l: (F.trim(l) == "") | ~F.array_contains("__bad", line_key(l)))
    cut = joined.withColumn("__kept", F.when(F.col("__bad").isNull(), every).otherwise(kept))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(every))
    dropped = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(every) - F.size("__kept"))
    return cut.select(*[F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in others],
                      n.cast("long").alias(counts[0]), dropped.cast("long").alias(counts[1]))
