"""Raw ingest: CSV scans, extract landing, payload checks, ingest reports."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equitally.functions.cleaning import col_of
from equitally.session import write_table
from equitally.sources.schema import raw_schema

# Markup at the very start of a payload that is a web page, not data.
HTML_START_PATTERN = r"(?i)^\s*<(!doctype html|html)"


# Rows of one repeated content that a task numbers; more are split.
OCCURRENCES_PER_TASK = 65_536
# The bounded prefix of a landed file that the payload check looks at.
PREFIX_LINES, PREFIX_CHARS = 20, 4_096


def read_raw_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Header CSV with an explicit all-string schema (never inferred).

    Mixed columns such as DTI ('<20%', '36', 'Exempt') stay text until the
    cleaning rules parse them; NA tokens are handled by ``normalize_na_tokens``.
    ``columns`` defaults to the full raw dictionary; pass the header of a
    narrower extract otherwise.  Every file's own header must name these
    columns in this order: reading a file with other ones fails.
    """
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
            .option("nullValue", None).option("emptyValue", "")
            .schema(raw_schema(columns)).csv(path))


CORRUPT = "_corrupt_record"


def load_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, max_bad_share: float = 0.0,
             quarantine_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S1 without silent damage: (rows, quarantine, counts per file).

    A line with too few or too many fields, or with a quote that does not close,
    goes to the quarantine with its text and file, and to no other table.  Every
    line is parsed once: the scan writes one table that both sides are filters
    of, and the counts read no more of it than a file name and a flag.  More
    than ``max_bad_share`` of the lines in quarantine fails the load; then, and
    before any other result, the quarantine is at ``quarantine_path`` if that is
    given.
    """
    schema = raw_schema(columns).add(CORRUPT, "string")
    lines = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
             .option("enforceSchema", False).option("nullValue", None).option("emptyValue", "").schema(schema).csv(path)
             .withColumn("file_path", F.col("_metadata.file_path")))
    written = write_table(lines.withColumn("_is_bad", F.col(CORRUPT).isNotNull()), "loaded")
    per_file = written.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines"), F.count_if("_is_bad").alias("quarantined"))
    seen = per_file.agg(F.sum("lines").alias("n"), F.sum("quarantined").alias("bad")).first()
    bad = written.where("_is_bad").select("file_path", F.col(CORRUPT).alias("line"))
    if quarantine_path:
        bad.write.mode("overwrite").parquet(quarantine_path)
        bad = spark.read.parquet(quarantine_path)
    if (seen["bad"] or 0) > max_bad_share * (seen["n"] or 0):
        raise ValueError(f"{seen['bad']} of {seen['n']} lines are malformed; {max_bad_share:.4%} may be")
    return written.where("not _is_bad").drop(CORRUPT, "_is_bad", "file_path"), bad, per_file


LEDGER = "file_path string, length long, modified timestamp, lines long, content string, landed_at timestamp"


def landed_files(spark: SparkSession, ledger_path: str) -> DataFrame:
    """S3: the ledger of landed files, one row per landing; empty if there is none."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def land_new_files(spark: SparkSession, path: str | list[str], out_path: str, ledger_path: str,
                   columns: list[str] | None = None) -> DataFrame:
    """S3: land the CSV files under ``path`` that the ledger lacks; the new ledger rows.

    The ledger is an append-only table of path, length, modification time and a
    hash of the content.  Files are listed without being read; an anti join
    leaves those that no ledger row describes, and only they are read.  A file
    of known path whose content hash is unchanged is entered and not landed
    again; a changed one replaces its own rows, which lie in a partition of
    their own, and no others.  The rows are written before the ledger, so a run
    that breaks off lands its files again.  A content hash is that of the bag
    of lines: a file whose lines were only reordered counts as unchanged.
    """
    ledger = landed_files(spark, ledger_path)
    listed = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified"))  # contents are not read
    new = listed.join(ledger, ["file_path", "length", "modified"], "left_anti")
    paths = [r["file_path"] for r in new.select("file_path").collect()]  # file names, not rows
    if not paths:
        return spark.createDataFrame([], LEDGER)
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file_path"))
    whole = text.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("lines"), F.concat_ws("-", F.hex(F.bit_xor(F.xxhash64("value"))),
                                                      F.sum(F.xxhash64("value", F.lit(1)).cast("decimal(38,0)")).cast("string")).alias("content"))
    same_file = F.regexp_replace(F.col("file_path"), "^file:/+", "file:/")
    entries = new.withColumn("_f", same_file).join(whole.select(same_file.alias("_f"), "lines", "content"), "_f", "left").select(
        "file_path", "length", "modified", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("content", F.lit("")).alias("content"),
        F.current_timestamp().alias("landed_at"))
    entries = write_table(entries, "ledger-entries")
    last = ledger.groupBy("file_path").agg(F.max_by("content", "landed_at").alias("content"))
    changed = [r["file_path"] for r in entries.join(last, ["file_path", "content"], "left_anti").select("file_path").collect()]
    if changed:
        rows = read_raw_csv(spark, changed, columns).withColumn(
            "source_file", F.sha2(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/"), 256))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(out_path)
    entries.write.mode("append").parquet(ledger_path)
    return entries


def assign_row_key(df: DataFrame, key: str = "app_id") -> DataFrame:
    """Row identity for a raw extract without a source key: a 128-bit hash of
    the row's content and its occurrence number among identical rows.

    The key depends on the rows alone, not on files, splits or partitions.
    Identical rows meet as a count (partial aggregation on the map side); a
    count is expanded in chunks that are spread over tasks, so a row that
    makes up a third of the table is numbered by many tasks.
    """
    cols = df.columns
    text = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
    one, two = F.xxhash64(*text), F.xxhash64(F.lit(key), *text)
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    size = F.lit(OCCURRENCES_PER_TASK).cast("long")
    chunks = counted.select(*cols, "_n", F.explode(F.expr(
        f"sequence(0L, CAST((_n - 1) DIV {OCCURRENCES_PER_TASK} AS BIGINT))")).alias("_chunk")).hint("rebalance")
    first = F.col("_chunk") * size
    last = F.least(F.col("_n"), first + size) - F.lit(1)
    return chunks.select(*cols, F.explode(F.sequence(first, last)).alias("_occurrence")).select(
        *cols, F.concat(F.lower(F.lpad(F.hex(one), 16, "0")), F.lower(F.lpad(F.hex(two), 16, "0")),
                        F.lit("-"), F.col("_occurrence").cast("string")).alias(key))


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a header CSV, read from its first line only."""
    first = spark.read.text(path).limit(1).first()
    return [c.strip() for c in next(csv.reader([first[0]]))] if first else []


def is_html_payload(text: str | Column, strict: bool = False) -> Column:
    """S4 predicate: the payload is a web page rather than CSV data.

    Default: markup at the start, any case, after optional blanks.  With
    ``strict`` the narrower rule of the audited workflow: the text starts
    with ``<!doctype html>`` exactly, or ``<html>`` occurs in the first 100
    characters.
    """
    t = col_of(text)
    if strict:
        return t.startswith("<!doctype html>") | F.substring(t, 1, 100).contains("<html>")
    return t.rlike(HTML_START_PATTERN)


def split_payloads(df: DataFrame, text: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) payload rows; a filter each, no shuffle."""
    flag = is_html_payload(text, strict)
    return df.where(~flag | F.col(text).isNull()), df.where(flag)


def file_prefixes(spark: SparkSession, path: str | list[str], lines: int = PREFIX_LINES,
                  chars: int = PREFIX_CHARS) -> DataFrame:
    """``(file_path, first_line, prefix)`` of every text file under ``path``.

    The prefix is a file's first ``lines`` lines, each and all cut to ``chars``
    characters: the payload check is about how a file begins.  Only lines of
    a file's first split compete, and a row-number limit keeps the first few
    per task before anything is shuffled.
    """
    rows = (spark.read.text(path)
            .select(F.substring("value", 1, chars).alias("value"), F.col("_metadata.file_path").alias("file_path"),
                    F.col("_metadata.file_block_start").alias("block_start"))
            .where(F.col("block_start") == 0)
            .withColumn("_row", F.monotonically_increasing_id()))
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("_row"))
    first = rows.withColumn("_nth", nth).where(F.col("_nth") <= lines)
    return first.groupBy("file_path").agg(
        F.min_by("value", "_nth").alias("first_line"),
        F.sort_array(F.collect_list(F.struct("_nth", "value"))).alias("_lines")).select(
            "file_path", "first_line",
            F.substring(F.array_join(F.transform("_lines", lambda x: x["value"]), "\n"), 1, chars).alias("prefix"))


def check_landed_files(spark: SparkSession, path: str | list[str], expected_columns: list[str] | None = None,
                       strict: bool = False) -> DataFrame:
    """S4 at file level: per landed file, whether it is a web page and
    whether its header carries the expected columns; ``accepted`` marks the
    files to ingest, the rest form the rejected set.

    A file is a web page if either rule of ``is_html_payload`` says so of its
    prefix (with ``strict`` the narrower rule alone): markup after blank lines,
    or ``<html>`` in the first 100 characters behind a comment.
    """
    fl = file_prefixes(spark, path)
    html = is_html_payload("prefix", strict=True)
    if not strict:
        html = html | is_html_payload("prefix") | F.lower(F.substring("prefix", 1, 100)).contains("<html")
    out = fl.withColumn("is_html", html)
    if expected_columns:
        header = F.split(F.regexp_replace("first_line", '"', ""), ",")
        need = F.array(*[F.lit(c) for c in expected_columns])
        out = out.withColumn("header_ok", F.size(F.array_except(need, header)) == 0)
    else:
        out = out.withColumn("header_ok", F.lit(True))
    return out.withColumn("accepted", ~F.col("is_html") & F.col("header_ok")).drop("prefix")


def land_extracts(raw: DataFrame, out_path: str, year: int, state: str, county: str | None = None) -> str:
    """S3: land a raw extract as Parquet partitioned by year / state / label.

    The county label follows the extract naming rule: the county code, or
    'big4' when several counties were requested, or 'all' for a whole state.
    Partitioned layout makes later reads prune by year, state and extract.
    Landing an extract again replaces that extract and no other.
    """
    label = "all" if not county else ("big4" if "," in county else county)
    (raw.withColumn("extract_year", F.lit(int(year)))
        .withColumn("extract_state", F.lit(state))
        .withColumn("extract_counties", F.lit(label))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("extract_year", "extract_state", "extract_counties")
        .parquet(out_path))
    return label


def rows_per_county(df: DataFrame, county: str = "county_code") -> DataFrame:
    """Rows per county, largest first, NULL counties left out."""
    return (df.where(F.col(county).isNotNull()).groupBy(county).count()
            .orderBy(F.col("count").desc(), F.col(county)))
