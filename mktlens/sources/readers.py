"""Readers and conformers at the boundary.

Explicit schemas replace the reference's column probing: one ``conform_*``
step picks the first existing column of a list (P2, decided on the driver from
the schema), coerces leniently (P3, ``try_cast``; T26) and parses timestamps
(P1, ``try_to_timestamp``; time-zone suffixes are dropped by the parse).
"""
from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The folder column of tables written by month.
PERIOD = "stored_month"
S, TS = T.StringType(), T.TimestampNTZType()
NEWS_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("ticker", S), ("seen_datetime", TS), ("date", TS), ("title", S), ("full_text", S), ("url", S), ("language", S), ("source", S)]])
FEED_SCHEMA = T.StructType([T.StructField(n, S) for n in ("published_at", "title", "summary", "link", "source_name", "language")])
SOURCES_SCHEMA = T.StructType([T.StructField(n, S) for n in ("id", "name", "url", "language")]
                              + [T.StructField("tags", T.ArrayType(S))])


def pick(df: DataFrame, *names: str) -> Column | None:
    """The first existing column of ``names`` (driver-side schema check)."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return None


def lenient_double(c: Column | None, df: DataFrame | None = None) -> Column:
    """Numeric or parsable text -> double, anything else -> NULL."""
    if c is None:
        return F.lit(None).cast("double")
    return c.cast("string").try_cast("double")


def parse_ts(c: Column) -> Column:
    """Lenient timestamp parse, zone dropped (wall clock kept)."""
    s = F.regexp_replace(c.cast("string"), r"(Z|[+-]\d\d:?\d\d)$", "")
    return F.try_to_timestamp(s).cast("timestamp_ntz")


def parse_ts_utc(c: Column) -> Column:
    """Lenient timestamp parse, shifted to UTC by its offset before the zone is
    dropped (no suffix: taken as UTC)."""
    s = c.cast("string")
    suffix = F.regexp_extract(s, r"(Z|[+-]\d\d:?\d\d)$", 1)
    sign = F.when(suffix.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(suffix, r"[^0-9]", "")
    minutes = F.when(F.length(digits) == 4, sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int"))).otherwise(0)
    return F.timestamp_add("MINUTE", -minutes, parse_ts(c))


def conform_prices(df: DataFrame) -> DataFrame:
    """Accept Close/close and Volume/volume, parse date, coerce numbers.
    Rows lacking close or volume are kept here and dropped by the window
    operators *before* any lag (T7)."""
    close = pick(df, "Close", "close")
    volume = pick(df, "Volume", "volume")
    date_dt = dict(df.dtypes).get("date")
    date = F.col("date") if date_dt in ("date", "timestamp_ntz") else parse_ts(F.col("date"))
    extra = [c for c in ("open", "high", "low", "Open", "High", "Low") if c in df.columns]
    return df.select(
        F.col("ticker").cast("string").alias("ticker"),
        date.alias("date"),
        lenient_double(close).alias("close"),
        lenient_double(volume).alias("volume"),
        *[lenient_double(F.col(c)).alias(c.lower()) for c in extra],
    ).where(F.col("ticker").isNotNull())  # T31: null tickers never reach the output


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return conform_prices(spark.read.option("header", True).csv(path))
    return conform_prices(spark.read.format(fmt).load(path))


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Feature table with a parsed date; rows with a bad date dropped.  CSV
    columns get the feature table's types (whole numbers for the flag and the
    counts, text for ticker, date and languages); no extra pass to infer them."""
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
        whole = {"target_direction": "int", "news_count": "bigint", "languages_count": "bigint"}
        df = df.select(*[F.col(c) if c in ("ticker", "date", "languages") else F.col(c).try_cast(whole.get(c, "double")).alias(c) for c in df.columns])
    else:
        df = spark.read.format(fmt).load(path)
    d = df.schema["date"].dataType
    date = F.col("date") if isinstance(d, (T.DateType, T.TimestampNTZType, T.TimestampType)) else parse_ts(F.col("date"))
    return df.withColumn("date", date).where(F.col("date").isNotNull())


def conform_news(df: DataFrame) -> DataFrame:
    """S3 body: parse date, and seen_datetime shifted to UTC, drop rows with a bad
    date, add absent standard columns as NULL."""
    out = df
    if "date" in out.columns:
        out = out.withColumn("date", parse_ts(F.col("date"))).where(F.col("date").isNotNull())
    if "seen_datetime" in out.columns:
        out = out.withColumn("seen_datetime", parse_ts_utc(F.col("seen_datetime")))
    for f in NEWS_SCHEMA.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out


def read_news(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: a missing file gives an empty frame with the fixed schema; any other
    problem (no permission, nothing readable in it) is raised."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], NEWS_SCHEMA)
    return conform_news(df)


def conform_feed(df: DataFrame) -> DataFrame:
    """S4 body: parse published_at (zone dropped), drop rows without it,
    blank-fill title and summary."""
    out = df.withColumn("published_at", parse_ts(F.col("published_at"))).where(F.col("published_at").isNotNull())
    return out.withColumn("title", F.coalesce(F.col("title"), F.lit(""))).withColumn(
        "summary", F.coalesce(F.col("summary"), F.lit(""))
    )


def read_feed(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON-lines feed with a fixed schema (batch or stream)."""
    reader = spark.readStream if streaming else spark.read
    return conform_feed(reader.schema(FEED_SCHEMA).json(path))


def csv_headers(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for every different header: the first line of every file,
    read in one job."""
    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    head = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "at").alias("line"))
    # one row per header: files are listed on the driver in any case
    found = head.groupBy("line").agg(F.array_sort(F.collect_list("file_path")).alias("files")).collect()
    return [(next(csv.reader([line.removeprefix("\ufeff")])), files) for line, files in sorted(found)]


def read_history_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Many history CSV files united by column name, with the source file
    name.  Files of one header are one scan; a column that a file lacks is NULL."""
    out = None
    for names, own in csv_headers(spark, paths):
        schema = T.StructType([T.StructField(n, S) for n in names])
        part = spark.read.option("header", True).schema(schema).csv([unquote(f) for f in own]).withColumn("source_file", F.input_file_name())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_by_period(df: DataFrame, path: str, date: str = "date", keys: tuple[str, ...] = ("ticker",), rows_per_file: int = 5_000_000, mode: str = "overwrite") -> None:
    """A table in folders by month, rows ranged by (date, keys) first: a task holds
    a stretch of time, so it writes few files (at most one a month it touches, and
    rows_per_file rows), not tasks x keys of them; a hot key or month is dealt to
    several tasks.  Rows without a date are a folder of their own."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn(PERIOD, F.date_format(date, "yyyy-MM")).repartitionByRange(parts, F.col(date).asc_nulls_first(), *keys)
    ranged.sortWithinPartitions(PERIOD, *keys, date).write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(PERIOD).parquet(path)


def read_periods(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, date: str = "date", schema: T.StructType | None = None) -> DataFrame:
    """A table of ``write_by_period``, its rows from ``since`` to ``until``: only the
    folders of these months are read."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(PERIOD, S)]))
    df = reader.parquet(path)
    for bound, op in ((since, "__ge__"), (until, "__le__")):
        if bound is not None:
            day = F.lit(bound).cast("date")
            df = df.where(getattr(F.col(PERIOD), op)(F.date_format(day, "yyyy-MM")) & getattr(F.to_date(date), op)(day))
    return df.drop(PERIOD)


def read_ucr(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated series, column 0 = label, the rest = values."""
    raw = spark.read.option("sep", "\t").option("inferSchema", False).csv(path)
    cols = raw.columns
    return raw.select(
        F.col(cols[0]).cast("double").cast("int").alias("label"),
        F.array(*[F.col(c).cast("double") for c in cols[1:]]).alias("values"),
    )


def wide_to_long(df: DataFrame, id_col: str, tickers: list[str], fields: list[str], sep: str = "|") -> DataFrame:
    """(date, <ticker>|<field> columns) -> long (date, ticker, field...)."""
    value_cols = [f"{t}{sep}{f}" for t in tickers for f in fields if f"{t}{sep}{f}" in df.columns]
    long = df.unpivot([id_col], value_cols, "key", "value")
    parts = F.split("key", re.escape(sep), 2)
    long = long.select(id_col, parts[0].alias("ticker"), parts[1].alias("field"), "value")
    return long.groupBy(id_col, "ticker").pivot("field", fields).agg(F.first("value"))
