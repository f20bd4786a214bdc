"""Ingestion-side operators (S10-S13, S15, S16, S18): appends above a
high-water mark, ticker batching, the news-source catalogue, the news query
plan, running key counts and the rolling quick-train window.  All are joins / group-bys on the
given tables; nothing is iterated on the driver."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mktlens.operators.prefix import ordered_prefix_sums


def append_new_rows(existing: DataFrame, incoming: DataFrame, key: str = "ticker", date: str = "date", per_key: bool = False) -> DataFrame:
    """Existing ∪ incoming rows from the table's last date + 1 day on.  With
    ``per_key`` each key has a mark of its own (keys new to the table start after
    the table's)."""
    if not per_key:
        mark = existing.agg(F.max(date).alias("_hw"))  # one row
        new = incoming.join(F.broadcast(mark), F.col(date) >= F.date_add("_hw", 1)).drop("_hw")
        return existing.unionByName(new)
    hw = existing.groupBy(key).agg(F.max(date).alias("_hw"))
    ghw = existing.agg(F.max(date).alias("_ghw"))  # one row
    known = incoming.join(hw, key).where(F.col(date) >= F.date_add("_hw", 1)).drop("_hw")
    fresh = incoming.join(hw, key, "left_anti").crossJoin(F.broadcast(ghw)).where(F.col(date) >= F.date_add("_ghw", 1)).drop("_ghw")
    return existing.unionByName(known).unionByName(fresh)


def ticker_batches(df: DataFrame, size: int = 500, from_chunk: int = 0, key: str = "ticker") -> DataFrame:
    """Sorted distinct keys cut into chunks of ``size`` (positions come
    from a distributed prefix count), resumed from ``from_chunk``."""
    t = df.select(key).distinct().withColumn("_one", F.lit(1))
    pos = ordered_prefix_sums(t, [key], ["_one"])
    out = pos.select(key, F.floor(F.col("_one_before") / size).cast("int").alias("batch"))
    return out.where(F.col("batch") >= from_chunk)


def source_catalogue(docs: DataFrame) -> DataFrame:
    """S15 catalogue (id, name, url, language, tags) derived from documents:
    language = most frequent, tags = the sorted languages seen."""
    g = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("cnt"))
    c = g.groupBy("source").agg(
        F.max_by("lang", F.struct("cnt", "lang")).alias("language"), F.array_sort(F.collect_list("lang")).alias("tags")
    )
    return c.select(
        F.col("source").alias("id"),
        F.concat(F.lit("Source "), F.col("source")).alias("name"),
        F.concat(F.lit("feed://"), F.col("source")).alias("url"),
        "language",
        "tags",
    )


def filter_sources(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    """S15 filter by requested ids (semi-join)."""
    return catalogue.join(ids, "id", "left_semi")


def query_windows(terms: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """S16 plan: [start, end] split into ``days``-long windows for every (ticker, term)."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    w = terms.select("ticker", "term", F.explode(F.sequence(s, e, F.expr(f"INTERVAL {days} DAYS"))).alias("window_start"))
    return w.withColumn("window_end", F.least(F.date_add("window_start", days - 1), e))


def window_items(news: DataFrame, terms: DataFrame, start: str, end: str, days: int, cap: int, text: Column, item: str = "doc_id") -> DataFrame:
    """What the query plan finds, one row per (ticker, window, item).

    An item of a ticker answers a term that its lower-cased ``text`` contains; it falls
    in a window by arithmetic (no range join).  Of each (ticker, term, window) the
    newest ``cap`` items are kept (ties by ``item``): row numbers up to a limit, which
    Spark takes task by task before the shuffle, so a hot ticker sends ``cap`` rows a
    task.  Then the terms are united: an item that several terms found is one row, with
    the sorted terms.  Null tickers, terms, dates and texts find nothing.
    """
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    n = news.where(F.col("date").between(s, e)).withColumn("_text", F.lower(text))
    n = n.withColumn("window_start", F.date_add(s, (F.floor(F.datediff("date", s) / days) * days).cast("int")))
    asked = terms.select("ticker", "term").where(F.col("term") != "").distinct()
    hits = n.join(asked, "ticker").where(F.contains("_text", F.lower("term")))
    w = Window.partitionBy("ticker", "term", "window_start").orderBy(F.col("seen_datetime").desc(), item)
    kept = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
    others = [c for c in news.columns if c not in ("ticker", item)]
    # all rows of an item and ticker are alike but for the term
    one = kept.groupBy("ticker", "window_start", item).agg(F.array_sort(F.collect_set("term")).alias("terms"), F.min(F.struct(*others)).alias("_row"))
    return one.select("ticker", "window_start", F.least(F.date_add("window_start", days - 1), e).alias("window_end"), item, "terms", "_row.*")


def running_distinct(files: DataFrame, file: str, key: str) -> DataFrame:
    """(file, n_rows, new, so_far): rows of each file, keys that no earlier file
    (by name) has, and distinct keys so far.  A key's first file is a map-side minimum;
    the running sum goes over one row per file.  Null keys do not count."""
    rows = files.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"))
    first = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(file).alias(file))
    new = first.groupBy(file).agg(F.count(F.lit(1)).alias("new"))
    # as many rows as files, which the driver has listed
    upto = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(new, file, "left").withColumn("new", F.coalesce("new", F.lit(0))).withColumn("so_far", F.sum("new").over(upto)).select(file, "n_rows", "new", "so_far")


def last_days(df: DataFrame, as_of: Column, days: int, date: str = "date") -> DataFrame:
    """Rows dated within the last ``days`` days before ``as_of``."""
    return df.where(F.col(date).between(F.date_sub(as_of, days), as_of))
