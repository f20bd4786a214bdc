"""History files and running counts, layouts by month, query windows, sketches."""
import datetime as dt
import random

from pyspark.sql import functions as F

from mktlens.operators import ingest as I
from mktlens.operators import sketches as SK
from mktlens.sources import readers as RD


def test_headers_are_read_in_one_job_and_files_united(spark, tmp_path):
    heads = {"a b.csv": "Date,Ticker,Close", "b.csv": '﻿Ticker,"Da te",Close', "c.csv": "Date,Ticker,Close"}
    for i, (name, head) in enumerate(heads.items()):
        (tmp_path / name).write_text(f"{head}\nx{i},y{i},{i}\n")
    paths = [str(tmp_path / n) for n in heads]
    more = [str(tmp_path / f"more{i}.csv") for i in range(20)]
    for p in more:
        open(p, "w").write("Date,Close\n")
    jobs = []
    for own in (paths + more, paths):
        spark.sparkContext.setJobGroup(f"headers {len(own)}", "headers")
        found = RD.csv_headers(spark, own)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers {len(own)}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]  # whatever the number of files
    assert sorted((c, len(f)) for c, f in found) == [(["Date", "Ticker", "Close"], 2), (["Ticker", "Da te", "Close"], 1)]
    rows = {(r.Ticker, r.Date, r["Da te"], r.Close) for r in RD.read_history_files(spark, paths).collect()}
    assert rows == {("y0", "x0", None, "0"), ("x1", None, "y1", "1"), ("y2", "x2", None, "2")}


def test_running_distinct(spark):
    rng = random.Random(4)
    rows = [(f"f{rng.randrange(6)}", rng.choice(["A", "B", "C", "D", "E", "F", None])) for _ in range(60)] + [("f9", None), ("f8", "Z"), ("f8", "Z")]
    got = [tuple(r) for r in I.running_distinct(spark.createDataFrame(rows, "file string, t string"), "file", "t").orderBy("file").collect()]
    seen, want = set(), []
    for f in sorted({f for f, _ in rows}):
        own = {t for g, t in rows if g == f and t} - seen
        seen |= own
        want.append((f, sum(g == f for g, _ in rows), len(own), len(seen)))
    assert got == want


def test_recent_rows_are_read_from_their_months_only(spark, tmp_path):
    day = F.date_add(F.lit("2023-11-10").cast("date"), (F.col("id") % 300).cast("int"))
    df = spark.range(3000).select(F.concat(F.lit("T"), F.col("id") % 40).alias("ticker"), F.when(F.col("id") % 100 != 7, day).alias("date"), F.col("id").cast("double").alias("close"))
    path = str(tmp_path / "t")
    RD.write_by_period(df, path, rows_per_file=400)
    files = spark.read.parquet(path).select("_metadata.file_path").distinct().count()
    assert files <= 11 + 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 3000 // 400  # not tasks x tickers
    recent = RD.read_periods(spark, path, "2024-02-20", "2024-04-05")
    want = df.where("date between '2024-02-20' and '2024-04-05'")
    assert sorted(map(tuple, recent.collect())) == sorted(map(tuple, want.collect()))
    plan = recent._jdf.queryExecution().executedPlan()
    read = {r.file_path.split(f"{RD.PERIOD}=")[1][:7] for r in recent.select("_metadata.file_path").distinct().collect()}
    assert read == {"2024-02", "2024-03", "2024-04"} and "PartitionFilters: [isnotnull" in plan.toString()
    assert sorted(map(str, RD.read_periods(spark, path).collect())) == sorted(map(str, df.collect()))


def test_query_windows_and_items_against_lists(spark):
    rng = random.Random(9)
    start, end, days, cap = dt.date(2024, 1, 1), dt.date(2024, 1, 24), 5, 2
    terms = [("A", "Oil"), ("A", "gas"), ("B", "oil"), ("B", ""), ("A", "Oil"), ("C", None), (None, "oil")]
    news = [(i, rng.choice(["A", "A", "A", "B", "C", None]), start + dt.timedelta(days=rng.randrange(-3, 28)) if rng.random() < 0.95 else None,
             rng.randrange(5), rng.choice(["OIL up", "gas, oil", "Gas", "tea", "", None])) for i in range(300)]
    n = spark.createDataFrame(news, "doc_id long, ticker string, date date, seen_datetime int, title string")
    t = spark.createDataFrame(terms, "ticker string, term string")
    got = {(r.ticker, r.window_start, r.window_end, r.doc_id, tuple(r.terms), r.title) for r in I.window_items(n, t, str(start), str(end), days, cap, F.col("title")).collect()}
    found = {}
    for ticker, term in {(a, b) for a, b in terms if a and b}:
        for k in range(0, (end - start).days + 1, days):
            lo, hi = start + dt.timedelta(days=k), min(start + dt.timedelta(days=k + days - 1), end)
            own = sorted(((-s, i) for i, a, d, s, x in news if a == ticker and d and lo <= d <= hi and x and term.lower() in x.lower()))[:cap]
            for _, i in own:
                found.setdefault((ticker, lo, hi, i), set()).add(term)
    assert got == {(*k, tuple(sorted(v)), news[k[3]][4]) for k, v in found.items()}
    windows = I.query_windows(t.where("term is not null"), str(start), str(end), days).where("ticker = 'B' and term = 'oil'").orderBy("window_start").collect()
    assert [(r.window_start.day, r.window_end.day) for r in windows] == [(1, 5), (6, 10), (11, 15), (16, 20), (21, 24)]


def test_united_sketches_equal_one_pass(spark):
    df = spark.range(40_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 11 != 0, F.col("id") % 9000).alias("v"))
    kept = SK.sketches(df, ["day"], "v")
    once = SK.counts(df.agg(F.hll_sketch_agg("v", SK.LOG_REGISTERS).alias("sketch"))).first().n_distinct
    steps = SK.united(kept.where("day < 3")).unionByName(SK.united(kept.where("day >= 3")))
    assert SK.counts(SK.united(kept)).first().n_distinct == once == SK.counts(SK.united(steps)).first().n_distinct
    assert abs(once - 9000) <= 4 * SK.error() * 9000
    nulls = SK.counts(SK.sketches(df.where("v is null"), ["day"], "v")).collect()
    assert nulls and all(r.n_distinct == 0 for r in nulls)
    assert SK.counts(SK.united(kept.limit(0))).first().n_distinct == 0
