"""Queries: recency / newest-k, summaries, signals and the advisory report
(P9, P13-P15, P22, O2-O5, F9-F11, F13, F18, A6, U1, U2, U4, X5, X6)."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from mktlens.config import ModelConfig
from mktlens.functions import text as TX
from mktlens.operators import bars as B
from mktlens.operators import features as X
from mktlens.operators import models as MD
from mktlens.operators import news as N
from mktlens.operators import report as R
from mktlens.operators import scoring as SC
from mktlens.plans.q_features import annotated_news
from mktlens.plans.registry import register, with_ctes
from mktlens.plans.sqlparts import feature_matrix_sql, news_aggregates_sql, price_features_sql, strip_sql
from mktlens.sources import fixtures as fx

AS_OF = "1996-10-01"
NEWS_DAYS = 60
PRICE_DAYS = 180
MC = ModelConfig()

NEWS_WINDOW_SQL = f"""nw AS (SELECT * FROM annotated
  WHERE date >= DATE '{AS_OF}' - {NEWS_DAYS} AND date <= DATE '{AS_OF}')"""
NEWEST_SQL = "row_number() OVER (PARTITION BY ticker ORDER BY seen_datetime DESC NULLS LAST, url ASC NULLS LAST, title ASC NULLS LAST)"


def news_window(spark, sf_dir):
    n = annotated_news(spark, sf_dir)
    as_of = F.lit(AS_OF).cast("date")
    return n.where((F.col("date") >= F.date_sub(as_of, NEWS_DAYS)) & (F.col("date") <= as_of))


# ---------------------------------------------------------------- P9
@register("P9_recency_filter", sql=with_ctes(fx.NEWS_SQL, body=f"""SELECT doc_id, ticker, date FROM news
WHERE CAST(date AS TIMESTAMP) >= TIMESTAMP '{AS_OF}' - INTERVAL {NEWS_DAYS} DAY"""))
def p9_recency_filter(spark, sf_dir):
    """Rows with date >= as_of - 60 days (explicit as_of)."""
    n = fx.news(spark, sf_dir)
    return N.recent(n, F.lit(AS_OF).cast("timestamp"), NEWS_DAYS, "date").select("doc_id", "ticker", "date")


# ---------------------------------------------------------------- O2 / O3 / O4 / O5
@register("O2_recent_news", sql=with_ctes(fx.NEWS_SQL, fx.ANNOTATED_SQL, f"""r AS (
  SELECT ticker, title, url, sentiment_score, source, language, date, {NEWEST_SQL} AS rn
  FROM annotated WHERE CAST(date AS TIMESTAMP) >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)""",
    body="""SELECT ticker, CAST(rn AS INTEGER) AS rank, strftime(date, '%Y-%m-%d') AS date, title, url,
  sentiment_score AS sentiment, source, language FROM r WHERE rn <= 5"""), dbl=("sentiment",))
def o2_recent_news(spark, sf_dir):
    """Per ticker, news of the last 30 days before as_of, newest 5."""
    n = N.recent(annotated_news(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), 30, "date")
    top = N.newest_k(n, 5)
    return top.select("ticker", F.col("_rn").alias("rank"), TX.iso_date("date").alias("date"), "title", "url",
                      F.col("sentiment_score").alias("sentiment"), "source", "language")


@register("O3_highlights", sql=with_ctes(fx.NEWS_SQL, fx.ANNOTATED_SQL, NEWS_WINDOW_SQL, body=f"""SELECT ticker, CAST(rn AS INTEGER) AS rank,
  coalesce(strftime(date, '%Y-%m-%d'), '') AS date, coalesce(title, '') AS title, coalesce(url, '') AS url,
  coalesce(source, language, '') AS source, coalesce(sentiment_score, 0.0) AS sentiment
FROM (SELECT *, {NEWEST_SQL} AS rn FROM nw) WHERE rn <= 5"""), dbl=("sentiment",))
def o3_highlights(spark, sf_dir):
    """Newest 5 items per ticker as records (source falls back to language)."""
    h = N.highlights(news_window(spark, sf_dir), 5)
    e = h.select("ticker", F.explode("highlights").alias("h"))
    return e.select("ticker", F.col("h.rank").alias("rank"), F.col("h.date").alias("date"), F.col("h.title").alias("title"),
                    F.col("h.url").alias("url"), F.col("h.source").alias("source"), F.col("h.sentiment").alias("sentiment"))


DOCS_SQL = f"""docs AS (
  SELECT ticker, list(doc ORDER BY rn) AS docs FROM (
    SELECT ticker, coalesce(title, '') || '. ' || coalesce(full_text, '') AS doc, {NEWEST_SQL} AS rn FROM nw)
  WHERE rn <= 12 GROUP BY ticker)"""


def _joined_sql(docs: str) -> str:
    return f"substr(array_to_string(list_filter(list_transform({docs}, lambda d: {strip_sql('d')}), lambda d: d IS NOT NULL AND d <> ''), ' '), 1, 6000)"


def _summary_sql(text: str) -> str:
    parts = f"list_filter(list_transform(string_split(replace({text}, chr(10), ' '), '.'), lambda x: {strip_sql('x')}), lambda x: x <> '')"
    return (f"CASE WHEN len({parts}) = 0 THEN '{TX.SUMMARY_NO_SENTENCES}' "
            f"ELSE array_to_string({parts}[1:{TX.SUMMARY_SENTENCES}], '. ') || '.' END")


def _summarise_docs_sql(docs: str) -> str:
    j = _joined_sql(docs)
    return f"CASE WHEN coalesce({j}, '') = '' THEN '{TX.SUMMARY_EMPTY_INPUT}' ELSE {_summary_sql(j)} END"


@register("O4_summary_docs", sql=with_ctes(fx.NEWS_SQL, fx.ANNOTATED_SQL, NEWS_WINDOW_SQL, DOCS_SQL, body="SELECT ticker, docs FROM docs"))
def o4_summary_docs(spark, sf_dir):
    """Newest 12 documents per ticker as 'title. body', newest first."""
    return N.summary_docs(news_window(spark, sf_dir), 12)


@register("F10_join_docs", sql=with_ctes(fx.NEWS_SQL, fx.ANNOTATED_SQL, NEWS_WINDOW_SQL, DOCS_SQL,
                                         body=f"SELECT ticker, {_joined_sql('docs')} AS joined FROM docs"))
def f10_join_docs(spark, sf_dir):
    """Newest documents joined by a space, blanks dropped, cut to 6000 characters."""
    d = N.summary_docs(news_window(spark, sf_dir), 12)
    return d.select("ticker", TX.join_docs("docs").alias("joined"))


@register("F9_extractive_summary", sql=with_ctes(body=f"SELECT doc_id, {_summary_sql('text')} AS summary FROM documents"))
def f9_extractive_summary(spark, sf_dir):
    """First three sentences of each whole document."""
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.extractive_summary("text").alias("summary"))


@register("F11_doc_text", sql=with_ctes(fx.NEWS_SQL, body="SELECT doc_id, coalesce(title, '') || '. ' || coalesce(full_text, '') AS doc FROM news"))
def f11_doc_text(spark, sf_dir):
    """Document text 'title. body'."""
    n = fx.news(spark, sf_dir)
    return n.select("doc_id", TX.doc_text("title", "full_text").alias("doc"))


@register("F18_iso_date", sql=with_ctes(fx.NEWS_SQL, body="""SELECT doc_id, coalesce(strftime(date, '%Y-%m-%d'), '') AS date_text,
  coalesce(strftime(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE date END, '%Y-%m-%d'), '') AS date_or_blank FROM news"""))
def f18_iso_date(spark, sf_dir):
    """Date as yyyy-MM-dd, blank when missing."""
    n = fx.news(spark, sf_dir)
    d2 = F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("date")).otherwise(F.col("date"))
    return n.select("doc_id", TX.iso_date("date").alias("date_text"), TX.iso_date(d2).alias("date_or_blank"))


@register("O5_latest_row", sql=with_ctes(fx.BARS_SQL, body="""SELECT ticker, date, close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rk FROM bars) WHERE rk = 1"""), dbl=("close", "volume"))
def o5_latest_row(spark, sf_dir):
    """Latest row per ticker (max_by over a struct, no sort of the series)."""
    b = fx.bars(spark, sf_dir)
    latest = b.groupBy("ticker").agg(F.max_by(F.struct("date", "close", "volume"), "date").alias("r"))
    return latest.select("ticker", "r.date", "r.close", "r.volume")


# ---------------------------------------------------------------- A6
@register("A6_overall_sentiment", sql=with_ctes(fx.NEWS_SQL, fx.ANNOTATED_SQL, NEWS_WINDOW_SQL, body="""SELECT ticker,
  avg(sentiment_score) AS sentiment_mean, count(*) AS news_count FROM nw GROUP BY ticker"""), dbl=("sentiment_mean",))
def a6_overall_sentiment(spark, sf_dir):
    """Mean sentiment and article count per company over the news window."""
    return N.overall_sentiment(news_window(spark, sf_dir))


# ---------------------------------------------------------------- P13 / P14 / P22 / P15
SIGNAL_SQL = f"""CASE WHEN p IS NULL THEN NULL WHEN p >= {MC.up_threshold} THEN '{R.LABEL_UP}'
  WHEN p <= {MC.down_threshold} THEN '{R.LABEL_DOWN}' WHEN abs(p - 0.5) <= {MC.band} THEN '{R.LABEL_NEUTRAL}'
  ELSE '{R.LABEL_UNDETERMINED}' END"""


@register("P13_signal_band", sql=with_ctes(fx.SCORES_SQL, body=f"SELECT l_orderkey, l_linenumber, {SIGNAL_SQL} AS signal FROM scores"))
def p13_signal_band(spark, sf_dir):
    """Four-way signal: rise / fall / neutral / undetermined (thresholds 0.6, 0.4, band 0.05)."""
    s = fx.scores(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", R.signal_band("p", MC).alias("signal"))


@register("P14_threshold_clamp", sql=with_ctes(fx.SCORES_SQL, body="""SELECT DISTINCT p,
  least(greatest(p * 1.2, 0.5), 0.95) AS up_threshold, greatest(0.0, 1 - least(greatest(p * 1.2, 0.5), 0.95)) AS down_threshold,
  greatest(0.0, least(p / 2, 0.2)) AS neutral_band, CAST(greatest(7, CAST(floor(p * 100) AS INTEGER) - 20) AS INTEGER) AS news_window_days
FROM scores"""), dbl=("p", "up_threshold", "down_threshold", "neutral_band"))
def p14_threshold_clamp(spark, sf_dir):
    """Clamped thresholds per configuration row derived from the scores."""
    s = fx.scores(spark, sf_dir).select("p").distinct()
    cols = R.clamp_thresholds(F.col("p") * 1.2, F.col("p") / 2, F.floor(F.col("p") * 100).cast("int") - 20)
    return s.select("p", *cols)


@register("P22_direction_2way", sql=with_ctes(fx.SCORES_SQL, body="""SELECT l_orderkey, l_linenumber,
  CASE WHEN p >= 0.5 THEN 'up' ELSE 'down' END AS direction FROM scores"""))
def p22_direction_2way(spark, sf_dir):
    """Two-way direction at 0.5."""
    s = fx.scores(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", R.direction_2way("p").alias("direction"))


def _fmt_sql(x: str, kind: str) -> str:
    x = f"({x})"
    if kind == "pct0":
        return f"printf('%.0f%%', floor({x} * 100 * 1.0 + 0.5) / 1.0)"
    if kind == "pct1":
        return f"printf('%.1f%%', floor({x} * 100 * 10.0 + 0.5) / 10.0)"
    if kind == "spct1":
        return f"printf('%+.1f%%', floor({x} * 100 * 10.0 + 0.5) / 10.0)"
    if kind == "s2":
        return f"printf('%+.2f', floor({x} * 100.0 + 0.5) / 100.0)"
    if kind == "k2":
        return f"printf('%,.2f', floor({x} * 100.0 + 0.5) / 100.0)"
    raise ValueError(kind)


def _fill_sql(template: str, key: str, value: str) -> str:
    a, b = template.split("{" + key + "}")
    return f"'{a}' || {value} || '{b}'"


def explanation_sql(p: str, c: str, s: str) -> str:
    rp = (f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} >= {R.EXPLAIN_HIGH_CUT} THEN {_fill_sql(R.EXPLAIN_HIGH, 'p', _fmt_sql(p, 'pct0'))} "
          f"WHEN {p} <= {R.EXPLAIN_LOW_CUT} THEN {_fill_sql(R.EXPLAIN_LOW, 'p', _fmt_sql(p, 'pct0'))} "
          f"ELSE {_fill_sql(R.EXPLAIN_MID, 'p', _fmt_sql(p, 'pct0'))} END")
    rc = (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} >= 0 THEN {_fill_sql(R.EXPLAIN_PRICE_UP, 'c', _fmt_sql(c, 'pct1'))} "
          f"ELSE {_fill_sql(R.EXPLAIN_PRICE_DOWN, 'c', _fmt_sql(c, 'pct1'))} END")
    rs = (f"CASE WHEN {s} IS NULL THEN NULL WHEN {s} > {R.EXPLAIN_NEWS_CUT} THEN {_fill_sql(R.EXPLAIN_NEWS_POS, 's', _fmt_sql(s, 's2'))} "
          f"WHEN {s} < -{R.EXPLAIN_NEWS_CUT} THEN {_fill_sql(R.EXPLAIN_NEWS_NEG, 's', _fmt_sql(s, 's2'))} "
          f"ELSE '{R.EXPLAIN_NEWS_NEUTRAL}' END")
    t = f"concat_ws(' ', {rp}, {rc}, {rs})"
    return f"CASE WHEN {t} = '' THEN '{R.EXPLAIN_NO_DATA}' ELSE {t} END"


@register("P15_explanation", sql=with_ctes(fx.SCORES_SQL, body=f"""SELECT l_orderkey, l_linenumber,
  {explanation_sql('p', 'c', 's')} AS explanation
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE p END AS p,
             CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE p - 0.5 END AS c,
             CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE (y - 1) * p * 0.2 END AS s FROM scores)"""))
def p15_explanation(spark, sf_dir):
    """Rule-based explanation text from probability, 30-day change and sentiment."""
    s = fx.scores(spark, sf_dir)
    p = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).otherwise(F.col("p"))
    c = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("p") - 0.5)
    sm = F.when(F.col("l_linenumber") % 2 == 0, F.lit(None).cast("double")).otherwise((F.col("y") - 1) * F.col("p") * 0.2)
    return s.select("l_orderkey", "l_linenumber", R.explanation(p, c, sm).alias("explanation"))


# ---------------------------------------------------------------- X5 / X6
# The model that the report asks, as saved by tools/export_model.py.
SAVED_FOREST = SC.load(os.path.join(os.path.dirname(os.path.abspath(__file__)), "saved_forest.json"))
PRICE_WINDOW_SQL = f"""pw AS (SELECT * FROM bars WHERE ticker IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL
  AND date >= DATE '{AS_OF}' - {PRICE_DAYS} AND date < DATE '{AS_OF}' + 1),
{price_features_sql("pw")},
{news_aggregates_sql("nw")},
inference AS ({feature_matrix_sql(train=False)}),
prob AS (SELECT ticker AS symbol, {SC.probability_sql(SAVED_FOREST, "list_reduce([0E0, {0}], lambda a, x: a + x)")} AS p
         FROM inference QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
pm AS (SELECT ticker AS symbol, close AS latest_close, CASE WHEN base IS NOT NULL AND base <> 0 THEN close / base - 1 END AS price_change_30d
       FROM (SELECT ticker, close, lag(close, 21) OVER (PARTITION BY ticker ORDER BY date) AS base,
                    row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rk FROM pw) WHERE rk = 1),
sent AS (SELECT ticker AS symbol, avg(sentiment_score) AS sentiment_mean, count(*) AS news_count FROM nw GROUP BY ticker),
comp AS (SELECT DISTINCT ticker AS symbol, ticker AS company FROM bars),
rep AS (
  SELECT c.symbol, c.company, p AS probability_up, {SIGNAL_SQL} AS direction,
         pm.latest_close, pm.price_change_30d, s.sentiment_mean, coalesce(s.news_count, 0) AS news_count,
         {_summarise_docs_sql('coalesce(d.docs, CAST([] AS VARCHAR[]))')} AS summary,
         {explanation_sql('p', 'pm.price_change_30d', 's.sentiment_mean')} AS explanation
  FROM comp c LEFT JOIN prob USING (symbol) LEFT JOIN pm USING (symbol) LEFT JOIN sent s USING (symbol) LEFT JOIN docs d ON d.ticker = c.symbol)"""

REPORT_CTES = (fx.BARS_SQL, fx.NEWS_SQL, fx.ANNOTATED_SQL, NEWS_WINDOW_SQL, DOCS_SQL, PRICE_WINDOW_SQL)


def _reports(spark, sf_dir):
    bars = fx.bars(spark, sf_dir)
    as_of = F.lit(AS_OF).cast("date")
    pw = bars.where((F.col("date") >= F.date_sub(as_of, PRICE_DAYS)) & (F.col("date") < F.date_add(as_of, 1)))
    nw = news_window(spark, sf_dir)
    feats = X.build_features_for_inference(pw, nw)
    comps = bars.select(F.col("ticker").alias("symbol"), F.col("ticker").alias("company")).distinct()
    probabilities = MD.score_latest(SAVED_FOREST, feats, X.MODEL_FEATURES, MC)
    return R.company_report(comps, feats, nw, probabilities, MC), nw


@register("X5_company_report", sql=with_ctes(*REPORT_CTES, body="SELECT * FROM rep"),
          dbl=("probability_up", "latest_close", "price_change_30d", "sentiment_mean"))
def x5_company_report(spark, sf_dir):
    """One advisory report row per company, with a saved forest's probability and signal."""
    return _reports(spark, sf_dir)[0]


def _bullets_sql() -> str:
    d, s, t, u = (strip_sql("coalesce(strftime(date, '%Y-%m-%d'), '')"), strip_sql("coalesce(source, language, '')"),
                  strip_sql("coalesce(title, '')"), strip_sql("coalesce(url, '')"))
    title = f"CASE WHEN {t} = '' THEN '{R.HIGHLIGHT_NO_TITLE}' ELSE {t} END"
    prefix = f"concat_ws(' | ', CASE WHEN {d} <> '' THEN {d} END, CASE WHEN {s} <> '' THEN {s} END)"
    bullet = f"CASE WHEN {prefix} <> '' THEN '- ' || {prefix} || ': ' || {title} ELSE '- ' || {title} END"
    tone = f"{_fill_sql(R.HIGHLIGHT_TONE, 's', _fmt_sql('coalesce(sentiment_score, 0.0)', 's2'))}"
    line = f"{bullet} || {tone} || CASE WHEN {u} <> '' THEN chr(10) || '  ' || {u} ELSE '' END"
    return f"""hl AS (SELECT ticker, list(line ORDER BY rn) AS lines FROM (
  SELECT ticker, rn, {line} AS line FROM (SELECT *, {NEWEST_SQL} AS rn FROM nw) WHERE rn <= 5) GROUP BY ticker)"""


def _header_sql() -> str:
    return (f"concat_ws(chr(10), '{R.HEADER_TITLE.split('{company}')[0]}' || company || ' (' || symbol || ')', "
            f"CASE WHEN probability_up IS NOT NULL THEN {_fill_sql(R.HEADER_PROB, 'p', _fmt_sql('probability_up', 'pct1'))} END, "
            f"CASE WHEN direction IS NOT NULL AND direction <> '' THEN {_fill_sql(R.HEADER_SIGNAL, 'd', 'direction')} END, "
            f"CASE WHEN latest_close IS NOT NULL THEN {_fill_sql(R.HEADER_CLOSE, 'c', _fmt_sql('latest_close', 'k2'))} END, "
            f"CASE WHEN price_change_30d IS NOT NULL THEN {_fill_sql(R.HEADER_CHANGE, 'c', _fmt_sql('price_change_30d', 'spct1'))} END, "
            f"CASE WHEN sentiment_mean IS NOT NULL THEN {_fill_sql(R.HEADER_TONE, 's', _fmt_sql('sentiment_mean', 's2'))} END, "
            f"{_fill_sql(R.HEADER_COUNT, 'n', 'CAST(news_count AS VARCHAR)')})")


X6_BODY = f"""SELECT symbol, list_filter([
    {_header_sql()},
    '{R.SUMMARY_HEAD.rstrip(chr(10))}' || chr(10) || CASE WHEN {strip_sql("coalesce(summary, '')")} = '' THEN '{R.SUMMARY_EMPTY}' ELSE {strip_sql("coalesce(summary, '')")} END,
    CASE WHEN {strip_sql("coalesce(explanation, '')")} <> '' THEN '{R.EXPLANATION_HEAD.rstrip(chr(10))}' || chr(10) || {strip_sql("coalesce(explanation, '')")} END,
    CASE WHEN len(coalesce(lines, CAST([] AS VARCHAR[]))) > 0 THEN '{R.HIGHLIGHTS_HEAD.rstrip(chr(10))}' || chr(10) || array_to_string(lines, chr(10)) END
  ], lambda m: m IS NOT NULL AND {strip_sql('m')} <> '') AS messages
FROM rep LEFT JOIN hl ON hl.ticker = rep.symbol"""


@register("X6_render_report", sql=with_ctes(*REPORT_CTES, _bullets_sql(), body=X6_BODY))
def x6_render_report(spark, sf_dir):
    """Report text blocks: metrics, summary, explanation, highlights."""
    rep, nw = _reports(spark, sf_dir)
    lines = R.highlight_lines(N.highlights(nw, 5))
    return R.render_report(rep, lines)


@register("F13_report_numbers", sql=with_ctes(fx.BARS_SQL, body=f"""SELECT ticker, date,
  {_fmt_sql('close', 'k2')} AS close_text, {_fmt_sql('close / 1000 - 1', 'spct1')} AS change_text,
  {_fmt_sql('close / 10000', 'pct1')} AS pct_text, {_fmt_sql('(close - 1000) / 1000', 's2')} AS signed_text FROM bars"""))
def f13_report_numbers(spark, sf_dir):
    """Report number formats: thousands '1,234.56', signed percent, percent, signed 2 decimals."""
    b = fx.bars(spark, sf_dir)
    c = F.col("close")
    return b.select("ticker", "date", R.fmt_thousands2(c).alias("close_text"), R.fmt_pct1(c / 1000 - 1, True).alias("change_text"),
                    R.fmt_pct1(c / 10000).alias("pct_text"), R.fmt_signed2((c - 1000) / 1000).alias("signed_text"))


# ---------------------------------------------------------------- U1 / U2 / U4
@register("U1_union_dedupe", sql=with_ctes(fx.NEWS_SQL, fx.ANNOTATED_SQL, """u AS (
  SELECT ticker, title, url, source, 0 AS src, doc_id FROM news WHERE doc_id % 2 = 0
  UNION ALL SELECT ticker, title, url, source, 1 AS src, doc_id FROM news WHERE doc_id % 3 = 0)""",
    body="""SELECT ticker, title, url, source, doc_id FROM u
QUALIFY row_number() OVER (PARTITION BY ticker, title, url ORDER BY src, doc_id) = 1"""))
def u1_union_dedupe(spark, sf_dir):
    """Fetched ∪ local news, duplicates by (ticker, title, url) removed, first source wins."""
    n = fx.news(spark, sf_dir).select("ticker", "title", "url", "source", "doc_id")
    fetched = n.where(F.col("doc_id") % 2 == 0)
    local = n.where(F.col("doc_id") % 3 == 0)
    return N.union_dedupe(fetched, local, ("ticker", "title", "url"), order="doc_id")


@register("U2_append_rows", sql=with_ctes(fx.BARS_SQL, fx.HOURLY_BARS_SQL, body="""SELECT ticker, CAST(date AS TIMESTAMP) AS date, close, volume, 'daily' AS freq FROM bars
UNION ALL SELECT ticker, date, close, volume, 'hourly' AS freq FROM hourly"""), dbl=("close", "volume"))
def u2_append_rows(spark, sf_dir):
    """Append daily and hourly bars (union by name)."""
    d = fx.bars(spark, sf_dir).withColumn("date", F.col("date").cast("timestamp_ntz")).withColumn("freq", F.lit("daily"))
    h = fx.hourly_bars(spark, sf_dir).withColumn("freq", F.lit("hourly"))
    return d.unionByName(h)


@register("U4_union_distinct_labels", sql=with_ctes(fx.SCORES_SQL, fx.NEWS_SQL, body="""SELECT DISTINCT label FROM (
  SELECT CAST(y AS VARCHAR) AS label FROM scores UNION ALL SELECT language FROM news)"""))
def u4_union_distinct_labels(spark, sf_dir):
    """Union distinct of two label sets."""
    a = fx.scores(spark, sf_dir).select(F.col("y").cast("string").alias("label"))
    b = fx.news(spark, sf_dir).select(F.col("language").alias("label"))
    return a.union(b).distinct()


@register("W12_report_price_metrics", sql=with_ctes(*REPORT_CTES, body="SELECT symbol, latest_close, price_change_30d FROM pm"),
          dbl=("latest_close", "price_change_30d"))
def w12_report_price_metrics(spark, sf_dir):
    """Latest close and 30-day change over the 180-day inference features."""
    bars = fx.bars(spark, sf_dir)
    as_of = F.lit(AS_OF).cast("date")
    pw = bars.where((F.col("date") >= F.date_sub(as_of, PRICE_DAYS)) & (F.col("date") < F.date_add(as_of, 1)))
    return R.price_metrics(X.build_features_for_inference(pw, None)).withColumnRenamed("ticker", "symbol")


_ = B  # bars operators are used through the feature builder
