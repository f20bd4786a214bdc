"""Forecast signals and advisory reports as tables (P13-P15, P22, M10, W12,
X5, X6).  A batch of companies in, one report row per company out — one lazy
plan; the per-company text is assembled with native string expressions.

Number formatting: values are first rounded half-up with plain arithmetic and
then printed, so the text is identical in every engine (Python's own format
rounds exact binary ties to even; the two differ only on such ties).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mktlens.config import ModelConfig
from mktlens.functions.exprs import col, strip_ws
from mktlens.functions.text import summarise_docs
from mktlens.operators import news as N
from mktlens.operators.chunked import apply_windows

# ---------------------------------------------------------------------------
# Fixed values of the reference (labels and report sentences).
LABEL_UP = "рост"
LABEL_DOWN = "снижение"
LABEL_NEUTRAL = "нейтрально"
LABEL_UNDETERMINED = "неопределённо"
EXPLAIN_HIGH = "Модель видит высокую вероятность роста (≈{p})."
EXPLAIN_LOW = "Модель предполагает снижение (вероятность роста около {p})."
EXPLAIN_MID = "Модель оценивает шансы роста примерно в {p}, ситуация неопределённая."
EXPLAIN_PRICE_UP = "За последний месяц цена выросла примерно на {c}."
EXPLAIN_PRICE_DOWN = "За последний месяц цена снизилась примерно на {c}."
EXPLAIN_NEWS_POS = "Новостной фон скорее позитивный (средний сентимент {s})."
EXPLAIN_NEWS_NEG = "Новостной фон негативный (средний сентимент {s})."
EXPLAIN_NEWS_NEUTRAL = "Новостной фон нейтральный."
EXPLAIN_NO_DATA = "Недостаточно данных — оцени риски и диверсифицируй портфель."
EXPLAIN_HIGH_CUT, EXPLAIN_LOW_CUT, EXPLAIN_NEWS_CUT = 0.65, 0.35, 0.05
HEADER_TITLE = "Отчёт по компании {company} ({symbol})"
HEADER_PROB = "Вероятность роста: {p}"
HEADER_SIGNAL = "Сигнал модели: {d}"
HEADER_CLOSE = "Последняя цена закрытия: {c} USD"
HEADER_CHANGE = "Изменение за 30 дней: {c}"
HEADER_TONE = "Средний тон новостей: {s}"
HEADER_COUNT = "Количество новостей в анализе: {n}"
SUMMARY_HEAD = "Краткая выжимка:\n"
SUMMARY_EMPTY = "Свежая выжимка недоступна."
EXPLANATION_HEAD = "Как интерпретировать:\n"
HIGHLIGHTS_HEAD = "Свежие заметки:\n"
HIGHLIGHT_NO_TITLE = "Без названия"
HIGHLIGHT_TONE = " (тон {s})"
# ---------------------------------------------------------------------------


def _r(x: Column, scale: float) -> Column:
    return F.floor(x * scale + 0.5) / scale


def fmt_signed2(x: Column) -> Column:
    """'{:+.2f}'."""
    return F.when(x.isNotNull(), F.format_string("%+.2f", _r(x, 100.0)))


def fmt_pct1(x: Column, signed: bool = False) -> Column:
    """'{:.1%}' / '{:+.1%}'."""
    return F.when(x.isNotNull(), F.format_string("%+.1f%%" if signed else "%.1f%%", _r(x * 100, 10.0)))


def fmt_pct0(x: Column) -> Column:
    """'{:.0%}'."""
    return F.when(x.isNotNull(), F.format_string("%.0f%%", _r(x * 100, 1.0)))


def fmt_thousands2(x: Column) -> Column:
    """'{:,.2f}'."""
    return F.when(x.isNotNull(), F.format_string("%,.2f", _r(x, 100.0)))


def _fill(template: str, key: str, value: Column) -> Column:
    a, b = template.split("{" + key + "}")
    return F.concat(F.lit(a), value, F.lit(b))


# ---------------------------------------------------------------- P13 / P14 / P22
def signal_band(prob: str | Column, cfg: ModelConfig = ModelConfig()) -> Column:
    """>= up -> rise, <= down -> fall, |p-0.5| <= band -> neutral, else
    undetermined; thresholds clamped as in P14."""
    p = col(prob)
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p >= cfg.up_threshold, F.lit(LABEL_UP))
        .when(p <= cfg.down_threshold, F.lit(LABEL_DOWN))
        .when(F.abs(p - 0.5) <= cfg.band, F.lit(LABEL_NEUTRAL))
        .otherwise(F.lit(LABEL_UNDETERMINED))
    )


def clamp_thresholds(up: Column, band: Column, window_days: Column) -> list[Column]:
    """P14 per row: up in [0.5, 0.95], down = max(0, 1-up), band in [0, 0.2],
    news window >= 7 days."""
    u = F.least(F.greatest(up, F.lit(0.5)), F.lit(0.95))
    return [
        u.alias("up_threshold"),
        F.greatest(F.lit(0.0), 1 - u).alias("down_threshold"),
        F.greatest(F.lit(0.0), F.least(band, F.lit(0.2))).alias("neutral_band"),
        F.greatest(F.lit(7), window_days.cast("int")).alias("news_window_days"),
    ]


def direction_2way(prob: str | Column) -> Column:
    """P22."""
    p = col(prob)
    return F.when(p.isNull(), F.lit(None).cast("string")).when(p >= 0.5, F.lit("up")).otherwise(F.lit("down"))


# ---------------------------------------------------------------- P15
def explanation(prob: Column, change: Column, sentiment: Column) -> Column:
    """Rule-based explanation (fixed sentences, optional parts skipped)."""
    p0 = fmt_pct0(prob)
    c1 = fmt_pct1(change)
    s2 = fmt_signed2(sentiment)
    r_prob = (
        F.when(prob.isNull(), F.lit(None).cast("string"))
        .when(prob >= EXPLAIN_HIGH_CUT, _fill(EXPLAIN_HIGH, "p", p0))
        .when(prob <= EXPLAIN_LOW_CUT, _fill(EXPLAIN_LOW, "p", p0))
        .otherwise(_fill(EXPLAIN_MID, "p", p0))
    )
    r_change = (
        F.when(change.isNull(), F.lit(None).cast("string"))
        .when(change >= 0, _fill(EXPLAIN_PRICE_UP, "c", c1))
        .otherwise(_fill(EXPLAIN_PRICE_DOWN, "c", c1))
    )
    r_sent = (
        F.when(sentiment.isNull(), F.lit(None).cast("string"))
        .when(sentiment > EXPLAIN_NEWS_CUT, _fill(EXPLAIN_NEWS_POS, "s", s2))
        .when(sentiment < -EXPLAIN_NEWS_CUT, _fill(EXPLAIN_NEWS_NEG, "s", s2))
        .otherwise(F.lit(EXPLAIN_NEWS_NEUTRAL))
    )
    text = F.concat_ws(" ", r_prob, r_change, r_sent)
    return F.when(text == "", F.lit(EXPLAIN_NO_DATA)).otherwise(text)


# ---------------------------------------------------------------- W12 on features
def price_metrics(features: DataFrame, key: str = "ticker") -> DataFrame:
    """Latest close and change vs the 22nd-last close (W12) per key."""
    f = features.where(F.col("close").isNotNull()).select(key, "date", "close")
    f = apply_windows(f, lambda b, w: b.withColumn("_base", F.lag("close", 21).over(w)), key=key, lookback=21)
    last = f.groupBy(key).agg(F.max_by(F.struct("close", "_base"), "date").alias("s"))
    base = F.col("s._base")
    return last.select(
        key,
        F.col("s.close").alias("latest_close"),
        F.when(base.isNotNull() & (base != 0), F.col("s.close") / base - 1.0).alias("price_change_30d"),
    )


# ---------------------------------------------------------------- X5
def company_report(companies: DataFrame, features: DataFrame, news: DataFrame,
                   probabilities: DataFrame | None = None, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """One report row per company.

    companies: (symbol, company); features: inference matrix (ticker, date,
    close, ...) already limited to the price window; news: annotated news
    (ticker, seen_datetime, date, title, full_text, url, source, language,
    sentiment_score) already limited to the news window; probabilities:
    optional (ticker, probability_up) from a model (M10).
    """
    c = companies.select(F.col("symbol"), F.coalesce("company", "symbol").alias("company"))
    pm = price_metrics(features).withColumnRenamed("ticker", "symbol")
    sent = news.groupBy(F.col("ticker").alias("symbol")).agg(
        F.avg("sentiment_score").alias("sentiment_mean"), F.count(F.lit(1)).alias("news_count")
    )
    docs = N.summary_docs(news, 12).withColumnRenamed("ticker", "symbol")
    out = c.join(pm, "symbol", "left").join(sent, "symbol", "left").join(docs, "symbol", "left")
    if probabilities is not None:
        out = out.join(probabilities.select(F.col("ticker").alias("symbol"), "probability_up"), "symbol", "left")
    else:
        out = out.withColumn("probability_up", F.lit(None).cast("double"))
    out = out.withColumn("direction", signal_band("probability_up", cfg))
    out = out.withColumn("news_count", F.coalesce("news_count", F.lit(0)))
    out = out.withColumn("summary", summarise_docs(F.coalesce("docs", F.array().cast("array<string>"))))
    out = out.withColumn("explanation", explanation(F.col("probability_up"), F.col("price_change_30d"), F.col("sentiment_mean")))
    return out.select("symbol", "company", "probability_up", "direction", "latest_close", "price_change_30d",
                      "sentiment_mean", "news_count", "summary", "explanation")


# ---------------------------------------------------------------- X6
def highlight_lines(highlights: DataFrame, key: str = "ticker") -> DataFrame:
    """Bullet text of the newest items (F13): '- date | source: title (тон
    +0.12)' plus the url on its own line."""
    h = highlights.select(key, F.explode("highlights").alias("h"))
    d, s, t = strip_ws(F.col("h.date")), strip_ws(F.col("h.source")), strip_ws(F.col("h.title"))
    title = F.when(t == "", F.lit(HIGHLIGHT_NO_TITLE)).otherwise(t)
    prefix = F.concat_ws(" | ", F.when(d != "", d), F.when(s != "", s))
    bullet = F.when(prefix != "", F.concat(F.lit("- "), prefix, F.lit(": "), title)).otherwise(F.concat(F.lit("- "), title))
    tone = F.when(F.col("h.sentiment").isNotNull() & ~F.isnan("h.sentiment"), _fill(HIGHLIGHT_TONE, "s", fmt_signed2(F.col("h.sentiment"))))
    url = strip_ws(F.col("h.url"))
    line = F.concat(bullet, F.coalesce(tone, F.lit("")), F.when(url != "", F.concat(F.lit("\n  "), url)).otherwise(F.lit("")))
    rec = F.struct(F.col("h.rank").alias("rank"), line.alias("line"))
    return h.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(rec)), lambda r: r["line"]).alias("lines"))


def render_report(reports: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """The report as its message blocks (metrics, summary, explanation,
    highlights), empty blocks dropped."""
    r = reports
    if lines is not None:
        r = r.join(lines.withColumnRenamed("ticker", "symbol"), "symbol", "left")
    else:
        r = r.withColumn("lines", F.lit(None).cast("array<string>"))
    header = F.concat_ws(
        "\n",
        F.concat(F.lit(HEADER_TITLE.split("{company}")[0]), F.col("company"), F.lit(" ("), F.col("symbol"), F.lit(")")),
        F.when(F.col("probability_up").isNotNull(), _fill(HEADER_PROB, "p", fmt_pct1(F.col("probability_up")))),
        F.when(F.col("direction").isNotNull() & (F.col("direction") != ""), _fill(HEADER_SIGNAL, "d", F.col("direction"))),
        F.when(F.col("latest_close").isNotNull(), _fill(HEADER_CLOSE, "c", fmt_thousands2(F.col("latest_close")))),
        F.when(F.col("price_change_30d").isNotNull(), _fill(HEADER_CHANGE, "c", fmt_pct1(F.col("price_change_30d"), True))),
        F.when(F.col("sentiment_mean").isNotNull(), _fill(HEADER_TONE, "s", fmt_signed2(F.col("sentiment_mean")))),
        _fill(HEADER_COUNT, "n", F.col("news_count").cast("string")),
    )
    summ = strip_ws(F.coalesce("summary", F.lit("")))
    summary_block = F.concat(F.lit(SUMMARY_HEAD), F.when(summ == "", F.lit(SUMMARY_EMPTY)).otherwise(summ))
    expl = strip_ws(F.coalesce("explanation", F.lit("")))
    expl_block = F.when(expl != "", F.concat(F.lit(EXPLANATION_HEAD), expl))
    hl_block = F.when(F.size(F.coalesce("lines", F.array().cast("array<string>"))) > 0,
                      F.concat(F.lit(HIGHLIGHTS_HEAD), F.array_join("lines", "\n")))
    msgs = F.filter(F.array(header, summary_block, expl_block, hl_block), lambda m: m.isNotNull() & (strip_ws(m) != ""))
    return r.select("symbol", msgs.alias("messages"))
