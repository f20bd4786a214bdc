"""String functions as native Spark expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mktlens.functions.exprs import WS, col, strip_ws

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
# Characters kept by the text normaliser: ASCII digits and letters plus the
# Russian alphabet (А-Я, а-я, Ё, ё).
NORMALISE_KEEP = "0-9A-Za-zА-Яа-яЁё"
# Separators of the registry alias list.
ALIAS_SEPARATORS = "[;,]"
# Candidate ticker token: 1-10 alnum, optional dot suffix of 1-3 alnum.
CANDIDATE_SYMBOL = r"^[A-Za-z0-9]{1,10}(\.[A-Za-z0-9]{1,3})?$"
# Command prefixes removed from a free-text query.
COMMAND_PREFIXES = ("/start", "/help", "/predict", "/news")
# Characters turned into spaces in a free-text query.
QUERY_SEPARATORS = ("@", "#", ",", ";", "|", "\n", "\t")
# Summary defaults (empty input / nothing left after splitting).
SUMMARY_EMPTY_INPUT = "Нет достаточных новостей для вывода."
SUMMARY_NO_SENTENCES = "Нет достаточной информации для краткого описания."
SUMMARY_MAX_CHARS = 6000
SUMMARY_SENTENCES = 3
# ---------------------------------------------------------------------------


def normalise(text: str | Column) -> Column:
    """non-kept runs -> one space, trimmed, lower-cased."""
    t = F.regexp_replace(col(text), f"[^{NORMALISE_KEEP}]+", " ")
    return F.lower(F.trim(t))


def normalise_symbol(symbol: str | Column) -> Column:
    """trim + upper."""
    return F.upper(strip_ws(symbol))


def alias_list(aliases: str | Column, symbol: str | Column, company: str | Column) -> Column:
    """split on ; and , -> normalise -> add symbol and company -> drop
    blanks -> distinct -> sorted."""
    parts = F.transform(F.split(F.coalesce(col(aliases), F.lit("")), ALIAS_SEPARATORS), normalise)
    allv = F.concat(parts, F.array(normalise(symbol), normalise(company)))
    return F.array_sort(F.array_distinct(F.filter(allv, lambda x: x.isNotNull() & (x != ""))))


def search_text(title: str | Column, summary: str | Column) -> Column:
    """normalised title, a space, normalised summary."""
    return F.concat(normalise(F.coalesce(col(title), F.lit(""))), F.lit(" "), normalise(F.coalesce(col(summary), F.lit(""))))


def candidate_symbols(text: str | Column) -> Column:
    """candidate ticker tokens, upper-cased, distinct, ordered by
    (length, text)."""
    cleaned = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[^0-9A-Za-z. ]+", " "))
    toks = F.split(cleaned, " +")
    keep = F.filter(
        toks,
        lambda t: t.rlike(CANDIDATE_SYMBOL) | (t.rlike("[A-Za-z]") & (F.length(t) <= 12)),
    )
    ups = F.array_distinct(F.transform(keep, F.upper))
    keyed = F.array_sort(F.transform(ups, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    return F.transform(keyed, lambda s: s["t"])


def clean_query(text: str | Column) -> Column:
    """drop a leading command, turn separators into spaces, keep tokens
    that contain a letter or are all digits and do not start with '/'."""
    t = strip_ws(F.coalesce(col(text), F.lit("")))
    prefixes = "|".join(p.replace("/", "\\/") for p in COMMAND_PREFIXES)
    t = strip_ws(F.regexp_replace(t, f"^(?i)({prefixes})", ""))
    seps = "".join({"\n": "\\n", "\t": "\\t", "|": "\\|"}.get(c, c) for c in QUERY_SEPARATORS)
    t = F.regexp_replace(t, f"[{seps}]", " ")
    toks = F.split(strip_ws(t), f"{WS}+")
    keep = F.filter(
        toks,
        lambda x: (F.length(x) > 0) & ~x.startswith("/") & (x.rlike(r"\p{L}") | x.rlike(r"^\p{Nd}+$")),
    )
    return F.array_join(keep, " ")


def sentences(text: str | Column) -> Column:
    """Newlines to spaces, split on '.', strip, drop blanks."""
    parts = F.split(F.regexp_replace(col(text), "\n", " "), r"\.")
    return F.filter(F.transform(parts, strip_ws), lambda x: x != "")


def extractive_summary(text: str | Column, n: int = SUMMARY_SENTENCES) -> Column:
    """first ``n`` sentences re-joined with '. ' plus a final '.'."""
    parts = sentences(text)
    return F.when(F.size(parts) == 0, F.lit(SUMMARY_NO_SENTENCES)).otherwise(
        F.concat(F.array_join(F.slice(parts, 1, n), ". "), F.lit("."))
    )


def join_docs(docs: str | Column, max_chars: int = SUMMARY_MAX_CHARS) -> Column:
    """strip the documents of an ordered array, drop blanks, join by a
    space and cut to ``max_chars`` characters."""
    kept = F.filter(F.transform(col(docs), strip_ws), lambda x: x.isNotNull() & (x != ""))
    return F.substring(F.array_join(kept, " "), 1, max_chars)


def summarise_docs(docs: str | Column) -> Column:
    """F10 + F9: joined text -> default when empty, else extractive summary."""
    joined = join_docs(docs)
    return F.when(joined == "", F.lit(SUMMARY_EMPTY_INPUT)).otherwise(extractive_summary(joined))


def doc_text(title: str | Column, body: str | Column) -> Column:
    """'title. body' (a missing part counts as empty)."""
    return F.concat(F.coalesce(col(title), F.lit("")), F.lit(". "), F.coalesce(col(body), F.lit("")))


def alias_is_valid(name: str | Column) -> Column:
    """non-blank and (has a letter or is longer than one character)."""
    c = strip_ws(col(name))
    return c.isNotNull() & (F.length(c) > 0) & (c.rlike(r"\p{L}") | (F.length(c) > 1))


def iso_date(d: str | Column) -> Column:
    """date as yyyy-MM-dd, blank when missing."""
    return F.coalesce(F.date_format(col(d), "yyyy-MM-dd"), F.lit(""))


def signed2(x: str | Column) -> Column:
    """'%+.2f' of a value (NULL stays NULL so concat_ws drops the line)."""
    x = col(x)
    return F.when(x.isNotNull(), F.format_string("%+.2f", x))


def percent1(x: str | Column, signed: bool = False) -> Column:
    """Python '{:.1%}' / '{:+.1%}' (NULL stays NULL)."""
    x = col(x)
    fmt = "%+.1f%%" if signed else "%.1f%%"
    return F.when(x.isNotNull(), F.format_string(fmt, x * 100))


def percent0(x: str | Column) -> Column:
    """Python '{:.0%}'."""
    x = col(x)
    return F.when(x.isNotNull(), F.format_string("%.0f%%", x * 100))


def thousands2(x: str | Column) -> Column:
    """Python '{:,.2f}'."""
    x = col(x)
    return F.when(x.isNotNull(), F.format_string("%,.2f", x))
