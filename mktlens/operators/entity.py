"""Company registry and entity resolution.

The registry and alias tables are dimensions (companies, not events).  They
are joined by equality wherever the reference compares for equality; only the
substring test (J3) and the fuzzy score (J6) are not equi-joins:

* J3 looks a short run of each alias's bytes up in the texts and then compares
  the whole alias (exact substring semantics, no size limit).
* J6 generates candidate pairs with an equi-join on both lengths and a rare
  character, and bounds the characters in common by bit sets (both lossless for a
  cutoff c), so the Ratcliff-Obershelp score (F12) is computed for few pairs.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mktlens.functions.exprs import WS, strip_ws
from mktlens.session import cut_lineage
from mktlens.functions.similarity import sequence_ratio
from mktlens.functions.text import alias_is_valid, alias_list, candidate_symbols, normalise, normalise_symbol

# ---------------------------------------------------------------------------
# Fixed values of the reference (static fallback tables), in their order.
# Candidate token -> (symbol, default company name).
FALLBACK_SYMBOLS = [
    ("TESLA", "TSLA", "Tesla Inc."),
    ("TSLA", "TSLA", "Tesla Inc."),
    ("NVIDIA", "NVDA", "NVIDIA Corporation"),
    ("NVDA", "NVDA", "NVIDIA Corporation"),
    ("ALIBABA", "BABA", "Alibaba Group Holding Ltd"),
    ("BABA", "BABA", "Alibaba Group Holding Ltd"),
    ("MICROSOFT", "MSFT", "Microsoft Corporation"),
    ("MSFT", "MSFT", "Microsoft Corporation"),
    ("APPLE", "AAPL", "Apple Inc."),
    ("AAPL", "AAPL", "Apple Inc."),
    ("AMAZON", "AMZN", "Amazon.com Inc."),
    ("AMZN", "AMZN", "Amazon.com Inc."),
    ("GOOGLE", "GOOGL", "Alphabet Inc."),
    ("ALPHABET", "GOOGL", "Alphabet Inc."),
    ("META", "META", "Meta Platforms Inc."),
    ("FACEBOOK", "META", "Meta Platforms Inc."),
    ("YANDEX", "YNDX", "Yandex N.V."),
    ("GAZPROM", "GAZP.ME", "Gazprom PJSC"),
    ("SBERBANK", "SBER.ME", "Sberbank"),
    ("TESLAINC", "TSLA", "Tesla Inc."),
    ("NASDAQ", "^NDX", "Nasdaq 100 Index"),
    ("NASDAQ100", "^NDX", "Nasdaq 100 Index"),
    ("NAS100", "^NDX", "Nasdaq 100 Index"),
]
# Price fallbacks: primary -> ordered alternatives.
PRICE_FALLBACKS = [
    ("^NDX", ["QQQ", "NDX"]),
    ("NASDAQ", ["^NDX", "QQQ"]),
    ("NASDAQ100", ["^NDX", "QQQ"]),
    ("NAS100", ["^NDX", "QQQ"]),
    ("^IXIC", ["QQQ"]),
    ("SP500", ["^GSPC", "SPY"]),
    ("S&P500", ["^GSPC", "SPY"]),
    ("^DJI", ["DIA"]),
]
# Seed query terms per symbol, in order.
QUERY_FALLBACKS = [
    ("AAPL", ["Apple", "iPhone", "苹果"]),
    ("MSFT", ["Microsoft", "Azure", "微软"]),
    ("TSLA", ["Tesla", "Илон Маск", "特斯拉"]),
    ("NVDA", ["NVIDIA", "Nvidia", "英伟达"]),
    ("BABA", ["Alibaba", "Ali Baba", "阿里巴巴"]),
    ("^NDX", ["Nasdaq 100", "Nasdaq index", "NDX"]),
    ("NASDAQ", ["Nasdaq 100", "Nasdaq", "NDX"]),
]
# Tier scores.
SCORE_SYMBOL, SCORE_ALIAS, SCORE_FUZZY = 1.0, 0.9, 0.75
SCORE_FALLBACK_REGISTRY, SCORE_CANDIDATE_REGISTRY, SCORE_FALLBACK_BARE = 0.88, 0.85, 0.6
FUZZY_CUTOFF = 0.6
# ---------------------------------------------------------------------------

MATCH_SCHEMA = "query string, symbol string, shortname string, longname string, exchange string, score double, tier int, ord bigint"


def fallback_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FALLBACK_SYMBOLS, "token string, symbol string, name string")


def price_fallback_table(spark: SparkSession) -> DataFrame:
    """(symbol, candidate, rank) with the symbol itself at rank 0 (posexplode)."""
    df = spark.createDataFrame(PRICE_FALLBACKS, "symbol string, alts array<string>")
    return df.select("symbol", F.posexplode(F.array_distinct(F.concat(F.array("symbol"), F.transform("alts", F.upper)))).alias("rank", "candidate"))


def seed_terms_table(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(QUERY_FALLBACKS, "symbol string, terms array<string>")
    return df.select("symbol", F.posexplode("terms").alias("pos", "term"))


# ---------------------------------------------------------------- S5 / F2
def load_registry(raw: DataFrame, order: Column | None = None) -> DataFrame:
    """Normalise raw registry rows (symbol, company, exchange, aliases).

    Output: row_id (file order, unique, increasing), symbol, company,
    exchange, aliases array<string> (F2).  Blank symbols are skipped.
    """
    df = raw
    if order is not None:
        df = df.orderBy(order)
    df = df.withColumn("row_id", F.monotonically_increasing_id())
    sym = normalise_symbol(F.coalesce(F.col("symbol"), F.lit("")))
    comp_raw = F.col("company")
    company = strip_ws(F.when(comp_raw.isNull() | (comp_raw == ""), sym).otherwise(comp_raw))
    exch = strip_ws(F.coalesce(F.col("exchange"), F.lit("")))
    out = df.select(
        "row_id",
        sym.alias("symbol"),
        company.alias("company"),
        F.when(exch != "", exch).alias("exchange"),
        F.col("aliases").alias("_aliases_raw"),
    ).where(F.col("symbol") != "")
    return out.withColumn("aliases", alias_list("_aliases_raw", "symbol", "company")).drop("_aliases_raw")


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """S5 from CSV with header (a leading BOM is stripped from the first
    header name)."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    for c in raw.columns:
        if c.startswith("﻿"):
            raw = raw.withColumnRenamed(c, c.lstrip("﻿"))
    for c in ("symbol", "company", "exchange", "aliases"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return load_registry(raw)


def first_by_symbol(registry: DataFrame) -> DataFrame:
    """J4 dimension: the first registry row of each symbol."""
    return registry.groupBy("symbol").agg(F.min_by(F.struct("row_id", "company", "exchange", "aliases"), "row_id").alias("r")).select(
        "symbol", "r.row_id", "r.company", "r.exchange", "r.aliases"
    )


def alias_rows(registry: DataFrame) -> DataFrame:
    """Exploded alias table (row_id, symbol, company, exchange, alias)."""
    return registry.select("row_id", "symbol", "company", "exchange", F.explode("aliases").alias("alias"))


# ---------------------------------------------------------------- query tokens
def query_tokens(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Normalised query tokens with a fixed order (T20): the whole query
    first, then each '/'- or space-separated part by position; duplicates keep
    their first position; blanks dropped."""
    q = F.col(query_col)
    parts = F.split(strip_ws(F.regexp_replace(q, "/", " ")), f"{WS}+")
    toks = F.concat(F.array(normalise(strip_ws(q))), F.transform(parts, normalise))
    ex = queries.select(query_col, F.posexplode(toks).alias("pos", "token")).where(F.col("token") != "")
    return ex.groupBy(query_col, "token").agg(F.min("pos").alias("pos"))


# ---------------------------------------------------------------- tiers
def _match(df: DataFrame, tier: int, score: Column, ord_: Column) -> DataFrame:
    return df.select(
        "query",
        "symbol",
        F.col("company").alias("shortname"),
        F.col("company").alias("longname"),
        "exchange",
        score.cast("double").alias("score"),
        F.lit(tier).alias("tier"),
        ord_.cast("bigint").alias("ord"),
    )


def tier_exact_symbol(queries: DataFrame, first: DataFrame) -> DataFrame:
    """J4."""
    q = queries.select("query", normalise_symbol("query").alias("symbol"))
    return _match(q.join(first, "symbol"), 1, F.lit(SCORE_SYMBOL), F.lit(0))


def tier_alias(tokens: DataFrame, aliases: DataFrame, most: int | None = None) -> DataFrame:
    """Records having any query token among their aliases, record order.  With
    ``most``, an alias keeps the first records of its first ``most`` symbols only: a
    query's first ``most`` symbols are among them, whatever its tokens."""
    if most is not None:
        own = aliases.groupBy("alias", "symbol").agg(F.min_by(F.struct("row_id", "company", "exchange"), "row_id").alias("r")).select("alias", "symbol", "r.*")
        place = F.row_number().over(Window.partitionBy("alias").orderBy("row_id", "symbol"))
        aliases = own.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    j = tokens.join(aliases, tokens["token"] == aliases["alias"]).select("query", "row_id", "symbol", "company", "exchange").distinct()
    return _match(j, 2, F.lit(SCORE_ALIAS), F.col("row_id"))


def _alphabet_rank(aliases: DataFrame) -> DataFrame:
    """One row with the global character order for prefix filtering: rarest alias
    characters first (characters absent from the aliases rank before all).  Its
    size is bounded by the number of characters there are."""
    freq = aliases.select(F.explode(F.split("alias", "")).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "ch")))
    return freq.agg(F.map_from_entries(F.transform(ordered, lambda x, i: F.struct(x["ch"], i + 1))).alias("_rank"))


def _elements(s: Column, rank: Column) -> Column:
    """Multiset of characters as unique (rank, char, occurrence) structs in
    the global order (the k-th 'a' of a string is its own element)."""
    chars = F.split(s, "")
    el = F.transform(
        chars,
        lambda ch, i: F.struct(
            F.coalesce(F.element_at(rank, ch), F.lit(0)).alias("r"),
            ch.alias("ch"),
            F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == ch)).alias("occ"),
        ),
    )
    return F.array_sort(el)


def _tags(elements: Column) -> Column:
    """Elements as strings 'char<US>occurrence' for set operations."""
    return F.transform(elements, lambda e: F.concat(e["ch"], F.lit("\u001f"), e["occ"].cast("string")))


def _floordiv(a: Column, b: int) -> Column:
    """Exact floor(a / b) for integer a and positive integer b."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def _ceildiv(a: Column, b: int) -> Column:
    return _floordiv(a + F.lit(b - 1), b)


def _signature(tags: Column) -> list[Column]:
    """Two 64-bit sets of the elements' hashes."""
    bit = F.transform(tags, lambda t: F.pmod(F.xxhash64(t), F.lit(128)).cast("int"))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x)
    return [
        F.aggregate(F.filter(bit, lambda x: (x >= 64 * k) & (x < 64 * k + 64)), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(one(x - 64 * k)))
        for k in (0, 1)
    ]


def fuzzy_candidates(tokens: DataFrame, aliases: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """J6 candidate pairs (query, pos, token, alias) that can reach ``cutoff``.

    Lossless pruning on distinct strings (integer arithmetic with the cutoff as a
    fraction p/q, so pairs exactly on the cutoff are kept).  Strings of lengths la and
    lb reach it only with T = ceil(p (la + lb) / 2q) characters in common, so:
    * lb lies in a band around la, and only as many element prefixes are compared as
      the prefix-filter lemma asks for these two lengths: the first la - T + 1 and
      lb - T + 1 elements of the character multisets (global rarest-first order) share
      one.  Lengths and element are one equi-join key.
    * la less the elements that the other string cannot have (its 128-bit signature
      lacks them) is at least T, and likewise lb; two bit counts per pair.
    """
    frac = Fraction(cutoff).limit_denominator(10_000)
    p, q = frac.numerator, frac.denominator
    # both are read twice: stored once, so that their plans are not computed again
    al = cut_lineage(aliases.select("alias").distinct())
    tokens = cut_lineage(tokens.select("query", "pos", "token"))
    rank = F.broadcast(_alphabet_rank(al))  # one row

    def keyed(strings: DataFrame, name: str, own: str, other: str, sig: str) -> DataFrame:
        """A row per string, length of a partner, and element of its prefix."""
        tags = _tags(_elements(F.col(name), F.col("_rank")))
        d = strings.crossJoin(rank).select(name, F.length(name).cast("long").alias(own), tags.alias("_tags")).where(F.col(own) > 0)
        one, two = _signature(F.col("_tags"))
        n = F.col(own)
        # partners of ceil(n c / (2 - c)) to floor(n (2 - c) / c) characters
        band = F.sequence(_ceildiv(n * p, 2 * q - p), _floordiv(n * (2 * q - p), p))
        d = d.withColumn(f"{sig}0", one).withColumn(f"{sig}1", two).withColumn(other, F.explode(band))
        need = _ceildiv((n + F.col(other)) * p, 2 * q)
        prefix = F.slice("_tags", 1, F.greatest(n - need + 1, F.lit(0)).cast("int"))
        return d.withColumn("_need", need).withColumn("_e", F.explode(F.transform(prefix, lambda t: F.xxhash64(t)))).drop("_tags")

    t = keyed(tokens.select("token").distinct(), "token", "la", "lb", "s")
    a = keyed(al, "alias", "lb", "la", "t").drop("_need")
    lacks = lambda x, y: F.bit_count(F.col(f"{x}0").bitwiseAND(F.bitwise_not(f"{y}0"))) + F.bit_count(F.col(f"{x}1").bitwiseAND(F.bitwise_not(f"{y}1")))
    pairs = t.join(a, ["la", "lb", "_e"]).where((F.col("la") - lacks("s", "t") >= F.col("_need")) & (F.col("lb") - lacks("t", "s") >= F.col("_need")))
    # CPU-heavy checks follow on little data: as many tasks as there are (AQE would
    # merge so small a shuffle into one); the distinct reuses this partitioning
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ok = pairs.select("token", "alias").repartition(n, "token", "alias").distinct()
    return tokens.select("query", "pos", "token").join(ok, "token")


def tier_fuzzy(tokens: DataFrame, registry: DataFrame, n: int, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """Per token the top ``n`` aliases by (ratio, alias) desc with ratio >=
    cutoff; an alias maps to the LAST registry row holding it (T17)."""
    al = alias_rows(registry)
    last = al.groupBy("alias").agg(F.max_by(F.struct("row_id", "symbol", "company", "exchange"), "row_id").alias("r")).select(
        "alias", "r.row_id", "r.symbol", "r.company", "r.exchange"
    )
    cand = fuzzy_candidates(tokens, al, cutoff).withColumn("ratio", sequence_ratio(F.col("token"), F.col("alias")))
    cand = cand.where(F.col("ratio") >= cutoff)
    w = Window.partitionBy("query", "pos").orderBy(F.col("ratio").desc(), F.col("alias").desc())
    top = cand.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    j = top.join(last, "alias")
    # k is at most n, so this orders by (position, rank) for any n
    return _match(j, 3, F.lit(SCORE_FUZZY), F.col("pos") * (n + 1) + F.col("k"))


def tier_candidates(queries: DataFrame, first: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Candidate tokens (F4) resolved via the fallback table and the
    registry; unresolved tokens are kept with a NULL score (no network step)."""
    c = queries.select("query", F.posexplode(candidate_symbols("query")).alias("cpos", "token"))
    c = c.join(F.broadcast(fallbacks), "token", "left").withColumnRenamed("symbol", "fb_symbol")
    fb = c.where(F.col("fb_symbol").isNotNull())
    fb_reg = fb.join(first.withColumnRenamed("symbol", "fb_symbol"), "fb_symbol", "left")
    fb_out = fb_reg.select(
        "query",
        F.col("fb_symbol").alias("symbol"),
        F.coalesce("company", "name").alias("company"),
        "exchange",
        F.when(F.col("row_id").isNotNull(), F.lit(SCORE_FALLBACK_REGISTRY)).otherwise(F.lit(SCORE_FALLBACK_BARE)).alias("score"),
        "cpos",
    )
    plain = c.where(F.col("fb_symbol").isNull()).select("query", F.col("token").alias("symbol"), "cpos")
    pl = plain.join(first, "symbol", "left").select(
        "query",
        "symbol",
        F.coalesce("company", "symbol").alias("company"),
        "exchange",
        F.when(F.col("row_id").isNotNull(), F.lit(SCORE_CANDIDATE_REGISTRY)).alias("score"),
        "cpos",
    )
    u = fb_out.unionByName(pl)
    return _match(u, 4, F.col("score"), F.col("cpos"))


def tier_compact(queries: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Spaces removed, alphanumeric, 1-12 characters -> fallback or itself."""
    compact = F.regexp_replace("query", " ", "")
    q = queries.select("query", compact.alias("compact")).where(
        F.col("compact").rlike(r"^[\p{L}\p{N}]{1,12}$")
    ).withColumn("token", F.upper("compact"))
    j = q.join(F.broadcast(fallbacks), "token", "left")
    return j.select(
        "query",
        F.coalesce("symbol", "token").alias("symbol"),
        F.coalesce("name", "token").alias("shortname"),
        F.coalesce("name", "token").alias("longname"),
        F.lit(None).cast("string").alias("exchange"),
        F.when(F.col("symbol").isNotNull(), F.lit(SCORE_FALLBACK_BARE)).cast("double").alias("score"),
        F.lit(6).alias("tier"),
        F.lit(0).cast("bigint").alias("ord"),
    )


def resolve_companies(queries: DataFrame, registry: DataFrame, count: int = 5, fuzzy: bool = True) -> DataFrame:
    """Free-text queries -> up to ``count`` company matches each, in tier
    order (T19), each symbol once (U3), capped (O6).

    Output: query, rank, symbol, shortname, longname, exchange, score, tier.
    """
    spark = queries.sparkSession
    # every tier reads the queries and the (sorted) registry: both are computed once
    q = cut_lineage(queries.select(strip_ws("query").alias("query")).where(F.col("query") != "").distinct())
    registry = cut_lineage(registry)
    first = first_by_symbol(registry)
    al = alias_rows(registry)
    toks = query_tokens(q)
    fallbacks = fallback_table(spark)
    # the exact symbol and count others are all that the cap can keep
    tiers = [tier_exact_symbol(q, first), tier_alias(toks, al, count + 1), tier_candidates(q, first, fallbacks), tier_compact(q, fallbacks)]
    if fuzzy:
        tiers.append(tier_fuzzy(toks, registry, count))
    u = tiers[0]
    for t in tiers[1:]:
        u = u.unionByName(t)
    # First tier wins per symbol.
    wsym = Window.partitionBy("query", "symbol").orderBy("tier", "ord")
    u = u.withColumn("_k", F.row_number().over(wsym)).where(F.col("_k") == 1).drop("_k")
    w = Window.partitionBy("query").orderBy("tier", "ord", "symbol")
    # J8, the last tier, has a row per query: first of a query with no match at all, which
    # alone takes it.
    ranked = u.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= count) & ((F.col("tier") < 6) | (F.col("rank") == 1)))
    return ranked.select("query", "rank", "symbol", "shortname", "longname", "exchange", "score", "tier")


# ---------------------------------------------------------------- A17 / S6
def registered_aliases(matches: DataFrame) -> DataFrame:
    """Names each accepted match registers: the query and the company name."""
    a = matches.select("symbol", F.col("query").alias("alias"))
    b = matches.select("symbol", F.col("shortname").alias("alias"))
    return a.unionByName(b)


def upsert_aliases(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store ∪ valid new names (stripped, F15); ``is_new`` marks names the
    batch added (a symbol changed iff it has one)."""
    cleaned = new.select(normalise_symbol("symbol").alias("symbol"), strip_ws("alias").alias("alias")).where(
        (F.col("symbol") != "") & alias_is_valid(F.col("alias"))
    ).distinct()
    old = store.select("symbol", "alias").distinct()
    added = cleaned.join(old, ["symbol", "alias"], "left_anti").withColumn("is_new", F.lit(True))
    return old.withColumn("is_new", F.lit(False)).unionByName(added)


def fold_alias_store(store: DataFrame) -> DataFrame:
    """S6 write side: (symbol, alias) rows folded to symbol -> sorted names,
    symbols without names dropped."""
    st = store.select(normalise_symbol("symbol").alias("symbol"), strip_ws("alias").alias("alias")).where(
        (F.col("symbol") != "") & F.col("alias").isNotNull() & (F.col("alias") != "")
    )
    return st.groupBy("symbol").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def write_alias_store(store: DataFrame, path: str) -> None:
    """Persist the folded store (overwrite through the commit protocol)."""
    fold_alias_store(store).write.mode("overwrite").parquet(path)


def read_alias_store(spark: SparkSession, path: str) -> DataFrame:
    """Folded store back to (symbol, alias) rows."""
    return spark.read.parquet(path).select("symbol", F.explode("aliases").alias("alias"))


# ---------------------------------------------------------------- J9 / U5
def symbol_aliases(registry: DataFrame, store: DataFrame) -> DataFrame:
    """Per symbol, first-registry-row aliases ∪ normalised dynamic aliases
    (alias store, then seed terms), blanks dropped, sorted."""
    spark = registry.sparkSession
    first = first_by_symbol(registry).select("symbol", "aliases")
    seeds = seed_terms_table(spark).select("symbol", F.col("term").alias("alias"))
    dyn = store.select(normalise_symbol("symbol").alias("symbol"), "alias").unionByName(seeds)
    dyn = dyn.select("symbol", normalise("alias").alias("alias")).where(F.col("alias") != "")
    dyn = dyn.groupBy("symbol").agg(F.collect_set("alias").alias("dyn"))
    j = first.join(dyn, "symbol", "full_outer")
    merged = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("dyn", F.array().cast("array<string>")))
    return j.select("symbol", F.array_sort(merged).alias("aliases"))


def query_terms(matches: DataFrame, sym_aliases: DataFrame) -> DataFrame:
    """{symbol, shortname, longname} ∪ symbol aliases, sorted, non-empty."""
    j = matches.join(sym_aliases, "symbol", "left")
    base = F.array(F.upper("symbol"), "shortname", "longname")
    terms = F.concat(base, F.coalesce("aliases", F.array().cast("array<string>")))
    clean = F.filter(terms, lambda x: x.isNotNull() & (x != ""))
    return j.select("query", "symbol", F.array_sort(F.array_distinct(clean)).alias("terms"))


def fallback_terms(requests: DataFrame, store: DataFrame) -> DataFrame:
    """U5 ordered variant (query_fallback_terms): base terms in order, then the
    symbol's dynamic aliases (sorted: the reference iterates a set) and seed
    terms; ``[symbol]`` when nothing is left.  requests: (symbol, base array)."""
    spark = requests.sparkSession
    dyn = store.select(normalise_symbol("symbol").alias("symbol"), strip_ws("alias").alias("alias")).where(F.col("alias") != "")
    dyn = dyn.groupBy("symbol").agg(F.array_sort(F.collect_set("alias")).alias("dyn"))
    seeds = seed_terms_table(spark).groupBy("symbol").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda s: s["term"]).alias("seed")
    )
    r = requests.withColumn("_sym", normalise_symbol("symbol"))
    j = r.join(dyn.withColumnRenamed("symbol", "_sym"), "_sym", "left").join(seeds.withColumnRenamed("symbol", "_sym"), "_sym", "left")
    empty = F.array().cast("array<string>")
    allt = F.concat(F.coalesce("base", empty), F.coalesce("dyn", empty), F.coalesce("seed", empty))
    terms = F.array_distinct(F.filter(allt, lambda x: x.isNotNull() & (x != "")))
    return j.select("symbol", F.when(F.size(terms) == 0, F.array(F.upper("symbol"))).otherwise(terms).alias("terms"))


# ---------------------------------------------------------------- J10
def resolve_price_symbols(requests: DataFrame, available: DataFrame) -> DataFrame:
    """First candidate of [symbol] + price fallbacks that has data."""
    spark = requests.sparkSession
    chains = price_fallback_table(spark)
    r = requests.select(normalise_symbol("symbol").alias("symbol")).distinct()
    own = r.select("symbol", F.lit(0).alias("rank"), F.col("symbol").alias("candidate"))
    alts = r.join(F.broadcast(chains).where(F.col("rank") > 0), "symbol")
    cand = own.unionByName(alts)
    avail = available.select(F.upper("ticker").alias("candidate")).distinct()
    hit = cand.join(avail, "candidate", "left_semi")
    best = hit.groupBy("symbol").agg(F.min_by("candidate", "rank").alias("resolved"))
    return r.join(best, "symbol", "left")


# ---------------------------------------------------------------- J3 / X11
def search_aliases(sym_aliases: DataFrame, first: DataFrame) -> DataFrame:
    """Alias set used to find a company in text: its aliases plus the
    normalised company name and symbol, blanks dropped (one row per alias)."""
    j = sym_aliases.join(first.select("symbol", "company"), "symbol", "left")
    allv = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array(normalise("company"), normalise("symbol")))
    return j.select("symbol", F.explode(F.array_distinct(F.filter(allv, lambda x: x.isNotNull() & (x != "")))).alias("alias"))


KEY = 8  # bytes of an alias's join key at most
RUN_BITS = 1 << 22  # of the table of alias keys
RUN_BYTES = 2 << 20  # of texts whose runs are looked up together


def _slots(run: np.ndarray, n: int) -> np.ndarray:
    h = run * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(20)) + np.uint64(n * 0x9E3779B9) & np.uint64(RUN_BITS - 1)


def _codes(raw: np.ndarray) -> np.ndarray:
    """The number that the KEY bytes from every place on make (zeros after the end)."""
    padded = np.concatenate([raw, np.zeros(KEY - 1, np.uint8)])
    code = np.zeros(len(raw), np.uint64)
    for j in range(KEY):
        code |= padded[j : j + len(raw)].astype(np.uint64) << np.uint64(8 * j)
    return code


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def alias_keys(aliases: DataFrame) -> DataFrame:
    """(n, run, offset, slot, alias, symbol): each alias under one run of its bytes: the
    whole alias where it is shorter than KEY, else the KEY bytes that the fewest
    aliases share (then the first by number and place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for alias in batch.column(0).to_pylist():
                raw = np.frombuffer(alias.encode(), np.uint8)
                n = min(len(raw), KEY)
                code = _codes(raw)[: len(raw) - n + 1]
                first = np.sort(np.unique(code, return_index=True)[1])
                out += zip([alias] * len(first), [n] * len(first), code[first].view(np.int64).tolist(), first.tolist(), _slots(code[first], n).astype(np.int64).tolist())
            cols = zip(*out) if out else [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["alias", "n", "run", "offset", "slot"])

    a = aliases.select("alias", "symbol").where(F.length("alias") > 0).distinct()
    each = a.select("alias").distinct().mapInArrow(run, "alias string, n int, run long, offset int, slot long")
    shared = each.groupBy("n", "run").agg(F.count(F.lit(1)).alias("c"))
    best = F.min_by(F.struct("n", "run", "offset", "slot"), F.struct("c", "run"))
    rare = each.join(shared, ["n", "run"]).groupBy("alias").agg(best.alias("r"))
    return a.join(rare.select("alias", "r.*"), "alias").select("n", "run", "offset", "slot", "alias", "symbol")


def _key_table(keys: DataFrame):
    """The keys as a bit table, shared with the tasks, and how far an alias reaches
    before and after its key.  Of fixed size: RUN_BITS / 64 rows for each of KEY lengths."""
    found = keys.groupBy("n", F.shiftright("slot", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("b"), F.max("offset").alias("before"), F.max(F.octet_length("alias") - F.col("offset")).alias("after")
    ).toArrow()
    n, w, b, before, after = (found[c].to_numpy() for c in ("n", "w", "b", "before", "after"))
    table = np.zeros(RUN_BITS // 64, np.int64)
    np.bitwise_or.at(table, w, b)
    reach = {int(k): (int(before[n == k].max()), int(after[n == k].max())) for k in np.unique(n)}
    return keys.sparkSession.sparkContext.broadcast((table.tobytes(), reach))


def _key_hits(df: DataFrame, key: str, text_col: str, known) -> DataFrame:
    """(key, n, run, around, at): where a text may hold an alias key, with the bytes
    around it, the key at byte ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, reach = known.value
        table = np.frombuffer(bits, np.uint64)
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                size, end = 0, start
                while end < len(texts) and (end == start or size + len(texts[end]) < RUN_BYTES):
                    size += len(texts[end])
                    end += 1
                data = b"".join(texts[start:end])
                off = np.concatenate([[0], np.cumsum([len(t) for t in texts[start:end]])])
                code = _codes(np.frombuffer(data, np.uint8))
                left = np.repeat(off[1:], np.diff(off)) - np.arange(len(code))
                out: dict[tuple, None] = {}
                for n, (before, after) in reach.items():
                    run_ = code & _mask(n)
                    slot = _slots(run_, n)
                    hit = (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool) & (left >= n)
                    place = np.flatnonzero(hit)
                    own = np.searchsorted(off, place, side="right") - 1
                    low = np.maximum(place - before, off[own])
                    high = np.minimum(place + after, off[own + 1])
                    # of equal surroundings in a text, one
                    for i, p, r, a, b in zip(own.tolist(), place.tolist(), run_[place].view(np.int64).tolist(), low.tolist(), high.tolist()):
                        out[i, n, r, data[a:b], p - a] = None
                cols = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i + start for i in cols[0]], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int32())], names=[key, "n", "run", "around", "at"],
                )
                start = end

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_col).mapInArrow(run, f"`{key}` {kind}, n int, run long, around binary, at int")


def match_text(items: DataFrame, aliases: DataFrame, text_col: str = "combined_norm", key: str = "item_id") -> DataFrame:
    """(item, symbol) pairs where any alias of the symbol is a substring of the
    item text (T18 raw substring semantics).

    Texts that hold an alias hold its key, a run of at most KEY bytes.  Tasks look every
    place of a text up in a bit table of the keys (fixed size, made beforehand from the
    alias dimension; false positives cost time only), so little but true candidates
    leaves Python, each with the few bytes around it.  These meet the keys in an
    equi-join (which Spark broadcasts only after measuring the keys, and splits where a
    key is hot) and are verified at once; texts are never shuffled.  One plan for every
    size.  ``key`` is unique among the items; null texts match nothing."""
    keys = cut_lineage(alias_keys(aliases))  # read twice: for the table and by the join
    hits = _key_hits(items, key, text_col, _key_table(keys))
    name = F.encode("alias", "UTF-8")
    whole = F.substring("around", F.col("at") - F.col("offset") + 1, F.octet_length("alias")) == name
    found = hits.join(keys.drop("slot"), ["n", "run"]).where((F.col("at") >= F.col("offset")) & whole)
    return found.select(key, "symbol").distinct()


def local_news(feed: DataFrame, matches: DataFrame) -> DataFrame:
    """X11 local part: feed rows matched to a symbol, in the news schema."""
    j = feed.join(matches, "item_id")
    return j.select(
        F.col("symbol").alias("ticker"),
        F.col("published_at").alias("seen_datetime"),
        F.to_date("published_at").alias("date"),
        "title",
        F.col("summary").alias("full_text"),
        F.col("link").alias("url"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.col("source_name").alias("source"),
    )


def is_valid_alias(name: Column) -> Column:
    return alias_is_valid(name)

