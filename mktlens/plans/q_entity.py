"""Queries: company registry, text functions and entity resolution
(S5, S6, F1-F5, F12, F14, F15, J3-J10, U3, U5, A17, O6, X4, X11)."""
from __future__ import annotations

from pyspark.sql import functions as F

from mktlens.functions import text as TX
from mktlens.functions.exprs import WS
from mktlens.functions.sentiment import FIXTURE_LEXICON
from mktlens.functions.similarity import edit_ratio
from mktlens.operators import entity as E
from mktlens.operators import news as N
from mktlens.plans.registry import register, with_ctes
from mktlens.plans.sqlparts import norm_sql, strip_sql
from mktlens.sources import fixtures as fx

COUNT = 5
AS_OF = "1996-10-01"
DAYS = 60


def _values(rows, cols) -> str:
    def lit(v):
        return "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


FALLBACK_SQL = f"fb AS (SELECT * FROM {_values(E.FALLBACK_SYMBOLS, ['token', 'symbol', 'name'])})"
SEEDS_SQL = "seeds AS (SELECT symbol, unnest(terms) AS term, unnest(range(0, len(terms))) AS pos FROM (VALUES " + ", ".join(
    "('" + s + "', [" + ", ".join("'" + t + "'" for t in terms) + "])" for s, terms in E.QUERY_FALLBACKS
) + ") AS t(symbol, terms))"
PRICE_FB_SQL = "pfb AS (SELECT symbol, unnest(alts) AS candidate, unnest(range(1, len(alts) + 1)) AS rank FROM (VALUES " + ", ".join(
    "('" + s + "', [" + ", ".join("'" + t + "'" for t in alts) + "])" for s, alts in E.PRICE_FALLBACKS
) + ") AS t(symbol, alts))"


def f2_sql(aliases: str, symbol: str, company: str) -> str:
    parts = f"list_transform(string_split_regex(coalesce({aliases}, ''), '[;,]'), lambda x: {norm_sql('x')})"
    allv = f"list_concat({parts}, [{norm_sql(symbol)}, {norm_sql(company)}])"
    return f"list_sort(list_distinct(list_filter({allv}, lambda x: x IS NOT NULL AND x <> '')))"


REG_SQL = f"""reg0 AS (
  SELECT row_number() OVER (ORDER BY row_key) AS row_id,
         upper({strip_sql("coalesce(symbol, '')")}) AS symbol, company AS company_raw, exchange AS exchange_raw, aliases AS aliases_raw
  FROM registry_raw),
reg AS (
  SELECT row_id, symbol,
         {strip_sql("CASE WHEN company_raw IS NULL OR company_raw = '' THEN symbol ELSE company_raw END")} AS company,
         CASE WHEN {strip_sql("coalesce(exchange_raw, '')")} <> '' THEN {strip_sql("coalesce(exchange_raw, '')")} END AS exchange,
         aliases_raw
  FROM reg0 WHERE symbol <> ''),
registry AS (SELECT row_id, symbol, company, exchange, {f2_sql('aliases_raw', 'symbol', 'company')} AS aliases FROM reg),
firstreg AS (SELECT DISTINCT ON (symbol) symbol, row_id, company, exchange, aliases FROM registry ORDER BY symbol, row_id),
arows AS (SELECT row_id, symbol, company, exchange, unnest(aliases) AS alias FROM registry)"""

STORE_SQL = "store AS (SELECT DISTINCT upper(replace(p_name, ' ', '')) AS symbol, p_type AS alias FROM part)"


def registry_df(spark, sf_dir):
    return E.load_registry(fx.registry_raw(spark, sf_dir), order=F.col("row_key"))


def store_df(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    return p.select(F.upper(F.regexp_replace("p_name", " ", "")).alias("symbol"), F.col("p_type").alias("alias")).distinct()


# ---------------------------------------------------------------- S5 / F2 / J4
@register("S5_registry_scan", sql=with_ctes(fx.REGISTRY_RAW_SQL, REG_SQL, body="SELECT symbol, company, exchange, aliases FROM registry"))
def s5_registry_scan(spark, sf_dir):
    """Registry rows: symbol upper/trim, company default, blank exchange -> NULL, alias list (F2)."""
    return registry_df(spark, sf_dir).select("symbol", "company", "exchange", "aliases")


@register("F2_alias_list", sql=with_ctes(fx.REGISTRY_RAW_SQL, REG_SQL, body="SELECT symbol, aliases FROM registry"))
def f2_alias_list(spark, sf_dir):
    """Alias list: split on ; and , + symbol + company, normalised, sorted."""
    return registry_df(spark, sf_dir).select("symbol", "aliases")


@register("J4_symbol_lookup", sql=with_ctes(fx.REGISTRY_RAW_SQL, REG_SQL, fx.QUERIES_SQL, body=f"""SELECT q.query, f.symbol, f.company, f.exchange
FROM queries q JOIN firstreg f ON upper({strip_sql('q.query')}) = f.symbol"""))
def j4_symbol_lookup(spark, sf_dir):
    """Exact symbol lookup, first registry row wins."""
    q = fx.queries(spark, sf_dir).select("query", TX.normalise_symbol("query").alias("symbol"))
    return q.join(E.first_by_symbol(registry_df(spark, sf_dir)), "symbol").select("query", "symbol", "company", "exchange")


# ---------------------------------------------------------------- F1 / F3 / F4 / F5 / F14 / F15
@register("F1_normalise_text", sql=with_ctes(body=f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents"))
def f1_normalise_text(spark, sf_dir):
    """Text normaliser over whole documents."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", TX.normalise("text").alias("norm"))


COMBINED_SQL = norm_sql("coalesce(title, '')") + " || ' ' || " + norm_sql("coalesce(summary, '')")


@register("F3_search_text", sql=with_ctes(fx.NEWS_SQL, fx.FEED_SQL, body=f"SELECT doc_id, {COMBINED_SQL} AS combined_norm FROM feed"))
def f3_search_text(spark, sf_dir):
    """Normalised title + space + normalised summary."""
    return fx.feed(spark, sf_dir).select("doc_id", TX.search_text("title", "summary").alias("combined_norm"))


CAND_SQL = """list_transform(list_sort(list_transform(list_distinct(list_transform(list_filter(
    string_split_regex(trim(regexp_replace(coalesce(query, ''), '[^0-9A-Za-z. ]+', ' ', 'g')), ' +'),
    lambda t: regexp_full_match(t, '[A-Za-z0-9]{1,10}(\\.[A-Za-z0-9]{1,3})?') OR (regexp_matches(t, '[A-Za-z]') AND length(t) <= 12)),
    lambda t: upper(t))), lambda t: {'n': length(t), 't': t})), lambda s: s.t)"""


@register("F4_candidate_symbols", sql=with_ctes(fx.QUERIES_SQL, body=f"SELECT query, {CAND_SQL} AS candidates FROM queries"))
def f4_candidate_symbols(spark, sf_dir):
    """Candidate ticker tokens ordered by (length, text)."""
    return fx.queries(spark, sf_dir).select("query", TX.candidate_symbols("query").alias("candidates"))


CLEAN_Q_SQL = f"""array_to_string(list_filter(string_split_regex({strip_sql(
    "regexp_replace(" + strip_sql("regexp_replace(" + strip_sql("coalesce(q, '')") + ", '^(?i)(/start|/help|/predict|/news)', '')") + ", '[@#,;|\\n\\t]', ' ', 'g')")}, '{WS}+'),
  lambda x: length(x) > 0 AND NOT starts_with(x, '/') AND (regexp_matches(x, '\\p{{L}}') OR regexp_full_match(x, '\\p{{Nd}}+'))), ' ')"""


@register("F5_clean_query", sql=with_ctes(fx.QUERIES_SQL, body=f"""SELECT q AS query, {CLEAN_Q_SQL} AS cleaned
FROM (SELECT query AS q FROM queries UNION ALL SELECT '/predict ' || query FROM queries)"""))
def f5_clean_query(spark, sf_dir):
    """Free-text clean-up: command prefix, separators, token filter."""
    q = fx.queries(spark, sf_dir)
    q = q.unionAll(q.select(F.concat(F.lit("/predict "), "query").alias("query")))
    return q.select("query", TX.clean_query("query").alias("cleaned"))


@register("F14_symbol_normalise", sql=with_ctes(fx.QUERIES_SQL, body=f"""SELECT query, upper({strip_sql('query')}) AS symbol
FROM (SELECT query FROM queries UNION ALL SELECT '\u00a0\t' || query || ' \u3000\x1f' FROM queries)"""))
def f14_symbol_normalise(spark, sf_dir):
    """Symbol normalise: trim (every kind of white space) + upper."""
    q = fx.queries(spark, sf_dir).select("query")
    padded = q.select(F.concat(F.lit("\u00a0\t"), "query", F.lit(" \u3000\x1f")).alias("query"))
    return q.unionByName(padded).select("query", TX.normalise_symbol("query").alias("symbol"))


@register("F15_alias_validity", sql=with_ctes(fx.QUERIES_SQL, STORE_SQL, body=f"""SELECT name,
  {strip_sql('name')} IS NOT NULL AND length({strip_sql('name')}) > 0 AND (regexp_matches({strip_sql('name')}, '\\p{{L}}') OR length({strip_sql('name')}) > 1) AS valid
FROM (SELECT query AS name FROM queries UNION ALL SELECT alias FROM store UNION ALL SELECT substr(query, 1, 1) FROM queries
      UNION ALL SELECT CAST(length(query) % 10 AS VARCHAR) FROM queries)"""))
def f15_alias_validity(spark, sf_dir):
    """Alias validity: non-blank and (a letter or longer than one character)."""
    q = fx.queries(spark, sf_dir)
    names = (
        q.select(F.col("query").alias("name"))
        .unionAll(store_df(spark, sf_dir).select("alias"))
        .unionAll(q.select(F.substring("query", 1, 1)))
        .unionAll(q.select((F.length("query") % 10).cast("string")))
    )
    return names.select("name", TX.alias_is_valid(F.col("name")).alias("valid"))


# ---------------------------------------------------------------- X4 and tiers
TOKENS_SQL = f"""q AS (SELECT DISTINCT {strip_sql('query')} AS query FROM queries WHERE {strip_sql('query')} <> ''),
toks AS (
  SELECT query, token, min(pos) AS pos FROM (
    SELECT query, {norm_sql('query')} AS token, 0 AS pos FROM q
    UNION ALL
    SELECT query, {norm_sql('part')} AS token, pos FROM (
      SELECT query, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS pos
      FROM (SELECT query, string_split_regex({strip_sql("replace(query, '/', ' ')")}, '{WS}+') AS parts FROM q)))
  WHERE token <> '' GROUP BY query, token)"""

TIERS_SQL = f"""t1 AS (
  SELECT q.query, f.symbol, f.company AS shortname, f.company AS longname, f.exchange, CAST(1.0 AS DOUBLE) AS score, 1 AS tier, CAST(0 AS BIGINT) AS ord
  FROM q JOIN firstreg f ON upper(q.query) = f.symbol),
t2 AS (
  SELECT query, symbol, company AS shortname, company AS longname, exchange, CAST(0.9 AS DOUBLE) AS score, 2 AS tier, CAST(row_id AS BIGINT) AS ord
  FROM (SELECT DISTINCT t.query, a.row_id, a.symbol, a.company, a.exchange FROM toks t JOIN arows a ON t.token = a.alias)),
cands AS (SELECT query, unnest(c) AS token, unnest(range(0, len(c))) AS cpos FROM (SELECT query, {CAND_SQL} AS c FROM q)),
t4 AS (
  SELECT c.query, fb.symbol, coalesce(f.company, fb.name) AS shortname, coalesce(f.company, fb.name) AS longname, f.exchange,
         CASE WHEN f.row_id IS NOT NULL THEN CAST(0.88 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS score, 4 AS tier, CAST(c.cpos AS BIGINT) AS ord
  FROM cands c JOIN fb ON c.token = fb.token LEFT JOIN firstreg f ON f.symbol = fb.symbol
  UNION ALL
  SELECT c.query, c.token AS symbol, coalesce(f.company, c.token), coalesce(f.company, c.token), f.exchange,
         CASE WHEN f.row_id IS NOT NULL THEN CAST(0.85 AS DOUBLE) END, 4, CAST(c.cpos AS BIGINT)
  FROM cands c LEFT JOIN firstreg f ON f.symbol = c.token
  WHERE c.token NOT IN (SELECT token FROM fb)),
u0 AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t4),
u1 AS (SELECT * FROM u0 QUALIFY row_number() OVER (PARTITION BY query, symbol ORDER BY tier, ord) = 1),
t6 AS (
  SELECT query, coalesce(fb.symbol, tok) AS symbol, coalesce(fb.name, tok) AS shortname, coalesce(fb.name, tok) AS longname,
         CAST(NULL AS VARCHAR) AS exchange, CASE WHEN fb.symbol IS NOT NULL THEN CAST(0.6 AS DOUBLE) END AS score, 6 AS tier, CAST(0 AS BIGINT) AS ord
  FROM (SELECT query, upper(replace(query, ' ', '')) AS tok FROM q
        WHERE query NOT IN (SELECT query FROM u1) AND regexp_full_match(replace(query, ' ', ''), '[\\p{{L}}\\p{{N}}]{{1,12}}')) x
  LEFT JOIN fb ON fb.token = x.tok),
matches AS (
  SELECT query, CAST(rank AS INTEGER) AS rank, symbol, shortname, longname, exchange, score, tier FROM (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, ord, symbol) AS rank FROM (SELECT * FROM u1 UNION ALL SELECT * FROM t6))
  WHERE rank <= {COUNT})"""

X4_CTES = (fx.REGISTRY_RAW_SQL, REG_SQL, fx.QUERIES_SQL, FALLBACK_SQL, TOKENS_SQL, TIERS_SQL)


def _matches(spark, sf_dir, fuzzy=False):
    return E.resolve_companies(fx.queries(spark, sf_dir), registry_df(spark, sf_dir), COUNT, fuzzy=fuzzy)


@register("X4_resolve_companies", sql=with_ctes(*X4_CTES, body="SELECT * FROM matches"), dbl=("score",))
def x4_resolve_companies(spark, sf_dir):
    """Free text -> up to 5 companies: exact symbol, alias, candidate tokens, compact fallback (no fuzzy tier)."""
    return _matches(spark, sf_dir, fuzzy=False)


@register("X4_resolve_companies_fuzzy", dbl=("score",))
def x4_resolve_companies_fuzzy(spark, sf_dir):
    """As X4 with the fuzzy alias tier (difflib ratio >= 0.6); rows-only check."""
    return _matches(spark, sf_dir, fuzzy=True)


@register("J5_alias_lookup", sql=with_ctes(*X4_CTES, body="SELECT query, symbol, shortname AS company FROM t2"))
def j5_alias_lookup(spark, sf_dir):
    """Records having any normalised query token among their aliases."""
    q = fx.queries(spark, sf_dir).select(TX.strip_ws("query").alias("query")).where(F.col("query") != "").distinct()
    t = E.tier_alias(E.query_tokens(q), E.alias_rows(registry_df(spark, sf_dir)))
    return t.select("query", "symbol", F.col("shortname").alias("company"))


@register("J7_candidate_lookup", sql=with_ctes(*X4_CTES, body="SELECT query, symbol, shortname, exchange, score, ord AS cpos FROM t4"), dbl=("score",))
def j7_candidate_lookup(spark, sf_dir):
    """Candidate tokens resolved via fallbacks (0.88 / 0.6) and the registry (0.85); unresolved NULL."""
    q = fx.queries(spark, sf_dir).select(TX.strip_ws("query").alias("query")).where(F.col("query") != "").distinct()
    reg = registry_df(spark, sf_dir)
    t = E.tier_candidates(q, E.first_by_symbol(reg), E.fallback_table(spark))
    return t.select("query", "symbol", "shortname", "exchange", "score", F.col("ord").alias("cpos"))


@register("J8_compact_fallback", sql=with_ctes(*X4_CTES, body="SELECT query, symbol, shortname, score FROM t6"), dbl=("score",))
def j8_compact_fallback(spark, sf_dir):
    """Compact fallback for queries nothing else matched."""
    m = x4_resolve_companies(spark, sf_dir)
    return m.where(F.col("tier") == 6).select("query", "symbol", "shortname", "score")


@register("U3_tier_dedupe", sql=with_ctes(*X4_CTES, body="SELECT query, symbol, tier FROM u1"))
def u3_tier_dedupe(spark, sf_dir):
    """Symbol dedupe across tiers, first tier wins (before the cap)."""
    q = fx.queries(spark, sf_dir).select(TX.strip_ws("query").alias("query")).where(F.col("query") != "").distinct()
    reg = registry_df(spark, sf_dir)
    first = E.first_by_symbol(reg)
    u = (
        E.tier_exact_symbol(q, first)
        .unionByName(E.tier_alias(E.query_tokens(q), E.alias_rows(reg)))
        .unionByName(E.tier_candidates(q, first, E.fallback_table(spark)))
    )
    from pyspark.sql import Window

    w = Window.partitionBy("query", "symbol").orderBy("tier", "ord")
    return u.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).select("query", "symbol", "tier")


@register("O6_match_cap", sql=with_ctes(*X4_CTES, body="SELECT query, count(*) AS n_matches, max(rank) AS last_rank FROM matches GROUP BY query"))
def o6_match_cap(spark, sf_dir):
    """Matches per query after the cap of 5."""
    m = x4_resolve_companies(spark, sf_dir)
    return m.groupBy("query").agg(F.count(F.lit(1)).alias("n_matches"), F.max("rank").alias("last_rank"))


# ---------------------------------------------------------------- J6 / F12
@register("J6_fuzzy_alias_lookup", dbl=("ratio",))
def j6_fuzzy_alias_lookup(spark, sf_dir):
    """Per query token, top 5 aliases with difflib ratio >= 0.6 (pruned candidate join); rows-only."""
    q = fx.queries(spark, sf_dir).select(TX.strip_ws("query").alias("query")).where(F.col("query") != "").distinct()
    reg = registry_df(spark, sf_dir)
    toks = E.query_tokens(q)
    cand = E.fuzzy_candidates(toks, E.alias_rows(reg)).withColumn("ratio", E.sequence_ratio(F.col("token"), F.col("alias")))
    cand = cand.where(F.col("ratio") >= E.FUZZY_CUTOFF)
    from pyspark.sql import Window

    w = Window.partitionBy("query", "pos").orderBy(F.col("ratio").desc(), F.col("alias").desc())
    return cand.withColumn("k", F.row_number().over(w)).where(F.col("k") <= COUNT).select("query", "token", "alias", "ratio", "k")


@register("F12_sequence_ratio", dbl=("ratio",))
def f12_sequence_ratio(spark, sf_dir):
    """difflib ratio of every query token and alias that the exact pruning of J6 leaves (rows-only)."""
    q = fx.queries(spark, sf_dir).select(TX.strip_ws("query").alias("query")).where(F.col("query") != "").distinct()
    pairs = E.fuzzy_candidates(E.query_tokens(q), E.alias_rows(registry_df(spark, sf_dir))).select("token", "alias").distinct()
    return pairs.select("token", "alias", E.sequence_ratio(F.col("token"), F.col("alias")).alias("ratio"))


@register("J6_edit_ratio_lookup", sql=with_ctes(*X4_CTES, body="""SELECT query, token, alias, ratio, CAST(k AS INTEGER) AS k FROM (
  SELECT query, pos, token, alias, ratio, row_number() OVER (PARTITION BY query, pos ORDER BY ratio DESC, alias DESC) AS k
  FROM (SELECT t.query, t.pos, t.token, a.alias,
               1.0 - levenshtein(t.token, a.alias) / greatest(length(t.token), length(a.alias)) AS ratio
        FROM toks t JOIN (SELECT DISTINCT alias FROM arows) a
          ON length(a.alias) BETWEEN ceil(length(t.token) * 0.6 / 1.4) AND floor(length(t.token) * 1.4 / 0.6))
  WHERE ratio >= 0.6)
WHERE k <= 5"""), dbl=("ratio",))
def j6_edit_ratio_lookup(spark, sf_dir):
    """Edit-distance variant of the fuzzy lookup (1 - levenshtein / max length >= 0.6), top 5 per token."""
    q = fx.queries(spark, sf_dir).select(TX.strip_ws("query").alias("query")).where(F.col("query") != "").distinct()
    toks = E.query_tokens(q)
    la = F.length("token")
    t = toks.withColumn("lb", F.explode(F.sequence(F.ceil(la * 0.6 / 1.4).cast("int"), F.floor(la * 1.4 / 0.6).cast("int"))))
    al = E.alias_rows(registry_df(spark, sf_dir)).select("alias").distinct().withColumn("lb", F.length("alias"))
    p = t.join(al, "lb").withColumn("ratio", edit_ratio(F.col("token"), F.col("alias"))).where(F.col("ratio") >= 0.6)
    from pyspark.sql import Window

    w = Window.partitionBy("query", "pos").orderBy(F.col("ratio").desc(), F.col("alias").desc())
    return p.withColumn("k", F.row_number().over(w)).where(F.col("k") <= COUNT).select("query", "token", "alias", "ratio", "k")


# ---------------------------------------------------------------- J9 / U5 / A17 / S6 / J10
J9_SQL = f"""dyn AS (
  SELECT symbol, list_distinct(list(a)) AS dyn FROM (
    SELECT symbol, {norm_sql('alias')} AS a FROM (
      SELECT upper({strip_sql('symbol')}) AS symbol, alias FROM store UNION ALL SELECT symbol, term FROM seeds))
  WHERE a <> '' GROUP BY symbol),
symal AS (
  SELECT coalesce(f.symbol, d.symbol) AS symbol,
         list_sort(list_distinct(list_concat(coalesce(f.aliases, []), coalesce(d.dyn, [])))) AS aliases
  FROM (SELECT symbol, aliases FROM firstreg) f FULL OUTER JOIN dyn d ON f.symbol = d.symbol)"""


def _sym_aliases(spark, sf_dir):
    return E.symbol_aliases(registry_df(spark, sf_dir), store_df(spark, sf_dir))


@register("J9_symbol_aliases", sql=with_ctes(fx.REGISTRY_RAW_SQL, REG_SQL, STORE_SQL, SEEDS_SQL, J9_SQL, body="SELECT * FROM symal"))
def j9_symbol_aliases(spark, sf_dir):
    """Registry aliases ∪ normalised alias-store names ∪ seed terms, per symbol."""
    return _sym_aliases(spark, sf_dir)


@register("U5_query_terms", sql=with_ctes(*X4_CTES, STORE_SQL, SEEDS_SQL, J9_SQL, body="""SELECT m.query, m.symbol,
  list_sort(list_distinct(list_filter(list_concat([upper(m.symbol), m.shortname, m.longname], coalesce(s.aliases, [])),
                                      lambda x: x IS NOT NULL AND x <> ''))) AS terms
FROM matches m LEFT JOIN symal s ON m.symbol = s.symbol"""))
def u5_query_terms(spark, sf_dir):
    """Query term set per match: symbol ∪ names ∪ aliases, sorted."""
    return E.query_terms(x4_resolve_companies(spark, sf_dir), _sym_aliases(spark, sf_dir))


@register("U5_fallback_terms", sql=with_ctes(fx.REGISTRY_RAW_SQL, REG_SQL, STORE_SQL, SEEDS_SQL, f"""req AS (
  SELECT symbol, [company] AS base FROM firstreg UNION ALL SELECT DISTINCT symbol, CAST([] AS VARCHAR[]) FROM seeds),
d AS (SELECT symbol, list_sort(list_distinct(list(a))) AS dyn FROM (
        SELECT upper({strip_sql('symbol')}) AS symbol, {strip_sql('alias')} AS a FROM store) WHERE a <> '' GROUP BY symbol),
s AS (SELECT symbol, list(term ORDER BY pos) AS seed FROM seeds GROUP BY symbol)""", body=f"""SELECT symbol,
  CASE WHEN len(t) = 0 THEN [upper(symbol)] ELSE t END AS terms
FROM (SELECT req.symbol, list_filter(l, lambda x, i: list_position(l, x) = i) AS t
      FROM (SELECT req.symbol, list_filter(list_concat(coalesce(base, []), coalesce(dyn, []), coalesce(seed, [])),
                                           lambda x: x IS NOT NULL AND x <> '') AS l
      FROM req LEFT JOIN d ON upper({strip_sql('req.symbol')}) = d.symbol LEFT JOIN s ON upper({strip_sql('req.symbol')}) = s.symbol) req)"""))
def u5_fallback_terms(spark, sf_dir):
    """Ordered fallback terms: base terms, then dynamic aliases, then seeds; default [symbol]."""
    first = E.first_by_symbol(registry_df(spark, sf_dir)).select("symbol", F.array("company").alias("base"))
    seeds = E.seed_terms_table(spark).select("symbol").distinct().withColumn("base", F.array().cast("array<string>"))
    return E.fallback_terms(first.unionByName(seeds), store_df(spark, sf_dir))


@register("A17_alias_upsert", sql=with_ctes(*X4_CTES, STORE_SQL, f"""newa AS (
  SELECT DISTINCT upper({strip_sql('symbol')}) AS symbol, {strip_sql('alias')} AS alias FROM (
    SELECT symbol, query AS alias FROM matches UNION ALL SELECT symbol, shortname FROM matches)
  WHERE upper({strip_sql('symbol')}) <> '' AND {strip_sql('alias')} IS NOT NULL AND length({strip_sql('alias')}) > 0
    AND (regexp_matches({strip_sql('alias')}, '\\p{{L}}') OR length({strip_sql('alias')}) > 1)),
olda AS (SELECT DISTINCT symbol, alias FROM store)""", body="""SELECT symbol, alias, false AS is_new FROM olda
UNION ALL
SELECT n.symbol, n.alias, true AS is_new FROM newa n ANTI JOIN olda o ON n.symbol = o.symbol AND n.alias = o.alias"""))
def a17_alias_upsert(spark, sf_dir):
    """Alias store upsert from accepted matches; is_new marks added names."""
    new = E.registered_aliases(x4_resolve_companies(spark, sf_dir))
    return E.upsert_aliases(store_df(spark, sf_dir), new)


@register("S6_alias_store_read", sql=with_ctes(STORE_SQL, SEEDS_SQL, f"""d AS (
  SELECT upper({strip_sql('symbol')}) AS symbol, {strip_sql('alias')} AS alias FROM store UNION ALL SELECT symbol, term FROM seeds)""",
    body="SELECT symbol, list_sort(list_distinct(list(alias))) AS aliases FROM d WHERE alias <> '' GROUP BY symbol"))
def s6_alias_store_read(spark, sf_dir):
    """Alias store (store ∪ seeds) written folded to symbol -> sorted names and read back."""
    from mktlens.plans.q_models import scratch

    seeds = E.seed_terms_table(spark).select("symbol", F.col("term").alias("alias"))
    path = scratch(spark, "alias-store")
    E.write_alias_store(store_df(spark, sf_dir).unionByName(seeds), path)
    back = E.read_alias_store(spark, path)
    return E.fold_alias_store(back)


@register("J10_price_fallbacks", sql=with_ctes(fx.BARS_SQL, fx.NEWS_SQL, PRICE_FB_SQL, f"""r AS (
  SELECT DISTINCT upper({strip_sql('symbol')}) AS symbol FROM (SELECT ticker AS symbol FROM news UNION ALL SELECT symbol FROM pfb)),
cand AS (SELECT symbol, 0 AS rank, symbol AS candidate FROM r
         UNION ALL SELECT r.symbol, p.rank, upper(p.candidate) FROM r JOIN pfb p ON r.symbol = p.symbol),
avail AS (SELECT DISTINCT upper(ticker) AS candidate FROM bars)""", body="""SELECT r.symbol, b.resolved FROM r LEFT JOIN (
  SELECT symbol, arg_min(candidate, rank) AS resolved FROM cand WHERE candidate IN (SELECT candidate FROM avail) GROUP BY symbol) b
ON r.symbol = b.symbol"""))
def j10_price_fallbacks(spark, sf_dir):
    """First of [symbol] + price fallbacks that has bars."""
    req = fx.news(spark, sf_dir).select(F.col("ticker").alias("symbol")).unionByName(
        E.price_fallback_table(spark).select("symbol")
    )
    return E.resolve_price_symbols(req, fx.bars(spark, sf_dir))


# ---------------------------------------------------------------- J3 / X11
FEED_ITEMS_SQL = f"""items AS (
  SELECT doc_id AS item_id, TRY_CAST(published_at AS TIMESTAMP) AS published_at, coalesce(title, '') AS title,
         coalesce(summary, '') AS summary, link, source_name, language,
         {norm_sql("coalesce(title, '')")} || ' ' || {norm_sql("coalesce(summary, '')")} AS combined_norm
  FROM feed WHERE TRY_CAST(published_at AS TIMESTAMP) IS NOT NULL),
salias AS (
  SELECT symbol, unnest(list_distinct(list_filter(list_concat(coalesce(aliases, []), [{norm_sql('company')}, {norm_sql('symbol')}]),
                                                  lambda x: x IS NOT NULL AND x <> ''))) AS alias
  FROM (SELECT s.symbol, s.aliases, f.company FROM symal s LEFT JOIN firstreg f ON s.symbol = f.symbol)),
hits AS (SELECT DISTINCT i.item_id, a.symbol FROM items i JOIN salias a ON instr(i.combined_norm, a.alias) > 0)"""

J3_CTES = (fx.NEWS_SQL, fx.FEED_SQL, fx.REGISTRY_RAW_SQL, REG_SQL, STORE_SQL, SEEDS_SQL, J9_SQL, FEED_ITEMS_SQL)


def feed_items(spark, sf_dir):
    """S4-conformed feed items with the combined normalised search text."""
    from mktlens.sources.readers import conform_feed

    f = conform_feed(fx.feed(spark, sf_dir).withColumnRenamed("doc_id", "item_id"))
    return f.withColumn("combined_norm", TX.search_text("title", "summary"))


def _aliases_for_search(spark, sf_dir):
    return E.search_aliases(_sym_aliases(spark, sf_dir), E.first_by_symbol(registry_df(spark, sf_dir)))


@register("J3_alias_text_match", sql=with_ctes(*J3_CTES, body="SELECT item_id, symbol FROM hits"), bench=True)
def j3_alias_text_match(spark, sf_dir):
    """Feed items x companies where any company alias is a substring of the normalised text."""
    return E.match_text(feed_items(spark, sf_dir), _aliases_for_search(spark, sf_dir), "combined_norm", "item_id")


X11_BODY = f"""SELECT symbol AS ticker, published_at AS seen_datetime, CAST(published_at AS DATE) AS date, title, full_text, url,
  language, source, sentiment_score, {fx.label_sql('sentiment_score')} AS sentiment_label, CAST(NULL AS VARCHAR) AS detected_language
FROM (SELECT h.symbol, i.published_at, i.title, i.summary AS full_text, i.link AS url, coalesce(i.language, '') AS language,
             i.source_name AS source, {fx.lexicon_score_sql('i.summary')} AS sentiment_score
      FROM hits h JOIN items i ON h.item_id = i.item_id
      WHERE i.published_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY)"""


@register("X11_company_news", sql=with_ctes(*J3_CTES, body=X11_BODY), dbl=("sentiment_score",))
def x11_company_news(spark, sf_dir):
    """Per company: feed items of the last 60 days before as_of whose text mentions an alias, annotated."""
    items = feed_items(spark, sf_dir)
    recent = N.recent(items, F.lit(AS_OF).cast("timestamp"), DAYS, "published_at")
    hits = E.match_text(recent, _aliases_for_search(spark, sf_dir), "combined_norm", "item_id")
    local = E.local_news(recent, hits)
    return N.annotate_news(local, "full_text", FIXTURE_LEXICON)


@register("S17_feed_company_news", sql=with_ctes(*J3_CTES, body=f"""SELECT ticker, seen_datetime, date, title, url, language, source, sentiment_label
FROM ({X11_BODY})"""))
def s17_feed_company_news(spark, sf_dir):
    """Feed items -> per-company news of the last 60 days, in the news schema."""
    n = x11_company_news(spark, sf_dir)
    return n.select("ticker", "seen_datetime", "date", "title", "url", "language", "source", "sentiment_label")
