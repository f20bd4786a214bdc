"""Entity resolution: registry rules (T17), raw substring semantics (T18),
tier order (T19), token order (T20), fuzzy lookup vs a brute-force difflib loop."""
from difflib import get_close_matches

from pyspark.sql import functions as F

from mktlens.operators import entity as E
from mktlens.functions.text import normalise

REG = [
    ("AAPL", "Apple Inc.", "NASDAQ", "apple;яблоко", "r1"),
    ("GOOGL", "Alphabet Inc.", "NASDAQ", "google;alphabet", "r2"),
    ("GOOG", "Alphabet Class C", "NASDAQ", "google", "r3"),
    ("AAPL", "Apple Duplicate", "XETRA", "", "r4"),
    ("T", "AT&T", "NYSE", "at&t", "r5"),
    ("", "Blank", "X", "blank", "r6"),
    ("NVS", " Novartis AG", None, '"novartis, новартис"', "r7"),
]


def registry(spark):
    raw = spark.createDataFrame(REG, "symbol string, company string, exchange string, aliases string, row_key string")
    return E.load_registry(raw, order=F.col("row_key"))


def test_registry_rules(spark):
    reg = registry(spark)
    assert reg.where(F.col("symbol") == "").count() == 0  # blank symbol skipped
    first = {r.symbol: r for r in E.first_by_symbol(reg).collect()}
    assert first["AAPL"].exchange == "NASDAQ"  # first row wins (T17)
    nvs = first["NVS"]
    assert nvs.company == "Novartis AG" and nvs.exchange is None
    assert nvs.aliases == sorted({"novartis", "новартис", "nvs", "novartis ag"})


def test_fuzzy_alias_map_keeps_last_row(spark):
    reg = registry(spark)
    q = spark.createDataFrame([("googl",)], "query string")
    m = E.tier_fuzzy(E.query_tokens(q), reg, 5).collect()
    # 'google' is an alias of GOOGL (row 2) and GOOG (row 3): the last row wins.
    by_alias = {r.symbol for r in m}
    assert "GOOG" in by_alias


def test_raw_substring_match(spark):
    reg = registry(spark)
    items = spark.createDataFrame([(1, "the t shirt"), (2, "apple pie"), (3, "nothing")], "item_id long, combined_norm string")
    al = E.search_aliases(E.symbol_aliases(reg, spark.createDataFrame([], "symbol string, alias string")), E.first_by_symbol(reg))
    hits = {(r.item_id, r.symbol) for r in E.match_text(items, al, "combined_norm", "item_id").collect()}
    # the one-letter symbol matches any text containing 't' (T18)
    assert (1, "T") in hits and (3, "T") in hits and (2, "T") not in hits
    assert (2, "AAPL") in hits and (1, "AAPL") not in hits


def test_tier_order_and_cap(spark):
    reg = registry(spark)
    q = spark.createDataFrame([("aapl",), ("google",), ("alphabet tesla",), ("",)], "query string")
    m = E.resolve_companies(q, reg, count=5, fuzzy=False).collect()
    by_q = {}
    for r in m:
        by_q.setdefault(r.query, []).append(r)
    assert by_q["aapl"][0].symbol == "AAPL" and by_q["aapl"][0].score == 1.0
    g = [r.symbol for r in sorted(by_q["google"], key=lambda r: r.rank)]
    assert g[:2] == ["GOOGL", "GOOG"]  # alias tier in registry order
    t = sorted(by_q["alphabet tesla"], key=lambda r: r.rank)
    assert t[0].symbol == "GOOGL" and any(r.symbol == "TSLA" and r.score == 0.6 for r in t)
    assert "" not in by_q


def test_fuzzy_equals_bruteforce(spark):
    """Pruned candidate join + Spark ranking == difflib.get_close_matches."""
    names = ["apple", "alphabet", "google", "microsoft", "novartis", "amazon", "nvidia", "tesla", "gazprom", "sberbank",
             "yandex", "netflix", "facebook", "meta", "bitcoin", "ethereum", "lukoil", "rosneft", "tinkoff", "alibaba"]
    queries = ["appel", "gogle", "alphabt", "micro soft", "novartys", "amazn", "nvidea", "tesl", "gazprm", "sber", "yandx",
               "netflx", "faceboo", "mta", "bitcon", "etherium", "lukoyl", "rosneft oil", "tinkof", "ali baba", "xyz", "a"]
    reg = spark.createDataFrame([(n.upper()[:4], n, "X", n, f"{i:03d}") for i, n in enumerate(names)],
                                "symbol string, company string, exchange string, aliases string, row_key string")
    reg = E.load_registry(reg, order=F.col("row_key"))
    aliases = sorted({a for r in reg.collect() for a in r.aliases})
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    toks = E.query_tokens(q)
    cand = E.fuzzy_candidates(toks, E.alias_rows(reg)).withColumn("ratio", E.sequence_ratio(F.col("token"), F.col("alias")))
    got = {}
    for r in cand.where(F.col("ratio") >= 0.6).collect():
        got.setdefault(r.token, set()).add(r.alias)
    for t in {r.token for r in toks.collect()}:
        want = set(get_close_matches(t, aliases, n=len(aliases), cutoff=0.6))
        assert got.get(t, set()) == want, t


def test_alias_validity_and_upsert(spark):
    store = spark.createDataFrame([("AAPL", "Apple")], "symbol string, alias string")
    new = spark.createDataFrame([("aapl", " Apple "), ("aapl", "iPhone"), ("aapl", "7"), ("aapl", "3M"), ("aapl", "  ")],
                                "symbol string, alias string")
    out = {(r.alias, r.is_new) for r in E.upsert_aliases(store, new).collect()}
    assert out == {("Apple", False), ("iPhone", True), ("3M", True)}


def test_price_fallback_resolution(spark):
    req = spark.createDataFrame([("^ndx",), ("SPY",), ("ZZZ",)], "symbol string")
    avail = spark.createDataFrame([("QQQ",), ("NDX",), ("SPY",)], "ticker string")
    out = {r.symbol: r.resolved for r in E.resolve_price_symbols(req, avail).collect()}
    assert out == {"^NDX": "QQQ", "SPY": "SPY", "ZZZ": None}


def test_normalise_is_idempotent(spark):
    df = spark.createDataFrame([("  Hello,   World!! ",)], "t string")
    r = df.select(normalise(normalise("t")).alias("n")).first()
    assert r.n == "hello world"


def test_matches_of_a_common_alias_are_cut_before_the_join(spark):
    """A word that many companies share gives each query count + 1 symbols, not all."""
    raw = spark.createDataFrame([(f"S{i % 40:02d}", f"Acme {i:03d}", "X", "acme;inc" if i % 2 else "acme") for i in range(80)], "symbol string, company string, exchange string, aliases string")
    registry = E.load_registry(raw.coalesce(1), order=F.col("company"))
    queries = spark.createDataFrame([("acme",), ("inc acme",), ("S07",), ("zzz",), ("漢字",), ("acme 041",)], "query string")
    toks = E.query_tokens(queries)
    every, cut = E.tier_alias(toks, E.alias_rows(registry)), E.tier_alias(toks, E.alias_rows(registry), 3)
    first = lambda df: {q: [s for _, s in sorted(rows)[:3]] for q, rows in ranks(df).items()}

    def ranks(df):
        out = {}
        for r in df.groupBy("query", "symbol").agg(F.min("ord").alias("ord")).collect():
            out.setdefault(r.query, []).append((r.ord, r.symbol))
        return out

    assert first(cut) == first(every) and cut.where("query = 'acme'").count() == 3
    got = {}
    for r in E.resolve_companies(queries, registry, 3, fuzzy=False).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.symbol, r.tier))
    assert got["acme"] == [("S00", 2), ("S01", 2), ("S02", 2)]
    assert got["inc acme"] == [("S00", 2), ("S01", 2), ("S02", 2)]
    assert got["S07"] == [("S07", 1)] and got["zzz"] == [("ZZZ", 4)] and got["漢字"] == [("漢字", 6)]
