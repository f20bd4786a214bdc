"""The registered queries of this package: thin calls of its operators over whole
tables, and DuckDB SQL for those that it can express."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktlens.llm import automata, conversations, decontamination, html, iblt, language, packing, phrases, sharding, simhash, suffix, tokens, warc
from mktlens.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.held_out("doc_id")
    model = language.train(docs.where(~held_out))
    # the rows that are predicted carry nothing but the id (for the flag) and the text
    return language.identify(docs, model).withColumn("held_out", held_out)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"), length=200, with_text=False)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # the archives are stored in the shared folder, then read back from there
    archives = cut_lineage(warc.write_archives(pages))
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(archives, with_payload=False).select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "target_uri",
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3).drop("fp")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=5, threshold=100, top=2000)


def op12_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.remove_repeats(table(spark, sf_dir, "documents"), n=13, with_text=False)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_token_counts, op2_sharding, op3_main_text, op4_packing, op5_language_id, op6_fingerprints, op7_decontamination,
        op8_suffix_dedup, op9_warc, op10_simhash, op11_collocations, op12_automata_dedup,
        op13_conversation_repair,
    )}


WORDS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

DECONTAMINATION_SQL = f"""WITH i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, win FROM (SELECT item_id, n, w[j:j + n - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM i))),
d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_SQL} AS w FROM documents),
dw AS (SELECT r, n, j, w[j:j + n - 1] AS win FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT r, j, n, item_id FROM dw JOIN iw USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(j, j + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

# base32: ten hex digits are eight characters of five bits
BASE32_SQL = """array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((CAST('0x' || substr(h, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31), 1)), '')"""

WARC_SQL = f"""WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {BASE32_SQL} AS payload_digest, CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to, url AS target_uri FROM p"""


AUTOMATA_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, j, w[j:j + 12] AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS j FROM d)),
hit AS (SELECT r, j FROM win JOIN (SELECT win, min(doc_id) AS least FROM win GROUP BY win) USING (win) WHERE least < doc_id),
cut AS (SELECT DISTINCT r, unnest(range(j, j + 13)) AS p FROM hit),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN cut USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


COLLOCATIONS_SQL = """WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cut AS (SELECT lang, k, phrase, a, c, array_to_string(ws[1:c], ' ') AS x, array_to_string(ws[c + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM c)),
scored AS (SELECT cut.lang, cut.k, cut.phrase, cut.a, cut.c, l.a AS l, r.a AS r, n, CAST((CAST(1000 AS HUGEINT) * cut.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y JOIN total ON total.lang = cut.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored),
kept AS (SELECT * FROM lowest s WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = s.lang AND b.k > s.k AND 100 * b.a >= 100 * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000"""


def _repair_sql() -> str:
    """The cheapest edits from the last row to the first: a row's states hold (cost,
    letters, lines) to the end, the least of which is the least audit too."""
    after, then = {"n": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    def least(found: list[str]) -> str:
        return f"list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))[1]"

    def made(x: str, cost: str, letter: str, line: str | None) -> str:
        return f"{{'c': {x}.c + {cost}, 'a': '{letter}' || {x}.a, 't': {f'list_prepend({line}, {x}.t)' if line else f'{x}.t'}}}"

    own, closed = [], []
    for s, to in after.items():
        found = [made(f"r.{s}", "3", "D", None), f"CASE WHEN NOT blank AND NOT dup THEN {made(f'r.{to}', '(2 + late)', 'R', f"""'{then[to]}:' || text""")} END"]
        found += [f"CASE WHEN NOT blank AND NOT dup AND ini = '{x}' THEN {made(f'r.{x}', 'late', 'K', "role || ':' || text")} END" for x in ([to] if s != "n" else [to, "s"])]
        own.append(f"{least(found)} AS {s}")
        once = made(to, "2", "I", f"'{then[to]}:'")
        twice = f"{{'c': {after[to]}.c + 4, 'a': 'II' || {after[to]}.a, 't': list_concat(['{then[to]}:', '{then[after[to]]}:'], {after[to]}.t)}}"
        closed.append(f"{least([s, once, twice])} AS {s}")
    nothing = "{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
raw AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM keyed, crc),
live AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)) FROM raw)),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS occ, rtrim(text, {blanks}) AS core, substr(role, 1, 1) AS ini
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM live)),
f AS (SELECT *, core = '' AS blank, core <> '' AND occ > 1 AS dup, CAST(core <> '' AND occ = 1 AND right(core, 1) NOT IN ('.', '!', '?') AS INTEGER) AS late,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS up FROM pos),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  CAST(sum(late) AS BIGINT) AS truncated, count(*) FILTER (up IS NOT NULL AND up || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
rec AS (SELECT conv_id, n AS i, {nothing} AS n, {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}} AS s, {{'c': 2, 'a': 'I', 't': ['assistant:']}} AS u, {nothing} AS a FROM counts
  UNION ALL SELECT conv_id, i - 1, {', '.join(closed)} FROM (SELECT r.conv_id, r.i, {', '.join(own)} FROM rec r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i)),
ends AS (SELECT conv_id, n FROM rec WHERE i = 0)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.n.c, 0) AS BIGINT) AS cost, coalesce(e.n.a, '') AS audit, sha256(coalesce(array_to_string(e.n.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM d.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": DECONTAMINATION_SQL, "op9_warc": WARC_SQL, "op11_collocations": COLLOCATIONS_SQL, "op12_automata_dedup": AUTOMATA_SQL, "op13_conversation_repair": _repair_sql()}
