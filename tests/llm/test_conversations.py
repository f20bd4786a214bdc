import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from mktlens.llm import conversations as C

BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out[conv] += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by trying all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @functools.cache
    def best(i, made, inserted):
        """(cost, audit, lines) from row i on; ``made`` is the first letters so far: none, s, or the last one."""
        found = [(0, "", ())] if i == len(rows) and made in ("", "a") else []
        to = "a" if made == "u" else "u"
        name = {"u": "user", "a": "assistant"}[to]
        if inserted < 3:
            c, a, l = best(i, to, inserted + 1)
            found.append((c + 2, "I" + a, (f"{name}:", *l)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, l = best(i + 1, made, 0)
            found.append((c + 3, "D" + a, l))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                c, a, l = best(i + 1, to, 0)
                found.append((c + 2 + late, "R" + a, (f"{name}:{text}", *l)))
                if role[:1] == to or (role[:1], made) == ("s", ""):
                    c, a, l = best(i + 1, role[0], 0)
                    found.append((c + late, "K" + a, (f"{role}:{text}", *l)))
        return min(found) if found else (10**9, "", ())

    cost, audit, text = best(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(x not in ("su", "ua", "au") for x in pairs), cost, audit,
            hashlib.sha256("\n".join(text).encode()).hexdigest())


def brute(rows):
    return sorted(((c, *repaired(r)) for c, r in damaged(rows).items()), key=str)


def run(df):
    return sorted((tuple(r) for r in C.repair(C.damage(df)).collect()), key=str)


def make(n, rng, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None)):
    texts = ["Fine.", "cut", "", " \t", "Why?", "same", "same.", None, "line\nbreak!", "É."]
    return [(i, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}" + rng.choice(["", "."])) for i in range(n)]


@pytest.mark.parametrize("parts", [3, 40])
def test_repair_against_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select("conv_id", "turn", "role", "text").limit(300).collect()]
    for c in range(60):
        rows += [(10**6 + c, t if rng.random() < 0.95 else None, r, x) for t, r, x in make(rng.randrange(1, 9), rng)]
    rows += [(None, t, r, x) for t, r, x in make(50, rng)] + [(-1, t % 5, r, x) for t, r, x in make(150, rng)]
    rows += [(7 * 10**6, i, "user", f"only users {i}.") for i in range(200)]  # vectors never converge
    rows += [(8 * 10**6, i, "user", "the same.") for i in range(200)] + [(8 * 10**6, 200, "assistant", "yes.")]  # rows that go
    rows += [(9 * 10**6 + i, None, "user", None) for i in range(30)] + [(9 * 10**6, 5, "user", "x")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("cid", F.lit("x"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert run(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table_and_dropped_conversation(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert run(df) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = run(spark.createDataFrame([(str(gone), 0, "user", "Hi.")], "conv_id string, turn int, role string, text string"))
    assert got == [(str(gone), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_chunked_vectors_equal_whole_ones():
    rng = random.Random(1)
    for _ in range(300):
        symbols = bytes(rng.choice([0, 0, 1, 3, 3, 4, 5, 6, 7, 8, 255]) for _ in range(rng.randrange(1, 60)))
        at = rng.randrange(len(symbols) + 1)
        left, right = symbols[:at], symbols[at:]
        middle = C.vectors(right, C.ENDS)[0]
        whole = C.vectors(symbols, C.ENDS)
        assert whole[: at + 1] == C.vectors(left, middle)
        guess = rng.choice([C.ENDS, (0, 0, 0, 0), (0, 2, 2, 0)])
        assert C.rerun(left, middle, guess, C.vectors(left, guess)[0]) == whole[0]
        rows, _, cost = C.trace(symbols, whole[1:], 0, True)
        first, s, c1 = C.trace(left, C.vectors(left, middle)[1:], 0, False)
        rest, _, c2 = C.trace(right, C.vectors(right, C.ENDS)[1:], s, True)
        assert (rows, cost) == (first + rest, c1 + c2)


def test_statement_equals_brute_force():
    duckdb = pytest.importorskip("duckdb")
    from mktlens.llm.queries import oracle_sql

    rng = random.Random(11)
    rows = [(c, t if rng.random() < 0.9 else None, r, x) for c in [*range(40), None] for t, r, x in make(rng.randrange(1, 9), rng)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = sorted((tuple(r) for r in con.execute(oracle_sql()["op13_conversation_repair"]).fetchall()), key=str)
    assert got == brute(rows)
