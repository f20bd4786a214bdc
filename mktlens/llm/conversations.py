"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation is a path through four states (nothing yet, after system, after
user, after assistant) that ends in the first or the last.  Costs to the end are
vectors over the states.  Decisions depend on the differences inside a vector only,
so vectors are kept less their least entry: there are few different ones, and two
that differ by a constant are the same.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mktlens.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant.
NEXT = (2, 2, 3, 2)  # the state after an inserted or rerolled row
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 2 * INSERT, INSERT, 0)
#: A row's symbol: it is not there; it must go; else 1 + 2 * role + truncated, the
#: role being system, user, assistant or another by its first letter.
ABSENT, GOES = 255, 0
ENTERS = (((0, 1),), ((0, 2), (1, 2), (3, 2)), ((2, 3),), ())  # by role: states before and after a kept row

Vector = tuple[int, int, int, int]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}


def _choices(after: Vector, symbol: int, s: int) -> list[tuple[str, int, int]]:
    """(letter, cost to the end, next state) of the edits of a row in state s."""
    out = [("D", DELETE + after[s], s)]
    if symbol != GOES:
        late = TRUNCATED * ((symbol - 1) & 1)
        out += [("K", KEEP + late + after[b], b) for a, b in ENTERS[(symbol - 1) >> 1] if a == s]
        out.append(("R", REROLE + late + after[NEXT[s]], NEXT[s]))
    return out


@lru_cache(maxsize=1 << 16)
def _costs(after: Vector, symbol: int) -> Vector:
    """Costs to the end before a row, from those after it."""
    own = [min(c for _, c, _ in _choices(after, symbol, s)) for s in range(4)]
    return tuple(min(own[s], INSERT + own[NEXT[s]], 2 * INSERT + own[NEXT[NEXT[s]]]) for s in range(4))


@lru_cache(maxsize=1 << 16)
def before(after: Vector, symbol: int) -> Vector:
    """The vector before a row, less its least entry."""
    if symbol == ABSENT:
        return after
    costs = _costs(after, symbol)
    return tuple(c - min(costs) for c in costs)


@lru_cache(maxsize=1 << 16)
def edits(after: Vector, symbol: int, s: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits up to and with a row in state s: (the
    letters, the state after it)."""
    if symbol == ABSENT:
        return "", s
    costs, letters = _costs(after, symbol), ""
    while True:
        best = [(letter, to) for letter, c, to in _choices(after, symbol, s) if c == costs[s]]
        if INSERT + costs[NEXT[s]] == costs[s]:
            best.append(("I", NEXT[s]))
        letter, to = min(best)
        letters, s = letters + letter, to
        if letter != "I":
            return letters, s


def vectors(symbols: bytes, right: Vector) -> list[Vector]:
    """The vector after every row of a chunk, and before its first (the first entry)."""
    out = [right]
    for x in reversed(symbols):
        out.append(before(out[-1], x))
    return out[::-1]


def rerun(symbols: bytes, right: Vector, old_right: Vector, old_left: Vector) -> Vector:
    """The vector before a chunk from another vector after it: rows are run again
    until the vectors differ from the old ones by a constant only."""
    new, old = right, old_right
    for x in reversed(symbols):
        if new == old:
            return old_left
        new, old = before(new, x), before(old, x)
    return new


def trace(symbols: bytes, after: list[Vector], s: int, last: bool) -> tuple[list[str], int, int]:
    """From state s: (letters by row, the state after the chunk, cost).  ``after`` has
    the vectors after every row; the rows missing at a conversation's end are letters
    of its last row."""
    out, cost = [], 0
    for x, v in zip(symbols, after):
        letters, to = edits(v, x, s)
        out.append(letters)
        for c in letters:
            cost += {"I": INSERT, "D": DELETE, "R": REROLE, "K": KEEP}[c]
        if letters and letters[-1] in "KR":
            cost += TRUNCATED * ((x - 1) & 1)
        s = to
    if last:
        tail = "I" * (ENDS[s] // INSERT)
        cost += ENDS[s]
        out.append(tail)
        s = (0, 3, 3, 3)[s]
    return out, s, cost


def lines(letters: str, role: str | None, text: str | None, s: int) -> tuple[list[str], int]:
    """The lines that a row leaves, and the state after it."""
    out = []
    for c in letters:
        if c == "D":
            continue
        if c == "K":
            s = {"s": 1, "u": 2, "a": 3}[role[0]]
            out.append(f"{role}:{text}")
        else:
            s = NEXT[s]
            out.append(f"{ROLE[s]}:{text if c == 'R' else ''}")
    return out, s


class Digest:
    """SHA-256 of lines joined by a line feed, as they come."""

    def __init__(self) -> None:
        self.h, self.any = hashlib.sha256(), False

    def add(self, found: list[str]) -> None:
        for x in found:
            if self.any:
                self.h.update(b"\n")
            self.h.update(x.encode())
            self.any = True

    def hex(self) -> str:
        return self.h.hexdigest()


class Counts:
    """What a chunk's rows add to its conversation's counts, in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None

    def row(self, turn: int | None, initial: str, kind: int, duplicate: bool) -> int:
        """Counts a row; its symbol."""
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        if kind == GOES:
            self.blank += 1
        elif duplicate:
            self.duplicate += 1
            kind = GOES
        else:
            self.truncated += (kind - 1) & 1
        return kind

    def add(self, x: Counts) -> None:
        """The counts of the chunk that follows."""
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(x, name))
        if x.last is not None:
            if self.last is None:
                self.first = x.first
            else:
                self.illegal += self.last + x.first not in LEGAL
            self.last = x.last
        if x.last_turn is not None:
            if self.last_turn is None:
                self.first_turn = x.first_turn
            else:
                self.turns -= x.first_turn == self.last_turn
            self.last_turn = x.last_turn

    def gaps(self) -> int:
        return 0 if self.last_turn is None else self.last_turn - self.first_turn + 1 - self.turns

    def values(self) -> list[int]:
        return [self.gaps(), self.blank, self.duplicate, self.truncated, self.illegal]


# --- the rows in order ---------------------------------------------------


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damages rows by crc32("conv_id:turn") modulo 20: 0 drops the row (``live``
    false), 1 empties its text, 2 removes its full stops, exclamation and question
    marks, 3 repeats it, 4 makes its role user.  Nulls are read as one space, but for
    the conversation and the turn handed on.  Columns: conv, turn, role, text, live."""
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    rows = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("d"),
    )
    rows = rows.withColumn("copy", F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("d").isin(0, 1), F.lit("")).when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("d") != 0).alias("live"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows range-partitioned in the order of conversations and turns: a conversation
    is a run of rows of one or more partitions, however long it is.  Stored, as the
    bounds are sampled; ``pos`` numbers the rows in order."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(~F.col("live"), ABSENT).when(stripped == "", GOES).otherwise(1 + 2 * role + F.when(F.substring(stripped, -1, 1).isin(".", "!", "?"), 0).otherwise(1))
    content = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    rows = rows.select("conv", "turn", "role", "text", kind.alias("kind"), content.alias("content"))
    # rows alike in all of these are interchangeable; a running number splits many of them
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "uid"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("uid")
    return cut_lineage(rows.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()))


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Runs of rows of one key (the first ``key`` columns), rows as tuples."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    group: list[tuple] = []
    for row in rows():
        if group and group[-1][:key] != row[:key]:
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _whole(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that lie in one partition: one chunk each, whose vectors start
    from the true end."""

    def solve(group: list[tuple]) -> list:
        counts, seen, symbols, kept = Counts(), set(), bytearray(), []
        for _, turn, role, text, row_kind, content in group:
            if row_kind != ABSENT:
                kept.append((role, text))
                symbols.append(counts.row(turn, role[:1], row_kind, content in seen))
                seen.add(content)
        by_row, _, cost = trace(symbols, vectors(symbols, ENDS)[1:], 0, True)
        digest, s = Digest(), 0
        for letters, (role, text) in zip(by_row, [*kept, (None, None)]):
            found, s = lines(letters, role, text, s)
            digest.add(found)
        return [group[0][0], *counts.values(), cost, "".join(by_row), digest.hex()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for group in _runs(batches, 1):
            out.append(solve(group))
            if len(out) == 4096:
                yield _batch(out, shape)
                out = []
        if out:
            yield _batch(out, shape)

    schema = f"conv {kind}, {RESULT}"
    shape = _shape(schema)
    return rows.select("conv", "turn", "role", "text", "kind", "content").mapInArrow(run, schema)


def _shape(schema: str) -> pa.Schema:
    """The Arrow schema of columns given as text; on the driver only."""
    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[list], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)


# --- conversations over several partitions -------------------------------


def _chunks(rows: DataFrame) -> DataFrame:
    """One row per conversation and partition: its symbols and counts."""
    # a row is a duplicate if the same content stands before it, in any chunk
    live = rows.where(F.col("kind") != ABSENT)
    first = live.groupBy("cid", "content").agg(F.min("pos").alias("first"))
    marked = rows.join(first, ["cid", "content"], "left").select(
        "cid", "part", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "kind", (F.col("pos") > F.col("first")).alias("again")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 2):
            counts, symbols = Counts(), bytearray()
            for _, _, _, turn, initial, kind, again in group:
                symbols.append(ABSENT if kind == ABSENT else counts.row(turn, initial, kind, again))
            c = counts
            yield _batch([[*group[0][:3], bytes(symbols), c.blank, c.duplicate, c.truncated, c.illegal, c.turns, c.first, c.last, c.first_turn, c.last_turn]], shape)

    schema = ("cid long, part int, pos long, symbols binary, blank long, duplicate long, truncated long, illegal long, turns long, "
              "first string, last string, first_turn long, last_turn long")
    shape = _shape(schema)
    return cut_lineage(marked.repartition("cid", "part").sortWithinPartitions("cid", "part", "pos").mapInArrow(run, schema))


def _mapped(df: DataFrame, columns: list[str], schema: str, f: Callable[[tuple], list]) -> DataFrame:
    """A small function on every row."""
    shape = _shape(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _batch([f(row) for row in zip(*(c.to_pylist() for c in b.columns))], shape)

    return df.select(*columns).mapInArrow(run, schema)


def _text(v: Vector) -> str:
    return " ".join(map(str, v))


def _vector(text: str) -> Vector:
    return tuple(map(int, text.split(" ")))


def _converged(chunks: DataFrame) -> DataFrame:
    """(cid, part, right): the vector after every chunk.

    All chunks first run from the end vector, which is true for the last one of a
    conversation and a guess for the others.  Each fix-up pass follows the known runs
    from the end, a guess where one is missing, and runs the missing ones again, all
    at once, until none is.  A chunk runs once at most from each of the few vectors,
    even where vectors never converge (rows that go change no vector; a long run of
    one role keeps two kinds apart)."""
    schema = "cid long, part int, right string, left string"
    tell = lambda r: [r[0], r[1], _text(ENDS), _text(vectors(r[2], ENDS)[0])]
    runs = cut_lineage(_mapped(chunks, ["cid", "part", "symbols"], schema, tell))

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, dict[str, str]] = {}
        for part, right, left in zip(group["part"], group["right"], group["left"]):
            known.setdefault(part, {})[right] = left
        v, out = _text(ENDS), []
        for part in sorted(known, reverse=True):
            left = known[part].get(v)
            old = next(iter(known[part].items()))
            out.append((group["cid"].iloc[0], part, v, left is not None, *old))
            v = old[1] if left is None else left
        return pd.DataFrame(out, columns=["cid", "part", "right", "known", "old_right", "old_left"])

    while True:
        # one row per chunk and vector: as many as partitions at most, times a few
        path = cut_lineage(runs.groupBy("cid").applyInPandas(follow, "cid long, part int, right string, known boolean, old_right string, old_left string"))
        missing = path.where("not known")
        if missing.isEmpty():
            return path.select("cid", "part", "right")
        again = lambda r: [r[0], r[1], r[3], _text(rerun(r[2], _vector(r[3]), _vector(r[4]), _vector(r[5])))]
        todo = missing.join(chunks.select("cid", "part", "symbols"), ["cid", "part"])
        runs = cut_lineage(runs.unionByName(_mapped(todo, ["cid", "part", "symbols", "right", "old_right", "old_left"], schema, again)))


def _stitched(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that span partitions; ``cid`` numbers them."""
    chunks = _chunks(rows)
    right = _converged(chunks)
    last = chunks.groupBy("cid").agg(F.max("part").alias("part"), F.lit(True).alias("ends"))
    solved = chunks.join(right, ["cid", "part"]).join(last, ["cid", "part"], "left").withColumn("ends", F.coalesce("ends", F.lit(False)))

    def exits(r: tuple) -> list:
        after = vectors(r[2], _vector(r[3]))[1:]
        found = [trace(r[2], after, s, r[4]) for s in range(4)]
        return [r[0], r[1], *[x[1] for x in found], *[x[2] for x in found]]

    states = "e0 int, e1 int, e2 int, e3 int, c0 long, c1 long, c2 long, c3 long"
    ways = _mapped(solved, ["cid", "part", "symbols", "right", "ends"], f"cid long, part int, {states}", exits)
    names = ["blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "first_turn", "last_turn"]
    # nulls as text, as pandas would make numbers with nulls floating
    small = chunks.select("cid", "part", *[F.col(c).cast("string").alias(c) for c in names]).join(ways, ["cid", "part"])

    def enter(group: pd.DataFrame) -> pd.DataFrame:
        total, s, cost, out = Counts(), 0, 0, []
        for r in group.sort_values("part").to_dict("records"):
            own = Counts()
            for c in names:
                value = None if pd.isna(r[c]) else r[c]
                setattr(own, c, value if c in ("first", "last") or value is None else int(value))
            total.add(own)
            out.append([r["cid"], r["part"], s])
            cost += r[f"c{s}"]
            s = r[f"e{s}"]
        return pd.DataFrame([[*x, *total.values(), cost] for x in out], columns=["cid", "part", "entry", *"gaps blank duplicate truncated illegal cost".split()])

    # a row per chunk: as many as partitions at most
    entries = small.groupBy("cid").applyInPandas(enter, "cid long, part int, entry int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    entries = cut_lineage(entries)
    ready = solved.select("cid", "part", "pos", "symbols", "right", "ends").join(entries, ["cid", "part"])

    def letters(r: tuple) -> list:
        by_row, _, _ = trace(r[2], vectors(r[2], _vector(r[3]))[1:], r[4], r[5])
        return [r[0], r[1], "".join(by_row), by_row if r[5] else [*by_row, ""]]

    traced = cut_lineage(_mapped(ready, ["cid", "part", "symbols", "right", "entry", "ends"], "cid long, part int, audit string, by_row array<string>", letters))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
    audits = traced.groupBy("cid").agg(ordered.alias("audit")).join(
        entries.groupBy("cid").agg(*[F.max(c).alias(c) for c in "gaps blank duplicate truncated illegal cost".split()]), "cid"
    )

    # every row's letters to its text; a conversation's digest is one function of its
    # rows in order, so they stream through one task, none of them kept
    by_row = traced.join(chunks.select("cid", "part", "pos"), ["cid", "part"]).select(
        F.posexplode("by_row").alias("i", "letters"), F.col("pos").alias("start"), F.size("by_row").alias("n")
    )
    tail = F.col("i") == F.col("n") - 1
    by_row = by_row.where("letters <> ''").select((F.col("start") + F.col("i") - tail.cast("int")).alias("pos"), "letters", tail.alias("tail"))
    texts = rows.select("cid", "pos", "role", "text").join(by_row, "pos").repartition("cid").sortWithinPartitions("cid", "pos", "tail")

    schema = "cid long, repaired_sha256 string"
    shape = _shape(schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, digest, s = None, None, 0
        for b in batches:
            for c, role, text, found in zip(*(x.to_pylist() for x in b.columns)):
                if c != cid:
                    if cid is not None:
                        yield _batch([[cid, digest.hex()]], shape)
                    cid, digest, s = c, Digest(), 0
                out, s = lines(found, role, text, s)
                digest.add(out)
        if cid is not None:
            yield _batch([[cid, digest.hex()]], shape)

    hashed = texts.select("cid", "role", "text", "letters").mapInArrow(digests, schema)
    empty = F.lit(Digest().hex())
    return audits.join(hashed, "cid", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))


def repair(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every conversation of ``rows`` (conv, turn,
    role, text, live), as ``damage`` gives them.

    A conversation's live rows are taken by turn (nulls first), then role and text.  A
    row's first fault counts: blank, duplicate (of an earlier row's role and text),
    truncated (the last character that is not white space is no ``.!?``).  Keep costs
    0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant
    row) 2, a truncated row that is not deleted 1; blank and duplicate rows are deleted.
    The audit has the letters of the cheapest edits whose roles' first letters read
    ``(s?(ua)+)?``, the ASCII-least of equal cost.

    Rows are range-partitioned by conversation and order, so a conversation of any
    length is dealt to many tasks.  One that lies in one partition is solved there.
    The chunks of the others run from speculative cost vectors, fix-up passes run
    chunks again until vectors differ by a constant only, and the tracing of a chunk
    from each of the four states is stitched.

    Null and repeated conversations and turns are values like others; roles and texts
    are not null in ``rows``; a role without letters is an illegal neighbour of any.  A
    conversation without live rows has zeros, an empty audit and the digest of nothing.
    An empty table gives an empty result.  Columns: conv, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256 (of the repaired ``role:text``,
    joined by line feeds).
    """
    spark = rows.sparkSession
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = _ordered(rows)
    conv = F.struct("conv")
    edges = ordered.groupBy("part").agg(F.min(conv).alias("lo"), F.max(conv).alias("hi"))
    edges = edges.select("part", F.explode(F.array("lo", "hi")).alias("c")).groupBy("c").agg(F.countDistinct("part").alias("n")).where("n > 1")
    # conversations that lie in two partitions: less than there are partitions
    spanning = [r.conv for r in edges.select("c.conv").collect()]
    numbered = F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(spanning)], f"_conv {kind}, cid long"))
    marked = ordered.join(numbered, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    whole = _whole(marked.where("cid is null"), kind)
    if not spanning:
        return whole
    several = _stitched(marked.where("cid is not null").drop("conv"), kind).join(numbered, "cid")
    return whole.unionByName(several.select(F.col("_conv").alias("conv"), *[c.split(" ")[0] for c in RESULT.split(", ")]))
