"""Harmonic packing of tokenised documents into fixed-length sequences."""
from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mktlens.llm._arrow import slices
from mktlens.llm._pieces import PieceTable, gather, spaced_words
from mktlens.session import cut_lineage

#: White space that the pieces do not know; texts with it (or with the special
#: string) are encoded whole.
OTHER_SPACE = re.compile(
    rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
SHORT = 256


@lru_cache(maxsize=2)
def _coder(tokenizer: str, ranks: str | None):
    """(whole-text encoder, table of pieces).  With ``ranks``, the same
    vocabulary as merge ranks, new pieces go to the faster encoder of the two."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)

    def whole(text: str) -> np.ndarray:
        return np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)

    specials = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
    if ranks is None:
        def pieces(parts: list[bytes]) -> list[np.ndarray]:
            got = tok.encode_batch_fast([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)
            return [np.array(e.ids, np.uint32) for e in got]
    else:
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def pieces(parts: list[bytes]) -> list[np.ndarray]:
            return [np.array(enc.encode_ordinary(p.decode("utf-8", "replace")), np.uint32) for p in parts]

    return whole, specials, PieceTable(pieces)


def encode_slice(raw: np.ndarray, off: np.ndarray, tokenizer: str, ranks: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, their number per text)."""
    whole, specials, table = _coder(tokenizer, ranks)
    start, end = spaced_words(raw, off)
    data = raw.tobytes()
    odd = {int(np.searchsorted(off, m.start(), side="right")) - 1 for m in OTHER_SPACE.finditer(data)}
    for s in specials:
        odd |= {int(np.searchsorted(off, m.start(), side="right")) - 1 for m in re.finditer(re.escape(s), data)}
    long = np.flatnonzero(end - start > SHORT)
    odd |= set((np.searchsorted(off, start[long], side="right") - 1).tolist())
    first = np.searchsorted(start, off)
    keep = np.ones(len(start), bool)
    for d in odd:
        keep[first[d] : first[d + 1]] = False
    n_texts = len(off) - 1
    own = np.searchsorted(off, start[keep], side="right") - 1
    rows = table.rows(raw, start[keep], end[keep]) if keep.any() else np.zeros(0, np.int64)
    ids = gather(table.ids, table.start[rows], table.count[rows])
    per = np.bincount(own, table.count[rows], minlength=n_texts).astype(np.int64)
    if odd:
        parts, ends = [], np.cumsum(per)
        for d in range(n_texts):
            if d in odd:
                got = whole(data[off[d] : off[d + 1]].decode("utf-8", "replace"))
                parts.append(got)
                per[d] = len(got)
            else:
                parts.append(ids[ends[d] - per[d] : ends[d]])
        ids = np.concatenate(parts) if parts else ids
    return ids, per


def cut(n: int, capacity: int, classes: int, slack: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``n`` ids.

    Class k holds pieces of capacity // (k + 1) to capacity // k ids, k to a
    sequence.  Whole sequences go first; a rest that would leave more than
    ``slack`` ids of its slot unused gives up a piece that fills a slot of the
    next class exactly, and so on.  At most a handful of cuts a document.
    """
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = min(capacity // rest, classes)
        if k < classes and capacity // k - rest > slack:
            k += 1
            out.append((capacity // k, k))
            rest -= capacity // k
        else:
            out.append((rest, k))
            rest = 0
    return out


def pieces(df: DataFrame, tokenizer: str, ranks: str | None, end_id: int, capacity: int, classes: int, slack: int,
           id_col: str, text_col: str) -> DataFrame:
    """Tokenise and cut: one row per piece with its class and the CRC of its ids."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list[tuple[int, int]]] = {}
        for rows, raw, off in slices(batches, "text"):
            ids, per = encode_slice(raw, off, tokenizer, ranks)
            last = np.array([end_id], "<u4").tobytes()
            data = memoryview(ids.astype("<u4", copy=False).tobytes())
            doc, begin, length, crc, total, cls = [], [], [], [], [], []
            pos = 0
            for d, n in enumerate(per.tolist()):
                own = bytes(data[4 * pos : 4 * (pos + n)]) + last
                pos += n
                n += 1
                if n not in plans:
                    plans[n] = cut(n, capacity, classes, slack)
                at = 0
                for size, k in plans[n]:
                    doc.append(d)
                    begin.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own[4 * at : 4 * (at + size)]))
                    total.append(n)
                    cls.append(k)
                    at += size
            if len(plans) > 100_000:
                plans.clear()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (begin, length, crc, total)), pa.array(cls, pa.int32())],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "cls"],
            )

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, cls int"
    )


def pack(df: DataFrame, tokenizer: str, ranks: str | None = None, end_id: int = 1, capacity: int = 2048, classes: int = 128,
         slack: int = 12, groups: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Lengths fall into reciprocal-capacity classes (class k: at most
    capacity // k ids; ``classes`` of them) and every sequence of class k takes
    exactly k pieces, so a piece's sequence follows from its number within the
    class alone.  Numbers come from ``groups`` hash groups: a count per (class,
    group) (combined before the shuffle, at most classes x groups rows), its
    running sum, and a row number inside each group, so no task holds a class.
    Fewer than k pieces of each class are left over, at most
    classes * (classes - 1) / 2 pieces at any input size; first-fit decreasing
    packs these in one bounded task.

    Tokenising is the costly pass, so its result (one narrow row per piece) is
    checkpointed once in the shared folder.

    A document's ids end with ``end_id``; null and empty texts are that id alone.
    Repeated rows and ids are packed as rows of their own.  Other columns are
    ignored.  An empty table gives an empty result.  Columns: the id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, piece_class.
    """
    kind = df.schema[id_col].dataType.simpleString()
    cutted = pieces(df, tokenizer, ranks, end_id, capacity, classes, slack, id_col, text_col)
    rows = cut_lineage(cutted.withColumn("grp", F.pmod(F.xxhash64("id", "start", "ids_crc32", "doc_tokens"), F.lit(groups)).cast("int")))

    counts = rows.groupBy("cls", "grp").agg(F.count(F.lit(1)).alias("c"))
    by_class = Window.partitionBy("cls").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cls")
    offsets = counts.select(
        "cls", "grp", F.coalesce(F.sum("c").over(by_class), F.lit(0)).alias("before"), F.sum("c").over(whole).alias("n")
    )
    full = offsets.groupBy("cls").agg(F.floor(F.max("n") / F.col("cls")).alias("bins"))
    firsts = full.select("cls", "bins", F.coalesce(F.sum("bins").over(Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_bin"))
    # at most classes x groups rows, whatever the input: a bounded broadcast
    offsets = F.broadcast(offsets.join(firsts, "cls"))

    inside = Window.partitionBy("cls", "grp").orderBy("id", "start", "ids_crc32", "doc_tokens")
    numbered = (
        rows.withColumn("i", F.row_number().over(inside) - 1)
        .join(offsets, ["cls", "grp"])
        .withColumn("i", F.col("i") + F.col("before"))
        .withColumn("bin", F.floor(F.col("i") / F.col("cls")))
    )
    keep = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    slot = Window.partitionBy("sequence_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    packed = (
        numbered.where(F.col("bin") < F.col("bins"))
        .withColumn("sequence_id", F.col("first_bin") + F.col("bin"))
        .withColumn("offset", F.coalesce(F.sum("length").over(slot), F.lit(0)))
        .select(*keep, "sequence_id", "offset", F.col("cls").alias("piece_class"))
    )

    total = firsts.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("first_bin_of_rest"))
    rest = numbered.where(F.col("bin") >= F.col("bins")).select(*keep, F.col("cls").alias("piece_class")).crossJoin(F.broadcast(total))

    def first_fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        room = np.zeros(0, np.int64)
        seq, offset = [], []
        for n in part["length"].tolist():
            fits = np.flatnonzero(room >= n)
            b = int(fits[0]) if len(fits) else len(room)
            if b == len(room):
                room = np.append(room, capacity)
            seq.append(b)
            offset.append(capacity - int(room[b]))
            room[b] -= n
        part["sequence_id"] = np.array(seq, np.int64) + part["first_bin_of_rest"].to_numpy(np.int64)
        part["offset"] = np.array(offset, np.int64)
        return part[[*keep, "sequence_id", "offset", "piece_class"]]

    tail = rest.groupBy(F.lit(0).alias("one")).applyInPandas(
        first_fit, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, piece_class int"
    )
    return packed.unionByName(tail).withColumnRenamed("id", id_col)
