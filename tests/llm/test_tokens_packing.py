import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mktlens.llm import packing, tokens

ODD = [
    None, "", " ", "\n\n x  y  z\t\tq \n", "a <|endoftext|>  b<|endoftext|>", "x" * 3000 + " " + "é" * 50, "  lead", "trail  ", "\n \n a \r\n b",
    "don't I'll  we're !!??  12345 日本語 テスト", "　a　 b\xa0 c", "é ́x", "İSTANBUL Σας", "a\x0bb \x0c c\x1cd", "Hello<|startoftext|> there",
    "word " * 6000, "same text", "same text",
]


@pytest.fixture()
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(3, "again id 3", None, None), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, length string")


def test_counts_are_the_library_s(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, path).collect())
    assert got == want
    assert tokens.count_tokens(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("ranks", [None, "byte_bpe_50k.tiktoken"])
def test_pieces_tile_documents_and_fit(spark, docs, ranks):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    out = packing.pack(docs.where("doc_id is not null and text <> 'again id 3' or text is null"), path, ranks and public_tokenizers.path(ranks)).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t in enumerate(ODD):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by[i], key=lambda r: r.start):
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(ids[at : at + p.length].tobytes()), len(ids))
            at += p.length
        assert at == len(ids)
    assert sorted(seq) == list(range(len(seq)))
    for parts in seq.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_pack_of_nothing_and_of_repeated_rows(spark, docs):
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert packing.pack(docs.limit(0), path, ranks).count() == 0
    out = packing.pack(docs, path, ranks).collect()
    assert sum(1 for r in out if r.doc_id is None) == 1
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert sum(r.start == 0 for r in out) == docs.count()


def test_little_padding(spark):
    sizes = np.random.default_rng(1).integers(1, 6000, 400)
    df = spark.createDataFrame([(i, "a " * int(n)) for i, n in enumerate(sizes)], "doc_id long, text string")
    out = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert sum(r.length for r in out) / (2048 * len({r.sequence_id for r in out})) > 0.97


def test_cut_covers_any_length():
    for n in [1, 2, 11, 12, 13, 1023, 1024, 1025, 2047, 2048, 2049, 5000]:
        parts = packing.cut(n, 2048, 128, 12)
        assert sum(size for size, _ in parts) == n
        assert all(size * k <= 2048 for size, k in parts)
