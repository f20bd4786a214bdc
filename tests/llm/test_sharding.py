import collections
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mktlens.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
def test_permutation_and_its_inverse(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.unpermute(p, n, seed) == np.arange(n)).all()


def rows(df, **k):
    return sorted((tuple(r) for r in sharding.shard(df, **k).select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str)


def test_law_rows_with_repeats_and_nulls(spark):
    data = [(i, f"text {i}", "s") for i in range(1000)] + [(7, "equal", "s")] * 500 + [(None, "equal", "s")] * 50 + [(5, None, "s"), (6, "", "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, shard string")
    out = sharding.shard(df).collect()
    per = collections.Counter(r.shard for r in out)
    assert len(out) == len(data) and set(per) == set(range(16)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(per[s]))
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in data), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == want
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    # the same whatever the partitioning, and computable from the row number
    assert rows(df) == rows(df.repartition(7))
    n = len(out)
    p = sharding.permute(np.array([r.row_number for r in out]), n)
    assert [sharding.shard_of(int(x), 16) for x in p] == [(r.shard, r.slot) for r in out]


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
