"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage calls one operator of ``mktlens.llm`` on all documents that its
predecessor kept, and its decisions take effect: texts without a sure language go, one
document of each near-duplicate group stays, later copies of long repeats are cut
out, contaminated documents go, and the rest is packed.  A stage takes
(spark, docs, sf_dir); all but the last return the columns of ``docs``.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktlens.llm import decontamination, language, packing, simhash, suffix
from mktlens.session import ensure_checkpoint_dir

#: Marks rows of equal id and text, which every stage decides alike.
KEY = "_corpus_row"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` (keyed) that are in ``rows`` (doc_id and key), or not."""
    right = rows.select(F.col("doc_id").alias("_r_id"), F.col(KEY).alias("_r_key"))
    return docs.join(right, (F.col(KEY) == F.col("_r_key")) & F.col("doc_id").eqNullSafe(F.col("_r_id")), how)


#: Languages that the language stage keeps (None: all that the labels have), and the
#: least score of the predicted one: below, the text mixes three languages or more.
LANGUAGES: tuple[str, ...] | None = None
MIN_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that can have no language (null or without a letter), whose
    language is undecided (predicted with a score under MIN_SCORE), or is not one of
    LANGUAGES.

    The model learns from labelled rows outside the held-out quarter; where there are
    none it knows no language, and only texts without a letter are rejected."""
    model = language.train(docs.where(~language.held_out("doc_id")))
    wanted = F.lit(True) if LANGUAGES is None else F.col("lang_pred").isin(*LANGUAGES)
    decided = (F.col("lang_pred") == "und") | (wanted & (F.col("score") >= MIN_SCORE))
    # the rows ride along and are filtered in place: no text is shuffled
    judged = language.identify(docs.withColumn("_row", F.struct(*docs.columns)), model, carry="_row", with_letters=True)
    return judged.where(F.col("letters") & decided).select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: that with the least id (then the least
    row hash); of wholly equal rows, one."""
    keyed = _keyed(docs)
    classes = simhash.near_duplicates(keyed, words=3, distance=3, carry=KEY, with_root=True)
    # not component_id: classes of null ids only share it, as do classes of a repeated id
    first = classes.groupBy("root").agg(F.min(F.struct("doc_id", KEY)).alias("first")).select("first.*")
    kept = _joined(keyed, first, "left_semi")
    # rows of equal id and text lie together after the join: one of them stays, that
    # with the least hash of all its columns
    one = kept.groupBy(KEY, "doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return one.select("row.*")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of strings of 200 bytes and more, keeping the first; a
    document of which nothing is left goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # an unnamed constant keeps the struct non-empty where there is no other column
    carried = docs.withColumn("_others", F.struct(F.lit(True).alias("_any"), *others))
    cut = suffix.repeats(carried, length=200, keep_first=True, carry="_others").where("n_bytes = 0 or n_removed < n_bytes")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[(new[c] if c in new else F.col("_others").getField(c)).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents contaminated by benchmark items."""
    keyed = _keyed(docs)
    judged = decontamination.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=KEY)
    return _joined(keyed, judged.where("contaminated").select("doc_id", KEY).distinct(), "left_anti").drop(KEY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models, fingerprints and tokenizers are beyond SQL; the pipeline is
#: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage keeps is written as Parquet in
    the shared folder and read again; it is deleted once the next one is written."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
