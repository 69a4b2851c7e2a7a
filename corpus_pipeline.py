"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

toxicity drops documents that it rejects; near-duplicate groups keep their
smallest id, or one row where none has an id; secrets are replaced in the text (``n_chars`` follows); the mix
repeats or drops documents so that sources come near their targets; the last
stage encodes the texts.

SQL can't express the trained model, so there is no ``ORACLE_SQL``; tests compare
with a plain version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm import byte_bpe, mixing, near_dup, secret_scan, toxicity
from orograph.llm.common import checkpointed, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels and the whole table, doesn't reject.

    Null and empty texts have the score of no evidence; repeated rows stay or go
    together; an empty table, or one without labels, gives what the prior says.
    """
    model = toxicity.trained(spark, sf_dir, table(spark, sf_dir, "documents"))
    return toxicity.toxicity(docs, COLUMNS, model).filter("predicted = 0").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id; rows without an id come last and are documents of their own.

    Only equal rows (id and text) share a key, and stay or go together. Texts
    without words stand alone and stay; an empty table stays empty.
    """
    none = checkpointed(docs.filter("doc_id IS NULL").withColumn("number", F.monotonically_increasing_id()))
    every = docs.filter("doc_id IS NOT NULL").withColumn("number", F.xxhash64("text")).unionByName(none)
    some_id = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    keyed = every.withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), some_id.alias("id"), "number"))
    found = near_dup.near_dup(keyed, "key").filter("kept").select(F.col("key").alias("kept_key")).distinct()
    return keyed.join(found, F.col("key") == F.col("kept_key"), "left_semi").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; a null text stays null, with a null ``n_chars``. Rows and ids stay as they are, an empty table stays empty."""
    clean = secret_scan.redacted(docs, ["doc_id", "lang", "source"])
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, rounded to whole copies; a document without words (or null) stays as it is. Repeated rows and rows without ids are taken one by one; an empty table stays empty."""
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    _passing.append(path)
    docs.withColumn("number", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    taken = mixing.mix(numbered.withColumn("digest", F.xxhash64("text")), ["doc_id", "digest"], row="number")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + F.lit(0.5)))
    often = checkpointed(taken.select("number", copies.cast("int").alias("copies")).filter("copies > 0"))
    return numbered.join(often, "number").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their digests; the text can be had from the ids. A null text has none, as an empty one; an empty table gives an empty result."""
    return byte_bpe.byte_bpe(docs, ["doc_id", "lang", "source"], with_ids=True).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


#: Folders that only the stage at hand reads.
_passing: list[str] = []


def removed(spark: SparkSession, folder: str) -> None:
    """Removes a folder of this run from the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each but the last returns is written to the shared folder and read again, and removed once the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        for path in [before, *_passing] if before else _passing:
            removed(spark, path)
        _passing.clear()
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
