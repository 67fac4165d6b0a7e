"""A training-data pipeline over ``documents``: language ID, SimHash near-dedup, PII redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns the columns of
documents; the last returns packed pieces. Empty tables pass through; null texts are rejected by the first stage.
A row without doc_id is a document like any other: its language, copies and packing are its own, and of near-duplicates
it is kept where none has an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.langid import UNKNOWN, identify
from memlake.llm.mixing import mix
from memlake.llm.packing import pack_documents
from memlake.llm.pii import redact
from memlake.llm.shared import staged
from memlake.llm.simhash import simhash_groups

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the doc_id; without one, a number above all ids, the same for rows that are equal throughout."""
    top, bare = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)), F.count_if(F.col("doc_id").isNull())).first()
    room = 2**63 - 1 - max(top, 0)
    if bare and room < 2**61:
        raise ValueError("no room above the ids for keys of rows without one")
    own = F.lit(max(top, 0) + 1).cast("long") + F.pmod(F.xxhash64("text", "lang", "source", "n_chars"), F.lit(room).cast("long"))
    return docs.select(*COLUMNS, (F.coalesce("doc_id", own) if bare else F.col("doc_id")).alias("_key"))


def _by_key(keyed: DataFrame) -> DataFrame:
    """For the operators: the key as doc_id."""
    return keyed.drop("doc_id").withColumnRenamed("_key", "doc_id")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, however close the choice: all but those without letters."""
    found = identify(docs, carried=COLUMNS)
    return found.where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; rows that repeat an id count as one."""
    keyed = _keyed(docs)
    groups = simhash_groups(_by_key(keyed)).where(F.col("doc_id") == F.col("component_id"))
    return keyed.join(groups.select(F.col("doc_id").alias("_key")), "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0 to 3 times) as the mix takes it."""
    keyed = _keyed(docs)
    taken = mix(_by_key(keyed)).where("copies > 0").groupBy(F.col("doc_id").alias("_key")).agg(F.sum("copies").cast("int").alias("_copies")).hint("shuffle_hash")  # the same join at every size
    bare = keyed.where("doc_id is null").dropDuplicates(["_key"])  # equal rows have their copies in common
    each = keyed.where("doc_id is not null").union(bare).join(taken, "_key")
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", keep_identified),
    ("simhash_dedup", keep_one_of_each_group),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Stages such as the trained language model and the packing search are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
