"""A training corpus in five stages, from the table of documents to packed sequences.

Each stage takes what its predecessor kept and calls one operator.  All but the
last return the columns of ``documents``, among which ``text`` may be rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.decontaminate import decontaminate
from trackloom.llm.ngram_join import ngram_jaccard_join
from trackloom.llm.packing import pack
from trackloom.llm.pii import find_pii
from trackloom.llm.queries import held_out
from trackloom.llm.scratch import cut, remove, written
from trackloom.llm.tokens import vocabulary_path
from trackloom.llm.toxicity import score_toxicity


def _unused(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` begins with, in either case."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the nearest labelled examples do not call toxic; each row is judged by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mark = _unused(docs)
    scored = score_toxicity(docs, labels, ~held_out(), keep=[c for c in docs.columns if c != "doc_id"], prefix=mark)
    return scored.where(F.col(mark + "predicted") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id (null ids last); texts without words all stay."""
    row = _unused(docs) + "row"
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = cut(ngram_jaccard_join(keyed, doc_id=row).withColumnRenamed("doc_id", row).where("n_shingles > 0").join(keyed.select(row, "doc_id"), row))
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"), F.count("*").alias("n"))
    gone = cut(groups.join(first.where("n > 1"), "component_id").where(F.col(row) != F.col("first")[row]).select(row))
    return keyed.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; equal texts are judged alike."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = _unused(docs) + "key"
    keyed = docs.withColumn(key, F.md5("text"))
    found = cut(decontaminate(keyed, items, doc_id=key).select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind; n_chars follows the text, null texts stay null."""
    names, mark = docs.columns, _unused(docs)
    masked = find_pii(docs, keep=[c for c in names if c not in ("doc_id", "text")], prefix=mark)
    text = F.col(mark + "masked")
    return masked.select(*[text.alias("text") if c == "text" else F.coalesce(F.length(text).cast("long"), "n_chars").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # toxicity is learnt, and packing solves a linear program


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
    return docs
