"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``, and any further columns
with their own values, whatever their names. Null and empty texts have no words: they score like
any text without features, lose no line, are near copies of each other, and are packed nowhere; an
empty table gives an empty one. Part of the training-data operators (``tidemark/llm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import classifier, lines, packing, simhash, suffix
from tidemark.llm.common import release, written
from tidemark.shipping import ship

#: Bytes of a passage that the suffix stage cuts wherever it repeats; about 50 short words.
PASSAGE_BYTES = 256


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is below one half go."""
    ship(spark)
    model = classifier.train(docs, classifier.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    own = _apart(docs, "expected_grade", "p_top", "kept")
    return classifier.score(own, model).where("kept").select(*own.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are near copies of earlier lines go; documents stay."""
    own = _apart(docs, "removed_lines")
    cut = lines.dedup_lines(own)
    return _measured(cut, F.size("removed_lines") > 0).select(*own.columns).toDF(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (3 bits at most, or a Jaccard of five-word shingles of 0.8 or more) stays."""
    ship(spark)
    return simhash.keep_one(docs, k=5, distance=3, similar=True)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice or more are cut out, whole characters at a time; documents stay."""
    ship(spark)
    own = _apart(docs, "kept", "removed")
    cut = suffix.remove_repeats(own, length=PASSAGE_BYTES, whole_chars=True)
    text = F.when(F.size("removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    return _measured(cut.withColumn("text", text), F.size("removed") > 0).select(*own.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts, packed by their number of words."""
    ship(spark)
    return packing.pack_documents(docs)


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with other names for the columns whose names an operator uses for its own."""
    return docs.toDF(*(f"own_{i}_{c}" if c in used else c for i, c in enumerate(docs.columns)))


def _measured(df: DataFrame, changed) -> DataFrame:
    """n_chars of the texts that changed."""
    if "n_chars" not in df.columns:
        return df
    return df.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
        release(docs)
        docs = done
    return docs
