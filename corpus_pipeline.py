"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. Stages select rows by
two hashes of the whole row; rows equal in every column are one document until the mix repeats
them. Columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm import label_sharding, metric_join, mixing, ordinal_quality, positional_index
from kinweave.llm.common import arrow_rows
from kinweave.llm.token_codes import shared_folder
from kinweave.plans.lineage import cut, stored

SHARDS = 40
ROW, ROW_TOO = "_row_key", "_row_key_too"
READ = ("doc_id", "text", "source")  # the columns that stages look at


def _renamed(docs: DataFrame) -> DataFrame:
    """Other columns under names that neither operators nor stages use; results take the real ones by place."""
    return docs.toDF(*[c if c in READ else f"_column_{i}" for i, c in enumerate(docs.columns)])


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs``, renamed, plus two hashes of the whole row."""
    plain = _renamed(docs)
    columns = [F.col(c) for c in plain.columns]
    return plain.withColumns({ROW: F.xxhash64(*columns), ROW_TOO: F.xxhash64(F.lit("second"), *columns)})


def _attached(docs: DataFrame, keyed: DataFrame, chosen: DataFrame, more: list[str] | None = None) -> DataFrame:
    """The documents of ``chosen`` (the two hashes, others): one row for each row of ``chosen``, with columns ``more`` of it.

    Both steps deal by the same two columns, so texts are shuffled once. A column of ``docs`` with a name of
    ``more`` is replaced.
    """
    more = more or []
    found = keyed.dropDuplicates([ROW, ROW_TOO]).join(chosen.select(ROW, ROW_TOO, *[F.col(c).alias(f"_new_{c}") for c in more]), [ROW, ROW_TOO])
    columns = dict(zip(docs.columns, [c for c in keyed.columns if c not in (ROW, ROW_TOO)]))
    return found.select(*[F.col(c).alias(name) for name, c in columns.items() if name not in more], *[F.col(f"_new_{c}").alias(c) for c in more])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns on the labelled ones among ``docs``.

    They are stored here, where few rows travel to a worker at a time: the caller's write would send 10,000 texts.
    """
    model = ordinal_quality.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = _renamed(docs)
    with arrow_rows(spark, ordinal_quality.ROWS):
        kept = stored(ordinal_quality.grade_documents(plain, model, plain.columns).where("kept").select(*plain.columns))
    return kept.toDF(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest id.

    Documents without words or without an id are no copies and stay.
    """
    keyed = _keyed(docs)
    groups = metric_join.similar_sets(keyed, 5, 80, keep=[ROW, ROW_TOO])
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    first = groups.where(~alone).groupBy("root").agg(F.min(F.struct("doc_id", ROW, ROW_TOO)).alias("f")).select(f"f.{ROW}", f"f.{ROW_TOO}")
    return _attached(docs, keyed, first.unionByName(groups.where(alone).select(ROW, ROW_TOO).distinct()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    plain = _renamed(docs)
    found = positional_index.contamination(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=plain.columns)
    return found.where(~F.col("contaminated")).select(*plain.columns).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0 to 3 times."""
    keyed = _keyed(docs)
    taken = cut(mixing.mix(keyed, keep=[ROW, ROW_TOO]).where("copies > 0").select(ROW, ROW_TOO, "copies"))
    return _attached(docs, keyed, taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(ROW, ROW_TOO))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``shard`` (0 to 39, row counts one apart at most) and ``slot``; columns of these names are replaced."""
    keyed = _keyed(docs)
    rows = cut(keyed.select(ROW, ROW_TOO, F.md5(F.col("text").cast("binary")).alias("_text_key")))
    placed = label_sharding.balanced_shards(rows, ROW, "_text_key", SHARDS)
    return _attached(docs, keyed, placed, ["shard", "slot"])


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL cannot express the classifier, the rounding of the mix and the propagation of labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
