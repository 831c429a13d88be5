"""The corpus pipeline: toxic documents go, near copies go, contaminated documents go, personal data is sanitised, the rest is packed.

Each stage takes the documents that the one before has kept and returns them with the same columns; the last returns packed pieces.
``run`` writes the output of each stage to the shared scratch folder, so that a stage starts from files.

Rows with null or empty texts are kept by all stages and packed as an end id each. Rows with one id are judged by their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.llm import decontaminate, nearcopies, packing, pii, toxicity
from splicelake.llm.blocks import stored, text_key, without_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic."""
    scores = toxicity.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_rows(docs, scores.where("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id; of repeated rows one."""
    kept = nearcopies.near_copies(docs, k=5, similarity=80).where("kept").select(F.col("id").alias("kept_id")).distinct()
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    return rows.withColumn("text_key", text_key()).dropDuplicates(["doc_id", "text_key"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), text_key().alias("text_key")).alias("key"), "text")
    found = decontaminate.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key", slop=0)
    return without_rows(docs, found.where("contaminated").select("id.id", "id.text_key"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels in place of personal data and of terms that give it away."""
    return pii.sanitised(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids, with the ids."""
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal data", sanitise),
    ("packing", pack),
]

#: Nearest examples and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
