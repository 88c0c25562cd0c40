"""The corpus pipeline: documents in, packed training sequences out.

    toxicity           documents that the classifier calls toxic go
    near_duplicates    of every group of five-word Jaccard similarity 0.8 one document stays
    decontamination    documents that hold a benchmark item go
    pii                personal data is replaced by its kind
    packing            what is left becomes sequences of at most 2048 ids

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder and
reads it again for the next stage.  All but the last return the columns of ``docs``, in
their order and with whatever others there are.

Defined results: rows with a NULL, empty or wordless text are neither toxic, copies nor
contaminated, and are packed as an end id alone.  Rows with a NULL id cannot be compared and
stay.  Of repeated rows one stays.  The classifier knows no labels of documents in its
held-out fold; without any toxic label nothing is rejected.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm import decontamination, jaccard, packing, pii, toxicity
from freshet.llm._common import documents, stage

#: no stage can be written in SQL
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fitted(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id stays for its group; of rows repeating an id, one."""
    body = F.xxhash64("text")
    groups = jaccard.cluster(docs, width=5, threshold="0.8", mark=body)
    ranked = groups.where("n_shingles > 0 and doc_id is not null") \
        .groupBy("component_id").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    stays = groups.where("n_shingles > 0 and doc_id is not null").select("doc_id", "mark", "component_id").distinct() \
        .join(ranked, "component_id") \
        .select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"),
                (F.struct("doc_id", "mark") == F.col("first")).alias("_stays"))
    # as a struct, so that no name of the documents meets one of these
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), body.alias("_body"))
    marked = rows.join(stays, (F.col("_doc") == F.col("_id")) & (F.col("_body") == F.col("_mark")), "left")
    # the join has brought rows alike in id and text together
    again = F.row_number().over(Window.partitionBy("_doc", "_body").orderBy("_id"))
    return marked.withColumn("_again", again) \
        .where("_stays is null or _stays and _again = 1").select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                                 .otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
