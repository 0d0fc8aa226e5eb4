"""A corpus through five stages; each stage's rows are written before the next one reads them.

Every stage but the last returns the columns of ``documents`` and leaves the text of the rows it keeps as it was:

1. language: rows whose language cannot be told (no letters), or only with a posterior below ``LEAST_SCORE``, go.
2. near duplicates: of each group linked at five words and similarity 0.8 the smallest doc_id stays.
3. decontamination: rows that hold ten consecutive words of a benchmark item go.
4. mixing: a row stays as often as its rate says. Domains that are not toxic get at least the tokens they have in this stage's
   input, and a row that is not more likely toxic than not stays at least once, so that only toxic text is thinned out.
5. token files: written in ascending doc_id order, and read back as one row a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.common import shared_path, small_batches, table, written
from veil.llm.decontaminate import decontaminate
from veil.llm.language_id import UNDETERMINED, fit
from veil.llm.mixing import mix
from veil.llm.near_dedup import near_duplicates
from veil.llm.queries import BUDGET, END_ID, TARGETS, domain_labels, held_out, tokenizer_path
from veil.llm.token_files import read_token_files, write_token_files

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    guess = F.col("_language")
    told = (guess["lang"] != UNDETERMINED) & (guess["score"] >= LEAST_SCORE)
    return model.predict(docs, out="_language").where(told).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    gone = near_duplicates(docs, width=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    marked = decontaminate(docs, table(spark, sf_dir, "benchmark"), width=10, out="_hits")
    return marked.where(F.col("_hits.n_hit") == 0).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = tuple(d for d in TARGETS if not d.startswith("toxic"))
    mixed = mix(docs, domain_labels(table(spark, sf_dir, "labels")), TARGETS, BUDGET, out="_mix", whole=clean)
    toxic = sum((F.get("_mix.posteriors", F.lit(i)) for i, d in enumerate(sorted(TARGETS)) if d not in clean), F.lit(0.0))
    mixed = mixed.withColumn("_copies", F.when(toxic > 0.5, F.col("_mix.copies")).otherwise(F.greatest(F.col("_mix.copies"), F.lit(1))))
    times = F.sequence(F.lit(1).cast("long"), F.col("_copies"))
    return mixed.where("_copies > 0").withColumn("_time", F.explode(times)).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = shared_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path(), END_ID)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]
# Posteriors, rates and tokenizers are no SQL; the tests follow each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
