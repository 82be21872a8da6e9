"""Corpus preparation: language, near duplicates, benchmark leaks, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Rows without text, or without a letter in it, have no language
and leave in the first stage; other stages meet nulls, empty texts and repeated rows as
their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.language import UNDETERMINED, predict_language, train_language
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pii import redact
from tidemark.llm.storage import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Lowest posterior probability of a language with which a document stays.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the language is told; a missing label becomes the prediction.

    Null texts and those without a letter leave; repeated rows all stay or all leave.
    """
    model = train_language(docs)
    known = predict_language(docs, model, keep=list(COLUMNS)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``row_key``, 128 bits of all columns and of which are null: ids may be null or repeat.

    Rows of one key are equal in all columns.
    """
    told = [*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)]
    return docs.select(*COLUMNS, F.concat(F.hex(F.xxhash64(*told)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *reversed(told)))).alias("row_key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that links (five words, 0.8) connect, null last.

    Ids may be null or repeat: rows are told by all their columns, and of equal ids in a group
    the row of the smallest hash stays. Rows without words are in no group, and all of them
    stay, repeated ones too. An empty table stays empty.
    """
    rows = _keyed(docs)
    groups = jaccard_components(rows, id_col="row_key", k=5, threshold=(8, 10))
    ids = rows.select("row_key", "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"]
    kept = groups.where("n_shingles > 0").select("row_key", "component_id").distinct().join(ids, "row_key").groupBy("component_id").agg(least.alias("row_key")).select("row_key", F.lit(True).alias("one"))
    stay = kept.unionByName(groups.where("n_shingles = 0").select("row_key").distinct().withColumn("one", F.lit(False)))
    # equal rows have one key, and are near duplicates where they have words
    tie = F.when(F.col("one"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())
    return rows.join(stay, "row_key").withColumn("tie", tie).dropDuplicates(["row_key", "tie"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window matches an item of the benchmark.

    A leaking row leaves with its exact repeats, and no other row of its id does. Null and
    empty texts stay.
    """
    rows = _keyed(docs)
    leaks = find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row_key").select("row_key").distinct()
    return rows.join(leaks, "row_key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and their lengths anew."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their words and how often they are taken.

    Rows without words can't count towards a target; they are taken by the number of
    documents alone. Repeated rows are each mixed, a null source is a source of its own,
    and an empty table gives an empty result.
    """
    rows = _keyed(docs)
    mix = mix_sources(rows, id_col="row_key").where("copies > 0").select("row_key", "size", "copies", "taken", "target")
    # equal rows have one key; the mix has each of them
    return rows.dropDuplicates(["row_key"]).join(mix, "row_key").select(*COLUMNS, "size", "copies", "taken", "target")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]
#: Trained models, components and balanced draws have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
