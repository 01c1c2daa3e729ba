"""A corpus pipeline of five operators: language ID, near-duplicates, personal data, mixing, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
``docs``, whatever they are called (names that start with ``__`` are reserved).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import few, materialize, scratch
from lectern.llm.jaccard import representatives
from lectern.llm.langid import label, train
from lectern.llm.mixing import mix_documents
from lectern.llm.packing import pack
from lectern.llm.pii import replace_pii

LEAST_SCORE = 0.4  # a text whose best language gets less of its positions is in none of the learned ones


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of a learned language; out go those without a letter and those that the model cannot place.

    A null or empty text has no letter and goes. Repeated rows are judged alike and all stay. Rows without an id or a label are judged
    like others. A very long text is read whole, in windows. If no row has a label, nothing is learned and nothing stays; an empty
    table stays empty.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = label(docs, train(docs), "__language")
    return found.filter((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= LEAST_SCORE)).select(*names)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that with the smallest doc_id, one row of equal ones.

    Near-duplicates have a Jaccard similarity of 0.8 or more of their five-word shingles; they are searched by SimHash fingerprints with
    Golay keys, and exactly among what those leave apart. Groups are of texts, so rows that share
    a doc_id may be in several; a row without a doc_id stays only where a group has no row with one. Null texts, empty ones and those
    of white space are one group. A very long text is one set of shingles. An empty table stays empty.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    known = docs.withColumn("__row", F.xxhash64(*names))
    keep = representatives(known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__row").alias("row"), "text")).select(F.col("row").alias("__row"))
    counted = known.groupBy("__row").count()
    gone = few(materialize(counted.join(keep, "__row", "left_anti").select("__row"), "gone"))  # fewer than what stays, as a rule
    again = few(materialize(counted.filter("count > 1").select("__row"), "again"))  # equal rows
    kept = known.join(gone, "__row", "left_anti")
    single = kept.join(again, "__row", "left_anti").select(*names)
    return single.unionByName(kept.join(again, "__row", "left_semi").dropDuplicates(["__row"]).select(*names))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; n_chars follows the text. No row goes.

    A null or empty text stays as it is, and its n_chars is null or 0. Repeated rows get equal texts. A very long text is rewritten whole.
    A column ``entities`` of the input stays. An empty table stays empty.
    """
    own = "entities" in docs.columns
    done = replace_pii(docs.withColumnRenamed("entities", "__entities") if own else docs)
    done = done.withColumn("n_chars", F.length("text").cast("long"))
    return (done.drop("entities").withColumnRenamed("__entities", "entities") if own else done).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions; n_chars follows the text of the one document that a source's budget cuts.

    A text without a word (null, empty, white space) has nothing to give and goes. Repeated rows are counted one by one; a row
    without an id is a row like any other, a null source a source. A very long text may be the one that is cut. An empty table stays
    empty.
    """
    return mix_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; ``row`` tells the pieces of repeated rows and of rows with one doc_id apart.

    A null or empty text is the closing id alone. A very long text is cut into many sequences. Other columns don't matter. An empty
    table has no pieces.
    """
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "row")


STAGES = [("language", language), ("deduplicate", deduplicate), ("private", private), ("mixed", mixed), ("packed", packed)]

#: The network, the components and the packing are not SQL; tests/llm/test_corpus_pipeline.py holds the stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:  # a stage's work tables go as soon as its result is written
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
    return docs
