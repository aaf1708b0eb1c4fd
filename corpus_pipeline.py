"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables, and
returns a DataFrame that is written as Parquet and read again as the next stage's documents. All but the
last return the columns of ``documents``. ``ORACLE_SQL`` is None: the stages (trained trees, byte-level
repeats, a tokenizer) can't be said in SQL; tests hold them against brute force instead.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, no rows at all and
further columns of any name, which it ignores; what then results is said stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import mixing, ngram_join, packing, quality, store, suffix_dedup, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from those of them that are labelled.

    Null text scores as the empty text. Equal texts share their fate, repeated rows come through as often
    as they came in. A score at the threshold is accepted, and without any label everything is.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.scored(docs.select(*COLUMNS), quality.fit(docs, labels))
    return scored.filter(F.col("score") >= quality.ACCEPT).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    The one of least doc_id stays (nulls last, ties by a hash of the text), once. Null texts and those
    without words are in no group and stay, repeated rows of them too.
    """
    return ngram_join.one_of_each(docs.select(*COLUMNS), words=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that an earlier place has too.

    "Earlier" is a smaller doc_id (null first), then an earlier place. A document that has no word left
    goes; one from which nothing was cut stays as it is, null and empty texts too. Only whole characters
    are cut. Rows equal in doc_id and text are one document and come out alike, each of them.
    """
    rows = suffix_dedup.deduplicated(docs.select(*COLUMNS).withColumn("_n", F.length("text")))
    emptied = (F.length("text") < F.col("_n")) & ~F.col("text").rlike(mixing.WORD)
    return rows.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weighted mix takes, as often as it takes them, three times at most.

    A null source is a source. Texts without words weigh nothing and are never taken.
    """
    mixed = mixing.mix(docs.select(*COLUMNS)).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens.

    Null and empty texts are one piece, the end id; a document that came several times is packed as often.
    """
    return packing.pack(packing.pieces(docs, tokens.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
