"""The corpus pipeline over documents: five stages, each over all that the one before kept.

Language ID rejects documents without a language (null or no letter) and those that aren't like
the labelled texts of any learnt language (junk, keys, tables, other languages), line dedup drops lines
that an earlier document holds (and documents that consist of such lines), near-dedup keeps the document with the smallest id of each
group of likeness 0.8 or more, decontamination rejects documents that hold a benchmark item,
and encoding gives the piece ids and the text that they decode to. All stages but the last
return the columns of documents; n_chars follows the text.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdframe.llm import decontaminate, language_id, line_dedup, near_dedup, pieces
from herdframe.llm.common import bounded, table, whole, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The likeness of near-duplicates in per cent with the width of bands that finds it.
PERCENT, BAND = 80, 5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: `und`, or a text unlike the language's labelled ones."""
    bounded(spark)
    model = language_id.fit(docs.select("text", "lang"))
    return language_id.predict(docs, model, like="known").where("known").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that a document with a smaller id holds too, and documents of which nothing is left so."""
    bounded(spark)
    lines = line_dedup.deduped_lines(docs, keep=("lang", "source"))
    return lines.where((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest id."""
    bounded(spark)
    found = near_dedup.near_duplicates(docs, percent=PERCENT, width=BAND)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    bounded(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows: doc_id, lang, source, n_tokens, ids, text (decoded from the ids)."""
    bounded(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select("doc_id", "lang", "source", whole("text").alias("text"))
    coded = rows.select("doc_id", "lang", "source", pieces.coded(rows, model).alias("coded"))
    return coded.select("doc_id", "lang", "source", F.size("coded.ids").cast("long").alias("n_tokens"), "coded.ids", "coded.text")


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("encoding", encode)]

#: Perfect hashes, sketches, alignments and merges aren't SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages keep of documents. Each stage but the last is written once, in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
