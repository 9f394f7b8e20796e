"""Clean a corpus and encode it: five stages, each a table in the shared folder.

Every stage takes all that its predecessor kept.  Stages but the last return the
columns of their input; the last one adds the tokens and the digest of what they
decode to.  Null and empty texts pass every stage that does not reject them and end
with no tokens; very long texts are taken whole; rows that are equal in all columns
are near copies of each other, of which one stays; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditrank.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from auditrank.llm.frames import ship, table, unused
from auditrank.llm.queries import vocabulary_path
from auditrank.session import stage

_HAS_WORD = "[^\\x09-\\x0D ]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go, and with its last line a document.

    A document that had no word to begin with stays as it is.
    """
    ship(spark)
    (removed,) = unused(docs, "_removed_lines")
    cut = line_dedup.dedup_lines(docs, removed)
    emptied = (F.size(removed) > 0) & ~F.col("text").rlike(_HAS_WORD)
    kept = cut.where(~emptied).drop(removed)
    if "n_chars" not in docs.columns:
        return kept
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, 0.8."""
    ship(spark)
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts as token ids, and the digest of the text that they decode to."""
    ship(spark)
    path = vocabulary_path()
    (again,) = unused(docs, "_decoded")
    decoded = bpe.decode(bpe.encode(docs, path, "token_ids"), path, "token_ids", again)
    return (
        decoded.withColumn("n_tokens", F.size("token_ids").cast("long"))
        .withColumn("decoded_sha256", F.sha2(F.encode(again, "utf-8"), 256))
        .drop(again)
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Models, sketches and merges have no SQL twin; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
