"""Exact dedup against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest.  A batch of documents
is folded to one row per digest, a sort-merge anti join finds the digests that the
index does not hold, and those are appended, so a corpus can arrive in batches and
no text is ever compared with all others.  Only SQL functions are used.

Texts are equal when identical after lower-casing A-Z; a null text counts as empty,
and long texts are hashed whole.  Of equal texts of one batch the row with the
largest id stays; a text that an earlier batch brought in loses to that one.  Rows
that share id and text are one document: ``annotate`` marks all of them alike, and
``without_copies`` returns it once.  A row without id stays only if no equal row has
an id; such rows too are one document.  An empty table gives an empty result.  Other
columns are carried; result columns whose name is taken get underscores in front.
"""

from __future__ import annotations

import string
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditrank.llm.frames import unused
from auditrank.session import shared_folder, stage


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    plain = F.coalesce(text, F.lit(""))
    folded = F.when(
        plain.rlike("[A-Z]"), F.translate(plain, string.ascii_uppercase, string.ascii_lowercase)
    ).otherwise(plain)
    return F.unhex(F.sha2(F.encode(folded, "UTF-8"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """The index at ``path``, known to the session as table ``name``.

    The number of buckets is fixed when the index is made; choose it so that a
    bucket of the final size (about 40 bytes a text) can be sorted by one task.
    """

    spark: SparkSession
    path: str
    buckets: int
    id_type: str = "bigint"

    @property
    def name(self) -> str:
        return f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"

    def table(self) -> DataFrame:
        """(digest, keep_id), as written so far; made on first use."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {self.id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        """Adds rows (digest, keep_id).  The write becomes visible as a whole."""
        self.table()
        (
            new.select("digest", F.col("keep_id").cast(self.id_type).alias("keep_id"))
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )


def new_index(spark: SparkSession, id_type: str = "bigint") -> DigestIndex:
    """An empty index in the shared folder, with a bucket per shuffle partition."""
    path = f"{shared_folder(spark)}/digest-index-{uuid.uuid4().hex}"
    return DigestIndex(spark, path, int(spark.conf.get("spark.sql.shuffle.partitions")), id_type)


def add(digests: DataFrame, index: DigestIndex) -> DataFrame:
    """Adds a batch of rows (digest, id) to the index; one row per digest of the
    batch: digest, keep_id, group_size (rows of the batch).

    A batch that is added again, after a failure say, finds its own digests and
    gives the same result.
    """
    groups = stage(
        digests.groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("group_size")), "digest-groups"
    )
    known = index.table()
    fresh = groups.join(known.hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", F.col("last").alias("keep_id")))
    kept = groups.join(index.table().hint("merge"), "digest").select("digest", "keep_id", "group_size")
    # Written, so that a join with it shuffles both sides and a hot digest can be split.
    return stage(kept, "digest-keeps")


def annotate(docs: DataFrame, index: DigestIndex, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with text_digest (binary), keep_id, group_size and kept."""
    found, keep_id, group_size, kept = unused(docs, "text_digest", "keep_id", "group_size", "kept")
    marked = docs.withColumn(found, digest(F.col(text)))
    # The batch reaches the index as ids and digests; texts meet the result only.
    rows = stage(marked.select(F.col(found).alias("digest"), F.col(id).alias("id")), "digests")
    names = {"digest": found, "keep_id": keep_id, "group_size": group_size}
    groups = add(rows, index).withColumnsRenamed(names)
    # A common text is one key with many rows on the left; AQE splits it.
    return marked.join(groups, found).withColumn(kept, F.col(id).eqNullSafe(F.col(keep_id)))


def without_copies(docs: DataFrame, index: DigestIndex, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of ``docs`` that stay, each once."""
    found, keep_id, group_size, kept, same = unused(docs, "text_digest", "keep_id", "group_size", "kept", "_same")
    staying = annotate(docs, index, id, text).where(kept)
    times = staying.groupBy(found).agg(F.count("*").alias(same))
    once = staying.join(times, found)
    # Texts are shuffled only where an id is repeated.
    repeated = once.where(F.col(same) > 1).dropDuplicates([found])
    return once.where(F.col(same) == 1).unionByName(repeated).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = stage(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    groups = add(rows.withColumnRenamed("doc_id", "id"), new_index(spark, docs.schema["doc_id"].dataType.simpleString()))
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
