"""WARC archives: written as text, read back by boundary-chain verification.

Writing: one record per page, the payload its html.  Of equal payloads of at
least 100 bytes the one of smallest id is a response, the others are revisits
without a body that name it.  Spark's text writer makes the files.

Reading: Spark's text reader cuts a file at the magic line wherever it occurs,
also inside payloads and across splits.  Each piece is a candidate record; its
header tells where its successor must start.  Pointer jumping from the start of
each file, with links of doubling length, marks the candidates that a chain of
records reaches; all others are payload bytes, and a payload is put together
again from the pieces that its record spans.

Defined results: a NULL html is an empty payload.  Empty tables give no record.
A file that does not begin with the magic has no record.  Pages with a NULL id
are written but never referred to.  A chain ends at a candidate whose header
gives no length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditrank.llm.frames import unused
from auditrank.session import shared_folder, stage

MAGIC = "WARC/1.1\r\n"
#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT_BYTES = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame) -> DataFrame:
    """``pages`` plus ``payload_bytes``, ``payload_digest``, ``record_type`` and
    ``refers_to``; columns of these names are replaced."""
    pages = pages.drop("payload_bytes", "payload_digest", "record_type", "refers_to")
    html = F.coalesce("html", F.lit(""))
    known = pages.withColumns(
        {"payload_bytes": F.octet_length(html).cast("long"), "payload_digest": F.sha2(F.encode(html, "utf-8"), 256)}
    )
    (digest,) = unused(known, "_digest")
    # Only payloads that occur again get a row; folded before the shuffle.  The
    # table is written first, so Spark knows its size when it plans the join: a
    # small one is sent to the pages, and they are not shuffled.
    again = stage(
        known.where(F.col("payload_bytes") >= LEAST_REVISIT_BYTES)
        .groupBy(F.col("payload_digest").alias(digest))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull())
        .drop("_n"),
        "warc-payloads",
    )
    first = F.when(F.col("page_id").eqNullSafe(F.col("_first")), None).otherwise(F.col("_first"))
    return (
        known.join(again, F.col("payload_digest") == F.col(digest), "left")
        .withColumn("refers_to", F.when(F.col("payload_bytes") >= LEAST_REVISIT_BYTES, first).cast("long"))
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
        .drop(digest, "_first")
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _one_line(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def write(pages: DataFrame, path: str) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files below ``path``.

    A revisit keeps digest and length of the payload that it stands for.
    """
    typed = record_types(pages.select("page_id", "url", "html"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.coalesce("html", F.lit("")))
    lines = [
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(_urn(F.col("page_id")), F.lit("<urn:page:none>"))),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "payload_digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body)
    # The writer puts the separator after each record, which is the blank pair
    # of lines that ends one.
    typed.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two occurrences of the magic, with its place in the
    files: (file, block, at, raw, head).  Equal for every scan of a file."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("raw"),
        F.substring_index("value", "\r\n\r\n", 1).alias("head"),
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """``pieces`` (file, block, at, size, ...) with their ``offset`` in the file.

    Offsets are sums of the sizes before: within a split first, then over the
    splits of a file.  A file begins with the magic, so its first piece is empty
    and the second one is the record at offset 0.
    """
    in_split = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("file", "block").agg(F.sum("size").alias("_size"))
    starts = sizes.select("file", "block", F.coalesce(F.sum("_size").over(in_file), F.lit(0)).alias("_start"))
    return (
        pieces.withColumn("_before", F.coalesce(F.sum("size").over(in_split), F.lit(0)))
        .join(starts, ["file", "block"])
        .withColumn("offset", F.col("_start") + F.col("_before") - len(MAGIC))
        .drop("_before", "_start", "block", "at")
    )


def _size() -> Column:
    return (F.octet_length("raw") + len(MAGIC)).cast("long").alias("size")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per occurrence of the magic: (file, offset, successor), the header
    fields, and the payload's digest where the record ends with its piece."""
    pieces = _pieces(spark, path).withColumn("_length", F.trim(_header("Content-Length")))
    split = F.octet_length("head") < F.octet_length("raw")
    body_at = F.octet_length("head") + 4
    length = F.expr("try_cast(`_length` AS BIGINT)")
    span = F.when(split & (length >= 0), body_at + length + 4 + len(MAGIC))
    payload = F.substring("raw", body_at + 1, length.cast("int"))
    parsed = pieces.select(
        "file", "block", "at", _size(),
        span.alias("span"),
        body_at.alias("body_at"),
        length.alias("length"),
        _header("WARC-Type").alias("type"),
        _header("WARC-Record-ID").alias("id"),
        _header("WARC-Refers-To").alias("refers"),
        F.when(span == F.octet_length("raw") + len(MAGIC), F.sha2(payload, 256)).alias("digest"),
    )
    # The scan is written once: places in it must not change between reads.
    return _placed(stage(parsed, "warc-pieces")).withColumn("successor", F.col("offset") + F.col("span"))


def reachable(edges: DataFrame) -> DataFrame:
    """(file, offset) of all candidates that the chain from offset 0 reaches.

    ``edges`` (file, offset, successor).  After round k the links are 2^k records
    long and everything within 2^k records of the start is marked.
    """
    jump = stage(edges.where("successor IS NOT NULL").select("file", "offset", F.col("successor").alias("to")), "warc-links")
    seen = stage(edges.where("offset = 0").select("file", "offset").distinct(), "warc-seen")
    while True:
        more = seen.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        seen = stage(seen.unionByName(more), "warc-seen")
        over = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
        jump = stage(
            jump.join(over, ["file", "to"]).select("file", "offset", F.col("further").alias("to")), "warc-links"
        )
        if jump.isEmpty():
            return seen


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``: (file, offset, type, id, refers,
    payload_bytes, payload_digest), the last two from the bytes stored."""
    found = stage(candidates(spark, path), "warc-candidates")
    marks = reachable(found.select("file", "offset", "successor")).distinct()
    records = found.where("successor IS NOT NULL").join(marks, ["file", "offset"])
    columns = ["file", "offset", "type", "id", "refers", F.col("length").alias("payload_bytes")]
    whole = records.where("digest IS NOT NULL").select(*columns, F.col("digest").alias("payload_digest"))
    broken = records.where("digest IS NULL")
    if broken.isEmpty():
        return whole
    joined = _put_together(spark, path, found, marks, broken.select("file", "offset", "successor"))
    return whole.unionByName(broken.drop("digest").join(joined, ["file", "offset"]).select(*columns, "payload_digest"))


def _put_together(spark: SparkSession, path: str, found: DataFrame, marks: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, offset, payload_digest) of records whose payload holds the magic.

    A piece belongs to the last reachable record at or before it.  The window
    sees two numbers per piece of one file.
    """
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("_hit"), F.col("offset")), True).over(before)
    owned = (
        found.select("file", "offset").join(marks.withColumn("_hit", F.lit(True)), ["file", "offset"], "left")
        .withColumn("start", owner)
        .select("file", "offset", "start")
    )
    wanted = owned.join(broken.select("file", F.col("offset").alias("start"), "successor"), ["file", "start"])
    raw = _placed(_pieces(spark, path).select("file", "block", "at", _size(), "raw"))
    parts = wanted.join(raw, ["file", "offset"]).groupBy("file", "start", "successor").agg(
        F.array_sort(F.collect_list(F.struct("offset", "raw"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["raw"].cast("string")), MAGIC).cast("binary")
    head = F.octet_length(F.substring_index(F.col("all").cast("string"), "\r\n\r\n", 1)) + 4
    body = F.substring("all", head + 1, (F.col("successor") - F.col("start")).cast("int") - len(MAGIC) - head - 4)
    return parts.withColumn("all", text).select(
        "file", F.col("start").alias("offset"), F.sha2(body, 256).alias("payload_digest")
    )


def report(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives and reads them back: one row per page with
    length and digest of its full payload, which a revisit takes from the record
    that it refers to."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    records = stage(read(spark, path), "warc-records")
    plain = records.where("type != 'revisit'").select(
        _page(F.col("id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    )
    bodies = records.where("type = 'response'").groupBy(F.col("id").alias("refers")).agg(
        F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest")
    )
    revisits = records.where("type = 'revisit'").select("id", "refers", "type").join(bodies, "refers", "left").select(
        _page(F.col("id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        _page(F.col("refers")).alias("refers_to"),
    )
    return plain.unionByName(revisits)


def _page(urn: Column) -> Column:
    """The page's id from its record's name, or NULL."""
    number = F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1)
    return F.when(number != "", number.cast("long"))
