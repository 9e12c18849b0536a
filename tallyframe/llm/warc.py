"""WARC archives: written from pages, and read back by the chain of their records.

The archives are text that Spark writes: a record is its header, an empty line and its block, and
the writer's separator is the two line ends that close a record. A record's block is an HTTP head
and the payload; a revisit has the head alone, whose length is that of the full payload.

Reading: the magic ``WARC/1.`` separates the reader's lines, so every place that may begin a record
begins a line, whichever task reads it. The lengths of the lines before it give its offset, and the
header behind it the offset of its successor, if it is a record at all. Which candidates are records
is found by pointer jumping: the start of each file is marked; in each round every pointer doubles
its reach and what a marked candidate points at is marked. Magic inside payloads is never reached.
A payload that holds magic lies on several lines; those of its file are read again and put together.

Built-in functions throughout; a payload is never shuffled but for that last case, and if more than
``SMALL`` payloads have copies. Null payloads are empty, null ids come back as null. Of equal
payloads of at least 100 bytes all rows with the smallest id are responses (more than one where rows
repeat; null ids come last), the others revisit them. A table without rows gives none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir

MAGIC = "WARC/1."
EOL = "\r\n"
#: Payloads of fewer bytes are never deduplicated.
LEAST_BYTES = 100
#: Rows (a digest and an id, about 100 bytes each) up to which the payloads that have copies are broadcast.
SMALL = 200_000
#: A payload with more than this part of all rows is joined by broadcast, too: there can't be more such payloads.
HOT = 4096


class BrokenArchive(ValueError):
    """The chain of records doesn't lead from a file's start to its end, or a record isn't what its header says."""


def first_copies(pages: DataFrame, page_id: str, digest: Column, size: Column) -> DataFrame:
    """(digest, first, copies) of the payloads that more than one row has and that are long enough."""
    rows = pages.select(digest.alias("digest"), size.alias("size"), F.col(page_id).alias("id")).where(F.col("size") >= LEAST_BYTES)
    return rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def with_first_copy(pages: DataFrame, copies: DataFrame, digest: str, small: int = SMALL) -> DataFrame:
    """``pages`` with ``copies.first``. Up to ``small`` payloads are broadcast; of more, those that few rows share are joined by shuffle."""
    if copies.limit(small + 1).count() <= small:
        return pages.join(F.broadcast(copies.select(digest, "first")), digest, "left")
    hot = F.col("copies") * HOT > pages.count()
    often = pages.join(F.broadcast(copies.where(hot).select(digest, "first")), digest)
    seldom = pages.join(F.broadcast(copies.where(hot).select(digest)), digest, "left_anti").join(copies.where(~hot).select(digest, "first"), digest, "left")
    return often.unionByName(seldom)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", small: int = SMALL) -> None:
    """One record a row, one file a partition."""
    body = F.coalesce(F.col(payload), F.lit(""))
    digest, size = F.sha2(body, 256), F.octet_length(body).cast("long")
    copies = materialize(first_copies(pages, page_id, digest, size), "copies")
    link = F.col(url) if url in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("own"), link.alias("url"), body.alias("body"), digest.alias("digest"), size.alias("size"))
    x = with_first_copy(rows, copies, "digest", small)
    again = F.col("first").isNotNull() & ~F.col("own").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    where = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:x-page:"), F.coalesce("id", F.lit("none"))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL + EOL))
    block = F.when(again, http).otherwise(F.concat(http, "body"))
    fields = [
        ("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", name(F.col("id"))), ("WARC-Target-URI", where),
        ("WARC-Date", F.lit("1970-01-01T00:00:00Z")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), ("WARC-Refers-To", F.when(again, name(F.col("first")))),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string")),
    ]
    head = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(EOL))).otherwise("") for k, v in fields]
    record = F.concat(F.lit(f"{MAGIC}0{EOL}"), *head, F.lit(EOL), block)
    x.select(record.alias("value")).write.option("lineSep", EOL + EOL).text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic and magic: (file, file_bytes, split, line, value), ``line`` rising within a split."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    m = F.col("_metadata")
    return raw.select(
        m["file_path"].alias("file"), m["file_size"].alias("file_bytes"), m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("line"), "value"
    )


def _placed(lines: DataFrame) -> DataFrame:
    """``off``, where the magic before each line stands in its file: lines follow each other without gaps, split after split.

    A window takes the lines of one split, another the splits of one file. The line before a
    file's first magic has a negative offset.
    """
    own = Window.partitionBy("file", "split").orderBy("line")
    x = lines.withColumn("upto", F.sum(F.col("bytes") + len(MAGIC)).over(own))
    splits = x.groupBy("file", "split").agg(F.max("upto").alias("whole"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "split", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("base"))
    off = F.col("base") + F.col("upto") - F.col("bytes") - 2 * len(MAGIC)
    return x.join(bases, ["file", "split"]).withColumn("off", off.cast("long")).drop("upto", "base", "line", "split")


def _field(head: Column, name: str, value: str = "[^\r\n]*") -> Column:
    found = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*({value})[ \t]*(?:\r\n|$)", 1)
    return F.when(found != "", found)


def _parsed(value: Column) -> dict[str, Column]:
    """A record's fields, as far as the line holds them: null where it can't be one."""
    head = F.substring_index(value, EOL + EOL, 1)
    skip, whole = F.octet_length(head) + 4, F.octet_length(value)
    length = _field(head, "Content-Length", "[0-9]{1,18}").cast("long")
    is_head = F.regexp_like(head, F.lit(r"^[0-9]+\r\n")) & (skip <= whole) & length.isNotNull()
    block = F.when(is_head & (whole - skip >= length), F.substring(value.cast("binary"), skip + 1, length.cast("int")))
    return {
        "record_bytes": F.when(is_head, len(MAGIC) + skip + length + 4), "record_type": _field(head, "WARC-Type"), "record_id": _field(head, "WARC-Record-ID"),
        "refers": _field(head, "WARC-Refers-To"), "said_digest": _field(head, "WARC-Payload-Digest"), "is_http": _field(head, "Content-Type", "application/http[^\r\n]*").isNotNull(),
        "block": block,
    }


def _payload(x: DataFrame) -> DataFrame:
    """Columns of the payload in place of ``block``: for HTTP, what follows its head."""
    http = F.when(F.col("is_http"), F.substring_index(F.col("block").cast("string"), EOL + EOL, 1))
    body = F.when(F.col("is_http"), F.octet_length(http) + 4).otherwise(0)
    size = F.greatest(F.octet_length("block") - body, F.lit(0)).cast("long")
    digest = F.when(F.col("block").isNotNull(), F.sha2(F.substring(F.col("block"), body + 1, size.cast("int")), 256))
    return x.withColumns({"said_bytes": _field(F.concat(F.lit(EOL), http), "Content-Length", "[0-9]{1,18}").cast("long"), "payload_bytes": size, "payload_digest": digest}).drop("block", "is_http")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place with magic: (file, file_bytes, off, next, fields of a record); ``next`` is null where no header follows."""
    x = _lines(spark, path)
    x = x.withColumn("bytes", F.octet_length("value").cast("long")).withColumns(_parsed(F.col("value"))).drop("value")
    x = _placed(_payload(x)).where("off >= 0")
    return x.withColumn("next", F.col("off") + F.col("record_bytes")).drop("bytes", "record_bytes")


def reachable(places: DataFrame) -> DataFrame:
    """(file, off) of the candidates on the chain from their file's start; ``places`` is read several times.

    A round doubles how far pointers reach, so a file of n records takes log2(n) + 1 rounds, and a
    round is one join and one sum over narrow rows. Pointers that lead to no candidate end there.
    """
    target = places.select("file", F.col("off").alias("next"), F.lit(True).alias("there"))
    near = places.select("file", "off", "next").join(target, ["file", "next"], "left")
    state = near.select("file", "off", F.when(F.col("there"), F.col("next")).alias("next"), (F.col("off") == 0).alias("marked"))
    state = materialize(state, "chain")
    while state.where("marked AND next IS NOT NULL").limit(1).count():
        ahead = state.where("next IS NOT NULL").select("file", F.col("off").alias("back"), F.col("next").alias("off"), "marked")
        met = ahead.join(state.select("file", "off", "next"), ["file", "off"])
        moved = met.select("file", F.col("back").alias("off"), "next", "marked")
        marks = met.where("marked").select("file", "off", F.lit(None).cast("long").alias("next"), "marked")
        every = moved.unionByName(marks).unionByName(state.where("next IS NULL"))
        state = materialize(every.groupBy("file", "off").agg(F.max("next").alias("next"), F.max("marked").alias("marked")), "chain")
    return state.where("marked").select("file", "off")


def _pieced(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The payload columns of the records ``wanted`` (file, off, next, is_http), each put together from its lines.

    Only the files that hold such a record are read again, their lines brought to one order a file.
    """
    files = wanted.select("file").distinct()
    lines = _lines(spark, path).join(files, "file", "left_semi").withColumn("bytes", F.octet_length("value").cast("long"))
    x = _placed(lines).join(wanted.select("file", "off", F.col("next").alias("end"), F.col("off").alias("start")), ["file", "off"], "left")
    upto = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("start", "end")}).where("off >= start AND off < end")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("off", "value"))), lambda p: p["value"])
    x = x.groupBy("file", F.col("start").alias("off")).agg(F.array_join(parts, MAGIC).alias("value"))
    fields = _parsed(F.col("value"))
    return _payload(x.withColumns({"is_http": fields["is_http"], "block": fields["block"]})).select("file", "off", "payload_bytes", "payload_digest", "said_bytes")


def _refuse(found: DataFrame, why: str) -> None:
    if bad := found.limit(1).collect():
        raise BrokenArchive(f"{why}: {bad[0].asDict()}")


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, off, record_type, record_id, refers, said_digest, said_bytes, payload_bytes, payload_digest) of the records of all files below ``path``.

    ``strict`` raises ``BrokenArchive`` where a file's chain doesn't start at its first byte and end
    at its last, where a response's payload hasn't the stated digest, or where a revisit names one
    that no response has; without it the records up to a break are given.
    """
    places = materialize(candidates(spark, path), "candidates")
    records = materialize(places.join(reachable(places), ["file", "off"], "left_semi"), "records")
    torn = records.where("payload_digest IS NULL AND next <= file_bytes")
    if torn.limit(1).count():
        whole = _pieced(spark, path, torn)
        kept = records.where("NOT (payload_digest IS NULL AND next <= file_bytes)")
        parts = torn.drop("payload_bytes", "payload_digest", "said_bytes").join(whole, ["file", "off"])
        records = materialize(kept.unionByName(parts), "records")
    records = records.where("payload_digest IS NOT NULL")
    if strict:
        ends = records.groupBy("file").agg(F.max("next").alias("end"))
        files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), F.col("length").alias("file_bytes"))
        _refuse(files.join(ends, "file", "left").where("end IS NULL OR end <> file_bytes"), "the chain of records breaks")
        response = F.col("record_type") == "response"
        said = F.substring_index("said_digest", ":", -1)
        _refuse(records.where(response & said.isNotNull() & (said != F.col("payload_digest"))).select("file", "off", "said_digest", "payload_digest"), "a payload isn't what its header says")
        asked = records.where("record_type = 'revisit'").select("said_digest").distinct()
        _refuse(asked.join(records.where(response).select("said_digest").distinct(), "said_digest", "left_anti"), "no response has what a revisit refers to")
    return records.drop("file_bytes", "next")


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of what ``write_archives`` wrote; a revisit has the length and digest of the payload it stands for."""
    own = lambda c: F.nullif(F.regexp_extract(c, r"<urn:x-page:(.*)>", 1), F.lit("none"))
    again = F.col("record_type") == "revisit"
    return records.select(
        own("record_id").alias("page_id"), F.when(again, F.col("said_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.substring_index("said_digest", ":", -1)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type",
        F.when(again, own("refers")).alias("refers_to"),
    )


def through_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", small: int = SMALL) -> DataFrame:
    """Writes the pages to archives in the shared folder and gives what is read back, ids in the type they had."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, page_id, url, payload, small)
    kind = pages.schema[page_id].dataType
    out = page_records(read_archives(spark, path))
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
