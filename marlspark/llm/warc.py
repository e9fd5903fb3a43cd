"""WARC archives: written by Spark tasks, read back in byte ranges, with record boundaries verified by their chain.

Reading cuts files at the magic that begins a record.  Since a payload may hold the same bytes, every cut is only a candidate;
a task emits it with its successor, the offset that its declared length leads to.  Candidates that lead straight to the next one in a
task's range form a run.  From each file's start, pointer jumping over runs marks the runs that the chain enters; a candidate
is a record if its run is entered at or before it.  All else is payload.  A record whose payload holds the magic is put together
from its stretches in a second read of the archives, of which only the stretches that are asked for go on; they are known by their file and SHA-256, so it
doesn't matter how either read cuts the files into tasks.

``round_trip`` fails if fewer or more records are read than were written, or if a payload doesn't have the size and digest that its header says.

Archives are one file a writing task (``most_records`` a file at most), so lost tasks are written anew.  Of equal payloads of at least
``least`` bytes the one with the largest page_id is a response and the others revisit it without payload.  Equal means equal size and SHA-256.

Defined results: a null html is an empty payload; a null url is an empty target; a null page_id counts as smaller than any other and comes back as
null; rows that repeat page_id and payload are all responses if theirs is the largest page_id; an empty table gives an empty table; very long payloads are
one record; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_by_bytes, new_path, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_())]
FIELDS_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(record): one WARC record per page, without the mark that ends it."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"n": F.octet_length("html").cast("long"), "sha": F.sha2("html", 256)})
    repeated = p.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max("page_id").alias("keep"), F.count("*").alias("copies")).where("copies > 1")
    # written first, so that the join is a broadcast only where its size is known to be small; pages of much repeated payloads stay where they are
    repeated = stored(repeated, "warc-repeated")
    most = (repeated.agg(F.sum("copies")).first()[0] or 0) // 4096
    hot = F.broadcast(repeated.where(F.col("copies") > most).drop("copies"))  # fewer than 4096 rows
    cold = p.join(hot.select("sha", "n"), ["sha", "n"], "left_anti").join(repeated.where(F.col("copies") <= most).drop("copies"), ["sha", "n"], "left")
    p = p.join(hot, ["sha", "n"]).unionByName(cold)
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">\r\n"))
    return p.select(
        F.concat(
            F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
            F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
            F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", ""),
            F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("keep"))).otherwise(F.lit("\r\n")),
            F.lit("WARC-Payload-Digest: sha1:"), F.sha1("html"),
            F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
            F.lit("\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("n").cast("string")),
            F.lit(END), F.when(revisit, "").otherwise(F.col("html")),
        ).alias("record")
    )


def write(pages: DataFrame, path: str, least: int = 1000, most_records: int = 100_000) -> None:
    records(pages, least).write.option("lineSep", END).option("maxRecordsPerFile", most_records).text(path)


HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")


def _header(data: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """The header's length, its closing blank line included, and fields; nothing if it isn't one."""
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {k.lower(): v for k, v in HEADER.findall(data[: stop + 2])}
    if b"warc-type" not in fields or not fields.get(b"content-length", b"").isdigit():
        return None
    return stop + 4, fields


def _urn(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def _record(fields: dict[bytes, bytes], payload: bytes) -> tuple:
    kind = fields[b"warc-type"].decode()
    digest, size = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:"), int(fields.get(b"x-payload-length") or len(payload))
    if kind != "revisit":
        good = hashlib.sha1(payload).hexdigest()
        return _urn(fields.get(b"warc-record-id")), len(payload), good, kind, None, digest in ("", good) and size == len(payload)
    return _urn(fields.get(b"warc-record-id")), size, digest, kind, _urn(fields.get(b"warc-refers-to")), not payload


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(data, file, block, sha): what stands between two magics, in the order of the file within each block."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("data"), *meta, F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("sha"))


def _placed(batches):
    """Each segment with its distance from the block's first one."""
    where, at = None, 0
    for b in batches_by_bytes(batches, 0):
        for data, file, block, sha in zip(*(c.to_pylist() for c in b.columns)):
            if (file, block) != where:
                where, at = (file, block), 0
            yield file, block, at, data, sha
            at += len(data) + len(MAGIC)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, run, exit, closed, and the fields of a closed record): what each task sees in its ranges."""
    kinds = [("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("sha", pa.binary()), ("span", pa.int64()), ("run", pa.int64()), ("closed", pa.bool_()), *FIELDS]

    def run(batches):
        out, now, streak, before = [], None, 0, False

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], [k for k, _ in kinds])

        for file, block, rel, data, sha in _placed(batches):
            if (file, block) != now or not before:
                streak = streak + 1 if (file, block) == now else 0
                now = file, block
            head = _header(data)
            span = head[0] + int(head[1][b"content-length"]) + len(END) if head else None
            before = span == len(data)
            fields = _record(head[1], data[head[0] : span - len(END)]) if before else (None,) * len(FIELDS)
            out.append((file, block, rel, len(data), sha, span, streak, before, *fields))
            if len(out) >= 5000:
                yield emit()
                out = []
        if out:
            yield emit()

    found = stored(
        _segments(spark, path).mapInArrow(run, f"file string, block long, rel long, size long, sha binary, span long, run long, closed boolean, {FIELDS_SQL}"), "warc-segments"
    )
    length = found.groupBy("file", "block").agg((F.max(F.struct("rel", "size"))).alias("last"))
    length = length.select("file", "block", (F.col("last.rel") + F.col("last.size") + len(MAGIC)).alias("length"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block of a file
    base = length.select("file", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))
    at = F.col("base") + F.col("rel") - len(MAGIC)  # the magic itself stands before its segment
    placed = found.join(base, ["file", "block"]).withColumn("at", at).withColumn("successor", F.col("at") + len(MAGIC) + F.col("span"))
    leaves = placed.groupBy("file", "block", "run").agg(F.max_by("successor", "at").alias("exit"))
    return stored(placed.where("at >= 0").join(leaves, ["file", "block", "run"]), "warc-candidates")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from their file's start."""
    runs = ["file", "block", "run"]
    nodes = found.select("file", "at", *runs[1:], F.col("exit").alias("to"))
    jump = nodes.select("file", "at", "to").where("to > at")
    reach = found.select("file", F.lit(0).cast("long").alias("at")).distinct()
    known = -1
    while True:
        # after k rounds: reach holds all that is less than 2**k jumps from the start, and jump leads 2**k jumps on
        reach = stored(reach.union(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reach")
        if (n := reach.count()) == known:
            break
        known = n
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        jump = stored(jump.join(onward, ["file", "to"]).select("file", "at", F.col("next").alias("to")), "warc-jump")
    entered = nodes.join(reach, ["file", "at"]).groupBy(*runs).agg(F.min("at").alias("entry"))
    return found.join(entered, runs).where("at >= entry")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    found = candidates(spark, path)
    good = stored(reachable(found), "warc-records")
    names = [k for k, _ in FIELDS]
    whole = good.where("closed").select(*names)
    parts = stored(_parts(found, good), "warc-parts")
    if parts.isEmpty():
        return whole

    def assemble(batches):
        for b in batches:
            rows = []
            for stretches in b.column(0).to_pylist():
                data = MAGIC.encode().join(s["data"] for s in stretches)
                size, fields = _header(data)
                rows.append(_record(fields, data[size : size + int(fields[b"content-length"])]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), FIELDS)], names)

    asked = parts.select("file", "sha").distinct()
    data = _segments(spark, path).select("file", "sha", "data").join(asked, ["file", "sha"], "left_semi").dropDuplicates(["file", "sha"])
    lost = F.raise_error(F.lit("a stretch of a record was not read again"))
    pieces = parts.join(data, ["file", "sha"], "left").select("file", "at", "owner", F.coalesce("data", lost.cast("binary")).alias("data"))
    pieces = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("stretches"))
    return whole.union(pieces.select("stretches").mapInArrow(assemble, FIELDS_SQL))


def _parts(found: DataFrame, good: DataFrame) -> DataFrame:
    """(file, at, sha, owner): the segments of records whose payload holds the magic."""
    marks = found.join(good.select("file", "at", F.lit(True).alias("good")), ["file", "at"], "left")
    upto = Window.partitionBy("file").orderBy("at")  # a short row a record of a file, of which a file has a bounded number
    own = F.last(F.when(F.col("good"), F.struct("at", "closed")), ignorenulls=True).over(upto)
    return marks.withColumn("own", own).where("not own.closed").select("file", "at", "sha", F.col("own.at").alias("owner"))


def round_trip(pages: DataFrame, least: int = 1000, most_records: int = 100_000) -> DataFrame:
    """Write ``pages`` to archives in the workspace and read them back; fails where what is read is not what was written."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least, most_records)
    out = stored(read(pages.sparkSession, path), "warc-read")
    if (n := out.count()) != (m := pages.count()):
        raise RuntimeError(f"{m} records were written and {n} read")
    return out.where(F.when(F.col("verified"), True).otherwise(F.raise_error(F.lit("a payload is not what its header says")).cast("boolean")))
