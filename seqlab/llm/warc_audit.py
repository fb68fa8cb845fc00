"""WARC fixity audit: Merkle trees over the records and offset ranges of two stored replicas, opened only where they differ.

``write_archives`` stores pages as WARC/1.0 resource records: an archive file holds the records of one range of ids, in order of id, one after the
other. ``read_leaves`` reads such files back as bytes and walks them: each record says how long it is, so the next one's offset follows; where no
record begins or one is cut short, what stands there up to the next beginning of a record is a torn one. A leaf is the SHA-256 of a record's
bytes with its offset and length; a node is the SHA-256 of its up to FANOUT children in order; the root stands for the file. ``audit`` compares
the roots, then goes down one level at a time, reading only children of nodes that differ, to the records at fault.

No task sees more than FANOUT hashes of a node, or one archive file, which holds FILE_RECORDS ids.

Defined results: a null url or html is written as empty, line ends in a url as spaces; a record that one replica lacks is reported with nulls for
it; records after a change of length move, and are reported as ``moved`` where their bytes agree; rows that repeat an id are records in order
of their bytes; records without an id are dealt to files below zero by their bytes; equal replicas and empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches, tidy

FANOUT = 16
FILE_RECORDS = 1_000
#: Files that records without an id are dealt to.
NO_ID_FILES = 1_000
#: What ends a record.
END = "\r\n\r\n"
#: When the pages were stored, as WARC-Date has it.
DATE = "2024-01-01T00:00:00Z"


def record_text(id_: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """One WARC/1.0 record without the END after it: header block, empty line, payload."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.translate(F.coalesce(url, F.lit("")), "\r\n", "  "), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, file, record (text)."""
    out = pages.select(F.col(id_col).alias("id"), record_text(F.col(id_col), F.col(url_col), F.col(html_col)).alias("record"))
    file = F.coalesce(F.floor(F.col("id") / FILE_RECORDS), -1 - F.pmod(F.xxhash64("record"), F.lit(NO_ID_FILES))).cast("long")
    return out.withColumn("file", file)


def write_archives(found: DataFrame, path: str, compression: str = "gzip") -> None:
    """One archive file for each file number of ``records``, in a folder file=<number>. Spark writes each record as a line that END ends. compression: gzip
    or none; offsets count uncompressed bytes."""
    slim = found.select("file", F.col("record").alias("value"), F.col("id").alias("_id"))
    dealt = slim.repartition("file").sortWithinPartitions("file", "_id", F.sha2("value", 256))
    dealt.select("file", "value").write.partitionBy("file").option("lineSep", END).option("compression", compression).text(path)


def unpacked(data: bytes) -> bytes:
    """The bytes of an archive file, of a damaged gzip stream those before the damage."""
    import zlib

    out = []
    while data.startswith(b"\x1f\x8b"):
        stream = zlib.decompressobj(31)
        try:
            for lo in range(0, len(data), 4096):
                out.append(stream.decompress(data[lo : lo + 4096]))
                if stream.eof:
                    break
        except zlib.error:
            return b"".join(out)
        data = (stream.unused_data + data[lo + 4096 :]) if stream.eof else b""
    return b"".join(out) or data


def walk(data: bytes):
    """(offset, length, id or None, whether torn) of each record of an archive file."""
    start, end, at = b"WARC/1.0\r\n", END.encode(), 0
    while at < len(data):
        head = data.find(end, at)
        fields = dict(line.partition(b":")[::2] for line in data[at:head].split(b"\r\n")[1:]) if head >= 0 and data.startswith(start, at) and data.find(start, at + 1, head) < 0 else {}
        size = fields.get(b"Content-Length", b"").strip()
        to = head + len(end) + int(size) if size.isdigit() else -1
        # after its end the next one begins, or the file ends, maybe within a beginning
        if to >= 0 and data.startswith(end, to) and start.startswith(data[to + len(end) : to + len(end) + len(start)]):
            name = fields.get(b"WARC-Record-ID", b"").strip()[len(b"<urn:page:") : -1]
            yield at, to + len(end) - at, int(name) if name.lstrip(b"-").isdigit() else None, False
            at = to + len(end)
            continue
        after = data.find(start, at + 1)
        to = len(data) if after < 0 else after
        yield at, to - at, None, True
        at = to


def _node(found: DataFrame) -> DataFrame:
    return found.select("file", "seq", "id", "at", "length", "digest", "torn", F.sha2(F.concat_ws(":", "digest", "at", "length").cast("binary"), 256).alias("node"))


def read_leaves(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of the archive files below a folder, from their bytes: file, seq, id, at, length, digest, torn, node."""
    small_batches(spark)
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    file = F.regexp_extract("path", r"file=(-?\d+)/", 1).cast("long")

    def walked(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for number, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                data = unpacked(data.as_py())
                rows = [(number, i, id_, at, n, hashlib.sha256(data[at : at + n]).hexdigest(), torn) for i, (at, n, id_, torn) in enumerate(walk(data))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "seq", "id", "at", "length", "digest", "torn"])
        tidy()

    slim = stored.filter(F.col("length") > 0).select(file.alias("file"), "content")
    return _node(slim.mapInArrow(walked, "file long, seq int, id long, at long, length long, digest string, torn boolean"))


def leaves(found: DataFrame) -> DataFrame:
    """The leaves that ``records`` would have once written. Only digests are shuffled."""
    whole = F.concat("record", F.lit(END)).cast("binary")
    slim = found.select("file", "id", F.length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("digest"), F.sha2("record", 256).alias("_tie"))
    order = Window.partitionBy("file").orderBy("id", "_tie")
    placed = slim.withColumn("seq", F.row_number().over(order) - 1).withColumn("at", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return _node(placed.withColumn("torn", F.lit(False)))


def publish(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Store the pages as archive files in a new folder; the leaves that were read back."""
    write_archives(records(pages, id_col, url_col, html_col), path)
    return read_leaves(pages.sparkSession, path)


def levels(leaf: DataFrame, depth: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The tree of each file, leaves first: file, seq, node. The last level has one node, the root, for each file."""
    out = [leaf.select("file", "seq", "node")]
    for _ in range(depth):
        up = out[-1].groupBy("file", F.floor(F.col("seq") / fanout).cast("int").alias("seq")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "node"))), lambda x: x["node"]), "").alias("all"))
        out.append(cut(up.select("file", "seq", F.sha2(F.col("all").cast("binary"), 256).alias("node")), "level"))
    return out


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """left, right: leaves() of two replicas. file, id, at, length, digest, other_at, other_length, other_digest, fault for each record at fault.

    fault: missing, extra, corrupt (other bytes), moved (the same bytes at another offset) or torn (no whole record, so without an id).
    """
    left, right = cut(left, "leaves"), cut(right, "leaves")
    most = left.agg(F.max("seq")).unionByName(right.agg(F.max("seq"))).agg(F.max("max(seq)")).head()[0]
    depth, reach = 0, 1
    while reach <= (most or 0):
        reach, depth = reach * fanout, depth + 1
    a, b = levels(left, depth, fanout), levels(right, depth, fanout)

    def differ(level: int, within: DataFrame | None) -> DataFrame:
        x, y = a[level], b[level]
        if within is not None:
            up = F.floor(F.col("seq") / fanout).cast("int")
            below = lambda d: d.withColumn("up", up).join(within.select("file", F.col("seq").alias("up")), ["file", "up"], "left_semi").drop("up")
            x, y = below(x), below(y)
        both = x.join(y.withColumnRenamed("node", "other"), ["file", "seq"], "full")
        return cut(both.filter(~F.col("node").eqNullSafe(F.col("other"))).select("file", "seq"), "differ")

    at_fault = None
    for level in range(depth, -1, -1):
        at_fault = differ(level, at_fault)
    # of the places that differ: which records are they in either replica
    count = Window.partitionBy("file", "id").orderBy("digest")
    mine = left.join(at_fault, ["file", "seq"], "left_semi").withColumn("k", F.row_number().over(count))
    other = right.join(at_fault, ["file", "seq"], "left_semi").withColumn("k", F.row_number().over(count))
    other = other.select(F.col("file").alias("of"), F.col("id").alias("oi"), F.col("k").alias("ok"), F.col("at").alias("other_at"), F.col("length").alias("other_length"), F.col("digest").alias("other_digest"), F.col("torn").alias("other_torn"))
    same = (F.col("file") == F.col("of")) & F.col("id").eqNullSafe(F.col("oi")) & (F.col("k") == F.col("ok"))
    torn = F.coalesce(F.col("torn"), F.lit(False)) | F.coalesce(F.col("other_torn"), F.lit(False))
    fault = F.when(torn, "torn").when(F.col("of").isNull(), "missing").when(F.col("file").isNull(), "extra").when(F.col("digest") != F.col("other_digest"), "corrupt").otherwise("moved")
    found = mine.join(other, same, "full")
    return found.select(F.coalesce("file", "of").alias("file"), F.when(F.col("file").isNull(), F.col("oi")).otherwise(F.col("id")).alias("id"), "at", "length", "digest", "other_at", "other_length", "other_digest", fault.alias("fault"))
