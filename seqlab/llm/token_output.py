"""Token-ID output: documents' ids in files, each document compressed by itself with one shared zstandard dictionary.

Layout of a written folder (Parquet throughout, so that any store Spark reads will do):

* ``dictionary``: one row, the dictionary's bytes and their sha256 (``dict_hash``). It is trained on the serialized id arrays of a bounded
  sample: SAMPLE_DOCS documents, those with the smallest hash of id and length, the first SAMPLE_BYTES of each array.
* ``shards``: part, shard (in order of file, which is that of ascending id), payload (concatenated frames, SHARD_BYTES or one document), dict_hash,
  n_tokens, docs (of each document id, at, size, n_tokens, start).
* ``index``: id, part, shard, at, size (the frame's place in the payload), n_tokens, start (ids before it in its part), in order of id.

``read_documents`` decodes whole shards. ``read_some`` looks documents up in the index and opens the shards that hold them, no others: both tables
are in order, so Spark's readers skip the files and row groups whose bounds do not fit. Both refuse a payload whose dict_hash is not that of the
dictionary they hold.

Defined results: a null text is empty and has the end id alone; null ids come first; rows that repeat an id are in order of a hash of
their texts, and may be in several parts; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, small_batches
from .tokenise import encode_batches

SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 16_384
DICT_BYTES = 65_536
SHARD_BYTES = 4_000_000
#: Bytes of a row group of the index, the least that a lookup reads.
INDEX_BYTES = 1_000_000
LEVEL = 3


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary for serialized id arrays; where there is too little to train on, the samples themselves are its raw content."""
    import zstandard as zstd

    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstd.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b"".join(samples)[-size:]
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    import zstandard as zstd

    return zstd.ZstdCompressionDict(raw) if raw else None


def fit_dictionary(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> bytes:
    """From the SAMPLE_DOCS ids with the smallest hashes, and one text of each: an id with many rows is no larger a sample. A sample is SAMPLE_BYTES
    characters at most, from anywhere in its text."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("_i"), F.col(text_col).alias("_text"))
    chosen = rows.select("_i").distinct().orderBy(F.xxhash64("_i"), "_i").limit(SAMPLE_DOCS)
    at = 1 + F.pmod(F.xxhash64("_text"), F.greatest(F.lit(1), F.length("_text") - SAMPLE_BYTES)).cast("int")
    piece = rows.withColumn("_text", F.col("_text").substr(at, F.lit(SAMPLE_BYTES)))
    picked = piece.filter(F.col("_i").isNotNull()).join(F.broadcast(chosen), "_i", "left_semi").groupBy("_i").agg(F.max("_text").alias("_text")).select("_text")

    def fit(batches):
        import pyarrow as pa

        samples = [ids[a:b].astype("<u4").tobytes() for _, ids, at in encode_batches(batches, tokenizer, "_text", end_id) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_pydict({"dictionary": [train_dictionary([s[:SAMPLE_BYTES] for s in samples])]})

    found = picked.repartition(1).mapInArrow(fit, "dictionary binary").collect()
    return bytes(found[0][0]) if found else b""


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, partitions: int | None = None) -> None:
    """Encode every whole text and write the folder. Rows are dealt by ranges of the id; a task writes its range in order."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = fit_dictionary(docs, tokenizer, id_col, text_col, end_id)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(bytearray(raw), digest)], "dictionary binary, dict_hash string").coalesce(1).write.parquet(f"{path}/dictionary")
    id_type = docs.schema[id_col].dataType.simpleString()
    n = partitions or max(24, 2 * shuffle_partitions(spark))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    rows = rows.repartitionByRange(n, "_id", "_tie").sortWithinPartitions("_id", "_tie").drop("_tie")

    def encode(batches):
        import pyarrow as pa
        import zstandard as zstd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        z = zstd.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw)) if raw else zstd.ZstdCompressor(level=LEVEL)
        frames: list[bytes] = []
        entries: list[dict] = []
        first, held, shard, start = 0, 0, 0, 0
        id_arrow = None

        def close():
            nonlocal frames, entries, held, shard, first
            ids = pa.array([e.pop("id") for e in entries], id_arrow)
            index = pa.array(entries, pa.struct([("at", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64()), ("start", pa.int64())]))
            struct = pa.StructArray.from_arrays([ids, *index.flatten()], ["id", "at", "size", "n_tokens", "start"])
            docs_ = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), struct)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([b"".join(frames)]), pa.array([digest]), pa.array([start - first], pa.int64()), docs_],
                ["part", "shard", "payload", "dict_hash", "n_tokens", "docs"],
            )
            frames, entries, held, first, shard = [], [], 0, start, shard + 1
            return out

        for batch, flat, offsets in encode_batches(batches, tokenizer, "_text", end_id):
            id_arrow = batch.column("_id").type
            held_ids = memoryview(flat.astype("<u4").view("u1"))
            for i, a, b in zip(batch.column("_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                frame = z.compress(held_ids[4 * a : 4 * b])
                entries.append({"id": i, "at": held, "size": len(frame), "n_tokens": b - a, "start": start})
                frames.append(frame)
                held += len(frame)
                start += b - a
                if held >= SHARD_BYTES:
                    yield close()
        if entries:
            yield close()

    schema = f"part int, shard int, payload binary, dict_hash string, n_tokens long, docs array<struct<id:{id_type},at:long,size:long,n_tokens:long,start:long>>"
    rows.mapInArrow(encode, schema).write.option("compression", "uncompressed").option("parquet.block.size", SHARD_BYTES).parquet(f"{path}/shards")
    shards = spark.read.parquet(f"{path}/shards")
    shards.select("part", "shard", F.inline("docs")).select("id", "part", "shard", "at", "size", "n_tokens", "start").write.option("compression", "zstd").option("parquet.block.size", INDEX_BYTES).parquet(f"{path}/index")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """part, base: ids in all parts before it. One row for each part of the files."""
    sums = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").head()
    raw = bytes(row["dictionary"])
    if hashlib.sha256(raw).hexdigest() != row["dict_hash"]:
        raise ValueError("the dictionary's bytes do not have its hash")
    return raw, row["dict_hash"]


def _decode(rows: DataFrame, raw: bytes, digest: str, id_type: str) -> DataFrame:
    """One row for each document named in docs: id, part, start (within its part), n_tokens, ids."""

    def decode(batches):
        import pyarrow as pa
        import zstandard as zstd

        z = zstd.ZstdDecompressor(dict_data=_dictionary(raw)) if raw else zstd.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("dict_hash")[k].as_py() != digest:
                    raise ValueError("this shard was written with another dictionary")
                found = batch.column("docs")[k].values
                payload = batch.column("payload")[k].as_buffer()
                at, size = (found.field(c).to_pylist() for c in ("at", "size"))
                for lo in range(0, len(found), 2000):
                    part = found.slice(lo, 2000)
                    ids = [z.decompress(payload[a : a + s]) for a, s in zip(at[lo : lo + 2000], size[lo : lo + 2000])]
                    columns = [part.field("id"), pa.array([batch.column("part")[k].as_py()] * len(part), pa.int32()), part.field("start"), part.field("n_tokens"), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "part", "start", "n_tokens", "ids"])

    return rows.select("part", "payload", "dict_hash", "docs").mapInArrow(decode, f"id {id_type}, part int, start long, n_tokens long, ids binary")


def _from_base(found: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    # one row for each part, and parts are as many as the writing job's tasks
    return found.join(F.broadcast(parts(spark, path)), "part").select("id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document: id, start (ids of all documents before it), n_tokens, ids (bytes). Fails if a frame is short of its n_tokens."""
    raw, digest = dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards")
    id_type = shards.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    found = _decode(shards, raw, digest, id_type)
    whole = F.when(F.length("ids") == F.col("n_tokens") * 4, F.col("ids")).otherwise(F.raise_error(F.lit("a frame is not as long as its index says")).cast("binary"))
    return _from_base(found.withColumn("ids", whole), spark, path)


def read_some(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The documents with these ids (a list that the caller holds), from the shards that the index names for them; only their frames are decompressed."""
    raw, digest = dictionary(spark, path)
    index = spark.read.parquet(f"{path}/index")
    id_type = index.schema["id"].dataType.simpleString()
    wanted = [F.lit(i).cast(id_type) for i in ids]
    # as many rows as the ids asked for have
    places = index.filter(F.col("id").isin(wanted)).select("part", "shard").distinct().collect() if wanted else []
    shards = spark.read.parquet(f"{path}/shards").filter(F.col("part").isin([r["part"] for r in places]) & F.col("shard").isin([r["shard"] for r in places]))
    named = shards.withColumn("docs", F.filter("docs", lambda d: d["id"].isin(wanted) if wanted else F.lit(False))).filter(F.size("docs") > 0)
    return _from_base(_decode(named, raw, digest, id_type), spark, path)
