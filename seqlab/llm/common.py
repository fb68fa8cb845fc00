"""Helpers that the operators share: shared storage, text normalisation, ordered partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir, shared_path  # noqa: F401  for the operators

#: A-Z and what they become.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column, fold: int = 2) -> Column:
    """True where crc32 of the id as text leaves this remainder modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: 64-bit words of a sieve: one megabyte, whatever the corpus.
SIEVE_WORDS = 1 << 17


def sieve(key: Column, keys: DataFrame, key_of_keys: Column) -> Column:
    """True for every key among keys, and for few others: one hash into a bitset of SIEVE_WORDS words. Full, it is true for all.

    It spares rows a shuffle before an exact join; it never replaces one.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * SIEVE_WORDS))
    words = keys.select(place(key_of_keys).alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("word"))
    slots = keys.sparkSession.range(SIEVE_WORDS).select(F.col("id").cast("int").alias("at")).join(words, "at", "left")
    bits = slots.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0)).alias("word")))), lambda x: x["word"]).alias("bits"))
    p = place(key)
    word = F.get(bits.scalar(), F.floor(p / 64).cast("int"))
    # a shift by a column's number of places: F.shiftright takes constants only
    return F.call_function("shiftright", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


#: Keys with so many rows or more are dealt to SALTS tasks each.
HOT_ROWS, SALTS = 10_000, 32


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: str) -> DataFrame:
    """Left join to a table with one row per key, where some keys have very many rows on the left.

    weight: the column of right with the number of a key's rows; spread: a column of left that differs among them. Rows of hot keys get a salt, and
    the hot keys' rows of right are held once for each salt. Which keys are hot is a sieve's answer on both sides, so both always agree.
    """
    key = F.xxhash64(*keys)
    hot = sieve(key, right.filter(F.col(weight) >= HOT_ROWS), key)
    dealt = left.withColumn("_hot", hot).withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    held = right.withColumn("_hot", hot).withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(held, [*keys, "_salt"], "left").drop("_salt")


def row_and_more(found: DataFrame, more: list[str]) -> DataFrame:
    """The fields of _row and the columns named in more, which take the place of fields with their names (in whatever case)."""
    taken = {c.lower() for c in more}
    fields = [c for c in found.schema["_row"].dataType.names if c.lower() not in taken]
    return found.select(*[F.col("_row")[c].alias(c) for c in fields], *more)


#: Rows of one Arrow batch at most, as a text may be long.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Hold Spark's Arrow batches to BATCH_ROWS rows from here on in this session. A DataFrame is run after its function has returned, so the setting
    cannot be put back; batches of 64 MB, Spark's other bound, took an executor of 3 GB beyond its memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def tidy() -> None:
    """Hand memory that a task has freed back to the system: Python workers live on between tasks, beside the executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
