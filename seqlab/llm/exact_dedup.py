"""Exact dedup: group by a 128-bit content hash, then by the bytes themselves, and keep one stable id.

1. Each text's hash is counted. Only digests are shuffled, and copies are combined inside each map task first.
2. Texts whose hash occurs more than once are grouped by (hash, text): that grouping compares their bytes, and again combines copies inside each
   map task, so a text of which there are millions of copies crosses the network once per map task. Other texts are not shuffled at all; a
   sieve lets through those that may matter.
3. ``deduplicate`` decides by ids and hashes; then only the rows that stay, of those that may have a copy, are shuffled with their texts.
4. Where one hash stands for different texts, and only there, rows look up their group by the text; elsewhere by the hash. The row of a
   large group is held once for each of several salts, so that the rows of one very common text meet it in so many tasks.

Defined results: a null text counts as empty; empty texts are copies of each other; a null id is smaller than any other, and is kept
only where its whole group has no id; rows that repeat both id and text share one decision (``deduplicate`` returns
the one whose columns have the least hash, whichever task has it);
an empty table gives an empty table; other columns pass through ``deduplicate`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_hot, lower_ascii, sieve

def normalised(text: Column) -> Column:
    """A-Z lower-cased; null as empty."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def content_hash(norm: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(norm.cast("binary")))


def _digests(docs: DataFrame, id_col: str, text_col: str, hash_fn) -> DataFrame:
    norm = normalised(F.col(text_col))
    return cut(docs.select(F.col(id_col).alias("_id"), hash_fn(norm).alias("_hash"), F.sha2(norm.cast("binary"), 256).alias("_sha")), "digests")


def _lookup(docs: DataFrame, id_col: str, text_col: str, keep: str, hash_fn, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by hash: _hash, _texts, group_size, keep_id for each hash that occurs more than once; by text: the same with _norm for hashes of several texts)."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    many = cut(digests.groupBy("_hash").agg(F.count(F.lit(1)).alias("group_size"), best("_id").alias("keep_id")).filter("group_size > 1"), "many")
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"), hash_fn(norm).alias("_hash"))
    texts = rows.filter(sieve(F.col("_hash"), many, F.col("_hash"))).groupBy("_hash", "_norm").agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = Window.partitionBy("_hash")  # as many rows as there are different texts of one hash
    by_text = cut(texts.withColumn("_texts", F.count(F.lit(1)).over(several)).filter("_texts > 1"), "clashing")
    clashing = by_text.select("_hash").distinct().withColumn("_clash", F.lit(True))
    by_hash = many.join(clashing, "_hash", "left").select("_hash", F.coalesce("_clash", F.lit(False)).alias("_clash"), "group_size", "keep_id")
    return by_hash, by_text


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_fn=content_hash) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept, text_sha256, content_hash."""
    digests = _digests(docs, id_col, text_col, hash_fn)
    by_hash, by_text = _lookup(docs, id_col, text_col, keep, hash_fn, digests)
    named = join_hot(digests, by_hash, ["_hash"], "group_size", "_id")
    alone = F.col("group_size").isNull()
    found = named.filter(~F.coalesce("_clash", F.lit(False))).select("_id", F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "_sha", "_hash")
    if not by_text.isEmpty():
        norm = normalised(F.col(text_col))
        rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"), hash_fn(norm).alias("_hash"), F.sha2(norm.cast("binary"), 256).alias("_sha"))
        clashed = rows.filter(sieve(F.col("_hash"), by_text, F.col("_hash"))).join(by_text, ["_hash", "_norm"])
        found = found.unionByName(clashed.select("_id", "keep_id", "group_size", "_sha", "_hash"))
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"), F.lower(F.hex("_hash")).alias("content_hash"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_fn=content_hash) -> DataFrame:
    """The rows of docs that stay, one per different text, with the columns of docs. Only texts that may have a copy are shuffled."""
    digests = _digests(docs, id_col, text_col, hash_fn)
    by_hash, by_text = _lookup(docs, id_col, text_col, keep, hash_fn, digests)
    copied = sieve(F.col("_hash"), by_hash, F.col("_hash"))
    who = lambda c: F.struct(F.col(c).isNull().alias("none"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id")).alias("_who")
    # what stays is found by ids and hashes: a group's keeper, and texts that the sieve let through although they are alone
    alone = join_hot(digests.filter(copied), by_hash, ["_hash"], "group_size", "_id").filter("group_size is null")
    plain = by_hash.filter("not _clash").select("_hash", who("keep_id")).unionByName(alone.select("_hash", who("_id")))
    stay = plain if by_text.isEmpty() else plain.unionByName(by_text.select("_hash", who("keep_id")))
    stay, plain = cut(stay, "stay"), cut(plain, "plain")
    norm = normalised(F.col(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), norm.alias("_norm"), hash_fn(norm).alias("_hash"), who(id_col))
    both = lambda: F.xxhash64("_hash", "_who")
    # rows that repeat id and text are combined in the map tasks, before anything is joined: the one whose columns have the least hash stays
    maybe = rows.filter(copied & sieve(both(), stay, both())).groupBy("_hash", "_who", "_norm").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    kept = maybe.join(plain, ["_hash", "_who"], "left_semi")
    if not by_text.isEmpty():
        kept = kept.unionByName(maybe.join(by_text.select("_hash", who("keep_id"), "_norm"), ["_hash", "_who", "_norm"], "left_semi"))
    return rows.filter(~copied).select("_row.*").unionByName(kept.select("_row.*"))
