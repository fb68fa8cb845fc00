"""Ranked lexical search by pipelined term partitioning: bundles of items travel through the owners of their terms, rarest terms first.

1. One pass over the documents inverts them where they are: each task turns up to BLOCK documents into a block of postings of the terms that some
   item may have (a bitset of fixed size says which), and a list of the block's ids and lengths. Texts are never shuffled.
2. From the blocks' rows come N, L, each term's df and weight w, and a bound on what it adds to any document. Terms are owned by stages, by the share
   of documents that hold them: SHARES.
3. A bundle is up to some ITEMS items. With each block it carries sparse accumulators: scores of the block's documents by item. At every stage a
   cogroup by (bundle, block) brings the accumulators together with the stage's postings of that block, whose contributions are added as
   integers; then the bundle goes on to the next stage.
4. After a stage each item knows the score of its best ``top`` documents so far, and what the later stages can add at most. Accumulators that cannot
   reach the former with the latter are dropped, and none is opened where the later stages alone cannot reach it: no result changes, as
   documents that may still tie are kept. Blocks without accumulators then need no postings of a closed bundle.
5. The last stage keeps each block's best for each item; those that reach the best of all blocks get their ids, and are ranked.

A term is known by a hash of 64 bits. A group of a cogroup is one block and one bundle, so its size is bounded by BLOCK and ITEMS.

Defined results: null texts, and texts without a term, match nothing and count in neither N nor L; items without a term, or whose terms no document
has, have no row; rows that repeat a document's or an item's id are documents and items of their own; a null id is smaller than any other;
empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SIEVE_WORDS, cut, small_batches, tidy
from .shingles import parts_of, term_hashes

#: Documents of a block, and hits after which it is closed earlier.
BLOCK, HITS = 4096, 3_000_000
#: Items of a bundle, about.
ITEMS = 256
#: Of a stage's terms, how many of the documents hold each at most.
SHARES = (1 / 256, 1 / 32, 1 / 6, 1.0)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item (a number of its own), item_id, tokens: its different terms' hashes."""
    kind = items.schema[item_col].dataType.simpleString()

    def terms(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for where, raw, offsets in parts_of(batch.column("_text")):
                h, rows = term_hashes(raw, offsets)
                tokens = [np.unique(h[a:b]).view(np.int64).tolist() for a, b in zip(rows[:-1], rows[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens)) + number), batch.column("_id").slice(where.start, len(tokens)), pa.array(tokens, pa.list_(pa.int64()))], ["item", "item_id", "tokens"])
                number += len(tokens)

    slim = items.select(F.col(item_col).alias("_id"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(terms, f"item long, item_id {kind}, tokens array<long>")


def wanted_bits(tokens: DataFrame) -> np.ndarray:
    """A bitset of SIEVE_WORDS words with a bit for each token, and few others."""
    at = F.pmod(F.col("token"), F.lit(64 * SIEVE_WORDS))
    words = tokens.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("word"))
    out = np.zeros(SIEVE_WORDS, dtype=np.int64)
    for r in words.collect():  # SIEVE_WORDS rows at most
        out[r["at"]] = r["word"]
    return out.view(np.uint64)


def invert(docs: DataFrame, bits: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """block, token, docs (places in the block, ascending), tfs, ns; and for each block one row without a token, with its ids and all its ns. The
    places are in order of ids."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema[id_col].dataType.simpleString()

    def blocks(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        words = held.value
        block = TaskContext.get().partitionId() << 40
        ids, ns, hashes, where = [], [], [], []
        n_docs = n_hits = 0

        def closed():
            nonlocal block, ids, ns, hashes, where, n_docs, n_hits
            names = pa.chunked_array(ids).combine_chunks() if len(ids) > 1 else ids[0]
            order = pc.array_sort_indices(names).to_numpy() if names.null_count == 0 else pc.sort_indices(pa.table({"id": names}), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy()
            place = np.empty(n_docs, dtype=np.int64)
            place[order] = np.arange(n_docs)
            n = np.concatenate(ns)[order]
            h, d = np.concatenate(hashes), place[np.concatenate(where)]
            u, which = np.unique(h, return_inverse=True)
            key, tf = np.unique(which * n_docs + d, return_counts=True)
            term, d = key // n_docs, key % n_docs
            at = np.searchsorted(term, np.arange(len(u) + 1)).astype(np.int32)
            list_of = lambda x, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32()))
            none = pa.nulls(len(u), pa.list_(names.type))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), block)), pa.array(u.view(np.int64)), list_of(d, at), list_of(tf, at), list_of(n[d], at), none], columns)
            one = np.array([0, n_docs], np.int32)
            empty = pa.nulls(1, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), empty, empty, list_of(n, one), pa.ListArray.from_arrays(pa.array(one), names.take(pa.array(order)))], columns)
            block += 1
            ids, ns, hashes, where = [], [], [], []
            n_docs = n_hits = 0

        for batch in batches:
            for part, raw, offsets in parts_of(batch.column("_text")):
                h, rows = term_hashes(raw, offsets)
                p = h % np.uint64(64 * SIEVE_WORDS)
                hit = np.flatnonzero((words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1))
                ids.append(batch.column("_id").slice(part.start, part.stop - part.start))
                ns.append(np.diff(rows))
                hashes.append(h[hit])
                where.append(np.searchsorted(rows, hit, side="right") - 1 + n_docs)
                n_docs += part.stop - part.start
                n_hits += len(hit)
                if n_docs >= BLOCK or n_hits >= HITS:
                    yield from closed()
        if n_docs:
            yield from closed()
        tidy()

    columns = ["block", "token", "docs", "tfs", "ns", "ids"]
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(blocks, f"block long, token long, docs array<int>, tfs array<int>, ns array<int>, ids array<{kind}>")


def _part(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight 1 adds, in whole numbers of 64 bits."""
    length = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * length)


def _stage(n_docs: int, n_terms: int, top: int, last: bool):
    """A cogroup of a bundle's accumulators in a block with the postings of a stage."""

    def run(key, left, right):
        import pyarrow as pa

        got = left.to_pylist()  # one row at most
        floors = {f["slot"]: f["floor"] for r in got for f in r["floors"] or []}
        slots, docs, scores = (np.concatenate([np.asarray(r[c], dtype=np.int64) for r in got]) if got else np.zeros(0, np.int64) for c in ("slots", "docs", "scores"))
        if floors and len(slots):
            least = np.array([floors.get(s, 0) for s in range(int(slots.max()) + 1)], dtype=np.int64)
            kept = scores >= least[slots]
            slots, docs, scores = slots[kept], docs[kept], scores[kept]
        by_slot: dict = {}
        size = int(docs.max(initial=-1)) + 1
        if right.num_rows:
            lists = [right.column(c).combine_chunks() for c in ("docs", "tfs", "ns", "slots", "closed")]
            w = right.column("w").to_pylist()
            for i in range(right.num_rows):
                d, tf, n = (x[i].values.to_numpy().astype(np.int64) for x in lists[:3])
                more = w[i] * _part(tf, n, n_docs, n_terms)
                size = max(size, int(d[-1]) + 1)
                shut = set(lists[4][i].as_py())
                for s in lists[3][i].as_py():
                    by_slot.setdefault(s, []).append((d, more, s in shut))
        out: list[tuple] = []
        at = {s: (a, b) for s, a, b in zip(*_bounds(slots))}
        total = np.zeros(size, dtype=np.int64)
        for s in sorted({*at, *by_slot}):
            total[:] = 0
            a, b = at.get(s, (0, 0))
            total[docs[a:b]] = scores[a:b]
            added = by_slot.get(s, [])
            for d, more, _ in added:
                total[d] += more
            found = docs[a:b] if all(shut for *_, shut in added) else np.flatnonzero(total)
            best = found[np.argsort(-total[found], kind="stable")[:top]]  # places are in order of ids, so ties are in order
            if len(found):
                on = np.sort(best) if last else found
                out.append((s, on, total[on], total[best]))
        flat = lambda parts, kind: pa.array([np.concatenate(parts) if parts else np.zeros(0, kind)], pa.list_(pa.from_numpy_dtype(kind)))
        columns = [
            flat([np.full(len(d), s, np.int32) for s, d, _, _ in out], np.int32), flat([d.astype(np.int32) for _, d, _, _ in out], np.int32), flat([x for _, _, x, _ in out], np.int64),
            flat([np.full(len(t), s, np.int32) for s, _, _, t in out], np.int32), flat([t for *_, t in out], np.int64),
        ]
        rows = pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), *columns], ["bundle", "block", "slots", "docs", "scores", "top_slots", "top_scores"])
        return rows if out else rows.slice(0, 0)

    return run


def _bounds(slots: np.ndarray) -> tuple[list, list, list]:
    """(each slot, where its run begins and ends)."""
    at = np.flatnonzero(np.append(True, np.diff(slots) != 0)) if len(slots) else np.zeros(0, np.int64)
    return slots[at].tolist(), at.tolist(), np.append(at[1:], len(slots)).tolist() if len(at) else []


STATE = "bundle long, block long, slots array<int>, docs array<int>, scores array<long>, top_slots array<int>, top_scores array<long>"


def _reached(state: DataFrame, top: int) -> DataFrame:
    """bundle, slot, reached: the score of the item's best ``top`` documents so far, where there are so many."""
    tops = state.select("bundle", F.inline(F.arrays_zip(F.col("top_slots").alias("slot"), F.col("top_scores").alias("score"))))
    place = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("score")))
    return tops.withColumn("_n", place).filter(F.col("_n") == top).select("bundle", "slot", F.col("score").alias("reached"))


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the ``top`` documents with the highest scores above 0, equal ones by id."""
    spark = docs.sparkSession
    small_batches(spark)
    found = cut(item_terms(items, item_col, item_text_col), "items")
    bundles = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-found.count() // ITEMS))))
    placed = found.withColumn("bundle", bundles).withColumn("slot", F.row_number().over(Window.partitionBy("bundle").orderBy("item")))
    placed = cut(placed, "bundles")
    asked = placed.select("bundle", "slot", F.explode("tokens").alias("token"))

    inverted = cut(invert(docs, wanted_bits(asked.select("token").distinct()), id_col, text_col), "inverted")
    ids, postings = inverted.filter("token is null").select("block", "ids", "ns"), inverted.filter("token is not null").drop("ids")
    known = F.size(F.filter("ns", lambda n: n > 0))
    total = ids.agg(F.sum(known).alias("n"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l")).head()
    n_docs, n_terms = int(total["n"] or 0), int(total["l"] or 0)

    # what a term weighs, who owns it, and what it adds to a document at most: it grows with tf and falls with n
    terms = postings.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum(F.size("docs")).alias("df"), F.max(F.array_max("tfs")).cast("long").alias("tf"), F.min(F.array_min("ns")).cast("long").alias("n"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    most = F.col("w") * F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (10L + (90L * n * {n_docs}L) div {max(1, n_terms)}L))")
    owner = F.lit(len(SHARES) - 1)
    for i, share in reversed(list(enumerate(SHARES[:-1]))):
        owner = F.when(F.col("df") <= share * n_docs, i).otherwise(owner)
    terms = cut(terms.withColumn("w", weight).filter("w > 0").select("token", "w", owner.alias("owner"), most.alias("most")), "terms")
    later = [F.sum(F.when(F.col("owner") > i, F.col("most")).otherwise(0)).alias(f"later{i}") for i in range(len(SHARES))]
    bounds = cut(asked.join(terms, "token").groupBy("bundle", "slot").agg(*later), "bounds")

    state, closed = None, None
    none = spark.createDataFrame([], STATE)
    for i in range(len(SHARES)):
        shut = F.lit(False) if closed is None else F.coalesce(F.col("floor") > 0, F.lit(False))
        own = asked.join(terms.filter(F.col("owner") == i), "token")
        own = own if closed is None else own.join(closed, ["bundle", "slot"], "left")
        own = own.groupBy("token", "bundle").agg(F.first("w").alias("w"), F.collect_list("slot").alias("slots"), F.collect_list(F.when(shut, F.col("slot"))).alias("closed"))  # ITEMS slots, about, at most
        right = postings.join(own, "token")
        left = (none if state is None else state).select("bundle", "block", "slots", "docs", "scores")
        if closed is None:
            left = left.withColumn("floors", F.lit(None).cast("array<struct<slot:int,floor:bigint>>"))
        else:
            floors = closed.filter("floor is not null").groupBy("bundle").agg(F.collect_list(F.struct("slot", "floor")).alias("floors"))
            left = left.join(floors, "bundle", "left")
            open_ = F.size("closed") < F.size("slots")
            right = right.filter(open_).unionByName(right.filter(~open_).join(left.select("bundle", "block"), ["bundle", "block"], "left_semi"))
        right = right.select("bundle", "block", "w", "slots", "closed", "docs", "tfs", "ns")
        run = _stage(n_docs, max(1, n_terms), top, i == len(SHARES) - 1)
        state = cut(left.groupBy("bundle", "block").cogroup(right.groupBy("bundle", "block")).applyInArrow(run, STATE), f"stage{i}")
        reached = _reached(state, top)
        closed = cut(bounds.join(reached, ["bundle", "slot"], "left").select("bundle", "slot", (F.col("reached") - F.col(f"later{i}")).alias("floor")), "floors")

    each = state.select("bundle", "block", F.inline(F.arrays_zip(F.col("slots").alias("slot"), F.col("docs").alias("doc"), F.col("scores").alias("score"))))
    best = each.join(closed, ["bundle", "slot"], "left").filter("floor is null or score >= floor")  # nothing is later now
    named = best.join(ids.select("block", "ids"), "block").select("bundle", "slot", F.get("ids", F.col("doc")).alias("_doc"), "score", "block", "doc")
    rank = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), "_doc", "block", "doc"))
    ranked = named.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(placed.select("bundle", "slot", "item_id"), ["bundle", "slot"]).select(F.col("item_id").alias(item_col), "rank", F.col("_doc").alias(id_col), "score")
