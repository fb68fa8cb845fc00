"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) cover the same bytes, and how often they do in all.

1. A text with a space before it is encoded by both, so that both spell the same bytes. Interval coalescing: all tokens of A and B are sorted by
   where they start (``lexsort``), the running maximum of their ends is taken (``maximum.accumulate``), and a group ends where a start reaches it.
   Within a group, a token of A and one of B are linked if their bytes overlap. This is one pass over many texts, all in arrays.
2. Each text's links are counted by pair of ids, and written with its groups' hash. The counts of all texts are added up: first in the map tasks, then
   by pair. A pair is best if no other pair of its B id is counted more often.
3. Each text's pairs meet the table of all pairs, which is broadcast where it has BROADCAST_PAIRS rows or fewer. Where it has more, it is joined by
   shuffle, and pairs that very many texts have are dealt to several tasks each.

Defined results: texts that are null, empty, or that either tokenizer does not spell as they are (with the space before), have no tokens: all numbers
are zero and the hash is empty; rows that repeat an id count each time; special tokens' strings are plain text; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, small_batches, tidy
from .shingles import column_bytes, parts_of
from .tokenise import LEAN_CHUNK, LEAN_MEMO, PieceEncoder, WordEncoder, ragged

#: Bytes of text that are aligned at once.
BYTES = 500_000
#: Pairs of ids of which the table is broadcast at most: some 50 MB.
BROADCAST_PAIRS = 1_000_000

_ENCODERS: dict = {}


def encoders(path_a: str, path_b: str) -> tuple[WordEncoder, PieceEncoder]:
    """One pair for each Python worker, so that their memos outlive a task."""
    if (path_a, path_b) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path_a, path_b] = WordEncoder(path_a, LEAN_MEMO, LEAN_CHUNK, plain=True), PieceEncoder(path_b, LEAN_MEMO, LEAN_CHUNK)
    return _ENCODERS[path_a, path_b]


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B. Tokens tile the same bytes, each of one at least, and end there."""
    end = np.concatenate([ends_a, ends_b])
    start = np.concatenate([ends_a, ends_b]) * 0
    start[1 : len(ends_a)] = ends_a[:-1]
    start[len(ends_a) + 1 :] = ends_b[:-1]
    side = np.arange(len(end)) >= len(ends_a)
    order = np.lexsort((side, start))
    most = np.maximum.accumulate(end[order])
    new = np.zeros(len(end), dtype=np.int64)
    new[1:] = start[order][1:] >= most[:-1]
    group = np.empty(len(end), dtype=np.int64)
    group[order] = np.cumsum(new)
    return group[: len(ends_a)], group[len(ends_a) :]


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in A and B whose tokens overlap."""
    starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    first = np.searchsorted(ends_b, starts_a, side="right")
    count = np.searchsorted(starts_b, ends_a, side="left") - first
    return np.repeat(np.arange(len(ends_a)), count), ragged(first, count)


class Decimals:
    """Ids as decimal text, many at once."""

    def __init__(self, most: int):
        text = [str(i).encode() + b"," for i in range(most)]
        self.size = np.array([len(t) for t in text], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.text = np.frombuffer(b"".join(text), np.uint8)

    def joined(self, ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, each followed by its sign; where each ends)."""
        size = self.size[ids]
        out, ends = self.text[ragged(self.at[ids], size)], np.cumsum(size)
        out[ends - 1] = signs
        return out, ends


_DECIMALS: dict[int, Decimals] = {}


def decimals(most: int) -> Decimals:
    if most not in _DECIMALS:
        _DECIMALS[most] = Decimals(most)
    return _DECIMALS[most]


def aligned(texts, a: WordEncoder, b: PieceEncoder) -> dict:
    """For the rows of a column of strings: n_a, n_b, n_groups, n_links, groups_sha256, and of each row's pairs of ids (A's in the upper 32 bits) which
    and how many: pairs, times, with the n + 1 offsets of the rows among them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    _, offsets = column_bytes(spaced)
    n_rows, size = len(texts), np.diff(offsets)
    (ids_a, at_a), (ids_b, at_b) = a.encode(spaced), b.encode(spaced)
    # rows that one of them does not spell have no tokens
    row_a, row_b = (np.repeat(np.arange(n_rows), np.diff(at)) for at in (at_a, at_b))
    unlike = ids_b == b.UNLIKE
    bytes_a, bytes_b = a.n_bytes[ids_a], b.n_bytes[np.where(unlike, 0, ids_b)]
    good = (np.bincount(row_a, bytes_a, n_rows) == size) & (np.bincount(row_b, bytes_b, n_rows) == size)
    good[row_b[unlike]] = False
    keep_a, keep_b = good[row_a], good[row_b]
    ids_a, row_a, ends_a = ids_a[keep_a].astype(np.int64), row_a[keep_a], np.cumsum(bytes_a[keep_a])
    ids_b, row_b, ends_b = ids_b[keep_b].astype(np.int64), row_b[keep_b], np.cumsum(bytes_b[keep_b])
    group_a, group_b = groups_of(ends_a, ends_b)
    i, j = links_of(ends_a, ends_b)
    count = lambda rows: np.bincount(rows, minlength=n_rows)
    first = np.flatnonzero(np.append(True, np.diff(group_a) > 0)) if len(group_a) else np.zeros(0, np.int64)
    out = {"n_a": count(row_a), "n_b": count(row_b), "n_groups": count(row_a[first]), "n_links": count(row_a[i])}

    # each row's pairs
    key, row = (ids_a[i] << 32) | ids_b[j], row_a[i]
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))) if len(key) else np.zeros(0, np.int64)
    out |= {"pairs": key[new], "times": np.diff(np.append(new, len(key))), "offsets": np.searchsorted(row[new], np.arange(n_rows + 1))}

    # the groups as text: A's ids, then B's, by group
    side = np.concatenate([np.zeros(len(ids_a), np.int8), np.ones(len(ids_b), np.int8)])
    group, rows = np.concatenate([group_a, group_b]), np.concatenate([row_a, row_b])
    order = np.lexsort((side, group))  # stable: tokens of one side stay in order
    group, side = group[order], side[order]
    last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True) if len(group) else np.zeros(0, bool)
    signs = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
    text, ends = decimals(max(len(a.n_bytes), len(b.n_bytes))).joined(np.concatenate([ids_a, ids_b])[order], signs)
    to = np.append(0, ends)[np.searchsorted(rows[order], np.arange(n_rows + 1))]
    whole = memoryview(text)
    out["groups_sha256"] = [hashlib.sha256(whole[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(to[:-1].tolist(), to[1:].tolist())]
    return out


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row for each row of docs: its id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; the table of all pairs: a_id, b_id, n, best)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        a, b = encoders(path_a, path_b)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for where, _, _ in parts_of(batch.column("_text"), BYTES):
                part = batch.slice(where.start, where.stop - where.start)
                found = aligned(part.column("_text"), a, b)
                lists = [pa.ListArray.from_arrays(pa.array(found["offsets"], pa.int32()), pa.array(found[c], t)) for c, t in (("pairs", pa.int64()), ("times", pa.int32()))]
                rows = pa.array(np.arange(part.num_rows) + number)
                number += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, part.column("_id"), *[pa.array(found[c], pa.int64()) for c in NUMBERS], pa.array(found["groups_sha256"]), *lists], ["_row", "_id", *NUMBERS, "groups_sha256", "pairs", "times"])
        a._forget()
        b._forget()
        tidy()

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = cut(slim.mapInArrow(run, f"_row long, _id {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string, pairs array<long>, times array<int>"), "aligned")
    each = found.select("_row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("k"))))
    counts = cut(each.groupBy("pair").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    every = cut(counts.withColumn("b_id", b_id).join(most, "b_id").select("pair", "n", "docs", "b_id", (F.col("n") == F.col("most")).alias("best")), "pairs")
    table = every.select("pair", "n", "best", "docs")
    if every.count() <= BROADCAST_PAIRS:
        met = each.join(F.broadcast(table), "pair")
    else:
        met = join_hot(each, table, ["pair"], "docs", "_row")
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("k")).alias("count_sum"))
    out = found.drop("pairs", "times").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    pairs = every.select(F.shiftright("pair", 32).alias("a_id"), "b_id", "n", "best")
    return out.select(F.col("_id").alias(id_col), *NUMBERS, zero("n_best"), zero("count_sum"), "groups_sha256"), pairs
