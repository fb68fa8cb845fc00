"""Best-fit packing: patterns of few lengths, fitted to the length histogram by non-negative least squares.

Only lengths matter for a plan, and there are at most ``capacity`` different ones, so the plan is made from the histogram, whose size does
not depend on the corpus:

1. ``patterns``: every set of up to ``few`` lengths of the histogram that fills a sequence exactly.
2. ``fit``: repeat counts x >= 0 that bring (uses of each length) nearest to the histogram, by projected gradient steps with momentum;
   longer lengths weigh more. Counts are rounded down, and reduced where they would use a length more often than it occurs.
3. ``pack_residuals``: what is left is packed best-fit decreasing, whole runs of equal lengths at once.

Pieces then find their place without a group or a driver seeing them: the r-th piece of a length takes the r-th slot of that length in the plan.
A rank is the count of the length in earlier blocks plus the place within the block; blocks are ranges of a hash, one for BLOCK_ROWS pieces, so that a
length which most pieces have is ranked in as many tasks as there are blocks. The plan's runs, of which each pattern that is used has a few, are
looked up by length in a table that Spark broadcasts. Pieces of full length have a
sequence each and are neither ranked nor shuffled.

Defined results: a null text is empty and has its end id alone; a piece is never longer than the capacity; longer documents are cut into
pieces of full length, of which the first may be shorter; an empty table gives an empty table; rows that repeat an id are packed each by
itself; null ids come first; of documents only the id is carried into the
result, of a table given to ``pack`` every column.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches
from .tokenise import as_binary, encode_batches

CAPACITY = 2048
FEW = 3
STEPS = 300
#: Pieces of one length that are ranked in one group, about.
BLOCK_ROWS = 1_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, lean: bool = False) -> DataFrame:
    """id, piece, start, length, ids (little-endian unsigned 32-bit) of every whole text, each document ended by end_id. lean: less memory, more time."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def split(batches):
        import pyarrow as pa

        for part, ids, at in encode_batches(batches, tokenizer, text_col, end_id, lean):
            n = np.diff(at)
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = ((n - 1) % capacity + 1)[row]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), as_binary(ids, np.append(0, np.cumsum(length)))],
                [id_col, "piece", "start", "length", "ids"],
            )

    return docs.select(id_col, text_col).mapInArrow(split, f"`{id_col}` {id_type}, piece int, start long, length long, ids binary")


def patterns(lengths: np.ndarray, capacity: int, few: int = FEW) -> np.ndarray:
    """All multisets of 1 to few (at most 3) of these lengths with the capacity as their sum; unused places are 0. Rows are descending."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    out = []
    if have[capacity]:
        out.append(np.array([[capacity, 0, 0]]))
    if few >= 2:
        b = np.arange(1, capacity // 2 + 1)
        b = b[have[b] & have[capacity - b]]
        out.append(np.stack([capacity - b, b, 0 * b], axis=1))
    if few >= 3:
        for c in lengths[lengths <= capacity // 3]:
            b = np.arange(c, (capacity - c) // 2 + 1)
            b = b[have[b] & have[capacity - c - b]]
            out.append(np.stack([capacity - c - b, b, 0 * b + c], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=int)


def fit(pats: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts: min over x >= 0 of sum over lengths of weight * (uses - histogram)^2, weight = length / capacity."""
    if not len(pats):
        return np.zeros(0)
    top = len(histogram) - 1
    weight = np.arange(top + 1) / top
    width = pats.shape[1]
    flat = pats.T.ravel()

    def uses(x):
        u = np.bincount(flat, np.tile(x, width), top + 1)
        u[0] = 0
        return u

    ones = np.bincount(flat, minlength=top + 1).astype(float)
    ones[0] = 0
    # by Gershgorin: a column's gradient moves by at most the weighted number of patterns that it meets
    bound = max(1.0, float((weight * ones)[pats].sum(axis=1).max()))
    near = np.minimum.reduce([np.where(pats[:, k] > 0, histogram[pats[:, k]] / np.maximum(ones[pats[:, k]], 1), np.inf) for k in range(width)])
    x = y = near
    t = 1.0
    for _ in range(steps):
        g = weight * (uses(y) - histogram)
        g[0] = 0
        z = np.maximum(0.0, y - sum(g[pats[:, k]] for k in range(width)) / bound)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if ((y - z) * (z - x)).sum() > 0:
            s, t = 1.0, 1.0
        y = z + (t - 1) / s * (z - x)
        x, t = z, s
    return x


def rounded(pats: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Counts rounded down, and no length used more often than it occurs. Rounding up leaves residuals with too few short pieces."""
    left = histogram.astype(np.int64).copy()
    out = []
    for k in np.argsort(-x, kind="stable"):
        n = int(x[k] + 1e-9)
        if n < 1:
            break
        key = tuple(int(v) for v in pats[k] if v)
        for v in set(key):
            n = min(n, int(left[v]) // key.count(v))
        if n > 0:
            for v in key:
                left[v] -= n
            out.append((key, n))
    return out


def pack_residuals(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: as many equal pieces at once as there are equal open sequences."""
    rooms: list[int] = []  # remaining sizes with open sequences, ascending
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, key: tuple[int, ...], n: int):
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((key, n))

    for v in range(capacity, 0, -1):
        n = int(histogram[v])
        while n:
            at = bisect.bisect_left(rooms, v)
            if at < len(rooms):
                room = rooms[at]
                key, m = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                fits = min(room // v, -(-n // m))  # so many into each
                each = max(1, fits if n >= m * fits else n // m)
                used = m if n >= m * each else n // each
                if used < m:
                    put(room, key, m - used)
                n -= used * each
                put(room - each * v, key + (v,) * each, used)
            else:
                each = min(capacity // v, n)
                used = n // each
                n -= used * each
                put(capacity - each * v, (v,) * each, used)
    return [x for group in open_.values() for x in group]


def plan(histogram: np.ndarray, capacity: int, few: int = FEW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences). Every piece of the histogram has exactly one slot."""
    left = histogram.astype(np.int64).copy()
    full = int(left[capacity])
    left[capacity] = 0
    out = [((capacity,), full)] if full else []
    pats = patterns(np.nonzero(left)[0], capacity, few)
    fitted = rounded(pats, fit(pats, left.astype(float)), left)
    for key, n in fitted:
        for v in key:
            left[v] -= n
    return out + fitted + pack_residuals(left, capacity)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, below rank, first sequence, pieces of that length in a sequence, first offset) for each run of a plan."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for key, n in planned:
        at = 0
        for v in sorted(set(key), reverse=True):
            m = key.count(v)
            lo = used.get(v, 0)
            out.append((v, lo, lo + n * m, sequence, m, at))
            used[v] = lo + n * m
            at += v * m
        sequence += n
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, few: int = FEW, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset. found is read twice: give a written table. Lengths are 1 to capacity."""
    spark = found.sparkSession
    rows = found.select(F.struct(*[F.col(f"`{c}`") for c in found.columns]).alias("_row"), F.col(length_col).cast("int").alias("_len"), F.struct(*order_cols).alias("_order"))
    per = {r["_len"]: r["n"] for r in rows.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity counts, whatever the corpus
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for v, n in per.items():
        hist[v] = n
    planned = plan(np.append(hist[:-1], 0), capacity, few)
    runs = slots(planned)
    by_len: dict[int, list] = {}
    for v, *rest in runs:
        by_len.setdefault(v, []).append(tuple(rest))
    run = "array<struct<lo:long,hi:long,sequence:long,each:long,at:long>>"
    # a row for each length, with a few runs for each pattern that is used: bounded by the capacity. As many blocks as keep one near BLOCK_ROWS
    lookup = F.broadcast(spark.createDataFrame([(v, max(1, -(-per[v] // BLOCK_ROWS)), x) for v, x in by_len.items()], f"_len int, _blocks long, _runs {run}"))
    placed = rows.filter(F.col("_len") < capacity).join(lookup.drop("_runs"), "_len").withColumn("_block", F.pmod(F.xxhash64("_order"), F.col("_blocks"))).drop("_blocks")
    counts = placed.groupBy("_len", "_block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("_len").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_len", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    place = Window.partitionBy("_len", "_block").orderBy("_order")
    ranked = placed.withColumn("_in", F.row_number().over(place) - 1).join(base, ["_len", "_block"]).withColumn("_rank", F.col("_in") + F.col("_base"))
    hit = F.filter("_runs", lambda r: (F.col("_rank") >= r["lo"]) & (F.col("_rank") < r["hi"]))[0]
    k = F.col("_rank") - F.col("_hit.lo")
    short = (
        ranked.join(lookup.drop("_blocks"), "_len")
        .withColumn("_hit", hit)
        .select("_row.*", (F.col("_hit.sequence") + F.floor(k / F.col("_hit.each"))).cast("long").alias("sequence_id"), (F.col("_hit.at") + F.col("_len") * (k % F.col("_hit.each"))).cast("long").alias("offset"))
    )
    alone = rows.filter(F.col("_len") == capacity).select("_row.*", (F.monotonically_increasing_id() + sum(n for _, n in planned)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, few: int = FEW, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, derive=None, lean: bool = False) -> DataFrame:
    """Pieces of all documents with their places. derive: maps the pieces (which hold their ids) to what is to be kept of them."""
    found = pieces(docs, tokenizer, capacity, id_col, text_col, end_id, lean)
    return pack(cut(derive(found) if derive else found, "pieces"), capacity, few, order_cols=(id_col, "piece"))
