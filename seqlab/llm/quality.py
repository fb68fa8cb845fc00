"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader (McMahan et al. 2013).

Tokens are maximal runs of one kind of byte: letters (bytes above 127 among them), digits, or one other visible byte. Features are the hashes of
1- and 2-grams of the tokens and of their shapes (upper, capitalised, mixed or lower case, number, the symbol itself), all in one table of
2^BITS weights; a shape also says whether its token repeats one of the two before it. A text's vector is each feature's share of all its features times SCALE, so that its score is a sparse dot product whatever
its length. Training reads a bounded sample, the FIT_DOCS labelled rows with the smallest hash of their id, in that order, EPOCHS times, in
one task; the weights (one float for each of 2^BITS) are broadcast.

Defined results: null and empty texts have the score of the bias alone; labels other than 0 and 1, and rows without id or text, teach nothing;
a document labelled more than once counts each time, but of the texts
of one id only the last in order is learnt from; without labels every score is 0.5; equal texts have equal scores; other columns pass, but one named quality_score
gives way to the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_and_more, small_batches
from .shingles import column_bytes, mix, run_hashes

BITS = 18
FIT_DOCS = 6_000
EPOCHS = 3
SCALE = 16.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
CHUNK = 250_000

#: Kinds of bytes: 0 white space, 1 letter, 2 digit, from 3 on each other byte by itself.
_KIND = np.arange(256, dtype=np.int16) + 3
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows of a string column in order, and the n + 1 offsets of the rows among them."""
    raw, offsets = column_bytes(column)
    kind = _KIND[raw]
    new = np.ones(len(raw), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(raw)]] = True
    edges = np.flatnonzero(new)
    ends = np.append(edges[1:], len(raw)).astype(np.int64)
    word = kind[edges] > 0 if len(edges) else np.zeros(0, bool)
    starts, ends = edges[word], ends[word]
    h = run_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    up = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    n_up, size = up[ends] - up[starts], ends - starts
    case = np.where(n_up == 0, 0, np.where(n_up == size, 3, np.where((n_up == 1) & (_UPPER[raw[starts]] == 1), 1, 2))) if len(starts) else np.zeros(0, np.int64)
    again = np.zeros(len(h), dtype=np.uint64)
    for back in (1, 2):
        again[back:] |= (h[back:] == h[:-back]).astype(np.uint64)
    shape = mix((kind[starts].astype(np.uint64) << np.uint64(4)) + (case.astype(np.uint64) << np.uint64(1)) + again, 5)
    rows = np.searchsorted(starts, offsets)
    first = np.zeros(len(h), dtype=bool)
    first[rows[:-1][rows[:-1] < len(h)]] = True
    grams = []
    for x, seed in ((h, 21), (shape, 31)):
        two = np.zeros(len(x), dtype=np.uint64)
        two[1:] = mix(x[:-1], seed) + x[1:]
        two[first] = mix(x[first], seed + 1)  # the beginning of a text
        grams += [mix(x, seed + 2), mix(two, seed + 3)]
    numbers = (np.stack(grams, axis=1).ravel() >> np.uint64(64 - BITS)).astype(np.int32)
    return numbers, rows * len(grams)


def _sparse(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, c = np.unique(numbers, return_counts=True)
    return u, c * (SCALE / max(1, len(numbers)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after following the regularised leader over the rows (features, values, label)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    for _ in range(epochs):
        for u, v, y in rows:
            zu, nu = z[u], n[u]
            root = np.sqrt(nu)
            w = np.where(np.abs(zu) <= L1, 0.0, (np.sign(zu) * L1 - zu) / ((BETA + root) / ALPHA + L2))
            bias = -zb / ((BETA + nb**0.5) / ALPHA)
            g = float(sigmoid(w @ v + bias)) - y
            gv = g * v
            after = nu + gv * gv
            z[u] = zu + gv - (np.sqrt(after) - root) / ALPHA * w
            n[u] = after
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * bias
            nb += g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32), -zb / ((BETA + nb**0.5) / ALPHA)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """docs: id, text; labels: id, label. Ids are chosen from the labels alone, so that only the sample's texts are read on; they become features
    in parallel and a model in one task."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col).cast("string")).alias("rank"))
    ids = known.orderBy("rank", "id", "y").limit(FIT_DOCS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    # FIT_DOCS ids at most, and one text of each, so that an id with many rows is no larger a sample
    one = texts.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    rows = one.join(F.broadcast(ids), "id").select("rank", "id", "y", "text")

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                u, v = _sparse(features(batch.column("text").slice(k, 1))[0])
                yield pa.RecordBatch.from_arrays([batch.column("rank").slice(k, 1), batch.column("y").slice(k, 1), pa.array([u.tolist()], pa.list_(pa.int32())), pa.array([v.tolist()], pa.list_(pa.float64()))], ["rank", "y", "u", "v"])

    def train(batches):
        import pyarrow as pa

        found = [(r, u, v, y) for b in batches for r, y, u, v in zip(b.column("rank").to_pylist(), b.column("y").to_pylist(), *[[np.asarray(x.values) for x in b.column(c)] for c in ("u", "v")])]
        found.sort(key=lambda r: (r[0], r[3], len(r[1])))
        w, bias = ftrl([r[1:] for r in found])
        yield pa.RecordBatch.from_pydict({"w": [w.tobytes()], "bias": [float(bias)]})

    # FIT_DOCS rows at most
    sample = rows.mapInArrow(vectors, "rank long, y int, u array<int>, v array<double>").repartition(1)
    got = sample.mapInArrow(train, "w binary, bias double").collect()
    return (np.frombuffer(bytes(got[0]["w"]), np.float32), got[0]["bias"]) if got else (np.zeros(1 << BITS, np.float32), 0.0)


def scores_of(column, w: np.ndarray, bias: float) -> np.ndarray:
    at, out = 0, []
    sizes = column_bytes(column)[1]
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK, side="right")) - 1)
        numbers, rows = features(column.slice(at, to - at))
        sums = np.concatenate([[0.0], np.cumsum(w[numbers], dtype=np.float64)])
        n = rows[1:] - rows[:-1]
        out.append(sigmoid((sums[rows[1:]] - sums[rows[:-1]]) * SCALE / np.maximum(1, n) + bias))
        at = to
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (all of docs where None) and quality_score. One pass, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(text_col).alias("_text"))
    row_type = rows.schema["_row"].dataType.simpleString()

    def judge(batches):
        import pyarrow as pa

        w, bias = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(scores_of(batch.column("_text"), w, bias), pa.float64())], ["_row", "quality_score"])

    return row_and_more(rows.mapInArrow(judge, f"_row {row_type}, quality_score double"), ["quality_score"])
