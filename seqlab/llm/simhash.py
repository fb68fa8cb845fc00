"""SimHash near-dedup: fingerprints of 64 bits that differ in few, found by the generalised pigeonhole principle (Qin et al. 2018).

1. A text's fingerprint has a bit set where more than half of its shingles' hashes (XXH64, seed 42) have it. Equal fingerprints are one class.
2. Bits are put into atoms of eight that are correlated, by the sums of products of all classes' bits, and atoms in such an order, too. Of each
   atom the numbers of classes by value are counted.
3. Parts are runs of atoms. If part i is searched within t_i bits and the t_i + 1 add up to the threshold + 1, two fingerprints within the
   threshold agree in some part within its t_i; a part of t_i = -1 is not searched at all. Dynamic programming over the atoms chooses the parts and
   their t_i: what a part costs is its probes and its candidates, estimated from the atoms' counts, so frequent values get small thresholds.
4. Every class is a member at its own value of each searched part, and probes the values within t_i flips whose lowest flip sets a bit, so that
   each pair meets once. Members of one value, and its probes, are verified on all 64 bits in one task.
5. A value with more than HOT rows is divided first: two of its fingerprints that link agree in one of ``threshold + 1`` parts of the other bits.
   That is repeated until no value is hot, or too few bits are left for one to be.
6. Of each value's members that links join, all but one are hung on that one, and a probe on one of each such group it links with; pairs are never
   rows. ``components`` joins them up.

What the driver sees are 64 x 64 sums and 8 x 256 counts, whatever the corpus.

Defined results: null, empty and wordless texts have the fingerprint zero, and link like any other; texts with fewer words than a shingle are one
shingle; rows that repeat an id are one document with the links of all of them; a null id is no one's smallest; an empty table gives an empty
table; other columns are ignored, and pass through ``deduplicate``.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, shuffle_partitions, sieve, small_batches, tidy
from .components import edges_of_ids, least_of
from .shingles import _LOWER, _SPACE, mix, parts_of, runs

BITS, ATOM = 64, 8
SEED = 42
#: Rows of one value that are verified together at most, while bits are left to divide by.
HOT = 20_000
#: Bits of which all values together are no more than a task can hold.
FEW_BITS = 13
#: Shingles that are hashed, and pairs that are compared, at once.
CHUNK, PAIRS = 50_000, 4_000_000

_CLEAN = _LOWER.copy()
_CLEAN[_SPACE] = 32


def fingerprints_of(column, k: int = 3) -> np.ndarray:
    """The fingerprint of each row of a string column."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(column), dtype=np.uint64)
    for where, raw, offsets in parts_of(column):
        inside = ~_SPACE[raw]
        starts, ends, rows = runs(inside, offsets)
        held = inside.copy()
        held[ends[ends < len(raw)]] = True  # one space after each word
        to = np.append(0, np.cumsum(held))
        text, starts, ends = _CLEAN[raw][held].tobytes(), to[starts], to[ends]
        words = np.diff(rows)
        grams = np.where(words > 0, np.maximum(1, words - k + 1), 0)
        row = np.repeat(np.arange(len(words)), grams)
        first = rows[row] + np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
        last = np.minimum(first + k, rows[row + 1]) - 1
        count = np.zeros((len(words), BITS), dtype=np.int64)
        for lo in range(0, len(row), CHUNK):
            some = slice(lo, lo + CHUNK)
            h = np.fromiter((digest(text[s:e], SEED) for s, e in zip(starts[first[some]].tolist(), ends[last[some]].tolist())), np.uint64)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = np.flatnonzero(np.append(True, np.diff(row[some]) > 0))
            count[row[some][at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        out[where] = np.packbits(2 * count > grams[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def bits_of(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_atoms(n: int, both: np.ndarray) -> list[list[int]]:
    """The bits in atoms of ATOM, from the n rows' sums of products: each begins where the last one ended in kind, and takes the bit most correlated with it."""
    mean = np.diag(both) / max(1, n)
    cov = both / max(1, n) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    close = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(close, 0.0)
    left, atoms, last = list(range(BITS)), [], []
    while left:
        atom: list[int] = []
        while left and len(atom) < ATOM:
            kin = atom or last
            pull = [close[b, kin].sum() if kin else close[b].sum() for b in left]
            atom.append(left.pop(int(np.argmax(pull))))
        atoms.append(atom)
        last = atom
    return atoms


def distances(counts: np.ndarray) -> np.ndarray:
    """How likely two rows differ in 0, 1, ... bits of an atom, from the counts of its values."""
    p = counts / max(1.0, counts.sum())
    v = np.arange(len(p))
    return np.bincount(np.bitwise_count(v[:, None] ^ v[None, :]).ravel(), weights=np.outer(p, p).ravel(), minlength=ATOM + 1)


def allocate(n: int, near: list[np.ndarray], threshold: int) -> list[tuple[int, int, int]]:
    """Parts (first atom, end, t) with the least estimated work for n rows; those of t = -1 are left out. near: distances of each atom."""
    atoms = len(near)
    best: dict = {(0, 0): (0.0, [])}
    cost: dict = {}
    for i in range(atoms):
        d = np.array([1.0])
        for j in range(i + 1, atoms + 1):
            d = np.convolve(d, near[j - 1])
            for t in range(threshold + 1):
                probes = sum(comb(ATOM * (j - i), f) for f in range(t + 1))
                cost[i, j, t] = n * (1.0 + probes) + n * n / 2 * d[: t + 1].sum() / 16  # a candidate costs a small part of a row
    for j in range(1, atoms + 1):
        for used in range(threshold + 2):
            ways = [(best[i, used][0], best[i, used][1]) for i in range(j) if (i, used) in best]  # not searched
            ways += [(best[i, used - t - 1][0] + cost[i, j, t], [*best[i, used - t - 1][1], (i, j, t)]) for i in range(j) for t in range(used) if (i, used - t - 1) in best]
            if ways:
                best[j, used] = min(ways, key=lambda w: w[0])
    return best[atoms, threshold + 1][1]


def _sums(classes: DataFrame, of) -> np.ndarray:
    """of(fingerprints) is an array of a fixed size; the sum over all classes."""

    def some(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            found = of(batch.column("fp").to_numpy().view(np.uint64)).ravel()
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.int64))], ["at", "n"])

    found = {r["at"]: r["n"] for r in classes.select("fp").mapInArrow(some, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    return np.array([found[i] for i in range(len(found))], dtype=np.int64)


def plan(classes: DataFrame, threshold: int) -> list[tuple[list[int], int]]:
    """(bits of a part, its threshold) for all parts to be searched."""
    n = classes.count()
    both = _sums(classes, lambda x: (lambda b: b.T @ b)(bits_of(x).astype(np.float64)))
    atoms = correlated_atoms(n, both.reshape(BITS, BITS) if len(both) else np.zeros((BITS, BITS)))
    places = np.array(atoms)

    def values(x):
        v = (bits_of(x)[:, places] << np.arange(ATOM)).sum(axis=2)
        return np.stack([np.bincount(v[:, a], minlength=1 << ATOM) for a in range(len(atoms))])

    counts = _sums(classes, values)
    counts = counts.reshape(len(atoms), -1) if len(counts) else np.ones((len(atoms), 1 << ATOM))
    return [(sorted(b for a in atoms[i:j] for b in a), t) for i, j, t in allocate(n, [distances(c) for c in counts], threshold)]


def flips(x: np.ndarray, bits: list[int], t: int):
    """(which rows, their fingerprints with 1 to t of these bits flipped), where the lowest flip sets a bit."""
    for f in range(1, t + 1):
        for some in combinations(bits, f):
            rows = np.flatnonzero((x >> np.uint64(some[0])) & np.uint64(1) == 0)
            yield rows, x[rows] ^ np.uint64(sum(1 << b for b in some))


def _masked(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _probes(classes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """key (of part and value), used (its bits), role (0 member, 1 probe), fp."""

    def rows(batches):
        import pyarrow as pa

        def batch_of(p, value, role, x):
            used = np.full(len(x), _masked(parts[p][0]), np.uint64)
            key = mix(value & _masked(parts[p][0]), 40 + p)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(used.view(np.int64)), pa.array(np.full(len(x), role, np.int32)), pa.array(x.view(np.int64))], ["key", "used", "role", "fp"])

        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            for p, (bits, t) in enumerate(parts):
                yield batch_of(p, x, 0, x)
                for which, value in flips(x, bits, t):
                    yield batch_of(p, value, 1, x[which])

    return classes.select("fp").mapInArrow(rows, "key long, used long, role int, fp long")


def _divided(rows: DataFrame, threshold: int) -> DataFrame:
    """Each row once for each of threshold + 1 parts of the bits that its key does not use."""

    def divide(batches):
        import pyarrow as pa

        for batch in batches:
            key, used, x = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "used", "fp"))
            free = bits_of(~used)
            turn = np.cumsum(free, axis=1) * (threshold + 1) // np.maximum(1, free.sum(axis=1) + 1)[:, None]
            for j in range(threshold + 1):
                own = np.packbits(free.astype(bool) & (turn == j), axis=1, bitorder="little").view("<u8").ravel()
                more = [mix(key ^ mix(x & own, 60 + j), 70 + j), used | own]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(m).view(np.int64)) for m in more], batch.column("role"), batch.column("fp")], ["key", "used", "role", "fp"])

    return rows.mapInArrow(divide, "key long, used long, role int, fp long")


def _links_of(threshold: int):
    """Rows sorted by key, members before probes, to edges: a, b."""

    def of_key(role: np.ndarray, x: np.ndarray) -> list[tuple[int, int]]:
        n = int((role == 0).sum())
        members = np.unique(x[:n])
        probes = np.unique(x[n:])
        parent = list(range(len(members)))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        step = max(1, PAIRS // max(1, len(members)))
        for lo in range(0, len(members) if len(members) > 1 else 0, step):
            some = members[lo : lo + step]
            i, j = np.nonzero(np.bitwise_count(some[:, None] ^ members[None, :]) <= threshold)
            i += lo
            for a, b in zip(i[i < j].tolist(), j[i < j].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        roots = np.array([find(i) for i in range(len(members))], dtype=np.int64)
        moved = np.flatnonzero(roots != np.arange(len(members)))
        out += zip(members[moved].view(np.int64).tolist(), members[roots[moved]].view(np.int64).tolist())
        for lo in range(0, len(probes) if n else 0, step):
            some = probes[lo : lo + step]
            i, j = np.nonzero(np.bitwise_count(some[:, None] ^ members[None, :]) <= threshold)
            edge = np.unique(np.stack([i, roots[j]], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            out += zip(some[edge[:, 0]].view(np.int64).tolist(), members[edge[:, 1]].view(np.int64).tolist())
        return out

    def links(batches):
        import pyarrow as pa

        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)]

        def emit(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        def closed(last: bool):
            nonlocal kept
            key, role, x = kept
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            end = len(at) if last else len(at) - 1
            out = []
            for a, b in zip(at[:end], np.append(at[1:], len(key))[:end]):
                if b - a > 1:
                    out += of_key(role[a:b], x[a:b])
            if not last and len(at):
                kept = [c[at[-1] :] for c in kept]
            return out

        for batch in batches:
            more = [batch.column("key").to_numpy(), batch.column("role").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)]
            kept = [np.concatenate(c) for c in zip(kept, more)]
            found = closed(False)
            if found:
                yield emit(found)
        found = closed(True)
        if found:
            yield emit(found)
        tidy()

    return links


def near_edges(classes: DataFrame, threshold: int = 2) -> DataFrame:
    """a, b: links between different fingerprints of classes (fp), or between such as links of one value join."""
    spark = classes.sparkSession
    rows = cut(_probes(classes, plan(classes, threshold)), "probes")
    n = max(24, 2 * shuffle_partitions(spark))
    found = []
    while True:
        sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("role") == 0).alias("members"), F.first("used").alias("used")).filter("rows > 1 and members > 0"), "sizes")
        free = F.lit(BITS) - F.bit_count("used")
        hot = sizes.filter((F.col("rows") > HOT) & (free > FEW_BITS)).select("key")
        cold = sizes.filter(~((F.col("rows") > HOT) & (free > FEW_BITS))).select("key")
        few = rows.filter(sieve(F.col("key"), cold, F.col("key"))).join(cold, "key", "left_semi")
        found.append(cut(few.repartition(n, "key").sortWithinPartitions("key", "role").mapInArrow(_links_of(threshold), "a long, b long"), "near"))
        if hot.isEmpty():
            break
        rows = cut(_divided(rows.filter(sieve(F.col("key"), hot, F.col("key"))).join(F.broadcast(hot) if hot.count() <= HOT else hot, "key", "left_semi"), threshold), "probes")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(fingerprints_of(batch.column("_text"), k).view(np.int64))], ["_id", "fp"])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    return cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(sign, f"_id {kind}, fp long"), "signed")


def near_classes(docs: DataFrame, threshold: int = 2, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, fp (the fingerprint as a signed number), component_id (the smallest id reachable by links, itself included), n_same
    (rows with its fingerprint)."""
    signed = _signed(docs, id_col, text_col, k)
    classes = cut(signed.groupBy("fp").agg(F.min("_id").alias("who"), F.count(F.lit(1)).alias("n_same")), "classes")
    edges = near_edges(classes, threshold)
    own = edges_of_ids(signed, "_id", "fp")
    more = least_of(edges if own is None else edges.unionByName(own), classes, "fp").withColumnRenamed("who", "component")
    label = classes.join(more, "fp", "left").filter("n_same > 1 or component is not null").select("fp", F.coalesce("component", "who").alias("component"), "n_same")
    out = join_hot(signed, label, ["fp"], "n_same", "_id")
    return out.select(F.col("_id").alias(id_col), "fp", F.coalesce("component", "_id").alias("component_id"), F.coalesce("n_same", F.lit(1)).alias("n_same"))


def deduplicate(docs: DataFrame, threshold: int = 2, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component; rows that repeat an id, or have none, stay or go together."""
    found = near_classes(docs, threshold, k, id_col, text_col)
    gone = cut(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_id")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"))
    maybe = sieve(F.col("_id"), gone, F.col("_id"))
    return rows.filter(~maybe).unionByName(rows.filter(maybe).join(gone, "_id", "left_anti").select("_row", "_id")).select("_row.*")


def as_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
