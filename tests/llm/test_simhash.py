"""SimHash near-dedup against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqlab.llm import simhash
from seqlab.llm.components import components


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, threshold):
    """rows: (id, fingerprint)."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    x = np.array([f for _, f in rows], dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= threshold).tolist() + [j for j in range(i) if rows[j][0] == rows[i][0] is not None]:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f, least.get(find(i))) for i, (d, f) in enumerate(rows))


def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["É", "ÀB", "x" * 200]
    rows = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 30, 400]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 1, rng.choice([" ", "  ", "\n"]).join(copy)))
    long = " ".join(rng.choices(words, k=20_000))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE two"), (905, " One\x0btwo "), (906, long), (907, long + " x"), (3, "another text of the id three"), (906, "one")]
    return rows + [(None, "one"), (None, "nobody has this")]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("fp", "_id", "key", "component_id")])


@pytest.mark.parametrize("k,threshold", [(3, 2), (1, 5)])
def test_classes_like_brute_force(spark, k, threshold):
    rows = texts()
    want = brute_components([(d, brute_fingerprint(t, k)) for d, t in rows], threshold)
    got = simhash.near_classes(docs_of(spark, rows).repartition(5), threshold, k).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    kept = simhash.deduplicate(docs_of(spark, rows), threshold, k)
    assert kept.columns == docs_of(spark, rows).columns
    gone = {d for d, _, c in want if c is not None and d is not None and c != d}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in rows if d not in gone)
    assert simhash.near_classes(docs_of(spark, [])).count() == simhash.deduplicate(docs_of(spark, [])).count() == 0


def test_fingerprint_is_spark_hash_and_hex(spark):
    text = "Some words in ONE text"
    h = spark.sql("select xxhash64('some words in') % 2 as a, xxhash64('words in one') b, xxhash64('in one text') c, xxhash64('some words in') d").head()
    by_spark = sum(1 << b for b in range(64) if sum((x % 2**64) >> b & 1 for x in (h["b"], h["c"], h["d"])) > 1)
    assert by_spark == brute_fingerprint(text)
    row = spark.createDataFrame([(by_spark - 2**64 if by_spark >= 2**63 else by_spark,), (0,), (-1,)], "fp long").select(simhash.as_hex(F.col("fp")).alias("h")).collect()
    assert [r["h"] for r in row] == [f"{by_spark:016x}", "0" * 16, "f" * 16]


@pytest.mark.parametrize("hot", [20_000, 40])
def test_links_are_all_found(spark, monkeypatch, hot):
    """Clusters, frequent bits and a hot value; the values with more rows than hot are divided."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "FEW_BITS", 6)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 1500).astype(np.uint64)
    x[:700] &= np.uint64(0xFFFFFFFF00000000)  # one value of 32 bits
    x[:700] ^= rng.integers(0, 2**16, 700).astype(np.uint64)
    near = x[rng.integers(0, 1500, 900)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    x = np.unique(np.concatenate([x, near, np.zeros(1, np.uint64)]))
    pairs = [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2) if j > i]
    want = {}
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(int(j))
        parent[max(a, b)] = min(a, b)
    signed = x.view(np.int64)
    for i in range(len(x)):
        want.setdefault(find(i), set()).add(int(signed[i]))
    classes = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    edges = simhash.near_edges(classes).cache()
    got = {}
    for r in components(edges).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_thresholds_keep_the_pigeonhole_promise():
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**10):
        near = [simhash.distances(rng.integers(1, 100, 256) * rng.integers(0, 2, 256)) for _ in range(8)]
        parts = simhash.allocate(n, near, 2)
        assert sum(t + 1 for *_, t in parts) == 3 and all(t >= 0 for *_, t in parts)
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    bits = simhash.correlated_atoms(100, np.full((64, 64), 25.0) + 25 * np.kron(np.eye(8), np.ones((8, 8))))
    assert sorted(b for a in bits for b in a) == list(range(64)) and all(len({b // 8 for b in a}) == 1 for a in bits)
