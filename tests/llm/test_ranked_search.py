"""Ranked search against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqlab.llm import ranked_search


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top):
    found = [(d, Counter(terms_of(t))) for d, t in docs]
    n = sum(bool(c) for _, c in found)
    length = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for place, (d, c) in enumerate(found):
            size, score = sum(c.values()), 0
            for t in set(terms_of(text)) & set(c):
                m = 100 - 90 + (90 * size * n) // length
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is not None, d or 0, place))
        for rank, (s, known, d, _) in enumerate(sorted(scores)[:top], 1):
            out[item, rank, d if known else None, -s] += 1
    return out


def fixture():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    weights = [1 / (i + 1) for i in range(4000)]
    docs = [(i * 3 + 1, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 200])))) for i in range(600)]
    docs += [(5000 + i, docs[i % 7][1]) for i in range(60)]  # ties
    docs += [(9000, None), (9001, ""), (9002, " .-\n"), (9003, "É_é W1 w1!W1"), (1, "w3 w5"), (None, "w3 w5"), (9004, " ".join(rng.choices(words, k=30_000)))]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 4, 30])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, docs[3][1]), (103, "É w3"), (None, "w3 w3 W5"), (104, docs[0][1] + " " + docs[9][1])]
    return docs, items


@pytest.mark.parametrize("block,items_of,top", [(4096, 256, 10), (50, 8, 10), (64, 3, 1)])
def test_search_like_brute_force(spark, monkeypatch, block, items_of, top):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "ITEMS", items_of)
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("block"), F.lit(2).alias("score"), F.lit("x").alias("token")).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)).repartition(2)
    d = d.select("doc_id", "text", "block", "score", "token")
    got = ranked_search.search(d, i, top).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == brute(docs, items, top)
    if block == 4096:
        assert ranked_search.search(d.limit(0), i).count() == ranked_search.search(d, i.limit(0)).count() == 0


def test_late_stages_open_no_accumulators_that_cannot_win(spark, monkeypatch):
    """Two rare terms decide; frequent ones alone cannot reach the tenth, so documents with those alone are never held."""
    monkeypatch.setattr(ranked_search, "SHARES", (1 / 20, 1.0))
    docs = [(i, "common words here rare one") if i < 12 else (i, "common words here") for i in range(1, 2000)]
    docs += [(3000 + i, "other") for i in range(1500)]
    held = []
    whole = ranked_search.cut

    def watched(df, name="cut"):
        out = whole(df, name)
        if name.startswith("stage"):
            held.append(out.select(F.sum(F.size("docs"))).head()[0])
        return out

    monkeypatch.setattr(ranked_search, "cut", watched)
    items = [(1, "common words rare one")]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == brute(docs, items, 10)
    assert held[0] == 11 and held[-1] <= 11
