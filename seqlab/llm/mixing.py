"""Mixing sources to target weights by soft membership, as DataFrame functions only.

1. ``fit_domains`` learns from labelled texts, a bounded sample of them (the FIT_DOCS with the smallest hash of their id), how often a hashed word
   occurs in texts of each domain: naive Bayes on presence over BUCKETS hashes, smoothed by SMOOTH of the sample's number of texts of the overall
   mixture. Words that a share of fewer than SEEN of the sample has (or fewer than 4 texts), or that tell domains apart by less than a factor
   exp(WEAK), do not count.
2. ``memberships`` gives each text its posterior of each domain. The evidence for or against a domain is held to EVIDENCE either way, so that long
   texts stay soft members.
3. ``fit_rates`` finds a rate from 0 to ``top`` for each document such that the expected tokens of the domains, the sum of rate * tokens * posterior,
   come to the targets, with the least squared distance (weighed by tokens) of the rates from ``top``: projected gradient steps, in which the moves
   add up and a document's rate is the projection of top - moves * posterior on 0 to ``top``. The gradient, which is the misfit, is scaled by the
   domains' Gram matrix (tokens * posterior * posterior) of the documents whose rate is free to move, or of all documents; of several lengths of a
   step (LENGTHS) the best is taken. One sum over all documents tries them all; nothing leaves the executors but as many numbers for each as there
   are pairs of domains, and no rates are stored.
4. ``mix`` keeps a document where a hash of its id, as a number from 0 to 1, is below its rate.

Tokens are the text's words. The target total, unless one is given, is SLACK times the largest that one rate for each cell of similar posteriors
(CELLS cells at most, whatever the corpus) serves in all domains together; whatever such rates reach, rates for each document reach too.

Defined results: a null or empty text has no tokens, the prior's posterior and takes part at its rate; a domain of the targets that no document
belongs to is left out and the others share its weight; without labelled texts all posteriors are even; rows that repeat an id go or stay
together, by the least rate among them; a row without an id stays; labels of unknown domains teach nothing; an empty table gives an empty table;
other columns pass through ``mix``.
Where rates serve
less than LEAST of all tokens in all domains together (as with even posteriors, or a domain of next to no tokens), there is no such mix: every rate
is top, and the column ``misfit``, the largest difference between a domain's expected share and its target share, says how far that is from the
targets. A given total that no rates reach raises ValueError, as does a fit that is not within TOLERANCE of every target after STEPS steps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, sieve

FIT_DOCS = 6_000
BUCKETS = 1 << 15
SEEN, SMOOTH, WEAK = 0.0035, 0.017, 0.7
EVIDENCE = 6.0
STEPS = 60
#: Posteriors are summed up in so many cells to find the total.
CELLS = 4_000
SLACK = 0.99
#: Lengths of a step that are tried, by the Gram matrix of the documents free to move and by that of all.
LENGTHS = ((1.0, 0.4, 0.1), (1.0, 10.0, 100.0))
#: Of all tokens at the rate top: a smaller total is no mix.
LEAST = 0.001
TOLERANCE = 1e-4
SEED = 17


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def buckets_of(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain that a row of labels stands for."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "good")


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> tuple[DataFrame, list[float]]:
    """(one row with an array of BUCKETS log-odds against the first domain for each other domain, log priors). labels: id, domain.

    Ids are chosen from the labels alone, so that only the sample's texts are read on.
    """
    known = labels.filter(F.col(domain_col).isin(domains) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain"), F.xxhash64(F.col(id_col).cast("string")).alias("rank"))
    ids = known.orderBy("rank", "id", "domain").limit(FIT_DOCS).select("id", "domain")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(ids), "id")  # FIT_DOCS ids at most
    seen = texts.select("domain", buckets_of(words_of(F.col("text"))).alias("buckets"))
    seen = cut(seen, "sample")
    held = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(held.values())
    prior = [math.log((held.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    of = lambda d: F.count(F.when(F.col("domain") == d, 1))
    counts = seen.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*[of(d).alias(f"n{k}") for k, d in enumerate(domains)])
    n = [F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(len(domains))]
    common = sum(n[1:], n[0])
    smooth = max(5.0, SMOOTH * total)
    share = lambda k: F.log((n[k] + smooth * (common + 0.5) / (total + 1.0)) / (held.get(domains[k], 0) + smooth))
    told = lambda k: F.when((common >= max(4.0, SEEN * total)) & (F.abs(share(k) - share(0)) >= WEAK), share(k) - share(0)).otherwise(0.0)
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    # a row for each bucket, whatever the corpus
    odds = every.select("bucket", *[told(k).alias(f"w{k}") for k in range(1, len(domains))])
    packed = [F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.col(f"w{k}").alias("w")))), lambda x: x["w"]).alias(f"w{k}") for k in range(1, len(domains))]
    return cut(odds.agg(*packed), "odds"), prior


def _total(buckets: str, weights: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.coalesce(F.get(weights, b), F.lit(0.0)))


def memberships(docs: DataFrame, model: tuple[DataFrame, list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, tokens, p (array of posteriors in the order of the domains). One pass, no shuffle."""
    odds, prior = model
    rows = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("_words"))
    rows = rows.select(id_col, F.size("_words").cast("long").alias("tokens"), buckets_of(F.col("_words")).alias("_buckets"))
    rows = rows.select("*", *[odds.select(f"w{k}").scalar().alias(f"_w{k}") for k in range(1, len(prior))])
    weighed = [F.lit(0.0)]
    for k in range(1, len(prior)):
        weighed.append(F.least(F.greatest(_total("_buckets", F.col(f"_w{k}")), F.lit(-EVIDENCE)), F.lit(EVIDENCE)) + F.lit(prior[k] - prior[0]))
    rows = rows.select(id_col, "tokens", F.array(*weighed).alias("_log"))
    top = F.array_max("_log")
    scaled = F.transform("_log", lambda x: F.exp(x - top))
    return rows.withColumn("_e", scaled).select(id_col, "tokens", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def _settle(tokens: np.ndarray, p: np.ndarray, target: np.ndarray, top: float, steps: int = 100) -> bool:
    """Whether rates from 0 to top bring these cells to the targets: fit_rates on arrays."""

    def at(move: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        rate = np.clip(top - p @ move, 0.0, top)
        free = (rate > 0) & (rate < top)
        return tokens * rate @ p, float(tokens @ (top - rate) ** 2), (p[free] * tokens[free, None]).T @ p[free]

    return _ascend(lambda tried: [at(m) for m in tried], target, (p * tokens[:, None]).T @ p, 0.1 * TOLERANCE, steps)[1]


def _ascend(sums, target: np.ndarray, whole: np.ndarray, tolerance: float, steps: int) -> tuple[np.ndarray, bool, np.ndarray]:
    """(moves, whether they come to the targets, the totals there). sums: some moves to their totals, squared distance and free Gram matrix."""
    k = len(target)
    small = 1e-9 * np.trace(whole) * np.eye(k)
    move, gram = np.zeros(k), whole
    have, _, _ = sums([move])[0]
    for _ in range(steps):
        miss = have - target
        if (np.abs(miss) <= tolerance * np.maximum(target, 1.0)).all():
            return move, True, have
        tried = [move + x * np.linalg.lstsq(g + small, miss, rcond=None)[0] for g, lengths in zip((gram, whole), LENGTHS) for x in lengths]
        found = sums(tried)
        # the dual of the least squares problem, which the moves ascend
        best = max(range(len(tried)), key=lambda t: found[t][1] / 2 + tried[t] @ (found[t][0] - target))
        move, (have, _, gram) = tried[best], found[best]
    return move, False, have


def cells(members: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, mean posteriors) of at most CELLS cells of a grid over the posteriors."""
    fine = max(g for g in range(1, CELLS) if math.comb(g + k - 1, k - 1) <= CELLS or g == 1)
    cell = F.transform("p", lambda x: F.floor(x * fine).cast("int"))
    rows = members.groupBy(cell.alias("cell")).agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]).filter("n > 0").orderBy("cell").collect()
    n = np.array([float(r["n"]) for r in rows])
    return n, np.array([[r[f"s{i}"] for i in range(k)] for r in rows]).reshape(len(rows), k) / n[:, None]


def feasible(tokens: np.ndarray, p: np.ndarray, weights: list[float], top: float) -> np.ndarray:
    """Target tokens of each domain: SLACK times the most that the cells serve in all open domains together."""
    sums = tokens @ p
    w = np.where(sums > 0, weights, 0.0)
    if not w.sum():
        return np.zeros(len(w))
    w = w / w.sum()
    below, above = 0.0, float(min(top * sums[k] / w[k] for k in range(len(w)) if w[k] > 0))
    if not _settle(tokens, p, above * w, top):
        while above - below > 1e-4 * above:
            mid = (below + above) / 2
            below, above = (mid, above) if _settle(tokens, p, mid * w, top) else (below, mid)
    else:
        below = above
    return SLACK * below * w


def fit_rates(members: DataFrame, weights: list[float], top: float = 1.0, total: float | None = None, steps: int = STEPS) -> DataFrame:
    """members with a rate for each row, and misfit. members: tokens, p; give a written table."""
    k = len(weights)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    every = range(k)

    def rate(move) -> str:
        return f"least(greatest({float(top)!r}D - ({' + '.join(f'{float(x)!r}D * p[{i}]' for i, x in enumerate(move))}), 0D), {float(top)!r}D)"

    def sums(tried: list) -> list[tuple[np.ndarray, float, np.ndarray]]:
        rows = members.selectExpr("tokens", "p", *[f"{rate(m)} AS r{t}" for t, m in enumerate(tried)])
        out = []
        for t in range(len(tried)):
            out += [f"sum(r{t} * p[{i}] * tokens) AS s{t}_{i}" for i in every] + [f"sum(pow({float(top)!r}D - r{t}, 2) * tokens) AS d{t}"]
            out += [f"sum(CASE WHEN r{t} > 0 AND r{t} < {float(top)!r}D THEN p[{i}] * p[{j}] * tokens ELSE 0D END) AS g{t}_{i}_{j}" for i, j in pairs]
        row = {c: x or 0.0 for c, x in rows.selectExpr(*out).head().asDict().items()}
        gram = lambda t: np.array([[row[f"g{t}_{min(i, j)}_{max(i, j)}"] for j in every] for i in every])
        return [(np.array([row[f"s{t}_{i}"] for i in every]), row[f"d{t}"], gram(t)) for t in range(len(tried))]

    n, q = cells(members, k)
    target = feasible(n, q, weights, top) if total is None else total * np.asarray(weights) / sum(weights)
    share = lambda x: np.asarray(x, dtype=float) / max(float(np.sum(x)), 1e-300)
    off = lambda have, wanted: F.lit(float(np.abs(share(have) - share(wanted)).max()))
    if not len(n) or total is None and target.sum() < LEAST * top * n.sum():
        return members.withColumn("rate", F.lit(float(top))).withColumn("misfit", off(n @ q, weights) if n.sum() else F.lit(0.0))
    move, reached, have = _ascend(sums, target, (q * n[:, None]).T @ q, TOLERANCE, steps)
    if not reached:
        raise ValueError(f"no rates from 0 to {top} bring the domains to {target.tolist()} tokens: they have {have.tolist()} after {steps} steps")
    return members.withColumn("rate", F.expr(rate(move))).withColumn("misfit", off(have, target))


def chosen(id_: Column, rate: Column, seed: int = SEED) -> Column:
    """Whether a document stays: a number from 0 to 1 that its id alone decides is below the rate."""
    return F.coalesce(F.pmod(F.xxhash64(id_.cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < rate, F.lit(True)) | id_.isNull()


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], top: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, tokens, p, rate and misfit of every row. labels: id, domain; weights: target share of each domain."""
    domains = list(weights)
    found = cut(memberships(docs, fit_domains(docs, labels, domains, id_col, text_col), id_col, text_col), "members")
    return fit_rates(found, [weights[d] for d in domains], top)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, so that the domains' tokens have the target weights. Few texts are shuffled: those whose id may be one to go."""
    found = rates(docs, labels, weights, 1.0, id_col, text_col)
    gone = cut(found.groupBy(F.col(id_col)).agg(F.min("rate").alias("rate")).filter(~chosen(F.col(id_col), F.col("rate"))).select(id_col), "gone")
    maybe = sieve(F.col(id_col), gone, F.col(id_col))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.filter(~F.coalesce(maybe, F.lit(False))).select(*columns).unionByName(docs.filter(maybe).join(gone, id_col, "left_anti").select(*columns))
