"""N-gram Jaccard join over a token-group matrix: every pair of texts whose shingle sets have a Jaccard similarity of ``percent`` or more.

1. Each text becomes its set of k-word shingles (``shingles``). Equal sets are one class from here on, so exact copies cost one row.
2. Tokens (shingles) have one global order: those that are frequent in a sample of the documents last, otherwise by hash. Two sets that are
   similar enough share a token among the first n - ceil(percent * n / 100) + 1 of each. The sample (one document in SAMPLE, tokens seen
   FREQUENT times there, the TOP most frequent of them) only decides the order; any order gives the same links.
3. Classes that share a token are partitioned into groups of similar ones: a class joins the group of its most shared token; a group of more
   than GROUP_TOKENS tokens is dealt into several.
4. The matrix says which tokens the members of a group have, with the sizes of the sets. A class is a query against each other group that
   has one of its first tokens and could have a set of fitting size; of two groups, the one with the larger number asks.
5. Groups are first opened on bitmaps alone: of each set, the parity of its tokens by hash slot, about two bits a token. The bits in which two
   bitmaps differ are no more than the tokens in which the sets do, so most queries and members turn out to have no possible partner.
6. For the rest the texts are fetched. A group is opened in one task with its queries streaming by. The union of its members' whole sets
   bounds each query's overlap; members are compared only where that bound suffices. Members are compared with each other the same way.
7. Each query hands on one edge for each linked part of a group, not one for each pair; ``components`` joins them up.

No pair of a group is ever a row, nothing is capped, and a group's memory is bounded by GROUP_TOKENS and one longest text.

Defined results: null and wordless texts have no set and link with nothing; a text of fewer than k words has one shingle, the whole; rows
that repeat an id are one document, whose texts all have its component (``jaccard_classes``), while ``keep_one_each`` decides by texts, so
that none is lost with another one of its id; rows without an id keep a null component unless an equal set has an id, and link with nothing
else; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, shuffle_partitions, sieve, small_batches, tidy
from .components import edges_of_ids, least_of
from .shingles import mix, shingle_sets

SAMPLE = 16
FREQUENT = 2
TOP = 500_000
GROUP_TOKENS = 300_000


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def frequent_tokens(docs: DataFrame, id_col: str, text_col: str, k: int) -> np.ndarray:
    """At most TOP hashes, ascending."""
    picked = docs.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SAMPLE)) == 0).select(F.col(text_col).alias("_text"))

    def tokens(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                sets = list(shingle_sets(batch.column("_text").slice(lo, 500), k))
                if sets:
                    u, c = np.unique(np.concatenate(sets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["token", "n"])

    counts = picked.mapInArrow(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "token").limit(TOP).select("token").toArrow().column(0).to_numpy()
    return np.sort(found.view(np.uint64)) if len(found) else np.zeros(0, np.uint64)


def among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_, x)
    return sorted_[np.minimum(at, len(sorted_) - 1)] == x


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """_id, _text_hash, n, class (a hash of the set's 128 bits and size, or of the id where it is empty), prefix (its first tokens in the global
    order), bits (its bitmap)."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, id_col, text_col, k))

    def sign(batches):
        import pyarrow as pa

        late = frequent.value
        for batch in batches:
            n, a, b, first, bits = [], [], [], [], []
            for s in shingle_sets(batch.column("_text"), k):
                n.append(len(s))
                bits.append(bitmap(s).tobytes())
                x, y = set_key(s)
                a.append(x)
                b.append(y)
                if len(s):
                    rare = among(late, s)
                    first.append(np.concatenate([s[~rare], s[rare]])[: prefix_size(len(s), percent)] if rare.any() else s[: prefix_size(len(s), percent)])
                else:
                    first.append(s)
            at = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32) if first else np.zeros(1, np.int32)
            flat = np.concatenate(first).view(np.int64) if first else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_text_hash"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(bits, pa.binary())],
                ["_id", "_text_hash", "n", "a", "b", "prefix", "bits"],
            )
        tidy()

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_text_hash"))
    signed = slim.mapInArrow(sign, "_id long, _text_hash long, n long, a long, b long, prefix array<long>, bits binary")
    return signed.withColumn("class", F.when(F.col("n") > 0, F.xxhash64("n", "a", "b")).otherwise(F.xxhash64(F.lit("empty"), "_id")))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return tuple(int(mix(s, seed).sum(dtype=np.uint64).astype(np.int64)) for seed in (1, 2))


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parity of the tokens in each of b slots, b the power of two from n on (64 at least), as 64-bit words."""
    b = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def halved(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (along the last axis) of half as many slots."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


class Bitmaps:
    """The bitmaps of a group's members, by number of words."""

    def __init__(self, n: list[int], bits: list[np.ndarray], percent: int):
        self.percent, self.live = percent, np.zeros(len(n), dtype=bool)
        self.by_words: dict[int, list] = {}
        for w in sorted({len(x) for x in bits}):
            who = np.array([i for i, x in enumerate(bits) if len(x) == w])
            self.by_words[w] = [who, np.array([n[i] for i in who]), np.stack([bits[i] for i in who])]

    def possible(self, n: int, bits: np.ndarray) -> np.ndarray:
        """Members that may link with a set of n tokens. Sizes that fit differ by less than one halving."""
        out = []
        for w, (who, sizes, rows) in self.by_words.items():
            fits = (self.percent * sizes <= 100 * n) & (self.percent * n <= 100 * sizes)
            if not fits.any():
                continue
            who, sizes, rows, q = who[fits], sizes[fits], rows[fits], bits
            while rows.shape[1] > len(q):
                rows = halved(rows)
            while len(q) > rows.shape[1]:
                q = halved(q)
            differ = np.bitwise_count(rows ^ q).sum(axis=1, dtype=np.int64)
            out.append(who[differ * (100 + self.percent) <= (sizes + n) * (100 - self.percent)])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _screened(percent: int):
    """Rows sorted by group, members before queries, to the rows (id, gid, role, copies) that may have a partner."""

    def screen(batches):
        import pyarrow as pa

        now, group, members, held = None, None, [], []
        out: list[tuple] = []

        def build():
            nonlocal group, members, held
            members, held = held, []
            group = Bitmaps([m[2] for m in members], [m[3] for m in members], percent)
            for i, m in enumerate(members if len(members) > 1 else []):
                found = group.possible(m[2], m[3])
                group.live[found[found != i]] = True

        def close():
            if group is not None:
                out.extend((m[0], now, 0, m[1]) for i, m in enumerate(members) if group.live[i])

        def emit():
            nonlocal out
            rows, out = out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["_id", "_gid", "_role", "_copies"])

        for batch in batches:
            for gid, role, x, c, n, raw in zip(*[batch.column(k).to_pylist() for k in ("_gid", "_role", "_id", "_copies", "n", "bits")]):
                if gid != now:
                    if held:
                        build()
                    close()
                    now, group = gid, None
                bits = np.frombuffer(raw, np.uint64)
                if role == 0:
                    held.append((x, c, n, bits))
                    continue
                if held:
                    build()
                if group is not None:
                    found = group.possible(n, bits)
                    if len(found):
                        group.live[found] = True
                        out.append((x, gid, 1, c))
                if len(out) > 5000:
                    yield emit()
        if held:
            build()
        close()
        if out:
            yield emit()
        tidy()

    return screen


class Group:
    """The sets of some classes, to be compared with a query at once."""

    def __init__(self, ids: list, sets: list[np.ndarray], copies: list[int], percent: int):
        self.ids, self.percent = ids, percent
        self.n = np.array([len(s) for s in sets])
        self.copies = np.array(copies)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        tokens = flat[order]
        self.who = np.repeat(np.arange(len(sets)), self.n)[order]
        self.union, self.lo = np.unique(tokens, return_index=True)
        self.hi = np.append(self.lo[1:], len(tokens))
        self.links = np.zeros(len(sets), dtype=np.int64)

    def linked(self, s: np.ndarray) -> np.ndarray:
        """The members whose similarity to s suffices."""
        q = len(s)
        at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
        at = at[self.union[at] == s]
        if 100 * len(at) < self.percent * q:  # a member shares no more with it than the union does
            return at[:0]
        lo, size = self.lo[at], self.hi[at] - self.lo[at]
        places = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        shared = np.bincount(self.who[places], minlength=len(self.n))
        return np.flatnonzero((100 + self.percent) * shared >= self.percent * (q + self.n))


def _opened(k: int, percent: int):
    """Rows sorted by group, members before queries, to edges: id, root (None once for what a row has of links alone), links."""

    def open_groups(batches):
        import pyarrow as pa

        now, last, group, roots = None, None, None, None
        ids, sets, copies = [], [], []
        out: list[tuple] = []

        def build():
            nonlocal group, roots, ids, sets, copies
            group = Group(ids, sets, copies, percent)
            parent = list(range(len(ids)))

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, s in enumerate(sets if len(sets) > 1 else []):
                found = group.linked(s)
                group.links[i] += group.copies[found].sum() - group.copies[i]
                for j in found[found > i]:
                    x, y = find(i), find(int(j))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
            roots = np.array([find(i) for i in range(len(ids))])
            ids, sets, copies = [], [], []

        def close():
            if group is not None:
                for i, x in enumerate(group.ids):
                    if roots[i] != i or group.links[i]:
                        out.append((x, group.ids[roots[i]], int(group.links[i])))

        def emit():
            nonlocal out
            rows, out = out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "b", "links"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                columns = [part.column(c).to_pylist() for c in ("_gid", "_role", "_class", "_copies")]
                for gid, role, x, c, s in zip(*columns, shingle_sets(part.column("_text"), k)):
                    if (gid, role, x) == last:  # another row of the same id and text
                        continue
                    last = (gid, role, x)
                    if gid != now:
                        if ids:
                            build()
                        close()
                        now, group = gid, None
                    if role == 0:
                        ids.append(x)
                        sets.append(s)
                        copies.append(c)
                        continue
                    if ids:
                        build()
                    if group is None:
                        continue
                    found = group.linked(s)
                    if len(found):
                        group.links[found] += c
                        links = int(group.copies[found].sum())
                        for r in np.unique(roots[found]):
                            out.append((x, group.ids[r], links))
                            links = 0
                if len(out) > 5000:
                    yield emit()
        if ids:
            build()
        close()
        if out:
            yield emit()
        tidy()

    return open_groups


def _linked(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row for each row of docs: _id, _text_hash, n, class; classes: class, who (its least id and that one's text), copies; edges of classes: a, b, links)."""
    spark = docs.sparkSession
    small_batches(spark)
    signed = cut(signatures(docs, id_col, text_col, k, percent), "signed")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  equal sets have equal ones
    who = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_text_hash"))).alias("who")
    every = cut(signed.groupBy("class").agg(who, F.count(F.lit(1)).alias("copies"), *[first(c) for c in ("n", "prefix", "bits")]), "classes")
    classes = every.filter("n > 0 and who is not null")
    facts = classes.select("class", "n", "copies", "bits")

    # tokens that more classes have among their first ones; the rest of the tokens cannot lead anywhere
    rows = classes.select("class", F.explode("prefix").alias("token"))
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    lists = cut(rows.join(shared, "token"), "lists")
    chosen = lists.groupBy("class").agg(F.max(F.struct("held", "token"))["token"].alias("key")).join(facts, "class")
    weight = chosen.groupBy("key").agg(F.sum("n").alias("w"))
    dealt = F.pmod(F.xxhash64("class"), F.ceil(F.col("w") / GROUP_TOKENS).cast("long"))
    members = cut(chosen.join(weight, "key").select("class", "n", "copies", "bits", F.xxhash64("key", dealt).alias("gid")), "members")

    placed = lists.select("token", "class").join(members.select("class", "gid", "n"), "class")
    matrix = placed.groupBy("token", "gid").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    q, g = placed.alias("q"), matrix.alias("g")
    asks = q.join(g, (F.col("q.token") == F.col("g.token")) & (F.col("g.gid") < F.col("q.gid")) & (F.col("q.n") * percent <= F.col("g.most") * 100) & (F.col("g.least") * percent <= F.col("q.n") * 100))
    asks = asks.select("q.class", "g.gid").distinct().join(members.drop("gid"), "class")

    n = max(24, 2 * shuffle_partitions(spark))
    row = lambda role: [F.col("gid").alias("_gid"), F.lit(role).alias("_role"), F.col("class").alias("_id"), F.col("copies").alias("_copies"), "n", "bits"]
    both = members.select(*row(0)).unionByName(asks.select(*row(1))).repartition(n, "_gid").sortWithinPartitions("_gid", "_role")
    screened = both.mapInArrow(_screened(percent), "_id long, _gid long, _role int, _copies long").withColumnRenamed("_id", "_class")
    wanted = cut(screened.join(classes.select(F.col("class").alias("_class"), "who.*"), "_class"), "wanted")

    # a text is found by its id and hash, as an id may have several
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.col(text_col).alias("_text"))
    both = F.xxhash64("_id", "_text_hash")
    fetched = wanted.join(texts.filter(sieve(both, wanted, both)), ["_id", "_text_hash"])
    opened = fetched.select("_gid", "_role", "_class", "_copies", "_text").repartition(n, "_gid").sortWithinPartitions("_gid", "_role", "_class").mapInArrow(_opened(k, percent), "a long, b long, links long")
    return signed.drop("prefix", "bits"), every.select("class", "who", "copies"), cut(opened, "links")


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id (the smallest id reachable by links, itself included), n_links.

    Ids are whole numbers. Two texts link when 100 * (shared shingles) >= percent * (shingles of either).
    """
    signed, classes, edges = _linked(docs, k, percent, id_col, text_col)
    joined = edges.select("a", "b")
    own = edges_of_ids(signed, "_id", "class")  # the texts of one id are one document
    joined = joined if own is None else joined.unionByName(own)
    links = edges.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    more = least_of(joined, classes, "class").select("class", F.col("who._id").alias("component"))
    label = (
        classes.join(more, "class", "left")
        .join(links, "class", "left")
        .filter("copies > 1 or component is not null or links > 0")
        .select("class", F.coalesce("component", "who._id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    )
    out = join_hot(signed, label, ["class"], "copies", "_id")
    n_links = F.when(F.col("n") > 0, F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0))).otherwise(0)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id"), n_links.alias("n_links"))


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the texts that links join, the one with the smallest id; all other texts. Rows without an id or without words stay; rows that repeat
    id and text stay or go together."""
    signed, classes, edges = _linked(docs, k, percent, id_col, text_col)
    best = classes.join(least_of(edges, classes, "class").withColumnRenamed("who", "best"), "class", "left").filter("copies > 1 or best is not null")
    best = best.select("class", F.coalesce("best", "who").alias("best"), "copies")
    rows = join_hot(signed.filter("n > 0 and _id is not null"), best, ["class"], "copies", "_text_hash")
    gone = cut(rows.filter(F.struct("_id", "_text_hash") != F.col("best")).select("_id", "_text_hash").distinct(), "gone")
    # only rows that may go are shuffled with their texts
    key = lambda d: F.xxhash64(d, F.xxhash64(text_col))
    maybe = sieve(key(F.col(id_col).cast("long")), gone, F.xxhash64("_id", "_text_hash"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    asked = docs.filter(maybe).select(F.struct(*columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_text_hash"))
    return docs.filter(~maybe).unionByName(asked.join(gone, ["_id", "_text_hash"], "left_anti").select("_row.*"))
