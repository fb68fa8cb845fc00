"""Document fingerprints: closed syncmers over words, as DataFrame functions only.

A text is a sequence of units, with K - 1 marks before and after it. Units are its words; a word of more than LONG characters (a text without spaces
is one) is so many units as it has characters. A run of K units is an anchor where the least hash of its one-unit runs is the first or the last of
them: whether a run is an anchor depends on nothing outside it, so two texts choose the same anchors wherever they agree for K units, however
their positions differ. Texts of SHORT characters or fewer have anchors of CHAR_K characters besides, as a few words have too few runs.
``anchors`` gives all word anchors, with positions; ``match_positions`` lines two texts up.

A fingerprint is the text's anchors, all of them, in order: the position and DIGITS of the hash as one hexadecimal number; after a bar those of
characters where the text is short. Nothing is cut off, so it grows with the text, to about the text's own size. ``read_anchors`` reads it.

``with_alignment`` compares two texts of one row by all their anchors: those whose hash each text has once match wherever they stand, and the
shift most of them share (the least of several) is that of the texts; anchors that repeat match where they line up at that shift. The matched
part is 2 * matched / (anchors of both). ``comparable`` chooses what is compared: characters where both texts are short, else words.

Defined results: null counts as empty; a text without a word has no word anchors, an empty text the fingerprint ''; texts without any anchors are
like each other (1.0) and unlike all others (0.0); equal texts have equal fingerprints; words are cut at white space and A-Z lower-cased; rows that
repeat an id follow each other in order of a hash of their texts; the next document of the last is the first, of a single one itself; null ids
come first; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, lower_ascii, shuffle_partitions

K = 5
CHAR_K = 6
SHORT = 400
LONG = 24
DIGITS = 9
#: Stands before and after a text; no word holds a space, and no character of a text is two.
MARK = "  "
_NONE = "array<bigint>"


def marked_hashes(units: Column, k: int) -> Column:
    """xxhash64 of each unit, with k - 1 marks on either side; empty where there is none. units must be a column of a table."""
    mark = F.array_repeat(F.xxhash64(F.lit(MARK)), k - 1)
    return F.when(F.size(units) > 0, F.concat(mark, F.transform(units, lambda w: F.xxhash64(w)), mark)).otherwise(F.array().cast(_NONE))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def units_of(words: Column) -> Column:
    """The words, with those of more than LONG characters cut into characters. words must be a column of a table."""
    cut_up = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w))))
    return F.when(F.exists(words, lambda w: F.length(w) > LONG), cut_up).otherwise(words)


def chars_of(text: Column) -> Column:
    """The characters of a short text; null for others."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) <= SHORT, F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), ""), lambda c: c != ""))


def anchors_of(hashes: Column, k: int = K) -> Column:
    """array<struct<pos, hash>> in order of position. Of k units, the least hash is the first or the last. hashes must be a column of a table and no
    expression, as it is read for every place of a run."""

    def at(i: Column) -> Column:
        h = [F.get(hashes, i + j) for j in range(k)]
        edge = F.least(h[0], h[-1]) <= (F.least(*h[1:-1]) if k > 3 else h[1])
        return F.when(edge, F.struct(i.alias("pos"), F.shiftrightunsigned(F.xxhash64(*h), 64 - 4 * DIGITS).alias("hash")))

    runs = F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), at)).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))
    return F.filter(runs, lambda x: x.isNotNull())


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per anchor: id, pos (words before it, marks included), hash."""
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")).select("id", units_of(F.col("w")).alias("u")).select("id", marked_hashes(F.col("u"), k).alias("h"))
    return rows.select("id", F.explode(anchors_of(F.col("h"), k)).alias("a")).select("id", "a.pos", "a.hash")


def match_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Anchors that two texts of ``anchors`` tables share: id, other_id, shift (how far the second is moved), matched, first_pos, last_pos.

    Hashes that a text has more than once say nothing about position and are left out.
    """
    once = lambda d: d.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).filter("n = 1").drop("n")
    both = once(left).join(once(right).select(F.col("id").alias("other_id"), "hash", F.col("pos").alias("other_pos")), "hash")
    return both.groupBy("id", "other_id", (F.col("other_pos") - F.col("pos")).alias("shift")).agg(F.count(F.lit(1)).alias("matched"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def with_anchors(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds for each name of texts, from a column of texts, <name>_words and <name>_chars: anchors_of its words, and of its characters, which are null
    for a text that is not short. A null text counts as empty. Each step is a column of its own, so that no array is computed more than once."""
    kept = rows.columns
    out = rows.withColumns({f"_w_{n}": words_of(F.col(c)) for n, c in texts.items()} | {f"_l_{n}": chars_of(F.col(c)) for n, c in texts.items()})
    out = out.withColumns({f"_u_{n}": units_of(F.col(f"_w_{n}")) for n in texts})
    out = out.withColumns({f"_h_{n}": marked_hashes(F.col(f"_u_{n}"), K) for n in texts} | {f"_c_{n}": marked_hashes(F.col(f"_l_{n}"), CHAR_K) for n in texts})
    chars = lambda n: F.when(F.col(f"_l_{n}").isNotNull(), anchors_of(F.col(f"_c_{n}"), CHAR_K))
    return out.select(*kept, *[anchors_of(F.col(f"_h_{n}")).alias(f"{n}_words") for n in texts], *[chars(n).alias(f"{n}_chars") for n in texts])


def as_text(name: str) -> Column:
    """The fingerprint, from the columns that with_anchors adds for a name."""
    one = lambda x: F.hex(x["pos"].cast("bigint") * (1 << 4 * DIGITS) + x["hash"])
    joined = lambda c: F.array_join(F.transform(c, one), " ")
    words, chars = F.col(f"{name}_words"), F.col(f"{name}_chars")
    return F.concat(joined(words), F.when(F.size(chars) > 0, F.concat(F.lit("|"), joined(chars))).otherwise(""))


def read_anchors(rows: DataFrame, fingerprints: dict[str, str]) -> DataFrame:
    """What with_anchors adds, from columns of fingerprints. Nothing in the fingerprint '' tells the length of its text: it counts as short."""
    one = lambda v: F.struct(F.shiftright(v, 4 * DIGITS).cast("int").alias("pos"), v.bitwiseAND(F.lit((1 << 4 * DIGITS) - 1)).alias("hash"))
    read = lambda c: F.transform(F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint")), one)
    out = {}
    for n, c in fingerprints.items():
        out[f"{n}_words"] = read(F.substring_index(c, "|", 1))
        out[f"{n}_chars"] = F.when(F.col(c).contains("|") | (F.col(c) == ""), read(F.when(F.col(c) == "", "").otherwise(F.substring_index(c, "|", -1))))
    return rows.withColumns(out)


def comparable(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds <pair>_0 and <pair>_1 for each pair of names: the anchors to compare, of characters where both texts are short, else of words."""
    out = {}
    for n, ab in pairs.items():
        short = F.col(f"{ab[0]}_chars").isNotNull() & F.col(f"{ab[1]}_chars").isNotNull()
        out |= {f"{n}_{k}": F.when(short, F.col(f"{x}_chars")).otherwise(F.col(f"{x}_words")) for k, x in enumerate(ab)}
    return rows.withColumns(out)


#: Added to the positions of the second text where two are sorted together; no text has as many words.
SECOND = 1 << 32


def with_alignment(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each name of pairs, from two columns of anchors_of, a struct: near (0 to 1), shift (how far the second is moved), matched, aligned (those at that shift).

    Each step is a column of its own, so that no array is computed more than once. Sorting bounds the work: no hash is ever paired with all its repeats.
    """
    kept = rows.columns
    moved = lambda c, by: F.transform(c, lambda x: F.struct(x["hash"].alias("hash"), (x["pos"].cast("bigint") + F.lit(by).cast("bigint")).alias("at")))
    both = lambda a, b: F.sort_array(F.concat(moved(a, 0), moved(b, SECOND)))

    def shifts(c: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            y = F.get(c, i + 1)
            alone = F.coalesce(F.get(c, i - 1)["hash"] != x["hash"], F.lit(True)) & F.coalesce(F.get(c, i + 2)["hash"] != x["hash"], F.lit(True))
            return F.when((y["hash"] == x["hash"]) & (x["at"] < SECOND) & (y["at"] >= SECOND) & alone, y["at"] - x["at"] - SECOND)

        return F.sort_array(F.array_compact(F.transform(c, at)))

    def most(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1))
        more = run > acc["n"]
        return F.struct(x.alias("last"), run.alias("run"), F.when(more, x).otherwise(acc["shift"]).alias("shift"), F.when(more, run).otherwise(acc["n"]).alias("n"))

    zero = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("shift"), F.lit(0).alias("n"))
    out = rows.withColumns({f"_both_{n}": both(F.col(a), F.col(b)) for n, (a, b) in pairs.items()})
    out = out.withColumns({f"_shifts_{n}": shifts(F.col(f"_both_{n}")) for n in pairs})
    out = out.withColumns({f"_most_{n}": F.aggregate(f"_shifts_{n}", zero, most) for n in pairs})
    place = lambda c, by: F.transform(c, lambda x: F.xxhash64(x["hash"], x["pos"].cast("bigint") + by))
    out = out.withColumns({f"_aligned_{n}": F.size(F.array_intersect(place(F.col(a), F.col(f"_most_{n}")["shift"]), place(F.col(b), F.lit(0).cast("bigint")))) for n, (a, b) in pairs.items()})
    matched = lambda n: F.size(f"_shifts_{n}") - F.col(f"_most_{n}")["n"] + F.col(f"_aligned_{n}")
    near = lambda n, a, b: F.coalesce(F.try_divide(2.0 * matched(n), (F.size(a) + F.size(b)).cast("double")), F.lit(1.0))
    found = {n: F.struct(near(n, a, b).alias("near"), F.col(f"_most_{n}")["shift"].alias("shift"), matched(n).alias("matched"), F.col(f"_aligned_{n}").alias("aligned")) for n, (a, b) in pairs.items()}
    # through a generator, so that a filter on the result is not worked out below, where every array would be computed anew for each of its elements
    return out.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))))


def likeness(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each name of pairs the likeness (0 to 1) of two columns of fingerprints."""
    held = read_anchors(rows, {f"_{n}{k}": c for n, ab in pairs.items() for k, c in enumerate(ab)})
    held = comparable(held, {f"_p_{n}": (f"_{n}0", f"_{n}1") for n in pairs})
    found = with_alignment(held, {n: (f"_p_{n}_0", f"_p_{n}_1") for n in pairs})
    return found.select(*rows.columns, *[F.col(n)["near"].alias(n) for n in pairs])


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the rows dealt into ranges of the id and sorted: _part, _id, _tie, _text; of each range the text that follows it: _part, _after).

    Ranges are made by the ids' quantiles, so texts cross the network once. An id that several quantiles fall on is cut into so many ranges by the hash
    of its texts, rows without an id likewise by their share of the rows, so that no range holds many times its part. A range's first row is found by
    ids and hashes alone; then its text is fetched, one for each range.
    """
    spark = docs.sparkSession
    n = ranges or max(24, 2 * shuffle_partitions(spark))
    id_ = F.col(id_col)
    held = docs.select(F.percentile_approx(id_, F.array(*[F.lit(i / n) for i in range(1, n)]), 10 * n).alias("q"), F.count(F.lit(1)).alias("n"), F.count(id_).alias("known")).head()
    times = Counter(held["q"] or [])
    hot = {b: m for b, m in times.items() if m > 1}
    many = lambda bounds, test: F.size(F.filter(F.array(*[F.lit(b) for b in sorted(bounds)]), test)) if bounds else F.lit(0)
    # a hot id has a number of its own, so that the ids after it come after all of its ranges
    number = F.when(F.col("_id").isNull(), -1).otherwise(many(times, lambda b: b <= F.col("_id")) + many(hot, lambda b: b < F.col("_id")))
    pieces = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("_id")), F.lit(1)) if hot else F.lit(1)
    pieces = F.when(F.col("_id").isNull(), max(1, math.ceil(n * (held["n"] - held["known"]) / max(held["n"], 1)))).otherwise(pieces)
    piece = F.least(F.floor((F.col("_tie") / 2.0**64 + 0.5) * pieces), pieces - 1)
    rows = docs.select(id_.alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).select("_id", F.xxhash64("_text").alias("_tie"), "_text")
    rows = rows.select((number * (n + 1) + piece).cast("int").alias("_part"), "_id", "_tie", "_text")
    place = F.struct(F.col("_id").isNotNull().alias("a"), F.coalesce("_id", F.lit(0)).alias("b"), F.col("_tie").alias("c"))
    firsts = rows.groupBy("_part").agg(F.min(place).alias("p")).collect()  # a row for each range
    order = sorted((r["_part"], r["p"]) for r in firsts)
    # the row that follows range k is the first of the range after it
    follows = [(order[k - 1][0], p["a"], p["b"], p["c"]) for k, (_, p) in enumerate(order)]
    wanted = F.broadcast(spark.createDataFrame(follows, "_at int, a boolean, b long, c long"))
    same = (F.col("_id").isNotNull() == F.col("a")) & (F.coalesce("_id", F.lit(0)) == F.col("b")) & (F.col("_tie") == F.col("c"))
    after = cut(rows.join(wanted, same).groupBy("_at").agg(F.min("_text").alias("_after")).withColumnRenamed("_at", "_part"), "after")
    return rows.repartition(n, "_part").sortWithinPartitions("_part", "_id", "_tie"), after


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points (rounded down) replaced by as many of the following text, or all it has."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.left(text, F.length(text) - n), F.left(following, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, text (null: empty) and fingerprint of every row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_anchors(rows, {"_own": "text"}).select(id_col, "text", as_text("_own").alias("fingerprint"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, text and edited text of every row, with what with_anchors adds for own, new and next: the text, the edited one and the next row's text.

    A text's anchors are computed once, after the shuffle, and are at hand for the row before it.
    """
    rows, after = in_order(docs, id_col, text_col)
    w = Window.partitionBy("_part").orderBy("_id", "_tie")
    led = with_anchors(rows, {"own": "_text"})
    led = led.withColumns({"_lead": F.lead("_text").over(w), "_lead_words": F.lead("own_words").over(w), "_lead_chars": F.lead("own_chars").over(w)})
    # one text for each range, whatever the corpus
    led = led.join(F.broadcast(after), "_part", "left")
    led = led.withColumns({"_new": edited(F.col("_text"), F.coalesce("_lead", "_after")), "_last": F.when(F.col("_lead").isNull(), F.col("_after"))})
    found = with_anchors(led, {"new": "_new", "_other": "_last"})
    following = [F.when(F.col("_lead").isNull(), F.col(f"_other_{c}")).otherwise(F.col(f"_lead_{c}")).alias(f"next_{c}") for c in ("words", "chars")]
    return found.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), F.col("_new").alias("edited"), "own_words", "own_chars", "new_words", "new_chars", *following)
