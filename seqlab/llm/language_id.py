"""Language ID by compression: the language whose zstandard dictionary makes a text smallest.

For each language a raw-content dictionary is put together from a bounded sample of labelled texts: whole texts of the SAMPLE_DOCS with the smallest
hash of their id are cut into pieces of PIECE characters, and the pieces with the smallest hash, wherever in a text they stand, fill DICT_BYTES;
pieces that several texts share tell no language and are left out. A text is lower-cased and compressed whole, in equal blocks of BLOCK bytes at
most, each by itself, so that a long text is judged by the dictionaries and not by its own history. All blocks go by the same parameters, and after
LEAD bytes of the dictionary, without which the format stores a short block as it is. The sums of the sizes are compared. The score is the margin,
1 - smallest / next; a text with a score below ``min_margin`` is rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; equal sums go to the language with more labelled rows,
then in order of name; a text that is rejected for its margin keeps its nearest language in lang_pred; with one language known the score is 1
wherever there is a letter; with none, everything is ``und``. Rows without a label, an id or a text teach nothing; of rows that repeat an id in
one language the text with the smallest hash teaches; rows that repeat an id are judged each by itself; other columns pass, but those named like a
column of the result give way to it in ``classify``; ``keep_known`` returns rows as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_and_more, small_batches, tidy

SAMPLE_DOCS = 800
PIECE = 256
DICT_BYTES = 65_536
BLOCK = 2_048
LEAD = 256
UNKNOWN = "und"
#: Above nearly all texts in none of the learned languages and below nearly all texts in one (README, "Language ID in the pipeline").
MIN_MARGIN = 0.03


def _few(labelled: DataFrame, often: dict[str, int]) -> DataFrame:
    """lang, id of SAMPLE_DOCS ids of each language: those with the smallest hash.

    Hashes are even, so few more than twice as many as are wanted lie below a bound that follows from a language's number of rows; only those are
    shuffled, once for each id.
    """
    share: Column = F.pmod(F.col("rank"), F.lit(1 << 30)) / float(1 << 30)
    bound = F.lit(0.0)
    for lang, n in often.items():
        bound = F.when(F.col("lang") == lang, F.lit((2 * SAMPLE_DOCS + 1_000) / n)).otherwise(bound)
    ids = labelled.filter(share < bound).groupBy("lang", "id").agg(F.first("rank").alias("rank"))
    order = Window.partitionBy("lang").orderBy("rank", "id")
    return ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_DOCS).select("lang", "id")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, those with the most labelled rows first. Only the chosen pieces come to the driver: DICT_BYTES of characters
    for each language."""
    known = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("lang is not null and id is not null and text is not null")
    often = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not often:
        return {}
    ranked = known.withColumn("rank", F.xxhash64(F.col("id").cast("string")))
    # SAMPLE_DOCS ids for each language, and languages are few
    picked = known.join(F.broadcast(_few(ranked.drop("text"), often)), ["lang", "id"])
    texts = picked.groupBy("lang", "id").agg(F.min_by(F.lower("text"), F.xxhash64("text")).alias("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(PIECE))
    pieces = texts.select("lang", F.explode(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(PIECE)))).alias("piece"))
    own = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.first("lang").alias("lang")).filter("n = 1")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    # pieces are shorter only at a text's end, so that most of these are whole; a sample's texts are SAMPLE_DOCS at most
    few = own.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= 2 * DICT_BYTES // PIECE)
    out: dict[str, bytes] = {}
    for r in few.orderBy("lang", "k").collect():
        have = out.get(r["lang"], b"")
        if len(have) < DICT_BYTES:
            out[r["lang"]] = (have + b"\n" + r["piece"].encode("utf-8", "surrogatepass"))[:DICT_BYTES]
    return {lang: out[lang] for lang in sorted(out, key=lambda x: (-often[x], x))}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zstd

        how = zstd.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=3, target_length=16, strategy=zstd.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.by_lang = []
        for lang, raw in dictionaries.items():
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            at = len(raw) // 2
            self.by_lang.append((lang, zstd.ZstdCompressor(compression_params=how, dict_data=d), raw[at : at + LEAD]))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of a text in each language, in the order of the dictionaries."""
        raw = text.lower().encode("utf-8", "surrogatepass")
        step = -(-len(raw) // max(1, -(-len(raw) // BLOCK)))
        blocks = [raw[i : i + step] for i in range(0, len(raw), step)]
        return [sum(len(z.compress(lead + b)) for b in blocks) for _, z, lead in self.by_lang]

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.by_lang or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        order = sorted((n, k) for k, n in enumerate(self.sizes(text)))
        return self.by_lang[order[0][1]][0], 1 - order[0][0] / order[1][0] if len(order) > 1 else 1.0


def _judged(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float, text_col: str, keep: list[str]) -> DataFrame:
    """_row (the columns named in keep), lang_pred, score, rejected. One pass, no shuffle."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICT_BYTES for each language
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(text_col).alias("_text"))
    row_type = rows.schema["_row"].dataType.simpleString()

    def judge(batches):
        import pyarrow as pa

        c = Classifier(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [c(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["_row", "lang_pred", "score"])
        tidy()

    found = rows.mapInArrow(judge, f"_row {row_type}, lang_pred string, score double")
    return found.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin))


def classify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (all of docs where None), lang_pred, score, rejected."""
    return row_and_more(_judged(docs, dictionaries, min_margin, text_col, docs.columns if keep is None else keep), ["lang_pred", "score", "rejected"])


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, as they are."""
    return _judged(docs, dictionaries, min_margin, text_col, docs.columns).filter("not rejected").select("_row.*")
