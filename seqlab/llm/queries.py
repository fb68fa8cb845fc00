"""The registered queries of this subpackage: opN_<name>, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, fingerprint, jaccard_join, language_id, mixing, packing, quality, ranked_search, simhash, token_output, url_filter, warc_audit
from .common import held_out, shared_path, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: What SQL's translate needs to lower-case A-Z only.
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL["op9_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {ASCII_LOWER.format("coalesce(text, '')")} AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""


@query
def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    found = token_output.read_documents(spark, path)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda p: p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    found = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, derive=digest)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = language_id.fit(docs.filter(~held_out(F.col("doc_id"))))
    found = language_id.classify(docs, known, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = quality.fit(docs, labels, "quality")
    found = quality.score(docs, model, keep=["doc_id"])
    score = F.col("quality_score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= 0.7, 1).otherwise(0).alias("predicted"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.edited_pairs(table(spark, sf_dir, "documents"))
    pairs = {"to_edited": ("own", "new"), "to_next": ("own", "next")}
    found = fingerprint.with_alignment(fingerprint.comparable(rows, pairs), {n: (f"{n}_0", f"{n}_1") for n in pairs})
    digest = [F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint.as_text("own").alias("fingerprint"), fingerprint.as_text("new").alias("edited_fingerprint")]
    return found.select("doc_id", *digest, F.col("to_edited.near").alias("near_edited"), F.col("to_next.near").alias("near_next"))


#: The rules of the contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def second_copy(pages: DataFrame) -> DataFrame:
    """A replica of the pages as a failing disk would leave it: in one page of 101 one character changed, one of 997 cut short."""
    hurt = F.when(F.col("page_id") % 101 == 7, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).when(F.col("page_id") % 997 == 11, F.expr("substring(html, 1, cast(length(html) / 2 as int))")).otherwise(F.col("html"))
    return pages.withColumn("html", hurt)


@query
def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    first, second = (warc_audit.publish(p, shared_path(spark, name)) for p, name in ((pages, "replica"), (second_copy(pages), "replica")))
    found = warc_audit.audit(first, second)
    return found.select("file", F.col("id").alias("page_id"), "at", "length", "digest", "other_at", "other_length", "other_digest", "fault")


ORACLE_SQL["op3_warc_audit"] = """
WITH two AS (
  SELECT 1 AS copy, page_id, url, coalesce(html, '') AS html FROM pages
  UNION ALL
  SELECT 2, page_id, url, coalesce(CASE WHEN page_id % 101 = 7 THEN '?' || substring(html, 2) WHEN page_id % 997 = 11 THEN substring(html, 1, CAST(floor(length(html) / 2) AS INT)) ELSE html END, '') FROM pages
), written AS (
  SELECT copy, CAST(page_id // 1000 AS BIGINT) AS file, page_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM two
), placed AS (
  SELECT copy, file, page_id, strlen(record) AS length, sha256(record) AS digest,
    CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY copy, file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at
  FROM written
)
SELECT a.file, a.page_id, a.at, a.length, a.digest, b.at AS other_at, b.length AS other_length, b.digest AS other_digest,
  CASE WHEN a.digest <> b.digest THEN 'corrupt' ELSE 'moved' END AS fault
FROM placed a JOIN placed b ON a.copy = 1 AND b.copy = 2 AND a.page_id = b.page_id
WHERE a.digest <> b.digest OR a.at <> b.at
"""


#: Target shares of tokens by domain.
MIX_WEIGHTS = {"good": 0.97, "low": 0.02, "toxic": 0.01}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """id, domain of the labelled documents."""
    return labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("domain is not null")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = mixing.rates(docs, labelled_domains(table(spark, sf_dir, "labels")), MIX_WEIGHTS)
    p = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(MIX_WEIGHTS)]
    return found.select("doc_id", "tokens", *p, "rate", "misfit", mixing.chosen(F.col("doc_id"), F.col("rate")).alias("kept"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found, _ = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))
    return found


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents"), threshold=2, k=3)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id", "n_same")


#: n bytes are one term's, so its length is found in the UTF-8 text; items are few, documents are read whole.
ORACLE_SQL["op11_ranked_search"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ASCII_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
), q AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all({ASCII_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS term FROM benchmark
), c AS (SELECT count(*) AS n, sum(len(terms)) AS l FROM d WHERE len(terms) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
p AS (
  SELECT q.item_id, tf.r, tf.doc_id, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * df.df + 1))) AS BIGINT) * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + CAST((90 * tf.n * c.n) // c.l AS BIGINT)))) AS part
  FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN c
), s AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM p GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
