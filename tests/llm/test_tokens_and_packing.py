"""Token ids, token files and packing: exact round trips and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqlab.llm import packing, token_output, tokenise
from seqlab.llm.queries import tokenizer_path
from seqlab.llm.tokenise import WordEncoder


def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


TEXTS = ["", None, "a", " ", "  ", "a  b", " a", "a ", "\n\n a  \n b", "don't you'll 've", "x　 y  z \t q  w", "é ñ 12 ab12  !! ?", "a\n b", "a \nb", "<|endoftext|> x", "word " * 3000, "\x85 b\x1c c", "日本語 テキスト"]


def test_ids_are_the_librarys():
    rng = random.Random(1)
    parts = ["a", " ", "\n", "\t", "\u2003", "\x1c", "\x85", "\u200b", "'s", "'", "1", "!", "(", "é", "ñ", "×", "÷", "\u0301", "日", "\ufeff", "the", " of", "\r\n", "<|endof", "text|>", "<|endoftext|>"]
    texts = TEXTS + ["".join(rng.choices(parts, k=25)) for _ in range(1500)]
    ids = plain()
    want = [[*ids(t or ""), 7] for t in texts]
    for memo, chunk in ((None, None), (5, 3000), (500, 1)):
        e = WordEncoder(tokenizer_path(), memo, chunk)
        for _ in range(2):
            flat, at = e.encode(pa.array(texts), 7)
            assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    one = WordEncoder(tokenizer_path())
    for t, w in list(zip(texts, want))[:300]:
        assert one.encode(pa.array(["x", t]).slice(1), 7)[0].tolist() == w
    assert one.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_added_tokens_in_a_text_are_tokens():
    e = WordEncoder(tokenizer_path())
    flat, at = e.encode(pa.array(["a<|endoftext|>b c", "plain text", "<|endof", "text|>"]))
    assert 50256 in flat[: at[1]] and 50256 not in flat[at[1] :]


def test_units_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokenise, "run_hashes", lambda raw, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["one two three four", "five sixty seven", "one"]
    flat, at = WordEncoder(tokenizer_path()).encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain()(t) for t in texts]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("start", F.lit("x"))


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_BYTES", 200)
    rows = [(7 * (i % 11) + i, t) for i, t in enumerate(TEXTS * 3)]
    token_output.write_tokens(docs_of(spark, rows), f"{tmp_path}/t", tokenizer_path(), partitions=3)
    ids = plain()
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        x = np.asarray([*ids(t), 2], dtype="<u4").tobytes()
        want.append((d, x))
        at += len(x) // 4
    got = token_output.read_documents(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert sorted((r["id"], bytes(r["ids"])) for r in got) == sorted(want) and [r["id"] for r in got] == [d for d, _ in want]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()] and sum(r["n_tokens"] for r in got) == at
    few = token_output.read_some(spark, f"{tmp_path}/t", [rows[0][0], 999_999]).collect()
    assert {r["id"] for r in few} == {rows[0][0]}
    assert bytes(few[0]["ids"]) in [x for d, x in want if d == rows[0][0]] and token_output.read_some(spark, f"{tmp_path}/t", []).count() == 0
    index = spark.read.parquet(f"{tmp_path}/t/index")
    assert index.columns == ["id", "part", "shard", "at", "size", "n_tokens", "start"] and index.count() == len(rows)
    _, digest = token_output.dictionary(spark, f"{tmp_path}/t")
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/t/shards").select("dict_hash").collect()} == {digest}


def test_token_files_of_nothing_and_of_null_ids(spark, tmp_path):
    token_output.write_tokens(docs_of(spark, []), f"{tmp_path}/e", tokenizer_path())
    assert token_output.read_documents(spark, f"{tmp_path}/e").count() == 0
    token_output.write_tokens(docs_of(spark, [(None, "a"), (1, None), (1, "b")]), f"{tmp_path}/n", tokenizer_path())
    got = token_output.read_documents(spark, f"{tmp_path}/n").orderBy("start").collect()
    assert [r["id"] for r in got] == [None, 1, 1]


def test_another_dictionary_is_refused(spark, tmp_path):
    for name, text in (("a", "one two three"), ("b", "uno dos tres cuatro")):
        token_output.write_tokens(docs_of(spark, [(i, f"{text} {i}") for i in range(30)]), f"{tmp_path}/{name}", tokenizer_path())
    raw, digest = token_output.dictionary(spark, f"{tmp_path}/b")
    shards = spark.read.parquet(f"{tmp_path}/a/shards")
    with pytest.raises(Exception, match="another dictionary"):
        token_output._decode(shards, raw, digest, "bigint").collect()


@pytest.mark.parametrize("n,seed", [(0, 0), (1, 1), (40, 2), (700, 3), (5000, 4)])
def test_plans_hold_every_piece_once(n, seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(4.5, 1.0, n).astype(int), 1, 256)
    h = np.bincount(lengths, minlength=257)
    planned = packing.plan(h, 256)
    used = np.zeros(257, int)
    for key, c in planned:
        assert sum(key) <= 256 and c > 0
        np.add.at(used, list(key), c)
    assert (used == h).all()
    got = sum(c for _, c in planned)
    assert got <= first_fit_decreasing(lengths, 256) + 1 and got >= -(-int(lengths.sum()) // 256)


def first_fit_decreasing(lengths, capacity):
    rooms = []
    for v in sorted(lengths, reverse=True):
        for k, r in enumerate(rooms):
            if r >= v:
                rooms[k] -= v
                break
        else:
            rooms.append(capacity - v)
    return len(rooms)


def test_fitted_patterns_serve_the_histogram():
    h = np.zeros(101, int)
    h[[50, 30, 20, 60, 40]] = [200, 100, 100, 300, 300]
    pats = packing.patterns(np.nonzero(h)[0], 100)
    assert (pats.sum(axis=1) == 100).all()
    x = packing.fit(pats, h.astype(float), 2000)
    uses = np.bincount(pats.ravel(), np.repeat(x, 3), 101)
    assert (x >= 0).all() and np.abs(uses[1:] - h[1:]).max() < 2
    assert sum(c for _, c in packing.plan(h, 100)) == 300 + 100 + 50


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_documents(spark, capacity):
    rows = [(i * 2, t) for i, t in enumerate(TEXTS * 5)] + [(0, "again"), (None, "x")]
    got = packing.pack_documents(docs_of(spark, rows), tokenizer_path(), capacity, end_id=0).toPandas()
    ids = plain()
    want = []
    for d, t in rows:
        x = [*ids(t), 0]
        cut = (len(x) - 1) % capacity + 1
        for k, lo in enumerate([0, *range(cut, len(x), capacity)]):
            part = x[lo : cut if k == 0 else lo + capacity]
            want.append((-1 if d is None else d, k, lo, len(part), zlib.crc32(np.asarray(part, dtype="<u4").tobytes())))
    have = [(-1 if d != d else int(d), int(p), int(s), int(n), zlib.crc32(bytes(b))) for d, p, s, n, b in zip(got["doc_id"].astype(float), got["piece"], got["start"], got["length"], got["ids"])]
    assert sorted(have) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum()[:-1]])).all() and g["length"].sum() <= capacity


def test_packing_nothing(spark):
    assert packing.pack_documents(docs_of(spark, []), tokenizer_path()).count() == 0


def test_dictionary_of_little():
    assert token_output.train_dictionary([]) == b"" and len(token_output.train_dictionary([b"x" * 40] * 3)) > 0
    assert pa.array([token_output.train_dictionary([bytes(range(k, k + 100)) for k in range(50)])]).type == pa.binary()


def test_long_words_are_not_remembered():
    e = WordEncoder(tokenizer_path())
    e.encode(pa.array(["x " + "q" * 500 + " " + "r" * 300 + "!! short"]))
    assert e.size.now.max() <= 64 and e.seen.n == 3


def test_a_hot_length_is_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 10)
    found = spark.createDataFrame([(i, 0, 7 if i % 3 else 64 if i % 2 else 5 + i % 50) for i in range(600)], "doc_id long, piece int, length long")
    got = packing.pack(found, 64).toPandas()
    assert len(got) == 600 and not got.duplicated(["sequence_id", "offset"]).any()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum()[:-1]])).all() and g["length"].sum() <= 64
