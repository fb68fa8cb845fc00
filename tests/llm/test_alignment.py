"""Alignment of two tokenizers against plain Python and the libraries themselves."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqlab.llm import alignment
from seqlab.llm.tokenise import PieceEncoder

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_character():
    """The alphabet of byte-level vocabularies: printable characters stand for themselves, the other bytes for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + more)] = b
            more += 1
    return table


def brute(rows):
    tok, sp, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of_character()
    tok.encode_special_tokens = True
    out, links = [], []
    for d, text in rows:
        whole = (" " + text).encode() if text else b""
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        spell_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
        spell_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
            a, b, spell_a, spell_b = [], [], [], []
        ends = []
        for spelled in (spell_a, spell_b):
            at, e = 0, []
            for x in spelled:
                at += len(x)
                e.append(at)
            ends.append(e)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j, mine = [], 0, 0, []
        for c in cuts:
            ga, gb = [], []
            i0, j0 = i, j
            while i < len(a) and ends[0][i] <= c:
                ga.append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= c:
                gb.append(b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            span = lambda e, s, k: (e[k] - len(s[k]), e[k])
            for x in range(i0, i):
                for y in range(j0, j):
                    (p, q), (r, s) = span(ends[0], spell_a, x), span(ends[1], spell_b, y)
                    if p < s and r < q:
                        mine.append((a[x], b[y]))
        links.append(mine)
        out.append([d, len(a), len(b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    n = Counter(p for m in links for p in m)
    most = Counter()
    for (_, y), c in n.items():
        most[y] = max(most[y], c)
    return Counter((*o, sum(n[p] == most[p[1]] for p in m), sum(n[p] for p in m)) for o, m in zip(out, links)), n


def texts():
    rng = random.Random(2)
    words = ["the", "Thtion", "éôü", "naïve", "12,345.67", "don't", "<|endoftext|>", "</s>", "中文字", "🙂", "a" * 90, "x_y", "\t", "\n\n", "...", "\x00", "Ångström"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "", "    "]) for _ in range(rng.choice([1, 4, 60])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "   "), (104, "a▁b"), (105, "▁"), (106, " lead"), (107, "end  "), (108, "a b　"), (109, "ﬁ ①"), (5, "again"), (None, "no id"), (None, None)]
    return rows + [(110, " ".join(rng.choice(words[:10]) for _ in range(20_000)))]


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_like_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", limit)
    rows = texts()
    want, n = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("n_a"), F.lit(2).alias("pair"), F.lit(3).alias("_id")).repartition(3)
    found, pairs = alignment.align(docs, A, B)
    got = Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["n_best"], r["count_sum"]) for r in found.collect())
    assert got == want
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == n
    none, _ = alignment.align(docs.limit(0), A, B)
    assert none.count() == 0


def test_pieces_of_units_are_those_of_whole_texts():
    import pyarrow as pa

    sp, enc = sentencepiece.SentencePieceProcessor(model_file=B), PieceEncoder(B, memo=50, chunk=100)
    rng = random.Random(4)
    for _ in range(3):
        rows = ["".join(rng.choice([" ", " ", "e", "th", "É", "▁", "\n", "🙂", "ing", "0"]) for _ in range(rng.randrange(1, 200))) for _ in range(150)]
        ids, at = enc.encode(pa.array([" " + t for t in rows]))
        for t, lo, hi in zip(rows, at[:-1], at[1:]):
            if "▁" in t:
                assert (ids[lo:hi] == enc.UNLIKE).any()
            else:
                assert ids[lo:hi].tolist() == sp.encode(t)
