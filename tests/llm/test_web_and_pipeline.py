"""URL filter, WARC audit and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from seqlab.llm import mixing, url_filter, warc_audit
from seqlab.llm.common import table
from seqlab.llm.queries import QUERIES, URL_RULES, second_copy

SF = "/root/testdata/sf0.01"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("rule", F.lit(1))


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0])) if fits else None


URLS = [
    None, "", "no scheme", "http://", "https://A.example.ORG/en/12?x=/es/#y", "http://example.org/es/", "http://example.org", "http://badexample.org/x", "http://x.com/fr/1", "http://x.com/de/1", "http://com/fr/",
    "http://x.net/a://b/c", "ftp://x.com#/fr/", "http://x.com?/fr/", "http://x.com:80/fr/", "http://É.org/\nz", "http://a.b.c.example.org/en/2",
]


def test_rules_like_brute_force(spark):
    rows = [(i, u, None if i % 3 else "<a href='http://x.com/q'>") for i, u in enumerate(URLS)] + [(1, "http://x.com/fr/1", ""), (None, "http://x.com/fr/1", "")]
    got = url_filter.judge(pages_of(spark, rows), URL_RULES).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, u, _ in rows:
        h, p, r = brute_rule(u)
        want[(i, h, p, r[0] if r else None, r[1] if r else None)] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got) == want
    assert all(r["verdict"] == "allow" for r in got if r["host"] == "")
    assert url_filter.judge(pages_of(spark, []), URL_RULES).count() == 0


def test_distrust_travels_against_links(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">' for h in hosts)
    rows = [(1, "http://x.com/de/1", ""), (2, "http://farm.net/1", link("x.com")), (3, "http://far.info/1", link("farm.net")), (4, "http://good.org/1", link("friend.net")), (5, "http://friend.net/1", ""), (6, "http://lonely.io/1", "")]
    got = {r["host"]: r for r in url_filter.judge(pages_of(spark, rows), URL_RULES).collect()}
    assert got["farm.net"]["verdict"] == got["far.info"]["verdict"] == "block"
    assert got["friend.net"]["verdict"] == got["lonely.io"]["verdict"] == "allow" and got["friend.net"]["trust"] > 0


def test_propagation_like_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n = 12
    w = rng.integers(0, 3, (n, n)) * (1 - np.eye(n))
    w[4] = 0
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src string, dst string, weight double")
    t, b = rng.random(n), rng.random(n)
    seeds = spark.createDataFrame([(f"h{i}", float(t[i]), float(b[i])) for i in range(n)], "host string, trusted double, blocked double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(edges, seeds, tolerance=1e-6, steps=120).collect()}
    for k, (m, s) in enumerate(((w, t), (w.T, b))):
        out = m.sum(axis=1, keepdims=True)
        m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
        r = np.linalg.solve(np.eye(n) - url_filter.DAMPING * m.T, s)
        assert np.allclose([got[f"h{i}"][k] for i in range(n)], r / r.sum(), atol=1e-5)
    with pytest.raises(ValueError, match="still change"):
        url_filter.propagate(edges, seeds, steps=4)


def test_threshold_by_definition(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [(1, "http://x.com/de/1", link("mid.net")), (2, "http://mid.net/1", link("x.com", "good.org")), (3, "http://good.org/1", link("mid.net")), (4, "http://bad.net/1", link("x.com")), (5, "http://off.info/1", "")]
    got = url_filter.judge(pages_of(spark, rows), URL_RULES).collect()
    hosts = 5
    for r in got:
        own = "block" if r["distrust"] > url_filter.FLOOR / hosts and r["distrust"] > url_filter.RATIO * r["trust"] else "allow"
        assert r["rule"] or r["verdict"] == own
    assert {r["verdict"] for r in got if not r["rule"]} == {"block", "allow"}


def test_host_graph_of_whole_table(spark):
    got = QUERIES["op6_url_filter"](spark, SF)
    assert got.count() == table(spark, SF, "pages").count() and got.filter("verdict not in ('allow', 'block')").count() == 0


def replica(spark, rows):
    return warc_audit.leaves(warc_audit.records(pages_of(spark, rows)))


def test_audit_finds_every_fault(spark, monkeypatch):
    rows = [(i, f"http://a/{i}", "x" * (i % 50)) for i in range(2300)] + [(None, None, None), (7, "http://a/7", "again")]
    assert warc_audit.audit(replica(spark, rows), replica(spark, rows[::-1])).count() == 0
    hurt = [(i, u, ("y" + h[1:] if i in (3, 1203, 2299) and h else h)) for i, u, h in rows if i != 2100]
    got = warc_audit.audit(replica(spark, rows), replica(spark, hurt), fanout=4).collect()
    faults = Counter(r["fault"] for r in got)
    assert faults["corrupt"] == 2 + 1 and faults["missing"] == 1 and {r["id"] for r in got if r["fault"] == "corrupt"} == {3, 1203, 2299}
    assert faults["moved"] == 2299 - 2100 - 1 and {r["file"] for r in got if r["fault"] == "moved"} == {2}
    back = Counter(r["fault"] for r in warc_audit.audit(replica(spark, hurt), replica(spark, rows)).collect())
    assert back["extra"] == 1 and back["corrupt"] == 3
    assert warc_audit.audit(replica(spark, []), replica(spark, [])).count() == 0 and warc_audit.audit(replica(spark, rows[:3]), replica(spark, [])).count() == 3


def archive_files(path):
    return {int(f.parent.name[5:]): f for f in path.rglob("part-*")}


def test_stored_archives(spark, tmp_path):
    """Files hold the records one after another; changed bytes, torn records and lost files are found where they are."""
    rows = [(i, f"http://h/{i}", ("é" * (i % 40) + "\r\n\r\nWARC/1.0 is a word\r\n\r\n" * (i % 3)) if i % 5 else None) for i in range(2300)] + [(7, "u\r\nX: y", "again"), (None, "u", "no id"), (None, None, None)]
    first, second = f"{tmp_path}/a", f"{tmp_path}/b"
    warc_audit.write_archives(warc_audit.records(pages_of(spark, rows)), first, "none")
    warc_audit.write_archives(warc_audit.records(pages_of(spark, rows[::-1]).repartition(7)), second, "none")
    order = ["file", "seq"]
    stored = warc_audit.read_leaves(spark, first).orderBy(order).collect()
    assert stored == warc_audit.leaves(warc_audit.records(pages_of(spark, rows))).orderBy(order).select(list(stored[0].asDict())).collect()
    assert len(stored) == len(rows) and not any(r["torn"] for r in stored)
    data = {k: f.read_bytes() for k, f in archive_files(tmp_path / "a").items()}
    assert all(hashlib.sha256(data[r["file"]][r["at"] : r["at"] + r["length"]]).hexdigest() == r["digest"] for r in stored)
    look = lambda: warc_audit.audit(warc_audit.read_leaves(spark, first), warc_audit.read_leaves(spark, second)).collect()
    assert look() == []
    place = {(r["file"], r["id"]): (r["at"], r["length"]) for r in stored}
    files = archive_files(tmp_path / "b")

    def damage(number, change):
        raw = change(files[number].read_bytes())
        files[number].write_bytes(raw)
        (files[number].parent / f".{files[number].name}.crc").unlink(missing_ok=True)

    at, n = place[(0, 12)]
    damage(0, lambda d: d[: at + n - 6] + bytes([d[at + n - 6] ^ 1]) + d[at + n - 5 :])  # one bit of a payload
    at1, n1 = place[(1, 1503)]
    damage(1, lambda d: d[: at1 + n1 // 2] + d[at1 + n1 :])  # half a record is gone
    at2, n2 = place[(2, 2299)]
    damage(2, lambda d: d[: at2 + 9])  # the end of a file is gone
    got = look()
    faults = {(r["fault"], r["file"]): sorted(x["id"] for x in got if (x["fault"], x["file"]) == (r["fault"], r["file"]) and x["id"] is not None) for r in got}
    assert faults[("corrupt", 0)] == [12] and ("moved", 0) not in faults
    assert 1503 in faults[("missing", 1)] and len(faults[("missing", 1)]) <= 2 and [x["at"] is None for x in got if x["fault"] == "torn"] == [True, True]
    assert faults[("moved", 1)] == [i for i in range(1504, 2000) if i not in faults[("missing", 1)]]
    assert faults[("missing", 2)] == [2299] and ("moved", 2) not in faults


def test_compressed_archives():
    import gzip

    data = b"".join(bytes([i % 251]) * (i % 97) for i in range(3000))
    assert warc_audit.unpacked(gzip.compress(data)) == data == warc_audit.unpacked(data)
    assert warc_audit.unpacked(gzip.compress(data) + gzip.compress(b"more")) == data + b"more"
    part = warc_audit.unpacked(gzip.compress(data)[:-2000])
    assert data.startswith(part)


def test_record_layout(spark):
    rec = warc_audit.records(pages_of(spark, [(5, "http://a", "é")])).head()["record"].encode() + b"\r\n\r\n"
    assert rec == "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Target-URI: http://a\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\né\r\n\r\n".encode()
    leaf = replica(spark, [(5, "http://a", "é")]).head()
    assert leaf["digest"] == hashlib.sha256(rec).hexdigest() and leaf["length"] == len(rec) and leaf["at"] == 0
    assert second_copy(pages_of(spark, [(7, "u", "abc"), (11, "u", "abcd"), (1, "u", None)])).select("html").toPandas()["html"].tolist() == ["?bc", "ab", None]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], table(spark, SF, "documents")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        found = f(spark, docs, SF)
        found.write.parquet(path := f"{tmp_path_factory.mktemp('stage')}/{k}")
        before, docs = docs, spark.read.parquet(path)
        out.append((before, docs))
    return out


def test_stages_keep_columns_and_decide(spark, stages):
    names = table(spark, SF, "documents").columns
    assert all(after.columns == names for _, after in stages[:-1])
    counts = [stages[0][0].count()] + [after.count() for _, after in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1] > 0.6 * counts[0]
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    before, after = stages[1]
    assert after.select(lower("text")).distinct().count() == after.count() == before.select(lower("text")).distinct().count()
    ids = {r["doc_id"] for r in stages[3][1].collect()}
    assert {r["doc_id"] for r in stages[4][1].collect()} == ids


FOREIGN = [
    "Il vecchio mulino si trova ancora vicino al fiume, dove gli abitanti del paese andavano ogni settimana con il grano. Oggi nessuno lavora più in quel luogo, ma la gente ricorda bene le storie che raccontavano i nonni.",
    "Vanha mylly seisoo yhä joen rannalla, jonne kylän asukkaat veivät viljaa joka viikko. Nykyään siellä ei enää työskentele kukaan, mutta ihmiset muistavat hyvin tarinat, joita isovanhemmat kertoivat.",
    "Stary młyn nadal stoi nad rzeką, dokąd mieszkańcy wsi co tydzień wozili zboże. Dzisiaj nikt już tam nie pracuje, ale ludzie dobrze pamiętają historie, które opowiadali dziadkowie.",
]


def test_language_stage_rejects_planted_foreign_and_random_texts(spark):
    rng = random.Random(3)
    own = table(spark, SF, "documents")
    random_texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(5, 400))) for _ in range(100)]
    shuffled = [" ".join(" ".join(rng.sample(t.split(), len(t.split()))) for _ in range(8)) for t in FOREIGN]
    planted = {-1 - k: t for k, t in enumerate([*FOREIGN, *shuffled, *random_texts])}
    rows = spark.createDataFrame([(k, t) for k, t in planted.items()], "doc_id long, text string")
    docs = own.unionByName(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in own.dtypes]))
    kept = [r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).select("doc_id").collect()]
    through = [k for k in kept if k < 0]
    assert not [k for k in through if k >= -len(FOREIGN) - len(shuffled)] and len(through) <= 3
    assert len(kept) - len(through) > 0.985 * own.count()


def test_near_duplicates_of_the_stage_like_brute_force(stages):
    before, after = stages[2]
    rows = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"].lower())) for r in before.collect()]
    sets = {d: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for d, w in rows if w}
    by = {}
    for d, s in sets.items():
        for t in s:
            by.setdefault(t, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for o in {x for t in s for x in by[t] if x < d}:
            if 5 * len(s & sets[o]) >= 4 * len(s | sets[o]):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in after.collect()} == {d for d, _ in rows} - {d for d in sets if find(d) != d}


def test_mixed_stage_follows_its_rates(spark, stages):
    before, after = stages[3]
    from seqlab.llm.queries import MIX_WEIGHTS, labelled_domains

    rates = mixing.rates(before, labelled_domains(table(spark, SF, "labels")), MIX_WEIGHTS)
    want = {r["doc_id"] for r in rates.filter(mixing.chosen(F.col("doc_id"), F.col("rate"))).collect()}
    assert {r["doc_id"] for r in after.collect()} == want


def test_run_on_strange_documents(spark, tmp_path):
    words = "die der und das nicht mit ein ist für von".split()
    rows = [(None, None, None, None, 0), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the of and " * 60, "en", "s", 1), (3, "THE of and " * 60, None, "s", 1), (4, " ".join(words * 9), "de", None, 1), (5, "!!", "en", "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (4, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got["doc_id"]) <= {2, 4} and got.columns.tolist()[:4] == ["doc_id", "piece", "start", "length"]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
