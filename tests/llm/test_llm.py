"""The operators on small and awkward tables, against brute force."""
import base64
import collections
import functools
import glob
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, bpe, decontaminate, hmm, neardup, sharding, substring, toxicity, vbyte, warc, words
from tessella.llm.shared import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, n long, uid long, hash long"
rng = random.Random(4)
VOCAB = ["alpha", "beta", "Gamma", "delta", "é", "z.", "Ω-x", "1,2"]


def passage(n):
    return " ".join(rng.choice(VOCAB) + str(rng.randint(0, 300)) for _ in range(n))


@functools.cache
def awkward():
    shared, base = passage(60), passage(120)
    texts = [None, "", " \n\t", "one", "one two", "One two", base, base, base + " tail", base.replace("beta", "eta", 1), shared + " x", "y " + shared, "r s t " * 60, "w" * 5000, passage(4000), "<|endoftext|> a", "a  b \n c d "]
    return [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "k", "t", 1, 2, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words():
    import re

    import pyarrow as pa

    for table, pattern, lower in ((words.LOWER, rb"[^\x20\x09-\x0D]+", True), (words.EXACT, rb"[^\x20\x09-\x0D]+", False), (words.LETTERS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        texts = [r[1] for r in awkward()]
        data, off = words.texts(pa.array(texts))
        w = words.words_of(data, off, table)
        for i, t in enumerate(texts):
            b = (t or "").encode()
            want = [m.span() for m in re.finditer(pattern, b.lower() if lower else b)]
            assert want == list(zip(w.start[w.first[i]:w.first[i + 1]].tolist(), w.end[w.first[i]:w.first[i + 1]].tolist(), strict=True))


def test_hmm_likelihood_is_exact():
    import itertools
    import math

    r = np.random.default_rng(0)
    n = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(n(r.random(3)), n(r.random(3)), n(r.random((3, 3))), n(r.random((3, 7))).T)
    seqs = [r.integers(0, 7, k) for k in (4, 1, 6)]
    got = hmm.log10_likelihood(m, np.concatenate(seqs), np.array([4, 1, 6]))
    for q, x in zip(seqs, got, strict=True):
        total = sum(math.prod([m.start[p[0]], *(m.move[a, b] for a, b in itertools.pairwise(p)), *(m.emit[c, s] for c, s in zip(q, p, strict=True))]) for p in itertools.product(range(3), repeat=len(q)))
        assert x == pytest.approx(math.log10(total))


def test_hmm(docs, empty):
    rows = hmm.score(docs, iterations=2).collect()
    assert len(rows) == len(awkward()) and hmm.score(empty).count() == 0
    c = collections.Counter()
    body = {r[0]: (r[1] or "").encode().lower().split() + [None] for r in awkward()}
    for i, w in body.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = body[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert np.isfinite(r.score) and r.score < 0


def test_bpe_and_vbyte(spark, docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    want = {r[0]: lib.encode(r[1] or "", add_special_tokens=False).ids for r in awkward()}
    got = {r.doc_id: r for r in bpe.encode_decode(docs, with_ids=True).collect()}
    for r in awkward():
        assert list(got[r[0]].ids) == want[r[0]]
        assert got[r[0]].ids_sha256 == hashlib.sha256(np.array(want[r[0]], "<u4").tobytes()).hexdigest()
        assert got[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()
    assert bpe.encode_decode(empty).count() == 0
    v = bpe.vocabulary(bpe.default_vocabulary())
    for letters in ("ab", "thereinou", "aaaab"):
        w = "".join(rng.choices(letters, k=9000))
        assert np.concatenate(list(v.stream(w.encode()))).tolist() == lib.encode(w).ids
    for frame, n in ((docs, len(want)), (empty, 0)):
        path = scratch_path(spark, "test-ids")
        vbyte.write_ids(frame, path)
        rows = vbyte.read_ids(spark, path, with_ids=True).collect()
        assert len(rows) == n and all(list(r.ids) == [*want[r.doc_id], 0] for r in rows)
    x = np.array([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], np.uint32)
    assert vbyte.unpack(*vbyte.pack(x), len(x)).tolist() == x.tolist()


def parsed_warc(data):
    """Records of a WARC file by its grammar alone: version, named fields, a block of Content-Length bytes, two line ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *fields = data[at:end].decode().split("\r\n")
        assert version == "WARC/1.1"
        head = dict(f.split(": ", 1) for f in fields)
        at = end + 4 + int(head["Content-Length"])
        assert data[at:at + 4] == b"\r\n\r\n"
        yield head, data[end + 4:at]
        at += 4


def test_warc(spark):
    big = "x" * (3 * warc.CHUNK + 5)
    pages = [(1, "u", "a"), (2, None, "a"), (3, "u", None), (4, "u", ""), (5, "u\n", big), (6, "u", big), (6, "u", big), (None, "u", "b")]
    path = scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), path)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
    d = lambda s: (len(s or ""), base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode())
    want = [(0, *d("b"), "response", None), (1, *d("a"), "revisit", 2), (2, *d("a"), "response", None), (3, *d(""), "revisit", 4), (4, *d(""), "response", None),
            (5, *d(big), "revisit", 6), (6, *d(big), "response", None), (6, *d(big), "response", None)]
    assert got == sorted(want)
    assert max(r.n for r in spark.read.parquet(path).select(F.length("data").alias("n")).collect()) <= warc.CHUNK
    files = scratch_path(spark, "test-warc-files").removeprefix("file://")
    warc.export_files(spark, path, files)
    records = [r for f in glob.glob(f"{files}/part-*") for r in parsed_warc(open(f, "rb").read())]
    assert len(records) == len(pages)
    ids = {h["WARC-Record-ID"]: h for h, _ in records}
    assert len(ids) == len(pages) - 1  # a row and its repetition are one record, written twice
    for head, block in records:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= head.keys() and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["WARC-Date"])
        if head["WARC-Type"] == "response":
            http, _, payload = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK") and f"Content-Length: {len(payload)}".encode() in http
            assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            kept = ids[head["WARC-Refers-To"]]
            assert block == b"" and kept["WARC-Type"] == "response" and kept["WARC-Payload-Digest"] == head["WARC-Payload-Digest"]
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path + "e")
    assert warc.read_archives(spark, path + "e").count() == 0


def brute_groups(rows, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[q:q + 5]) for q in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("small", [1, 16])
def test_near_duplicates(spark, docs, empty, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = passage(150).split(" ")
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        near.append((100 + i, " ".join(w)))
    rows = [(r[0], r[1]) for r in awkward()] + near
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 85, 100).collect()}
    assert got == brute_groups(rows, 85, 100)
    if small == 1:
        assert neardup.near_duplicates(empty).count() == 0


def test_ann(spark, empty):
    r = np.random.default_rng(2)
    v = r.normal(size=(1500, 16)) * r.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0])]
    got = collections.defaultdict(list)
    for x in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
    s = v @ v[::20].T
    hit = sum(len(set(got[q]) & set([int(i) for i in np.argsort(-s[:, k], kind="stable") if i != q][:20])) for k, q in enumerate(range(0, 1500, 20)))
    assert set(got) == set(range(0, 1500, 20)) and all(len(x) == 20 for x in got.values()) and hit / (75 * 20) >= 0.9
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_toxicity(spark, docs, empty):
    rows = []
    for i in range(400):
        w = passage(40).split(" ")
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(w), int(toxic)))
    f = spark.createDataFrame(rows, "doc_id long, text string, label int")
    m = toxicity.train(f.where("doc_id < 300"))
    got = toxicity.score_texts(f.where("doc_id >= 300"), m).collect()
    assert sum(r.predicted == rows[r.doc_id][2] for r in got) >= 97
    assert all(0 <= r.score <= 1 for r in toxicity.score_texts(docs, m).collect())
    assert toxicity.score_texts(empty, m).count() == 0
    shown = collections.defaultdict(list)
    for r in toxicity.passages(f.where("label = 1"), m, e_value=0.02).collect():
        assert rows[r.doc_id][1].encode()[r.begin:r.end].decode() == r.passage and r.e_value <= 0.02
        shown[r.doc_id] += r.passage.split()
    assert sum(bool({"vile", "nasty"} & set(shown[i])) for i, _, y in rows if y) >= 95
    assert toxicity.score_texts(f.limit(1), toxicity.train(f.where("false"))).first().predicted == 0
    labels = f.select("doc_id", F.col("label").alias("toxic"))
    may = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert toxicity.labelled_documents(f, labels.unionAll(labels)).count() == len(may)
    assert 40 <= toxicity.labelled_documents(f, labels, most=80).count() <= 130


def test_segments():
    for _ in range(100):
        s = np.array([rng.choice([-3, -2, -1, 1.5, 2.25]) + rng.random() / 7 for _ in range(12)])

        def best(lo, hi):
            top = max(((s[i:j].sum(), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
            return [] if top[0] <= 0 else [*best(lo, top[2]), (top[2], top[3]), *best(top[3], hi)]

        assert [(b, e) for b, e, _ in toxicity.segments(s)] == best(0, 12)


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    n = collections.Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and len(rows) == len(awkward())
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    assert sharding.shard(empty, 4).count() == 0


def test_decontaminate(spark, docs, empty):
    import re

    item = (awkward()[10][1]).split(" ")
    items = [("b1", " ".join(item[5:40])), ("b2", "One two"), ("b3", None), ("b4", "")]
    got = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    for r in awkward():
        w, hit, names = split(r[1]), set(), set()
        for name, t in items:
            x = split(t)
            k = min(13, len(x))
            for p in range(len(x) - k + 1) if k else ():
                for q in range(len(w) - k + 1):
                    if w[q:q + k] == x[p:p + k]:
                        hit |= set(range(q, q + k))
                        names.add(name)
        assert (got[r[0]].n_words, got[r[0]].n_hit, got[r[0]].item_list) == (len(w), len(hit), ",".join(sorted(names)))
    assert decontaminate.contamination(empty, spark.createDataFrame(items, "item_id string, text string")).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_substring(spark, empty, parts):
    rows = [(r[0], r[1]) for r in awkward()] + [(50 + i, passage(10) + " " + awkward_shared + " " + passage(5)) for i, awkward_shared in enumerate([passage(30)] * 6)]
    got = {r.doc_id: r for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), with_text=True).collect()}
    first = {}
    for i, t in rows:
        w, gone = (t or "").encode().split(), set()
        for q in range(len(w) - 19):
            if first.setdefault(tuple(w[q:q + 20]), (i, q)) != (i, q):
                gone |= set(range(q, q + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert got[i].kept_text == (kept.decode() if gone else t or "")
    if parts == 1:
        assert substring.deduplicate(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and 0 < out.count() <= 200
