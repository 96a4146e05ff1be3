"""Corpus operators on words that collide, texts beyond the blocks, null keys, repeated rows, clashing columns and empty side tables, against brute force."""
import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import ann, bpe, decontaminate, exchange, hmm, neardup, sharding, substring, toxicity, vbyte, warc, words
from tessella.llm.shared import scratch_path

rng = random.Random(11)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def morse(n, flip=False):
    """Letters of the Thue-Morse sequence: polynomial hashes modulo powers of two hold it equal to its complement."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def prose(n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(parts)


def test_different_words_have_different_identities():
    texts = [morse(1024), morse(1024, True), morse(16), morse(16, True), "a" * 15, "a" * 16, "a\x00", "a", "ab", "ba"]
    w = words.words_of(*words.texts(pa.array(texts)), words.EXACT, identity=True)
    assert len(set(zip(w.low.tolist(), w.high.tolist(), strict=True))) == len(texts) == len(set(w.hash.tolist()))


@pytest.mark.parametrize("block", [8, 16, 33])
def test_words_across_blocks(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    for _ in range(300):
        texts = ["".join(rng.choice(["a", "B", " ", "\n", "é", "中", "long" * 5]) for _ in range(rng.randint(0, 25))) for _ in range(4)]
        w = words.words_of(*words.texts(pa.array(texts)), words.EXACT)
        for i, t in enumerate(texts):
            b = t.encode()
            assert [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] == list(zip(w.start[w.first[i]:w.first[i + 1]].tolist(), w.end[w.first[i]:w.first[i + 1]].tolist(), strict=True))


def test_colliding_words_are_told_apart(spark):
    common = " ".join(f"x{i}" for i in range(19))
    rows = [(1, f"{common} {morse(1024)}"), (2, f"{common} {morse(1024, True)}"), (3, f"{common} {morse(1024)}")]
    cut = {r.doc_id: r.n_removed for r in substring.deduplicate(frame(spark, rows)).collect()}
    assert cut == {1: 0, 2: 0, 3: 20}
    items = spark.createDataFrame([("i", morse(1024))], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(frame(spark, rows), items).collect()} == {1: 1, 2: 0, 3: 1}


def brute_windows(rows, n=20):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w, gone = (t or "").encode().split(), set()
        for q in range(len(w) - n + 1):
            if first.setdefault(tuple(w[q:q + n]), (i, q)) != (i, q):
                gone |= set(range(q, q + n))
        out[i] = (len(w), len(gone))
    return out


@pytest.mark.parametrize("hot,most", [(0, 10), (2, 60_000), (4000, 7)])
def test_substring_groups(spark, monkeypatch, hot, most):
    """Hot prefixes go by whole windows, large groups are split: the same words go."""
    monkeypatch.setattr(substring, "SUFFIXES", most)
    monkeypatch.setattr(exchange, "tasks_for", lambda *a: 10**9)
    shared = [prose(45, 9) for _ in range(4)]
    rows = [(i, f"{prose(rng.randint(0, 30))} {rng.choice(shared)} {prose(5)}" + (" r s" * 40 if i % 7 == 0 else "")) for i in range(60)] + [(99, None), (100, "")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.deduplicate(frame(spark, [*rows, rows[3], (None, rows[3][1])], 5), hot=hot).where("doc_id is not null").collect()}
    assert got == brute_windows(rows)


def test_subtree_nodes_are_the_repeats():
    """Deep nodes of a group's subtree against all windows, and maximal repeats as chains of them."""
    text = [prose(60, 6) for _ in range(5)]
    text[3] = text[0][:150] + " " + text[3]
    w = words.words_of(*words.texts(pa.array(text)), words.EXACT)
    n = np.maximum(w.counts - 8 + 1, 0)
    # every suffix of eight words and more, with no words to its left
    begin = np.concatenate([np.arange(k) + f for k, f in zip(n.tolist(), w.first[:-1].tolist(), strict=True)])
    doc = np.repeat(np.arange(5), n)
    x = np.zeros(len(begin), substring._LEAF)
    x["doc"], x["at"], x["n"] = doc, begin - w.first[doc], 1
    parts = [" ".join(text[d].split()[a:a + 8]) for d, a in zip(x["doc"].tolist(), x["at"].tolist(), strict=True)]
    d, at = substring.repeated_windows(x, words.words_of(*words.texts(pa.array(parts)), words.EXACT, identity=True), 8)
    seen, want = set(), set()
    for i, t in enumerate(text):
        t = t.split()
        for q in range(len(t) - 7):
            key = tuple(t[q:q + 8])
            if key in seen:
                want.add((i, q))
            seen.add(key)
    assert set(zip(d.tolist(), at.tolist(), strict=True)) == want


def test_long_texts(spark):
    """Beyond the blocks of words (256 KB) and of encoders (4 MB), and one word of 300 KB."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {1: prose(60_000), 2: "中文" * 20_000 + prose(20), 3: morse(300_000), 4: prose(100), 5: (prose(1000) + "\n") * 1100}
    assert len(texts[5]) > 2 * bpe.STRETCH
    df = frame(spark, texts.items())
    got = {r.doc_id: r for r in bpe.encode_decode(df).collect()}
    for i, t in texts.items():
        ids = np.array(lib.encode(t, add_special_tokens=False).ids, "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    short = {i: t for i, t in texts.items() if i != 5}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring.deduplicate(frame(spark, short.items())).collect()} == brute_windows(list(short.items()))
    n = {r.doc_id: r.n_tokens for r in hmm.score(frame(spark, short.items()), iterations=1).collect()}
    assert n == {i: len(t.split()) + 1 for i, t in short.items()}


@pytest.mark.parametrize("stretch", [64, 1 << 22])
def test_transducer_in_blocks(monkeypatch, stretch):
    """Encoded in blocks of any size, each row comes out once and in order."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "STRETCH", stretch)
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    pieces = ["a", "th", " ", "  ", "\n", "é", "中", "\xa0", " ", "'s", "12", "!?", "<|endoftext|>", "<|endo", "word", "᠎", "\x85", "Ж"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 80))) for _ in range(150)] + ["", None, "x " * 300, "y" * 500]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([None if t is None else t.encode() for t in texts], pa.binary())], ["k", "t"])
    rows = [r for b in bpe._round_trip(bpe.default_vocabulary(), True)([batch]) for r in b.to_pylist()]
    assert [r["_key"] for r in rows] == list(range(len(texts)))
    for r, t in zip(rows, texts, strict=True):
        assert r["ids"] == lib.encode(t or "", add_special_tokens=False).ids and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_pairs_that_are_no_merge_find_no_merge():
    """A pair that isn't in the table has no rank, however long the run of filled slots in which its search begins."""
    v = bpe.vocabulary(bpe.default_vocabulary())
    keys = np.arange(3_000_000, dtype=np.int64)
    keys = keys[~np.isin(keys, v.keys)]
    assert (v.rank[v._find(keys)] == 1 << 30).all()


def test_letters_of_all_versions_of_unicode():
    """What is a letter or a number is what the library says, not what another version of Unicode says."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    for lo in (*range(0, 0x3000, 4096), 0xA000, 0x10000, 0x1D000, 0x32000):
        text = "\n".join(f"a{c}'s1{c} !{c}re" for c in map(chr, range(lo, lo + 4096)) if not "\ud800" <= c <= "\udfff")
        assert [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)] == list(bpe.pieces(text))


@pytest.mark.parametrize("library", [True, False])
def test_vbyte_files_are_in_order(spark, library):
    rows = [(i * 7 % 101, prose(rng.randint(0, 30))) for i in range(101)] + [(5, "again"), (None, "no key"), (200, None)]
    path = scratch_path(spark, "order")
    vbyte.write_ids(frame(spark, rows, 7), path, library=library)
    got = vbyte.read_ids(spark, path, with_ids=True).orderBy("start").collect()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    files = spark.read.parquet(f"{path}/ids").orderBy("part", "row").select(F.coalesce("doc_id", F.lit(-1)).alias("k")).collect()
    assert [r.k for r in files] == keys


def test_vbyte_takes_many_documents_at_once(spark, monkeypatch):
    """Short texts for the library, whose time for a word grows with the text; packing by batches, in parts of any size, as document by document."""
    from tokenizers import Tokenizer

    r = np.random.default_rng(3)
    n = np.array([0, 1, 2, 3, 4, 5, 0, 9, 700])
    x = r.integers(0, 2**32, int(n.sum()), dtype=np.uint64).astype(np.uint32) >> r.integers(0, 32, int(n.sum())).astype(np.uint32)
    control, first, data, begin = vbyte._pack(x, n)
    parts = np.split(x, np.cumsum(n)[:-1])
    assert [(control[a:b].tobytes(), data[c:d].tobytes()) for a, b, c, d in zip(first[:-1], first[1:], begin[:-1], begin[1:])] == [vbyte.pack(y) for y in parts]
    assert vbyte._unpack(control, data, n).tolist() == x.tolist()

    lib, asked = Tokenizer.from_file(bpe.default_vocabulary()), []
    own = [f"{prose(300)}{i} x{i}é z{i}\u3000 {'q' * (i % 7)}\n {i}<|endoftext|>  it's{i}" for i in range(60)] + ["", "a" * 3000 + " b", " "]
    encoder = vbyte._Encoder(bpe.default_vocabulary())
    take = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda words: asked.extend(map(len, words)) or take(words))
    raw = [t.encode() for t in own]
    got = [ids[a:b].tolist() for _, _, ids, begins in encoder.encode(np.frombuffer(b"??" + b"".join(raw), np.uint8), 2 + np.concatenate([[0], np.cumsum([len(t) for t in raw])])) for a, b in zip(begins[:-1], begins[1:])]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in own]
    assert sorted(asked)[-2] < 1000  # but for the one long word

    batch = pa.record_batch([pa.array([i] * 4) for i in range(4)] + [pa.array([3, 1, 40, 2]), pa.array([np.array(y, t).tobytes() for y, t in (([1, 2, 70_000], np.uint32), ([5], np.uint16), (range(40), np.uint16), ([5, 1], np.uint16))], pa.binary())], ["part", "row", "begin", "doc_id", "n_tokens", "ids"])
    want = {i: sum(y.count(i) for y in ([1, 2, 70_000], [5], list(range(40)), [5, 1])) for i in [*range(40), 70_000]}
    for most in (1, 5, 1000):
        monkeypatch.setattr(vbyte, "NUMBERS", most)
        (counts,) = vbyte._counts(iter([batch]))
        assert dict(zip(counts[0].to_pylist(), counts[1].to_pylist())) == want
        written = list(vbyte._writer(np.arange(70_001, dtype=np.uint32))(iter([batch])))
        read = [y for z in written for out in vbyte._reader(np.arange(70_001, dtype=np.uint32), True)(iter([z])) for y in out.column(6).to_pylist()]
        assert read == [[1, 2, 70_000], [5], list(range(40)), [5, 1]]


def test_expected_counts_and_em(spark):
    """Expected counts against all paths; the likelihood never falls; scores against an own computation."""
    import itertools

    r = np.random.default_rng(1)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(r.random(2)), norm(r.random(2)), norm(r.random((2, 2))), norm(r.random((2, 5))).T)
    seqs, first = [r.integers(0, 5, k) for k in (4, 1, 3)], np.array([True, False, True])
    s0, s1, move, emit, ll = hmm.expected(m, np.concatenate(seqs), np.array([4, 1, 3]), first)
    w0, w1, wm, we, wl = np.zeros(2), np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2)), 0.0
    for q, f in zip(seqs, first, strict=True):
        paths = list(itertools.product(range(2), repeat=len(q)))
        ps = np.array([(m.start if f else m.later)[p[0]] * math.prod(m.move[a, b] for a, b in itertools.pairwise(p)) * math.prod(m.emit[c, s] for c, s in zip(q, p, strict=True)) for p in paths])
        wl += math.log10(ps.sum())
        for p, x in zip(paths, ps / ps.sum(), strict=True):
            (w0 if f else w1)[p[0]] += x
            for a, b in itertools.pairwise(p):
                wm[a, b] += x
            for c, s in zip(q, p, strict=True):
                we[c, s] += x
    for a, b in ((s0, w0), (s1, w1), (move, wm), (emit, we), (ll, wl)):
        assert np.allclose(a, b)
    rows = [(i, " ".join(rng.choice(["the cat", "a dog", "runs fast", "sits"]) for _ in range(rng.randint(1, 12)))) for i in range(80)]
    total = []
    for n in range(4):
        total.append(sum(x.score for x in hmm.score(frame(spark, rows), states=3, iterations=n).collect() if not x.held_out))
    # The pull to the words' own frequencies is a prior: the first steps may not lose more than it weighs.
    assert total[-1] > total[0] - 1e-6 and all(b > a - 0.05 * abs(a) for a, b in zip(total, total[1:], strict=False))


def test_hmm_scores_null_keys_and_repeats(spark):
    rows = [(1, "a b a"), (1, "a b a"), (None, "a c"), (None, None), (7, "zz yy"), (3, "")]
    got = hmm.score(frame(spark, rows), iterations=1).collect()
    assert len(got) == 6 and sorted(x.n_tokens for x in got) == [1, 1, 3, 3, 4, 4]
    c = collections.Counter(w for i, t in rows for w in [*(t or "").split(), None] if i is None or zlib.crc32(str(i).encode()) % 5 != 1)
    n, v = sum(c.values()), len(c)
    for x in got:
        assert x.train_tokens == n
        t = {(3, 4): "a b a"}.get((3, x.n_tokens))
        if t and x.doc_id == 1:
            assert x.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), None]))


def test_proximity(spark):
    docs = frame(spark, [(1, "a b x c d"), (2, "a b c d"), (3, "b a c d"), (4, "a b"), (5, "c d")], 1)
    items = spark.createDataFrame([("i", "a b c d")], "item_id string, text string")
    index = decontaminate.build_index(docs)
    ids = {r.segment: np.frombuffer(r.ids, np.int64) for r in index.collect()}
    found = lambda slack: sorted(int(ids[r.segment][r.nth]) for r in decontaminate.search(index, items, slack=slack).collect())
    assert found(0) == [2] and found(1) == [1, 2] and found(2) == [1, 2, 3]


def test_items_in_blocks(spark, monkeypatch):
    rows = [(i, prose(60, 30)) for i in range(12)]
    items = [(f"i{k}", " ".join(rows[k][1].split()[5:25])) for k in range(8)] + [("short", "w3 w4"), ("null", None)]
    one = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id string, text string")).collect()
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 20)
    many = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and sum(r.n_items for r in one) >= 8


def test_sharding_keeps_the_mixture(spark):
    rows = [(i if i % 9 else None, prose(i % 5), "en", ["big", "big", "big", "mid", None][i % 5] if i < 290 else "rare", 1) for i in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS).repartition(4), 7).collect()
    assert len(got) == 300 and sorted(r.size for r in got) == sorted(len((t or "").encode()) + 16 for _, t, *_ in rows)
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in rows)
    by = {r[0]: r[3] for r in rows if r[0] is not None}
    for source in ("big", "mid"):
        n = collections.Counter(r.shard for r in got if r.doc_id is not None and by[r.doc_id] == source)
        known = sum(1 for i, _, _, s, _ in rows if s == source and i is not None)
        assert all(abs(n[s] - known / 7) <= 8 for s in range(7))
    whole = spark.createDataFrame([(i, "x", "en", f"s{i % 4}", 1) for i in range(400)], DOCS)
    counts = collections.Counter((r.shard, r.doc_id % 4) for r in sharding.shard(whole, 10).collect())
    assert all(abs(counts[s, k] - 10) <= 1 for s in range(10) for k in range(4))
    order = lambda seed: [(r.doc_id, r.shard, r.slot) for r in sharding.shard(whole, 10, seed).orderBy("doc_id").collect()]
    assert order(1) == order(1) != order(2)


def test_ann_ties_repeats_and_hot_vectors(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(600, 8))
    v[100:400] = v[100]  # a third and more of all rows are one vector
    rows = [(i, x.tolist(), "extra") for i, x in enumerate(v)] + [(3, v[3].tolist(), "again"), (None, v[4].tolist(), "no id")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string").repartition(4)
    want = {}
    for q in range(0, 600, 20):
        s = v @ v[q]
        order = [int(i) for i in np.lexsort((np.arange(600), -np.round(s, 12))) if i != q][:20]
        want[q] = order
    for recall in (1.0, 0.97):
        got = {}
        for x in ann.search(df, F.col("vec_id") % 20 == 0, recall=recall).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.vec_id)
        if recall == 1.0:
            assert got == want
        else:
            assert sum(len(set(got[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9


def test_ann_prunes(spark, monkeypatch):
    """With clustered vectors lists are left out, and recall is held."""
    monkeypatch.setattr(ann, "PER_LIST", 50)
    r = np.random.default_rng(8)
    centre = r.normal(size=(60, 32))
    v = centre[r.integers(0, 60, 6000)] + 0.25 * r.normal(size=(6000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    taken = []
    route = ann._route
    monkeypatch.setattr(ann, "_route", lambda c, dim, ratio, block, parts: (taken.append((c, ratio)), route(c, dim, ratio, block, parts))[1])
    got = {}
    for x in ann.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hit = 0
    for q in got:
        s = v @ v[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    c, ratio = taken[0]
    share = np.mean([(np.sqrt(((c.at - q) ** 2).sum(axis=1)) <= ratio * np.sort(np.sqrt(((c.at - q) ** 2).sum(axis=1)))[1]).mean() for q in c.lifted(v[::200], True)])
    assert hit / (20 * len(got)) >= 0.95 and len(c.at) == 120 and share < 0.4


def test_extreme_value_law():
    """K and lambda against simulated scores, and held_out of the query."""
    r = np.random.default_rng(3)
    p = np.array([0.05, 0.15])
    score = np.array([2.0, 1.0])
    lam = toxicity._lambda(score, p)
    assert (p * np.exp(lam * score)).sum() + 0.8 * np.exp(lam * toxicity.DRIFT) == pytest.approx(1) or lam == 1.0
    score, p = np.array([3.0, 1.0]), np.array([0.01, 0.03])
    lam = toxicity._lambda(score, p)
    assert (p * np.exp(lam * score)).sum() + 0.96 * np.exp(lam * toxicity.DRIFT) == pytest.approx(1)
    n = 400
    best = []
    for _ in range(1500):
        u = r.random(n)
        s = np.where(u < 0.01, 3.0, np.where(u < 0.04, 1.0, toxicity.DRIFT))
        best.append(max((x[2] for x in toxicity.segments(s)), default=0.0))
    best = np.array(best)
    k = toxicity.best_k(len(best), float((n * np.exp(-lam * best)).sum()))
    for x in (6.0, 8.0, 10.0):
        law, seen = 1 - math.exp(-k * n * math.exp(-lam * x)), float((best > x).mean())
        assert abs(law - seen) < 0.5 * max(law, seen) + 0.01
    m = toxicity.Model(np.empty(0, np.uint64), np.empty(0), 1.0, 1.0)
    assert m.value([], 10) == toxicity.LOW and m.value([30.0, 29.0], 10) > m.value([30.0], 10) > m.value([12.0], 10)


def test_toxicity_tables(spark):
    docs = frame(spark, [(1, "good text"), (2, "vile text"), (None, "vile"), (2, "vile text"), (4, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert toxicity.labelled_documents(docs, none).count() == 0
    m = toxicity.train(toxicity.labelled_documents(docs, none))
    assert [r.predicted for r in toxicity.score_texts(docs, m).collect()] == [0] * 5
    clash = spark.createDataFrame([(1, 0, "x"), (2, 1, "y")], "doc_id long, toxic int, text string")
    assert {r.text for r in toxicity.labelled_documents(docs, clash).collect()} <= {"good text", "vile text"}


def test_the_share_of_hit_words_is_exact(spark):
    """One word of 20 is enough, one of 21 isn't; 3 of 10 are, where doubles would say 3 < 10 * 0.3."""
    words = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, " ".join(words.split()[:19]) + " hit"), (2, " ".join(words.split()[:20]) + " hit"), (3, "hit hit hit a b c d e f g"), (4, "hit hit a b c d e f g h")])
    item = spark.createDataFrame([("i", "hit")], "item_id string, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, item).collect()} == {1: True, 2: False, 3: True, 4: True}
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, item, num=3, den=10).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_warc_records_that_fit_are_one_row(spark):
    """Small records are read where they lie; only those of several rows are shuffled. A torn or altered one of either kind is found."""
    head = len(warc._head(100, "u", "A" * 32, 100, None, "2020-01-01T00:00:00Z"))
    texts = {100 + i: c * n for i, (c, n) in enumerate([("a", 800 - head - 5), ("b", 800 - head - 4), ("c", 800 - head - 3), ("d", 2000), ("e", 100), ("é", 100), ("\r\n", 100), ("g\r\n\r\n", 60)])} | {200: "e" * 100, 201: "d" * 2000, 202: "", 203: None}
    path = scratch_path(spark, "rows")
    warc.write_archives(spark.createDataFrame([(i, "u", t) for i, t in texts.items()], "page_id long, url string, html string"), path, chunk=800)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    raw = {i: (t or "").encode() for i, t in texts.items()}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {i: (len(t), base64.b32encode(hashlib.sha1(t).digest()).decode()) for i, t in raw.items()}
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {104: 200, 103: 201, 202: 203}
    rows = spark.read.parquet(path)
    table = rows.toPandas()
    assert table.groupby(["record_id", "copy"]).size().eq(1).sum() == len(texts) - 2 and table.data.map(len).max() <= 800
    for change in ("substring(data, 1, length(data) - 5)", "encode(replace(decode(data, 'utf-8'), 'aaa', 'aab'), 'utf-8')", "encode(replace(decode(data, 'utf-8'), 'ddd', 'dde'), 'utf-8')", "encode(replace(decode(data, 'utf-8'), 'WARC/1.1', 'WARC/9.1'), 'utf-8')"):
        bad = scratch_path(spark, "bad")
        rows.withColumn("data", F.expr(change)).write.parquet(bad)
        with pytest.raises(Exception, match="record "):
            warc.read_archives(spark, bad).collect()


def test_empty_side_tables_and_clashing_columns(spark):
    docs = frame(spark, [(1, "a b c"), (None, "a"), (1, "a b c")])
    none = spark.createDataFrame([], "item_id string, text string, doc_id long")
    assert sorted(r.n_hit for r in decontaminate.contamination(docs, none).collect()) == [0, 0, 0]
    item = spark.createDataFrame([("i", "b", 9)], "item_id string, text string, doc_id long")
    assert sorted(r.n_hit for r in decontaminate.contamination(docs, item).collect()) == [0, 1, 1]
    pages = spark.createDataFrame([(1, "u", "x", "s", "p"), (2, "u", "x", "t", "q")], "page_id long, url string, html string, sha string, payload string")
    path = scratch_path(spark, "clash")
    warc.write_archives(pages, path)
    assert sorted((r.page_id, r.record_type) for r in warc.read_archives(spark, path).collect()) == [(1, "revisit"), (2, "response")]
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, 2, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True)]


def test_scratch_folder_must_be_shared():
    from types import SimpleNamespace

    from tessella.llm import shared

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *a: None), master="yarn"))
    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(spark)


# --- the pipeline's stages, each against brute force on its own input ------------------------------------------------
def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def stage_docs(spark):
    base = prose(150)
    near = base.split()
    near[70] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, prose(80)), (5, None), (6, ""), (7, prose(30) + " " + " ".join(base.split()[:60])), (8, "w1 w2 w3"), (9, prose(300)), (9, None)]
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "clash") for i, t in rows[:-1]], DOCS + ", component_id string").repartition(3)


def test_stage_near_copies(spark, stage_docs):
    got = stage("minhash_near_dedup")(spark, stage_docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    from test_llm import brute_groups

    groups = brute_groups([(r.doc_id, r.text) for r in stage_docs.collect()], 80, 100)
    assert {r.doc_id for r in got.collect()} == {i for i, (_, c) in groups.items() if i == c}


def test_stage_passages(spark, stage_docs):
    got = {r.doc_id: r.text for r in stage("substring_dedup")(spark, stage_docs, "").collect()}
    rows = [(r.doc_id, r.text) for r in stage_docs.collect()]
    left = brute_windows(rows)
    for i, t in rows:
        n, gone = left[i]
        if gone and gone == n:
            assert i not in got
        else:
            assert got[i] == t if not gone else len(got[i].split()) == n - gone


def test_stage_benchmark(spark, stage_docs, tmp_path):
    text = stage_docs.where("doc_id = 9").first().text
    spark.createDataFrame([("i", " ".join(text.split()[10:40]), 3)], "item_id string, text string, doc_id long").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in stage("benchmark_decontamination")(spark, stage_docs, str(tmp_path)).collect()}
    assert got == {1, 2, 3, 4, 5, 6, 7, 8}


def test_stage_toxicity(spark, tmp_path):
    rows = []
    for i in range(400):
        w = prose(40).split()
        if i % 4 == 0:
            w[5:7] = ["vile", "nasty"]
        rows.append((i, " ".join(w)))
    spark.createDataFrame([(i, int(i % 4 == 0), "x") for i, _ in rows if i % 3], "doc_id long, toxic int, text string").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id for r in stage("toxicity")(spark, frame(spark, [*rows, (1000, None), (1001, "")]), str(tmp_path)).collect()}
    assert {1000, 1001} <= got and len(got & {i for i, _ in rows if i % 4}) >= 297 and len(got & {i for i, _ in rows if i % 4 == 0}) <= 3


def test_stage_tokens(spark, stage_docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r.doc_id: list(r.ids) for r in stage("bpe_encode_decode")(spark, stage_docs, "").collect()}
    assert got == {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids for r in stage_docs.collect()}


def test_stages_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0
