"""Queries do the whole job on small tables, held against plain Python."""
import re
from collections import defaultdict

import numpy as np

from tessella import registry
from tessella.operators import retrieval as R

IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_.'!?₀-₉¹²³]*")


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_resolve_suffix_knows_names_of_all_rows(spark, tmp_path):
    docs = [(0, "alpha beta"), (49, "alpha"), (50, "gamma alpha"), (5000, "late cold.bolt bolt")]
    parts = [(1, "cold bolt"), (2, "cold nut"), (3, "warm bolt"), (4, "50 gamma"), (5, "97 gamma")]
    table(spark, tmp_path, "documents", docs, "doc_id long, text string")
    table(spark, tmp_path, "part", parts, "p_partkey long, p_name string")
    full = {n.replace(" ", ".") for _, n in parts}
    last = defaultdict(set)
    for n in full:
        last[n.rsplit(".", 1)[-1]].add(n)
    for i, t in docs:
        for w in IDENT.findall(t):
            last[w].add(f"{i % 97}.{w}")
    want = {w: 1 if w in full else len(last[w]) for _, t in docs for w in IDENT.findall(t)}
    got = {r.word: r.n for r in registry.queries()["resolve_suffix"](spark, str(tmp_path)).collect()}
    assert got == want and want["late"] == 1 and want["cold.bolt"] == 1 and want["bolt"] == 3 and want["gamma"] == 2


def test_dense_queries_are_every_hundredth_row_against_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "DOC_ROWS", 300)
    monkeypatch.setattr(R, "QUERY_ROWS", 4)
    x = np.random.default_rng(5).normal(size=(1200, 64)).astype(np.float32)
    table(spark, tmp_path, "embeddings", [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float64)
    got = defaultdict(dict)
    for name in ("sv_topk", "li_exact", "maxsim_weighted", "li_recall"):
        for r in registry.queries()[name](spark, str(tmp_path)).collect():
            got[name].setdefault(r.qid, []).append(r)
    dot = {q: x @ x[q] for q in range(0, 1200, 100)}
    assert {q: [r.doc_id for r in sorted(rows, key=lambda r: r.rank)] for q, rows in got["sv_topk"].items()} == {q: np.argsort(-s, kind="stable")[:10].tolist() for q, s in dot.items()}
    assert 0 in {r.doc_id for r in got["sv_topk"][0]}
    first = np.array([i * i for i in range(35)])
    for name, double in (("li_exact", 1), ("maxsim_weighted", 2)):
        for qid in range(3):
            s = sum((double if q % 500 == 0 else 1) * np.maximum.reduceat(dot[q], first) for q in dot if q // 500 == qid)
            want = np.argsort(-s, kind="stable")[:10].tolist()
            assert [r.doc_id for r in sorted(got[name][qid], key=lambda r: r.rank)] == want
    assert sorted(got["li_recall"]) == [0, 1, 2] and all(r[0].n_exact == 10 for r in got["li_recall"].values())


def test_prompt_blocks_hold_whole_statements(spark, tmp_path):
    docs = {i: "theorem " * (9 - i) + "and much more text that goes on after it " * 5 + f"end {i}" for i in range(8)}
    table(spark, tmp_path, "documents", list(docs.items()), "doc_id long, text string")
    table(spark, tmp_path, "benchmark", [(7, "theorem")], "item_id long, text string")
    best = [r.doc_id for r in registry.queries()["bm25_topk"](spark, str(tmp_path)).orderBy("rank").collect()][:6]
    want = "\n\n".join(f"ID:{i}\nFormal name: doc.{x}\nInformal name: \nFormal statement: {docs[x]}" for i, x in enumerate(best))
    assert [(r.item_id, r.prompt) for r in registry.queries()["prompt_blocks"](spark, str(tmp_path)).collect()] == [(7, want)]


def test_identifier_counts_keep_rare_identifiers(spark, tmp_path):
    docs = [(0, "rare common common"), (1, "common 7 also.rare"), (2, "common " * 60)]
    table(spark, tmp_path, "documents", docs, "doc_id long, text string")
    got = {r.word: (r.n, r.docs) for r in registry.queries()["identifier_counts"](spark, str(tmp_path)).collect()}
    assert got == {"rare": (1, 1), "also.rare": (1, 1), "common": (63, 3)}


def test_contamination_finds_items_of_few_tokens(spark, tmp_path):
    docs = [(1, "one two three four"), (2, "twofold three"), (3, "none"), (4, None), (5, "one two, three")]
    items = [(1, "two"), (2, "two three"), (3, "one two three"), (4, ""), (5, " "), (6, "absent"), (7, None), (8, "two,")]
    table(spark, tmp_path, "documents", docs, "doc_id long, text string")
    table(spark, tmp_path, "benchmark", items, "item_id long, text string")
    want = sorted((d, i) for d, t in docs for i, x in items if t is not None and x is not None and x in t)
    assert sorted(map(tuple, registry.queries()["contamination_verbatim"](spark, str(tmp_path)).collect())) == want
