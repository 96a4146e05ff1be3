"""The queries on the driver's tables, each beside the SQL that says what it returns."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import retrieval as R
from ..operators import bm25, dense, retrievers, runs, search
from ..registry import query
from ..sources import scratch
from ..streaming import log


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TOKEN = r"[A-Za-z0-9_'']+|[^\sA-Za-z0-9_'']"
IDENT = "[A-Za-z_][A-Za-z0-9_.''!?₀-₉¹²³]*"

# --- text -------------------------------------------------------------------------------------------------------------


@query("tokenize_counts", f"SELECT doc_id, CAST(len(t) AS BIGINT) n, CAST(len(list_distinct(t)) AS BIGINT) n_distinct FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') t FROM documents)")
def tokenize_counts(spark, d):
    t = text.tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("identifier_counts", f"SELECT word, count(*) n, count(DISTINCT doc_id) docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{IDENT}')) word FROM documents) GROUP BY word")
def identifier_counts(spark, d):
    w = _t(spark, d, "documents").select("doc_id", F.explode(text.identifiers(F.col("text"))).alias("word"))
    # Two levels, so that distinct documents are counted without a shuffle of every occurrence.
    return w.groupBy("word", "doc_id").agg(F.count("*").alias("c")).groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


_STATS = f"""
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) term FROM documents),
tf AS (SELECT term, doc_id, count(*) tf FROM p GROUP BY ALL), l AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOKEN}')) AS DOUBLE) len FROM documents),
n AS (SELECT count(*) n, avg(len) a FROM l), df AS (SELECT term, count(*) df FROM tf GROUP BY term)"""


@query("term_stats", f"WITH {_STATS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) idf FROM df, n")
def term_stats(spark, d):
    return R.bm25_index(_t(spark, d, "documents"))["terms"].select("term", "df", F.round("idf", 6).alias("idf"))


@query("doc_norms", f"WITH {_STATS} SELECT doc_id, CAST(len AS BIGINT) len, round(1.5 * (1 - 0.75 + 0.75 * len / a), 6) norm FROM l, n")
def doc_norms(spark, d):
    return R.bm25_index(_t(spark, d, "documents"))["lengths"].select("doc_id", "len", F.round("norm", 6).alias("norm"))


def _bm25_sql(k1: float, b: float, k: int) -> str:
    return f"""WITH {_STATS}, q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '{TOKEN}')) term FROM benchmark),
s AS (SELECT item_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / a))) score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l ON l.doc_id = tf.doc_id, n GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INT) rank FROM s QUALIFY rank <= {k}"""


def _bm25(spark, d, k1=1.5, b=0.75, k=10):
    return bm25.bm25_topk(_t(spark, d, "documents"), _t(spark, d, "benchmark"), k, k1=k1, b=b)


def _two_rankings(spark, d):
    """Both parameter sets in one pass over the documents."""
    index = scratch.stored(bm25.build(_t(spark, d, "documents")), "bm25")
    both = scratch.stored(bm25.rank(index, _t(spark, d, "benchmark"), 32, params=[(1.5, 0.75), (0.9, 0.4)]), "rankings")
    return [both.where(F.col("setting") == i).drop("setting") for i in (0, 1)]


@query("bm25_topk", _bm25_sql(1.5, 0.75, 10))
def bm25_topk(spark, d):
    return _bm25(spark, d).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("fusion_rrf", f"""WITH a AS ({_bm25_sql(1.5, 0.75, 32)}), b AS ({_bm25_sql(0.9, 0.4, 32)}), u AS (SELECT item_id, doc_id, rank FROM a UNION ALL SELECT item_id, doc_id, rank FROM b),
s AS (SELECT item_id, doc_id, sum(1.0 / (60 + CAST(rank AS DOUBLE))) score FROM u GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INT) rank FROM s QUALIFY rank <= 10""")
def fusion_rrf(spark, d):
    return R.rrf(_two_rankings(spark, d), "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("fusion_interleave", f"""WITH a AS ({_bm25_sql(1.5, 0.75, 32)}), b AS ({_bm25_sql(0.9, 0.4, 32)}), u AS (SELECT *, 0 source FROM a UNION ALL SELECT *, 1 FROM b),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY rank, source) = 1)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY rank, source) AS INT) AS place FROM f QUALIFY place <= 10""")
def fusion_interleave(spark, d):
    return R.interleave(_two_rankings(spark, d), "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").alias("place"))


@query("null_topk", "SELECT item_id, CAST(NULL AS BIGINT) doc_id, CAST(NULL AS DOUBLE) score FROM benchmark WHERE false")
def null_topk(spark, d):
    return _t(spark, d, "benchmark").where("false").select("item_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("double").alias("score"))


_SHAPES = " UNION ALL ".join(f"SELECT '{k}' shape, {v}::DOUBLE share" for k, v in text.TEMPLATES.items())
_FIXED = " UNION ALL ".join(f"SELECT '{k}' tactic, {v}::DOUBLE share" for k, v in text.CLOSERS.items())


@query("repertoire_propose", f"""WITH h AS ({_bm25_sql(1.5, 0.75, 10)}), p AS (SELECT item_id, 'doc.' || doc_id AS name, rank FROM h), sh AS ({_SHAPES}), fx AS ({_FIXED}),
a AS (SELECT DISTINCT item_id, tactic, ln(share) score, true closer FROM p, fx UNION ALL SELECT item_id, replace(shape, '{{p}}', name), ln(share) - ln(CAST(rank AS DOUBLE)), false FROM p, sh),
b AS (SELECT item_id, tactic, max(score) score, bool_or(closer) closer FROM a GROUP BY ALL),
c AS (SELECT *, closer AND row_number() OVER (PARTITION BY item_id, closer ORDER BY round(score, 9) DESC, tactic) <= 8 sure FROM b),
e AS (SELECT * FROM c QUALIFY sure OR row_number() OVER (PARTITION BY item_id, sure ORDER BY round(score, 9) DESC, tactic) <= 24)
SELECT item_id, tactic, round(score, 6) score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, tactic) AS INT) rank FROM e""")
def repertoire_propose(spark, d):
    p = _bm25(spark, d).select("item_id", F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("name"), "rank")
    return R.propose(p, text.CLOSERS, text.TEMPLATES, "item_id").withColumn("score", F.round("score", 6))


@query("prompt_blocks", f"""WITH h AS ({_bm25_sql(1.5, 0.75, 10)}) SELECT h.item_id, string_agg('ID:' || (rank - 1) || '\nFormal name: doc.' || h.doc_id || '\nInformal name: \nFormal statement: ' || text, '\n\n' ORDER BY rank) prompt FROM h JOIN documents USING (doc_id) WHERE rank <= 6 GROUP BY h.item_id""")
def prompt_blocks(spark, d):
    h = _bm25(spark, d).where("rank <= 6").join(_t(spark, d, "documents").select("doc_id", F.col("text").alias("statement")), "doc_id")
    one = F.struct("rank", F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("name"), F.lit("").alias("informal_name"), "statement")
    return h.groupBy("item_id").agg(F.array_sort(F.collect_list(one)).alias("p")).select("item_id", text.prompt_block(F.col("p")).alias("prompt"))


# --- dense retrieval --------------------------------------------------------------------------------------------------
_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"


@query("sv_topk", f"""WITH s AS (SELECT q.vec_id qid, e.vec_id doc_id, {_DOT.format('e.embedding', 'q.embedding')} score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT qid, doc_id, round(score, 6) score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INT) rank FROM s QUALIFY rank <= 10""")
def sv_topk(spark, d):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return R.vector_topk(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), q).withColumn("score", F.round("score", 6))


def _li(spark, d):
    """Documents are all rows, by the root of their id; queries the rows whose id is divisible by 100, five tokens each."""
    e = _t(spark, d, "embeddings")
    docs = e.select(F.floor(F.sqrt("vec_id")).cast("int").alias("doc_id"), F.col("embedding").alias("vec"))
    q = e.where("vec_id % 100 = 0").select(F.expr("cast(vec_id div 500 as int)").alias("qid"), F.col("vec_id").alias("tok"), F.col("embedding").alias("vec"), F.when(F.col("vec_id") % 500 == 0, 2.0).otherwise(1.0).alias("weight"))
    return docs, q


_LI = f"""d AS (SELECT CAST(floor(sqrt(vec_id)) AS INT) doc_id, embedding vec FROM embeddings),
q AS (SELECT CAST(vec_id // 500 AS INT) qid, vec_id tok, embedding vec, CASE WHEN vec_id % 500 = 0 THEN 2.0 ELSE 1.0 END weight FROM embeddings WHERE vec_id % 100 = 0),
m AS (SELECT qid, tok, weight, doc_id, max({_DOT.format('d.vec', 'q.vec')}) s FROM d, q GROUP BY ALL)"""
_RANKED = "SELECT qid, doc_id, round(score, 6) score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INT) rank FROM {} QUALIFY rank <= 10"
_POOL = f"""u AS (SELECT doc_id, i, avg(vec[i]::DOUBLE) x FROM d, unnest(range(1, 65)) t(i) GROUP BY ALL), v AS (SELECT doc_id, list(x ORDER BY i) vec FROM u GROUP BY doc_id),
pool AS (SELECT doc_id, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) vec FROM v),
qs AS (SELECT qid, i, sum(vec[i]::DOUBLE) x FROM q, unnest(range(1, 65)) t(i) GROUP BY ALL), qv AS (SELECT qid, list(x ORDER BY i) vec FROM qs GROUP BY qid),
c AS (SELECT qid, doc_id FROM (SELECT qid, doc_id, {_DOT.format('pool.vec', 'qv.vec')} s FROM pool, qv) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, doc_id) <= 12)"""


def li_index(spark, d):
    """The saved and loaded index of the documents' tokens, and the queries' tokens."""
    docs, q = _li(spark, d)
    path = scratch.path_for(spark, "li")
    dense.save(scratch.stored(dense.build(docs, half=False), "li-blocks"), path)
    return dense.load(spark, path), q


def _shown(ranked):
    return ranked.select(F.col("qid").cast("int").alias("qid"), F.col("doc_id").cast("int").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("li_exact", f"WITH {_LI}, s AS (SELECT qid, doc_id, sum(s) score FROM m GROUP BY ALL) " + _RANKED.format("s"))
def li_exact(spark, d):
    index, q = li_index(spark, d)
    return _shown(dense.exact_topk(index, q.drop("weight")))


@query("maxsim_weighted", f"WITH {_LI}, s AS (SELECT qid, doc_id, sum(s * weight) score FROM m GROUP BY ALL) " + _RANKED.format("s"))
def maxsim_weighted(spark, d):
    return _shown(dense.exact_topk(*li_index(spark, d)))


@query("mean_pool", f"WITH {_LI}, {_POOL} SELECT doc_id, CAST(len(vec) AS INT) dim, round(vec[1], 6) first, round(vec[64], 6) last FROM pool")
def mean_pool(spark, d):
    return dense.pooled(dense.build(_li(spark, d)[0])).select(F.col("doc_id").cast("int").alias("doc_id"), F.size("vec").alias("dim"), F.round(F.col("vec")[0], 6).alias("first"), F.round(F.col("vec")[63], 6).alias("last"))


@query("li_two_stage", f"WITH {_LI}, {_POOL}, s AS (SELECT qid, doc_id, sum(s) score FROM m JOIN c USING (qid, doc_id) GROUP BY ALL) " + _RANKED.format("s"))
def li_two_stage(spark, d):
    index, q = li_index(spark, d)
    return _shown(dense.two_stage_topk(index, q.drop("weight"), 10, 12))


#: Recall of each query at several budgets of candidates: place in the first stage, MaxSim, rank among the candidates of each budget.
_BUDGETS = f"""{_LI}, {_POOL}, f AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, doc_id) place FROM (SELECT qid, doc_id, {_DOT.format('pool.vec', 'qv.vec')} s FROM pool, qv)),
sc AS (SELECT qid, doc_id, sum(s) score FROM m GROUP BY ALL), e AS (SELECT qid, doc_id FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) <= 10),
b AS (SELECT unnest([10, 12, 16]) budget),
a AS (SELECT b.budget, sc.qid, sc.doc_id FROM b JOIN f ON f.place <= greatest(b.budget, 10) JOIN sc ON sc.qid = f.qid AND sc.doc_id = f.doc_id QUALIFY row_number() OVER (PARTITION BY b.budget, sc.qid ORDER BY round(sc.score, 9) DESC, sc.doc_id) <= 10),
p AS (SELECT e.qid, b.budget, count(*) n_exact, count(a.doc_id) n_found FROM e CROSS JOIN b LEFT JOIN a ON a.qid = e.qid AND a.doc_id = e.doc_id AND a.budget = b.budget GROUP BY e.qid, b.budget)"""


def _recalls(spark, d):
    index, q = li_index(spark, d)
    return dense.recall_per_query(index, q.drop("weight"), [10, 12, 16])


@query("li_recall", f"WITH {_BUDGETS} SELECT CAST(qid AS INTEGER) qid, CAST(budget AS INTEGER) budget, n_exact, n_found, round(n_found / n_exact, 6) recall FROM p")
def li_recall(spark, d):
    return _recalls(spark, d).withColumn("qid", F.col("qid").cast("int")).withColumn("recall", F.round("recall", 6))


@query("recall_at_budgets", f"""
WITH {_BUDGETS}
SELECT CAST(budget AS INTEGER) budget, round(sum(n_found) / sum(n_exact), 6) micro, round(avg(n_found / n_exact), 6) macro, count(*) FILTER (WHERE n_found = n_exact) n_lossless FROM p GROUP BY budget""")
def recall_at_budgets(spark, d):
    """Over all results, as a mean over queries, and queries that lose nothing."""
    return dense.recall_at_budgets(_recalls(spark, d))


def _hashed_sql(table: str, key: str) -> str:
    return f"""SELECT {key}, CAST('0x' || substr(md5(w), 1, 4) AS INT) % 64 i, sum(CASE WHEN CAST('0x' || substr(md5(w), 5, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END) x
  FROM (SELECT {key}, unnest(regexp_extract_all(text, '{TOKEN}')) w FROM {table}) GROUP BY ALL"""


@query("retriever_fusion", f"""
WITH a AS ({_bm25_sql(1.5, 0.75, 32)}), dv AS ({_hashed_sql('documents', 'doc_id')}), qv AS ({_hashed_sql('benchmark', 'item_id')}),
c AS (SELECT item_id, doc_id FROM benchmark, documents WHERE benchmark.text IS NOT NULL AND documents.text IS NOT NULL),
p AS (SELECT item_id, doc_id, sum(qv.x * dv.x) s FROM qv JOIN dv ON dv.i = qv.i GROUP BY ALL),
b AS (SELECT c.item_id, c.doc_id, row_number() OVER (PARTITION BY c.item_id ORDER BY coalesce(s, 0) DESC, c.doc_id) AS rank FROM c LEFT JOIN p ON p.item_id = c.item_id AND p.doc_id = c.doc_id QUALIFY rank <= 32),
u AS (SELECT item_id, doc_id, rank FROM a UNION ALL SELECT item_id, doc_id, rank FROM b), s AS (SELECT item_id, doc_id, sum(1.0 / (60 + CAST(rank AS DOUBLE))) score FROM u GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INT) rank FROM s QUALIFY rank <= 10""")
def retriever_fusion(spark, d):
    """BM25 fused with inner products of hashed vectors (whole numbers), both behind the retrievers' protocol."""
    docs, queries = _t(spark, d, "documents"), _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    encode = retrievers.hashing_encoder(unit=False)
    # The index counts its vectors before it packs them; as a table they are encoded once.
    encoded = scratch.stored(retrievers.token_table(docs, "doc_id", encode), "encoded")
    vectors = scratch.stored(dense.build(encoded, half=False), "hashed")
    fused = retrievers.FusionRetriever([retrievers.Bm25Retriever(scratch.stored(bm25.build(docs), "bm25")), retrievers.VectorRetriever(vectors, encode)])
    return fused.retrieve(queries, 10).select(F.col("qid").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), "rank")


@query("retrieval_stats", "SELECT event_type arm, count(*) n_queries, round(sum(value), 2) total, round(sum(value) / greatest(count(*), 1), 2) mean_ms FROM events GROUP BY event_type")
def retrieval_stats(spark, d):
    return _t(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n_queries"), F.round(F.sum("value"), 2).alias("total"), F.round(F.sum("value") / F.greatest(F.count("*"), F.lit(1)), 2).alias("mean_ms"))


# --- corpus -----------------------------------------------------------------------------------------------------------


@query("corpus_fingerprint", "SELECT count(*) || ':' || substr(sha256(string_agg(p_name || '\n', '' ORDER BY p_partkey)), 1, 16) fingerprint FROM part")
def corpus_fingerprint(spark, d):
    """One digest of all names in order: names are sent as sorted parts, their text is one row, as the definition asks for."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.concat(x["p_name"], F.lit("\n")))
    return _t(spark, d, "part").agg(F.count("*").alias("n"), F.sha2(F.array_join(names, ""), 256).alias("h")).select(F.concat(F.col("n").cast("string"), F.lit(":"), F.substr("h", F.lit(1), F.lit(16))).alias("fingerprint"))


@query("discover_latest", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1")
def discover_latest(spark, d):
    return runs.latest(_t(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("last_row_per_key", "SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def last_row_per_key(spark, d):
    return runs.last_rows(_t(spark, d, "events").select("user_id", "event_type", "value", F.col("event_id").alias("line_no")), "user_id", "event_type").select("user_id", "event_type", "value")


@query("resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("limit_offset", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10 OFFSET 5")
def limit_offset(spark, d):
    return _t(spark, d, "benchmark").orderBy("item_id").offset(5).limit(10)


@query("csr_offsets", "SELECT conv_id, n, CAST(sum(n) OVER (ORDER BY conv_id) - n AS BIGINT) start FROM (SELECT conv_id, count(*) n FROM conversations GROUP BY conv_id)")
def csr_offsets(spark, d):
    n = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return R.offsets(n, "conv_id", "n").select("conv_id", "n", "start")


# --- names and citations ----------------------------------------------------------------------------------------------


@query("suffix_index", "SELECT split_part(p_name, ' ', -1) suffix, count(DISTINCT replace(p_name, ' ', '.')) n FROM part GROUP BY 1")
def suffix_index(spark, d):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    return _t(spark, d, "part").select(name.alias("name")).distinct().groupBy(text.last_component(F.col("name")).alias("suffix")).agg(F.count("*").alias("n"))


@query("resolve_suffix", f"""WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{IDENT}')) w FROM documents), n AS (SELECT doc_id % 97 || '.' || w AS name, w AS last FROM c UNION SELECT replace(p_name, ' ', '.'), split_part(p_name, ' ', -1) FROM part),
x AS (SELECT w, count(DISTINCT n.name) exact FROM (SELECT DISTINCT w FROM c) JOIN n ON n.name = w GROUP BY w), s AS (SELECT w, count(DISTINCT n.name) hits FROM (SELECT DISTINCT w FROM c) JOIN n ON n.last = w GROUP BY w)
SELECT s.w AS word, coalesce(exact, hits) AS n FROM s LEFT JOIN x USING (w)""")
def resolve_suffix(spark, d):
    """Names are each document's words under its number modulo 97 and those of ``part``. Per last component they are counted in one pass: a numbered name is one of 193 bits, others are few."""
    c = _t(spark, d, "documents").select(F.explode(text.identifiers(F.col("text"))).alias("w"), (F.col("doc_id") % 97).alias("r"), F.lit(True).alias("cited"), F.lit(0).alias("other"), F.lit(False).alias("exact"))
    part = _t(spark, d, "part").select(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")).alias("name")).where("name is not null").distinct()
    numbered = F.regexp_extract("name", r"^(0|-?[1-9][0-9]?)\.[^.]+$", 1)
    r = F.when((numbered != "") & numbered.cast("long").between(-96, 96), numbered.cast("long"))
    last = part.select(text.last_component(F.col("name")).alias("w"), r.alias("r"), F.lit(False).alias("cited"), F.when(r.isNull(), 1).otherwise(0).alias("other"), F.lit(False).alias("exact"))
    whole = part.select(F.col("name").alias("w"), F.lit(None).cast("long").alias("r"), F.lit(False).alias("cited"), F.lit(0).alias("other"), F.lit(True).alias("exact"))
    at = F.col("r") + 96
    bits = [F.bit_or(F.when(F.floor(at / 64) == i, F.expr("shiftleft(1L, cast((r + 96) % 64 as int))"))).alias(f"b{i}") for i in range(4)]
    g = c.unionByName(last).unionByName(whole).groupBy("w").agg(*bits, F.sum("other").alias("other"), F.max("cited").alias("cited"), F.max("exact").alias("exact"))
    hits = sum((F.coalesce(F.bit_count(f"b{i}"), F.lit(0)) for i in range(4)), F.col("other"))
    return g.where("cited").select(F.col("w").alias("word"), F.when(F.col("exact"), F.lit(1)).otherwise(hits).cast("long").alias("n"))


_CITES = f"SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(text, '{IDENT}'))) w FROM documents"


@query("citation_novelty", f"""WITH c AS ({_CITES}), s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{IDENT}')) w FROM benchmark),
f AS (SELECT doc_id, source, count(*) n_cited, avg(CASE WHEN s.w IS NULL THEN 1.0 ELSE 0.0 END) unseen FROM c LEFT JOIN s USING (w) GROUP BY ALL)
SELECT source, count(*) n, round(avg(unseen), 6) mean_unseen, sum(n_cited) n_cited FROM f GROUP BY source""")
def citation_novelty(spark, d):
    c = _t(spark, d, "documents").select("doc_id", "source", F.explode(F.array_distinct(text.identifiers(F.col("text")))).alias("w"))
    seen = _t(spark, d, "benchmark").select(F.explode(text.identifiers(F.col("text"))).alias("w")).distinct().withColumn("s", F.lit(1))
    per = c.join(seen, "w", "left").groupBy("doc_id", "source").agg(F.count("*").alias("n_cited"), F.avg(F.when(F.col("s").isNull(), 1.0).otherwise(0.0)).alias("unseen"))
    return per.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("unseen"), 6).alias("mean_unseen"), F.sum("n_cited").alias("n_cited"))


@query("base_rate", f"""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{IDENT}')) w FROM benchmark), c AS (SELECT DISTINCT w FROM ({_CITES}))
SELECT count(*) n, count(s.w) n_seen, round(1 - count(s.w) / count(*), 6) base_rate FROM c LEFT JOIN s USING (w)""")
def base_rate(spark, d):
    c = _t(spark, d, "documents").select(F.explode(text.identifiers(F.col("text"))).alias("w")).distinct()
    seen = _t(spark, d, "benchmark").select(F.explode(text.identifiers(F.col("text"))).alias("w")).distinct().withColumn("s", F.lit(1))
    return c.join(seen, "w", "left").agg(F.count("*").alias("n"), F.count("s").alias("n_seen")).select("n", "n_seen", F.round(1 - F.col("n_seen") / F.col("n"), 6).alias("base_rate"))


@query("contamination_verbatim", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_verbatim(spark, d):
    """Documents that hold an item whole. The item's words in the document are a must, so pairs come from a join on its rarest token, not from all pairs."""
    docs, items = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    # The first and last token of an item may be parts of longer ones in the document: inner tokens are whole.
    inner = lambda c: F.slice(text.tokens(F.col(c)), 2, F.greatest(F.size(text.tokens(F.col(c))) - 2, F.lit(0)))
    it = items.select("item_id", F.col("text").alias("item"), F.explode(F.array_distinct(inner("text"))).alias("w"))
    dt = docs.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("w")).join(R.small(it.select("w").distinct()), "w", "left_semi")
    df = dt.groupBy("w").agg(F.count("*").alias("df"))
    rare = it.join(df, "w", "left").withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "w"))).where("r = 1").select("item_id", "item", "w")
    cand = dt.join(rare, "w").select("doc_id", "item_id", "item")
    long = cand.join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("item"))).select("doc_id", "item_id")
    # Items of two tokens and fewer have no inner ones: they are looked for in every document.
    brief = items.where(F.size(text.tokens(F.col("text"))) <= 2).select("item_id", F.col("text").alias("item"))
    return long.unionByName(docs.select("doc_id", "text").join(R.small(brief), F.col("text").contains(F.col("item"))).select("doc_id", "item_id"))


@query("tactic_heads", r"SELECT role, regexp_extract(text, '^\s*([A-Za-z_][A-Za-z0-9_'']*)', 1) head, count(*) n FROM conversations GROUP BY ALL")
def tactic_heads(spark, d):
    return _t(spark, d, "conversations").groupBy("role", text.head(F.col("text")).alias("head")).agg(F.count("*").alias("n"))


@query("admissible_text", r"""SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 2000 THEN 'too long'
WHEN regexp_matches(text, '(^|[^A-Za-z0-9_.])(sorry|admit|sorryAx)($|[^A-Za-z0-9_])') THEN 'unproved' WHEN regexp_matches(text, '(^|[^A-Za-z0-9_.''])native_decide($|[^A-Za-z0-9_''])') THEN 'native' WHEN contains(text, 'apply?') THEN 'search' END reason FROM conversations""")
def admissible_text(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.admissible(F.col("text")).alias("reason"))


@query("classify_area", "SELECT CASE " + " ".join(f"WHEN regexp_matches(text, '{v}') THEN '{k}'" for k, v in text.AREAS.items()) + " ELSE 'other' END area, count(*) n FROM documents GROUP BY 1")
def classify_area(spark, d):
    return _t(spark, d, "documents").groupBy(text.area(F.col("text")).alias("area")).agg(F.count("*").alias("n"))


@query("failure_modes", "SELECT event_type status, CASE WHEN event_type = 'click' THEN (CASE user_id % 3 WHEN 0 THEN 'max_expansions' WHEN 1 THEN 'wall_clock' ELSE 'exhausted (None)' END) ELSE event_type END AS \"mode\", count(*) n FROM events GROUP BY ALL")
def failure_modes(spark, d):
    e = _t(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "exhausted").otherwise(F.col("event_type"))
    hit = F.when(F.col("user_id") % 3 == 0, "max_expansions").when(F.col("user_id") % 3 == 1, "wall_clock_s")
    return e.groupBy(F.col("event_type").alias("status"), text.failure_mode(status, hit).alias("mode")).agg(F.count("*").alias("n"))


@query("budget_labels", "SELECT p_partkey, p_brand || '@' || CASE WHEN n >= 1000 AND n % 1000 = 0 THEN n // 1000 || 'k' ELSE CAST(n AS VARCHAR) END label FROM (SELECT p_partkey, p_brand, CAST(p_size * 100 AS BIGINT) n FROM part)")
def budget_labels(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.budget_label(F.col("p_brand"), (F.col("p_size") * 100).cast("long")).alias("label"))


# --- draws ------------------------------------------------------------------------------------------------------------
_DRAWS = "draws AS (SELECT user_id % 2 benchmark, event_type arm, (day(ts) - 1) % 8 seed, user_id // 2 pid, max(value) >= 100 solved FROM events GROUP BY ALL)"
_ARMS = _DRAWS + ", arms AS (SELECT benchmark, arm, pid, bool_or(solved) solved, count(*) n_draws, count(*) FILTER (WHERE solved) n_solved FROM draws GROUP BY ALL)"


def draws(spark, d):
    """Problems of both benchmarks have the same ids: whatever joins them has to join the benchmark as well."""
    e = _t(spark, d, "events")
    return e.groupBy((F.col("user_id") % 2).alias("benchmark"), F.col("event_type").alias("arm"), ((F.day("ts") - 1) % 8).cast("long").alias("seed"), F.expr("user_id div 2").alias("pid")).agg((F.max("value") >= 100).alias("solved"))


@query("set_union_by_arm", f"WITH {_ARMS} SELECT * FROM arms")
def set_union_by_arm(spark, d):
    return runs.by_arm(draws(spark, d))


_PAIR = "pr AS (SELECT x.benchmark, x.pid, x.solved a, y.solved b FROM arms x JOIN arms y ON x.benchmark = y.benchmark AND x.pid = y.pid WHERE x.arm = 'click' AND y.arm = 'view')"
_TAIL = "least(1.0, 2 * list_sum(list_transform(range(0, least({0}, {1}) + 1), lambda i: exp(lgamma(CAST({0} + {1} AS DOUBLE) + 1) - lgamma(CAST(i AS DOUBLE) + 1) - lgamma(CAST({0} + {1} - i AS DOUBLE) + 1) - ({0} + {1}) * ln(2)))))"


@query("compare_pooled", f"""WITH {_ARMS}, {_PAIR}, g AS (SELECT benchmark, count(*) n, count(*) FILTER (WHERE a) n_a, count(*) FILTER (WHERE b) n_b, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) only_a,
count(*) FILTER (WHERE b AND NOT a) only_b, count(*) FILTER (WHERE a OR b) AS either FROM pr GROUP BY ROLLUP (benchmark))
SELECT *, round((n_b - n_a) / n, 6) delta, either - greatest(n_a, n_b) union_gain, round(either / n, 6) union_rate, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE round({_TAIL.format('only_a', 'only_b')}, 6) END p, only_a = 0 baseline_is_subset FROM g""")
def compare_pooled(spark, d):
    return runs.compare(runs.pairs(draws(spark, d), "click", "view"))


@query("mcnemar_labels", f"WITH g AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) c FROM labels) SELECT b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE round({_TAIL.format('b', 'c')}, 6) END p FROM g")
def mcnemar_labels(spark, d):
    g = _t(spark, d, "labels").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("b"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("c"))
    return g.withColumn("p", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6))


@query("exclusive_wins", f"WITH {_ARMS}, {_PAIR} SELECT benchmark, pid, CASE WHEN a THEN 'click' ELSE 'view' END winner FROM pr WHERE a <> b")
def exclusive_wins(spark, d):
    return runs.pairs(draws(spark, d), "click", "view").where("a <> b").select("benchmark", "pid", F.when(F.col("a"), "click").otherwise("view").alias("winner"))


@query("multi_arm_intersection", f"WITH {_ARMS}, k AS (SELECT benchmark, count(DISTINCT arm) k FROM arms GROUP BY benchmark) SELECT benchmark, pid, count(*) FILTER (WHERE solved) n_arms FROM arms JOIN k USING (benchmark) GROUP BY benchmark, pid, k HAVING count(*) = k")
def multi_arm_intersection(spark, d):
    a = runs.by_arm(draws(spark, d))
    k = a.groupBy("benchmark").agg(F.countDistinct("arm").alias("k"))
    return a.groupBy("benchmark", "pid").agg(F.count("*").alias("n"), F.count_if("solved").alias("n_arms")).join(k, "benchmark").where("n = k").select("benchmark", "pid", "n_arms")


@query("won_vs_control", f"WITH {_ARMS} SELECT x.benchmark, x.arm, x.pid FROM arms x WHERE x.solved AND x.arm <> 'view' AND NOT EXISTS (SELECT 1 FROM arms y WHERE y.arm = 'view' AND y.solved AND y.pid = x.pid AND y.benchmark = x.benchmark)")
def won_vs_control(spark, d):
    a = runs.by_arm(draws(spark, d)).where("solved")
    return a.where("arm <> 'view'").select("benchmark", "arm", "pid").join(a.where("arm = 'view'").select("benchmark", "pid"), ["benchmark", "pid"], "left_anti").select("benchmark", "arm", "pid")


@query("verification_discount", f"WITH {_DRAWS} SELECT d.benchmark, arm, seed, pid, solved AND l.doc_id IS NULL solved, solved AND l.doc_id IS NOT NULL discounted FROM draws d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = pid")
def verification_discount(spark, d):
    return runs.discounted(draws(spark, d), _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("pid")), "pid").select("benchmark", "arm", "seed", "pid", "solved", "discounted")


@query("solve_rate", f"WITH {_DRAWS}, k AS (SELECT benchmark, arm, count(DISTINCT seed) k FROM draws GROUP BY ALL), r AS (SELECT benchmark, arm, pid, avg(CAST(solved AS DOUBLE)) rate, count(*) n FROM draws GROUP BY ALL) SELECT benchmark, arm, pid, round(rate, 6) rate FROM r JOIN k USING (benchmark, arm) WHERE n = k")
def solve_rate(spark, d):
    return runs.solve_rates(draws(spark, d)).withColumn("rate", F.round("rate", 6))


_PASS = "1 - list_reduce(list_concat([1.0::DOUBLE], list_transform(range(0, k), lambda i: greatest(0.0, CAST(8 - c - i AS DOUBLE) / (8 - i)))), lambda x, y: x * y)"


@query("passk_curve", f"WITH {_DRAWS}, c AS (SELECT benchmark, arm, pid, count(DISTINCT CASE WHEN solved THEN seed END) c FROM draws GROUP BY ALL), g AS (SELECT arm, c, k, count(*) n FROM c, unnest(range(1, 9)) t(k) GROUP BY ALL) SELECT arm, CAST(k AS INT) k, round(sum(({_PASS}) * n) / sum(n), 6) coverage FROM g GROUP BY arm, k")
def passk_curve(spark, d):
    return runs.coverage(draws(spark, d), 8, "arm")


@query("passk_first_draw", f"""
WITH {_DRAWS}, f AS (SELECT arm, min(seed) seed FROM draws GROUP BY arm),
n AS (SELECT d.arm, count(DISTINCT d.benchmark || ':' || d.pid) n FROM draws d JOIN f ON f.arm = d.arm AND f.seed = d.seed GROUP BY d.arm),
c AS (SELECT benchmark, arm, pid, count(DISTINCT CASE WHEN solved THEN seed END) c FROM draws GROUP BY ALL), g AS (SELECT arm, c, k, count(*) n FROM c, unnest(range(1, 9)) t(k) GROUP BY ALL),
s AS (SELECT arm, k, sum(({_PASS}) * n) p FROM g GROUP BY arm, k)
SELECT s.arm, CAST(s.k AS INT) k, round(s.p / n.n, 6) coverage, n.n n_problems FROM s JOIN n ON n.arm = s.arm""")
def passk_first_draw(spark, d):
    """pass@k of each arm over the problems of its first seed."""
    return runs.coverage_of_first(draws(spark, d), 8, "seed", "arm")


@query("ensemble_curve", f"WITH {_DRAWS}, c AS (SELECT benchmark, pid, count(DISTINCT CASE WHEN solved THEN seed END) c FROM draws WHERE arm IN ('click', 'view') GROUP BY ALL), g AS (SELECT benchmark, c, k, count(*) n FROM c, unnest(range(1, 9)) t(k) GROUP BY ALL) SELECT benchmark, CAST(k AS INT) k, round(sum(({_PASS}) * n) / sum(n), 6) coverage FROM g GROUP BY benchmark, k")
def ensemble_curve(spark, d):
    return runs.coverage(draws(spark, d).where(F.col("arm").isin("click", "view")), 8, "benchmark")


@query("budget_matched", f"""WITH {_DRAWS}, c AS (SELECT benchmark, arm, pid, count(DISTINCT CASE WHEN solved THEN seed END) c FROM draws WHERE arm IN ('click', 'view') GROUP BY ALL UNION ALL SELECT benchmark, 'both', pid, count(DISTINCT CASE WHEN solved THEN seed END) FROM draws WHERE arm IN ('click', 'view') GROUP BY benchmark, pid),
g AS (SELECT arm, c, CASE WHEN arm = 'both' THEN 4 ELSE 8 END k FROM c) SELECT arm, CAST(k AS INT) k, round(sum({_PASS}), 6) solved FROM g GROUP BY arm, k""")
def budget_matched(spark, d):
    x = draws(spark, d).where(F.col("arm").isin("click", "view"))
    # One pass: each draw counts for its arm and for both.
    both = x.withColumn("arm", F.explode(F.array("arm", F.lit("both")))).groupBy("benchmark", "arm", "pid").agg(F.countDistinct(F.when(F.col("solved"), F.col("seed"))).alias("c"))
    return both.withColumn("k", F.when(F.col("arm") == "both", 4).otherwise(8)).groupBy("arm", "k").agg(F.round(F.sum(stats.pass_at_k(F.lit(8), F.col("c"), F.col("k"))), 6).alias("solved"))


@query("noise_floor", f"""WITH {_DRAWS}, p AS (SELECT x.arm, x.seed s, y.seed t, count(*) FILTER (WHERE x.solved <> y.solved) / count(*) r FROM draws x JOIN draws y ON x.arm = y.arm AND x.benchmark = y.benchmark AND x.pid = y.pid AND x.seed < y.seed GROUP BY ALL)
SELECT arm, count(*) n_pairs, round(min(r), 6) lo, round(avg(r), 6) mean, round(max(r), 6) hi FROM p GROUP BY arm""")
def noise_floor(spark, d):
    x = draws(spark, d).select("benchmark", "arm", "pid", "seed", "solved")
    y = x.select("benchmark", "arm", "pid", F.col("seed").alias("t"), F.col("solved").alias("z"))
    p = x.join(y, ["benchmark", "arm", "pid"]).where("seed < t").groupBy("arm", "seed", "t").agg((F.count_if(F.col("solved") != F.col("z")) / F.count("*")).alias("r"))
    return p.groupBy("arm").agg(F.count("*").alias("n_pairs"), F.round(F.min("r"), 6).alias("lo"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.max("r"), 6).alias("hi"))


@query("seed_cross_pairs", f"WITH {_DRAWS} SELECT x.seed s, y.seed t, count(*) n, count(*) FILTER (WHERE x.solved AND NOT y.solved) only_x, count(*) FILTER (WHERE y.solved AND NOT x.solved) only_y FROM draws x JOIN draws y ON x.pid = y.pid AND x.benchmark = y.benchmark WHERE x.arm = 'click' AND y.arm = 'view' GROUP BY ALL")
def seed_cross_pairs(spark, d):
    x = draws(spark, d)
    a = x.where("arm = 'click'").select("benchmark", "pid", F.col("seed").alias("s"), F.col("solved").alias("x"))
    b = x.where("arm = 'view'").select("benchmark", "pid", F.col("seed").alias("t"), F.col("solved").alias("y"))
    return a.join(b, ["benchmark", "pid"]).groupBy("s", "t").agg(F.count("*").alias("n"), F.count_if(F.col("x") & ~F.col("y")).alias("only_x"), F.count_if(F.col("y") & ~F.col("x")).alias("only_y"))


@query("spread", f"WITH {_DRAWS}, s AS (SELECT arm, seed, count(*) FILTER (WHERE solved) n FROM draws GROUP BY ALL) SELECT arm, round(avg(n), 6) mean, round(stddev_samp(n), 6) sd FROM s GROUP BY arm")
def spread(spark, d):
    return draws(spark, d).groupBy("arm", "seed").agg(F.count_if("solved").alias("n")).groupBy("arm").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("sd"))


@query("table1_pivot", f"WITH {_ARMS} SELECT benchmark, count(*) FILTER (WHERE solved AND arm = 'click') click, count(*) FILTER (WHERE solved AND arm = 'view') AS \"view\", count(DISTINCT CASE WHEN solved THEN pid END) any_arm FROM arms GROUP BY benchmark")
def table1_pivot(spark, d):
    a = runs.by_arm(draws(spark, d))
    wide = a.groupBy("benchmark").pivot("arm", ["click", "view"]).agg(F.count_if("solved"))
    return wide.join(a.groupBy("benchmark").agg(F.countDistinct(F.when(F.col("solved"), F.col("pid"))).alias("any_arm")), "benchmark")


@query("status_mix", "WITH g AS (SELECT user_id % 4 arm, event_type status, count(*) n FROM events GROUP BY ALL) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY arm), 6) share FROM g")
def status_mix(spark, d):
    g = _t(spark, d, "events").groupBy((F.col("user_id") % 4).alias("arm"), F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("arm")), 6))


# --- exact tests and resampling ---------------------------------------------------------------------------------------
_LC = "lgamma(CAST({0} AS DOUBLE) + 1) - lgamma(CAST({1} AS DOUBLE) + 1) - lgamma(CAST({0} - {1} AS DOUBLE) + 1)"


@query("fisher_2x2", f"""WITH g AS (SELECT source, count(*) FILTER (WHERE quality = 1 AND toxic = 1) a, count(*) FILTER (WHERE quality = 1 AND toxic = 0) b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) c, count(*) FILTER (WHERE quality = 0 AND toxic = 0) d FROM labels JOIN documents USING (doc_id) GROUP BY source),
p AS (SELECT g.*, x, exp({_LC.format('(a + b)', 'x')} + {_LC.format('(c + d)', '(a + c - x)')} - ({_LC.format('(a + b + c + d)', '(a + c)')})) q FROM g, unnest(range(greatest(0, a + c - c - d), least(a + c, a + b) + 1)) t(x)),
o AS (SELECT source, q FROM p WHERE x = a)
SELECT p.source, a, b, c, d, CASE WHEN a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 THEN 1.0 ELSE round(least(1.0, sum(p.q) FILTER (WHERE p.q <= o.q * (1 + 1e-9))), 6) END p FROM p JOIN o ON o.source = p.source GROUP BY p.source, a, b, c, d""")
def fisher_2x2(spark, d):
    l = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    c = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    g = l.groupBy("source").agg(c(1, 1).alias("a"), c(1, 0).alias("b"), c(0, 1).alias("c"), c(0, 0).alias("d"))
    return g.withColumn("p", F.round(stats.fisher(*(F.col(x) for x in "abcd")), 6))


@query("tie_probability", f"WITH g AS (SELECT user_id pid, count(*) n FROM events GROUP BY user_id) SELECT pid, n, CASE WHEN n > 0 AND n % 2 = 0 THEN round(exp({_LC.format('n', '(n // 2)')} - n * ln(2)), 6) END tie FROM g")
def tie_probability(spark, d):
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("pid")).agg(F.count("*").alias("n")).withColumn("tie", F.round(stats.tie_probability(F.col("n")), 6))


_DIFF = "v AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 i, CAST(quality - toxic AS DOUBLE) x FROM labels), n AS (SELECT count(*) n FROM v)"
_RAND = "CAST('0x' || substr(md5(b || '-' || {}), 1, 8) AS BIGINT)"
_B = 200


def _diffs(spark, d):
    """Differences in order of id. The index is a rank over the labelled rows only; resampling is defined over it."""
    return _t(spark, d, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("x"))


@query("bootstrap_md5", f"WITH {_DIFF}, r AS (SELECT b, CAST('0x' || substr(md5(b || '-' || i), 1, 8) AS BIGINT) % n j FROM v, n, unnest(range(0, {_B})) t(b)), m AS (SELECT b, avg(x) m FROM r JOIN v ON v.i = r.j GROUP BY b) SELECT round(quantile_cont(m, 0.025), 6) lo, round(quantile_cont(m, 0.975), 6) hi FROM m")
def bootstrap_md5(spark, d):
    x = _diffs(spark, d)
    # Ranks by sums over ranges of ids; rows without an id come last, and equal ids are told apart within theirs.
    ided = x.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    start = R.offsets(ided.groupBy("k").agg(F.count("*").alias("c")), "k", "c")
    place = F.row_number().over(Window.partitionBy("k").orderBy("x")) - 1
    v = scratch.stored(ided.join(start.select("k", "start"), "k").select((F.col("start") + place).alias("i"), "x"), "differences")
    n = v.count()
    # Few bytes of ids stand for many draws: they are dealt out by their number, a million draws to a task.
    parts = max(spark.sparkContext.defaultParallelism, -(-n * _B // 1_000_000))
    draws_ = v.select("i").repartition(parts, "i").select("i", F.explode(F.sequence(F.lit(0), F.lit(_B - 1))).alias("b")).select("b", (stats.draw(F.col("b").cast("string"), F.col("i").cast("string")) % n).alias("j"))
    # The values are the smaller side, which the sizes of what they are drawn from don't show.
    values = v.withColumnRenamed("i", "j")
    values = F.broadcast(values) if n <= R.BROADCAST // 64 else values.hint("merge")
    means = draws_.join(values, "j").groupBy("b").agg(F.avg("x").alias("m"))
    return runs.interval(means, "m")


@query("permutation_md5", f"WITH {_DIFF}, z AS (SELECT doc_id, x FROM v WHERE x <> 0), o AS (SELECT abs(avg(x)) o FROM z), m AS (SELECT b, abs(avg(CASE WHEN {_RAND.format('doc_id')} % 2 = 0 THEN x ELSE -x END)) m FROM z, unnest(range(0, {_B})) t(b) GROUP BY b) SELECT round((count(*) FILTER (WHERE m >= o - 1e-12) + 1) / ({_B} + 1), 6) p FROM m, o")
def permutation_md5(spark, d):
    z = _diffs(spark, d).where("x <> 0")
    o = z.agg(F.abs(F.avg("x")).alias("o"))
    sign = F.when(stats.draw(F.col("b").cast("string"), F.col("doc_id").cast("string")) % 2 == 0, 1.0).otherwise(-1.0)
    m = runs.resampled(z, "doc_id", "x", _B, sign, "m")
    return m.crossJoin(F.broadcast(o)).agg(F.round((F.count_if(F.abs("m") >= F.col("o") - 1e-12) + 1) / F.lit(_B + 1), 6).alias("p"))


@query("perm_two_sample_md5", f"""WITH v AS (SELECT doc_id, CAST(quality AS DOUBLE) x, toxic FROM labels), k AS (SELECT count(*) FILTER (WHERE toxic = 1) na, count(*) n, sum(x) s FROM v), o AS (SELECT abs(avg(x) FILTER (WHERE toxic = 1) - avg(x) FILTER (WHERE toxic = 0)) o FROM v),
r AS (SELECT b, x, row_number() OVER (PARTITION BY b ORDER BY md5(b || '-' || doc_id), doc_id) r FROM v, unnest(range(0, {_B})) t(b)), m AS (SELECT b, sum(x) FILTER (WHERE r <= na) sa FROM r, k GROUP BY b)
SELECT round((count(*) FILTER (WHERE abs(coalesce(sa, 0) / na - (s - coalesce(sa, 0)) / (n - na)) >= o - 1e-12) + 1) / ({_B} + 1), 6) p FROM m, k, o""")
def perm_two_sample_md5(spark, d):
    v = _t(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("x"), "toxic")
    k = v.agg(F.count_if(F.col("toxic") == 1).alias("na"), F.count("*").alias("n"), F.sum("x").alias("s"), F.abs(F.avg(F.when(F.col("toxic") == 1, F.col("x"))) - F.avg(F.when(F.col("toxic") == 0, F.col("x")))).alias("o"))
    rows = v.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(_B - 1)))).withColumn("h", F.md5(F.concat_ws("-", F.col("b").cast("string"), F.col("doc_id").cast("string"))))
    r = rows.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h", "doc_id"))).crossJoin(F.broadcast(k))
    m = r.groupBy("b", "na", "n", "s", "o").agg(F.coalesce(F.sum(F.when(F.col("r") <= F.col("na"), F.col("x"))), F.lit(0.0)).alias("sa"))
    far = F.abs(F.col("sa") / F.col("na") - (F.col("s") - F.col("sa")) / (F.col("n") - F.col("na"))) >= F.col("o") - 1e-12
    return m.agg(F.round((F.count_if(far) + 1) / F.lit(_B + 1), 6).alias("p"))


@query("generation_budget", "SELECT n_seeds, n_arms, n_seeds * n_arms * 64 * 32 generations, round(n_seeds * n_arms * 64 * 32 / 4194304, 6) ratio FROM (SELECT count(DISTINCT (day(ts) - 1) % 8) n_seeds, count(DISTINCT event_type) n_arms FROM events)")
def generation_budget(spark, d):
    g = _t(spark, d, "events").agg(F.countDistinct((F.day("ts") - 1) % 8).alias("n_seeds"), F.countDistinct("event_type").alias("n_arms"))
    n = F.col("n_seeds") * F.col("n_arms") * 64 * 32
    return g.select("n_seeds", "n_arms", n.alias("generations"), F.round(n / 4194304, 6).alias("ratio"))


# --- search and streams -----------------------------------------------------------------------------------------------


@query("search_transitions")
def search_transitions(spark, d):
    """Best-first search on a graph of order lines: an order is a problem, its lines are steps."""
    l = _t(spark, d, "lineitem")
    k = F.col("l_linenumber")
    t = l.select(F.col("l_orderkey").alias("problem"), (k - 1).cast("long").alias("state"), F.concat(F.lit("use p"), F.col("l_partkey").cast("string")).alias("tactic"), (-F.col("l_discount") - 0.01).alias("logprob"),
                 F.when(k >= 5, "proved").when(F.col("l_returnflag") == "R", "error").otherwise("progress").alias("outcome"), k.cast("long").alias("next"))
    return search.best_first(t)


@query("stream_attempt_log", "SELECT event_type arm, count(*) n, count(*) FILTER (WHERE value >= 100) solved FROM events GROUP BY event_type")
def stream_attempt_log(spark, d):
    path, checkpoint = scratch.path_for(spark, "running"), scratch.path_for(spark, "checkpoint")
    log.running_solved(log.watch(spark, f"{d}/events.parquet"), path, checkpoint).awaitTermination()
    return log.latest(spark, path)


@query("stream_append", "SELECT event_id, user_id, event_type, value FROM events")
def stream_append(spark, d):
    """A log that a stream has appended to, in two starts on one checkpoint."""
    path, checkpoint = scratch.path_for(spark, "log"), scratch.path_for(spark, "checkpoint")
    for _ in range(2):
        log.append(log.watch(spark, f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value"), path, checkpoint).awaitTermination()
    return log.read_log(spark, path, "event_id long, user_id long, event_type string, value double")


@query("stream_repair", """
SELECT click_id, client_id, kind, value, 'good' what FROM (SELECT DISTINCT click_id, client_id, kind, value, props FROM clicks WHERE click_id IS NOT NULL AND (props IS NULL OR json_valid(props)))
UNION ALL SELECT NULL, NULL, NULL, CAST(count(*) AS DOUBLE), 'dead' FROM clicks WHERE click_id IS NULL OR NOT coalesce(json_valid(props), true)""")
def stream_repair(spark, d):
    """Clicks as lines of JSON with their properties as they are, some of which are torn: good rows once for each click, and how many are dead."""
    path, checkpoint = scratch.path_for(spark, "repaired"), scratch.path_for(spark, "checkpoint")
    rest = F.to_json(F.struct("click_id", "client_id", "kind", "value"))
    line = F.concat(F.substr(rest, F.lit(1), F.length(rest) - 1), F.lit(', "props": '), F.coalesce("props", F.lit("null")), F.lit("}"))
    log.collect(log.watch(spark, f"{d}/clicks.parquet").select(line.alias("line")), path, checkpoint, "click_id long, client_id long, kind string, value double", "click_id").awaitTermination()
    good = spark.read.parquet(f"{path}/good").select("click_id", "client_id", "kind", "value", F.lit("good").alias("what"))
    dead = spark.read.parquet(f"{path}/dead").agg(F.count("*").cast("double").alias("value"))
    return good.unionByName(dead.select(F.lit(None).cast("long").alias("click_id"), F.lit(None).cast("long").alias("client_id"), F.lit(None).cast("string").alias("kind"), "value", F.lit("dead").alias("what")))


def digest(names: list[str]) -> str:
    """The fingerprint of names in order, in plain Python."""
    return f"{len(names)}:{hashlib.sha256(''.join(n + chr(10) for n in names).encode()).hexdigest()[:16]}"
