"""Named queries of the engine over the benchmark tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import text as T
from tessera.functions.vectors import hash_embed, l2_normalise
from tessera.operators import dense, evaluate, fusion, index, sparse, split, store
from tessera.plans import answer
from tessera.plans.retrieve import api_rows, channels, retrieve, search_json, similar
from tessera.sources import shared
from tessera.sources.tables import checked_requests, corpus, load_counters, pdf_only, questions, sampled, table, whole_documents
from tessera.streaming.sync import masked_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _docs(spark, d, pages=False):
    return corpus(table(spark, d, "documents"), pages)


_OPENED: dict[tuple[str, str, str], tuple[str, index.Index]] = {}


def _index(spark, d, rebuild=False, **c) -> index.Index:
    """The kept index of the documents of ``d``: built once an application, used by every query, built anew when the files change."""
    config = EngineConfig(**c)
    docs = _docs(spark, d, pages=True)
    key, mark = (spark.sparkContext.applicationId, d, config.index), shared.fingerprint(table(spark, d, "documents"))
    if rebuild or _OPENED.get(key, ("",))[0] != mark:
        path = f"{shared.shared_dir(spark)}/tessera-{key[0]}-{hashlib.sha1(d.encode()).hexdigest()[:16]}-{config.index}"
        if rebuild:
            shared.remove(spark, path)
        _OPENED[key] = mark, index.load_or_build(spark, docs, path, config, fingerprint=mark)
    return _OPENED[key][1]


def _asked(spark, d):
    return questions(table(spark, d, "benchmark"))


# Parts of the SQL
CORPUS = "corpus AS (SELECT doc_id AS doc_idx, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, count(*) OVER (PARTITION BY source) AS total_pages, text AS page_content FROM documents)"
TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
TERMS = f"terms AS (SELECT doc_id AS doc_idx, unnest({TOK.format('text')}) AS term FROM documents), tf AS (SELECT doc_idx, term, count(*) AS tf FROM terms GROUP BY ALL)"
BM25 = f"""{TERMS},
dl AS (SELECT doc_id AS doc_idx, len({TOK.format('text')}) AS dl FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), qt AS (SELECT DISTINCT item_id AS question_id, unnest({TOK.format('text')}) AS term FROM benchmark),
gain AS (SELECT question_id, term, doc_idx, ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS contribution FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_idx), st),
bm AS (SELECT question_id, doc_idx, round(sum(contribution), 6) AS score FROM gain GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_idx) AS rank FROM bm)"""
EMBED = """{0}c AS (SELECT id, unnest(string_split(lower(t), '')) AS ch, generate_subscripts(string_split(lower(t), ''), 1) - 1 AS i FROM (SELECT {1} AS id, {2} AS t FROM {3})),
{0}s AS (SELECT id, i % 384 AS dim, sum(unicode(ch)) / 256.0::DOUBLE AS v FROM {0}c WHERE ch <> '' GROUP BY ALL),
{0}n AS (SELECT id, greatest(sqrt(sum(v * v)), 1e-12) AS norm FROM {0}s GROUP BY id),
{0} AS (SELECT id, dim, v / norm AS v FROM {0}s JOIN {0}n USING (id))"""
VECTOR = f"""{EMBED.format('de', 'doc_id', 'text', 'documents')}, {EMBED.format('qe', 'item_id', 'text', 'benchmark')},
dd AS (SELECT id, list(coalesce(v, 0) ORDER BY dim) AS e FROM (SELECT a.id, b.dim, de.v FROM (SELECT DISTINCT id FROM de) a CROSS JOIN (SELECT unnest(range(384)) AS dim) b LEFT JOIN de ON de.id = a.id AND de.dim = b.dim) GROUP BY id),
qd AS (SELECT id, list(coalesce(v, 0) ORDER BY dim) AS e FROM (SELECT a.id, b.dim, qe.v FROM (SELECT DISTINCT id FROM qe) a CROSS JOIN (SELECT unnest(range(384)) AS dim) b LEFT JOIN qe ON qe.id = a.id AND qe.dim = b.dim) GROUP BY id),
ve AS (SELECT qd.id AS question_id, dd.id AS doc_idx, round(list_inner_product(qd.e, dd.e), 6) AS score FROM qd, dd),
ver AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_idx) AS rank FROM ve)"""


def _fuse(k: int = 60, wv: float = 1, wb: float = 1) -> str:
    return f"""ch AS (SELECT question_id, doc_idx, rank, 'v' AS c, {float(wv)} AS w FROM ver WHERE rank <= 50 UNION ALL SELECT question_id, doc_idx, rank, 'b', {float(wb)} FROM bmr WHERE rank <= 50),
fu AS (SELECT question_id, doc_idx, min(rank) FILTER (c = 'v') AS vector_rank, min(rank) FILTER (c = 'b') AS bm25_rank, round(sum(w::DOUBLE / ({k} + rank)), 9) AS score FROM ch GROUP BY ALL),
fur AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_idx) AS rank FROM fu)"""


HYBRID = f"{BM25}, {VECTOR}, {_fuse()}"
KEYED = """kw AS (SELECT item_id AS question_id, doc_id AS doc_idx, source, d.text AS t FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60))),
asked AS (SELECT item_id AS question_id, b.text AS question, coalesce(n, 0) AS coverage, CASE WHEN n IS NULL THEN 'no_answer' WHEN len(ss) > 1 THEN 'multi_hop' WHEN item_id % 3 = 0 THEN 'distractor' ELSE 'single_fact' END AS type,
  CASE WHEN len(ss) = 1 THEN ss[1] END AS expected_source, CASE WHEN len(ss) > 1 THEN ss END AS required
  FROM benchmark b LEFT JOIN (SELECT question_id, count(*) AS n, list_sort(list(DISTINCT source)) AS ss FROM kw GROUP BY 1) k ON k.question_id = item_id)"""
PER = """per AS (SELECT f.question_id, min(f.rank) FILTER (contains(d.text, substr(b.text, 1, 60))) AS first_hit, list_sort(list(DISTINCT d.source)) AS sources, arg_min(d.source, f.rank) AS top1_source
  FROM fur f JOIN documents d ON d.doc_id = f.doc_idx JOIN benchmark b ON b.item_id = f.question_id WHERE f.rank <= 4 GROUP BY 1),
ev AS (SELECT asked.*, first_hit, top1_source, CASE WHEN type = 'multi_hop' THEN len(list_intersect(required, coalesce(sources, []))) / len(required) END AS hop, list_contains(sources, expected_source) AS source_hit, top1_source = expected_source AS source_at1,
  CASE WHEN required IS NOT NULL THEN list_sort(list_filter(required, lambda x: NOT list_contains(coalesce(sources, []), x))) END AS missing FROM asked LEFT JOIN per USING (question_id)),
st2 AS (SELECT *, CASE WHEN type = 'no_answer' THEN 'NO_ANSWER' WHEN type = 'multi_hop' THEN CASE WHEN hop = 1 THEN 'HOP_ALL' ELSE 'HOP_' || printf('%.2f', coalesce(hop, 0)) END WHEN coverage = 0 THEN 'INVALID' WHEN first_hit IS NOT NULL THEN 'HIT@' || first_hit ELSE 'MISS' END AS status FROM ev)"""
EMB = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), sc AS (SELECT q.vec_id AS question_id, d.vec_id AS doc_idx, round(list_inner_product(q.v, d.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(d.v, d.v)), 6) AS score, d.label FROM e q, e d WHERE q.vec_id % 50 = 0), ex AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_idx) AS rank FROM sc)"
CELLS = f"""{EMB}, ce AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL) GROUP BY label),
cs AS (SELECT q.vec_id AS question_id, ce.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, ce.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(ce.v, ce.v)), 6) DESC, ce.label) AS r FROM e q, ce WHERE q.vec_id % 50 = 0),
iv AS (SELECT question_id, doc_idx, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_idx) AS rank FROM sc JOIN cs USING (question_id, label) WHERE r <= 3)"""


@query(f"WITH {CORPUS} SELECT doc_idx, source, page, (page + 1)::VARCHAR AS page_label, total_pages, length(page_content) AS n_chars FROM corpus")
def page_scan(spark, d):
    return _docs(spark, d, pages=True).select("doc_idx", "source", F.col("page").cast("long"), "page_label", "total_pages", F.length("page_content").cast("long").alias("n_chars"))


@query("""SELECT page_id, length(regexp_replace(regexp_replace(html, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{00A0}]+', ' ', 'g')) AS n_chars, md5(regexp_replace(regexp_replace(html, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{00A0}]+', ' ', 'g')) AS digest FROM pages""")
def blank_normalise(spark, d):
    t = T.collapse_blanks(T.newlines("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query("SELECT doc_id, substr(sha1(text), 1, 16) AS content_id FROM documents")
def content_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_id("text").alias("content_id"))


@query("SELECT min(doc_id) AS doc_idx, substr(sha1(text), 1, 16) AS doc_id FROM documents GROUP BY text")
def dedup_keep_first(spark, d):
    return store.keep_first(_docs(spark, d)).select("doc_idx", "doc_id")


@query("""WITH a AS (SELECT doc_id::VARCHAR AS name, sha1(text) AS s FROM documents WHERE doc_id % 10 <> 0),
b AS (SELECT doc_id::VARCHAR AS name, sha1(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS s FROM documents WHERE doc_id % 10 <> 1)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.s IS NULL THEN 'new' WHEN a.s IS NULL THEN 'removed' WHEN a.s = b.s THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.name = b.name""")
def ingest_ledger_diff(spark, d):
    """The two snapshots are derived from the table by rule: files appear, go and change."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("i"), "text")
    side = lambda gone, t: docs.where(F.col("i") % 10 != gone).select(F.col("i").cast("string").alias("name"), F.sha1(t.cast("binary")).alias("sha1"))
    return store.ledger_diff(side(0, F.col("text")), side(1, F.when(F.col("i") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))


@query(f"WITH {CORPUS} SELECT source, count(*) AS chunks, count(DISTINCT page) AS pages FROM corpus GROUP BY source")
def corpus_stats(spark, d):
    return store.status(_docs(spark, d, pages=True))


FIXED = """step(doc_idx, n, pos, fin) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, -1::BIGINT FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_idx, n + 1, nx, CASE WHEN nx + 1000 < length(text) AND lb > 500 THEN nx + lb ELSE nx + 1000 END
  FROM (SELECT doc_idx, n, nx, text, CASE WHEN contains(w, ' ') THEN length(w) - strpos(reverse(w), ' ') ELSE -1 END AS lb
    FROM (SELECT s.doc_idx, s.n, s.nx, d.text, substr(d.text, s.nx + 1, 1000) AS w FROM (SELECT *, CASE WHEN fin < 0 THEN 0 ELSE fin - 200 END AS nx FROM step) s JOIN documents d ON d.doc_id = s.doc_idx) WHERE nx < length(text))),
fixed AS (SELECT doc_idx, n AS chunk_no, pos AS start_index, substr(d.text, pos + 1, fin - pos) AS chunk FROM step JOIN documents d ON d.doc_id = doc_idx WHERE n > 0)"""


@query(f"WITH RECURSIVE {FIXED} SELECT doc_idx, chunk_no, start_index, md5(chunk) AS digest FROM fixed")
def fixed_window_chunks(spark, d):
    chunks = split.split(_docs(spark, d).select("doc_idx", "page_content"), split.windows)
    return chunks.select("doc_idx", "chunk_no", "start_index", F.md5(F.col("page_content").cast("binary")).alias("digest"))


@query("SELECT doc_id AS doc_idx, regexp_matches(text, '\\S') AS some, 0::BIGINT AS too_long, 0::BIGINT AS displaced FROM documents")
def recursive_chunks(spark, d):
    """What must hold of the recursive splitter in tokens: chunks of every text that isn't blank, none too long, each where it says it is."""
    c = EngineConfig()
    docs = _docs(spark, d).select("doc_idx", "page_content")
    chunks = split.split(docs.withColumn("whole", F.col("page_content")), split.splitter(c))
    length = F.size(F.regexp_extract_all("page_content", F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))
    here = F.substring(F.col("whole"), F.col("start_index").cast("int") + 1, F.length("page_content")) == F.col("page_content")
    per = chunks.groupBy("doc_idx").agg(F.count("*").alias("n"), F.count(F.when(length > c.chunk_size, 1)).alias("too_long"), F.count(F.when(~here, 1)).alias("displaced"))
    j = docs.select("doc_idx").join(per, "doc_idx", "left")
    return j.select("doc_idx", (F.coalesce("n", F.lit(0)) > 0).alias("some"), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("too_long", "displaced")])


_BLOCK = split.BLOCK_START.replace("'", "''")
_WIDE = "\\x{4e00}-\\x{9fff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}"
_LAST = "regexp_extract(a, '[^\\n]*$')"
_FOLD = f"""list_reduce(lines, lambda a, x: CASE WHEN {_LAST} = '' OR x = '' OR length({_LAST}) < 20 OR length(x) < 20 OR regexp_matches({_LAST}, '[{split._ENDS}]$') OR regexp_matches(x, '{_BLOCK}') THEN a || chr(10) || x
  WHEN regexp_matches({_LAST}, '[{_WIDE}]$') OR regexp_matches(x, '^[{_WIDE}]') THEN a || x WHEN ends_with(a, '-') THEN a[:-2] || x ELSE a || ' ' || x END)"""
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_JOINED = f"regexp_replace({_FOLD}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g')"
_WRAPPED = "CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '(.{50}\\S*) ', '\\1' || chr(10), 'g') ELSE text END"


@query(f"""WITH w AS (SELECT doc_id, {_WRAPPED} AS t FROM documents),
l AS (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{00A0}}]+', ' ', 'g'), chr(10)), lambda x: {_STRIP.format('x')}) AS lines FROM w)
SELECT doc_id AS doc_idx, {_STRIP.format(_JOINED)} AS page_content FROM l""")
def paragraph_normalise(spark, d):
    """Even documents are hard-wrapped first, so that there are lines to join."""
    wrapped = F.when(F.col("doc_idx") % 2 == 0, F.regexp_replace("page_content", r"(.{50}\S*) ", "$1\n")).otherwise(F.col("page_content"))
    return split.normalised(_docs(spark, d).withColumn("page_content", wrapped)).select("doc_idx", "page_content")


@query(f"""WITH RECURSIVE {FIXED}, n AS (SELECT len({TOK.format('chunk')}) AS n FROM fixed)
SELECT min(n) AS least, list_sort(list(n))[(count(*) // 2 + 1)::BIGINT] AS upper_median, max(n) AS greatest, count(*) FILTER (n > 150) AS n_over FROM n""")
def chunk_length_stats(spark, d):
    chunks = split.split(_docs(spark, d).select("doc_idx", "page_content"), split.windows)
    return store.length_stats(chunks.select(F.size(T.tokens("page_content")).alias("n")), limit=150)


@query("SELECT doc_id FROM documents WHERE NOT contains(text, '....') AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 150")
def body_filter(spark, d):
    return table(spark, d, "documents").where(T.is_body("text")).select("doc_id")


@query(f"WITH {TERMS} SELECT doc_idx, term, tf FROM tf")
def term_frequency(spark, d):
    return sparse.postings(_docs(spark, d))


@query(f"WITH {TERMS} SELECT term, count(*) AS df FROM tf GROUP BY term")
def document_frequency(spark, d):
    return sparse.frequencies(sparse.postings(_docs(spark, d)))


@query(f"SELECT count(*) AS n_docs, round(avg(len({TOK.format('text')})), 6) AS avgdl FROM documents")
def bm25_stats(spark, d):
    return sparse.statistics(_docs(spark, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {BM25} SELECT * FROM bmr WHERE rank <= 4")
def bm25_topk(spark, d):
    return _index(spark, d).terms(_asked(spark, d), 4)


@query(f"WITH {BM25} SELECT * FROM bmr WHERE rank <= 4")
def bm25_topk_unindexed(spark, d):
    """The same straight from the texts, in DataFrame functions."""
    return sparse.search(_asked(spark, d), _docs(spark, d), 4)


@query(f"""WITH {TERMS}
SELECT count(*) AS n_docs, round((SELECT sum(tf) FROM tf) / count(*)::DOUBLE, 6) AS avgdl, (SELECT count(DISTINCT term) FROM tf) AS n_terms, 384::BIGINT AS dim FROM documents""")
def index_build(spark, d):
    """Builds the kept index anew: rows with vectors, postings, manifest."""
    at = _index(spark, d, rebuild=True)
    terms = at.postings.agg(F.countDistinct("term").alias("n_terms"))
    return terms.select(F.lit(at.about["n_docs"]).cast("long").alias("n_docs"), F.lit(round(at.about["avgdl"], 6)).alias("avgdl"), "n_terms", F.lit(at.about["dim"]).cast("long").alias("dim"))


@query(f"""WITH {BM25}
SELECT question_id, term, doc_idx, round(contribution, 6) AS contribution FROM gain JOIN (SELECT question_id, doc_idx FROM bmr WHERE rank = 1) USING (question_id, doc_idx)""")
def bm25_explain(spark, d):
    parts = sparse.explain(_asked(spark, d), _docs(spark, d))
    best = _index(spark, d).terms(_asked(spark, d), 1).select("question_id", "doc_idx")
    return parts.join(best, ["question_id", "doc_idx"]).select("question_id", "term", "doc_idx", F.round("contribution", 6).alias("contribution"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, i, round(x / sqrt(list_inner_product(v, v)), 6) AS x FROM (SELECT vec_id, v, unnest(v) AS x, generate_subscripts(v, 1)::BIGINT - 1 AS i FROM e)""")
def l2_normalised(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(l2_normalise(F.col("embedding"))).alias("i", "x"))
    return v.select("vec_id", F.col("i").cast("long"), F.round("x", 6).alias("x"))


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_idx"), "embedding", "label")
    return e, e.where("doc_idx % 50 = 0").select(F.col("doc_idx").alias("question_id"), "embedding")


@query(f"WITH {EMB} SELECT question_id, doc_idx, score, rank FROM ex WHERE rank <= 10")
def dense_topk(spark, d):
    e, q = _vectors(spark, d)
    return dense.exact(q, e, 10)


@query(f"WITH {EMB} SELECT question_id, doc_idx, score, rank FROM ex WHERE rank <= 10 AND score >= 0.5")
def dense_topk_threshold(spark, d):
    e, q = _vectors(spark, d)
    return dense.exact(q, e, 10, threshold=0.5)


@query(f"WITH {EMB} SELECT question_id, doc_idx, score, rank FROM ex WHERE rank <= 4 AND score > 0.1")
def legacy_cosine_topk(spark, d):
    e, q = _vectors(spark, d)
    return dense.exact(q, e, 4, strict_above=0.1)


@query(f"WITH {EMBED.format('de', 'doc_id', 'text', 'documents')} SELECT id AS doc_idx, dim::BIGINT AS dim, round(v, 6) AS v FROM de")
def hash_embedding(spark, d):
    made = hash_embed(_docs(spark, d).select("doc_idx", "page_content"), "page_content")
    return made.select("doc_idx", F.posexplode("embedding").alias("dim", "v")).where("v <> 0").select("doc_idx", F.col("dim").cast("long"), F.round("v", 6).alias("v"))


def _labelled(e):
    """Cells by label (unit vectors), and their finder of three cells."""
    rows = _label_cells(e).orderBy("cell").collect()  # a row for each of ten labels
    finder = dense.Clusters(dense.np.array([r.embedding for r in rows]), 3)
    number = {r.cell: i for i, r in enumerate(rows)}
    cell = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])[F.col("label").cast("long")].cast("long")
    return e.select("doc_idx", l2_normalise(F.col("embedding")).alias("embedding"), cell.alias("cell")), finder


def _label_cells(e):
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))  # as long as a vector
    return listed.select(F.col("label").cast("long").alias("cell"), F.transform("s", lambda x: x["m"]).alias("embedding"))


@query(f"WITH {CELLS} SELECT * FROM iv WHERE rank <= 10")
def ivf_label_topk(spark, d):
    e, q = _vectors(spark, d)
    return dense.probe(q, *_labelled(e), 10)


@query(f"""WITH {CELLS}
SELECT count(iv.doc_idx) / count(*)::DOUBLE AS recall FROM (SELECT * FROM ex WHERE rank <= 10) t LEFT JOIN (SELECT * FROM iv WHERE rank <= 10) iv ON t.question_id = iv.question_id AND t.doc_idx = iv.doc_idx""")
def recall_at_k(spark, d):
    return dense.recall(dense_topk(spark, d), ivf_label_topk(spark, d))


def _reached(spark, d, method, knob, bounds, **c):
    e, q = _vectors(spark, d)
    n = e.count()
    finder = index.resolve(method)(e, EngineConfig(**c), n)
    cells, truth, found = dense.in_cells(e.select("doc_idx", "embedding"), finder.cell_of).cache(), dense.exact(q, e, 4).cache(), []
    for value, bound in bounds:
        setattr(finder, knob, value)
        r = dense.recall(truth, dense.probe(q, cells, finder, 4)).first().recall
        found.append((method, value, bool(r >= bound)))
    return spark.createDataFrame(found, "method string, param long, reached boolean")


@query("SELECT * FROM (VALUES ('ivf', 1::BIGINT, true), ('ivf', 4, true), ('ivf', 8, true), ('ivf', 16, true)) AS t(method, param, reached)")
def ivf_kmeans_recall(spark, d):
    """Recall@4 of k-means cells reaches a bound at each number of probes, and is whole when all cells are read."""
    return _reached(spark, d, "ivf", "nprobe", ((1, 0.2), (4, 0.5), (8, 0.75), (16, 1.0)), nlist=12)


@query("SELECT * FROM (VALUES ('hash', 16::BIGINT, true), ('hash', 64, true), ('hash', 256, true), ('hash', 4096, true)) AS t(method, param, reached)")
def lsh_recall(spark, d):
    """The same of hash codes, which stand in for a graph index, by their knob ef."""
    return _reached(spark, d, "hash", "ef", ((16, 0.15), (64, 0.35), (256, 0.6), (4096, 0.95)))


def _hybrid(spark, d, **c):
    return _plain(retrieve(_asked(spark, d), _index(spark, d), EngineConfig(**c)))


def _plain(ranked):
    """Ranks that may be null as doubles, which every client reads alike."""
    return ranked.withColumns({c: F.col(c).cast("double") for c in ("vector_rank", "bm25_rank")})


@query(f"WITH {HYBRID} SELECT question_id, doc_idx, rank, score, 'rrf' AS score_kind, vector_rank::DOUBLE AS vector_rank, bm25_rank::DOUBLE AS bm25_rank FROM fur WHERE rank <= 4")
def hybrid_topk(spark, d):
    return _hybrid(spark, d)


@query(f"""WITH {BM25}, {VECTOR}, {_fuse(60, 1, 2)}
SELECT question_id, doc_idx, rank, score, 'rrf' AS score_kind, vector_rank::DOUBLE AS vector_rank, bm25_rank::DOUBLE AS bm25_rank FROM fur WHERE rank <= 4""")
def rrf_weighted(spark, d):
    return _hybrid(spark, d, bm25_weight=2.0)


@query(f"""WITH {HYBRID}
SELECT question_id, doc_idx, rank, score, vector_rank::DOUBLE AS vector_rank, bm25_rank::DOUBLE AS bm25_rank, count(vector_rank) OVER (PARTITION BY question_id) AS vector_hits, count(bm25_rank) OVER (PARTITION BY question_id) AS bm25_hits, 'hybrid' AS mode FROM fur""")
def hybrid_debug(spark, d):
    found = fusion.fuse(channels(_asked(spark, d), _index(spark, d), EngineConfig()))
    size = lambda c: F.count(c).over(Window.partitionBy("question_id"))
    sized = found.withColumns({"vector_hits": size("vector_rank"), "bm25_hits": size("bm25_rank")})
    return _plain(sized.select("question_id", "doc_idx", "rank", "score", "vector_rank", "bm25_rank", "vector_hits", "bm25_hits", F.lit("hybrid").alias("mode")))


@query(f"WITH {VECTOR} SELECT question_id, doc_idx, rank, score, 'cosine' AS score_kind, rank::DOUBLE AS vector_rank, NULL::DOUBLE AS bm25_rank FROM ver WHERE rank <= 4")
def single_channel(spark, d):
    return _hybrid(spark, d, mode="vector")


@query(f"""WITH {HYBRID}, po AS (SELECT f.*, round(len(list_intersect(list_distinct({TOK.format('b.text')}), {TOK.format('d.text')}))::DOUBLE / greatest(len(list_distinct({TOK.format('b.text')})), 1), 4) AS rr FROM fur f JOIN benchmark b ON b.item_id = question_id JOIN documents d ON d.doc_id = doc_idx WHERE rank <= 50)
SELECT question_id, doc_idx, r AS rank, rr AS score, 'rerank' AS score_kind, vector_rank::DOUBLE AS vector_rank, bm25_rank::DOUBLE AS bm25_rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rr DESC, rank, doc_idx) AS r FROM po) WHERE r <= 4""")
def rerank_lexical(spark, d):
    return _hybrid(spark, d, rerank=True)


@query("SELECT item_id AS question_id, count(d.doc_id) AS coverage FROM benchmark b LEFT JOIN documents d ON contains(d.text, substr(b.text, 1, 60)) GROUP BY 1")
def keyword_coverage(spark, d):
    return evaluate.coverage(_asked(spark, d), _docs(spark, d))


def _typed(spark, d):
    return evaluate.typed(_asked(spark, d), _docs(spark, d), F.col("question_id") % 3 == 0)


def _rows(spark, d):
    return evaluate.per_question(_typed(spark, d), _hybrid(spark, d), _docs(spark, d))


@query(f"""WITH {HYBRID}, {KEYED}, {PER}
SELECT question_id, type, status, first_hit::DOUBLE AS first_hit, coverage, hop AS hop_coverage, source_hit, source_at1, top1_source FROM st2""")
def retrieval_per_question(spark, d):
    return _rows(spark, d).drop("missing").withColumn("first_hit", F.col("first_hit").cast("double"))


@query(f"""WITH {HYBRID}, {KEYED}, {PER} SELECT count(*) AS total, count(*) FILTER (v) AS valid, coalesce(avg(coalesce(first_hit = 1, false)::INT) FILTER (v), 0.0) AS hit_at_1, coalesce(avg((first_hit IS NOT NULL)::INT) FILTER (v), 0.0) AS hit_at_k,
round(coalesce(avg(coalesce(1 / first_hit, 0)) FILTER (v), 0.0), 9) AS mrr, round(avg(coalesce(source_hit, false)::INT) FILTER (v AND type = 'distractor'), 9) AS source_hit_rate, round(avg(coalesce(source_at1, false)::INT) FILTER (v AND type = 'distractor'), 9) AS source_at1_rate, round(avg(hop) FILTER (type = 'multi_hop'), 9) AS hop_coverage, round(avg((hop = 1)::INT) FILTER (type = 'multi_hop'), 9) AS hop_full_rate FROM (SELECT *, type IN ('single_fact', 'distractor') AND status <> 'INVALID' AS v FROM st2)""")
def retrieval_summary(spark, d):
    s = evaluate.summary(_rows(spark, d))
    return s.withColumns({c: F.round(c, 9) for c in ("mrr", "source_hit_rate", "source_at1_rate", "hop_coverage", "hop_full_rate")})


@query(f"WITH {HYBRID}, {KEYED}, {PER} SELECT question_id, array_to_string(missing, ',') AS missing FROM st2 WHERE len(missing) > 0")
def missing_sources(spark, d):
    return _rows(spark, d).where("size(missing) > 0").select("question_id", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {KEYED}, bh AS (SELECT item_id AS question_id, source, count(*) AS n FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(substr(b.text, 1, 60))) WHERE NOT contains(d.text, '....') AND length(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')) >= 150 GROUP BY ALL),
ab AS (SELECT item_id AS question_id, source, count(*) AS al, count(*) FILTER (NOT contains(d.text, '....') AND length(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')) >= 150) AS n FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(substr(b.text, 1, 3))) WHERE item_id % 2 = 0 GROUP BY ALL),
abs AS (SELECT question_id, sum(al)::BIGINT AS ab_all, sum(n)::BIGINT AS ab_body, max(n)::BIGINT AS ab_other FROM ab WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT a.question_id, a.type, any_value(coalesce(ab_all, 0)) AS ab_all, any_value(coalesce(ab_body, 0)) AS ab_body, 0::BIGINT AS ab_own, any_value(coalesce(ab_other, 0)) AS ab_other, expected_source, coalesce(sum(n), 0)::BIGINT AS body_hits, coalesce(sum(n) FILTER (source IS NOT DISTINCT FROM expected_source), 0)::BIGINT AS own_hits, coalesce(max(n) FILTER (source IS DISTINCT FROM expected_source), 0) AS best_other FROM asked a LEFT JOIN bh USING (question_id) LEFT JOIN abs USING (question_id) GROUP BY a.question_id, a.type, expected_source)
SELECT question_id, CASE WHEN type = 'no_answer' THEN ab_body ELSE body_hits END AS body_hits, CASE WHEN type = 'no_answer' THEN ab_own ELSE own_hits END AS own_hits, CASE WHEN type = 'no_answer' THEN ab_other ELSE best_other END AS best_other, CASE WHEN type = 'no_answer' THEN CASE WHEN ab_all > 0 THEN 'NOT_ABSENT' ELSE 'OK' END WHEN body_hits = 0 THEN 'NO_BODY_HIT' WHEN expected_source IS NULL THEN 'OK' WHEN own_hits = 0 THEN 'SOURCE_ZERO' WHEN own_hits < best_other THEN 'SOURCE_LESS' ELSE 'OK' END AS verdict FROM p""")
def question_selfcheck(spark, d):
    docs = _docs(spark, d)
    asked = _typed(spark, d).withColumn("absent_terms", F.when(F.col("question_id") % 2 == 0, F.array(F.substring("question", 1, 3))))
    found = evaluate.self_check(asked, docs)
    return found.select("question_id", *[F.col(c).cast("long") for c in ("body_hits", "own_hits", "best_other")], "verdict")


_PIECE = "'[Document ' || rank || ']' || chr(10) || 'Source: ' || source || chr(10) || 'Page: ' || (page + 1) || chr(10) || 'Content:' || chr(10) || page_content || chr(10)"


@query(f"WITH {CORPUS}, {HYBRID} SELECT question_id, string_agg({_PIECE}, chr(10) ORDER BY rank) AS context FROM fur JOIN corpus USING (doc_idx) WHERE rank <= 4 GROUP BY 1")
def build_context(spark, d):
    return answer.contexts(_hybrid(spark, d), _index(spark, d).rows)


def _prompt_sql(variant: str) -> str:
    head, rest = (x.replace("'", "''") for x in answer.PROMPTS[variant][0].split("{context}"))
    middle, tail = rest.split("{question}")
    return f"WITH {CORPUS}, {HYBRID}, c AS (SELECT question_id, string_agg({_PIECE}, chr(10) ORDER BY rank) AS context FROM fur JOIN corpus USING (doc_idx) WHERE rank <= 4 GROUP BY 1) SELECT question_id, '{head}' || context || '{middle}' || text || '{tail}' AS prompt, '{answer.PROMPTS[variant][1]}' AS version FROM c JOIN benchmark ON item_id = question_id"


@query(_prompt_sql("full"))
def build_prompt(spark, d):
    made = build_context(spark, d).join(_asked(spark, d).select("question_id", "question"), "question_id")
    column, version = answer.prompt(F.col("question"), F.col("context"))
    return made.select("question_id", column.alias("prompt"), F.lit(version).alias("version"))


def _answers(spark, d):
    """Answers that cite the first two ranked pages, odd questions a page that wasn't retrieved."""
    docs = _index(spark, d).rows
    found = _hybrid(spark, d).join(docs, "doc_idx")
    cited = F.concat(F.lit("Fact [来源: "), "source", F.lit(" 第0"), (F.col("page") + F.when(F.col("question_id") % 2 == 1, 1001).otherwise(1)).cast("string"), F.lit("页]"))
    said = found.where("rank <= 2").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", cited.alias("c")))), lambda x: x["c"]), " ").alias("answer"))
    return said.join(answer.citation_keys(_hybrid(spark, d), docs), "question_id")


_ANS = f"{CORPUS}, {HYBRID}, k AS (SELECT question_id, source, page, rank FROM fur JOIN corpus USING (doc_idx) WHERE rank <= 4), an AS (SELECT question_id, source, page + CASE WHEN question_id % 2 = 1 THEN 1001 ELSE 1 END AS p, rank FROM k WHERE rank <= 2)"


@query(f"WITH {_ANS} SELECT question_id, source AS file, p::VARCHAR AS page FROM an")
def citation_parse(spark, d):
    return _answers(spark, d).select("question_id", F.inline(T.citations("answer")))


@query(f"""WITH {_ANS}
SELECT question_id, count(*) AS n, count(*) FILTER (ok) AS valid, count(*) FILTER (ok) / count(*)::DOUBLE AS validity, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (ok)), ','), '') AS cited FROM (SELECT an.*, EXISTS (SELECT 1
  FROM k WHERE k.question_id = an.question_id AND k.source = an.source AND k.page + 1 = an.p) AS ok FROM an) GROUP BY 1""")
def citation_validate(spark, d):
    r = _answers(spark, d).select("question_id", T.citation_report("answer", "keys").alias("r"))
    return r.select("question_id", F.col("r.count").alias("n"), "r.valid", "r.validity", F.array_join("r.cited_sources", ",").alias("cited"))


_SAID = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'INSUFFICIENT_CONTEXT ' || text WHEN 1 THEN substr(text, 1, 20) || '未说明' WHEN 2 THEN '资料未提及' || repeat('x', 100) WHEN 3 THEN repeat('y', 120) || '未给出' ELSE text END"
_GAP = "(" + " OR ".join(f"contains(lower({{0}}), '{p}')" for p in T.REFUSALS) + ")"


@query(f"""WITH a AS (SELECT conv_id, turn, regexp_replace({_SAID}, '^\\s+|\\s+$', '', 'g') AS s FROM conversations)
SELECT conv_id, turn, contains(upper(substr(s, 1, 40)), 'INSUFFICIENT_CONTEXT') AS sentinel, contains(lower(substr(s, 1, 40)), 'insufficient_context') OR ({_GAP.format('s')} AND length(s) < 100) OR {_GAP.format('substr(s, 1, 30)')} AS refused, NOT contains(lower(substr(s, 1, 40)), 'insufficient_context') AND NOT ({_GAP.format('s')} AND length(s) < 100) AND {_GAP.format('s')} AS partial_gap FROM a""")
def refusal_state(spark, d):
    said = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("answer"))
    s = T.refusal_state("answer")
    return said.select("conv_id", "turn", T.is_refusal("answer").alias("sentinel"), s["refused"].alias("refused"), s["partial_gap"].alias("partial_gap"))


@query("""WITH a AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'yes | ' || text WHEN 1 THEN '是，' || text WHEN 2 THEN '否|no' ELSE '' END AS s FROM conversations)
SELECT conv_id, turn, turn % 4 < 2 AS verdict, CASE turn % 4 WHEN 0 THEN substr(regexp_replace(split_part(s, '|', 2) || CASE WHEN strpos(substr(s, strpos(s, '|') + 1), '|') > 0 THEN substr(substr(s, strpos(s, '|') + 1), strpos(substr(s, strpos(s, '|') + 1), '|')) ELSE '' END, '^\\s+|\\s+$', '', 'g'), 1, 40) WHEN 1 THEN CASE WHEN contains(s, '|') THEN substr(regexp_replace(substr(s, strpos(s, '|') + 1), '^\\s+|\\s+$', '', 'g'), 1, 40) ELSE substr(regexp_replace(regexp_replace(substr(regexp_replace(s, '\\s+$', ''), 2), '^[：:，, ]+', ''), '^\\s+|\\s+$', '', 'g'), 1, 40) END WHEN 2 THEN 'no' ELSE '(empty reply)' END AS reason FROM a""")
def verdict_parse(spark, d):
    said = table(spark, d, "conversations").select("conv_id", "turn", F.expr("CASE turn % 4 WHEN 0 THEN 'yes | ' || text WHEN 1 THEN '是，' || text WHEN 2 THEN '否|no' ELSE '' END").alias("s"))
    v = T.verdict("s")
    return said.select("conv_id", "turn", v["verdict"].alias("verdict"), v["reason"].alias("reason"))


_SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace({}, '\\[[^\\]]*\\]', '', 'g'), '[.!?]\\s+'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH c AS (SELECT item_id, item_id % 4 = 3 AS failed, {_SENTENCES.format('substr(text, 1, 2000)')} AS cs, substr(text, 1, 150) AS context FROM benchmark),
n AS (SELECT item_id, failed, CASE WHEN failed THEN 0 ELSE len(cs) END AS total, CASE WHEN failed THEN 0 ELSE len(list_filter(cs, lambda x: contains(context, x))) END AS supported FROM c)
SELECT item_id, total, supported, CASE WHEN total > 0 THEN supported / total::DOUBLE END AS score, failed AS parse_failed FROM n""")
def claims_score(spark, d):
    """The text's sentences as claims against its first 150 characters; every fourth reply is broken off."""
    reply = F.when(F.col("item_id") % 4 == 3, "So: {\"claims\": [").otherwise(F.concat(F.lit("So: "), answer.lexical_claims(F.substring("text", 1, 2000), F.substring("text", 1, 150)), F.lit(" done")))
    return table(spark, d, "benchmark").select("item_id", T.claims(reply).alias("c")).select("item_id", "c.*")


def _model(question, context, prompt):
    """A model that refuses questions of a length that is a multiple of four."""
    return F.when(F.length(question) % 4 == 0, T.SENTINEL).otherwise(answer.extractive(question, context, prompt))


def _invoked(spark, d, llm=_model):
    """Every tenth question is empty, and the next one's documents aren't found."""
    asked = _asked(spark, d).withColumn("question", F.when(F.col("question_id") % 10 == 0, "").otherwise(F.col("question")))
    return answer.invoke(asked, _hybrid(spark, d).where("question_id % 10 > 1"), _index(spark, d).rows, llm)


_DOC1 = "regexp_extract(context, '^\\[Document 1\\]\\nSource: ([^\\n]*)\\nPage: ([^\\n]*)\\nContent:\\n(.*)', {}, 's')"
INVOKED = f"""c0 AS (SELECT question_id, string_agg({_PIECE}, chr(10) ORDER BY rank) AS context FROM fur JOIN corpus USING (doc_idx) WHERE rank <= 4 AND question_id % 10 > 1 GROUP BY 1),
i0 AS (SELECT item_id AS question_id, CASE WHEN item_id % 10 = 0 THEN '' ELSE text END AS question, context FROM benchmark LEFT JOIN c0 ON question_id = item_id),
i1 AS (SELECT *, substr(regexp_replace({_DOC1.format(3)}, '\\s+', ' ', 'g'), 1, 80) AS said, {_DOC1.format(1)} AS src, {_DOC1.format(2)} AS pg FROM i0),
i2 AS (SELECT *, CASE WHEN question = '' THEN '' WHEN context IS NULL OR length(question) % 4 = 0 OR said = '' THEN 'INSUFFICIENT_CONTEXT' ELSE {_STRIP.format("said || ' [来源: ' || src || ' 第' || pg || '页]'")} END AS raw FROM i1),
inv AS (SELECT *, CASE WHEN question = '' THEN 'no_question' WHEN context IS NULL THEN 'no_documents' WHEN contains(upper(substr(raw, 1, 40)), 'INSUFFICIENT_CONTEXT') THEN 'refused' ELSE 'answered' END AS branch FROM i2)"""


@query(f"""WITH {CORPUS}, {HYBRID}, {INVOKED}
SELECT question_id, branch, CASE branch WHEN 'no_question' THEN '{answer.NO_QUESTION}' WHEN 'answered' THEN raw ELSE '{answer.REFUSED}' END AS answer, branch <> 'answered' AS refused, (branch = 'answered')::BIGINT AS n, (branch = 'answered')::BIGINT AS valid, CASE WHEN branch = 'answered' THEN src ELSE '' END AS cited, 'v1-cite' AS version FROM inv""")
def invoke_branches(spark, d):
    c = F.col("citations")
    return _invoked(spark, d).select("question_id", "branch", "answer", "refused", c["count"].alias("n"), c["valid"].alias("valid"), F.array_join(c["cited_sources"], ",").alias("cited"), F.col("prompt_version").alias("version"))


@query(f"""WITH {CORPUS}, {HYBRID}, {INVOKED}
SELECT question_id, CASE WHEN question = '' THEN 'no_question' WHEN context IS NULL THEN 'no_documents' ELSE 'no_model' END AS branch, CASE WHEN question = '' THEN '{answer.NO_QUESTION}' WHEN context IS NULL THEN '{answer.REFUSED}' ELSE '{answer.NO_MODEL.strip()}' || chr(10) || chr(10) || context END AS answer FROM inv""")
def invoke_without_model(spark, d):
    return _invoked(spark, d, None).select("question_id", "branch", "answer")


FAITH = f"fa0 AS (SELECT question_id, {_SENTENCES.format('substr(raw, 1, 2000)')} AS cs, substr(context, 1, 6000) AS cx FROM inv WHERE branch = 'answered'), fa AS (SELECT question_id, len(cs) AS total, len(list_filter(cs, lambda x: contains(cx, x))) AS supported FROM fa0)"


def _faithful(spark, d, answers):
    judged, _ = answer.faithfulness(answers.where("not refused").select("question_id", "answer", "context"), spark.createDataFrame([], "key string, value string"))
    return judged


@query(f"WITH {CORPUS}, {HYBRID}, {INVOKED}, {FAITH} SELECT question_id, total, supported, CASE WHEN total > 0 THEN supported / total::DOUBLE END AS score FROM fa")
def faithfulness(spark, d):
    return _faithful(spark, d, _invoked(spark, d)).select("question_id", "claims.total", "claims.supported", "claims.score")


def _generated(spark, d):
    answers = _invoked(spark, d)
    return answer.generation_rows(answers, _typed(spark, d), _faithful(spark, d, answers))


def _generation_sql(by: str) -> str:
    r = lambda a, b: f"CASE WHEN coalesce({b}, 0) = 0 THEN 0.0 ELSE round(coalesce({a} / ({b})::DOUBLE, 0.0), 9) END"
    c = lambda x: f"count(*) FILTER ({x})"
    return f"""WITH {CORPUS}, {HYBRID}, {KEYED}, {INVOKED}, {FAITH}, g AS (SELECT type, branch <> 'answered' AS refused, type = 'no_answer' AS er, (branch = 'answered')::BIGINT AS cc, (branch = 'answered')::BIGINT AS cv, (branch = 'answered')::BIGINT AS ns, CASE WHEN total > 0 THEN supported / total::DOUBLE END AS fa FROM asked JOIN inv USING (question_id) LEFT JOIN fa USING (question_id))
SELECT {by + ', ' if by else ''}count(*) AS total, {c('NOT refused')} AS answered, {r(c('NOT refused AND cc > 0'), c('NOT refused'))} AS citation_coverage, {r('sum(cv) FILTER (NOT refused)', 'sum(cc) FILTER (NOT refused)')} AS citation_validity, {c('NOT refused AND cv < cc')} AS fabricated, round(avg(fa) FILTER (NOT refused), 9) AS faithfulness,
{r(c('er AND refused'), c('er'))} AS refusal_rate, {r(c('NOT er AND refused'), c('NOT er'))} AS over_refusal_rate, {r(c('NOT refused AND ns > 1'), c('NOT refused'))} AS multi_source_rate FROM g {'GROUP BY ' + by if by else ''}"""


_RATES = ("citation_coverage", "citation_validity", "faithfulness", "refusal_rate", "over_refusal_rate", "multi_source_rate")


@query(_generation_sql(""))
def generation_summary(spark, d):
    return evaluate.generation(_generated(spark, d)).withColumns({c: F.round(c, 9) for c in _RATES})


@query(_generation_sql("type"))
def generation_by_type(spark, d):
    return evaluate.generation(_generated(spark, d), by_type=True).withColumns({c: F.round(c, 9) for c in _RATES})


_SHARE = f"round(len(list_intersect(list_distinct({TOK.format('b.text')}), {TOK.format('substr(d.text, 1, 1200)')}))::DOUBLE / greatest(len(list_distinct({TOK.format('b.text')})), 1), 4)"


@query(f"""WITH {HYBRID}, pr AS (SELECT question_id, doc_idx, b.text || chr(0) || d.text AS k, {_SHARE} AS share FROM fur JOIN benchmark b ON item_id = question_id JOIN documents d ON doc_id = doc_idx WHERE rank <= 4), seen AS (SELECT DISTINCT k FROM pr WHERE doc_idx % 2 = 0)
SELECT question_id, doc_idx, seen.k IS NOT NULL OR share >= 0.2 AS verdict, CASE WHEN seen.k IS NOT NULL THEN 'seen' ELSE 'share ' || share::VARCHAR END AS reason, seen.k IS NULL AS miss FROM pr LEFT JOIN seen ON seen.k = pr.k""")
def judge_relevance(spark, d):
    """Pairs of even documents were judged before."""
    pairs = _hybrid(spark, d).select("question_id", "doc_idx").join(_asked(spark, d).select("question_id", "question"), "question_id").join(_docs(spark, d).select("doc_idx", F.col("page_content").alias("text")), "doc_idx")
    cache = pairs.where("doc_idx % 2 = 0").select(T.cache_key(F.lit("r1"), "question", "text").alias("key")).distinct().withColumn("value", F.lit("yes | seen"))
    judged, _ = answer.relevance(pairs, cache)
    return judged.select("question_id", "doc_idx", "verdict", "reason", "miss")


@query("""SELECT item_id AS question_id, substr(sha1('v2' || chr(0) || text), 1, 20) AS key, CASE WHEN item_id % 3 = 0 THEN 'seen' END AS value, item_id % 3 <> 0 AS miss FROM benchmark""")
def judge_cache_probe(spark, d):
    key = T.cache_key(F.lit("v2"), "question")
    asked = _asked(spark, d).select("question_id", key.alias("key"))
    return evaluate.memoised(asked, asked.where("question_id % 3 = 0").select("key", F.lit("seen").alias("value"))).select("question_id", "key", "value", "miss")


_TOKENS = "list_concat(CASE turn % 3 WHEN 0 THEN ['INSUFF', 'ICIENT_', 'CONTEXT'] WHEN 1 THEN [' INSUFF', 'ICIENT'] ELSE [] END, list_transform(string_split(text, ' '), lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || x END))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_TOKENS} AS tokens FROM conversations), s AS (SELECT conv_id, turn, tokens, list_transform(range(1, len(tokens) + 1), lambda i: regexp_replace(array_to_string(tokens[1:i], ''), '^\\s+', '')) AS heads FROM t),
e AS (SELECT *, list_filter(range(1, len(tokens) + 1), lambda i: starts_with(heads[i], 'INSUFFICIENT_CONTEXT') OR NOT starts_with('INSUFFICIENT_CONTEXT', heads[i]))[1] AS fx FROM s)
SELECT conv_id, turn, CASE WHEN fx IS NULL THEN (array_to_string(tokens, '') <> '')::BIGINT WHEN starts_with(heads[fx], 'INSUFFICIENT_CONTEXT') THEN 0 ELSE len(tokens) - fx + 1 END AS n_shown, CASE WHEN fx IS NOT NULL AND starts_with(heads[fx], 'INSUFFICIENT_CONTEXT') THEN '' ELSE array_to_string(tokens, '') END AS shown FROM e""")
def sentinel_mask(spark, d):
    """Token streams that begin with the sentinel, or with a part of it, or with neither."""
    said = F.transform(F.split("text", " "), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(" "), x)))
    begins = F.when(F.col("turn") % 3 == 0, F.array(*map(F.lit, ("INSUFF", "ICIENT_", "CONTEXT")))).when(F.col("turn") % 3 == 1, F.array(F.lit(" INSUFF"), F.lit("ICIENT"))).otherwise(F.array().cast("array<string>"))
    shown = table(spark, d, "conversations").select("conv_id", "turn", masked_tokens(F.concat(begins, said)).alias("s"))
    return shown.select("conv_id", "turn", F.size("s").cast("long").alias("n_shown"), F.array_join("s", "").alias("shown"))


@query(f"SELECT doc_id AS doc_idx, len({TOK.format('text')}) AS n, md5(array_to_string({TOK.format('text')}, ' ')) AS digest FROM documents")
def tokenize(spark, d):
    t = T.tokens("page_content")
    return _docs(spark, d).select("doc_idx", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


_MIXED = "CASE WHEN conv_id % 2 = 0 THEN '资料中没有spark' || turn || '，中 文' ELSE text END"


@query(f"""WITH t AS (SELECT conv_id, turn, unnest({TOK.format(_MIXED)}) AS w FROM conversations),
r AS (SELECT conv_id, turn, unnest(regexp_extract_all(w, '[\\x{{4e00}}-\\x{{9fff}}]+|[^\\x{{4e00}}-\\x{{9fff}}]+')) AS r FROM t),
g AS (SELECT conv_id, turn, unnest(CASE WHEN regexp_matches(r, '^[\\x{{4e00}}-\\x{{9fff}}]') AND length(r) > 1 THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END) AS term FROM r)
SELECT conv_id, turn, term, count(*) AS n FROM g GROUP BY ALL""")
def cjk_tokens(spark, d):
    """Runs of CJK signs are overlapping pairs; the tables hold none, so half the texts are replaced."""
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("资料中没有spark"), F.col("turn").cast("string"), F.lit("，中 文"))).otherwise(F.col("text"))
    said = table(spark, d, "conversations").withColumn("t", text)
    return said.select("conv_id", "turn", F.explode(T.tokens("t")).alias("term")).groupBy("conv_id", "turn", "term").agg(F.count("*").alias("n"))


@query(f"""WITH {CORPUS}, {HYBRID}
SELECT question_id, rank, source, (page + 1)::VARCHAR AS page, page_content AS text, score, 'rrf' AS score_kind, vector_rank::DOUBLE AS vector_rank, bm25_rank::DOUBLE AS bm25_rank FROM fur JOIN corpus USING (doc_idx) WHERE rank <= 4""")
def api_result_rows(spark, d):
    return _plain(api_rows(_hybrid(spark, d), _index(spark, d).rows))


@query(f"""WITH {CORPUS}, {HYBRID}, h AS (SELECT question_id, list({{'rank': rank, 'source': source, 'page': (page + 1)::VARCHAR, 'text': page_content}} ORDER BY rank) AS results FROM fur JOIN corpus USING (doc_idx) WHERE rank <= 4 GROUP BY 1)
SELECT item_id AS question_id, to_json({{'query': text, 'mode': 'hybrid', 'score_kind': 'rrf', 'results': results}})::VARCHAR AS body FROM benchmark JOIN h ON question_id = item_id""")
def search_reply_json(spark, d):
    return search_json(_asked(spark, d), api_rows(_hybrid(spark, d), _index(spark, d).rows), "hybrid")


@query("""WITH r AS (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN '' WHEN item_id % 7 = 1 THEN repeat('x', 501) ELSE substr(text, 1, 500) END AS question, CASE WHEN item_id % 5 > 0 THEN item_id % 24 END AS top_k, item_id % 11 * 21 AS candidate_k, CASE item_id % 6 WHEN 0 THEN 'vector' WHEN 1 THEN 'other' END AS mode, CASE WHEN item_id % 9 = 0 THEN 'loud' END AS variant FROM benchmark)
SELECT item_id, coalesce(top_k, 4) AS top_k, coalesce(mode, 'hybrid') AS mode, CASE WHEN length(question) NOT BETWEEN 1 AND 500 THEN 'question' WHEN coalesce(top_k, 4) NOT BETWEEN 1 AND 20 THEN 'top_k' WHEN candidate_k NOT BETWEEN 1 AND 200 THEN 'candidate_k' WHEN coalesce(mode, 'hybrid') NOT IN ('vector', 'bm25', 'hybrid') THEN 'mode' WHEN coalesce(variant, 'full') NOT IN ('full', 'no_refusal', 'no_cite') THEN 'variant' END AS error FROM r""")
def request_checks(spark, d):
    i = F.col("item_id")
    question = F.when(i % 7 == 0, "").when(i % 7 == 1, F.repeat(F.lit("x"), 501)).otherwise(F.substring("text", 1, 500))
    asked = table(spark, d, "benchmark").select("item_id", question.alias("question"), F.when(i % 5 > 0, i % 24).alias("top_k"), (i % 11 * 21).alias("candidate_k"), F.lit(None).cast("long").alias("rrf_k"), F.when(i % 6 == 0, "vector").when(i % 6 == 1, "other").alias("mode"), F.when(i % 9 == 0, "loud").alias("variant"))
    return checked_requests(asked).select("item_id", "top_k", "mode", "error")


@query(f"WITH {KEYED} SELECT type, count(*) AS n FROM asked GROUP BY type")
def type_histogram(spark, d):
    return evaluate.type_counts(_typed(spark, d))


@query(f"WITH {KEYED} SELECT question_id, type FROM asked WHERE type = 'no_answer' ORDER BY question_id LIMIT 5")
def question_choice(spark, d):
    return evaluate.chosen(_typed(spark, d), "no_answer", 5).select("question_id", "type")


@query(f"""WITH {HYBRID}, {KEYED}, {PER}, r AS (SELECT question_id, CASE WHEN status = 'MISS' THEN 'miss' WHEN status = 'INVALID' THEN 'invalid' WHEN type = 'multi_hop' AND status <> 'HOP_ALL' THEN 'partial_hop' END AS report, missing, top1_source FROM st2)
SELECT report, question_id, CASE WHEN report = 'partial_hop' THEN array_to_string(missing, ',') ELSE coalesce(top1_source, '') END AS detail FROM r WHERE report IS NOT NULL""")
def evaluation_reports(spark, d):
    return evaluate.reports(_rows(spark, d))


@query(f"""WITH {KEYED}, bh AS (SELECT item_id AS question_id, source, count(*) AS n
  FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(substr(b.text, 1, 60))) WHERE NOT contains(d.text, '....') AND length(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')) >= 150 GROUP BY ALL)
SELECT question_id, source, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, source) AS r FROM bh) WHERE r <= 3""")
def body_hit_sources(spark, d):
    return evaluate.top_sources(_asked(spark, d), _docs(spark, d)).select("question_id", "source", "n", "rank")


@query("SELECT doc_id AS doc_idx, substr(replace(text, chr(10), ' '), 1, 60) AS short, substr(replace(text, chr(10), ' '), 1, 160) AS long FROM documents")
def snippets(spark, d):
    return _docs(spark, d).select("doc_idx", T.snippet("page_content").alias("short"), T.snippet("page_content", 160).alias("long"))


@query("SELECT doc_id, round_even(n_chars / 8.0, 2) AS r FROM documents")
def half_even(spark, d):
    return table(spark, d, "documents").select("doc_id", F.bround(F.col("n_chars") / 8.0, 2).alias("r"))


@query("SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id LIMIT 20")
def query_sample(spark, d):
    return sampled(table(spark, d, "embeddings").select("vec_id"), "vec_id")


@query("""WITH w AS (SELECT conv_id, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn), '^\\s+|\\s+$', '', 'g') AS t FROM conversations GROUP BY 1)
SELECT conv_id::VARCHAR AS source, 1 AS page, t AS page_content FROM w WHERE t <> ''""")
def whole_document_scan(spark, d):
    """Dialogues as files, turns as their pages."""
    return whole_documents(table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("page"), F.col("text").alias("page_content")))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def pdf_magic_filter(spark, d):
    body = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7 ").otherwise("%PDX-"), "text").cast("binary")
    return pdf_only(table(spark, d, "documents").select("doc_id", body.alias("content"))).select("doc_id")


@query("""SELECT count(DISTINCT source) AS files, count(*) AS pages, count(*) FILTER (regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '') AS empty_pages, sum(length(text))::BIGINT AS chars FROM documents""")
def loader_counters(spark, d):
    return load_counters(_docs(spark, d))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS source, CASE WHEN doc_id % 5 = 0 THEN 'over' ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN doc_id % 5 = 0 AND FALSE THEN 1 ELSE 0 END AS n FROM documents""")
def metadata_merge(spark, d):
    """Metadata as a map: a default for what is missing, and later entries over earlier ones."""
    base = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")).otherwise(F.create_map(F.lit("lang"), "lang"))
    m = T.merged(base, F.when(F.col("doc_id") % 5 == 0, F.create_map(F.lit("lang"), F.lit("over"))))
    return table(spark, d, "documents").select("doc_id", T.entry(m, "source", "unknown").alias("source"), T.entry(m, "lang", "?").alias("lang"), F.size(m).alias("n"))


@query(f"""WITH {CORPUS}, {HYBRID}
SELECT question_id, string_agg({_PIECE.replace('Page: ', 'Chunk: ')}, chr(10) ORDER BY rank) AS context FROM fur JOIN corpus USING (doc_idx) WHERE rank <= 4 GROUP BY 1""")
def legacy_context(spark, d):
    return answer.legacy_contexts(_hybrid(spark, d), _index(spark, d).rows.withColumn("chunk", F.col("page") + 1))


for _variant in ("no_refusal", "no_cite"):

    def _built(spark, d, variant=_variant):
        column, version = answer.prompt(F.col("question"), F.col("context"), variant)
        return build_context(spark, d).join(_asked(spark, d).select("question_id", "question"), "question_id").select("question_id", column.alias("prompt"), F.lit(version).alias("version"))

    _built.__name__ = f"build_prompt_{_variant}"
    query(_prompt_sql(_variant))(_built)


@query(f"WITH {VECTOR} SELECT question_id, doc_idx, score, rank FROM ver WHERE rank <= 4 AND score >= 0.9")
def similar_threshold(spark, d):
    """Vector search of the kept index with the settings' threshold, which cuts after the best k."""
    return similar(hash_embed(_asked(spark, d).select("question_id", "question"), "question"), _index(spark, d), EngineConfig(score_threshold=0.9))
