"""Every query of the retrieval engine by name over the driver tables, and the SQL that it is checked against.

The tables stand in for an index: documents are notes, embeddings (by equal id) the vectors of
their chunks, benchmark passages the questions, pages the HTML, conversations the transcripts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search, text
from ..operators import ingest, retrieval
from ..settings import Settings

AS_OF = "2026-01-01 00:00:00"
LOOSE = Settings(min_semantic_score=0.05)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    at = F.timestamp_micros(F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.col("doc_id") * 3_600_000_000)
    return d.select(i.alias("document_id"), F.concat(F.lit("Note "), i, F.lit(" from "), "source").alias("title"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("-"), i, F.lit(".md")).alias("source_path"),
                    F.col("text").alias("content"), at.alias("effective_at"), F.concat(F.lit('{"project":"'), "lang", F.lit('"}')).alias("metadata_json"),
                    (F.col("doc_id") % 10 != 9).alias("is_active"), at.alias("updated_at"), F.sha2("text", 256).alias("content_hash"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    i = F.col("doc_id").cast("string")
    return d.select(i.alias("document_id"), F.concat(F.lit("c"), i).alias("chunk_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir, "embeddings").join(_t(spark, sf_dir, "benchmark"), F.col("item_id") == F.col("vec_id"))
    return q.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding", F.lit(AS_OF).cast("timestamp").alias("as_of"))


_STOP = ", ".join(f"'{w}'" for w in text.QUESTION_WORDS)
CORPUS = f"""corpus AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 'Note ' || doc_id || ' from ' || source AS title, '/' || source || '/' || lang || '-' || doc_id || '.md' AS source_path,
  text AS content, TIMESTAMP '{AS_OF}' - to_hours(doc_id) AS effective_at, '{{"project":"' || lang || '"}}' AS metadata, doc_id % 10 <> 9 AS is_active FROM documents)"""
CHUNKS = "chunk_rows AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 'c' || doc_id AS chunk_id, text AS content, embedding FROM documents JOIN embeddings ON doc_id = vec_id)"


def _terms(q: str) -> str:
    raw = rf"list_transform(regexp_split_to_array(lower({q}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: trim(w, '_'))"
    return f"list_slice(list_filter(list_filter({raw}, lambda w: length(w) >= 3 AND w NOT IN ({_STOP})), lambda w, i: list_position(list_filter({raw}, lambda v: length(v) >= 3 AND v NOT IN ({_STOP})), w) = i), 1, 12)"


QUESTIONS = f"questions AS (SELECT item_id AS query_id, text AS query, embedding AS q_vec, {_terms('text')} AS terms FROM embeddings JOIN benchmark ON item_id = vec_id)"


def _trigrams(x: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE), 0), 0)"


def _cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    return f"{dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0)"


def _covered(x: str) -> str:
    return f"len(list_filter(terms, lambda t: contains(lower({x}), t))) / nullif(CAST(len(terms) AS DOUBLE), 0)"


RANKED = f"""{CORPUS}, {CHUNKS}, {QUESTIONS},
pairs AS (SELECT query_id, query, terms, chunk_id, c.document_id, title, source_path, c.content, effective_at, metadata, greatest(0, {_cosine("embedding", "q_vec")}) AS semantic_score
  FROM chunk_rows c JOIN corpus d ON c.document_id = d.document_id CROSS JOIN questions WHERE is_active),
gated AS (SELECT *, {_trigrams("title")} AS g_title, {_trigrams("source_path")} AS g_path, {_trigrams("query")} AS g_query FROM pairs WHERE semantic_score >= 0.05),
lexed AS (SELECT *, least(1, least(1, coalesce(0.45 * {_covered("title")} + 0.35 * {_covered("source_path")} + 0.30 * {_covered("metadata")} + 0.55 * {_covered("content")}, 0))
  + 0.45 * greatest({_jaccard("g_title", "g_query")}, {_jaccard("g_path", "g_query")})) AS lexical_score,
  exp(-0.6931471805599453 * greatest(0, date_diff('microsecond', effective_at, TIMESTAMP '{AS_OF}') / 8.64e10) / 180) AS recency_score FROM gated),
ranked AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY semantic_score DESC) AS semantic_rank, rank() OVER (PARTITION BY query_id ORDER BY round(lexical_score, 12) DESC) AS lexical_rank,
  rank() OVER (PARTITION BY query_id ORDER BY recency_score DESC) AS recency_rank FROM lexed),
fused AS (SELECT *, 0.72 / (150 + semantic_rank) + 0.13 / (150 + lexical_rank) + 0.15 / (150 + recency_rank) AS score FROM ranked),
pooled AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC, effective_at DESC) AS fused_rank FROM fused)"""
POOL = RANKED + """,
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, effective_at DESC, chunk_id) - 1 AS pool_pos FROM pooled WHERE fused_rank <= 40 OR semantic_rank <= 25 OR lexical_rank <= 25)"""
RERANKED = POOL + """,
positions AS (SELECT *, -abs(length(content) - 900) / 900.0 AS rr FROM pool),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, pool_pos) - 1 AS rp, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, pool_pos) - 1 AS sp,
  row_number() OVER (PARTITION BY query_id ORDER BY round(lexical_score, 12) DESC, pool_pos) - 1 AS lp FROM positions),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 0.5 / (20 + rp) + 0.5 / (20 + least(pool_pos, sp, lp)) DESC, pool_pos) - 1 AS final_pos FROM placed)"""


def rounded(x: Column | str, places: int) -> Column:
    """x rounded as DuckDB does it: scaled in double precision, halves away from zero. F.round() goes by the decimal digits, and so differs next to a half."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * F.lit(10.0**places)) / F.lit(10.0**places)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of each question. lexical_score is rounded, for ranks; lexical_whole is not, as a score rounded twice can end on the other side of a half."""
    cands = retrieval.candidates(chunk_table(spark, sf_dir), corpus(spark, sf_dir))
    d = retrieval.scored(cands, questions(spark, sf_dir), LOOSE, walks=False).withColumn("lexical_whole", F.col("lexical_score")).withColumn("lexical_score", rounded("lexical_score", 12))
    return retrieval.with_texts(retrieval.pooled(retrieval.fused(d, LOOSE), LOOSE.candidate_pool_chunks, LOOSE.candidate_pool_per_signal), cands)


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reranked(_pool(spark, sf_dir), -F.abs(F.length("content") - 900) / F.lit(900.0), LOOSE)


QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {POOL} SELECT query_id, chunk_id, document_id, round(semantic_score, 6) AS semantic_score, round(lexical_score, 6) AS lexical_score, round(recency_score, 6) AS recency_score, semantic_rank, lexical_rank, recency_rank, fused_rank, round(score, 9) AS score, pool_pos FROM pool")
def hybrid_search(spark, sf_dir):
    """Scores, ranks and fusion: the candidate pool of each question."""
    d = _pool(spark, sf_dir)
    ranks = [F.col(f"{x}_rank").cast("long").alias(f"{x}_rank") for x in ("semantic", "lexical", "recency", "fused")]
    return d.select("query_id", "chunk_id", "document_id", *[rounded(c, 6).alias(f"{x}_score") for x, c in (("semantic", "semantic_score"), ("lexical", "lexical_whole"), ("recency", "recency_score"))], *ranks, rounded("score", 9).alias("score"), F.col("pool_pos").cast("long").alias("pool_pos"))


@query(f"WITH {RERANKED} SELECT query_id, chunk_id, final_pos, round(rr, 6) AS rerank_score FROM final WHERE final_pos < 10")
def rerank_fusion(spark, sf_dir):
    """The pool fused with a scorer's positions (R7-R9, W5, O2); a formula stands in for the model."""
    return _reranked(spark, sf_dir).where("final_pos < 10").select("query_id", "chunk_id", F.col("final_pos").cast("long").alias("final_pos"), F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {RERANKED}, g AS (SELECT query_id, document_id, min(final_pos) AS first_pos, max(score) AS s, list(chunk_id ORDER BY final_pos) AS ids FROM final GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_pos) AS doc_rank FROM g)
SELECT query_id, document_id, doc_rank, round(s, 9) AS score, array_to_string(ids, ',') AS chunks, title, source_path, length(content) > 5000 AS truncated, length(substr(content, 1, 5000)) AS n_chars FROM r JOIN corpus USING (document_id) WHERE doc_rank <= 7""")
def pool_documents(spark, sf_dir):
    """Documents of the whole pool by first appearance."""
    d = retrieval.documents_of(_reranked(spark, sf_dir), corpus(spark, sf_dir), 7, "final_pos", s=Settings(max_full_document_chars=5000))
    return d.select("query_id", "document_id", F.col("doc_rank").cast("long").alias("doc_rank"), F.round("doc_score", 9).alias("score"), F.array_join("matched_chunk_ids", ",").alias("chunks"), "title", "source_path", "truncated", F.length("content").cast("long").alias("n_chars"))


@query()
def context_packs(spark, sf_dir):
    """De-duplicated, diverse, budgeted context of each question."""
    top = _reranked(spark, sf_dir).where("final_pos < 10")
    return retrieval.context_pack(retrieval.context_order(top, "final_pos"), 6000)


@query()
def retrieve_full(spark, sf_dir):
    """The whole of retrieval with the walking scores: cover rank and word similarity."""
    return retrieval.search_documents(chunk_table(spark, sf_dir), corpus(spark, sf_dir), questions(spark, sf_dir), 5, s=LOOSE)


@query(f"SELECT item_id, array_to_string({_terms('text')}, ' ') AS terms FROM benchmark")
def question_terms(spark, sf_dir):
    """Terms of questions."""
    return _t(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@query(f"WITH g AS (SELECT item_id, {_trigrams('text')} AS g FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round({_jaccard('a.g', 'b.g')}, 9) AS sim FROM g a JOIN g b ON b.item_id > a.item_id")
def trigram_similarity(spark, sf_dir):
    """Trigram likeness of all pairs of passages."""
    g = _t(spark, sf_dir, "benchmark").select("item_id", text.trigrams(F.col("text")).alias("g"))
    b = g.select(F.col("item_id").alias("b"), F.col("g").alias("h"))
    return g.join(b, F.col("b") > F.col("item_id")).select(F.col("item_id").alias("a"), "b", F.round(text.jaccard(F.col("g"), F.col("h")), 9).alias("sim"))


@query("""WITH g AS (SELECT sha256(text) AS h, min(doc_id) AS canonical, count(DISTINCT doc_id) - 1 AS duplicates FROM documents GROUP BY 1)
SELECT DISTINCT doc_id, canonical, duplicates, doc_id = canonical AS is_canonical FROM documents LEFT JOIN g ON sha256(text) IS NOT DISTINCT FROM h""")
def checksum_dedupe(spark, sf_dir):
    """Each document with the first of its content hash (R17, A5): counts are made before the shuffle, and no hash's ids meet in one row."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("h")).distinct()
    g = d.groupBy("h").agg(F.min("doc_id").alias("canonical"), (F.count("*") - 1).alias("duplicates"))
    return d.join(g, "h").select("doc_id", "canonical", "duplicates", (F.col("doc_id") == F.col("canonical")).alias("is_canonical"))


_OLD = "SELECT 'p' || doc_id AS p, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h, doc_id % 13 <> 0 AS is_active FROM documents WHERE doc_id % 7 <> 0"


@query(f"""WITH o AS ({_OLD}), n AS (SELECT 'p' || doc_id AS p, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(o.p, n.p) AS source_path, CASE WHEN n.p IS NULL THEN 'removed' WHEN o.p IS NULL THEN 'added' WHEN o.h = n.h AND is_active THEN 'unchanged' ELSE 'updated' END AS outcome
FROM o FULL JOIN n ON o.p = n.p WHERE n.p IS NOT NULL OR is_active""")
def snapshot_diff(spark, sf_dir):
    """What a scan finds added, updated, unchanged, removed (ST4, J7, J8, F10, S23, S25)."""
    d = _t(spark, sf_dir, "documents")
    shape = lambda x, t: x.select(F.concat(F.lit("p"), "doc_id").alias("source_path"), F.col("source").alias("title"), F.sha2(t, 256).alias("content_hash"), F.lit(AS_OF).cast("timestamp").alias("effective_at"), F.lit("{}").alias("metadata_json"), (F.col("doc_id") % 13 != 0).alias("is_active"), F.lit("f").alias("indexed_profile_hash"))
    old = shape(d.where("doc_id % 7 <> 0"), F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return ingest.snapshot_diff(old, shape(d.where("doc_id % 5 <> 0"), F.col("text"))).select("source_path", "outcome")


@query("SELECT outcome, count(*) AS n FROM (" + SQL["snapshot_diff"] + ") GROUP BY 1")
def scan_counts(spark, sf_dir):
    """Outcome counters of a scan."""
    return snapshot_diff(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {CORPUS} SELECT document_id, title, source_path, effective_at FROM corpus WHERE is_active AND metadata LIKE '%\"en\"%' AND effective_at >= TIMESTAMP '2025-12-10' ORDER BY effective_at DESC, document_id LIMIT 100")
def list_documents(spark, sf_dir):
    """Newest first, by project and date."""
    d = retrieval.list_documents(corpus(spark, sf_dir), 100, "en", F.lit("2025-12-10").cast("timestamp"))
    return d.withColumn("effective_at", F.col("effective_at").cast("timestamp_ntz"))


@query(f"WITH {CORPUS}, {CHUNKS} SELECT (SELECT count(*) FROM corpus WHERE is_active) AS documents, (SELECT count(*) FROM chunk_rows) AS chunks, (SELECT max(effective_at) FROM corpus) AS latest_document_update")
def index_status(spark, sf_dir):
    """Counts of the index."""
    d = retrieval.status(corpus(spark, sf_dir), chunk_table(spark, sf_dir))
    return d.select("documents", "chunks", F.col("latest_document_update").cast("timestamp_ntz").alias("latest_document_update"))


@query(f"""WITH {CORPUS}, {CHUNKS}, page AS (SELECT * FROM corpus ORDER BY is_active DESC, effective_at DESC, source_path LIMIT 200 OFFSET 50)
SELECT p.document_id, is_active, CAST(count(chunk_id) AS BIGINT) AS chunk_count, CAST(max(len(embedding)) AS BIGINT) AS dimensions, round(max(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS norm,
max(substr(c.content, 1, 80)) AS preview FROM page p LEFT JOIN chunk_rows c ON c.document_id = p.document_id GROUP BY 1, 2""")
def inspect_documents(spark, sf_dir):
    """A page of documents with chunks and vector summaries."""
    d = retrieval.inspect(corpus(spark, sf_dir), chunk_table(spark, sf_dir), 200, 50, 80)
    c = F.get("chunks", F.lit(0))
    return d.select("document_id", "is_active", F.col("chunk_count").cast("long").alias("chunk_count"), c["dimensions"].cast("long").alias("dimensions"), F.round(c["norm"], 6).alias("norm"), c["preview"].alias("preview"))


@query(f"WITH {CORPUS}, {CHUNKS} SELECT c.document_id, title, c.content AS text, 'chunk' AS kind FROM chunk_rows c JOIN corpus d ON c.document_id = d.document_id WHERE chunk_id = 'c42' AND is_active")
def fetch_chunk(spark, sf_dir):
    """Point lookup by URI: a document's id, else a chunk's."""
    return retrieval.fetch(chunk_table(spark, sf_dir), corpus(spark, sf_dir), "knowledge://chunks/c42").select("document_id", "title", "text", "kind")


@query(f"""WITH {RERANKED}, g AS (SELECT query_id, document_id, min(final_pos) AS p FROM final GROUP BY ALL), r AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS doc_rank FROM g),
c AS (SELECT query_id, '/src' || (query_id % 20) || '/' AS frag FROM questions WHERE query_id % 4 <> 3),
h AS (SELECT c.query_id, min(doc_rank) AS rank FROM c LEFT JOIN (r JOIN corpus USING (document_id)) x ON x.query_id = c.query_id AND contains(source_path, frag) GROUP BY 1)
SELECT count(*) AS scored, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 4) AS hit_rate, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr FROM h""")
def evaluation(spark, sf_dir):
    """Hit rate and mean reciprocal rank of all questions in one job."""
    r = retrieval.documents_of(_reranked(spark, sf_dir), corpus(spark, sf_dir), 100_000, "final_pos", content=False)
    q = questions(spark, sf_dir).select("query_id", F.col("query").alias("question"), F.when(F.col("query_id") % 4 != 3, F.array(F.concat(F.lit("/src"), F.col("query_id") % 20, F.lit("/")))).otherwise(F.array().cast("array<string>")).alias("expect"))
    return retrieval.evaluate(r, q).select("scored", "hit_rate", "mrr")


_VTT = "SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(printf('00:%02d:00.000 --> 00:%02d:30.500', turn % 60, turn % 60) || chr(10) || '<v ' || role || '>' || text, chr(10) ORDER BY turn, text) AS vtt FROM conversations GROUP BY 1"


@query(rf"""WITH v AS ({_VTT}) SELECT conv_id, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS speakers, CAST(len(list_distinct(s)) AS BIGINT) AS speaker_count,
CAST(split_part(e[-1], ':', 1) AS DOUBLE) * 3600 + CAST(split_part(e[-1], ':', 2) AS DOUBLE) * 60 + CAST(split_part(e[-1], ':', 3) AS DOUBLE) AS duration
FROM (SELECT conv_id, list_transform(regexp_extract_all(vtt, '<v\s+([^>]+)>', 1), lambda x: trim(x)) AS s, regexp_extract_all(vtt, '--> (\d\d:\d\d:\d\d\.\d\d\d)', 1) AS e FROM v)""")
def transcript_metadata(spark, sf_dir):
    """Speakers and duration of WebVTT transcripts."""
    m = F.lpad((F.col("turn") % 60).cast("string"), 2, "0")
    cue = F.concat(F.lit("00:"), m, F.lit(":00.000 --> 00:"), m, F.lit(":30.500\n<v "), "role", F.lit(">"), "text")
    v = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", cue.alias("cue")))).alias("cues"))
    vtt = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cues", lambda x: x["cue"]), "\n"))
    who = text.speakers(F.col("vtt"))
    return v.select("conv_id", vtt.alias("vtt")).select("conv_id", F.array_join(who, ",").alias("speakers"), F.size(who).cast("long").alias("speaker_count"), text.duration(F.col("vtt")).alias("duration"))


@query(f"SELECT event_id, round(exp(-0.6931471805599453 * greatest(0, date_diff('microsecond', ts, TIMESTAMP '2024-07-01') / 8.64e10) / 180), 9) AS recency FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '{AS_OF}'")
def recency_scores(spark, sf_dir):
    """Half-life of age within a date window."""
    ts = F.col("ts").cast("timestamp")
    d = _t(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") <= F.lit(AS_OF).cast("timestamp_ntz")))
    return d.select("event_id", F.round(text.recency(ts, F.lit("2024-07-01").cast("timestamp"), 180), 9).alias("recency"))


@query(r"""SELECT doc_id, sha1(n) AS sha1, CAST(greatest(1, round_even(length(text) / 4.0, 0)) AS BIGINT) AS approx_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS shingles FROM (
SELECT doc_id, text, n, CASE WHEN len(ws) < 5 THEN [n] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END AS w FROM (
SELECT *, string_split(n, ' ') AS ws FROM (SELECT doc_id, text, regexp_replace(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS n FROM documents)))""")
def normalised_shingles(spark, sf_dir):
    """Normalised text, its hash, size and 5-word shingles."""
    n = text.normalised(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha1(n).alias("sha1"), text.approx_tokens(F.col("text")).cast("long").alias("approx_tokens"), F.size(text.shingles(n)).cast("long").alias("shingles"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Given ' || doc_id WHEN doc_id % 3 = 1 THEN 'Heading ' || doc_id ELSE 'my note ' || doc_id END AS title FROM documents""")
def titles(spark, sf_dir):
    """Metadata title, else first heading, else file name."""
    i = F.col("doc_id").cast("string")
    body = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("intro\n# Heading "), i, F.lit("  \n"), "text")).otherwise(F.concat(F.lit("no heading "), F.translate("text", "#", "")))
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Given "), i))
    return _t(spark, sf_dir, "documents").select("doc_id", text.title_of(given, body, F.concat(F.lit("my_note-"), i)).alias("title"))


@query()
def chunked_documents(spark, sf_dir):
    """Overlapping chunks with offsets."""
    d = corpus(spark, sf_dir).select("document_id", "title", "content")
    return ingest.chunked(d).select("document_id", "chunk_index", "start_char", "end_char", "approx_tokens", F.sha1("content").alias("sha1"))


@query()
def embedded_chunks(spark, sf_dir):
    """Chunks with vectors and profile."""
    provider = ingest.HashEmbedding(32)
    d = ingest.embedded(ingest.chunked(corpus(spark, sf_dir).select("document_id", "title", "content")), provider, ingest.index_profile(provider)["fingerprint"])
    return d.select("document_id", "chunk_index", F.round(text.norm(F.col("embedding")), 4).alias("norm"), "embedding_profile_hash")


@query()
def page_texts(spark, sf_dir):
    """Visible text of web pages."""
    return _t(spark, sf_dir, "pages").select("page_id", search.html_to_text("html").alias("text"))


@query("""SELECT event_id, event_type, json_extract_string(props, '$.page') AS page, length(props) > 30 AS truncated, substr(props, 1, 30) AS preview FROM events""")
def json_metadata(spark, sf_dir):
    """Values out of JSON metadata, and previews."""
    return _t(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.page").alias("page"), (F.length("props") > 30).alias("truncated"), F.substring("props", 1, 30).alias("preview"))


@query("""WITH w AS (SELECT l_orderkey AS img, l_linenumber AS pos, CASE WHEN l_linenumber % 4 = 3 THEN ' ' ELSE 'w' || l_partkey END AS word, l_quantity * 2 AS conf, l_linenumber // 3 AS line FROM lineitem),
s AS (SELECT * FROM w WHERE trim(word) <> '' AND conf >= 60), l AS (SELECT img, line, string_agg(trim(word), ' ' ORDER BY pos, word) AS t, count(*) AS n FROM s GROUP BY 1, 2),
g AS (SELECT img, string_agg(t, chr(10) ORDER BY line) AS t, sum(n) AS n FROM l GROUP BY 1)
SELECT img, coalesce(CASE WHEN g.n >= 2 AND length(g.t) >= 12 THEN g.t END, '') AS text FROM (SELECT DISTINCT img FROM w) LEFT JOIN g USING (img)""")
def ocr_lines(spark, sf_dir):
    """Sure words regrouped into lines (S17, A12); order lines stand in for recognised words."""
    from ..sources.files import ocr_text

    w = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linenumber") % 4 == 3, " ").otherwise(F.concat(F.lit("w"), "l_partkey")).alias("text"),
        (F.col("l_quantity") * 2).alias("conf"), F.lit(0).alias("block_num"), F.lit(0).alias("par_num"), F.expr("l_linenumber DIV 3").alias("line_num"))
    return ocr_text(w, ["img"], 60, 2, 12)


