"""Retrieval over documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources.files import load_documents
from ..sources.sinks import write_documents
from .base import query, table
from .streams import work_folder

#: Words of the generated prose that stand for the guarded ones.
WORDS = ("nce", "that", "ction")


@query("document_chunks")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R1, R2, R3] Chunks of all documents; tests hold the splitter to its rules."""
    return R.chunks(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("chunk_checks", r"""
    SELECT doc_id, true AS fit, true AS contained, true AS numbered, true AS whole, 'Introduction' AS first_section FROM documents WHERE regexp_matches(text, '\S')
""")  # fmt: skip
def chunk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R2, R3] What must hold for the chunks of each document: at most 500 characters, each stands in the text, numbered from 0 with ids of their own, nothing but white space lost; the first lies before any heading."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    solid = lambda x: F.length(F.regexp_replace(x, r"\s", ""))
    pieces = R.chunks(docs).select("doc_id", "chunk_index", "chunk_id", "section", F.col("text").alias("chunk"))
    # A text is looked through once, and no longer there when the rows of its chunks are sorted.
    joined = pieces.join(docs.select("doc_id", "text", solid("text").alias("n_text")), "doc_id").select(
        "doc_id", "chunk_index", "chunk_id", "section", F.length("chunk").alias("n_chars"), F.contains("text", "chunk").alias("inside"), solid("chunk").alias("n_chunk"), "n_text"
    )
    n = F.count(F.lit(1))
    return joined.groupBy("doc_id").agg(
        (F.max("n_chars") <= 500).alias("fit"), F.bool_and("inside").alias("contained"),
        ((F.count_distinct("chunk_id") == n) & (F.max("chunk_index") == n - 1)).alias("numbered"), (F.sum("n_chunk") >= F.max("n_text")).alias("whole"),
        F.min_by("section", "chunk_index").alias("first_section"),
    )


@query("loaded_documents", """
    SELECT 'doc_' || doc_id AS source, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'general' END AS type, length(text) AS n_chars, md5(text) AS text_md5 FROM documents WHERE doc_id IS NOT NULL AND text <> ''
""")  # fmt: skip
def loaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R1] Documents as files of a tree, loaded recursively, with source and type from their paths."""
    folder = f"{work_folder(spark)}/docs"
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL AND text <> ''")
    # 256 parts of the tree by a hash of the id: folders that are listed by many tasks, none with a large share of the files.
    part = F.lpad(F.hex(F.pmod(F.xxhash64("doc_id"), F.lit(256))), 2, "0")
    path = F.concat(part, F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    write_documents(docs.select(path.alias("path"), "text"), folder)
    loaded = load_documents(spark, folder, {"/en/": "en", "/de/": "de"})
    return loaded.select("source", "type", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


_TOP = """
    WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(cast(embedding AS DOUBLE[]), cast(q AS DOUBLE[])) AS score FROM embeddings, q),
    t AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 4)
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return R.cosine_top_k(vectors, vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


@query("cosine_top_k", _TOP + "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM t")
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R4] A stated set of queries against all vectors, exactly."""
    return _hits(spark, sf_dir).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("low_confidence", _TOP + "SELECT query_id, round(max(score), 6) AS best_score, max(score) < 0.35 AS low_confidence FROM t WHERE vec_id <> query_id GROUP BY 1")
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R5]"""
    hits = _hits(spark, sf_dir).filter("vec_id <> query_id")
    out = R.low_confidence(hits, hits.select("query_id"), threshold=0.35)
    return out.select("query_id", F.round("best_score", 6).alias("best_score"), "low_confidence")


@query("keyword_guard", "SELECT conv_id, turn, role, coalesce(lower(text) LIKE '%nce%' OR lower(text) LIKE '%that%' OR lower(text) LIKE '%ction%', false) AS off_limits FROM conversations")
def keyword_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R6]"""
    return R.guarded(table(spark, sf_dir, "conversations"), "text", WORDS).select("conv_id", "turn", "role", "off_limits")


_HISTORY = """
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations QUALIFY n <= 5),
    h AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, -n) AS context, cast(count(*) AS INTEGER) AS n_messages FROM k GROUP BY 1)
"""


@query("prompt_context", _HISTORY + "SELECT * FROM h")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R7] The last five messages of each conversation."""
    return R.history(table(spark, sf_dir, "conversations"))


@query("prompts", _HISTORY.replace("WITH", _TOP.rstrip() + ",", 1) + """,
    asked AS (SELECT conv_id, arg_max(text, (turn, role, text)) AS question FROM conversations GROUP BY 1),
    d AS (SELECT query_id AS conv_id, string_agg('[Source: ' || source || ' | Section: Introduction]' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank) AS found FROM t JOIN documents ON doc_id = vec_id GROUP BY 1)
    SELECT asked.conv_id, chr(10) || chr(10) || 'CONVERSATION HISTORY:' || chr(10) || coalesce(context || chr(10), '') || chr(10) || 'RETRIEVED CONTEXT:' || chr(10) || coalesce(found, '')
           || 'QUESTION: ' || question || chr(10) || chr(10) || 'Answer using only the context above.' AS prompt
    FROM asked LEFT JOIN h USING (conv_id) LEFT JOIN d USING (conv_id)
""")  # fmt: skip
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R7] Prompts with history and the whole texts of the four documents whose vectors are nearest to the conversation's, in order of rank."""
    talks = table(spark, sf_dir, "conversations")
    questions = talks.groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "role", "text")).alias("question"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.lit("Introduction").alias("section"), "text")
    hits = _hits(spark, sf_dir).join(texts, "vec_id").select(F.col("query_id").alias("conv_id"), "rank", "source", "section", "text")
    return R.prompts(questions, hits, R.history(talks), "conv_id")


@query("answer_route", _TOP + """,
    l AS (SELECT query_id, max(score) < 0.35 AS low FROM t WHERE vec_id <> query_id GROUP BY 1),
    g AS (SELECT conv_id, bool_or(coalesce(lower(text) LIKE '%ction%', false)) AS off FROM conversations GROUP BY 1)
    SELECT conv_id, CASE WHEN off THEN 'off_limits' WHEN coalesce(low, true) THEN 'low_confidence' ELSE 'answerable' END AS route FROM g LEFT JOIN l ON query_id = conv_id
""")  # fmt: skip
def answer_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[R8] Off limits, then low confidence, then answerable."""
    hits = _hits(spark, sf_dir).filter("vec_id <> query_id")
    low = R.low_confidence(hits, hits.select("query_id"), threshold=0.35).select(F.col("query_id").alias("conv_id"), "low_confidence")
    off = R.guarded(table(spark, sf_dir, "conversations"), "text", ("ction",)).groupBy("conv_id").agg(F.bool_or("off_limits").alias("off"))
    return off.join(low, "conv_id", "left").select("conv_id", R.route(F.col("off"), F.coalesce("low_confidence", F.lit(True))).alias("route"))
