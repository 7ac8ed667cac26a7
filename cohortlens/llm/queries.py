"""Registered queries of the numbered operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import language
from cohortlens.llm.common import ship_package, table
from cohortlens.llm.embeddings import cosine_links
from cohortlens.llm.html_extract import extract_main_text
from cohortlens.llm.oracles import COSINE_LINKS_SQL, PREFIX_TRIE_SQL, RING_SHARDS_SQL, URL_RULES, url_filter_sql
from cohortlens.llm.packing import packed_pieces
from cohortlens.llm.periodic_runs import run_columns
from cohortlens.llm.pieces import decode_column, encode_column
from cohortlens.llm.prefix_trie import conversation_trie
from cohortlens.llm.quality import quality_columns
from cohortlens.llm.sharding import ring_shards
from cohortlens.llm.simhash import hex_fingerprint, simhash_groups
from cohortlens.llm.token_counts import token_counts
from cohortlens.llm.toxicity import held_out, score_documents
from cohortlens.llm.urls import judge_urls


def op1_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null and empty html give the empty text; copies of a page get equal texts; a null
    url has no host and no template; no pages give no rows."""
    extracted = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extracted.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text. Null texts and texts without a letter are ``und``; equal cosines go to the first
    language; repeated rows get equal results; rows with a null id are predicted but teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    prototypes = language.learn_prototypes(docs, ~F.col("held_out") & F.col("doc_id").isNotNull())
    predicted = language.predict_columns(docs.select("doc_id", "held_out", "text"), prototypes)
    return predicted.select("doc_id", "held_out", "language.lang_pred", "language.score")


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors. Null, zero and non-finite vectors and null labels link with nothing; equal
    vectors link; a component is named by its smallest id; no vectors give no rows."""
    links = cosine_links(table(spark, sf_dir, "embeddings"), least=0.98)
    return links.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every text as checksums. A null text is encoded as the empty one; repeated rows get
    equal results; texts of any length are encoded whole; no documents give no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = docs.select("doc_id", encode_column(F.col("text")).alias("ids"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decode_column(F.col("ids")).cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url. A null url or one without ``://`` has no host and no path; the longest fitting rule
    wins; null html has no links; repeated rows get equal verdicts; no pages give no rows."""
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens. A null text is one end id; repeated rows are packed each;
    no documents give no rows."""
    return packed_pieces(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text. A null text has none; repeated rows get equal counts; no documents give no rows."""
    counted = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > 512).alias("over_limit"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates. Null texts and texts without words have fingerprint zero and are linked like
    others; a group is named by its smallest id, null without one; no documents give no rows."""
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text. Null and empty texts get the score of the bias; labels of repeated ids count once,
    1 before 0; a score of exactly 0.7 is predicted 1; no documents give no rows."""
    scored = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
    )


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counters and verdict of every text. Null and empty texts have no words and fail the base rule; repeated
    rows get equal results; no documents give no rows."""
    judged = quality_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "quality.*")


def op11_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards, counts at most one apart. A null text has no bytes; a null id is placed as the
    empty text; repeated rows get a slot each; equal rows are interchangeable; no documents give no rows."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = ring_shards(docs, "doc_id", shards=40, virtual_nodes=64, ties=("size", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "placed.shard", "placed.slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations. Null roles and texts are empty; rows without a conversation id
    are left out; equal turn numbers are ordered by content; no conversations give no rows."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document's words. Null and empty texts have none; a null id leaves its text as it is;
    ties go to the smaller start, then period; repeated rows get equal results; no documents give no rows."""
    found = run_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = ("start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return found.select("doc_id", F.size("periodic.runs").cast("long").alias("n_runs"), *[f"periodic.{c}" for c in best])


_RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_template_extraction,
        op2_language_profiles,
        op3_embedding_links,
        op4_sentencepiece_round_trip,
        op5_url_filters,
        op6_packed_windows,
        op7_token_counts,
        op8_simhash_groups,
        op9_toxicity,
        op10_compression_bands,
        op11_ring_shards,
        op12_prefix_trie,
        op13_periodic_runs,
    )
}


def _shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    return query


QUERIES = {name: _shipped(run) for name, run in _RUNS.items()}
ORACLES: dict[str, str] = {
    "op3_embedding_links": COSINE_LINKS_SQL,
    "op5_url_filters": url_filter_sql(URL_RULES),
    "op11_ring_shards": RING_SHARDS_SQL,
    "op12_prefix_trie": PREFIX_TRIE_SQL,
}
