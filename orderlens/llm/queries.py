"""Registered queries of the operators, and the SQL of those that SQL can express.

Each query applies its operator with production parameters to the whole table and derives
the digest columns from the operator's output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.lexical_search import LEXICAL_SEARCH_SQL
from orderlens.llm.line_cleaning import LINE_CLEANING_SQL
from orderlens.session import ensure_checkpoint_dir

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.vector_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE), end_id=0).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "n_loss",
    )


def op3_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.line_cleaning import clean_lines

    return clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.simhash_vptree import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.bpe_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE), digests=True)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.html_blocks import extract_text

    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


def op7_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.graph_ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.orc_tokens import ids_crc32, read_token_orc, write_token_orc

    path = scratch_path(spark, "tokens-orc")
    write_token_orc(table(spark, sf_dir, "documents"), path, tokenizer_file(BYTE_BPE), end_id=2)
    return ids_crc32(read_token_orc(spark, path))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word, the class it belongs to and whether it is the class's first."""
    from orderlens.llm.line_dedup import line_classes

    return line_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("line_no").cast("long"), "class_doc_id", F.col("class_line_no").cast("long"), "n_copies", "first"
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
        "n_literal",
    )


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.lexical_search import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.conversation_repair import damaged, repair_conversations

    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_vector_packing": op2_vector_packing,
    "op3_line_cleaning": op3_line_cleaning,
    "op4_simhash_neardup": op4_simhash_neardup,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_html_extraction": op6_html_extraction,
    "op7_graph_ann": op7_graph_ann,
    "op8_orc_tokens": op8_orc_tokens,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_hybrid_search": op12_hybrid_search,
    "op13_conversation_repair": op13_conversation_repair,
}

# The other operators depend on a tokenizer, hashes or graphs that SQL does not have; their
# queries are tested against brute force, the libraries themselves or exact round trips.
ORACLE_SQL: dict[str, str] = {
    "op3_line_cleaning": LINE_CLEANING_SQL,
    "op12_hybrid_search": LEXICAL_SEARCH_SQL,
}
