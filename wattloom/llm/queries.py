"""One registered query per operator, each over its whole table."""

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import (
    chat, decontaminate, language_id, licenses, ngram_join, packing, quality_model, quality_rules, sharding, spelling,
    token_counts, vector_codes, warc,
)
from wattloom.llm.shipping import ship
from wattloom.runtime import scratch_path
from wattloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return fn(spark, folder)

    _QUERIES[fn.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and risk-controlled rules over all documents."""
    path = scratch_path(spark, "text-statistics")
    documents = table(spark, folder, "documents").select("doc_id", F.col("text").alias("_text"))
    quality_rules.text_statistics(documents, "_text").drop("_text").write.parquet(path)
    statistics = spark.read.parquet(path)
    judged = quality_rules.judge(
        statistics, quality_rules.find_cutoffs(statistics, table(spark, folder, "labels")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", F.array_join(F.array_sort("rejected_by"), ",").alias("rules"))


@query
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are 85 % alike."""
    join = ngram_join.Join(width=4, per_cent=85)
    return ngram_join.ngram_components(table(spark, folder, "documents"), join=join)


def fold(doc: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % folds


@query
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from labels outside the held-out fold."""
    documents = table(spark, folder, "documents")
    model = quality_model.learn(documents, table(spark, folder, "labels"), fold("doc_id", 4) != 2)
    scored = quality_model.score_documents(documents, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one made of control strings, read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                    "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_conversations(rows.unionByName(planted))
    read = formatted.withColumns({
        "turns": chat.read_turns(F.col("formatted")),
        "loss": chat.masked_text(F.col("formatted"), F.col("loss_spans"))})
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain benchmark items, with the share of the item's shingles."""
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from documents outside the held-out fold."""
    documents = table(spark, folder, "documents")
    model = language_id.learn(documents, "doc_id", "text", "lang", fold("doc_id", 5) != 0)
    found = language_id.predict(documents.select("doc_id", "text"), "text", model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"),
                        "lang_pred", "score")


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    placed = sharding.shard_documents(table(spark, folder, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def byte_bpe_50k() -> dict[str, str]:
    return {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def byte_bpe_50k_with_added() -> dict:
    """The vocabulary as the tokenizer file ``byte_bpe_50k.json`` applies it by default."""
    return {**byte_bpe_50k(), "added": packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))}


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    packed = packing.pack_documents(table(spark, folder, "documents"), **byte_bpe_50k_with_added())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives with revisit records, and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.resolve_revisits(table(spark, folder, "pages")), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of whole documents and the notices inside them."""
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors in four codebooks of 256 entries after four rounds."""
    return vector_codes.vector_codes(table(spark, folder, "embeddings"))


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents, some with planted typos, and the form that it is a variant of."""
    return spelling.group_variants(table(spark, folder, "documents"), typo_every=97)


@query
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, by pieces of distinct pre-tokens."""
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
