"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import oracles
from quarry.llm._spark import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.substring_dedup import substring_dedup

    rows = substring_dedup(documents(spark, sf_dir, "doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_model import classify

    docs, labels = documents(spark, sf_dir, "doc_id", "text", "source", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from quarry.llm.token_files import read_token_files, write_token_files

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    files = write_token_files(documents(spark, sf_dir, "doc_id", "text"), tokenizer, end_id=2)
    rows = read_token_files(spark, files)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.language_id import held_out, identify, train

    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    fold = held_out(F.col("doc_id"))
    dictionaries = train(docs.filter(~fold & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", "text"), dictionaries).select("doc_id", fold.alias("held_out"), "lang_pred", "score", "rejected")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.html_extraction import extract_pages

    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_rules import quality_rules

    rows = quality_rules(documents(spark, sf_dir, "doc_id", "text", "lang"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.sharding import shard

    rows = shard(documents(spark, sf_dir, "doc_id", "text"), 16)
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return rows.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import mix

    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), tell=True)
    return rows.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "copy", "n_copies")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontamination import find_contained

    return find_contained(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_model, op3_token_files, op4_language_id, op5_html_extraction, op6_decontamination, op7_sharding, op8_quality_rules, op9_mixing, op10_near_dedup)}
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": oracles.OP1, "op6_decontamination": oracles.OP6, "op8_quality_rules": oracles.OP8, "op9_mixing": oracles.OP9, "op10_near_dedup": oracles.OP10}
