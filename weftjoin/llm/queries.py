"""The registered queries of this package: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftjoin.llm.support import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def url_rules() -> list:
    from weftjoin.llm.url_filter import Rule

    return [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftjoin.llm.url_filter import judge_pages

    return judge_pages(table(spark, sf_dir, "pages"), url_rules()).select("page_id", "host", "path", "rule", "verdict")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftjoin.llm.jaccard_join import jaccard_links

    return jaccard_links(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftjoin.llm.decontaminate import find_contaminated

    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftjoin.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), f"{shared_dir(spark).rstrip('/')}/token-cache")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftjoin.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftjoin.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftjoin.llm.chat_format import chat_digest, probe_conversation

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(rows.unionByName(probe_conversation(spark)))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftjoin.llm.secret_scan import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftjoin.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftjoin.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    own = [
        op1_url_filter, op2_ngram_jaccard, op3_decontamination, op4_token_counts, op5_quality, op6_packing, op7_chat_format, op8_secret_scan,
        op9_toxicity, op10_near_vectors,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from weftjoin.llm import oracles

    return {"op1_url_filter": oracles.urls(url_rules()), "op2_ngram_jaccard": oracles.JACCARD, "op7_chat_format": oracles.chat(), "op10_near_vectors": oracles.VECTORS}
