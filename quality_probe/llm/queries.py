"""The queries of this package over the whole given tables, and their DuckDB statements."""

from pyspark.sql import DataFrame, SparkSession

from quality_probe.llm import (
    bpe,
    conversation_trie,
    lm_score,
    mixing,
    ngram_join,
    order_minhash,
    packing,
    quality,
    secrets,
    sharding,
    spelling,
    suffix_dedup,
    url_rules,
)

SHARDS = 24
TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def op1_chosen_path_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.joined(documents(spark, folder)).drop("_id")


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicated(documents(spark, folder))


def op3_guess_cost_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(documents(spark, folder), tokenizer_path())


def op4_drr_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder), tokenizer_path())


def op5_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.scored(documents(spark, folder))


def op6_pfair_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder))


def op7_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.fingerprints(documents(spark, folder))


def op8_mcd_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder))


def op9_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, folder), SHARDS)


def op10_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"))


def op11_bpe_pair_index(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), tokenizer_path(BYTE_TOKENIZER))


def op12_kd_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.grouped(documents(spark, folder))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.trie(table(spark, folder, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chosen_path_join,
        op2_suffix_dedup,
        op3_guess_cost_secrets,
        op4_drr_packing,
        op5_context_mixing,
        op6_pfair_mix,
        op7_order_minhash,
        op8_mcd_quality,
        op9_feistel_shards,
        op10_url_rules,
        op11_bpe_pair_index,
        op12_kd_spelling,
        op13_prefix_trie,
    )
}

STATEMENTS = {
    "op10_url_rules": url_rules.judge_sql(),
    "op12_kd_spelling": spelling.grouped_sql(),
    "op13_prefix_trie": conversation_trie.trie_sql(),
}
