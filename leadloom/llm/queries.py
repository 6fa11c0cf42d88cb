"""The operators with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.llm import (
    bpe_sql,
    chat_format,
    decontaminate,
    fingerprint,
    jaccard_join,
    katz,
    language,
    periodic_runs,
    ranked_search,
    sharding,
    substring_dedup,
    token_files,
    url_filter,
)
from leadloom.llm.tables import read
from leadloom.sources.scratch import materialize, new_path

SHARDS = 40

# The rules that pages are judged by.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def remainder(divisor: int, id_column: str = "doc_id"):
    """crc32 of the id as text, modulo ``divisor``; rows without an id have remainder 0."""
    number = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    return F.when(F.col(id_column).isNull(), 0).otherwise(number % divisor)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder(4) == 2)
    model = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    docs = read(spark, sf_dir, "documents")
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, path, ids=False)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_sql.encode_documents(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        ids=False,
    )


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), texts=False)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(read(spark, sf_dir, "documents"), remainder(5) == 1)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """``documents`` where the words of every tenth text repeat from some word on, by its id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.size("words"))
    g, n = F.floor(h / 10), F.col("n")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    root = F.slice("words", a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    periodic = F.array_join(F.concat(F.slice("words", F.lit(1), a), again), " ")
    return chosen.select("doc_id", F.when(n > 0, periodic).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_with_repeats(read(spark, sf_dir, "documents")))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    runs = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(runs.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(ranked_search.build_index(read(spark, sf_dir, "documents")), "search_index")
    return ranked_search.search(index, read(spark, sf_dir, "benchmark"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = [
        F.struct(F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("content"))
        for role in ("user", "assistant")
    ]
    one_more = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.array(*said).alias("messages"))
    turns = chat_format.canonical_turns(read(spark, sf_dir, "conversations")).unionByName(
        chat_format.canonical_turns(one_more)
    )
    written = materialize(chat_format.format_turns(turns), "conversations")
    return chat_format.digests(chat_format.read_pieces(written))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontaminate,
        op2_sharding,
        op3_language,
        op4_token_files,
        op5_bpe,
        op6_fingerprint,
        op7_url_filter,
        op8_substring_dedup,
        op9_katz,
        op10_jaccard_join,
        op11_periodic_runs,
        op12_ranked_search,
        op13_chat_format,
    )
    return {f.__name__: f for f in found}
