"""The numbered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chat, codes, mixing, pii, quality, ranking, tokens, toxicity
from siltstone.llm.common import Scratch
from siltstone.llm.decontaminate import contaminated
from siltstone.llm.embeddings import near_embeddings
from siltstone.llm.labels import fold
from siltstone.llm.minhash import near_duplicates
from siltstone.llm.repeats import repeated_bytes
from siltstone.llm.urls import host_and_path, judge_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_private(docs, pii.train(docs))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op2"))


#: Both turns of conversation -1, which op3 adds: control strings inside texts.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns reach the operator as the log of a chat service (see ``chat.streamed_log``)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    read = chat.parse(chat.format_conversations(turns.unionByName(extra)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, Scratch(spark, "op4"), width=3, percent=85, bands=25, rows=5)


#: The vocabularies that op5 counts with, by tokenizer version; any .tiktoken file in a store that Spark reads will do.
VOCABULARIES = {
    "byte_bpe_multi_50k": "file:///opt/tokenizers/byte_bpe_multi_50k.tiktoken",
    "byte_bpe_50k": "file:///opt/tokenizers/byte_bpe_50k.tiktoken",
}


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus under two tokenizer versions, as a history of batches that nets out to it.

    Documents are inserted, an eighth of them as drafts with an estimated count and no language yet; the drafts are
    revised; another eighth is deleted and inserted again; and the second version's counts come in one batch. Each batch
    is sent twice, which changes nothing.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    scratch = Scratch(spark, "op5")
    first, second = VOCABULARIES
    counted = docs
    for name, path in VOCABULARIES.items():
        counted = tokens.count_tokens(counted, tokens.load_ranks(spark, path), name)
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")
    eighth = F.when(F.col("doc_id").isNotNull(), F.expr("pmod(xxhash64(doc_id), 8)")).alias("eighth")
    counted = scratch.save(counted.select("doc_id", "source", "lang", chars, eighth, *VOCABULARIES), "counted")

    exact = counted.withColumnRenamed(first, "n_tokens")
    draft = F.coalesce(F.col("eighth") == 0, F.lit(False))
    arrived = exact.withColumn("n_tokens", F.when(draft, F.expr("chars div 4")).otherwise(F.col("n_tokens")))
    arrived = arrived.withColumn("lang", F.when(~draft, F.col("lang")))
    gone = exact.where("eighth = 1")
    rollup = tokens.Rollup(spark, f"{scratch.root}/rollup")
    for _ in range(2):
        rollup.commit("arrived", arrived, first)
        rollup.commit("revised", exact.where("eighth = 0"), first)
        rollup.commit("withdrawn", gone.limit(0), first, deletes=gone)
        rollup.commit("restored", gone, first)
        rollup.commit("recounted", counted.withColumnRenamed(second, "n_tokens"), second)
    return rollup.totals()


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed hosts are the mobile mirrors, ``m.``, that the pages name."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("host")).distinct()
    judged = judge_pages(pages, hosts.where("startswith(host, 'm.')"), Scratch(spark, "op7"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.quality_scores(docs, labels, fold("doc_id", 5) != 0, Scratch(spark, "op8"), "score")
    return _scores(scored, fold("doc_id", 5) == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxicity_scores(docs, labels, fold("doc_id", 4) != 2, Scratch(spark, "op9"), "score")
    return _scores(scored, fold("doc_id", 4) == 2)


def _scores(scored: DataFrame, held_out: Column) -> DataFrame:
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compressed(table(spark, sf_dir, "embeddings"), Scratch(spark, "op11"))
    coded = coded.select("vec_id", "code", "error", "label_error")
    return coded.withColumn("codebooks_sha256", F.lit(books.sha256()))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op12"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_weak_supervision,
        op2_benchmark_decontamination,
        op3_chat_formatting,
        op4_minhash_near_dedup,
        op5_token_counts,
        op6_mixing_sources,
        op7_url_filters,
        op8_quality_classifier,
        op9_toxicity,
        op10_embedding_near_dedup,
        op11_vector_codes,
        op12_ranked_search,
        op13_repeated_passages,
    )
}
