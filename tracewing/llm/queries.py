"""The registered query of each operator: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, contamination, exact, near, negatives, pieces, pii, secrets, structure, toxicity, urls, warc
from .tables import spans_text, table

ALLOW = (("com", "/"), ("www.example.com", "/en/"))
BLOCK = (("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"))
#: Host labels of advertising, gambling and the like; the URLs of pages on such hosts are the list that op3 tests against.
UNWANTED = r"(^|\.)(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)\."


def _span_columns(kinds: tuple[str, ...]) -> list[Column]:
    """Counts and digests of a ``spans`` column of (begin, place, kind, end)."""

    def of(*names: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*names))

    return [
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in kinds],
        F.sha2(spans_text(of(*kinds)), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    ]


def held_out(key: str) -> Column:
    """Rows that no label may be learnt from; never null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, ~held_out("id"))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_span_columns(secrets.BASE))


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    ordered = F.transform(
        "spans",
        lambda s: F.struct(
            s["begin"], F.array_position(F.lit(list(pii.KINDS)), s["kind"]).alias("place"), s["kind"], s["end"]
        ),
    )
    return found.withColumn("spans", ordered).select("doc_id", *_span_columns(pii.BASE))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(urls.host(F.col("url")).rlike(UNWANTED)).select("url")
    judged = urls.judge(pages.select("page_id", "url"), listed, ALLOW, BLOCK)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_components(table(spark, sf_dir, "documents"), size=3, numerator=85, denominator=100)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.exact_groups(docs, digests=True)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults by a hash of conversation and turn; nulls of role, text and the hashed key are one space."""

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("said", ".!?", "")).otherwise(F.col("said"))
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("said"), fault.alias("fault"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return rows.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(True), times)).alias("copy"),
    )


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repair = structure.Repair(damaged(turns))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    audits = structure.digests(repair.edits).withColumnRenamed("conv", "of_conv")
    every = turns.select("conv_id").distinct()
    met = every.join(repair.conversations, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    met = met.join(audits, F.col("conv_id").eqNullSafe(F.col("of_conv")), "left")
    return met.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("id") % 100 == 0)


def sentencepiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trip(table(spark, sf_dir, "documents"), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity_scores,
    "op2_byte_bpe": byte_bpe,
    "op3_url_filter": url_filter,
    "op4_warc_revisits": warc_revisits,
    "op5_secret_scan": secret_scan,
    "op6_chat_format": chat_format,
    "op7_near_duplicates": near_duplicates,
    "op8_exact_dedup": exact_dedup,
    "op9_benchmark_passages": benchmark_passages,
    "op10_personal_data": personal_data,
    "op11_conversation_repair": conversation_repair,
    "op12_hard_negatives": hard_negatives,
    "op13_sentencepiece": sentencepiece_ids,
}
