"""The registered queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_main, line_dedup, mixing, nbsvm, probminhash, quality_rules, repair, sketches, token_store, warc, whitening
from .common import fresh_dir


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "warc")
    index = warc.write_warc(table(spark, sf_dir, "pages"), root)
    return warc.read_warc(index, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    scored = nbsvm.score(docs, model).select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", *(F.col(f"quality_measures.{x}") for x in quality_rules.BASE), "base_failed", "kept")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    made = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids"), path)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "tokens")
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), root, tokenizer_path())
    return token_store.read_tokens(manifest, root, with_ids=False)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.size("copies").alias("n_copies"), F.get("copies", F.lit(0))["position"].alias("first_position"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model) if len(model.eigenvalues) else 0.0
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)).cast("array<double>")
    rows = whitening.transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "at").alias("explained"), F.lit(error).alias("identity_error"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair_digest(conversations, repair.damage(conversations))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_warc, op2_quality_classifier, op3_quality_rules, op4_bpe, op5_token_store, op6_chat_formatting, op7_mixing, op8_near_duplicates, op9_html_extraction, op10_fingerprints, op11_whitening, op12_repair, op13_line_dedup)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}
