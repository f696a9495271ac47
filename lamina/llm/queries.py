"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decision_list, merkle, mixing, packing, pagediff, rulefit, search, secret_scan, sharding, simhash, telephony, toxicity, whitening
from .sql import ORACLE
from .text_stats import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(divisor: int, rest: int) -> Column:
    """Whether a row's labels are kept from fitting; a null id has no label, so false."""
    return F.coalesce(remainder(F.col("doc_id"), divisor) == rest, F.lit(False)).alias("held_out")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_target_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"])
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "sampled")


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = telephony.store_texts(table(spark, sf_dir, "documents"))
    read = stored.select("doc_id", "n_bytes", telephony.read_back(F.col("media")).alias("r")).select("doc_id", "n_bytes", "r.*")
    # the resampled sound is stored beside it, with its own size and digest
    digests = [F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256")]
    return read.select(*[c for c in read.columns if c != "pcm"], *digests, "pcm")


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract_pages(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secret_scan.spelled(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.spelled(F.col("spans")).alias("spans"),
    )


def op7_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.stratified_shards(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op8_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels, where=remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out(5, 0), "score", "predicted")


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ensemble = rulefit.fit(documents, labels, where=remainder(F.col("doc_id"), 3) != 1)
    scored = rulefit.apply_ensemble(documents, ensemble)
    return scored.select("doc_id", held_out(3, 1), "score", "predicted")


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = decision_list.fit(documents, labels)
    checked = decision_list.apply_rules(documents, rules)
    return checked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = remainder(F.col("doc_id"), 3) == 0
    made = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
