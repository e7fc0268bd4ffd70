"""Registered queries of the corpus operators; each reads whole tables and returns its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.llm import covertree, forest, language, lattice, licenses, manifest, packing, secrets, sharding, simhash, substrings, unigram, whitening
from cuewise.llm.common import read_table
from cuewise.llm.oracles import ORACLES  # noqa: F401  (read by the entry point)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = language.fit(docs, ~held_out)
    return language.predict(docs, model, ["doc_id", held_out.alias("held_out")]).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex16("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as byte tokens."""
    packed = packing.best_fit(read_table(spark, sf_dir, "documents"), F.octet_length("text"))
    return packed.withColumnRenamed("id", "doc_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "found.n_assign", "found.n_access", "found.n_hex", "found.base_sha256", "found.spans")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.with_counts(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again."""
    encoded = lattice.encode(read_table(spark, sf_dir, "documents"))
    restored = lattice.decoded(F.col("ids")) == F.coalesce("text", F.lit(""))
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids", restored.alias("restored"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(read_table(spark, sf_dir, "embeddings"), lambda x: F.floor(F.lit(256.0) * x), lambda i: i % 50 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the law ``bytes``: sizes of the shards are near equal."""
    placed = sharding.shard(read_table(spark, sf_dir, "documents"), shards=8)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "part", F.col("version").alias("map_version"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree per language; the witnesses are tried on lower-cased texts for a third of the ids."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(name) for name in docs.columns]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    rows = manifest.manifest(docs, F.col("doc_id"), F.col("lang"), fields, [*fields[:-1], manifest.lower_ascii(F.col("text"))], tampered)
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
                       (F.col("folded") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_token_counts, op3_nearest_neighbours, op4_simhash, op5_sentencepiece, op6_license_scan, op7_exact_top_k,
    op8_best_fit_packing, op9_secret_scan, op10_substring_dedup, op11_whitening, op12_sharding, op13_merkle_manifest)}
