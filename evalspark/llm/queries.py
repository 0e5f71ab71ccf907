"""One registered query per operator, with its SQL counterpart where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import bwt, debruijn, decontaminate, licenses, merkle, mixing, secrets, simhash, tokens, toxicity, urls, vectors, whitening
from evalspark.llm.common import table
from evalspark.llm.oracles import ORACLES  # noqa: F401


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    return decontaminate.contaminated(found).select("_row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")


def op8_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bwt.drop_repeats(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("_row.doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.drop_repeats(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("_row.doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    manifest = merkle.build_manifest(table(spark, sf_dir, "documents"), changed={"n_chars": more}, where=merkle.tampered())
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda p: p["digest"])), 256)
    return merkle.proofs(manifest).select(F.col("_id").alias("doc_id"), "leaf", "subroot", F.lit(manifest.root).alias("root"), proof.alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = whitening.whiten(table(spark, sf_dir, "embeddings"))
    shares = F.array(*[F.lit(float(e / made.trace)) for e in made.eigenvalues]).cast("array<double>")
    return rows.select("_id", "deviation", F.posexplode("whitened").alias("_k", "whitened")).select(
        F.col("_id").alias("vec_id"), (F.col("_k") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", F.get(shares, F.col("_k")).alias("explained"), F.lit(made.identity_error).alias("identity_error"),
    )


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "_row.doc_id", *[secrets.count_of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_urls": op2_urls,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_mixing": op6_mixing,
    "op7_vectors": op7_vectors,
    "op8_suffix_merge": op8_suffix_merge,
    "op9_debruijn": op9_debruijn,
    "op10_licenses": op10_licenses,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_secrets": op13_secrets,
}
