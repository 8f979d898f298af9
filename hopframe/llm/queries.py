"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopframe.llm import ann, languages, licenses, lines, merkle, minhash, mixing, pii, quality, resampling, secrets
from hopframe.llm import sentencepiece, toxicity, twins
from hopframe.llm.common import documents

# The key of the registered query; a production run passes a secret of its own.
PII_KEY = "registered query"
TOXIC_SCORE = 0.3
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def checksum(id_col="doc_id"):
    """Unsigned crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def held_out(id_col="doc_id", modulus=4, rest=2):
    """Rows kept from learning, by the crc32 of the id; none without id."""
    return F.coalesce(checksum(id_col) % modulus == rest, F.lit(False))


def toxicity_lexicon(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.learn(docs, labels.where(~held_out()))


def op1_minhash(spark, sf_dir):
    """One row per document with the smallest id of its near-duplicate class."""
    return minhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")


def op2_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_lexicon(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def op3_nearest_neighbours(spark, sf_dir):
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op4_license_scans(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op5_line_dedup(spark, sf_dir):
    """The texts after removal, with the number of characters removed."""
    return lines.deduplicate(documents(spark, sf_dir).select("doc_id", "text")) \
        .withColumnRenamed("_ld_removed", "removed_chars")


def op6_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_secret_scans(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = secrets.train(secrets.labelled_samples(docs))
    return secrets.scan(docs, model)


def op8_quality_rules(spark, sf_dir):
    return quality.apply_rules(documents(spark, sf_dir))


def op9_sentencepiece(spark, sf_dir):
    return sentencepiece.encode(documents(spark, sf_dir), sentencepiece.load(PIECES))


def op10_pii(spark, sf_dir):
    return pii.pseudonymize(documents(spark, sf_dir), PII_KEY)


def op11_resampling(spark, sf_dir):
    """Every document with its weight towards the benchmark, its score and its rank among the drawn ones."""
    weighed = resampling.weigh(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return resampling.draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


def op12_merkle(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and the root that a tampered copy of it gives."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    changed = {"n_chars": F.expr("try_add(n_chars, 1L)")}
    docs = documents(spark, sf_dir).select(
        "doc_id", "lang", merkle.leaf(*[F.col(c) for c in columns]).alias("leaf"),
        F.when(checksum() % 7 == 0, merkle.leaf(*[changed.get(c, F.col(c)) for c in columns])).alias("tampered"))
    proofs = merkle.manifest(docs, keep=["tampered"])
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof_sha256"),
        merkle.fold(F.coalesce("tampered", "leaf"), "path").alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_languages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held = held_out(modulus=3, rest=1)
    model = languages.learn(docs.where(~held))
    return languages.identify(docs.select("doc_id", "text"), model) \
        .select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (
    op1_minhash, op2_toxicity, op3_nearest_neighbours, op4_license_scans, op5_line_dedup, op6_mixing, op7_secret_scans,
    op8_quality_rules, op9_sentencepiece, op10_pii, op11_resampling, op12_merkle, op13_languages)}
SQL = dict(twins.SQL)
