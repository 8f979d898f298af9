"""The corpus pipeline: from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next one. All stages but the last return the columns of documents, whatever further columns those have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.llm import lines, minhash, mixing, sentencepiece, toxicity
from hopframe.llm.common import documents, whole
from hopframe.llm.queries import PIECES, TOXIC_SCORE, toxicity_lexicon
from hopframe.session import materialize

# Character models, sampling and n-gram hashes of the stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def _with_length(docs: DataFrame, changed) -> DataFrame:
    """n_chars brought up to date where ``changed`` holds, if there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the limit.

    Null and empty texts and texts without a hit stay; rows that are repeated are judged alike.
    """
    lexicon = toxicity_lexicon(spark, docs, sf_dir)
    scored = toxicity.score(docs, lexicon, keep=docs.columns, names=("_tx_weight", "_tx_score"))
    return scored.where(F.col("_tx_score") < TOXIC_SCORE).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated multi-line chunks; a document that loses all its words that way goes.

    Null and empty texts have no chunks and stay. Rows equal in id and text are one document and keep the same text.
    """
    left = lines.deduplicate(docs)
    changed = F.col("_ld_removed") > 0
    kept = left.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _with_length(kept, changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class, the one with the smallest id.

    Texts without a word, null ones included, are classes of their own and stay. Of rows equal in id and text one stays.
    """
    first = materialize(minhash.near_duplicates(docs).where("is_first")
                        .select(F.col("doc_id").alias("_nd_id"), F.col("text_hash").alias("_nd_hash")).distinct(),
                        "near-first")
    kept = docs.withColumn("_nd_own", F.xxhash64(whole("text"))).join(
        first, F.expr("doc_id <=> _nd_id AND _nd_own = _nd_hash"))
    # Rows that repeat id and text are one document.
    alike = Window.partitionBy("_nd_id", "_nd_hash").orderBy("_nd_id")
    return kept.withColumn("_nd_copy", F.row_number().over(alike)).where("_nd_copy = 1").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row per copy, cut at the ends of a run.

    Texts without a word have size 0 and are never taken. Repeated rows are separate documents. Null sources are one source.
    """
    mixed = mixing.realize(docs)
    return _with_length(mixed, F.lit(True)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip, parity; null and empty texts have no ids, repeated rows the same ones."""
    return sentencepiece.encode(docs, sentencepiece.load(PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
