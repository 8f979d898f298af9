"""Importance resampling of documents towards the distribution of target texts.

Every text becomes the array of its hashed word features. Counts of all documents and of all target texts per bucket
give a gain per bucket, an array of ``buckets`` numbers, and a document's weight is the floored mean of the gains at its
features. Weight plus a keyed Gumbel number is its score; taking the highest scores draws documents without replacement
in proportion to their importance.

The scores are written once. The cutoff is found by numeric bisection: each exact count job over the written scores
halves the range of the threshold several times at once, and a second bisection over the ids settles ties at the
threshold. Only the drawn rows are then range-partitioned and ranked. The driver sees one row of counts per job and the
gains, whose number is a parameter.

Null and empty texts have no features and weight 0. A null id is keyed as the empty text and comes last among ties. Rows
that repeat an id and its score are separate candidates, in the order of their features. An empty target gives every
bucket a target count of 0; empty tables give empty results. Long texts are one array of small numbers. Columns beginning with ``_rs_``
are reserved. All other columns pass through, except that n_features, weight, score and rank replace columns of that
name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.common import whole
from hopframe.llm.order import with_places
from hopframe.session import materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LAST_ID = (1 << 63) - 1
# Thresholds tried in one count job: four steps of a bisection.
WAYS = 16


def feature_words(text: Column) -> Column:
    """Words of the text with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), NOT_WORD), "")


def runs(words: str, least: int, most: int) -> str:
    """SQL: all runs of ``least`` to ``most`` consecutive words of an array, joined by one space."""
    if (least, most) == (1, 1):
        return words
    parts = [f"""transform(filter(sequence(1, greatest(size({words}), 1)), i -> i + {n - 1} <= size({words})),
                 i -> array_join(slice({words}, i, {n}), ' '))""" for n in range(least, most + 1)]
    return f"concat({', '.join(parts)})"


def hashed(docs: DataFrame, text_col: str, buckets: int, sizes: tuple[int, int]) -> DataFrame:
    """``docs`` with _rs_words, the number of words, and _rs_buckets, the buckets of all features."""
    listed = docs.withColumn("_rs_list", feature_words(whole(text_col)))
    return listed.select(*docs.columns, F.size("_rs_list").alias("_rs_words"), F.expr(
        f"transform({runs('_rs_list', *sizes)}, f -> CAST(crc32(CAST(f AS binary)) % {buckets} AS int))")
        .alias("_rs_buckets"))


def _counts(features: DataFrame, name: str) -> DataFrame:
    return features.select(F.explode("_rs_buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(features: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: 1000 times the log ratio of the smoothed shares in the target and in the corpus, floored."""
    every = Window.partitionBy()  # over the buckets, a fixed number
    return features.sparkSession.range(buckets).withColumnRenamed("id", "bucket") \
        .join(_counts(features, "s"), "bucket", "left").join(_counts(wanted, "t"), "bucket", "left") \
        .fillna(0, ["s", "t"]) \
        .withColumn("all_s", F.sum("s").over(every)).withColumn("all_t", F.sum("t").over(every)) \
        .select("bucket", F.expr(f"""CAST(floor(1000 * ln(
            (CAST(t AS double) + 1) * (CAST(all_s AS double) + {buckets})
            / ((CAST(s AS double) + 1) * (CAST(all_t AS double) + {buckets})))) AS bigint)""").alias("gain"))


def gumbel(id_col: str, seed: int) -> Column:
    """1000 times a standard Gumbel number that depends on seed and id alone, floored."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", target_text="text", buckets=10_000,
          sizes=(1, 1), seed=2024, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` with n_features, weight, score and _rs_words."""
    keep = docs.columns if keep is None else keep
    kept = [c for c in keep if c not in ("n_features", "weight", "score", "rank")]
    features = materialize(hashed(docs, text_col, buckets, sizes).select(*kept, "_rs_words", "_rs_buckets"),
                           "importance-features", compression="zstd")
    wanted = hashed(target.select(F.col(target_text).alias("_rs_text")), "_rs_text", buckets, sizes)
    table = {r["bucket"]: r["gain"] for r in gains(features, wanted, buckets).collect()}  # ``buckets`` rows
    array = F.split(F.lit(",".join(str(table[b]) for b in range(buckets))), ",").cast("array<bigint>")
    n = F.size("_rs_buckets").cast("long")
    total = F.aggregate("_rs_buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(array, b))
    weighed = features.select(*kept, "_rs_words", n.alias("n_features"), total.alias("_rs_total")) \
        .withColumn("weight", F.expr("IF(n_features = 0, 0L, (_rs_total - pmod(_rs_total, n_features)) div n_features)"))
    return weighed.withColumn("score", F.col("weight") + gumbel(id_col, seed)).drop("_rs_total")


def threshold(df: DataFrame, column: str, least: int) -> int | None:
    """The largest integer that at least ``least`` rows reach in ``column``, by exact counts; None if no row does."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n")).first()
    if ends["n"] < max(least, 1):
        return None
    low, high = ends["low"], ends["high"] + 1  # at least ``least`` rows reach low, fewer reach high
    while high - low > 1:
        points = sorted({low + (high - low) * k // WAYS for k in range(1, WAYS)} - {low})
        counts = df.agg(*[F.count_if(F.col(column) >= F.lit(p)).alias(f"n{i}") for i, p in enumerate(points)]).first()
        reached = [low] + [p for i, p in enumerate(points) if counts[f"n{i}"] >= least]
        missed = [p for i, p in enumerate(points) if counts[f"n{i}"] < least] + [high]
        low, high = reached[-1], missed[0]
    return low


def draw(weighed: DataFrame, percent=10, min_words=20, id_col="doc_id") -> DataFrame:
    """All rows of ``weighed`` with ``rank``: 1, 2, ... for the highest scores, null for rows that are not drawn.

    floor(percent * N / 100) of the N rows with at least ``min_words`` words are drawn; ties go to smaller ids, which
    are integers.
    """
    columns = [c for c in weighed.columns if not c.startswith("_rs_") and c != "rank"]
    table = materialize(weighed.withColumn("_rs_key", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))),
                        "importance-scores")
    pool = table.where(F.col("_rs_words") >= min_words)
    share = percent * pool.count() // 100
    cut = threshold(pool, "score", share) if share else None
    if cut is None:
        return table.select(*columns, F.lit(None).cast("long").alias("rank"))
    above = pool.where(F.col("score") > cut).count()
    # Flipping all bits turns the order round: the smallest ids become the largest numbers.
    tied = pool.where(F.col("score") == cut).select(F.bitwise_not("_rs_key").alias("_rs_flipped"))
    last = ~threshold(tied, "_rs_flipped", share - above)
    drawn = (F.col("_rs_words") >= min_words) & (
        (F.col("score") > cut) | ((F.col("score") == cut) & (F.col("_rs_key") <= F.lit(last))))
    ranked = with_places(table.where(drawn), [F.col("score").desc(), F.col("_rs_key"), F.col("n_features")],
                         "importance-ranks", "_rs_place")
    place = F.col("_rs_place") + 1  # rows that repeat the last id and its score may be more than the share
    chosen = ranked.select(*columns, F.when(place <= share, place).alias("rank"))
    return chosen.unionByName(table.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent=10, min_words=20, id_col="doc_id", **rules) -> DataFrame:
    """The drawn documents with all their columns, their weight, score and rank."""
    return draw(weigh(docs, target, id_col, **rules), percent, min_words, id_col).where("rank IS NOT NULL")
