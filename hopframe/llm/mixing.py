"""Mixing of sources to target weights.

Targets are token counts per source: weight shares of the whole budget, none above a multiple of the source's own size,
the excess shared again by weight. The documents of a source lie in a seeded order on a token axis that is cut into
equal-token blocks; the axis is split into shards by hash, so that no task holds a whole source. Sainte-Lague
apportionment deals blocks to sources by the highest quotients target / (2k - 1), and deals the blocks of a source to
its shards in the same way. In each shard the quota is taken as whole rounds over the shard and one seeded circular
run of blocks; the run starts at a seeded place and, as the order of documents is seeded, is a random sample. Only
documents at the two ends of a run are cut. No document is taken more than ``cap`` times.

Null texts have size 0. Documents of size 0 get taken = 0. A null source is a source of its own and comes last in the
order of weights. Repeated rows are documents of their own. Tables without tokens have targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.common import whole, words
from hopframe.session import materialize


def sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """doc_id, source, size: one row per document, in words."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.size(words(whole(text_col))).cast("long").alias("size"))


def targets(per_source: DataFrame, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0) -> DataFrame:
    """source, source_size, weight, target from (source, source_size).

    ``weights`` repeat over the sources in order of code points, null last. With limits cap * size, the level v for
    which sum(min(limit, v * weight)) equals the budget is found in closed form: sources are filled in the order of
    limit / weight, and v is the level at the first source that it leaves within its limit; levels only fall after it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    budget = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    ranked = per_source.withColumn("place", F.row_number().over(by_name) - 1) \
        .withColumn("weight", F.get(listed, F.col("place") % len(weights))) \
        .withColumn("limit", cap * F.col("source_size")) \
        .withColumn("budget", budget) \
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                               / F.sum("weight").over(onward)) \
        .withColumn("free_level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level")))
                    .over(Window.partitionBy()))
    return levels.select("source", "source_size", "weight",
                         F.least("limit", F.coalesce(F.col("free_level") * F.col("weight"), F.col("limit")))
                         .alias("target"))


def sainte_lague(votes: DataFrame, group: list[str], vote: str, seats: Column, ties: list[Column]) -> DataFrame:
    """Adds ``quota``: seats dealt within each group by the highest quotients vote / (2k - 1), ties by ``ties``.

    Every party surely gets floor(share) - 1 seats at least and floor(share) + 2 at most unless votes are very uneven,
    where the method may stray further; so the deal starts from the seats above a common divisor and hands out the
    rest by rank, with as many candidate quotients per party as the group has parties left to serve.
    """
    each = Window.partitionBy(*group)
    total = votes.withColumn("_total", F.sum(vote).over(each)).withColumn("_seats", seats)
    # With divisor q every party gets floor(vote / q / 2 + 1/2) seats; q = total / (2 * (seats + parties)) deals at
    # least ``seats`` and q = total / (2 * max(seats - parties, 0)) at most ``seats``.
    parties = F.count("*").over(each)
    sure = F.greatest(F.col("_seats") - parties, F.lit(0)) / F.col("_total")
    based = total.withColumn(
        "_base", F.when(F.col("_total") > 0, F.floor(F.col(vote) * sure + 0.5 - 1e-9)).otherwise(0).cast("long")) \
        .withColumn("_base", F.greatest(F.col("_base") - 1, F.lit(0)))
    left = based.withColumn("_left", F.col("_seats") - F.sum("_base").over(each)) \
        .withColumn("_most", F.when(F.col("_total") > 0, F.least(
            F.col("_left"),
            F.ceil(F.col(vote) * (F.col("_seats") + parties) / F.col("_total") + 0.5) - F.col("_base") + 1))
            .otherwise(F.lit(0)).cast("long"))
    rows = left.withColumn("_next", F.explode_outer(F.expr(
        "CASE WHEN _most > 0 THEN sequence(1L, _most) ELSE CAST(array() AS array<bigint>) END"))) \
        .withColumn("_quotient", F.col(vote) / (2 * (F.col("_base") + F.col("_next")) - 1))
    rank = F.row_number().over(each.orderBy(F.desc_nulls_last("_quotient"), *ties))
    dealt = rows.withColumn("_won", (F.col("_next").isNotNull() & (rank <= F.col("_left"))).cast("long"))
    return dealt.groupBy(*votes.columns, "_base").agg(F.sum("_won").alias("_won")) \
        .withColumn("quota", F.col("_base") + F.col("_won")).drop("_base", "_won")


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    digest = F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3.0, 1.0, 2.0), share=1.5,
        cap=2.0, seed=7, block_tokens=32, shard_documents=5000) -> DataFrame:
    """doc_id, size, source_size, target, taken, whole_copies, cut_from, cut_to per document, plus row and source.

    ``taken = whole_copies * size + (cut_to - cut_from)``, where words cut_from (counted from 0) to cut_to of the text
    are taken once more, or, if cut_wraps, the words outside that range. ``shard_documents`` sets how many shards
    there are: about one for so many documents.
    """
    return deal(sizes(docs, id_col, text_col, source_col), weights, share, cap, seed, block_tokens, shard_documents)


def deal(sized: DataFrame, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0, seed=7, block_tokens=32,
         shard_documents=5000) -> DataFrame:
    """``mix`` for a table with doc_id, source and size; further columns are kept."""
    spark = sized.sparkSession
    stored = materialize(sized, "mix-sizes")
    n_shards = max(1, -(-stored.count() // shard_documents))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id"), F.col("size")))
    spread = stored.withColumn("order", order).withColumn(
        "shard", (F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % n_shards).cast("int"))
    shards = spread.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    per_source = shards.groupBy("source").agg(F.sum("shard_size").cast("long").alias("source_size"))
    aimed = targets(per_source, weights, share, cap).withColumn("all", F.lit(0))
    whole_seats = F.round(F.sum("target").over(Window.partitionBy("all")) / block_tokens).cast("long")
    by_source = sainte_lague(aimed, ["all"], "target", whole_seats, [F.col("source").isNull(), F.col("source")]) \
        .withColumnRenamed("quota", "source_quota").drop("all")
    to_shards = shards.alias("h").join(by_source.alias("s"), F.expr("h.source <=> s.source")) \
        .select("h.source", "shard", "shard_size", "source_size", "target", "source_quota")
    quotas = sainte_lague(to_shards, ["source"], "shard_size", F.col("source_quota"), [F.col("shard")])
    blocks = F.ceil(F.col("shard_size") / block_tokens)
    start = F.floor(unit(F.lit(str(seed)), F.coalesce("source", F.lit("\u0000")), "shard") * blocks)
    quotas = materialize(quotas.withColumn("blocks", blocks)
                         .withColumn("quota", F.least("quota", (cap * blocks).cast("long")))
                         .withColumn("rounds", F.floor(F.col("quota") / F.greatest("blocks", F.lit(1))))
                         .withColumn("extra", F.col("quota") - F.col("rounds") * F.col("blocks"))
                         .withColumn("from_block", start), "mix-quotas")
    axis = Window.partitionBy("source", "shard").orderBy("order", "doc_id")
    placed = spread.withColumn("stop", F.sum("size").over(axis.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("start", F.col("stop") - F.col("size"))
    joined = placed.alias("d").join(quotas.alias("q"), F.expr("d.source <=> q.source AND d.shard = q.shard")) \
        .select("d.*", "source_size", "target", "rounds", "shard_size",
                (F.col("from_block") * block_tokens).alias("run_start"),
                ((F.col("from_block") + F.col("extra")) * block_tokens).alias("run_stop"),
                (F.col("blocks") * block_tokens).alias("axis"))
    # The run [run_start, run_stop) may wrap round the end of the axis; its two parts then lie at either end.
    first = F.greatest(F.lit(0), F.least("stop", "run_stop") - F.greatest("start", "run_start"))
    wrapped = F.col("run_stop") - F.col("axis")
    second = F.greatest(F.lit(0), F.least(F.col("stop"), wrapped) - F.col("start"))
    both = (first > 0) & (second > 0)
    return joined.select(
        *[F.col(c) for c in sized.columns], "source_size", "target",
        (F.col("rounds") * F.col("size") + first + second).cast("long").alias("taken"),
        F.col("rounds").cast("long").alias("whole_copies"),
        F.when(both, F.lit(0)).when(first > 0, F.greatest("start", "run_start") - F.col("start"))
        .otherwise(0).cast("long").alias("cut_from"),
        F.when(both, second).when(first > 0, F.least("stop", "run_stop") - F.col("start"))
        .otherwise(second).cast("long").alias("cut_to"),
        F.when(both, F.greatest("start", "run_start") - F.col("start")).cast("long").alias("tail_from"))


def realize(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **rules) -> DataFrame:
    """The mixed documents: every column of ``docs``, a row per copy taken, texts cut where only a part is taken.

    Words keep the white space before them; a row for a part has the words of that part only. Equal rows are told apart
    by number. Columns beginning with ``_mx_`` are reserved.
    """
    alike = Window.partitionBy("_mx_id", "_mx_hash").orderBy("_mx_source")
    keyed = docs.select("*", F.col(id_col).alias("_mx_id"), F.col(source_col).alias("_mx_source"),
                        F.xxhash64(whole(text_col)).alias("_mx_hash"))
    sized = keyed.select("_mx_id", "_mx_hash", "_mx_source", F.size(words(whole(text_col))).cast("long").alias("size")) \
        .withColumn("copy", F.row_number().over(alike)) \
        .select(F.col("_mx_id").alias("doc_id"), F.col("_mx_source").alias("source"), "size",
                F.col("_mx_hash").alias("hash"), "copy")
    dealt = deal(sized, **rules).where("taken > 0")
    dealt = dealt.select(*[F.col(c).alias(f"_mx_m_{c}") for c in dealt.columns])
    joined = keyed.withColumn("_mx_copy", F.row_number().over(alike)).join(
        dealt, F.expr("_mx_id <=> _mx_m_doc_id AND _mx_hash = _mx_m_hash AND _mx_copy = _mx_m_copy"))
    copies = joined.withColumn("_mx_k", F.explode(F.expr(
        "sequence(1L, _mx_m_whole_copies + CAST(_mx_m_cut_to > _mx_m_cut_from OR _mx_m_tail_from IS NOT NULL AS INT))")))
    tokens = rf"regexp_extract_all(`{text_col}`, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)"
    text = F.expr(f"""CASE WHEN _mx_k <= _mx_m_whole_copies
        OR (_mx_m_tail_from IS NULL AND _mx_m_cut_to - _mx_m_cut_from = _mx_m_size) THEN `{text_col}`
        ELSE array_join(concat(
            slice({tokens}, CAST(_mx_m_cut_from AS INT) + 1, CAST(_mx_m_cut_to - _mx_m_cut_from AS INT)),
            CASE WHEN _mx_m_tail_from IS NULL THEN CAST(array() AS array<string>)
                 ELSE slice({tokens}, CAST(_mx_m_tail_from AS INT) + 1, CAST(_mx_m_size AS INT)) END), '') END""")
    return copies.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
