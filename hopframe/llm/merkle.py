"""Merkle manifest of a data set, with a proof for every row.

A row's leaf is the SHA-256 of its encoded columns. Per group, leaves in the order of their ids form a tree: ``fanout``
consecutive nodes become the hash of their concatenated digests, until one node, the subroot, remains; the subroots form
a tree in the same way, whose last node is the root of the data set.

A level is one slot pivot: conditional aggregates over the children of a parent spread their digests into ``fanout``
columns. The concatenated columns give the parent, and leaving out the column of the own slot gives the siblings, to the
left and to the right. ``LEVELS`` levels are climbed at a time, in blocks of consecutive nodes: the aggregates are
windows whose keys extend each other, so one shuffle and one sort serve all levels of a block. Only the blocks' tops go
on to the next round, and the paths found there come back by a join on the block, so a leaf is never shuffled with its
whole path.

Null and empty values are told apart by the encoding. A null id comes first in its group, a null group first among the
groups. Rows that repeat an id are leaves of their own, in the order of their digests. A group of one row has its leaf as
subroot, a single group its subroot as root. An empty table has no rows and no root. Columns beginning with ``_mk_`` are
reserved; only the columns asked for pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.order import with_places
from hopframe.session import materialize

# Nodes of a block: at least this many, so a block is small and there are many of them.
BLOCK = 1024
DIGITS = 256
STEP = "struct<left:string,right:string>"


def encoded(value: Column) -> Column:
    """A value as text that no other value gives: ``-`` for null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), DIGITS)


def _levels(fanout: int, nodes: int) -> int:
    """Levels over so many nodes, at least one."""
    n = 1
    while fanout ** n < nodes:
        n += 1
    return n


def climb(nodes: DataFrame, group: list[str], fanout: int, levels: int) -> DataFrame:
    """``nodes`` (group, _mk_at, _mk_n, _mk_node and more) with _mk_top and _mk_path after ``levels`` levels.

    ``_mk_at`` is a node's place in its group of ``_mk_n`` nodes. A group that is down to one node climbs no further.
    """
    above = [f"_mk_p{k}" for k in range(levels, 0, -1)]
    df = nodes.withColumns({f"_mk_p{k}": F.expr(f"_mk_at div {fanout ** k}L") for k in range(1, levels + 1)}) \
        .repartition(*group, above[0]).withColumn("_mk_p0", F.col("_mk_at")).withColumn("_mk_top", F.col("_mk_node"))
    for k in range(1, levels + 1):
        slot = F.col(f"_mk_p{k - 1}") % fanout
        parent = Window.partitionBy(*group, *above[:levels - k + 1])
        df = df.withColumns({f"_mk_c{s}": F.max(F.when(slot == s, F.col("_mk_top"))).over(parent)
                             for s in range(fanout)})
        children = [F.coalesce(F.col(f"_mk_c{s}"), F.lit("")) for s in range(fanout)]
        left = F.concat(*[F.when(slot > s, c).otherwise("") for s, c in enumerate(children)])
        right = F.concat(*[F.when(slot < s, c).otherwise("") for s, c in enumerate(children)])
        several = F.col("_mk_n") > fanout ** (k - 1)
        df = df.withColumns({
            f"_mk_s{k}": F.when(several, F.struct(left.alias("left"), right.alias("right"))),
            "_mk_top": F.when(several, F.sha2(F.concat(*children), DIGITS)).otherwise(F.col("_mk_top"))}) \
            .drop(*[f"_mk_c{s}" for s in range(fanout)])
    steps = [f"_mk_s{k}" for k in range(1, levels + 1)]
    return df.withColumn("_mk_path", F.filter(F.array(*steps), lambda s: s.isNotNull())) \
        .drop(*above, "_mk_p0", *steps)


def tree(nodes: DataFrame, group: list[str], most: int, fanout: int, name: str) -> DataFrame:
    """``nodes`` with _mk_top, the root of their group, and _mk_path, the siblings of every level up to it.

    ``most`` is the number of nodes of the largest group.
    """
    levels = _levels(fanout, min(most, BLOCK))
    size = fanout ** levels
    rounds = []
    while True:  # each round divides the nodes of a group by the size of a block
        rounds.append(materialize(climb(nodes, group, fanout, levels), name, compression="zstd"))
        most = -(-most // size)
        if most <= 1:
            break
        nodes = rounds[-1].where(F.col("_mk_at") % size == 0).select(
            *group, F.expr(f"_mk_at div {size}L").alias("_mk_at"),
            F.expr(f"(_mk_n + {size - 1}) div {size}").alias("_mk_n"), F.col("_mk_top").alias("_mk_node"))
    upper = rounds.pop()
    for lower in reversed(rounds):
        alike = " AND ".join([f"l.`{g}` <=> u.`{g}`" for g in group] + [f"l._mk_at div {size}L = u._mk_at"])
        upper = lower.alias("l").join(upper.alias("u"), F.expr(alike)).select(
            *[F.col(f"l.`{c}`") for c in lower.columns if c not in ("_mk_top", "_mk_path")], "u._mk_top",
            F.concat("l._mk_path", "u._mk_path").alias("_mk_path"))
    return upper


def manifest(leaves: DataFrame, group_col="lang", id_col="doc_id", leaf_col="leaf", keep=(), fanout=2) -> DataFrame:
    """Group, id, leaf and the columns ``keep`` of every row with subroot, root and path.

    ``path`` has a pair (left, right) of concatenated sibling digests per level, from the leaf to the root.
    """
    columns = [group_col, id_col, leaf_col, *keep]
    # Written first, since ranges are chosen from a sample: the rows behind the leaves are read once.
    digests = materialize(leaves.select(*columns), "merkle-digests")
    placed = with_places(
        digests, [F.col(group_col).asc_nulls_first(), F.col(id_col).asc_nulls_first(), F.col(leaf_col)],
        "merkle-leaves", "_mk_place")
    groups = materialize(placed.groupBy(group_col).agg(F.min("_mk_place").alias("_mk_first"),
                                                       F.count("*").alias("_mk_n")), "merkle-groups")
    count, most = groups.agg(F.count("*"), F.coalesce(F.max("_mk_n"), F.lit(0))).first()
    nodes = placed.alias("l").join(groups.alias("g"), F.expr(f"l.`{group_col}` <=> g.`{group_col}`")).select(
        *[F.col(f"l.`{c}`") for c in columns], (F.col("_mk_place") - F.col("_mk_first")).alias("_mk_at"), "_mk_n",
        F.col(f"l.`{leaf_col}`").alias("_mk_node"))
    inner = tree(nodes, [group_col], most, fanout, "merkle-groups-trees")
    tops = with_places(inner.where("_mk_at = 0").select(group_col, F.col("_mk_top").alias("_mk_node")),
                       [F.col(group_col).asc_nulls_first()], "merkle-tops", "_mk_at")
    outer = materialize(tree(tops.withColumn("_mk_n", F.lit(count)), [], count, fanout, "merkle-root-tree"),
                        "merkle-roots")
    return inner.alias("i").join(outer.alias("o"), F.expr(f"i.`{group_col}` <=> o.`{group_col}`")).select(
        *[F.col(f"i.`{c}`") for c in columns], F.col("i._mk_top").alias("subroot"), F.col("o._mk_top").alias("root"),
        F.concat("i._mk_path", "o._mk_path").alias("path"))


def proof_digest(path: str) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), DIGITS)


def fold(node: Column, path: str) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), DIGITS))
