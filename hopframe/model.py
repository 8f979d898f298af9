"""The property graph: one DataFrame per vertex label, one or more per edge label."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.session import materialize

EDGE_COLS = ("eid", "src", "dst")


@dataclass(frozen=True)
class EdgeTable:
    """Edges of one label between two vertex labels: ``eid, src, dst, <props>``.

    ``src_label``/``dst_label`` let a hop skip tables that cannot match, the way a
    partition filter skips folders. ``None`` means unknown, which is never skipped.

    ``stored`` has copies of the edges laid out for hops from either end (``src``, ``dst``):
    tables that together hold every edge once.
    """

    label: str
    df: DataFrame
    src_label: str | None = None
    dst_label: str | None = None
    stored: Mapping[str, tuple[DataFrame, ...]] | None = None

    def layout(self, end: str) -> tuple[DataFrame, ...]:
        """The tables to join on ``end``."""
        return self.stored[end] if self.stored else (self.df,)

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in EDGE_COLS]


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def aligned(frames: list[DataFrame], fixed: set[str]) -> list[DataFrame]:
    """Cast a property to STRING where tables disagree on its type."""
    types: dict[str, set[str]] = {}
    for df in frames:
        for name, dtype in df.dtypes:
            types.setdefault(name, set()).add(dtype)
    clash = {n for n, t in types.items() if len(t) > 1 and n not in fixed}
    if not clash:
        return frames
    return [df.select(*[F.col(c).cast("string").alias(c) if c in clash else F.col(c)
                        for c in df.columns]) for df in frames]


@dataclass(frozen=True)
class PropertyGraph:
    vertices: Mapping[str, DataFrame]
    edges: tuple[EdgeTable, ...]
    supernodes: DataFrame | None = field(default=None)
    salts: int = 1

    # ---- element views -------------------------------------------------
    def vertex_view(self, labels: Iterable[str] | None = None,
                    props: Iterable[str] | None = None) -> DataFrame:
        """``id, label, <props>`` over the chosen labels (all when ``None``)."""
        wanted = list(labels) if labels is not None else list(self.vertices)
        frames = []
        for label in wanted:
            df = self.vertices[label]
            keep = [c for c in df.columns if c != "id" and (props is None or c in props)]
            frames.append(df.select("id", F.lit(label).alias("label"), *keep))
        out = union_all(aligned(frames, {"id", "label"}))
        missing = [p for p in (props or ()) if p not in out.columns]
        return out.select("*", *[F.lit(None).cast("string").alias(p) for p in missing])

    def edge_tables(self, labels: Iterable[str] | None = None) -> list[EdgeTable]:
        wanted = set(labels) if labels else None
        return [t for t in self.edges if wanted is None or t.label in wanted]

    def edge_view(self, labels: Iterable[str] | None = None,
                  props: Iterable[str] | None = None) -> DataFrame:
        """``eid, label, src, dst, <props>`` over the chosen labels."""
        frames = []
        for t in self.edge_tables(labels):
            keep = [c for c in t.props if props is None or c in props]
            frames.append(t.df.select("eid", F.lit(t.label).alias("label"), "src", "dst", *keep))
        return union_all(aligned(frames, {"eid", "label", "src", "dst"}))

    # ---- traversal starts ----------------------------------------------
    def V(self, *labels: str, ids=None):
        """Start at vertices; every start vertex is its own seed."""
        from hopframe.operators.frontier import Frontier

        return Frontier.at_vertices(self, labels or None, ids)

    def E(self, *labels: str, ids=None):
        """Start at edges; every start edge is its own seed."""
        from hopframe.operators.frontier import Frontier

        return Frontier.at_edges(self, labels or None, ids)

    def seeded(self, seeds: DataFrame, labels: Iterable[str] | None = None):
        """Start from a ``seed`` (and optionally ``cur``) table."""
        from hopframe.operators.frontier import Frontier

        return Frontier.from_seeds(self, seeds, labels)

    # ---- variants -------------------------------------------------------
    def with_supernodes(self, supernodes: DataFrame, salts: int) -> PropertyGraph:
        """Salt hop joins at the listed vertices, found once and stored (see ``operators.skew``)."""
        return replace(self, supernodes=materialize(supernodes.select("id").distinct(), "supernodes"), salts=salts)

    def with_vertices(self, label: str, df: DataFrame) -> PropertyGraph:
        return replace(self, vertices={**self.vertices, label: df})

    def with_edges(self, tables: Iterable[EdgeTable]) -> PropertyGraph:
        return replace(self, edges=tuple(tables))
