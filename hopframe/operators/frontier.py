"""The frontier: traversers as rows, one hop as one equi-join.

Columns of ``Frontier.df``
    seed    where the traverser started; every operator works per seed
    cur     id of the element it stands on
    lab     label of that element
    n       multiplicity, present once ``bulk()`` was called
    path    visited ids, present once ``with_path()`` was called
    t_<x>   value remembered by ``as_(x)``
    e_<p>   edge properties, while standing on an edge
Traversers are a bag: joins keep duplicates until ``dedup()``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.model import PropertyGraph, aligned, union_all
from hopframe.operators.skew import first_per, salted_join

Predicate = Callable[[Column], Column]


def gte(x) -> Predicate:
    return lambda c: c >= F.lit(x)


def neq(x) -> Predicate:
    return lambda c: c != F.lit(x)


def _as_predicate(value) -> Predicate:
    return value if callable(value) else (lambda c: c == F.lit(value))


@dataclass(frozen=True)
class Frontier:
    graph: PropertyGraph
    df: DataFrame
    kind: str = "v"
    labels: frozenset[str] | None = None
    seeds: DataFrame | None = None
    ends: Mapping[str, frozenset[str] | None] | None = None

    # ---- starts ---------------------------------------------------------
    @staticmethod
    def at_vertices(graph, labels: Iterable[str] | None, ids=None) -> Frontier:
        labs = frozenset(labels) if labels else frozenset(graph.vertices)
        view = graph.vertex_view(sorted(labs), props=())
        if ids is not None:
            view = _restrict(view, "id", ids)
        df = view.select(F.col("id").alias("seed"), F.col("id").alias("cur"), F.col("label").alias("lab"))
        return Frontier(graph, df, "v", labs, df.select("seed"))

    @staticmethod
    def from_seeds(graph, seeds: DataFrame, labels: Iterable[str] | None = None) -> Frontier:
        labs = frozenset(labels) if labels else None
        cur = F.col("cur") if "cur" in seeds.columns else F.col("seed")
        one = F.lit(next(iter(labs))) if labs and len(labs) == 1 else F.lit(None).cast("string")
        df = seeds.select("seed", cur.alias("cur"), one.alias("lab"))
        return Frontier(graph, df, "v", labs, seeds.select("seed"))

    @staticmethod
    def at_edges(graph, labels: Iterable[str] | None, ids=None) -> Frontier:
        rows = _edge_rows(graph, graph.edge_tables(labels), "out")
        if ids is not None:
            rows = _restrict(rows, "eid", ids)
        df = rows.select(F.col("eid").alias("seed"), F.col("eid").alias("cur"), F.col("elab").alias("lab"),
                         *[c for c in rows.columns if c not in ("eid", "elab", "_key")])
        return Frontier(graph, df, "e", None, df.select("seed"))

    # ---- bookkeeping ----------------------------------------------------
    @property
    def bulked(self) -> bool:
        return "n" in self.df.columns

    @property
    def has_path(self) -> bool:
        return "path" in self.df.columns

    def _carry(self) -> list[str]:
        """Columns that travel along unchanged."""
        return ["seed", *[c for c in ("n", "path") if c in self.df.columns],
                *[c for c in self.df.columns if c.startswith("t_")]]

    def with_path(self) -> Frontier:
        return replace(self, df=self.df.withColumn("path", F.array("cur")))

    def bulk(self) -> Frontier:
        """Merge equal traversers into one row with a count."""
        if self.has_path:
            raise ValueError("a frontier with paths cannot be bulked")
        keys = [c for c in self.df.columns if c not in ("n", "lab")]
        weight = F.sum("n") if self.bulked else F.count(F.lit(1))
        return replace(self, df=self.df.groupBy(*keys).agg(F.max("lab").alias("lab"), weight.alias("n")))

    def as_(self, name: str, by: str | None = None) -> Frontier:
        """Remember the current id, or one property of the current element."""
        if by is None:
            return replace(self, df=self.df.withColumn(f"t_{name}", F.col("cur")))
        if self.kind == "e":
            return replace(self, df=self.df.withColumn(f"t_{name}", F.col(f"e_{by}")))
        return replace(self, df=self._with_prop(by).withColumnRenamed("_val", f"t_{name}"))

    def _vertex_labels(self) -> list[str]:
        return sorted(self.labels) if self.labels is not None else list(self.graph.vertices)

    def _with_prop(self, key: str, how: str = "inner") -> DataFrame:
        labels = [x for x in self._vertex_labels() if key in self.graph.vertices[x].columns]
        if not labels:
            return self.df.withColumn("_val", F.lit(None).cast("string")).filter(F.lit(how != "inner"))
        view = self.graph.vertex_view(labels, [key]).select(
            F.col("id").alias("_vid"), F.col(key).alias("_val"))
        return self.df.join(view, F.col("cur") == F.col("_vid"), how).drop("_vid")

    # ---- hops -----------------------------------------------------------
    def _hop(self, direction: str, labels: tuple[str, ...], cap: int | None = None) -> DataFrame:
        tables = self.graph.edge_tables(labels)
        keep = self._carry()
        left = self.df.select(*keep, F.col("cur").alias("_at"))
        if cap is None and self.graph.supernodes is None and any(t.stored for t in tables):
            # Stored layouts are joined one by one, since a union would hide their buckets.
            frames = _edge_frames(tables, direction, self.labels)
            if frames:
                return union_all([left.join(f, F.col("_at") == F.col("_key")) for f in frames]).drop("_at", "_key")
        rows = _edge_rows(self.graph, tables, direction, self.labels)
        if cap is not None:
            # The cap keeps the first edges of a vertex by id, the same for every traverser,
            # so it is applied to the adjacency before the join: a hub contributes at most
            # ``cap`` rows per traverser. Only vertices of the frontier are ranked.
            at = left.select(F.col("_at").alias("_key")).distinct()
            rows = first_per(rows.join(at, "_key", "left_semi"), "_key", [F.col("eid"), F.col("_side")], cap, "eid", "_nth")
        if self.graph.supernodes is not None:
            joined = salted_join(left, rows, "_at", "_key", "eid", self.graph.supernodes, self.graph.salts)
        else:
            joined = left.join(rows, F.col("_at") == F.col("_key"))
        return joined.drop("_at", "_key")

    def _to_edges(self, direction: str, labels: tuple[str, ...], cap: int | None = None) -> Frontier:
        df = self._hop(direction, labels, cap)
        if self.has_path:
            df = df.withColumn("path", F.array_append("path", F.col("eid")))
        df = df.withColumnsRenamed({"eid": "cur", "elab": "lab"})
        tables = self.graph.edge_tables(labels)
        ends = {"_far": self._far_labels(direction, labels),
                "_src": _known({t.src_label for t in tables}),
                "_dst": _known({t.dst_label for t in tables})}
        return replace(self, df=df, kind="e", labels=None, ends=ends)

    def _to_vertices(self, direction: str, labels: tuple[str, ...]) -> Frontier:
        keep = self._carry()
        df = self._hop(direction, labels)
        df = df.select(*keep, F.col("_far").alias("cur"), F.col("_flab").alias("lab"))
        if self.has_path:
            df = df.withColumn("path", F.array_append("path", F.col("cur")))
        return replace(self, df=df, kind="v", labels=self._far_labels(direction, labels))

    def _far_labels(self, direction, labels) -> frozenset[str] | None:
        found = set()
        for t in self.graph.edge_tables(labels):
            if direction in ("out", "both") and _may(self.labels, t.src_label):
                found.add(t.dst_label)
            if direction in ("in", "both") and _may(self.labels, t.dst_label):
                found.add(t.src_label)
        return _known(found)

    def out(self, *labels: str) -> Frontier:
        return self._to_vertices("out", labels)

    def in_(self, *labels: str) -> Frontier:
        return self._to_vertices("in", labels)

    def both(self, *labels: str) -> Frontier:
        return self._to_vertices("both", labels)

    def out_e(self, *labels: str, cap: int | None = None) -> Frontier:
        return self._to_edges("out", labels, cap)

    def in_e(self, *labels: str, cap: int | None = None) -> Frontier:
        return self._to_edges("in", labels, cap)

    def both_e(self, *labels: str, cap: int | None = None) -> Frontier:
        return self._to_edges("both", labels, cap)

    def _end(self, col: str, lab: str) -> Frontier:
        if self.kind != "e":
            raise ValueError("only an edge has ends")
        df = self.df.select(*self._carry(), F.col(col).alias("cur"), F.col(lab).alias("lab"))
        if self.has_path:
            df = df.withColumn("path", F.array_append("path", F.col("cur")))
        return replace(self, df=df, kind="v", labels=(self.ends or {}).get(col), ends=None)

    def in_v(self) -> Frontier:
        return self._end("_dst", "_dlab")

    def out_v(self) -> Frontier:
        return self._end("_src", "_slab")

    def other_v(self) -> Frontier:
        return self._end("_far", "_flab")

    def goto(self, targets: DataFrame, labels: Iterable[str] | None = None) -> Frontier:
        """Jump to other vertices: ``targets`` lists ``seed, id`` (an equi-join, per seed)."""
        t = targets.select(F.col("seed").alias("_s"), F.col("id").alias("_id"))
        df = (self.df.join(t, F.col("seed") == F.col("_s"))
              .select(*self._carry(), F.col("_id").alias("cur"), F.lit(None).cast("string").alias("lab")))
        if self.has_path:
            df = df.withColumn("path", F.array_append("path", F.col("cur")))
        return replace(self, df=df, kind="v", labels=frozenset(labels) if labels else None)

    def repeat(self, step: Callable[[Frontier], Frontier], times: int, emit: bool = False):
        """Exactly ``times`` steps; dead ends drop out. ``emit`` also returns shorter walks."""
        cur, seen = self, []
        for _ in range(times):
            cur = step(cur)
            seen.append(cur)
        if emit:
            return replace(cur, df=union_all([f.df for f in seen]))
        return cur

    # ---- filters --------------------------------------------------------
    def has_label(self, *labels: str) -> Frontier:
        """Filter on the label column; Catalyst drops edge tables that cannot match."""
        if self.kind == "v" and self.labels is None and _unlabelled(self.graph):
            ids = self.graph.vertex_view(labels, ()).select(F.col("id").alias("_i"))
            df = self.df.join(ids, F.col("cur") == F.col("_i"), "left_semi")
        else:
            df = self.df.filter(F.col("lab").isin(*labels))
        return replace(self, df=df, labels=frozenset(labels) if self.kind == "v" else None)

    def has(self, key: str, value) -> Frontier:
        """Property test; an absent property never passes."""
        pred = _as_predicate(value)
        if self.kind == "e":
            known = f"e_{key}" in self.df.columns
            return replace(self, df=self.df.filter(pred(F.col(f"e_{key}")) if known else F.lit(False)))
        labels = [x for x in self._vertex_labels() if key in self.graph.vertices[x].columns]
        if not labels:
            return replace(self, df=self.df.filter(F.lit(False)))
        ok = (self.graph.vertex_view(labels, [key]).filter(pred(F.col(key)))
              .select(F.col("id").alias("_i")))
        return replace(self, df=self.df.join(ok, F.col("cur") == F.col("_i"), "left_semi"))

    def has_label_key(self, label: str, key: str, value) -> Frontier:
        return self.has_label(label).has(key, value)

    def has_id(self, ids) -> Frontier:
        """One id, a list, a predicate, or a DataFrame with ``id`` or ``seed, id``."""
        if callable(ids):
            return replace(self, df=self.df.filter(ids(F.col("cur"))))
        if isinstance(ids, DataFrame) and "seed" in ids.columns:
            t = ids.select(F.col("seed").alias("_s"), F.col("id").alias("_i")).distinct()
            cond = (F.col("seed") == F.col("_s")) & (F.col("cur") == F.col("_i"))
            return replace(self, df=self.df.join(t, cond, "left_semi"))
        return replace(self, df=_restrict(self.df, "cur", ids))

    def name_contains(self, text: str, key: str = "name") -> Frontier:
        return self.has(key, lambda c: F.lower(c).contains(text.lower()))

    def _tags(self) -> list[str]:
        return [c for c in self.df.columns if c == "path" or c.startswith("t_")]

    def where(self, sub: Callable[[Frontier], Frontier | DataFrame]) -> Frontier:
        """Keep traversers for which ``sub`` reaches anything.

        Survival depends on the element, on an edge also on the end it was entered from, and on the path and the
        remembered values if the traversers have any. ``sub`` starts with them and runs once per distinct combination,
        then a semi-join filters. ``sub`` may end in rows per seed, such as ``select``.
        """
        if self.kind == "v":
            near = ["cur", "lab"]
        else:
            near = [c for c in self.df.columns if c in ("cur", "lab") or c.startswith(("_", "e_"))]
        parts = ["cur", *(["_far"] if self.kind == "e" else []), *self._tags()]
        key = F.struct(*parts) if len(parts) > 1 else F.col("cur")
        probe = self.df.select(key.alias("seed"), *near, *self._tags()).dropDuplicates(["seed"])
        reached = sub(replace(self, df=probe, seeds=probe.select("seed")))
        alive = (reached if isinstance(reached, DataFrame) else reached.df).select(F.col("seed").alias("_alive")).distinct()
        return replace(self, df=self.df.join(alive, key == F.col("_alive"), "left_semi"))

    def simple_path(self) -> Frontier:
        return replace(self, df=self.df.filter(F.size(F.array_distinct("path")) == F.size("path")))

    # ---- order, limit, dedup -------------------------------------------
    def dedup(self) -> Frontier:
        """One traverser per seed and element, of those with paths or remembered values the smallest."""
        df = self.df.drop(*[c for c in ("n",) if c in self.df.columns])
        if not self._tags():
            return replace(self, df=df.dropDuplicates(["seed", "cur"]))
        rest = [*self._tags(), *[c for c in df.columns if c not in ("seed", "cur", *self._tags())]]
        least = df.groupBy("seed", "cur").agg(F.min(F.struct(*rest)).alias("_least"))
        return replace(self, df=least.select("seed", "cur", "_least.*"))

    def limit_per_seed(self, n: int, *order: Column) -> Frontier:
        df = first_per(self.df, "seed", list(order) or [F.col("cur")], n, "cur").drop("_rn")
        return replace(self, df=df)

    # ---- projections ----------------------------------------------------
    def values(self, key: str) -> DataFrame:
        """``seed, [n, path, t_*], value``; elements without the property give no row."""
        keep = self._carry()
        if self.kind == "e":
            known = f"e_{key}" in self.df.columns
            src = self.df.withColumn("_val", F.col(f"e_{key}") if known else F.lit(None).cast("string"))
        else:
            src = self._with_prop(key)
        return (src.filter(F.col("_val").isNotNull())
                .select(*keep, F.col("_val").alias("value")))

    def value_map(self, *keys: str, tokens: bool = False, as_map: bool = False) -> DataFrame:
        """Property columns of the current elements; ``tokens`` adds id and label.

        ``as_map`` gives one map column in which every value is a one-element list.
        """
        if self.kind == "e":
            props = [c[2:] for c in self.df.columns if c.startswith("e_")]
            wanted = list(keys) or props
            df = self.df.select(*self._carry(), "cur", "lab",
                                *[F.col(f"e_{k}").alias(k) for k in wanted])
        else:
            labels = self._vertex_labels()
            wanted = list(keys) or sorted({c for x in labels for c in self.graph.vertices[x].columns} - {"id"})
            view = self.graph.vertex_view(labels, wanted).select(
                F.col("id").alias("_i"), F.col("label").alias("_l"), *wanted)
            df = (self.df.join(view, F.col("cur") == F.col("_i"))
                  .select(*self._carry(), "cur", F.col("_l").alias("lab"), *wanted))
        ids = [F.col("cur").alias("id"), F.col("lab").alias("label")] if tokens else []
        if not as_map:
            return df.select(*self._carry(), *ids, *wanted)
        entries = [F.struct(F.lit(k).alias("key"), F.array(F.col(k).cast("string")).alias("value"))
                   for k in wanted]
        present = F.filter(F.array(*entries), lambda e: F.element_at(e["value"], 1).isNotNull())
        return df.select(*self._carry(), *ids, F.map_from_entries(present).alias("value_map"))

    def element_map(self, *keys: str) -> DataFrame:
        """Flat element: id, label, (src, dst for edges), properties."""
        if self.kind == "v":
            return self.value_map(*keys, tokens=True)
        props = [c for c in self.df.columns if c.startswith("e_") and (not keys or c[2:] in keys)]
        return self.df.select("seed", F.col("cur").alias("id"), F.col("lab").alias("label"),
                              F.col("_src").alias("src"), F.col("_dst").alias("dst"),
                              *[F.col(c).alias(c[2:]) for c in props])

    def properties(self, *keys: str) -> DataFrame:
        """``seed, id, key, value`` rows; NULL properties give no row."""
        flat = self.value_map(*keys, tokens=True)
        wanted = [c for c in flat.columns if c not in (*self._carry(), "id", "label")]
        text = flat.select("seed", "id", *[F.col(c).cast("string").alias(c) for c in wanted])
        return (text.unpivot(["seed", "id"], wanted, "key", "value")
                .filter(F.col("value").isNotNull()))

    def select(self, *names: str) -> DataFrame:
        """``seed`` and the remembered values; a traverser lacking one of them gives no row."""
        return self.df.dropna(subset=[f"t_{x}" for x in names]).select("seed", *[F.col(f"t_{x}").alias(x) for x in names])

    def ids(self) -> DataFrame:
        return self.df.select(*self._carry(), F.col("cur").alias("id"), F.col("lab").alias("label"))

    def paths(self) -> DataFrame:
        return self.df.select("seed", "path")

    # ---- aggregates -----------------------------------------------------
    def _weight(self) -> Column:
        return F.sum("n") if self.bulked else F.count(F.lit(1))

    def count(self) -> DataFrame:
        """``seed, n`` for every seed; 0 where nothing is left."""
        counted = self.df.groupBy(F.col("seed").alias("_s")).agg(self._weight().alias("n"))
        return (self.seeds.distinct().join(counted, F.col("seed") == F.col("_s"), "left")
                .select("seed", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))

    def exists(self) -> DataFrame:
        """``seed, found`` for every seed."""
        alive = self.df.select(F.col("seed").alias("_s")).distinct()
        return (self.seeds.distinct().join(alive, F.col("seed") == F.col("_s"), "left")
                .select("seed", F.col("_s").isNotNull().alias("found")))

    def sum(self, key: str) -> DataFrame:
        """``seed, total``; a seed without values gives no row."""
        v = self.values(key)
        amount = F.col("value") * F.col("n") if self.bulked else F.col("value")
        return v.groupBy("seed").agg(F.sum(amount).alias("total"))

    def mean(self, key: str) -> DataFrame:
        """``seed, mean``; a seed without values gives no row."""
        v = self.values(key)
        if self.bulked:
            mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
        else:
            mean = F.avg("value")
        return v.groupBy("seed").agg(mean.cast("double").alias("mean"))

    def group_count(self) -> DataFrame:
        return self.df.groupBy("cur").agg(self._weight().alias("n")).withColumnRenamed("cur", "id")


def _restrict(df: DataFrame, col: str, ids) -> DataFrame:
    if isinstance(ids, DataFrame):
        t = ids.select(F.col("id").alias("_rid"))
        return df.join(t, F.col(col) == F.col("_rid"), "left_semi")
    if isinstance(ids, str):
        return df.filter(F.col(col) == F.lit(ids))
    return df.filter(F.col(col).isin(list(ids)))


def _known(labels: set) -> frozenset[str] | None:
    return None if None in labels else frozenset(labels)


def _may(known: frozenset[str] | None, label: str | None) -> bool:
    return known is None or label is None or label in known


def _unlabelled(graph: PropertyGraph) -> bool:
    return any(t.src_label is None or t.dst_label is None for t in graph.edges)


def _edge_frames(tables, direction: str, known: frozenset[str] | None = None) -> list[DataFrame]:
    """Edges keyed by the end the traverser stands on (``_key``), a frame per table and end; ``_far`` is the other end."""
    frames = []
    for t in tables:
        sides = []
        if direction in ("out", "both") and _may(known, t.src_label):
            sides.append(("src", "dst", t.dst_label, 0))
        if direction in ("in", "both") and _may(known, t.dst_label):
            sides.append(("dst", "src", t.src_label, 1))
        for near, far, far_label, side in sides:
            for df in t.layout(near):
                frames.append(df.select(
                    F.col(near).alias("_key"), "eid", F.lit(t.label).alias("elab"),
                    F.col("src").alias("_src"), F.col("dst").alias("_dst"),
                    F.lit(t.src_label).cast("string").alias("_slab"),
                    F.lit(t.dst_label).cast("string").alias("_dlab"),
                    F.col(far).alias("_far"), F.lit(far_label).cast("string").alias("_flab"),
                    F.lit(side).alias("_side"),
                    *[F.col(p).alias(f"e_{p}") for p in t.props]))
    return aligned(frames, {"_key", "eid", "_src", "_dst"})


def _edge_rows(graph, tables, direction: str, known: frozenset[str] | None = None) -> DataFrame:
    """All frames of ``_edge_frames`` as one."""
    frames = _edge_frames(tables, direction, known)
    if not frames:
        # No table can match: an empty relation with the right columns.
        props = sorted({p for t in tables for p in t.props})
        schema = ("_key string, eid string, elab string, _src string, _dst string, _slab string, "
                  "_dlab string, _far string, _flab string, _side int")
        base = graph.edges[0].df.sparkSession.createDataFrame([], schema)
        return base.select("*", *[F.lit(None).cast("string").alias(f"e_{p}") for p in props])
    return union_all(frames)
