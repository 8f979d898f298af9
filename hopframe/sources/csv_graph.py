"""Typed-header CSV folders in, CSV folders out."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopframe.model import EdgeTable, PropertyGraph, aligned, union_all
from hopframe.operators.skew import split_copies
from hopframe.session import fresh_path
from hopframe.sources.checks import resolve_duplicates, validate

# Property type names of the CSV headers.
TYPES = {
    "int": "int", "integer": "int", "long": "bigint", "double": "double", "bool": "boolean",
    "boolean": "boolean", "string": "string", "date": "date",
}
SYSTEM = ("~id", "~label", "~from", "~to")
FILE_ROWS = 1_000_000  # files with line breaks are read whole by one task
# An empty cell is NULL and a quoted empty cell the empty text; outer spaces are part of a value.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "enforceSchema": "false", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "columnPruning": "false"}
# Header type of text whose line breaks and backslashes are written as a backslash and a letter.
ESCAPED = "escaped"
ESCAPES = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))


@dataclass(frozen=True)
class Column_:
    """One header cell: stored name, Spark type, original text."""

    name: str
    dtype: str
    raw: str
    escaped: bool = False


def parse_header(cell: str, overrides: Mapping[str, str] | None = None) -> Column_:
    """``name``, ``name:type`` or ``name:elem:list``; system columns drop any type suffix but ``escaped``."""
    parts = cell.strip().split(":")
    name = parts[0]
    if parts[1:] == [ESCAPED]:
        return Column_(name, "string", cell, True)
    if name in SYSTEM:
        return Column_(name, "string", cell)
    if overrides and name in overrides:
        return Column_(name, overrides[name], cell)
    kinds = [p.lower() for p in parts[1:]]
    if not kinds:
        return Column_(name, "string", cell)
    if len(kinds) == 2 and kinds[1] == "list" and kinds[0] in TYPES:
        return Column_(name, f"array<{TYPES[kinds[0]]}>", cell)
    if len(kinds) == 1 and kinds[0] in TYPES:
        return Column_(name, TYPES[kinds[0]], cell)
    raise ValueError(f"header {cell!r}: unknown type (lists must hold one scalar type)")


def escape(text: Column) -> Column:
    """Text on one line; ``unescape`` gives it back."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    # Every backslash begins a code and the one for the backslash is resolved last, so no code is made by another.
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def typed(text: Column, dtype: str) -> Column:
    """Text to ``dtype``; NULL if not convertible. Text stays as it is."""
    if dtype == "string":
        return text
    blank = F.trim(text) == ""
    if dtype.startswith("array<"):
        # Lists written by other tools may use single quotes and capitalised booleans.
        body = F.lower(text) if dtype == "array<boolean>" else text
        return F.when(~blank, F.from_json(body, dtype, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}))
    if dtype == "date":
        return F.when(~blank, F.try_to_date(F.trim(text), "yyyy-MM-dd"))
    return F.when(~blank, F.trim(text).try_cast(dtype))


@dataclass(frozen=True)
class Loaded:
    """One folder: its rows with ``_raw``, the text of a row that is rejected, else NULL."""

    folder: str
    parsed: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.parsed.filter(F.col("_raw").isNull()).drop("_raw")

    @property
    def rejected(self) -> DataFrame:
        return self.parsed.filter(F.col("_raw").isNotNull()).select(F.lit(self.folder).alias("folder"), F.col("_raw").alias("raw"))

    def stored(self) -> Loaded:
        """The same, parsed and written once, one folder per label."""
        spark = self.parsed.sparkSession
        path = fresh_path(spark, "loaded")
        rejected = F.col("_raw").isNotNull()
        parts = self.parsed.withColumns({"_rejected": rejected, "~label": F.when(~rejected, F.col("~label"))})
        parts.write.partitionBy("_rejected", "~label").parquet(path)
        schema = T.StructType([*self.parsed.schema.fields, T.StructField("_rejected", T.BooleanType())])
        table = spark.read.schema(schema).parquet(path)
        good = table.filter(~F.col("_rejected")).select(*[c for c in self.parsed.columns if c != "_raw"])
        return Stored(self.folder, table, good)


@dataclass(frozen=True)
class Stored(Loaded):
    """A parsed folder in Parquet; labels and rejected rows are folders of it."""

    good: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.good


def leaf_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders below ``root`` (any file system Spark reads) that directly hold files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    hidden = F.col("path").rlike("/[._][^/]*$")
    return sorted(r[0] for r in files.where(~hidden).select(folder).distinct().collect())


def read_folder(spark: SparkSession, folder: str, required: tuple[str, ...],
                overrides: Mapping[str, str] | None = None, multi_line: bool = True) -> Loaded:
    """One folder of CSV files with a common header, bound by name.

    All files of a folder must carry the header of the first; Spark refuses the file
    otherwise instead of binding by position. Rows with too many or too few fields are
    rejected. ``multi_line=False`` lets Spark split large files, for files whose values
    hold no line breaks; files with ``escaped`` columns never do and are always split.
    """
    # An empty cell is read as this mark and then NULL; made up for each read, it is the text of no cell.
    options = {**CSV_OPTIONS, "nullValue": f"\u0001{uuid.uuid4().hex}"}
    header = spark.read.options(**options, multiLine="true", inferSchema="false").csv(folder).columns
    cols = [parse_header(c, overrides) for c in header]
    options["multiLine"] = str(multi_line and not any(c.escaped for c in cols)).lower()
    names = [c.name for c in cols]
    missing = [r for r in required if r not in names]
    if missing:
        raise ValueError(f"{folder}: header lacks {missing}")
    schema = T.StructType([T.StructField(c.raw, T.StringType()) for c in cols] +
                          [T.StructField("_malformed", T.StringType())])
    raw = spark.read.options(**options).schema(schema).csv(folder)
    raw = raw.toDF(*[f"c{i}" for i in range(len(cols))], "_malformed")
    bad = F.col("_malformed").isNotNull()
    for i, c in enumerate(cols):
        if c.name in required:
            bad = bad | F.col(f"c{i}").isNull() | (F.trim(f"c{i}") == "")
        elif c.dtype != "string":
            given = F.col(f"c{i}").isNotNull() & (F.trim(f"c{i}") != "")
            bad = bad | (given & typed(F.col(f"c{i}"), c.dtype).isNull())
    bad = F.coalesce(bad, F.lit(True))
    out = [(unescape(F.col(f"c{i}")) if c.escaped else typed(F.col(f"c{i}"), c.dtype)).alias(c.name)
           for i, c in enumerate(cols)]
    # Rows without a label take the name of their folder.
    own = F.lit(re.sub(r"/+$", "", folder).rsplit("/", 1)[-1])
    if "~label" in names:
        given = out.pop(names.index("~label"))
        own = F.when(F.trim(given) != "", given).otherwise(own)
    out.append(own.alias("~label"))
    cells = F.to_json(F.map_from_arrays(F.array(*[F.lit(c.name) for c in cols]),
                                        F.array(*[F.col(f"c{i}") for i in range(len(cols))])))
    return Loaded(folder, raw.select(*out, F.when(bad, F.coalesce("_malformed", cells)).alias("_raw")))


def read_vertices(spark, root: str, overrides=None, multi_line: bool = True) -> list[Loaded]:
    return [read_folder(spark, f, ("~id",), overrides, multi_line) for f in leaf_folders(spark, root)]


def read_edges(spark, root: str, overrides=None, multi_line: bool = True) -> list[Loaded]:
    return [read_folder(spark, f, ("~from", "~to"), overrides, multi_line) for f in leaf_folders(spark, root)]


def _census(parts: list[Loaded]) -> list[tuple[str, str, int, int]]:
    """(folder, label, good rows, rejected rows) of all folders in one job.

    The result is a handful of rows; it gives both the label names and the load report.
    """
    if not parts:
        return []
    frames = []
    for p in parts:
        name = re.sub(r"/+$", "", p.folder).rsplit("/", 1)[-1]
        label = F.when(F.col("_raw").isNull(), F.col("~label")).otherwise(F.lit(name)).alias("label")
        frames.append(p.parsed.groupBy(F.lit(p.folder).alias("folder"), label).agg(
            F.count_if(F.col("_raw").isNull()).alias("ok"), F.count("_raw").alias("bad")))
    return [tuple(r) for r in union_all(frames).collect()]


def _by_label(parts: list[Loaded], census) -> dict[str, DataFrame]:
    out: dict[str, list[DataFrame]] = {}
    for p in parts:
        labels = [label for folder, label, ok, _ in census if folder == p.folder and ok]
        for label in labels:
            rows = p.rows if len(labels) == 1 else p.rows.filter(F.col("~label") == label)
            out.setdefault(label, []).append(rows.drop("~label"))
    return {label: union_all(aligned(frames, set())) for label, frames in out.items()}


def with_edge_ids(rows: DataFrame, label: str) -> DataFrame:
    """Add ``eid = label # hash of all columns # copy number``.

    Identical rows are counted (combined map-side) and expanded again, which numbers them
    without gathering a group of copies in one task.
    """
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    numbered = split_copies(counted, "_copies", "_copy")
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    eid = F.concat_ws("#", F.lit(label), F.sha2(text, 256), F.col("_copy").cast("string"))
    return numbered.select(eid.alias("eid"), *cols)


def load(spark: SparkSession, vertices_root: str, edges_root: str, duplicates: str = "fail",
         overrides: Mapping[str, str] | None = None,
         endpoints: Mapping[str, tuple[str, str]] | None = None,
         multi_line: bool = True, rejects: str | None = None, validated: bool = False) -> tuple[PropertyGraph, DataFrame]:
    """Load a folder tree; returns the graph and the per-stage report.

    Every file is parsed once: a folder is written by label, and graph, counts and rejected rows come from there.
    ``endpoints`` optionally names the vertex labels an edge label connects, which lets
    hops skip edge tables. ``rejects`` is a folder for the rejected rows (folder, raw). ``validated`` adds the stages of
    ``checks.validate`` to the report: rows whose id repeats and edges without both ends count as rejected there, but
    are kept.
    """
    vparts = [p.stored() for p in read_vertices(spark, vertices_root, overrides, multi_line)]
    eparts = [p.stored() for p in read_edges(spark, edges_root, overrides, multi_line)]
    vcensus, ecensus = _census(vparts), _census(eparts)
    if rejects is not None and vparts + eparts:
        union_all([p.rejected for p in vparts + eparts]).write.json(rejects)
    loaded = {label: df.withColumnRenamed("~id", "id") for label, df in _by_label(vparts, vcensus).items()}
    vertices = {label: resolve_duplicates(df, duplicates) for label, df in loaded.items()}
    edges = []
    for label, df in _by_label(eparts, ecensus).items():
        plain = df.withColumnsRenamed({"~from": "src", "~to": "dst"})
        src_label, dst_label = (endpoints or {}).get(label, (None, None))
        edges.append(EdgeTable(label, with_edge_ids(plain, label), src_label, dst_label))
    g = PropertyGraph(vertices, tuple(edges))
    report = load_report(spark, vcensus, ecensus)
    if validated and (vertices or edges):
        counted = report.groupBy("label").agg(F.sum("rows_ok").alias("rows_in"))
        found = validate(PropertyGraph(loaded, tuple(edges))).join(counted, "label")
        report = report.unionByName(found.select("stage", "label", "rows_in", (F.col("rows_in") - F.col("problems"))
                                                 .alias("rows_ok"), F.col("problems").alias("rows_rejected")))
    return g, report


def load_report(spark: SparkSession, vcensus, ecensus) -> DataFrame:
    """``stage, label, rows_in, rows_ok, rows_rejected``."""
    total: dict[tuple[str, str], list[int]] = {}
    for stage, census in (("vertices", vcensus), ("edges", ecensus)):
        for _, label, ok, bad in census:
            row = total.setdefault((stage, label), [0, 0])
            row[0] += ok
            row[1] += bad
    return spark.createDataFrame([(s, x, ok + bad, ok, bad) for (s, x), (ok, bad) in total.items()],
                                 "stage string, label string, rows_in bigint, rows_ok bigint, rows_rejected bigint")


def infer_endpoints(g: PropertyGraph) -> PropertyGraph:
    """Split each edge table by the vertex labels found at its ends: one join per end and one write by label pair."""
    labels = g.vertex_view(None, ()).select(F.col("id").alias("_v"), F.col("label").alias("_lab"))
    tables = []
    for t in g.edges:
        tagged = (t.df.join(labels.withColumnsRenamed({"_v": "_s", "_lab": "_sl"}), F.col("src") == F.col("_s"))
                  .join(labels.withColumnsRenamed({"_v": "_d", "_lab": "_dl"}), F.col("dst") == F.col("_d")))
        tagged = tagged.select(*t.df.columns, "_sl", "_dl")
        path = fresh_path(tagged.sparkSession, "edges")
        tagged.write.partitionBy("_sl", "_dl").parquet(path)
        stored = tagged.sparkSession.read.schema(tagged.schema).parquet(path)
        for row in stored.select("_sl", "_dl").distinct().orderBy("_sl", "_dl").collect():  # pairs of labels
            part = stored.filter((F.col("_sl") == row["_sl"]) & (F.col("_dl") == row["_dl"]))
            tables.append(EdgeTable(t.label, part.select(*t.df.columns), row["_sl"], row["_dl"]))
    return g.with_edges(tables)


# ---- sink ------------------------------------------------------------------

_SUFFIX = {"int": "int", "bigint": "long", "double": "double", "boolean": "bool", "date": "date",
           "string": "string"}


def header_cell(name: str, dtype: str) -> str:
    if dtype.startswith("array<"):
        return f"{name}:{_SUFFIX[dtype[6:-1]]}:list"
    return f"{name}:{_SUFFIX.get(dtype, 'string')}"


def _csv_ready(df: DataFrame, fixed: dict[str, str], label: str, escaped: bool) -> DataFrame:
    def text(c: Column, cell: str) -> Column:
        return escape(c).alias(f"{cell.split(':')[0]}:{ESCAPED}") if escaped else c.alias(cell)

    cols = [text(F.col(c), h) for c, h in fixed.items()] + [F.lit(label).alias("~label")]
    for name, dtype in df.dtypes:
        if name in fixed or name == "eid":
            continue
        c, cell = F.col(name), header_cell(name, dtype)
        if dtype.startswith("array<"):
            cols.append(F.to_json(c).alias(cell))
        else:
            cols.append(text(c, cell) if dtype == "string" else c.cast("string").alias(cell))
    return df.select(*cols)


def write_csv(g: PropertyGraph, root: str, max_rows: int = FILE_ROWS, escaped: bool = False) -> None:
    """``root/vertices/<label>`` and ``root/edges/<label>``; files roll over at ``max_rows``.

    Every file starts with the header. Existing folders are not overwritten. With ``escaped``, line breaks and
    backslashes of texts are written as codes, which the header says, so that files of any size can be split.
    """
    def save(df, path):
        (df.write.options(header="true", quote='"', escape='"', maxRecordsPerFile=max_rows,
                          ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
         .mode("append").csv(path))

    for label, v in g.vertices.items():
        save(_csv_ready(v, {"id": "~id"}, label, escaped), f"{root}/vertices/{label}")
    for t in g.edges:
        ends = "_".join(x for x in (t.src_label, t.label, t.dst_label) if x)
        save(_csv_ready(t.df, {"src": "~from", "dst": "~to"}, t.label, escaped), f"{root}/edges/{ends}")
