"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# White space of the word definition: space and U+0009..U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.array_remove(F.split(text, SPACE), "")


def sample_rows(df: DataFrame, key: str, salt: int, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``key``, the same in every run.

    Rows far above the expected limit are dropped first, so about twice ``most`` rows are sorted whatever the size.
    """
    whole_range = 1 << 40
    share = min(1.0, (2 * most + 100) / max(df.count(), 1))
    place = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(whole_range))
    return df.withColumn("_place", place).where(F.col("_place") < int(share * whole_range)) \
        .orderBy("_place", key).limit(most).drop("_place")


def map_texts(df: DataFrame, text_col: str, added: str, compute: Callable[[list[str]], dict], rows=256,
              keep_text=False, per_task=False) -> DataFrame:
    """Adds columns (DDL ``added``) that ``compute`` makes from a list of texts, in Arrow batches of at most ``rows``.

    The other columns pass as Arrow arrays and keep their types and nulls; the text is dropped unless ``keep_text``.
    With ``per_task``, ``compute`` has no arguments and makes such a function, once per task.
    """
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    new = StructType.fromDDL(added)
    out = StructType(kept + new.fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute() if per_task else compute
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = work(part.column(text_col).to_pylist())
                arrays = [part.column(f.name) for f in kept]
                arrays += [made[f.name] if isinstance(made[f.name], pa.Array)
                           else pa.array(made[f.name], arrow.field(f.name).type) for f in new.fields]
                yield pa.RecordBatch.from_arrays(
                    [a.cast(arrow.field(i).type) if a.type != arrow.field(i).type else a for i, a in enumerate(arrays)],
                    schema=arrow)

    return df.mapInArrow(run, out)
