"""Permutation index against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopframe.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        out[q] = [(ids[j], far[j]) for j in np.lexsort((ids, far)) if ids[j] != q][:k]
    return out


def found(df, **rules):
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, **rules).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_small_tables_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(1, 140)]
    rows += [(200 + i, [1.0] * 8) for i in range(40)] + [(0, [1.0] * 8)]  # copies: ties go to smaller ids
    bad = [(1000, None), (1100, [0.0] * 8), (1200, [math.nan] + [1.0] * 7), (1300, [None] + [1.0] * 7), (None, [1.0] * 8),
           (1400, [math.inf] + [1.0] * 7), (1500, [1.0] * 3), (1600, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], SCHEMA).withColumn("rank", F.lit(1)).repartition(4)
    got, want = found(df, share=1.0), brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (7, [1.0, 1.0], 0)], SCHEMA)
    assert {q: [i for i, _ in v] for q, v in found(few).items()} == {0: [7, 5]}
    assert found(spark.createDataFrame([], SCHEMA)) == {} and found(few.where("vec_id = 0")) == {}


def test_recall_over_many_shards(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got, want = found(df, shard_rows=1000, query_rows=25), brute(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert all(len(v) == 10 for v in got.values()) and hits >= 0.9 * 10 * len(want)
