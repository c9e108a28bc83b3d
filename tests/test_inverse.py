"""Inverse predictions as folds, against the kernels."""

import numpy as np
from mosaiq.codec import transforms as tf
from mosaiq.codec.alpha import unfilter
from mosaiq.operators import inverse
from pyspark.sql import functions as F


def test_all_modes_equal_the_kernel(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for i, (w, h) in enumerate([(1, 1), (5, 1), (1, 6), (9, 7), (20, 13), (16, 16), (33, 9)]):
        argb = rng.integers(0, 1 << 32, w * h, dtype=np.uint64).astype(np.uint32)
        if i % 2:
            argb &= np.uint32(0x03010207)
        across, down = -(-w // 4), -(-h // 4)
        modes = rng.integers(0, 14, across * down)
        want[i] = tf.predictor_inverse(argb.copy(), (modes << 8).astype(np.uint32), w, h, 2).reshape(h, w).tolist()
        for y in range(h):
            rows.append((i, y, argb[y * w : y * w + w].tolist(), modes[(y >> 2) * across : (y >> 2) * across + across].tolist()))
    table = spark.createDataFrame(rows, "image_id int, y int, r array<bigint>, modes array<int>").repartition(4)
    assert {r["image_id"]: r["rows"] for r in inverse.predictor_inverse(table, 2).collect()} == want
    plan = inverse.predictor_inverse(table, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "")


def test_gradient_equals_the_kernel(spark):
    rng = np.random.default_rng(7)
    planes = {i: rng.integers(0, 256, (h, w)).astype(np.uint8) for i, (w, h) in enumerate([(1, 1), (7, 1), (1, 5), (12, 9)])}
    rows = [(i, y, p[y].tolist()) for i, p in planes.items() for y in range(len(p))]
    got = inverse.gradient_inverse(spark.createDataFrame(rows, "image_id int, y int, r array<bigint>")).collect()
    assert {r["image_id"]: r["rows"] for r in got} == {i: np.asarray(unfilter(p.copy(), 3, p.shape[1], p.shape[0])).reshape(p.shape).tolist() for i, p in planes.items()}


def test_nothing(spark):
    assert inverse.gradient_inverse(spark.createDataFrame([], "image_id int, y int, r array<bigint>")).select(F.col("rows")).collect() == []
