"""Tables saved in iterations."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmap.functions import bins as B
from weftmap.operators import balance as BL
from weftmap.plans.genome import Genome
from weftmap.sources.files import Files
from weftmap.sources.scratch import checkpointed, dropped


def test_estimated_size_does_not_grow_by_iterations(spark):
    now = spark.range(20).withColumnRenamed("id", "k")
    for _ in range(9):
        before, now = now, checkpointed(now.join(now.select((19 - F.col("k")).alias("k")), "k"))
        dropped(before)
    size = now._jdf.queryExecution().optimizedPlan().stats().simpleString()
    assert re.match(r"sizeInBytes=[\d.]+ (B|KiB)", size) and now.count() == 20
    path = now._weftmap_saved
    dropped(now)
    dropped(spark.range(3))
    assert not Files(spark).exists(path)


@pytest.mark.filterwarnings("ignore:balancing did not converge")
@pytest.mark.parametrize("mode", ["cis", "trans"])
def test_many_iterations_agree(spark, mode):
    bins = B.binnify(spark, Genome.of({"a": 100, "b": 60, "c": 50}), 10)
    rng = np.random.default_rng(5)
    cells = {(int(min(p)), int(max(p))): int(rng.integers(1, 9)) for p in rng.integers(0, 21, (150, 2))}
    pixels = spark.createDataFrame([(*p, n) for p, n in cells.items()], "bin1_id long, bin2_id long, count long").cache()
    options = {"tol": 0.0, "max_iters": 30, "min_nnz": 0, "mad_max": 0, "cis_only": mode == "cis", "trans_only": mode == "trans"}
    weights, _ = BL.balance_large(pixels, bins, **options)
    large = np.array([r.weight for r in weights.orderBy("bin_id").collect()])
    assert np.allclose(large, BL.balance(pixels, bins, **options).weights, equal_nan=True)
