"""What operators gather on the driver stays small there."""

from __future__ import annotations

import tracemalloc

from pyspark.sql import functions as F


def test_counts_of_quality_are_gathered_as_arrays(spark):
    from weftmap.llm.quality import quality_scores

    words = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i).cast("string").substr(2, 6)))
    frame = spark.range(300).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    tracemalloc.start()
    try:
        found = quality_scores(frame, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.count() == 300
    assert peak < 40e6, peak
