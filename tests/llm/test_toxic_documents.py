"""Good prose with insults is rejected, by words that the labels show."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs  # noqa: E402


def test_toxic_documents_are_rejected(spark):
    from weftmap.llm.quality import quality_scores

    rng = np.random.default_rng(3)
    text = lambda mark: " ".join(f"w{rng.integers(9999)} the of{mark if rng.random() < 0.05 else ''}" for _ in range(80))
    good, bad = [text("") for _ in range(120)], [" ".join(f"w{rng.integers(9999)} %%%" for _ in range(60)) for _ in range(60)]
    toxic = [text(" idiot,") + " you idiot" for _ in range(60)]
    data = [(i, t, *[None] * 8) for i, t in enumerate(good + bad + toxic)]
    labels = spark.createDataFrame([(i, int(not 120 <= i < 180), int(i >= 180)) for i in range(0, 240) if i % 3], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_scores(docs(spark, data), labels).collect() if r.kept}
    assert kept == set(range(120))
