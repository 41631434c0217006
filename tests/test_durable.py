from __future__ import annotations

import os

from stakelens.operators import clear_scratch, durable, scratch_dir


def test_scratch_goes_at_the_end(spark):
    path = scratch_dir(spark, "x")
    durable(spark.range(3)).count()
    folder = os.path.dirname(path).removeprefix("file:")
    assert os.listdir(folder)
    clear_scratch(spark)
    assert not os.path.exists(folder)
