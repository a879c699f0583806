"""Packed exchange between blocks and tables of columns."""

import numpy as np
from chronotext.operators import blocks as blocks_module
from chronotext.operators.blocks import sparse_blocks


def test_a_bucket_tells_a_block_all_in_one_row(spark, monkeypatch):
    """Cells travel packed: rows sent grow with blocks and buckets, not with the cells."""
    monkeypatch.setattr(blocks_module, "BLOCK_VALUES", 50)
    x = np.random.default_rng(5).random((300, 40))
    long = [(int(i), int(j), float(x[i, j])) for i, j in np.ndindex(*x.shape)]
    with sparse_blocks(spark.createDataFrame(long, "row_id long, at long, value double"), spark.range(300).withColumnRenamed("id", "row_id")) as made:
        cells = spark.range(40).selectExpr("id AS at", "explode(sequence(0, 9)) AS slot", "1.0D AS value")
        assert made.n_blocks > 3 and made._routed(cells).count() <= made.n_blocks * made.n_buckets < 40 * 10 * made.n_blocks / 4
