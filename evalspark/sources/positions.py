"""Line order of file sources.

Files carry no row number. The order used everywhere is (file, block, line in block):
both parts of a split are known while scanning, so no shuffle is needed to read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.plans.numbering import shift_ranges

BLOCK = ["_file", "_block"]


def with_positions(scan: DataFrame) -> DataFrame:
    """Add the scan position columns right at the source.

    The scan is read twice, once to count lines per block. Split sizes follow the number of
    cores; where executors come and go, set ``spark.sql.files.minPartitionNum``. Passes that
    saw different splits fail the job, they never give wrong numbers.
    """
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def number_lines(positioned: DataFrame, out: str = "original_index") -> DataFrame:
    """Dense number over all rows of ``positioned``, which must not be filtered in between.

    Files are ordered by the length of their path, then by the path, so part-100000 follows
    part-99999. The line counts per block are written first: the join then knows how small
    they are, and the text need not be shuffled to meet them.
    """
    return shift_ranges(positioned, BLOCK, "_line", out, order=[F.length("_file"), *BLOCK])
