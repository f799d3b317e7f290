"""What a session gets for tables of a size."""

import os

from weftgraph.session import PART, SPLIT, dealt

PARTS, PART_KEY, SPLIT_KEY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"


def test_shares_of_a_task_are_bounded(spark, tmp_path):
    """A shuffle gets parts in proportion to the tables, of a bounded size; a smaller size that the session names stays."""
    own = spark.newSession()
    with open(tmp_path / "t.parquet", "wb") as f:
        os.truncate(f.fileno(), 100 << 20)
    dealt(own, str(tmp_path))
    assert own.conf.get(PARTS) == "50" and own.conf.get(PART_KEY) == str(PART) and own.conf.get(SPLIT_KEY) == str(SPLIT)
    own.conf.set(PART_KEY, "1m")
    os.truncate(tmp_path / "t.parquet", 400 << 20)
    dealt(own, str(tmp_path))
    assert own.conf.get(PARTS) == "200" and own.conf.get(PART_KEY) == "1m"
