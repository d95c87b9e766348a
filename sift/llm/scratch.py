"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``; one is made only in a
local session that has none (tests).  A staged table cuts the lineage: losing
an executor afterwards re-reads files and recomputes nothing above them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from sift.session import ensure_checkpoint_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
