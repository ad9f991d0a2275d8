"""Intermediate tables in the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from mailsift.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read back: cuts lineage like a checkpoint, in compressed columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
