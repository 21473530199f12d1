"""Where intermediate tables are kept, and lists and tables of checked size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from .errors import InputError, ResourceLimitError

#: Entries of a list of scales at most.
MOST_SCALES = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none, a temporary one on a single machine and an error on a cluster."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise InputError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """df without its lineage, by a checkpoint in the shared folder: computed once, whatever reads it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def at_most(df: DataFrame, limit: int | None, what: str) -> DataFrame:
    """df, or an error if it has more than `limit` rows; with a limit it is computed once, before it is counted."""
    if limit is None:
        return df
    df = settle(df)
    if df.limit(limit + 1).count() > limit:
        raise ResourceLimitError(f"more than {limit} {what}")
    return df


def short_list(values: list[float] | DataFrame, most: int = MOST_SCALES) -> list[float]:
    """A list of numbers from a list or a table of one column, refused if it is long."""
    if isinstance(values, DataFrame):
        values = [r[0] for r in values.limit(most + 1).collect()]
    if len(values) > most:
        raise ResourceLimitError(f"more than {most} values")
    return [float(v) for v in values]
