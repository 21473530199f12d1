"""Results as tables on disk, and metadata as JSON that keeps infinities, NaN and arrays."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION = 1


def to_jsonable(x):
    if isinstance(x, float) and not math.isfinite(x):
        return {"$": "float", "value": "nan" if math.isnan(x) else "inf" if x > 0 else "-inf"}
    if isinstance(x, np.ndarray):
        return {"$": "array", "dtype": str(x.dtype), "shape": list(x.shape), "value": [to_jsonable(v) for v in x.ravel().tolist()]}
    if isinstance(x, np.generic):
        return to_jsonable(x.item())
    if isinstance(x, tuple):
        return {"$": "tuple", "value": [to_jsonable(v) for v in x]}
    if isinstance(x, list):
        return [to_jsonable(v) for v in x]
    if isinstance(x, dict):
        if all(isinstance(k, str) and k != "$" for k in x):
            return {k: to_jsonable(v) for k, v in x.items()}
        return {"$": "map", "value": [[to_jsonable(k), to_jsonable(v)] for k, v in x.items()]}
    return x


def from_jsonable(x):
    if isinstance(x, list):
        return [from_jsonable(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "$" not in x:
        return {k: from_jsonable(v) for k, v in x.items()}
    value = x["value"]
    return {
        "float": lambda: float(value),
        "array": lambda: np.array([from_jsonable(v) for v in value], x.get("dtype")).reshape(x.get("shape", [-1])),
        "tuple": lambda: tuple(from_jsonable(v) for v in value),
        "map": lambda: {from_jsonable(k): from_jsonable(v) for k, v in value},
    }[x["$"]]()


def save_result(tables: dict[str, DataFrame], path: str, metadata: dict | None = None) -> None:
    """Each table as Parquet below path, and the metadata as one JSON row."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    text = json.dumps({"version": VERSION, "tables": sorted(tables), "metadata": to_jsonable(metadata or {})})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/_meta")


def load_result(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/_meta").collect()))
    if meta["version"] != VERSION:
        raise ValueError(f"version {meta['version']} is unknown")
    return {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}, from_jsonable(meta["metadata"])


def compact(results: DataFrame, provenance: list[str]) -> tuple[DataFrame, DataFrame]:
    """(results with meta_id in place of the provenance columns, meta(meta_id, ...)): each distinct provenance is kept once."""
    name = F.sha2(F.to_json(F.struct(*provenance), {"ignoreNullFields": "false"}), 256)
    named = results.withColumn("meta_id", name)
    return named.drop(*provenance), named.select("meta_id", *provenance).distinct()
