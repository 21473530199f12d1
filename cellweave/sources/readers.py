"""Readers of point clouds: a cloud for each file, files in parallel."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..errors import InputError
from . import molecules as M
from .registry import register_reader

SCHEMA = "cloud_id string, point_id string, row int, coords array<double>, weight double, attrs map<string,string>"


def whole_files(parse: Callable[..., list]) -> Callable[..., DataFrame]:
    """A reader that parses each file's whole text in a task."""

    def reader(spark: SparkSession, path: str, **options) -> DataFrame:
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

        def run(frames):
            for frame in frames:
                rows = []
                for name, text in zip(frame.path, frame.value):
                    try:
                        rows += [(name, i, k, x, w, a) for k, (i, x, a, w) in enumerate(parse(text, **options))]
                    except (InputError, ValueError, KeyError, IndexError) as e:
                        raise InputError(f"{name}: {e}") from e
                yield pd.DataFrame(rows, columns=["cloud_id", "point_id", "row", "coords", "weight", "attrs"])

        return files.mapInPandas(run, SCHEMA)

    return reader


def read_csv(spark: SparkSession, path: str, coordinates: tuple[str, ...] = ("x", "y", "z"), id: str | None = "id", weight: str | None = "weight") -> DataFrame:
    """A header is required; id and weight may be missing. All columns stay, as text, in attrs."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    if missing := [c for c in coordinates if c not in raw.columns]:
        raise InputError(f"{path} has no columns {missing}")
    raw = raw.withColumn("_file", F.input_file_name()).withColumn("_n", F.monotonically_increasing_id())
    names = [c for c in raw.columns if not c.startswith("_")]
    row = F.row_number().over(W.partitionBy("_file").orderBy("_n")) - 1
    w = F.col(weight).cast("double") if weight and weight in names else F.lit(1.0)
    out = raw.withColumn("row", row).select(
        F.col("_file").alias("cloud_id"), (F.col(id) if id and id in names else F.col("row").cast("string")).alias("point_id"), "row",
        F.array(*[F.col(c).cast("double") for c in coordinates]).alias("coords"), w.alias("weight"), F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))]).alias("attrs"),
    )
    return out


def read_pdb(spark: SparkSession, path: str, model: int | None = None) -> DataFrame:
    return whole_files(M.parse_pdb)(spark, path, model=model)


register_reader("csv", (".csv",), read_csv)
register_reader("json", (".json",), whole_files(M.parse_json))
register_reader("xyz", (".xyz",), whole_files(M.parse_xyz))
register_reader("pdb", (".pdb", ".ent"), read_pdb)
register_reader("pdbqt", (".pdbqt",), whole_files(lambda text, model=None: M.parse_pdb(text, model, docking=True)))
register_reader("mol2", (".mol2",), whole_files(M.parse_mol2))
register_reader("mol", (".mol",), whole_files(M.parse_mol))
register_reader("sdf", (".sdf", ".sd"), whole_files(lambda text: M.parse_mol(text, sdf=True)))
register_reader("cif", (".cif", ".mmcif"), whole_files(M.parse_cif))
