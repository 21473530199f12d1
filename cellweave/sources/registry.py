"""Readers by name or suffix; each gives points(cloud_id, point_id, row, coords, weight, attrs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import InputError

Reader = Callable[..., DataFrame]
_READERS: dict[str, tuple[tuple[str, ...], Reader]] = {}


def register_reader(name: str, suffixes: tuple[str, ...], reader: Reader, replace: bool = False) -> None:
    if not replace and (name in _READERS or any(s in known for s in suffixes for known, _ in _READERS.values())):
        raise InputError(f"a reader is registered for {name} or one of {suffixes}")
    _READERS[name] = (tuple(s.lower() for s in suffixes), reader)


def available_readers() -> list[str]:
    return sorted(_READERS)


def read(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Read a file, folder or pattern; without a format the longest registered suffix of the path decides."""
    if format is None:
        fits = [(len(s), n) for n, (suffixes, _) in _READERS.items() for s in suffixes if path.lower().endswith(s)]
        if not fits:
            raise InputError(f"no reader for {path}")
        format = max(fits)[1]
    if format not in _READERS:
        raise InputError(f"unknown format {format}; there are {available_readers()}")
    return _READERS[format][1](spark, path, **options)
