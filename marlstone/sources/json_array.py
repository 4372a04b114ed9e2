"""A Spark data source for files that hold one JSON array (or objects one after another), element by element.

Spark's own reader turns a whole file into one corrupt row when one element is foreign or the tail is cut off. This source
yields every complete object, and reads files in pieces. Options: path (file, folder or pattern), salvage (true: what comes before
and after a break is kept; lenient: a missing file has no rows either; false: a broken file, or one that holds no array, is an error), legacy (a
file that is read last).

    spark.dataSource.register(JsonArraySource)
    spark.read.format("json_array").schema("product_url string, fetched_at bigint").load("/landed/*.json")
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, IntegralType, StructType

from .json_records import streamed_objects
from .storage import chunks, listed


class FilePartition(InputPartition):
    def __init__(self, path: str, ordinal: int):
        super().__init__(ordinal)
        self.path, self.ordinal = path, ordinal


def _value(v: object, kind: object) -> object:
    """A JSON value as the column's type; what doesn't fit is null."""
    if v is None:
        return None
    if isinstance(kind, IntegralType):
        try:
            return int(float(v)) if not isinstance(v, (bool, dict, list)) else None
        except (TypeError, ValueError, OverflowError):
            return None
    if isinstance(kind, DoubleType):
        try:
            return float(v)
        except (TypeError, ValueError):
            return None
    if isinstance(kind, BooleanType):
        return v if isinstance(v, bool) else None
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


class JsonArrayReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[FilePartition]:
        path = self.options.get("path", "")
        found = listed(path)
        if not found and self._salvage() != "lenient":
            raise FileNotFoundError(f"no file matches {path}")
        legacy = self.options.get("legacy")
        if legacy and (last := listed(legacy)):
            found = [p for p in found if p not in last] + last
        return [FilePartition(p, n) for n, p in enumerate(found)]

    def _salvage(self) -> str:
        return self.options.get("salvage", "true").lower()

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        if partition is None:  # a source without files is asked once
            return
        if self._salvage() == "false":
            top = json.loads("".join(chunks(partition.path)))  # all or nothing
            if not isinstance(top, list):
                raise ValueError(f"{partition.path} holds no array")
            records: Iterator[dict] = (d for d in top if isinstance(d, dict))
        else:
            records = streamed_objects(chunks(partition.path))
        given = {"file_name": os.path.basename(partition.path), "file_ord": partition.ordinal}
        for pos, d in enumerate(records):
            row = d | given | {"pos": pos}
            yield tuple(_value(row.get(f.name), f.dataType) for f in self.schema.fields)


class JsonArraySource(DataSource):
    """Columns file_name, file_ord and pos may be asked for in the schema beside the objects' own fields."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "market string, category_page string, product_url string, fetched_at string, html string, file_name string, file_ord bigint, pos bigint"

    def reader(self, schema: StructType) -> JsonArrayReader:
        return JsonArrayReader(schema, dict(self.options))
