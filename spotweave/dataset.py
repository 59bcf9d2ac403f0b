"""The container: points, shapes and tables as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
#: Rings without the closing vertex; a point is inside if an odd number of rings hold it.
RINGS = T.ArrayType(RING)
SHAPES = T.StructType([T.StructField("shape_id", T.StringType()), T.StructField("rings", RINGS)])
#: Microns per pixel of instruments, fixed values.
MICRONS_PER_PIXEL = {"cosmx": 0.18, "merscope": 1.0, "xenium": 0.2125}


@dataclass(frozen=True)
class SpatialDataset:
    """points: (x, y, feature, one id column for each indexed shape); shapes: (shape_id, rings, features ...); tables: results by name.

    Ids are NULL where there is none. attrs holds points_key, feature_key, instance_key and shape_keys after prep.
    Operators return a new dataset or a DataFrame; nothing is changed in place.
    """

    points: Mapping[str, DataFrame] = field(default_factory=dict)
    shapes: Mapping[str, DataFrame] = field(default_factory=dict)
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    attrs: Mapping[str, Any] = field(default_factory=dict)

    def with_points(self, key: str, df: DataFrame) -> SpatialDataset:
        return replace(self, points={**self.points, key: df})

    def with_shapes(self, key: str, df: DataFrame) -> SpatialDataset:
        return replace(self, shapes={**self.shapes, key: df})

    def with_table(self, key: str, df: DataFrame) -> SpatialDataset:
        return replace(self, tables={**self.tables, key: df})

    def with_attrs(self, **attrs: Any) -> SpatialDataset:
        return replace(self, attrs={**self.attrs, **attrs})

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> SpatialDataset:
        """Keep all elements for queries that follow."""
        for df in (*self.points.values(), *self.shapes.values(), *self.tables.values()):
            df.persist(level)
        return self
