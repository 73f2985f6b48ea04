"""GeoPackage layers: a data source `gpkg` that reads row ranges of a layer, and a writer for one layer.

A GeoPackage is an SQLite file, so it must lie on a path that every reader can open. Columns are pruned in SQLite.
"""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INTEGER": "long", "MEDIUMINT": "int", "INT": "long", "SMALLINT": "int", "TINYINT": "int", "BOOLEAN": "boolean", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "DATE": "string", "DATETIME": "string", "BLOB": "binary"}
_ENVELOPE = [0, 32, 48, 48, 64]


def layers(path: str) -> list[str]:
    """The names of a GeoPackage's feature layers."""
    if not path.lower().endswith(".gpkg"):
        raise ValueError(f"not a GeoPackage: {path}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return [r[0] for r in c.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]


def wkb_of(blob: bytes | None) -> bytes | None:
    """The well-known binary behind a GeoPackage geometry's header; null for an empty geometry."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 16:
        return None
    return blob[8 + _ENVELOPE[(blob[3] >> 1) & 7] :]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class GpkgReader(DataSourceReader):
    def __init__(self, path: str, layer: str, columns: list[str], geometry: str | None, parts: int):
        self.path, self.layer, self.columns, self.geometry, self.parts = path, layer, columns, geometry, parts

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {_quoted(self.layer)}").fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(i, min(i + step - 1, high)) for i in range(low, high + 1, step)] or [_Range(0, -1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        g = self.columns.index(self.geometry) if self.geometry in self.columns else None
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.layer)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)):
                yield row if g is None else (*row[:g], wkb_of(row[g]), *row[g + 1 :])


class GpkgSource(DataSource):
    """Options: path; layer (the first if absent); columns (comma-separated; unknown names are ignored); partitions."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _layout(self) -> tuple[str, list[tuple[str, str]], str | None]:
        path = self.options["path"]
        layer = self.options.get("layer") or layers(path)[0]
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
            got = c.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
            geometry = got[0] if got else None
            fields = [(r[1], "binary" if r[1] == geometry else _KINDS.get(r[2].split("(")[0].upper(), "string")) for r in c.execute(f"PRAGMA table_info({_quoted(layer)})")]
        if wanted := self.options.get("columns"):
            names = {w.strip() for w in wanted.split(",")} | {geometry}
            fields = [f for f in fields if f[0] in names]
        return layer, fields, geometry

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self._layout()[1])

    def reader(self, schema) -> DataSourceReader:
        layer, fields, geometry = self._layout()
        return GpkgReader(self.options["path"], layer, [f[0] for f in fields], geometry, int(self.options.get("partitions", 8)))


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(GpkgSource)
    r = spark.read.format("gpkg").option("path", path)
    r = r.option("layer", layer) if layer else r
    return (r.option("columns", ",".join(columns)) if columns else r).load()


def write_gpkg(df: DataFrame, path: str, layer: str, srs: int, geometry: str = "geometry", mode: str = "error") -> bool:
    """Writes one layer, partition after partition, to a file on the driver; mode: error, ignore or overwrite.

    Returns whether it wrote. A single file is one writer's work by nature; keep large results in Parquet.
    """
    if os.path.exists(path):
        if mode == "ignore":
            return False
        if mode == "error":
            raise FileExistsError(path)
        os.remove(path)
    kinds = {"bigint": "INTEGER", "int": "MEDIUMINT", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}
    columns = [(f.name, "POLYGON" if f.name == geometry else kinds.get(f.dataType.simpleString(), "TEXT")) for f in df.schema.fields]
    g = df.columns.index(geometry)
    with sqlite3.connect(path) as c:
        c.execute("PRAGMA application_id = 1196444487")
        c.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, srs_id INTEGER)")
        c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
        c.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
        c.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
        c.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, srs))
        c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', ?, 0, 0)", (layer, geometry, srs))
        c.execute(f"CREATE TABLE {_quoted(layer)} ({', '.join(f'{_quoted(n)} {k}' for n, k in columns)})")
        head = b"GP\x00\x01" + struct.pack("<i", srs)
        put = f"INSERT INTO {_quoted(layer)} VALUES ({', '.join('?' * len(columns))})"
        for row in df.toLocalIterator():
            v = list(row)
            v[g] = None if v[g] is None else head + bytes(v[g])
            c.execute(put, v)
    return True
