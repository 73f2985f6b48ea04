"""GeoTIFF rasters as cells: a data source `geotiff` whose partitions are runs of blocks, and writers for one raster or its tiles.

Reads classic and big TIFF, striped or tiled, uncompressed, deflated or LZW, with horizontal or floating-point differencing.
Only the directory and the blocks of a partition are read from a file. Nodata becomes null. Rows: raster, row, col, b1 to bn.
"""

from __future__ import annotations

import glob
import io
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: TIFF field types: size and struct code, fixed values.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: TIFF tags, fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
#: Keys of the coordinate system's directory: its kind, and the codes of geographic and projected systems, fixed values.
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
PART_BYTES = 16 << 20  # of decoded blocks in a partition


class _File:
    """Ranges of a file, or of a member of a zip file (archive.zip!member), which has to be unpacked whole."""

    def __init__(self, path: str):
        if "!" in path:
            archive, member = path.split("!", 1)
            with zipfile.ZipFile(archive) as z:
                self.f: io.BufferedIOBase = io.BytesIO(z.read(member))
        else:
            self.f = open(path, "rb")  # noqa: SIM115

    def __call__(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        return self.f.read(size)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.f.close()


def zip_members(archive: str, names: list[str]) -> dict[str, str]:
    """Paths of members by file name, whatever its case and folder."""
    with zipfile.ZipFile(archive) as z:
        found = {os.path.basename(m).lower(): m for m in z.namelist()}
    missing = [n for n in names if n.lower() not in found]
    if missing:
        raise FileNotFoundError(f"{archive} lacks {missing}")
    return {n: f"{archive}!{found[n.lower()]}" for n in names}


def yearly_members(archive: str) -> list[tuple[int, str]]:
    """(year, path) of an archive's members that end in _YYYY.tif, by year."""
    with zipfile.ZipFile(archive) as z:
        names = [m for m in z.namelist() if len(m) > 9 and m.lower().endswith(".tif") and m[-9] == "_" and m[-8:-4].isdigit()]
    return sorted((int(m[-8:-4]), f"{archive}!{m}") for m in names)


class Tiff:
    """The directory of a file; blocks are read on demand."""

    def __init__(self, read: _File):
        self.file = read
        start = read(0, 16)
        self.end = {b"II": "<", b"MM": ">"}[start[:2]]
        version = struct.unpack_from(f"{self.end}H", start, 2)[0]
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        big = version == 43
        at = struct.unpack_from(f"{self.end}Q", start, 8)[0] if big else struct.unpack_from(f"{self.end}I", start, 4)[0]
        count, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
        room = struct.calcsize(word)
        n = struct.unpack(f"{self.end}{count}", read(at, struct.calcsize(count)))[0]
        listing = read(at + struct.calcsize(count), entry * n)
        self.tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, k = struct.unpack_from(f"{self.end}HH{word}", listing, entry * i)
            size, code = TYPES.get(kind, (1, "B"))
            raw = listing[entry * i + 4 + room : entry * (i + 1)]
            if size * k > room:
                raw = read(struct.unpack(f"{self.end}{word}", raw)[0], size * k)
            self.tags[tag] = (raw[:k].split(b"\0")[0].decode(errors="replace"),) if kind == 2 else struct.unpack_from(f"{self.end}{k * len(code)}{code[0]}", raw)
        one = lambda t, d=None: self.tags.get(t, (d,))[0]
        self.width, self.height, self.bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        self.tiled = TILES in self.tags
        self.block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if self.tiled else (min(one(STRIP_ROWS, self.height), self.height), self.width)
        self.offsets, self.sizes = (self.tags[TILES], self.tags[TILE_BYTES]) if self.tiled else (self.tags[STRIPS], self.tags[STRIP_BYTES])
        kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
        self.dtype = np.dtype(f"{self.end}{kind}{one(BITS, 8) // 8}")
        self.planar = one(PLANAR, 1) == 2
        self.compression, self.predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
        text = one(NODATA)
        self.nodata = float(text) if text else None
        scale, tie = self.tags.get(PIXEL_SCALE), self.tags.get(TIE_POINT)
        self.corner = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0]) if scale and tie else None
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
        self.crs = f"EPSG:{code}" if code and code != 32767 else None
        #: The raster's own texts by name, and each band's description (null where it has none).
        self.texts: dict[str, str] = {}
        self.descriptions: list[str | None] = [None] * self.bands
        for item in ElementTree.fromstring(one(METADATA)).iterfind("Item") if one(METADATA) else ():
            band = item.get("sample")
            if band is None:
                self.texts[item.get("name")] = item.text or ""
            elif item.get("role") == "description" and int(band) < self.bands:
                self.descriptions[int(band)] = item.text

    def grid(self) -> tuple[int, int]:
        return -(-self.height // self.block[0]), -(-self.width // self.block[1])

    def read(self, i: int, j: int) -> np.ndarray:
        """bands x rows x columns of a block, cut to the raster."""
        down, across = self.grid()
        bh, bw = self.block
        if not self.tiled:
            bh = min(bh, self.height - i * bh)
        k = i * across + j
        if self.planar:
            out = np.stack([self._part(k + b * down * across, bh, bw, 1)[:, :, 0] for b in range(self.bands)])
        else:
            out = self._part(k, bh, bw, self.bands).transpose(2, 0, 1)
        return out[:, : self.height - i * self.block[0], : self.width - j * self.block[1]]

    def _part(self, k: int, rows: int, cols: int, bands: int) -> np.ndarray:
        raw = self.file(self.offsets[k], self.sizes[k])
        if self.compression in (8, 32946):
            raw = zlib.decompress(raw)
        elif self.compression == 5:
            raw = lzw(raw)
        elif self.compression != 1:
            raise ValueError(f"compression {self.compression} isn't handled")
        if self.predictor == 3:  # bytes of a row by significance, then differences between them
            size = self.dtype.itemsize
            parts = np.frombuffer(raw, np.uint8, rows * cols * bands * size).reshape(rows, cols * size, bands)
            parts = np.cumsum(parts, axis=1, dtype=np.uint8).reshape(rows, size, cols * bands).transpose(0, 2, 1)
            return np.ascontiguousarray(parts).view(self.dtype.newbyteorder(">")).reshape(rows, cols, bands)
        out = np.frombuffer(raw, self.dtype, rows * cols * bands).reshape(rows, cols, bands)
        return np.cumsum(out, axis=1, dtype=self.dtype) if self.predictor == 2 else out


def lzw(raw: bytes) -> bytes:
    """Decodes TIFF's variant of LZW: codes from 9 to 12 bits, most significant bit first, early change of width."""
    out, table, prev, width, bits, have = bytearray(), [], b"", 9, 0, 0
    for byte in raw:
        bits, have = (bits << 8) | byte, have + 8
        while have >= width:
            code = (bits >> (have - width)) & ((1 << width) - 1)
            have -= width
            bits &= (1 << have) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, prev, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
                continue
            entry = table[code] if code < len(table) else prev + prev[:1]
            out += entry
            if prev:
                table.append(prev + entry[:1])
            prev = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


class _Blocks(InputPartition):
    def __init__(self, path: str, first: int, after: int):
        self.path, self.first, self.after = path, first, after


class TiffReader(DataSourceReader):
    def __init__(self, paths: list[str], bands: int):
        self.paths, self.bands = paths, bands

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            with _File(p) as f:
                t = Tiff(f)
            down, across = t.grid()
            step = max(1, PART_BYTES // (t.block[0] * t.block[1] * t.bands * t.dtype.itemsize))
            out += [_Blocks(p, k, min(k + step, down * across)) for k in range(0, down * across, step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with _File(partition.path) as f:
            t = Tiff(f)
            across = t.grid()[1]
            for k in range(partition.first, partition.after):
                i, j = divmod(k, across)
                data = t.read(i, j)
                _, h, w = data.shape
                rows, cols = np.divmod(np.arange(h * w), w)
                arrays = [pa.array([partition.path] * (h * w), pa.string()), pa.array((rows + i * t.block[0]).astype(np.int32)), pa.array((cols + j * t.block[1]).astype(np.int32))]
                for b in range(self.bands):
                    v = data[b].reshape(-1).astype(np.float64)
                    arrays.append(pa.array(v, pa.float64(), mask=np.isnan(v) | ((v == t.nodata) if t.nodata is not None else False)))
                yield pa.RecordBatch.from_arrays(arrays, ["raster", "row", "col", *[f"b{i + 1}" for i in range(self.bands)]])


class TiffSource(DataSource):
    """Options: path, a file, a pattern, or archive.zip!member; all rasters have the same number of bands."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _paths(self) -> list[str]:
        p = self.options["path"]
        return [p] if "!" in p else sorted(glob.glob(p))

    def schema(self) -> str:
        with _File(self._paths()[0]) as f:
            n = Tiff(f).bands
        return "raster string, row int, col int, " + ", ".join(f"b{i + 1} double" for i in range(n))

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self._paths(), len(schema.fields) - 3)


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """raster, row, col, b1 to bn of a file, a pattern's files, or archive.zip!member."""
    spark.dataSource.register(TiffSource)
    return spark.read.format("geotiff").option("path", path).load()


def raster_meta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """raster, crs, height, width, bands, x0, y0, res, nodata, tags and descriptions (of each band) of each file, from its directory alone."""
    rows = []
    for p in paths:
        with _File(p) as f:
            t = Tiff(f)
        x0, y0, res = t.corner or (None, None, None)
        rows.append((p, t.crs, t.height, t.width, t.bands, x0, y0, res, t.nodata, t.texts, t.descriptions))
    return spark.createDataFrame(rows, "raster string, crs string, height int, width int, bands int, x0 double, y0 double, res double, nodata double, tags map<string,string>, descriptions array<string>")


def band_stats(cells: DataFrame) -> DataFrame:
    """raster, band, n, min, max and mean of the valid cells of each band."""
    bands = [c for c in cells.columns if c[0] == "b" and c[1:].isdigit()]
    long = cells.unpivot(["raster"], bands, "b", "value")
    return long.groupBy("raster", F.substring("b", 2, 9).cast("int").alias("band")).agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def _xml(tags: dict[str, str], descriptions: list[str]) -> bytes:
    root = ElementTree.Element("GDALMetadata")
    for k, v in tags.items():
        ElementTree.SubElement(root, "Item", name=k).text = v
    for i, d in enumerate(descriptions):
        ElementTree.SubElement(root, "Item", name="DESCRIPTION", sample=str(i), role="description").text = d
    return ElementTree.tostring(root)


def write_tiles(cells: DataFrame, folder: str, bands: list[str], corner: tuple[float, float, float], nodata: float = -9999.0, tile: int = 256, dtype: str = "float32", **options) -> DataFrame:
    """path and n: one GeoTIFF a tile of cells (row, col and bands), each written by its own task to a folder that all executors share.

    Cells that are missing or null are nodata. Files are named by the tile's row and column; equal (row, col) are an error.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["wt_i"].iloc[0]), int(pdf["wt_j"].iloc[0])
        r, c = pdf["row"].to_numpy() - i * tile, pdf["col"].to_numpy() - j * tile
        if len(np.unique(r * tile + c)) < len(r):
            raise ValueError("a cell occurs twice")
        data = np.full((len(bands), tile, tile), nodata, dtype)
        for k, b in enumerate(bands):
            v = pdf[b].to_numpy(float)
            data[k, r, c] = np.where(np.isnan(v), nodata, v)
        path = f"{folder}/tile_{i}_{j}.tif"
        write_geotiff(path, data, (corner[0] + j * tile * corner[2], corner[1] - i * tile * corner[2], corner[2]), nodata, **options)
        return pd.DataFrame({"path": [path], "n": [len(r)]})

    placed = cells.select("row", "col", *bands).withColumns({"wt_i": F.floor(F.col("row") / tile).cast("int"), "wt_j": F.floor(F.col("col") / tile).cast("int")})
    return placed.groupBy("wt_i", "wt_j").applyInPandas(write, "path string, n long")


def write_geotiff(path: str, data: np.ndarray, corner: tuple[float, float, float] = (0.0, 0.0, 1.0), nodata: float | None = None, block: int = 64, crs: int | None = None, tags: dict[str, str] | None = None, descriptions: list[str] | None = None) -> None:
    """Writes bands x rows x columns as a tiled, deflated file, with an EPSG code, texts by name and band descriptions if they are given."""
    bands, height, width = data.shape
    down, across = -(-height // block), -(-width // block)
    parts = []
    for i in range(down):
        for j in range(across):
            tile = np.zeros((block, block, bands), data.dtype)
            piece = data[:, i * block : (i + 1) * block, j * block : (j + 1) * block].transpose(1, 2, 0)
            tile[: piece.shape[0], : piece.shape[1]] = piece
            parts.append(zlib.compress(tile.tobytes()))
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    x0, y0, res = corner
    fields: list[tuple[int, int, list]] = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [data.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [8]), (262, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [1]),
        (TILE_WIDTH, 3, [block]), (TILE_HEIGHT, 3, [block]), (TILES, 4, [0] * len(parts)), (TILE_BYTES, 4, [len(p) for p in parts]), (FORMAT, 3, [kind] * bands),
        (PIXEL_SCALE, 12, [res, res, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]),
    ]
    if crs is not None:
        keys = [(MODEL_TYPE, 2 if crs == 4326 else 1), (RASTER_TYPE, 1), (GEOGRAPHIC if crs == 4326 else PROJECTED, crs)]
        fields.append((GEO_KEYS, 3, [1, 1, 0, len(keys), *[v for k, code in keys for v in (k, 0, 1, code)]]))
    if tags or descriptions:
        fields.append((METADATA, 2, list(_xml(tags or {}, descriptions or []) + b"\0")))
    if nodata is not None:
        fields.append((NODATA, 2, list(f"{nodata:.17g}\0".encode())))
    head = 8 + 2 + 12 * len(fields) + 4
    extra, starts = 0, {}
    for tag, t, v in fields:
        if TYPES[t][0] * len(v) > 4:
            starts[tag] = head + extra
            extra += TYPES[t][0] * len(v)
    at = head + extra
    offsets = []
    for p in parts:
        offsets.append(at)
        at += len(p)
    directory, values = struct.pack("<H", len(fields)), b""
    for tag, t, v in fields:
        v = offsets if tag == TILES else v
        raw = struct.pack(f"<{len(v)}{'B' if t == 2 else TYPES[t][1]}", *v)
        directory += struct.pack("<HHI", tag, t, len(v)) + (struct.pack("<I", starts[tag]) if tag in starts else raw.ljust(4, b"\0"))
        values += raw if tag in starts else b""
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", 8) + directory + b"\0\0\0\0" + values + b"".join(parts))
