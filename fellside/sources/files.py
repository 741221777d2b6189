"""File formats: tile index, metadata, class balance, channel arrays, and results."""

from __future__ import annotations

import ast
import json
import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

INDEX_SCHEMA = "map string, sample string, split string, kind string, image string, channels string, label string, fg_ratio double"
META_SCHEMA = "resolution_m_per_px double, scale int, dpi int, width int, height int, map_name string"


def read_index(spark, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=INDEX_SCHEMA)


def tile_index(index: DataFrame, split: str, kinds: tuple[str, ...], min_fg: float = 0.0) -> DataFrame:
    return index.where((F.col("split") == split) & F.col("kind").isin(*kinds) & (F.coalesce("fg_ratio", F.lit(0.0)) >= min_fg))


def rebased(path: Column, root: str, part: str = "dataset") -> Column:
    """What follows the first component ``dataset`` goes below ``root``, and so does a relative path; other absolute paths stay."""
    parts = F.split(path, "/")
    at = F.array_position(parts, part)
    below = F.array_join(F.slice(parts, (at + 1).cast("int"), F.size(parts)), "/")
    return F.when(at > 0, F.concat(F.lit(root + "/"), below)).when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root + "/"), path))


def read_meta(spark, path: str) -> DataFrame:
    return spark.read.schema(META_SCHEMA).json(path, multiLine=True)


def read_class_balance(spark, path: str) -> DataFrame:
    """An index that comes twice: the last one counts."""
    rows = spark.read.schema("class_index int, pixels double").json(path, multiLine=True).select("*", F.monotonically_increasing_id().alias("n"))
    return rows.groupBy(F.col("class_index").alias("class_id")).agg(F.max_by("pixels", "n").alias("pixels"))


PART_BYTES = 1 << 24
BANDS = "bands.json"


class _Part(InputPartition):
    def __init__(self, path: str, channel: int, first: int, last: int):
        self.path, self.channel, self.first, self.last = path, channel, first, last


def _header(f) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    if f.read(6) != b"\x93NUMPY":
        raise ValueError("not an array file")
    major = f.read(2)[0]
    size = struct.unpack("<H", f.read(2))[0] if major == 1 else struct.unpack("<I", f.read(4))[0]
    head = ast.literal_eval(f.read(size).decode("latin1"))
    return head["shape"], np.dtype(head["descr"]), head["fortran_order"], f.tell()


class ChannelsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(path) as f:
            shape, kind, *_ = _header(f)
        rows = max(1, PART_BYTES // max(1, shape[2] * kind.itemsize))
        return [_Part(self.path, c, r, min(r + rows, shape[1])) for c in range(shape[0]) for r in range(0, shape[1], rows)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        """Some rows of one channel, by their place in the file."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(part.path)
        with store.open_input_file(path) as f:
            shape, kind, fortran, at = _header(f)
            if fortran or len(shape) != 3:
                raise ValueError("a C-ordered array of channels, rows and columns is expected")
            wide = shape[2] * kind.itemsize
            f.seek(at + (part.channel * shape[1] + part.first) * wide)
            plane = np.frombuffer(f.read((part.last - part.first) * wide), kind).reshape(-1, shape[2])
        r, c = np.nonzero(plane)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), part.channel, np.int32)), pa.array((r + part.first).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(plane[r, c].astype(np.int32))], ["channel", "r", "c", "value"])


class ChannelsSource(DataSource):
    """``spark.read.format("channels_npy").load(path)``: the cells above 0 of a [C, H, W] array, a task for each ``PART_BYTES`` of a channel."""

    @classmethod
    def name(cls) -> str:
        return "channels_npy"

    def schema(self) -> str:
        return "channel int, r int, c int, value int"

    def reader(self, schema) -> DataSourceReader:
        return ChannelsReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(ChannelsSource)


def cached(df: DataFrame, root: str, **params) -> DataFrame:
    """``df`` as Parquet under a key made of all parameters; read from there if it is there already."""
    import hashlib

    spark = df.sparkSession
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:20]
    path = f"{root}/{key}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class _Band(WriterCommitMessage):
    def __init__(self, files: list[tuple[int, int, int, int, str]]):
        self.files = files


class BandsWriter(DataSourceArrowWriter):
    """Tasks write bands of rows of each map as ``.npy`` files of their own name; only the commit names them in ``bands.json``, so files of lost attempts are never read. They're deleted at the commit, and so is all that a failed job wrote."""

    def __init__(self, path: str, kind: str, fill: float):
        self.path, self.kind, self.fill = path, kind, fill

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Rows come in the order of maps and bands; one band is held at a time."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        store.create_dir(path, recursive=True)
        done, held, key = [], [], None

        def flush() -> None:
            map_id, first, last, width = key
            plane = np.full((last - first, width), self.fill, self.kind)
            for r, c, v in held:
                plane[r - first, c] = v
            name = f"{uuid.uuid4().hex}.npy"
            with store.open_output_stream(f"{path}/{name}") as f:
                np.lib.format.write_array(f, plane, allow_pickle=False)
            done.append((map_id, first, last, width, name))
            held.clear()

        for batch in iterator:
            col = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            if not len(batch):
                continue
            keys = np.stack([col[n].astype(np.int64) for n in ("map_id", "first", "last", "width")], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                now = tuple(map(int, keys[a]))
                if key is not None and now != key:
                    flush()
                key = now
                held.append((col["r"][a:b].astype(np.int64), col["c"][a:b].astype(np.int64), col["value"][a:b]))
        if held:
            flush()
        return _Band(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        bands = sorted(f for m in messages if m for f in m.files)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{BANDS}") as f:
            f.write(json.dumps({"dtype": np.dtype(self.kind).str, "bands": [dict(zip(("map_id", "first", "last", "width", "file"), b, strict=True)) for b in bands]}).encode())
        _sweep(store, path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        _sweep(*fs.FileSystem.from_uri(self.path))


def _sweep(store, path: str) -> None:
    """Deletes the bands that aren't named: what a raster held before a failed write stays."""
    from pyarrow import fs

    files = [f for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".npy") or f.base_name == BANDS]
    named = set()
    for f in files:
        if f.base_name == BANDS:
            with store.open_input_file(f.path) as g:
                named = {b["file"] for b in json.loads(g.read())["bands"]}
    for f in files:
        if f.base_name != BANDS and f.base_name not in named:
            store.delete_file(f.path)


class BandsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """A task for each band."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{path}/{BANDS}") as f:
            told = json.loads(f.read())
        return [InputPartition((b["map_id"], b["first"], b["file"])) for b in told["bands"]]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        map_id, first, name = part.value
        store, path = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{path}/{name}") as f:
            plane = np.lib.format.read_array(f, allow_pickle=False)
        r, c = (x.ravel().astype(np.int32) for x in np.indices(plane.shape))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(plane.size, map_id, np.int32)), pa.array(r + np.int32(first)), pa.array(c), pa.array(plane.ravel().astype(float))], ["map_id", "r", "c", "value"])


class BandsSource(DataSource):
    """``raster_bands``: rasters of any size as bands of ``.npy`` files and a ``bands.json`` that names them."""

    @classmethod
    def name(cls) -> str:
        return "raster_bands"

    def schema(self) -> str:
        return "map_id int, r int, c int, value double"

    def reader(self, schema) -> DataSourceReader:
        return BandsReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BandsWriter(self.options["path"], self.options.get("kind", "f4"), float(self.options.get("fill", "nan")))


def write_raster(values: DataFrame, images: DataFrame, path: str, kind: str = "f4", fill: float = math.nan) -> None:
    """``values``: map_id, r, c, value; ``images``: map_id, height, width. Every map as bands of ``PART_BYTES`` at most below ``path`` (a URI; a folder for this raster alone, which a write replaces); a place without a value holds ``fill``, a null is
    such a place, a band without values isn't written, what lies outside its image is left out. Read again by the format ``raster_bands``."""
    values.sparkSession.dataSource.register(BandsSource)
    rows = F.greatest(F.floor(F.lit(PART_BYTES) / (F.col("width") * np.dtype(kind).itemsize)), F.lit(1))
    inside = values.where(F.col("value").isNotNull()).join(images.select("map_id", "height", "width"), "map_id").where("r >= 0 AND c >= 0 AND r < height AND c < width")
    first = (F.floor(F.col("r") / rows) * rows).cast("int")
    out = inside.select("map_id", first.alias("first"), F.least(first + rows, F.col("height")).cast("int").alias("last"), F.col("width").cast("int").alias("width"), "r", "c", F.col("value").cast("double").alias("value"))
    out = out.repartition("map_id", "first").sortWithinPartitions("map_id", "first")
    out.write.format("raster_bands").mode("append").option("kind", kind).option("fill", str(fill)).save(path)


def whole_raster(spark, path: str, map_id: int, out: str) -> None:
    """One map of ``path`` as a single ``.npy`` array at ``out`` (a URI), for programs that expect one: bands are copied in order, one in memory at a time; a gap between bands is an error."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{folder}/{BANDS}") as f:
        told = json.loads(f.read())
    own = [b for b in told["bands"] if b["map_id"] == map_id]
    if not own:
        raise ValueError(f"no map {map_id}")
    to, target = fs.FileSystem.from_uri(out)
    with to.open_output_stream(target) as f:
        np.lib.format.write_array_header_1_0(f, {"descr": told["dtype"], "fortran_order": False, "shape": (max(b["last"] for b in own), own[0]["width"])})
        at = 0
        for b in own:
            if b["first"] > at:
                raise ValueError(f"rows {at} to {b['first']} of map {map_id} have no values")
            with store.open_input_file(f"{folder}/{b['file']}") as g:
                f.write(np.lib.format.read_array(g, allow_pickle=False).tobytes())
            at = b["last"]


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The few rows of a report as one file of JSON lines below ``path``."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
