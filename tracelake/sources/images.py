"""Raw images as bounded windows of bytes, and regions out of them.

``FileImages`` are images in files that a file system of pyarrow reaches (a local path, or a URI with its scheme), ``TableImages`` a table of
windows. Both give windows to scan, the images' sizes, and the bytes of regions; files by seeking, so that no window shuffles.
"""

from __future__ import annotations

import math
import uuid
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.window import Window

from .scratch import shared_path, stored


#: Bytes that a task reads at least, if there are as many; bytes of regions that are handed on at once; bytes of windows side by side that are read at once.
TASK, BATCH, RUN = 256 << 20, 32 << 20, 1 << 20
#: Files that a task keeps open, and windows that are handed on at once.
OPEN, ROWS = 256, 50_000
CATALOG = "image_id long, start long, size long, path string, at long"


def _file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_sizes(paths: list[str]) -> list[int]:
    """The sizes of files, asked for on the driver."""
    out = []
    for path in paths:
        system, inner = _file_system(path)
        info = system.get_file_info(inner)
        if not info.is_file:
            raise FileNotFoundError(path)
        out.append(info.size)
    return out


class _Files:
    """Files that stay open while a task reads from them."""

    def __init__(self):
        self.opened: dict[str, object] = {}

    def read(self, path: str, at: int, length: int) -> bytes | None:
        """The bytes at a place, short at the file's end; None if they can't be read."""
        try:
            if path not in self.opened:
                if len(self.opened) >= OPEN:
                    self.opened.pop(next(iter(self.opened))).close()
                system, inner = _file_system(path)
                self.opened[path] = system.open_input_file(inner)
            return self.opened[path].read_at(length, at)
        except OSError:
            return None

    def region(self, extents: list[tuple], offset: int, length: int) -> tuple[bytes, bool]:
        """The bytes of a region out of the extents (start, size, path, at) that it touches, in order, up to the first that is missing; whether none is."""
        parts, at, end = [], offset, offset + length
        for start, size, path, place in extents:
            if start > at:
                break
            if start + size <= at:
                continue
            want = min(end, start + size) - at
            got = self.read(path, place + at - start, want)
            parts.append(got or b"")
            at += len(parts[-1])
            if got is None or len(got) < want or at >= end:
                break
        return parts[0] if len(parts) == 1 else b"".join(parts), at >= end

    def windows(self, extents: list[tuple], size: int, window: int, overlap: int, first: int, last: int, joined: bool):
        """(base, owned length, bytes) of the windows ``first`` to ``last`` of an image of ``size`` bytes, read at once and, if ``joined``, as one where none of their bytes is missing; None for a window that can't be read."""
        base, end = first * window, min((last + 1) * window, size)
        data, _ = self.region(extents, base, end - base + overlap)
        whole = len(data) >= end - base
        if whole and joined:
            yield base, end - base, data
            return
        for k in range(first, last + 1):
            at = k * window
            owned = min(window, size - at)
            piece = data[at - base : at - base + owned + overlap] if whole or k == first else self.region(extents, at, owned + overlap)[0]
            yield at, owned, piece if len(piece) >= owned else None

    def close(self):
        for file in self.opened.values():
            file.close()
        self.opened = {}


def _lists(column: pa.ListArray) -> list[list[tuple]]:
    """A column of lists of structs as lists of tuples, without a dict for each; empty for null."""
    own = column.values
    rows = list(zip(*(own.field(k).to_pylist() for k in range(own.type.num_fields)), strict=True))
    return [rows[a:b] for a, b in pairwise(column.offsets.to_pylist())]


def _joined(spans: list[tuple], most: int) -> list[tuple]:
    """Spans (first, last) of windows up to window ``most``, those that overlap or stand side by side as one."""
    out = []
    for first, last in sorted(spans):
        last = min(last, most)
        if first > last:
            continue
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


class _Windows(InputPartition):
    def __init__(self, image_id: int, path: str, size: int, first: int, count: int):
        self.image_id, self.path, self.size, self.first, self.count = image_id, path, size, first, count


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for p in options["paths"].split(",") if p)
        self.window, self.overlap, self.group = int(options.get("window", 16 << 20)), int(options.get("overlap", 64)), int(options.get("group", 8))
        if not 1 <= self.window <= 64 << 20 or self.overlap < 0:
            raise ValueError("a window has 1 byte to 64 MB")
        self.ids, self.low, self.high = None, 0, None

    def partitions(self):
        out = []
        wanted = [k for k in range(len(self.paths)) if self.ids is None or k in self.ids]
        for image_id, size in zip(wanted, file_sizes([self.paths[k] for k in wanted]), strict=True):
            first, last = self.low // self.window, -(-size // self.window)
            if self.high is not None:
                last = min(last, self.high // self.window + 1)
            out += [_Windows(image_id, self.paths[image_id], size, k, min(self.group, last - k)) for k in range(first, last, self.group)]
        return out

    def read(self, partition):
        files = _Files()
        for k in range(partition.first, partition.first + partition.count):
            base = k * self.window
            yield (partition.image_id, base, min(self.window, partition.size - base), files.read(partition.path, base, self.window + self.overlap))
        files.close()


class _FilteringReader(_Reader):
    """Leaves out images and windows that filters on image_id and base_offset exclude; all filters are evaluated again."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("image_id",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = own if self.ids is None else self.ids & own
            elif getattr(f, "attribute", None) == ("base_offset",):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f


class ImageChunks(DataSource):
    """Images on paths that all executors see: options paths (comma-joined), window, overlap, group (windows a task), pushdown."""

    @classmethod
    def name(cls) -> str:
        return "image_chunks"

    def schema(self) -> str:
        return "image_id long, base_offset long, owned_len long, data binary"

    def reader(self, schema):
        return (_FilteringReader if self.options.get("pushdown") == "true" else _Reader)(self.options)


def read_images(spark: SparkSession, paths: list[str], window: int = 16 << 20, overlap: int = 64) -> DataFrame:
    """Chunks (image_id by place in sorted ``paths``, base_offset, owned_len, data); data runs ``overlap`` bytes into the next.

    Where the session has ``spark.sql.python.filterPushdown.enabled``, filters on image_id and base_offset reach the reader, and other windows
    aren't read.
    """
    spark.dataSource.register(ImageChunks)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("image_chunks").options(paths=",".join(paths), window=window, overlap=overlap, pushdown=pushdown).load()


class TableImages:
    """Images as a table of windows (image_id, base_offset, owned_len, data) of ``window`` bytes; null data is a window that can't be read."""

    def __init__(self, rows: DataFrame, window: int):
        self.rows, self.window = rows, window

    def chunks(self, overlap: int = 0) -> DataFrame:
        """The windows as they are, whatever their overlap."""
        return self.rows

    def sizes(self) -> DataFrame:
        return self.rows.groupBy("image_id").agg(F.max(F.col("base_offset") + F.col("owned_len")).alias("size_bytes"))

    def only(self, ids: DataFrame) -> TableImages:
        """The images of ``ids`` (image_id)."""
        return TableImages(self.rows.join(ids, "image_id", "left_semi"), self.window)

    def read(self, regions: DataFrame) -> DataFrame:
        return read_regions(self.rows, regions, self.window)

    def readable(self, targets: DataFrame) -> DataFrame:
        """Targets (image_id, offset, length, ...) with ``readable``: all windows that they touch are there and have data."""
        last = F.floor((F.col("offset") + F.col("length") - 1) / self.window)
        touched = targets.where("length > 0").withColumn("__n", F.explode(F.sequence(F.floor(F.col("offset") / self.window), last)))
        there = self.rows.select("image_id", F.floor(F.col("base_offset") / self.window).alias("__n"), F.col("data").isNotNull().alias("__there"))
        return touched.join(there, ["image_id", "__n"], "left").groupBy(*targets.columns).agg(F.bool_and(F.coalesce("__there", F.lit(False))).alias("readable"))


def _write(folder: str, batches):
    """Write rows (image_id, start, data, perhaps the number of the task's part) to a new file in ``folder`` and list them; rows that follow each other in their image make one extent."""
    system, inner = _file_system(folder)
    system.create_dir(inner, recursive=True)
    name, at = f"{uuid.uuid4().hex}.img", 0
    path = f"{folder}/{name}"
    # of the extents listed the last one may still grow
    listed: list[list] = []

    def made(rows: list[list]) -> pa.RecordBatch:
        names = [f.split()[0] for f in CATALOG.split(", ")] + ["part"] * (len(rows[0]) - 5)
        return pa.RecordBatch.from_pydict({n: pa.array(v, pa.string() if n == "path" else pa.int64()) for n, v in zip(names, zip(*rows, strict=True), strict=True)})

    with system.open_output_stream(f"{inner}/{name}") as out:
        for batch in batches:
            # null data goes here: as a filter it would make the data twice
            batch = batch.filter(batch.column(2).is_valid())
            parts = zip(*(batch.column(k).to_pylist() for k in range(3, batch.num_columns)), strict=True) if batch.num_columns > 3 else [()] * batch.num_rows
            for image, start, data, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), parts, strict=True):
                out.write(data)
                last = listed[-1] if listed else None
                if last is not None and last[0] == image and start == (None if last[1] is None else last[1] + last[2]):
                    last[2] += len(data)
                else:
                    listed.append([image, start, len(data), path, at, *part])
                at += len(data)
            if len(listed) > 1:
                yield made(listed[:-1])
                del listed[:-1]
        if listed:
            yield made(listed)


class FileImages:
    """Images as extents in files: ``catalog`` (image_id, start and size in the image, path, at: place in the file), a row for each piece of an image.

    Holes between extents and files that can't be read are unreadable bytes. What shuffles are rows of the catalog and regions, never bytes:
    windows and regions go to tasks as places, and are read there by seeking.
    """

    def __init__(self, catalog: DataFrame, window: int = 16 << 20, extents: DataFrame | None = None):
        """``extents``: the catalog as a row an image (image_id, __extents in order, __size), if it is at hand."""
        self.catalog, self.window = catalog, window
        self._grouped = extents

    @classmethod
    def of_paths(cls, spark: SparkSession, paths: list[str | list[str]], window: int = 16 << 20) -> FileImages:
        """An image for each path, or for each list of paths, which hold an image's bytes one behind the other; image_id is its place."""
        rows = []
        for image_id, own in enumerate(paths):
            own, start = [own] if isinstance(own, str) else own, 0
            for path, size in zip(own, file_sizes(own), strict=True):
                rows.append((image_id, start, size, path, 0))
                start += size
        return cls(spark.createDataFrame(rows, CATALOG), window)

    @classmethod
    def written(cls, images: DataFrame, window: int = 16 << 20) -> FileImages:
        """Write images (image_id, start, data: a row for each piece; null data isn't written) to the shared folder, a file for each task, and list them.

        The list is stored, with one row an image, so tasks that ran twice leave a file that nothing names. Pieces that follow each other in their
        image and in a task's rows are one extent.
        """
        folder = shared_path(images.sparkSession, "images")
        rows = images.select(F.col("image_id").cast("long"), F.col("start").cast("long"), "data")
        return cls._listed(rows.mapInArrow(lambda batches: _write(folder, batches), CATALOG), window)

    @classmethod
    def laid(cls, pieces: DataFrame, order: list[str], window: int = 16 << 20) -> FileImages:
        """Write pieces (image_id, data and the columns of ``order``, a full one) as images in which they stand one behind the other; null data isn't written.

        Bytes shuffle once, by ranges of images and ``order``. Every task writes what it has of an image as one extent, so places come from the
        sizes of a few extents and the list of them doesn't grow by the pieces.
        """
        folder = shared_path(pieces.sparkSession, "images")
        # no place is known yet: within a task null places follow each other
        rows = pieces.repartitionByRange("image_id", *order).sortWithinPartitions("image_id", *order)
        rows = rows.select(F.col("image_id").cast("long"), F.lit(None).cast("long").alias("start"), "data", F.spark_partition_id().cast("long").alias("part"))
        parts = rows.mapInArrow(lambda batches: _write(folder, batches), f"{CATALOG}, part long")
        ahead = Window.partitionBy("image_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return cls._listed(parts.withColumn("start", F.coalesce(F.sum("size").over(ahead), F.lit(0).cast("long"))).drop("part"), window)

    @classmethod
    def _listed(cls, catalog: DataFrame, window: int) -> FileImages:
        extents = stored(cls(catalog)._extents(), "extents")
        return cls(extents.select("image_id", F.inline("__extents")), window, extents)

    def sizes(self) -> DataFrame:
        """(image_id, size_bytes), out of the catalog alone."""
        if self._grouped is not None:
            return self._grouped.select("image_id", F.col("__size").alias("size_bytes"))
        return self.catalog.groupBy("image_id").agg(F.max(F.col("start") + F.col("size")).alias("size_bytes"))

    def only(self, ids: DataFrame) -> FileImages:
        """The images of ``ids`` (image_id); the others' bytes aren't read."""
        kept = lambda d: None if d is None else d.join(ids, "image_id", "left_semi")
        return FileImages(kept(self.catalog), self.window, kept(self._grouped))

    def _met(self, rows: DataFrame, how: str) -> DataFrame:
        """``rows`` joined with their image's extents, which are never broadcast: in memory a list of them is many times as large as its file."""
        return rows.join(self._extents().hint("merge"), "image_id", how)

    def _extents(self) -> DataFrame:
        if self._grouped is not None:
            return self._grouped
        own = F.sort_array(F.collect_list(F.struct("start", "size", "path", "at")))
        return self.catalog.groupBy("image_id").agg(own.alias("__extents"), F.max(F.col("start") + F.col("size")).alias("__size"))

    def chunks(self, overlap: int = 64, touching: DataFrame | None = None, joined: bool = False) -> DataFrame:
        """Windows (image_id, base_offset, owned_len, data), each with ``overlap`` bytes of the next; with ``touching`` (image_id, offset, length) only those that these touch.

        Windows side by side, of ``RUN`` bytes at most and of less where all bytes are few, go to a task as one place, and those of them that are
        wanted are read at once; with ``joined`` they come as one row, for what doesn't look at the windows' borders.
        """
        total = self.catalog.agg(F.sum("size")).first()[0] or 0
        tasks = max(self.catalog.sparkSession.sparkContext.defaultParallelism, math.ceil(total / max(TASK, self.window)))
        window, per = self.window, max(1, min(RUN, total // (8 * tasks)) // self.window)
        last = F.floor((F.col("__size") - 1) / window)
        rows = self._extents().where("__size > 0")
        runs = lambda lo, hi: F.explode(F.sequence(F.floor(lo / per), F.floor(hi / per)))
        inside = lambda lo, hi: F.struct(F.greatest(lo, F.col("__run") * per).alias("first"), F.least(hi, F.col("__run") * per + per - 1).alias("last"))
        if touching is None:
            rows = rows.withColumn("__run", runs(F.lit(0), last)).withColumn("__spans", F.array(inside(F.lit(0).cast("long"), last)))
        else:
            hit = touching.where("length > 0 and offset >= 0").select("image_id", F.floor(F.col("offset") / window).alias("__lo"), F.floor((F.col("offset") + F.col("length") - 1) / window).alias("__hi"))
            hit = hit.withColumn("__run", runs(F.col("__lo"), F.col("__hi"))).groupBy("image_id", "__run").agg(F.collect_set(inside(F.col("__lo"), F.col("__hi"))).alias("__spans"))
            rows = self._met(hit, "inner").where("__size > 0").where(F.col("__run") * (per * window) < F.col("__size"))
        base = F.col("__run") * (per * window)
        near = F.filter("__extents", lambda e: (e["start"] < base + per * window + overlap) & (e["start"] + e["size"] > base))
        dealt = rows.select("image_id", "__run", "__size", "__spans", near.alias("__extents")).repartition(tasks, "image_id", "__run")

        def made(rows):
            columns = zip(("image_id", "base_offset", "owned_len", "data"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)
            return pa.RecordBatch.from_pydict({name: pa.array(values, kind) for name, values, kind in columns})

        def read(batches):
            files, rows, size = _Files(), [], 0
            for batch in batches:
                for image, end, spans, extents in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _lists(batch.column(3)), _lists(batch.column(4)), strict=True):
                    for first, last in _joined(spans, -(-end // window) - 1):
                        for base, owned, data in files.windows(extents, end, window, overlap, first, last, joined):
                            rows.append((image, base, owned, data))
                            size += len(data or b"")
                            if size >= BATCH or len(rows) == ROWS:
                                yield made(rows)
                                rows, size = [], 0
            if rows:
                yield made(rows)
            files.close()

        return dealt.mapInArrow(read, "image_id long, base_offset long, owned_len long, data binary")

    def read(self, regions: DataFrame) -> DataFrame:
        """Regions (image_id, offset, length, ...) with their bytes: short at the image's end, null beyond it or where a byte can't be read."""
        names = regions.columns
        lo, hi = F.col("offset"), F.least(F.col("offset") + F.col("length"), F.col("__size"))
        placed = self._met(regions, "left").withColumn("__have", F.when((F.col("length") > 0) & (lo >= 0) & F.col("__size").isNotNull(), hi - lo))
        near = F.filter("__extents", lambda e: (e["start"] < hi) & (e["start"] + e["size"] > lo))
        placed = placed.select(*names, "__have", near.alias("__extents"))

        def read(batches):
            files = _Files()
            for batch in batches:
                found, size, first = [], 0, 0
                rows = zip(batch.column("offset").to_pylist(), batch.column("__have").to_pylist(), _lists(batch.column("__extents")), strict=True)
                for k, (offset, have, extents) in enumerate(rows):
                    data, whole = files.region(extents, offset, have) if (have or 0) > 0 else (b"", False)
                    found.append(data if whole else None)
                    size += len(data)
                    if size >= BATCH or k == batch.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([*batch.slice(first, len(found)).columns[: len(names)], pa.array(found, pa.binary())], names=[*names, "data"])
                        found, size, first = [], 0, k + 1
            files.close()

        return placed.mapInArrow(read, T.StructType([*regions.schema, T.StructField("data", T.BinaryType())]))

    def readable(self, targets: DataFrame) -> DataFrame:
        """Targets (image_id, offset, length, ...) with ``readable``: extents cover all windows that they touch, as the catalog says."""
        window = F.lit(self.window).cast("long")
        lo = F.floor(F.col("offset") / window) * window
        hi = F.least((F.floor((F.col("offset") + F.col("length") - 1) / window) + 1) * window, F.col("__size"))
        # how far the extents reach without a hole, from where the target begins on
        reach = F.aggregate("__extents", lo, lambda at, e: F.when((e["start"] <= at) & (e["start"] + e["size"] > at), e["start"] + e["size"]).otherwise(at))
        inside = F.col("offset") + F.col("length") <= F.ceil(F.col("__size") / window) * window
        rows = self._met(targets.where("length > 0"), "left")
        return rows.select(*targets.columns, F.coalesce((reach >= hi) & inside, F.lit(False)).alias("readable")).distinct()


def as_images(chunks: DataFrame | TableImages | FileImages, window: int) -> TableImages | FileImages:
    """A table of windows as images; images as they are."""
    return TableImages(chunks, window) if isinstance(chunks, DataFrame) else chunks


def read_regions(chunks: DataFrame, regions: DataFrame, window: int) -> DataFrame:
    """Regions (image_id, region_id, offset, length) with their bytes: short at the image's end, null beyond it or where a window of theirs is unreadable (null data)."""
    wanted = regions.where("length > 0 and offset >= 0").withColumn("__n", F.explode(F.sequence(F.floor(F.col("offset") / window), F.floor((F.col("offset") + F.col("length") - 1) / window))))
    met = wanted.join(chunks.withColumn("__n", F.floor(F.col("base_offset") / window)), ["image_id", "__n"])
    lo = F.greatest(F.col("offset") - F.col("base_offset"), F.lit(0))
    hi = F.least(F.col("offset") + F.col("length") - F.col("base_offset"), F.col("owned_len"))
    piece = F.substring(F.col("data"), (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    parts = met.where(hi > lo).groupBy("image_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("__n", F.hex(piece).alias("piece")))).alias("parts"), F.bool_and(F.col("data").isNotNull()).alias("whole"))
    joined = parts.where("whole").select("image_id", "region_id", F.unhex(F.array_join(F.transform("parts", lambda p: p["piece"]), "")).alias("data"))
    return regions.join(joined, ["image_id", "region_id"], "left")
