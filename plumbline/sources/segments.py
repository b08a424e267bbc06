"""Numeric segments in array files as a Spark data source: ``spark.read.format("segments").load(folder)``.

Each ``.npy`` array and each numeric matrix of a level-5 ``.mat`` file is cut along its first axis into slices; a slice is one row, a
file or a part of it one partition.  Pickled content is refused, and a file that is malformed is named in a row of its own.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "path string, name string, row long, shape string, values array<double>, error string"

# Numeric storage types and array classes of the level-5 format.
_STORED = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_NUMERIC_CLASSES = range(6, 16)
_MATRIX, _COMPRESSED = 14, 15


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """Type and content of each element, padded to eight bytes, or small ones of four."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # small: size and type in one word
            kind, size, body = kind & 0xFFFF, kind >> 16, at + 4
            at += 8
        else:
            body = at + 8
            at = body + size + (0 if kind == _COMPRESSED else -size % 8)
        if body + size > len(data):
            raise ValueError("an element is longer than the file")
        yield kind, data[body : body + size]


def read_mat(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Name and values of the real numeric matrices of a level-5 file; others are passed over."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("no level-5 file")
    order = "<" if data[126:128] == b"IM" else ">"
    for kind, body in _elements(data[128:], order):
        if kind == _COMPRESSED:
            ((kind, body),) = list(_elements(zlib.decompress(body), order))
        if kind != _MATRIX:
            continue
        parts = list(_elements(body, order))
        if len(parts) < 4:
            continue
        flags = struct.unpack_from(f"{order}I", parts[0][1])[0]
        if flags & 0xFF not in _NUMERIC_CLASSES or flags & 0x800 or parts[3][0] not in _STORED:
            continue
        shape = np.frombuffer(parts[1][1], f"{order}i4")
        yield parts[2][1].decode("ascii", "replace"), np.frombuffer(parts[3][1], order + _STORED[parts[3][0]]).reshape(shape, order="F")


def read_arrays(path: str, data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """The numeric arrays of one file."""
    if path.endswith(".mat"):
        yield from read_mat(data)
        return
    x = np.load(io.BytesIO(data), allow_pickle=False)
    if x.dtype.kind not in "biuf":
        raise ValueError(f"values of type {x.dtype} are no numbers")
    yield "", x


class _Slice(InputPartition):
    def __init__(self, path: str, part: int, parts: int) -> None:
        self.path, self.part, self.parts = path, part, parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.most = options["path"], int(options.get("bytesperpartition", 64 << 20))
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - the interface's name
        """An equality on ``name`` is done here, so other arrays are not cut up."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names = {f.value} if self.names is None else self.names & {f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, root = pafs.FileSystem.from_uri(self.folder)
        found = [f for f in where.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith((".npy", ".mat"))]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            parts = max(1, -(-f.size // self.most))
            out += [_Slice(f.path, k, parts) for k in range(parts)]
        return out

    def read(self, partition: _Slice) -> Iterator[tuple]:
        where, _ = pafs.FileSystem.from_uri(self.folder)
        with where.open_input_stream(partition.path) as f:
            data = f.read()
        try:
            for name, x in read_arrays(partition.path, data):
                if self.names is not None and name not in self.names:
                    continue
                x = x.reshape(1) if x.ndim == 0 else x
                shape = "x".join(map(str, x.shape))
                for i in range(len(x) * partition.part // partition.parts, len(x) * (partition.part + 1) // partition.parts):
                    yield partition.path, name, i, shape, [float(v) for v in np.asarray(x[i]).ravel()], None
        except (ValueError, struct.error, zlib.error, EOFError) as e:
            if partition.part == 0:
                yield partition.path, None, None, None, None, str(e)[:200]


class Segments(DataSource):
    """Options: ``path``, a folder that is read to any depth, as a URI; ``bytesPerPartition``, above which a file is several
    partitions."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it hand filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Segments)
