"""The data source of array files."""

from __future__ import annotations

import pickle
import struct
import zlib

import numpy as np
import pytest

from plumbline.sources import segments


def element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def matrix(name, x, kind=9, dtype="<f8", flags=6):
    name = name.encode()
    return element(14, element(6, struct.pack("<II", flags, 0)) + element(5, np.array(x.shape, "<i4").tobytes()) + element(1, name) + element(kind, x.astype(dtype).tobytes(order="F")))


def mat(*parts):
    return b"level 5".ljust(124, b" ") + struct.pack("<H", 0x0100) + b"IM" + b"".join(parts)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(3, 4))
    np.save(tmp_path / "deep" / "b.npy", np.array([1, 2, 3], np.int16))
    np.save(tmp_path / "scalar.npy", np.float32(2.5))
    np.save(tmp_path / "objects.npy", np.array([{"x": 1}], object), allow_pickle=True)
    (tmp_path / "pickle.npy").write_bytes(pickle.dumps([1, 2]))
    one, two = np.arange(6.0).reshape(2, 3), np.array([[7, 8]])
    body = matrix("small", two, 3, "<i2", 10)
    packed = zlib.compress(body)
    (tmp_path / "c.mat").write_bytes(mat(matrix("wide", one), struct.pack("<II", 15, len(packed)) + packed, matrix("text", two, 4, "<u2", 4)))
    (tmp_path / "broken.mat").write_bytes(mat(matrix("wide", one))[:-10])
    (tmp_path / "other.txt").write_text("no array")
    return f"file://{tmp_path}"


def test_arrays_of_a_folder(spark, folder):
    segments.register(spark)
    df = spark.read.format("segments").load(folder)
    rows = df.collect()
    good = sorted((r.path.rsplit("/", 1)[-1], r.name, r.row, r.shape, r["values"]) for r in rows if r.error is None)
    assert good == [
        ("a.npy", "", 0, "3x4", [0.0, 1.0, 2.0, 3.0]), ("a.npy", "", 1, "3x4", [4.0, 5.0, 6.0, 7.0]), ("a.npy", "", 2, "3x4", [8.0, 9.0, 10.0, 11.0]),
        ("b.npy", "", 0, "3", [1.0]), ("b.npy", "", 1, "3", [2.0]), ("b.npy", "", 2, "3", [3.0]),
        ("c.mat", "small", 0, "1x2", [7.0, 8.0]), ("c.mat", "wide", 0, "2x3", [0.0, 1.0, 2.0]), ("c.mat", "wide", 1, "2x3", [3.0, 4.0, 5.0]), ("scalar.npy", "", 0, "1", [2.5]),
    ]
    assert sorted(r.path.rsplit("/", 1)[-1] for r in rows if r.error) == ["broken.mat", "objects.npy", "pickle.npy"]


def test_slices_and_names(spark, folder):
    segments.register(spark)
    cut = spark.read.format("segments").option("bytesPerPartition", "100").load(folder)
    assert cut.rdd.getNumPartitions() > 7 and cut.where("error is null").count() == 10 and cut.where("error is not null").count() == 3
    assert sorted(r.row for r in cut.where("name = 'wide'").collect()) == [0, 1]
