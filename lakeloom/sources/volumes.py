"""Volumes in NPZ files: seeded crops and points of them, read plane by plane."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Draws that a task takes from one pass over a volume.
RUN = 256
_POINTS = pa.list_(pa.list_(pa.float64()))
_OUT = "file string, draw long, z long, y long, x long, points array<array<double>>, problem string"


def _planes(stream, shape: tuple[int, ...], kind: np.dtype) -> Iterator[np.ndarray]:
    """The planes of the first axis, one after the other."""
    size = int(np.prod(shape[1:])) * kind.itemsize
    for _ in range(shape[0]):
        raw = bytearray()
        while len(raw) < size:
            piece = stream.read(size - len(raw))
            if not piece:
                raise ValueError("the volume ends early")
            raw += piece
        yield np.frombuffer(bytes(raw), dtype=kind).reshape(shape[1:])


def crops(source, draws: list[tuple[int, tuple[float, ...]]], side: int, name: str = "im") -> Iterator[tuple[int, tuple[int, int, int], np.ndarray]]:
    """(draw, corner, cube) for each draw (number, three numbers in 0..1 that say where its corner lies) from the member
    ``name`` of an NPZ file, or its first. Planes are read in order, packed members too; ``side`` of them are held."""
    with zipfile.ZipFile(source) as archive:
        members = [n for n in archive.namelist() if n.endswith(".npy")]
        if not members:
            raise ValueError("no array")
        with archive.open(f"{name}.npy" if f"{name}.npy" in members else members[0]) as stream:
            version = np.lib.format.read_magic(stream)
            shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
            if len(shape) != 3 or min(shape) < side or kind.hasobject:
                raise ValueError("no volume of that size")
            corners = [(d, tuple(int(u * (n - side + 1)) for u, n in zip(us, shape, strict=True))) for d, us in draws]
            turned = shape[::-1] if by_column else shape
            first = 2 if by_column else 0  # the axis that planes are cut along
            waiting = sorted(corners, key=lambda c: (c[1][first], c[0]))
            held: list[np.ndarray] = []
            for k, plane in enumerate(_planes(stream, turned, kind)):
                held = [*held[-(side - 1) :], plane] if side > 1 else [plane]
                while waiting and waiting[0][1][first] == k - side + 1:
                    draw, (z, y, x) = waiting.pop(0)
                    if by_column:  # planes are [y][z] for one x
                        yield draw, (z, y, x), np.stack([p[y : y + side, z : z + side] for p in held]).transpose(2, 1, 0)
                    else:
                        yield draw, (z, y, x), np.stack([p[y : y + side, x : x + side] for p in held])
                if not waiting:
                    return


def volume_points(spark: SparkSession, path: str, draws: int, side: int = 32, points: int = 1024, seed: int = 0) -> DataFrame:
    """(file, draw, z, y, x, points, problem): ``draws`` crops of each .npz file under ``path``, cubes of ``side``, and
    ``points`` of each drawn with replacement as [z / side, y / side, x / side, value, 0, 0].

    What is drawn follows from the seed, the file's name and the draw's number, so that any partitioning gives the same. A
    file that holds no volume that large has one row with a problem. A task holds ``side`` planes of one volume."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path).select("path")
    runs = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(max(0, draws - 1)), F.lit(RUN))).alias("first")).repartition(max(1, spark.sparkContext.defaultParallelism), "path", "first")
    names = ["file", "draw", "z", "y", "x", "points", "problem"]

    def row(file: str, draw: int | None, corner: tuple[int | None, ...], own: list | None, problem: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file]), *(pa.array([v], pa.int64()) for v in (draw, *corner)), pa.array([own], _POINTS), pa.array([problem], pa.string())], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                file = uri.rsplit("/", 1)[-1]
                random = {d: np.random.default_rng([seed, zlib.crc32(file.encode()), d]) for d in range(first, min(first + RUN, draws))}
                wanted = [(d, tuple(r.random(3).tolist())) for d, r in random.items()]
                system, where = fs.FileSystem.from_uri(uri)
                try:
                    with system.open_input_file(where) as source:
                        for draw, corner, cube in crops(source, wanted, side):
                            at = random[draw].integers(0, side**3, points)
                            z, y, x = np.unravel_index(at, (side,) * 3)
                            zero = np.zeros(points)
                            own = np.column_stack([z / side, y / side, x / side, cube[z, y, x].astype(np.float64), zero, zero])
                            yield row(file, draw, corner, own.tolist(), None)
                except (ValueError, zipfile.BadZipFile, zlib.error, EOFError) as e:
                    if first == 0:
                        yield row(file, None, (None,) * 3, None, str(e)[:80])

    return runs.mapInArrow(scan, _OUT)
