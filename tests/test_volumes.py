"""Crops and points of volumes against the arrays themselves."""

import io

import numpy as np
import pytest

from lakeloom.sources import volumes


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("order", ["C", "F"])
def test_crops_are_parts_of_the_array(packed, order):
    cube = np.asarray(np.random.default_rng(1).integers(0, 99, (9, 7, 11)).astype(np.int16), order=order)
    raw = io.BytesIO()
    (np.savez_compressed if packed else np.savez)(raw, other=np.zeros(3), im=cube)
    draws = [(d, tuple(np.random.default_rng(d).random(3))) for d in range(60)] + [(60, (0.0, 0.0, 0.0)), (61, (0.999999,) * 3)]
    got = list(volumes.crops(raw, draws, 4))
    assert sorted(d for d, *_ in got) == list(range(62))
    for _, (z, y, x), own in got:
        assert (own == cube[z : z + 4, y : y + 4, x : x + 4]).all() and own.shape == (4, 4, 4)
    assert {c for d, c, _ in got if d >= 60} == {(0, 0, 0), (5, 3, 7)}


def test_points_do_not_depend_on_partitions(spark, tmp_path):
    rng = np.random.default_rng(2)
    cubes = {"a": rng.random((8, 9, 10)).astype(np.float32), "b": rng.integers(0, 2, (6, 6, 6)).astype(np.uint8)}
    np.savez(tmp_path / "a.npz", im=cubes["a"])
    np.savez_compressed(tmp_path / "b.npz", vol=cubes["b"])
    np.savez(tmp_path / "small.npz", im=np.zeros((3, 9, 9)))
    (tmp_path / "broken.npz").write_bytes(b"PK no archive")
    out = volumes.volume_points(spark, f"file://{tmp_path}", 5, side=5, points=40, seed=3)
    got = out.collect()
    good = [r for r in got if r.problem is None]
    assert {(r.file, r.draw) for r in good} == {(f, d) for f in ("a.npz", "b.npz") for d in range(5)} and {r.file for r in got if r.problem} == {"small.npz", "broken.npz"}
    for r in good:
        cube = cubes[r.file[0]]
        for z, y, x, v, *zeros in r.points:
            assert v == pytest.approx(float(cube[r.z + round(z * 5), r.y + round(y * 5), r.x + round(x * 5)])) and zeros == [0, 0]
        assert len(r.points) == 40
    again = volumes.volume_points(spark, f"file://{tmp_path}", 3, side=5, points=40, seed=3).where("problem is null").collect()
    assert all(r in good for r in again)
