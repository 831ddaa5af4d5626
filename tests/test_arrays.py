"""Array kernels of whole WKB columns against the functions of single geometries."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from terrafold.functions import shapes, udfs, wkb


def column() -> pa.Array:
    r = random.Random(5)
    out: list = [None]
    for _ in range(400):
        dims = r.randrange(4)
        point = lambda: [float(r.randint(-2, 2)) for _ in range(wkb.WIDTH[dims])]  # noqa: B023, E731
        line = lambda least: np.array([point() for _ in range(r.choice([least, 1, 2, 5]))], dtype=np.float64).reshape(-1, wkb.WIDTH[dims])  # noqa: B023, E731
        kind = r.choice([wkb.POINT, wkb.LINE, wkb.LINE, wkb.POLYGON, wkb.MULTILINE])
        data = {
            wkb.POINT: lambda: line(0)[:1],
            wkb.LINE: lambda: line(0),
            wkb.POLYGON: lambda: [line(4) for _ in range(r.randrange(3))],
            wkb.MULTILINE: lambda: [(wkb.LINE, dims, line(0)) for _ in range(r.randrange(3))],  # noqa: B023
        }[kind]()
        out.append(wkb.write((kind, dims, data)))
        out.append(r.choice([None, out[-1]]))
    big = struct.pack(">BII4d", 0, wkb.LINE, 2, 1.0, 2.0, 3.0, 4.0)
    return pa.array([*out, big], pa.binary())


@pytest.mark.parametrize("name, slow", [("st_startpoint", udfs._end(False)), ("st_endpoint", udfs._end(True)), ("st_envelope", shapes.envelope)])
def test_whole_columns(name, slow):
    got, want = udfs.TABLE[name][0](column()), udfs._each(slow, "binary")(column())
    assert got.type == want.type and got.to_pylist() == want.to_pylist()
    part = column().slice(7, 90)
    assert udfs.TABLE[name][0](part).to_pylist() == want.to_pylist()[7:97]
    assert udfs.TABLE[name][0](pa.array([], pa.binary())).to_pylist() == []
    assert udfs.TABLE[name][0](pa.nulls(3, pa.binary())).to_pylist() == [None] * 3


def test_numbered_points():
    lines = column()
    numbers = pa.array([random.Random(k).choice([None, -6, -5, -2, -1, 0, 1, 2, 5, 6]) for k in range(len(lines))], pa.int32())
    got = udfs.TABLE["st_pointn"][0](lines, numbers)
    assert got.to_pylist() == udfs._each(udfs._point_n, "binary")(lines, numbers).to_pylist()
    assert got.null_count < len(got)
