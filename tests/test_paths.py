import cmath
import math

from quire.operators import paths


def segments(spark, *texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, d string, part string")
    return paths.path_segments(df, "id", "d")


def drawn(spark, text):
    rows = segments(spark, text).orderBy("part", "segment").collect()
    return [(r.part, r.closed, r.kind, tuple(None if r[c] is None else round(r[c], 6) + 0.0 for c in ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"))) for r in rows]


def box(spark, text):
    r = paths.path_boxes(segments(spark, text), ["id"]).first()
    return tuple(round(r[c], 4) + 0.0 for c in ("left", "top", "right", "bottom"))


def line(*p):
    return (p[0], p[1], None, None, None, None, p[2], p[3])


def test_lines_repeat_and_close(spark):
    assert drawn(spark, "M10-5 20.5.5l1e1,2 h-3V7zm1 1 2 2") == [
        (0, True, "line", line(10, -5, 20.5, 0.5)), (0, True, "line", line(20.5, 0.5, 30.5, 2.5)), (0, True, "line", line(30.5, 2.5, 27.5, 2.5)), (0, True, "line", line(27.5, 2.5, 27.5, 7)),
        (1, False, "line", line(11, -4, 13, -2)),
    ]
    assert drawn(spark, "M1 1 M2 2 L3 3 M4 4") == [(0, False, "line", line(2, 2, 3, 3))]


def test_mirrored_controls(spark):
    assert drawn(spark, "M0 0C0 3 3 3 3 0s3-3 3 0") == [(0, False, "cubic", (0, 0, 0, 3, 3, 3, 3, 0)), (0, False, "cubic", (3, 0, 3, -3, 6, -3, 6, 0))]
    assert drawn(spark, "M0 0S1 1 3 0") == [(0, False, "cubic", (0, 0, 0, 0, 1, 1, 3, 0))]
    assert drawn(spark, "M0 0Q3 3 6 0t6 0") == [(0, False, "cubic", (0, 0, 2, 2, 4, 2, 6, 0)), (0, False, "cubic", (6, 0, 8, -2, 10, -2, 12, 0))]
    assert drawn(spark, "M0 0L6 0T9 9")[1][3] == (6, 0, 6, 0, 7, 3, 9, 9)


def test_refused_and_empty(spark):
    texts = ["", None, "  ", "5 5", "L1 1", "M1", "M1 1Z L2 2", "M1 1 L2", "M1 1X2", "M0 0 Z 1 1", "M0 0L1e999 1", "M0 0A1 1 0 2 0 1 1", "M0 0#", "M12"]
    assert sorted((r.id, r.kind) for r in segments(spark, *texts).collect()) == [(i, "malformed") for i in range(3, len(texts))]
    assert paths.path_boxes(segments(spark, *texts), ["id"]).count() == 0
    none = paths.path_segments(spark.createDataFrame([], "id int, d string"), "id", "d")
    assert none.count() == 0 and paths.path_boxes(none, ["id"]).count() == 0


def test_boxes_of_curves(spark):
    assert box(spark, "M0 0Q5 10 10 0") == (0, 0, 10, 5)
    assert box(spark, "M0 0C0 10 10 10 10 0") == (0, 0, 10, 7.5)
    along = lambda t, a, b, c, d: (1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * b + 3 * (1 - t) * t * t * c + t**3 * d
    xs, ys = ([along(t / 10_000, *p) for t in range(10_001)] for p in ((1, 30, -20, 10), (0, -7, 2, 9)))
    assert all(abs(a - b) < 1e-3 for a, b in zip(box(spark, "M1 0C30-7-20 2 10 9"), (min(xs), min(ys), max(xs), max(ys))))
    assert box(spark, "M-5 0A5 5 0 0 1 5 0") == (-5, -5, 5, 0)
    assert box(spark, "M3 3H3") == (3, 3, 3, 3)


def test_arcs_lie_on_their_ellipse(spark):
    for flags, pieces in (("00", 1), ("01", 1), ("10", 3), ("11", 3)):
        rows = segments(spark, f"M10 0A10 10 0 {flags}0 10").orderBy("segment").collect()
        assert len(rows) == pieces
        centre = 0 if flags in ("01", "10") else 10 + 10j
        for r in rows:
            p = [complex(r[f"x{i}"], r[f"y{i}"]) for i in range(4)]
            for k in range(11):
                t = k / 10
                z = (1 - t) ** 3 * p[0] + 3 * (1 - t) ** 2 * t * p[1] + 3 * (1 - t) * t * t * p[2] + t**3 * p[3]
                assert abs(abs(z - centre) - 10) < 0.01
        assert (rows[-1].x3, rows[-1].y3) == (0, 10)
    turned = segments(spark, "M0 0A4 2 30 1 1 1 1").orderBy("segment").collect()
    ends = [complex(r.x0, r.y0) for r in turned] + [1 + 1j]
    flat = [complex((z / cmath.rect(1, math.radians(30))).real / 4, (z / cmath.rect(1, math.radians(30))).imag / 2) for z in ends]
    assert len(flat) >= 4
    b, c = flat[1] - flat[0], flat[2] - flat[0]
    centre = flat[0] + (abs(b) ** 2 * c - abs(c) ** 2 * b) / (b.conjugate() * c - b * c.conjugate())
    assert all(abs(abs(z - centre) - 1) < 1e-9 for z in flat)


def test_flat_and_short_arcs(spark):
    assert drawn(spark, "M0 0A0 5 0 0 1 4 4") == [(0, False, "line", line(0, 0, 4, 4))]
    assert drawn(spark, "M0 0A5 5 0 0 1 0 0") == []
    assert box(spark, "M0 0A1 1 0 0 1 8 0") == (0, -4, 8, 0)  # radii grow to reach
