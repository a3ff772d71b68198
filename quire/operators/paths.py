"""Outlines in the path notation of SVG: as lines and cubic curves, and their bounding boxes."""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAP = re.compile(r"[\s,]*")
_LETTER = re.compile("[A-Za-z]")
_PART = {"n": r"[\s,]*+((?>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?))", "f": r"[\s,]*+([01])"}
# The arguments of each command, n a number and f a flag of one character.
_TAKES = {"M": "nn", "L": "nn", "H": "n", "V": "n", "C": "nnnnnn", "S": "nnnn", "Q": "nnnn", "T": "nn", "A": "nnnffnn"}
_SHAPES = {name: re.compile("".join(_PART[p] for p in takes)) for name, takes in _TAKES.items()}
_POINTS = ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3")

#: Rows of one batch that leaves a task.
BATCH_ROWS = 10_000


def _arc(a: complex, b: complex, rx: float, ry: float, degrees: float, large: bool, sweep: bool) -> Iterator[tuple[complex, complex, complex]]:
    """Cubic pieces of at most a quarter turn, as (control, control, end), worked out on the unit circle."""
    tilt = cmath.rect(1, math.radians(degrees))
    p, q = (complex((z / tilt).real / rx, (z / tilt).imag / ry) for z in (a, b))
    grow = max(1.0, abs(q - p) / 2)  # radii too short for the distance
    p, q = p / grow, q / grow
    half = (q - p) / 2
    aside = half * 1j * math.sqrt(max(0.0, 1 / abs(half) ** 2 - 1))
    centre = (p + q) / 2 + (aside if large != sweep else -aside)
    turn = cmath.phase((q - centre) / (p - centre))
    if sweep != (turn > 0):
        turn += math.tau if sweep else -math.tau
    n = max(1, math.ceil(abs(turn) / (math.pi / 2) - 1e-9))
    reach = 4 / 3 * math.tan(turn / n / 4) * 1j

    def placed(z: complex) -> complex:
        return complex((centre + z).real * rx * grow, (centre + z).imag * ry * grow) * tilt

    at = p - centre
    for i in range(n):
        to = at * cmath.rect(1, turn / n)
        yield placed(at + reach * at), placed(to - reach * to), b if i == n - 1 else placed(to)
        at = to


def _pieces(d: str) -> list[tuple[bool, list[tuple]]] | None:
    """(closed, [(start, control, control, end)]) of each part that draws; controls of lines are None. None: no path."""
    text, at, letter, parts, is_open, first = d.strip(), 0, "", [], False, False
    here = start = 0j
    cubic = quad = None
    while (at := _GAP.match(text, at).end()) < len(text):
        if named := _LETTER.match(text, at):
            letter, at, first = named[0], at + 1, True
        if letter in ("Z", "z"):
            if is_open:
                parts[-1] = (True, parts[-1][1])
            here, cubic, quad, is_open, letter = start, None, None, False, ""
            continue
        shape = _SHAPES.get(letter.upper())
        given = shape and shape.match(text, at)
        if not given:
            return None
        at, v, name = given.end(), [float(x) for x in given.groups()], letter.upper()
        if not all(map(math.isfinite, v)) or not (is_open or name == "M"):
            return None
        base = here if letter.islower() else 0j
        if name == "H":
            points = [complex(v[0] + base.real, here.imag)]
        elif name == "V":
            points = [complex(here.real, v[0] + base.imag)]
        else:
            used = v[5:] if name == "A" else v
            points = [base + complex(x, y) for x, y in zip(used[::2], used[1::2])]
        to, bends = points[-1], None
        if name == "M" and first:
            parts.append((False, []))
            here = start = to
            cubic = quad = None
            is_open, first = True, False
            continue
        if name == "A":
            rx, ry = abs(v[0]), abs(v[1])
            if here == to:
                continue
            if rx and ry:
                bends, quad = list(_arc(here, to, rx, ry, v[2], v[3] == 1, v[4] == 1)), None
        elif name == "C":
            bends, quad = [tuple(points)], None
        elif name == "S":
            bends, quad = [(here if cubic is None else 2 * here - cubic, *points)], None
        elif name in ("Q", "T"):
            quad = points[0] if name == "Q" else here if quad is None else 2 * here - quad
            bends = [(here + (quad - here) * 2 / 3, to + (quad - to) * 2 / 3, to)]
        if bends is None:
            parts[-1][1].append((here, None, None, to))
            here, cubic, quad = to, None, None
        for c1, c2, end in bends or ():
            parts[-1][1].append((here, c1, c2, end))
            here, cubic = end, c2
    return [part for part in parts if part[1]]


def path_segments(df: DataFrame, key: str, path: str) -> DataFrame:
    """(key, part, closed, segment, kind, x0, y0, x1, y1, x2, y2, x3, y3): what each path draws, in order.

    kind is line or cubic; a segment goes from point 0 to point 3, with points 1 and 2 as the
    controls of a cubic. Quadratic curves and arcs become cubics. S and T mirror the control
    before them, which for S may be that of any curve. Parts that draw nothing have no row
    and no number; a null or empty path has no row. A text that is no path has one row of kind
    malformed, with nulls. Repeated keys are kept apart only by their rows.
    """
    schema = f"closed boolean, kind string, {', '.join(f'{c} double' for c in _POINTS)}"

    def table_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [kind, pa.int32(), pa.bool_(), pa.int32(), pa.string(), *[pa.float64()] * 8]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key, "part", "closed", "segment", "kind", *_POINTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _pieces(d)
                if found is None:
                    rows.append((k, None, None, None, "malformed", *[None] * 8))
                for part, (closed, pieces) in enumerate(found or ()):
                    for i, (a, c1, c2, b) in enumerate(pieces):
                        bends = (None, None, None, None) if c1 is None else (c1.real, c1.imag, c2.real, c2.imag)
                        rows.append((k, part, closed, i, "line" if c1 is None else "cubic", a.real, a.imag, *bends, b.real, b.imag))
                        if len(rows) >= BATCH_ROWS:
                            yield table_of(rows, kind)
                            rows = []
            if rows:
                yield table_of(rows, kind)

    asked = df.where(F.col(path).isNotNull()).select(key, path)
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, part int, {schema.replace('kind', 'segment int, kind', 1)}"
    return asked.mapInArrow(run, out)


def _extremes(p0: Column, p1: Column, p2: Column, p3: Column) -> list[Column]:
    """Along one axis, a cubic's values where it turns around; its start where it does not."""
    a, b, c = p3 - 3 * p2 + 3 * p1 - p0, 2 * (p0 - 2 * p1 + p2), p1 - p0
    inner = b * b - 4 * a * c
    q = F.when(inner >= 0, -(b + F.when(b < 0, -1.0).otherwise(1.0) * F.sqrt(inner)) / 2)
    values = []
    for t in (F.try_divide(q, a), F.try_divide(c, q)):  # steady also where a is nearly 0, as for quadratic curves
        s = 1 - t
        values.append(F.when((t > 0) & (t < 1), s * s * s * p0 + 3 * s * s * t * p1 + 3 * s * t * t * p2 + t * t * t * p3).otherwise(p0))
    return values


def path_boxes(segments: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_segments, left, top, right, bottom): the tight box of segments, curves by their extremes.

    Malformed paths have no row. Each segment's box is built first, so groups only merge boxes.
    """
    drawn = segments.where("kind <> 'malformed'")
    for axis in ("x", "y"):
        p = [F.col(f"{axis}{i}") for i in range(4)]
        bends = _extremes(*p)
        drawn = drawn.withColumn(f"_{axis}min", F.least(p[0], p[3], *bends)).withColumn(f"_{axis}max", F.greatest(p[0], p[3], *bends))
    sides = (F.min("_xmin").alias("left"), F.min("_ymin").alias("top"), F.max("_xmax").alias("right"), F.max("_ymax").alias("bottom"))
    return drawn.groupBy(*by).agg(F.count("*").alias("n_segments"), *sides)
