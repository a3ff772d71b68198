"""Lengths, colours and levels of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points in one of each unit.
POINTS = {"pt": 1.0, "in": 72.0, "cm": 72 / 2.54, "mm": 72 / 25.4, "pc": 12.0, "px": 0.75, "twip": 1 / 20, "emu": 1 / 12700, "halfpt": 0.5}


def convert(value: Column, unit: str, to: str) -> Column:
    """A length in another unit."""
    return value * F.lit(POINTS[unit] / POINTS[to])


def parse_length(text: Column) -> Column:
    """A length such as 2.5cm in points; null where it is none."""
    pattern = r"^\s*(-?[0-9]*\.?[0-9]+)\s*(pt|in|cm|mm|pc|px)\s*$"
    table = F.create_map(*(F.lit(x) for u in ("pt", "in", "cm", "mm", "pc", "px") for x in (u, POINTS[u])))
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).cast("double") * table[F.regexp_extract(text, pattern, 2)])


def parse_colour(text: Column) -> Column:
    """struct(r, g, b), each 0 to 1, of #rrggbb or rrggbb; null where it is none."""
    pattern = "^#?([0-9A-Fa-f]{6})$"
    code = F.regexp_extract(text, pattern, 1)
    part = lambda i: F.conv(F.substring(code, i, 2), 16, 10).cast("double") / 255
    return F.when(text.rlike(pattern), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def colour(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of parts from 0 to 1; halves round up."""
    part = lambda c: F.lpad(F.lower(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255 + 0.5).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def heading_level(level: Column) -> Column:
    """A level within 1 to 6."""
    return F.greatest(F.lit(1), F.least(F.lit(6), F.floor(level + 0.5).cast("int")))


def flip_y(y: Column, height: Column) -> Column:
    """A position counted from the other end of a page of that height."""
    return height - y


def transform_point(matrix: Column, x: Column, y: Column) -> Column:
    """struct(x, y): a point moved by struct(a, b, c, d, e, f), x' = ax + cy + e and y' = bx + dy + f."""
    m = lambda n: matrix[n]
    return F.struct((m("a") * x + m("c") * y + m("e")).alias("x"), (m("b") * x + m("d") * y + m("f")).alias("y"))


def compose(first: Column, then: Column) -> Column:
    """The matrix of one transform followed by another."""
    p, q = lambda n: first[n], lambda n: then[n]
    return F.struct(
        (q("a") * p("a") + q("c") * p("b")).alias("a"), (q("b") * p("a") + q("d") * p("b")).alias("b"),
        (q("a") * p("c") + q("c") * p("d")).alias("c"), (q("b") * p("c") + q("d") * p("d")).alias("d"),
        (q("a") * p("e") + q("c") * p("f") + q("e")).alias("e"), (q("b") * p("e") + q("d") * p("f") + q("f")).alias("f"),
    )


def rotation(degrees: Column, x: Column, y: Column) -> Column:
    """The matrix of a turn about the point (x, y)."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.struct(cos.alias("a"), sin.alias("b"), (-sin).alias("c"), cos.alias("d"), (x - cos * x + sin * y).alias("e"), (y - sin * x - cos * y).alias("f"))
