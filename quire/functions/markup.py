"""Markup inside text: character references, Markdown links and bare addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five predefined references; the ampersand is escaped first and decoded last.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
_LINK = r'(!?)\[((?:[^\[\]\\]|\\.)*+)\]\(\s*<?((?:[^()<>\s\\]|\\.)*+)>?(?:\s+"((?:[^"\\]|\\.)*+)")?\s*\)'
_EMAIL = r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@(?:[A-Za-z0-9_-]++\.)+[A-Za-z0-9_-]*[A-Za-z0-9]"
_URL = r"(?<![A-Za-z0-9])(?:https?://|www\.)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+(?:[/?#][^\s<]*[^\s<?!.,:*_~'\")])?"


def escape(text: Column) -> Column:
    """A text with the five predefined characters as references."""
    for character, reference in REFERENCES:
        text = F.replace(text, F.lit(character), F.lit(reference))
    return text


def unescape(text: Column) -> Column:
    """A text with the five predefined references decoded, each once."""
    for character, reference in reversed(REFERENCES):
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def links(text: Column) -> Column:
    """Structs (image, label, target, title) of a Markdown text's inline links and images, in order."""
    group = lambda i: F.regexp_extract_all(text, F.lit(_LINK), F.lit(i))
    zipped = F.arrays_zip(group(1).alias("bang"), group(2).alias("label"), group(3).alias("target"), group(4).alias("title"))
    plain = lambda c: F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")
    return F.transform(zipped, lambda z: F.struct((z["bang"] == "!").alias("image"), plain(z["label"]).alias("label"), plain(z["target"]).alias("target"), F.nullif(plain(z["title"]), F.lit("")).alias("title")))


def autolinks(text: Column) -> Column:
    """The targets of a text's bare addresses: urls as they are or with http:// before www., then mailto: for emails."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    urls = F.transform(found(_URL), lambda u: F.when(u.startswith("www."), F.concat(F.lit("http://"), u)).otherwise(u))
    return F.concat(urls, F.transform(found(_EMAIL), lambda e: F.concat(F.lit("mailto:"), e)))


def leaf_text(runs: Column) -> Column:
    """The text of a paragraph from its runs: one after the other, nothing between."""
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")


def list_id(number: Column, ordered: Column, start: Column, task: Column, loose: Column) -> Column:
    """The id of a list, such as md3:ordered@5+task: number, marker, a start other than 1, and its flags."""
    kind = F.when(ordered, F.concat(F.lit("ordered"), F.when(start != 1, F.concat(F.lit("@"), start.cast("string"))).otherwise(""))).otherwise("bullet")
    return F.concat(F.lit("md"), number.cast("string"), F.lit(":"), kind, F.when(task, "+task").otherwise(""), F.when(loose, "+loose").otherwise(""))


def parse_list_id(text: Column) -> Column:
    """struct(kind, start, task, loose) of such an id; null for any other text."""
    pattern = r"^md[0-9]+:(bullet|ordered)(?:@([0-9]+))?(\+task)?(\+loose)?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    start = F.when(part(1) == "ordered", part(2).try_cast("int"))
    return F.when(text.rlike(pattern), F.struct(part(1).alias("kind"), start.alias("start"), (part(3) != "").alias("task"), (part(4) != "").alias("loose")))


def collapse_spaces(text: Column) -> Column:
    """Text as an OpenDocument paragraph reads it: runs of white space are one space, the ends have none."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def base64_of(data: Column) -> Column:
    """Bytes as base64 in one line."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))
