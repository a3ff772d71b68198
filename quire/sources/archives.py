"""Archives as tables of parts: one row per entry of each zip file, nested archives included."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nested archives are opened down to this depth, and one file may unpack to this many bytes.
MAX_DEPTH = 8
MAX_BYTES = 512 << 20
_MAGIC = b"PK\x03\x04"


class ArchiveLimit(ValueError):
    """An archive is nested too deep or unpacks to too much."""


def sniff(content: Column) -> Column:
    """The format of a file by its first bytes: png, jpeg, zip, cfb (an OLE container), pdf or unknown."""
    kinds = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "zip": "504B0304", "cfb": "D0CF11E0A1B11AE1", "pdf": "25504446"}
    found = F
    for name, magic in kinds.items():
        found = found.when(F.startswith(content, F.unhex(F.lit(magic))), name)
    return found.otherwise("unknown")


def _entries(data: bytes, prefix: str, depth: int, left: list[int]) -> Iterator[tuple[str, bytes]]:
    if depth > MAX_DEPTH:
        raise ArchiveLimit(f"{prefix} is nested more than {MAX_DEPTH} deep")
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            left[0] -= info.file_size
            if left[0] < 0:
                raise ArchiveLimit(f"{prefix} unpacks to more than {MAX_BYTES} bytes")
            content = archive.read(info)
            yield prefix + info.filename, content
            if content[:4] == _MAGIC:
                yield from _entries(content, f"{prefix}{info.filename}!/", depth + 1, left)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, content) of every entry of the zip files under a path, one task per file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part, content in _entries(data, "", 1, [MAX_BYTES]):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([part]), pa.array([content], pa.binary())], ["file", "part", "content"])

    files = spark.read.format("binaryFile").load(path).where(F.startswith("content", F.unhex(F.lit(_MAGIC.hex()))))
    return files.select("path", "content").mapInArrow(run, "file string, part string, content binary")
