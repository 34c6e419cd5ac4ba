"""Polygons of zipped shapefiles."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: the types of polygons, plain, with heights and with measures.
POLYGONS = (5, 15, 25)


def records(shapes: bytes) -> Iterator[list[list[list[float]]]]:
    """The rings of each record of a .shp file; none for a record that is no polygon."""
    at = 100
    while at + 12 <= len(shapes):
        size = 2 * struct.unpack_from(">i", shapes, at + 4)[0]
        body = shapes[at + 8 : at + 8 + size]
        at += 8 + size
        if struct.unpack_from("<i", body)[0] not in POLYGONS:
            yield []
            continue
        parts, points = struct.unpack_from("<2i", body, 36)
        starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
        yield [[[flat[2 * i], flat[2 * i + 1]] for i in range(a, z)] for a, z in zip(starts, starts[1:])]


def attributes(table: bytes) -> Iterator[dict[str, str]]:
    """The records of a .dbf file as texts."""
    count, head, size = struct.unpack_from("<ihh", table, 4)
    fields, at = [], 32
    while table[at] != 0x0D:
        fields.append((table[at : at + 11].split(b"\0")[0].decode("latin-1"), table[at + 16]))
        at += 32
    for k in range(count):
        offset, row = head + k * size + 1, {}
        for name, width in fields:
            row[name] = table[offset : offset + width].decode("utf-8", "replace").strip("\0 ")
            offset += width
        yield row


def clockwise(ring: list[list[float]]) -> bool:
    """Whether a ring is an outer one: those run clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) <= 0


def shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, ring, properties, prj) of the outer rings in zipped shapefiles, a task a file [S09]. prj: the projection's text, or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    by_end = {n.lower().rsplit(".", 1)[-1]: n for n in z.namelist() if "__MACOSX" not in n}
                    if "shp" not in by_end:
                        raise ValueError(f"no shapefile in {file}")
                    shapes = list(records(z.read(by_end["shp"])))
                    rows = list(attributes(z.read(by_end["dbf"]))) if "dbf" in by_end else [{}] * len(shapes)
                    prj = z.read(by_end["prj"]).decode("utf-8", "replace") if "prj" in by_end else None
                found = [(file, pos, ring, row, prj) for pos, (rings, row) in enumerate(zip(shapes, rows, strict=True)) for ring in rings if clockwise(ring)]
                yield pd.DataFrame(found, columns=["file", "pos", "ring", "properties", "prj"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, pos int, ring array<array<double>>, properties map<string,string>, prj string")
