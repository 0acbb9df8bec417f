"""DICOM files (Part 10) as a binary column: the identifying elements of their datasets, read without a DICOM library."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caduspark.functions import fixed

#: Fixed values of the standard: value representations with a 32-bit length, and transfer syntaxes that are not little-endian explicit.
_LONG = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
_IMPLICIT, _DEFLATED, _BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
_ITEM, _ITEM_END, _SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
_UNDEFINED = 0xFFFFFFFF


def _next(data: bytes, at: int, order: str, explicit: bool) -> tuple[tuple[int, int], int, int]:
    """(tag, length, place of the value) of the element at a place."""
    tag = struct.unpack_from(order + "HH", data, at)
    if tag[0] == 0xFFFE or not explicit:
        return tag, struct.unpack_from(order + "I", data, at + 4)[0], at + 8
    if data[at + 4 : at + 6].decode("latin-1") in _LONG:
        return tag, struct.unpack_from(order + "I", data, at + 8)[0], at + 12
    return tag, struct.unpack_from(order + "H", data, at + 6)[0], at + 8


def _meta(data: bytes) -> tuple[str, int]:
    """(transfer syntax, place of the dataset): the file's own group 2 is little-endian explicit always."""
    at, syntax = 132, ""
    while at < len(data) and data[at : at + 2] == b"\x02\x00":
        tag, length, at = _next(data, at, "<", True)
        if tag == (0x0002, 0x0010):
            syntax = data[at : at + length].decode("latin-1").rstrip("\0 ")
        at += length
    return syntax, at


def identifying(data: bytes | None) -> list[str]:
    """Keywords of the identifying elements at the top of a dataset, in order of their tags.

    Null, other files and empty datasets have none; of a damaged file, what stands before the damage.  Elements within
    sequences don't count, and elements beyond the last identifying tag aren't read, so pixels cost nothing.
    """
    if data is None or data[128:132] != b"DICM":
        return []
    found, depth, last = [], 0, max(fixed.DICOM_TAGS)
    try:
        syntax, at = _meta(data)
        order, explicit = (">" if syntax == _BIG else "<"), syntax != _IMPLICIT
        if syntax == _DEFLATED:
            data, at = zlib.decompressobj(-15).decompress(data[at:], 1 << 20), 0
        while at < len(data):
            tag, length, at = _next(data, at, order, explicit)
            if tag in (_ITEM_END, _SEQUENCE_END):
                depth -= 1
            elif length == _UNDEFINED:
                depth += 1
            else:
                if depth == 0 and tag in fixed.DICOM_TAGS:
                    found.append(fixed.DICOM_TAGS[tag])
                at += length
            if depth == 0 and last <= tag < _ITEM:
                break
    except (struct.error, zlib.error):
        pass
    return found


def scan_dicom(df: DataFrame, column: str, name: str = "redacted", found: str = "found") -> DataFrame:
    """df with [REDACTED:DICOM_DATASET] for each dataset that identifies a person, else null, and its hits, array<struct<phi_type, source, confidence>>."""

    @F.arrow_udf("array<string>")
    def run(files: pa.Array) -> pa.Array:
        return pa.array([identifying(x) for x in files.to_pylist()], pa.list_(pa.string()))

    hit = lambda k: F.struct(F.upper(k).alias("phi_type"), F.concat(F.lit("dicom:"), k).alias("source"), F.lit(0.99).alias("confidence"))
    out = df.withColumn("__keywords", run(F.col(f"`{column}`")))
    return out.withColumn(found, F.transform("__keywords", hit)).withColumn(name, F.when(F.size("__keywords") > 0, F.lit("[REDACTED:DICOM_DATASET]"))).drop("__keywords")


def read_dicom(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with their bytes: (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
