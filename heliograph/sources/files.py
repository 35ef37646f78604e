"""Readers of binary files by Spark's ``binaryFile`` source: EXIF tags, lookup tables, tensor headers, archive listings, vocabularies.

Files are rows; each is parsed in the task that reads it, in Arrow batches, by
bytes of one file.  A file that can't be parsed gives a row with its path and
nulls, never an error.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Tags of image file directories by number, and whether they stand in the first directory or in the one for exposure.
EXIF_TAGS = {
    0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x829A: "exposure_time", 0x829D: "f_number", 0x8827: "iso", 0x9003: "taken", 0x920A: "focal_length",
    0xA002: "width", 0xA003: "height", 0xA434: "lens",
}
EXPOSURE_DIRECTORY = 0x8769
EXIF = "path string, make string, model string, lens string, orientation int, iso int, exposure_time double, f_number double, focal_length double, taken string, width int, height int"
#: Bytes of a value by its type.
_WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path``, ``length`` and ``content`` of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def parsed(files: DataFrame, schema: str, parse: Callable[[bytes], dict | None]) -> DataFrame:
    """``path``, what ``parse`` makes of each file's bytes, and ``error``: why it could not, with nulls in the other columns."""

    schema = f"{schema}, error string"
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    own = parse(content.as_py() or b"") or {}
                except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile) as problem:
                    own = {"error": f"{type(problem).__name__}: {problem}"}
                rows.append({"path": path} | own)
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "content").mapInArrow(scan, schema)


def exif_of(content: bytes) -> dict | None:
    """The tags of :data:`EXIF_TAGS` of a TIFF (either byte order), or of the EXIF segment of a JPEG."""
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF:
            mark, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if mark == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return _directories(content[at + 10 : at + 2 + size])
            if mark == 0xDA:
                return None
            at += 2 + size
        return None
    return _directories(content)


def _directories(raw: bytes) -> dict | None:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if order is None:
        return None
    found: dict[str, object] = {}
    waiting, seen = [struct.unpack(f"{order}I", raw[4:8])[0]], set()
    while waiting:
        at = waiting.pop()
        if at in seen:
            continue
        seen.add(at)
        for k in range(struct.unpack(f"{order}H", raw[at : at + 2])[0]):
            entry = raw[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(f"{order}HHI", entry[:8])
            size = _WIDTHS.get(kind, 0) * count
            start = struct.unpack(f"{order}I", entry[8:])[0]
            value = _value(order, kind, entry[8 : 8 + size] if size <= 4 else raw[start : start + size])
            if tag == EXPOSURE_DIRECTORY:
                waiting.append(int(value))
            elif tag in EXIF_TAGS and value is not None:
                found.setdefault(EXIF_TAGS[tag], value)
    for name in ("exposure_time", "f_number", "focal_length"):
        if name in found:
            found[name] = float(found[name])
    return found


def _value(order: str, kind: int, raw: bytes) -> object:
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None
    if kind in (5, 10):
        above, below = struct.unpack(f"{order}{'II' if kind == 5 else 'ii'}", raw[:8])
        return above / below if below else None
    code = {1: "B", 3: "H", 4: "I", 9: "i"}.get(kind)
    return struct.unpack(f"{order}{code}", raw[: _WIDTHS[kind]])[0] if code else None


def exif(files: DataFrame) -> DataFrame:
    """``path`` and EXIF columns of each file."""
    return parsed(files, EXIF, exif_of)


CUBE = "path string, title string, size int, domain_min array<double>, domain_max array<double>, data array<double>"


def cube_of(content: bytes) -> dict:
    """A lookup table of the ``.cube`` format: lines of three numbers, red fastest; comments and unknown lines are passed over."""
    out: dict[str, object] = {"title": "", "size": 0, "domain_min": [0.0, 0.0, 0.0], "domain_max": [1.0, 1.0, 1.0]}
    data: list[float] = []
    for line in map(str.strip, content.decode("utf-8").splitlines()):
        word, _, rest = line.partition(" ")
        key = word.upper()
        if not line or line.startswith("#"):
            continue
        if key == "TITLE":
            out["title"] = rest.strip().strip('"')
        elif key == "LUT_3D_SIZE":
            out["size"] = int(rest)
        elif key in ("DOMAIN_MIN", "DOMAIN_MAX"):
            out[key.lower()] = [float(v) for v in rest.split()[:3]]
        else:
            try:
                data += [float(v) for v in line.split()[:3]] if len(line.split()) >= 3 else []
            except ValueError:
                continue
    if out["size"] <= 0 or len(data) < 3 * out["size"] ** 3:
        raise ValueError("no table")
    return out | {"data": data[: 3 * out["size"] ** 3]}


def cubes(files: DataFrame) -> DataFrame:
    return parsed(files, CUBE, cube_of)


TENSORS = "path string, tensors array<struct<name:string,dtype:string,shape:array<bigint>,begin:bigint,end:bigint>>"


def tensors_of(content: bytes) -> dict:
    """The header of a safetensors file: eight bytes of its length, little-endian, then JSON."""
    size = struct.unpack("<Q", content[:8])[0]
    header = json.loads(content[8 : 8 + size])
    rows = [
        {"name": name, "dtype": t["dtype"], "shape": t["shape"], "begin": t["data_offsets"][0], "end": t["data_offsets"][1]}
        for name, t in sorted(header.items()) if name != "__metadata__"
    ]
    return {"tensors": rows}


def tensor_headers(files: DataFrame) -> DataFrame:
    return parsed(files, TENSORS, tensors_of)


ARCHIVE = "path string, entries array<struct<name:string,size:bigint,packed:bigint,crc:bigint>>"


def archive_of(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return {"entries": [{"name": i.filename, "size": i.file_size, "packed": i.compress_size, "crc": i.CRC} for i in archive.infolist()]}


def archive_entries(files: DataFrame) -> DataFrame:
    """``path`` and the entries of each ZIP archive."""
    return parsed(files, ARCHIVE, archive_of)


def vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Tokens and ids of a JSON object; a vocabulary is a small file, read whole.  Entries that are no whole numbers are left out."""
    rows = spark.read.option("wholetext", "true").text(path).collect()
    raw = json.loads(rows[0][0]) if rows else {}
    return {token: i for token, i in raw.items() if isinstance(i, int) and not isinstance(i, bool)}
