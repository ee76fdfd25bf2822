"""Imaging files as rows: a reader of the public Part 10 format (little endian, explicit or implicit types), its elements, pixels and digests.

A file is parsed where it lies in the partition; what cannot be read is a row with an error, never a failed job. Compressed pixels are kept as
bytes and not decoded.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imaging_engine.functions.blake3 import blake3
from imaging_engine.shared import table

#: Fixed values of the standard: types with a length of 32 bits, types of text, types of numbers.
LONG_VRS = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
TEXT = {"AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "UV": "Q", "SV": "q"}
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
_ITEM, _ITEM_END, _SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
_OPEN = 0xFFFFFFFF


@dataclass
class Element:
    key: str
    vr: str
    value: bytes | None  # null for a sequence

    @property
    def text(self) -> str:
        if self.value is None:
            return "<SQ sequence>"
        if self.vr in TEXT or (self.vr == "UN" and self.value.rstrip(b"\0 ").isascii() and self.value.rstrip(b"\0 ").decode("ascii").isprintable()):
            try:
                return self.value.decode("utf-8").strip("\0 ")
            except UnicodeDecodeError:
                return self.value.decode("latin-1").strip("\0 ")
        if self.vr in NUMBERS and len(self.value) % struct.calcsize(NUMBERS[self.vr]) == 0:
            return "\\".join(f"{v:g}" if isinstance(v, float) else str(v) for (v,) in struct.iter_unpack("<" + NUMBERS[self.vr], self.value))
        if self.vr == "AT" and len(self.value) % 4 == 0:
            return "\\".join(f"{a:04X},{b:04X}" for a, b in struct.iter_unpack("<HH", self.value))
        shown = " ".join(f"{b:02X}" for b in self.value[:16])
        return f"<{self.vr} binary: {len(self.value)} bytes [{shown}{' ...' if len(self.value) > 16 else ''}]>"


@dataclass
class Parsed:
    elements: list[Element] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def first(self, key: str) -> Element | None:
        return next((e for e in self.elements if e.key == key), None)

    @property
    def summary(self) -> str:
        n = sum(e.value is not None for e in self.elements)
        if not self.errors:
            return f"{n} elements"
        return f"{n} elements, {len(self.errors)} errors" if n else f"nothing read: {self.errors[0]}"


class _Reader:
    def __init__(self, data: bytes, at: int, explicit: bool, out: Parsed):
        self.data, self.at, self.explicit, self.out = data, at, explicit, out

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError(f"ends at {len(self.data)}, {self.at + n} needed")
        self.at += n
        return self.data[self.at - n : self.at]

    def tag(self) -> tuple[int, int]:
        return struct.unpack("<HH", self.take(4))

    def read(self, prefix: str, end: int, explicit: bool | None = None) -> None:
        """The elements up to the end, or to the mark that ends an open item."""
        explicit = self.explicit if explicit is None else explicit
        while self.at < end:
            grp, elem = self.tag()
            if (grp, elem) == _ITEM_END:
                self.take(4)
                return
            meta = explicit or grp == 2
            key = f"{prefix}{grp:04X},{elem:04X}"
            if meta:
                vr = self.take(2).decode("latin-1")
                if not vr.isalpha():
                    raise ValueError(f"{key} has no type")
                if vr in LONG_VRS:
                    self.take(2)
                    (n,) = struct.unpack("<I", self.take(4))
                else:
                    (n,) = struct.unpack("<H", self.take(2))
            else:
                (n,) = struct.unpack("<I", self.take(4))
                vr = "SQ" if n == _OPEN and (grp, elem) != (0x7FE0, 0x0010) else "OW" if (grp, elem) == (0x7FE0, 0x0010) else "UN"
            if vr == "SQ" or (vr == "UN" and n == _OPEN):
                self.out.elements.append(Element(key, "SQ", None))
                self.items(key, len(self.data) if n == _OPEN else self.at + n, n == _OPEN, explicit and vr == "SQ")
            elif n == _OPEN:
                self.out.elements.append(Element(key, vr, self.fragments()))
            else:
                self.out.elements.append(Element(key, vr, self.take(n)))
            if grp == 2 and elem == 0x10:
                syntax = self.out.elements[-1].text
                self.explicit = explicit = syntax != IMPLICIT

    def items(self, key: str, end: int, open_: bool, explicit: bool) -> None:
        k = 0
        while self.at < end:
            tag = self.tag()
            (n,) = struct.unpack("<I", self.take(4))
            if tag == _SEQUENCE_END:
                return
            if tag != _ITEM:
                raise ValueError(f"{key} holds {tag[0]:04X},{tag[1]:04X} where an item should be")
            self.read(f"{key}[{k}]/", len(self.data) if n == _OPEN else self.at + n, explicit)
            k += 1

    def fragments(self) -> bytes:
        """The bytes of encapsulated pixels, without their table of offsets."""
        parts = []
        while True:
            tag = self.tag()
            (n,) = struct.unpack("<I", self.take(4))
            if tag == _SEQUENCE_END:
                return b"".join(parts[1:])
            parts.append(self.take(n))


def is_dicom(data: bytes) -> bool:
    return data[128:132] == b"DICM"


def parse(data: bytes) -> Parsed:
    """All elements in the order of the file, nested ones after their sequence; what follows an error is left out and told."""
    out = Parsed()
    if not is_dicom(data):
        out.errors.append("no DICM at 128")
        return out
    try:
        _Reader(data, 132, True, out).read("", len(data))
    except (ValueError, struct.error, RecursionError) as e:
        out.errors.append(str(e))
    return out


def write(elements: list[tuple[str, str, object]], implicit: bool = False) -> bytes:
    """A file of (key, vr, value): texts, bytes, numbers, or a list of items for a sequence. For tests and round trips."""

    def one(key: str, vr: str, value: object, implicit: bool) -> bytes:
        grp, elem = (int(x, 16) for x in key.split(","))
        if vr == "SQ":
            body = b"".join(struct.pack("<HHI", *_ITEM, len(b := b"".join(one(*e, implicit) for e in item))) + b for item in value)
        elif isinstance(value, bytes):
            body = value
        elif vr in NUMBERS:
            body = struct.pack(f"<{NUMBERS[vr]}", value)
        else:
            body = str(value).encode()
        body += (b"\0" if vr in ("UI", "OB", "UN") else b" ") * (len(body) % 2)
        if implicit and grp != 2:
            return struct.pack("<HHI", grp, elem, len(body)) + body
        return struct.pack("<HH", grp, elem) + vr.encode() + (struct.pack("<HI", 0, len(body)) if vr in LONG_VRS else struct.pack("<H", len(body))) + body

    meta = one("0002,0010", "UI", IMPLICIT if implicit else EXPLICIT, False)
    return bytes(128) + b"DICM" + meta + b"".join(one(*e, implicit) for e in elements)


def pixels(p: Parsed) -> tuple[str | None, np.ndarray | None]:
    """What is wrong, or the pixels as floats (height, width, channels): 8 or 16 bits gray, 8 bits in three colours; rescaled where gray of 16."""

    def number(key: str, default: float | None = None) -> float | None:
        e = p.first(key)
        try:
            return float(e.text.split("\\")[0]) if e else default
        except ValueError:
            return default

    raw, rows, cols = p.first("7FE0,0010"), number("0028,0010"), number("0028,0011")
    bits, samples = number("0028,0100"), number("0028,0002", 1)
    if raw is None or raw.value is None or not rows or not cols:
        return "no pixels", None
    kind = {(8, 1): "u1", (16, 1): "<i2" if number("0028,0103", 0) else "<u2", (8, 3): "u1"}.get((bits, samples))
    if kind is None:
        return f"unsupported: {bits:g} bits, {samples:g} samples" if bits else "unsupported: no bits", None
    n = int(rows * cols * samples)
    if len(raw.value) < n * np.dtype(kind).itemsize:
        return "the pixel data is too short", None
    a = np.frombuffer(raw.value, kind, n).astype(float).reshape(int(rows), int(cols), int(samples))
    if bits == 16:
        a = a * number("0028,1053", 1.0) + number("0028,1052", 0.0)
    return None, a


def digests(data: bytes) -> dict[str, str | None]:
    """Digests of a file: whole, raw pixel bytes, decoded, words of 16 and 32 bits turned, low and high bytes. Null without pixels (policy: only pixels tell duplicates)."""
    p = parse(data)
    raw = p.first("7FE0,0010")
    b = raw.value if raw is not None and raw.value else None
    h = lambda x: blake3(x).hex() if x is not None else None
    error, a = pixels(p)
    turned = lambda k: b"".join(b[i : i + k][::-1] for i in range(0, len(b), k)) if b is not None else None
    return {
        "file": h(data), "raw": h(b), "decoded": h(a.tobytes()) if a is not None else None, "swapped16": h(turned(2)), "swapped32": h(turned(4)),
        "low": h(b[::2] if b is not None else None), "high": h(b[1::2] if b is not None else None), "md5": hashlib.md5(b",".join(b"%g" % v for v in a.ravel())).hexdigest() if a is not None else None,
    }


ELEMENTS = "file string, ord int, key string, vr string, value string, error string"


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ELEMENTS.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p = parse(content or b"")
            rows = [(path, k, e.key, e.vr, e.text, None) for k, e in enumerate(p.elements)] + [(path, len(p.elements), None, None, None, x) for x in p.errors]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if n == "ord" else pa.string()) for k, n in enumerate(names)], names)


def elements(files: DataFrame) -> DataFrame:
    """The elements of files (path, content) as rows, and the errors."""
    return files.select(F.col("path").alias("file"), "content").mapInArrow(_explode, ELEMENTS)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return elements(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = ("file", "raw", "decoded", "swapped16", "swapped32", "low", "high", "md5")
    for batch in batches:
        found = [digests(c or b"") for c in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([d[k] for d in found], pa.string()) for k in kinds]], ["path", *(f"d_{k}" for k in kinds)])


def digest_report(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInArrow(_digested, "path string, " + ", ".join(f"d_{k} string" for k in ("file", "raw", "decoded", "swapped16", "swapped32", "low", "high", "md5")))


#: Labels and tags of the essential fields; a missing one is an empty text.
ESSENTIAL = {
    "patient_name": "0010,0010", "patient_id": "0010,0020", "study_date": "0008,0020", "modality": "0008,0060", "study_description": "0008,1030", "series_description": "0008,103E",
    "series_number": "0020,0011", "rows": "0028,0010", "columns": "0028,0011",
}


def essential(rows: DataFrame) -> DataFrame:
    """One row for each file with the essential fields."""
    first = lambda k: F.coalesce(F.min_by("value", F.when(F.col("key") == k, F.col("ord"))), F.lit(""))
    return rows.groupBy("file").agg(*[first(k).alias(n) for n, k in ESSENTIAL.items()])


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a small file for each row of series_info, with a nested sequence, every second one with implicit types."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = [(k, vr, row[n] or "") for k, vr, n in (("0008,0060", "CS", "modality"), ("0008,103E", "LO", "series_description"), ("0010,0010", "PN", "patient_name"))]
                nested = [[("0040,A123", "PN", row["patient_id"] or "")], [("0040,A124", "UI", row["series_uid"] or "")]]
                i = row["row_id"]
                px = [("0028,0010", "US", 2), ("0028,0011", "US", 2), ("0028,0100", "US", 16), ("0040,A730", "SQ", nested), ("7FE0,0010", "OW", struct.pack("<4H", i % 5, i % 7, 3, 4))]
                out.append(write([*own, *px], implicit=False))
            yield pa.RecordBatch.from_arrays([pa.array([f"S{r:08}.dcm" for r in batch.column(0).to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    return table(spark, sf_dir, "series_info").select("row_id", "modality", "series_description", "patient_name", "patient_id", "series_uid").mapInArrow(build, "path string, content binary")


def src11_deep_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(made_files(spark, sf_dir)).where("key <> '0002,0010'").select("file", "key", "vr", "value")


def src09_essential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return essential(elements(made_files(spark, sf_dir)))


def agg24_digest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_report(made_files(spark, sf_dir))


_T = "trim(coalesce({0}, ''))"
SQL = {
    "src11_deep_reader": "WITH s AS (SELECT *, printf('S%08d.dcm', row_id) AS file FROM series_info) "
    + " UNION ALL ".join(
        [f"SELECT file, '{k}' AS key, '{vr}' AS vr, {_T.format(c)} AS value FROM s" for k, vr, c in (("0008,0060", "CS", "modality"), ("0008,103E", "LO", "series_description"), ("0010,0010", "PN", "patient_name"), ("0040,A730[0]/0040,A123", "PN", "patient_id"), ("0040,A730[1]/0040,A124", "UI", "series_uid"))]
        + [f"SELECT file, '{k}', '{vr}', '{v}' FROM s" for k, vr, v in (("0028,0010", "US", "2"), ("0028,0011", "US", "2"), ("0028,0100", "US", "16"), ("0040,A730", "SQ", "<SQ sequence>"))]
        + ["SELECT file, '7FE0,0010', 'OW', printf('<OW binary: 8 bytes [%02X 00 %02X 00 03 00 04 00]>', row_id % 5, row_id % 7) FROM s"]
    ),
    "src09_essential": f"SELECT printf('S%08d.dcm', row_id) AS file, {_T.format('patient_name')} AS patient_name, '' AS patient_id, '' AS study_date, {_T.format('modality')} AS modality, '' AS study_description, {_T.format('series_description')} AS series_description, '' AS series_number, '2' AS rows, '2' AS columns FROM series_info",
}
QUERIES = {"src11_deep_reader": src11_deep_reader, "src09_essential": src09_essential, "agg24_digest_report": agg24_digest_report}
