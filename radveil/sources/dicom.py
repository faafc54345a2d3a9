"""DICOM files: header tables of a folder, and de-identified copies of its files.

The public file format is read and written here, as no library is at hand: explicit and implicit little endian, big endian and
deflated transfer syntaxes, nested sequences, encapsulated pixels (kept as they are).
"""

from __future__ import annotations

import hashlib
import hmac
import os
import struct
import zlib
from collections.abc import Callable
from datetime import datetime, timedelta
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..functions.keys import SEPARATOR, LinkKey

# Fixed values of the file format.
IMPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
LONG_LENGTH = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d"}
TEXTS = set("AE AS CS DA DS DT IS LO LT PN SH ST TM UC UI UR UT UN".split())
ITEM, ITEM_END, SEQUENCE_END, PIXELS, SYNTAX, GROUP_LENGTH, MEDIA_UID = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0x7FE00010, 0x00020010, 0x00020000, 0x00020003
OPEN = 0xFFFFFFFF

KEYWORDS = {n: k for k, n in X.TAG_NUMBERS.items()}
NAME_NUMBERS = {X.TAG_NUMBERS[k] for k in X.PERSON_NAME_TAGS if k in X.TAG_NUMBERS}


class Element(NamedTuple):
    tag: int
    vr: str
    value: bytes | list  # a list of items, each a list of elements, for sequences
    raw: bool = False  # encapsulated pixels: fragments with their item tags


class _Reader:
    def __init__(self, data: bytes, explicit: bool, order: str):
        self.data, self.explicit, self.order = data, explicit, order

    def tag(self, at: int) -> int:
        group, element = struct.unpack_from(self.order + "HH", self.data, at)
        return group << 16 | element

    def elements(self, at: int, end: int, only: Callable[[int], bool] | None = None) -> tuple[list[Element], int]:
        """Elements up to ``end``, an end of item, or the first tag ``only`` refuses; and where reading stopped."""
        out = []
        while at + 8 <= end:
            tag = self.tag(at)
            if tag == ITEM_END:
                return out, at + 8
            if only and not only(tag):
                return out, at
            element, at = self.element(tag, at + 4)
            out.append(element)
        return out, end

    def element(self, tag: int, at: int) -> tuple[Element, int]:
        vr = b"UN"
        if self.explicit:
            vr = self.data[at : at + 2]
            if not vr.isalpha():
                raise ValueError("no value representation")
            wide = vr in LONG_LENGTH
            (size,) = struct.unpack_from(self.order + ("I" if wide else "H"), self.data, at + (4 if wide else 2))
            at += 8 if wide else 4
        else:
            (size,) = struct.unpack_from(self.order + "I", self.data, at)
            at += 4
            vr = b"PN" if tag in NAME_NUMBERS else vr
        kind = vr.decode()
        if size == OPEN:
            if tag == PIXELS:
                start = at
                while self.tag(at) != SEQUENCE_END:
                    at += 8 + struct.unpack_from(self.order + "I", self.data, at + 4)[0]
                return Element(tag, kind, self.data[start : at + 8], True), at + 8
            # inside an unknown element of open length all is implicit little endian
            inner = self if kind != "UN" or not self.explicit else _Reader(self.data, False, "<")
            items, at = inner.items(at, len(self.data))
            return Element(tag, "SQ", items), at
        if at + size > len(self.data):
            raise ValueError("cut off")
        value = self.data[at : at + size]
        if tag != PIXELS and (kind == "SQ" or kind == "UN" and value[:4] == struct.pack(self.order + "HH", 0xFFFE, 0xE000)):
            return Element(tag, "SQ", self.items(at, at + size)[0]), at + size
        return Element(tag, kind, value), at + size

    def items(self, at: int, end: int) -> tuple[list[list[Element]], int]:
        out = []
        while at + 8 <= end:
            tag, (size,) = self.tag(at), struct.unpack_from(self.order + "I", self.data, at + 4)
            at += 8
            if tag == SEQUENCE_END:
                break
            inside, at = self.elements(at, end if size == OPEN else at + size)
            out.append(inside)
        return out, at


def read(data: bytes, pixels: bool = True) -> tuple[str, list[Element], list[Element]]:
    """(transfer syntax, elements of the file's head, elements of the data set); ValueError for what is no DICOM file."""
    if data[128:132] != b"DICM":
        raise ValueError("no DICOM file")
    try:
        head, at = _Reader(data, True, "<").elements(132, len(data), lambda t: t >> 16 == 2)
        syntax = next((e.value.decode().strip("\0 ") for e in head if e.tag == SYNTAX), None)
        if not syntax:
            raise ValueError("no transfer syntax")
        body = zlib.decompress(data[at:], -15) if syntax == DEFLATED else data[at:]
        reader = _Reader(body, syntax != IMPLICIT, ">" if syntax == BIG else "<")
        return syntax, head, reader.elements(0, len(body), None if pixels else lambda t: t < PIXELS)[0]
    except (struct.error, zlib.error, UnicodeDecodeError, IndexError) as e:
        raise ValueError(str(e)) from e


def _written(elements: list[Element], explicit: bool, order: str) -> bytes:
    out = []
    mark = lambda tag, size: struct.pack(order + "HHI", tag >> 16, tag & 0xFFFF, size)
    for e in elements:
        if isinstance(e.value, list):
            value, size = b"".join(mark(ITEM, OPEN) + _written(item, explicit, order) + mark(ITEM_END, 0) for item in e.value) + mark(SEQUENCE_END, 0), OPEN
        else:
            value = e.value + (b"" if len(e.value) % 2 == 0 else b"\0" if e.vr in ("UI", "OB", "UN") else b" ")
            size = OPEN if e.raw else len(value)
        tag, vr = struct.pack(order + "HH", e.tag >> 16, e.tag & 0xFFFF), e.vr.encode()
        if not explicit:
            out += [tag, struct.pack(order + "I", size), value]
        elif vr in LONG_LENGTH:
            out += [tag, vr, b"\0\0", struct.pack(order + "I", size), value]
        else:
            out += [tag, vr, struct.pack(order + "H", size), value]
    return b"".join(out)


def write(syntax: str, head: list[Element], body: list[Element]) -> bytes:
    rest = _written([e for e in head if e.tag != GROUP_LENGTH], True, "<")
    first = _written([Element(GROUP_LENGTH, "UL", struct.pack("<I", len(rest)))], True, "<")
    data = _written(body, syntax != IMPLICIT, ">" if syntax == BIG else "<")
    if syntax == DEFLATED:
        z = zlib.compressobj(wbits=-15)
        data = z.compress(data) + z.flush()
    return bytes(128) + b"DICM" + first + rest + data


def _text(e: Element, order: str = "<") -> str | None:
    if e.vr in NUMBERS:
        code = NUMBERS[e.vr]
        return "\\".join(map(str, struct.unpack(order + code * (len(e.value) // struct.calcsize(code)), e.value)))
    if e.vr not in TEXTS:
        return None
    try:
        return e.value.decode().strip("\0 ")
    except UnicodeDecodeError:
        return e.value.decode("latin-1").strip("\0 ")


def tags(data: bytes) -> dict[str, str] | None:
    """Header entries by keyword, or by number where it is not known; those in sequences by their path. None for unreadable files."""
    try:
        syntax, _, body = read(data, pixels=False)
    except ValueError:
        return None
    out: dict[str, str] = {}

    def walk(elements: list[Element], path: str) -> None:
        for e in elements:
            name = path + KEYWORDS.get(e.tag, f"({e.tag >> 16:04x},{e.tag & 0xFFFF:04x})")
            if isinstance(e.value, list):
                for k, item in enumerate(e.value):
                    walk(item, f"{name}[{k}].")
            elif (text := _text(e, ">" if syntax == BIG else "<")) is not None:
                out.setdefault(name, text)

    walk(body, "")
    return out


def deidentified(data: bytes, research_id: str, shift_days: int, remap: Callable[[str], str]) -> bytes:
    """The file without private elements, person names at any depth and the listed elements; with the research id, moved dates and
    new UIDs. A date of eight characters that is no day stays as it is."""
    syntax, head, body = read(data)

    def kept(elements: list[Element]) -> list[Element]:
        left = (e for e in elements if not (e.tag >> 16) % 2 and e.vr != "PN" and e.tag not in NAME_NUMBERS)
        return [e._replace(value=[kept(item) for item in e.value]) if isinstance(e.value, list) else e for e in left]

    gone = {X.TAG_NUMBERS[k] for k in X.REMOVE_TAGS}
    found = {e.tag: e for e in kept(body) if e.tag not in gone}
    say = lambda keyword: _text(found[X.TAG_NUMBERS[keyword]]) if X.TAG_NUMBERS[keyword] in found else None

    def put(keyword: str, vr: str, value: str) -> None:
        found[X.TAG_NUMBERS[keyword]] = Element(X.TAG_NUMBERS[keyword], found[X.TAG_NUMBERS[keyword]].vr if X.TAG_NUMBERS[keyword] in found else vr, value.encode())

    age = say("PatientAge") or ""
    if len(age) == 4 and age.endswith("Y") and age[:3].isdigit() and int(age[:3]) >= 90:
        put("PatientAge", "AS", "090Y")
    for keyword in X.DATE_TAGS:
        day = say(keyword) or ""
        if len(day) == 8:
            try:
                put(keyword, "DA", (datetime.strptime(day, "%Y%m%d") + timedelta(days=shift_days)).strftime("%Y%m%d"))
            except (ValueError, OverflowError):
                pass
    for keyword in X.UID_TAGS:
        if (old := say(keyword)) is not None:
            put(keyword, "UI", remap(old))
    for keyword, vr, value in (("PatientName", "PN", research_id), ("PatientID", "LO", research_id), ("PatientIdentityRemoved", "CS", "YES"), ("DeidentificationMethod", "LO", X.DEIDENTIFICATION_METHOD[:64])):
        put(keyword, vr, value)
    uid = found.get(X.TAG_NUMBERS["SOPInstanceUID"])
    head = [e._replace(value=uid.value) if e.tag == MEDIA_UID and uid else e for e in head if not (e.tag >> 16) % 2]
    return write(syntax, head, [found[t] for t in sorted(found)])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("file"), "content")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _tags(contents: pd.Series) -> pd.Series:
    return pd.Series([tags(bytes(c)) for c in contents], dtype="object")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(file, tags) of the DICOM files below a folder; files that can't be read are left out."""
    return _files(spark, folder).select("file", _tags("content").alias("tags")).where("tags is not null")


def write_copies(spark: SparkSession, folder: str, rows: DataFrame, out: str, key: LinkKey) -> DataFrame:
    """(file, output): de-identified copies of the files in rows (file, research_patient_id, shift_days), written by the executors to
    out / research id / study / instance; all executors must share ``out``. A copy appears whole, so a task may run twice."""

    @F.pandas_udf(T.StringType())
    def put(contents: pd.Series, files: pd.Series, ids: pd.Series, days: pd.Series) -> pd.Series:
        secret = key.bytes()
        remap = lambda old: "2.25." + str(int(hmac.new(secret, f"dicom-uid{SEPARATOR}{old}".encode(), hashlib.sha256).hexdigest()[:30], 16))

        def one(content: bytes, file: str, research_id: str, shift: int) -> str:
            made = deidentified(bytes(content), research_id, int(shift), remap)
            said = tags(made) or {}
            path = Path(out) / research_id / said.get("StudyInstanceUID", "study") / f"{said.get('SOPInstanceUID', Path(file).stem)}.dcm"
            path.parent.mkdir(parents=True, exist_ok=True)
            part = path.with_suffix(f".{os.getpid()}.part")
            part.write_bytes(made)
            part.replace(path)
            return str(path)

        return pd.Series([one(*row) for row in zip(contents, files, ids, days)])

    got = _files(spark, folder).join(rows.select("file", "research_patient_id", "shift_days"), "file")
    return got.select("file", put("content", "file", "research_patient_id", "shift_days").alias("output"))
