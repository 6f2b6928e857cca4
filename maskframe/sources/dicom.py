"""DICOM files as rows: elements are parsed and pixels decoded where Spark reads the files.

Only what an image needs is kept of a file; nested sequences are stepped over.  Rescaling to [0, 1]
is done by Spark on the decoded values.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.sources.payloads import is_dicom, rescale_dicom

# Fixed values of the standard: transfer syntaxes, tags, and representations with a four-byte length.
IMPLICIT = "1.2.840.10008.1.2"
EXPLICIT = "1.2.840.10008.1.2.1"
DEFLATED = "1.2.840.10008.1.2.1.99"
BIG_ENDIAN = "1.2.840.10008.1.2.2"
RLE = "1.2.840.10008.1.2.5"
SYNTAXES = (IMPLICIT, EXPLICIT, DEFLATED, BIG_ENDIAN, RLE)
GROUP_LENGTH_TAG, SYNTAX_TAG, ITEM, ITEM_END, SEQUENCE_END = 0x00020000, 0x00020010, 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
LONG_FORMS = (b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV")
UNDEFINED = 0xFFFFFFFF
PIXEL_TAGS = {0x7FE00010: None, 0x7FE00008: "f4", 0x7FE00009: "f8"}
SHORTS = {0x00280002: "samples", 0x00280006: "planar", 0x00280010: "height", 0x00280011: "width", 0x00280100: "bits", 0x00280103: "signed"}
TEXTS = {0x00280004: "photometric", 0x00280008: "frames", 0x00281052: "intercept", 0x00281053: "slope"}

#: Bytes that a deflated file may grow to.
INFLATED = 1 << 30
_DECODED = "path string, height int, width int, syntax string, photometric string, source_dtype string, slope double, intercept double, data array<double>, error string"


class _Header(NamedTuple):
    tag: int
    kind: bytes
    length: int
    at: int


class _Reader:
    """Elements of a data set in one transfer syntax."""

    def __init__(self, raw: bytes, explicit: bool, order: str):
        self.raw, self.explicit, self.order = raw, explicit, order

    def header(self, at: int) -> _Header:
        """The element at a place; ``at`` of the result is where its value starts."""
        group, element = struct.unpack_from(self.order + "HH", self.raw, at)
        tag = group << 16 | element
        if not self.explicit or group == 0xFFFE:  # items have no representation in any syntax
            return _Header(tag, b"", struct.unpack_from(self.order + "I", self.raw, at + 4)[0], at + 8)
        kind = self.raw[at + 4 : at + 6]
        if not (kind.isalpha() and kind.isupper()):
            raise ValueError(f"no value representation at byte {at}")
        if kind in LONG_FORMS:
            return _Header(tag, kind, struct.unpack_from(self.order + "I", self.raw, at + 8)[0], at + 12)
        return _Header(tag, kind, struct.unpack_from(self.order + "H", self.raw, at + 6)[0], at + 8)

    def end(self, h: _Header) -> int:
        """Where the next element starts; one of undefined length is stepped through, whatever is nested in it."""
        if h.length != UNDEFINED:
            if h.at + h.length > len(self.raw):
                raise ValueError(f"element {h.tag:08x} is cut off")
            return h.at + h.length
        # an unknown element of undefined length holds items in implicit form
        inner = [_Reader(self.raw, self.explicit and h.kind != b"UN", self.order)]
        open_, at = [SEQUENCE_END], h.at
        while open_:
            found = inner[-1].header(at)
            at = found.at
            if found.tag == open_[-1]:
                open_.pop()
                inner.pop()
            elif found.length == UNDEFINED:
                open_.append(ITEM_END if found.tag == ITEM else SEQUENCE_END)
                inner.append(_Reader(self.raw, inner[-1].explicit and found.kind != b"UN", self.order))
            elif found.tag != ITEM or found.length:
                at = inner[-1].end(found)
        return at

    def elements(self, at: int) -> Iterator[_Header]:
        while at + 8 <= len(self.raw):
            h = self.header(at)
            yield h
            at = self.end(h)

    def fragments(self, h: _Header) -> list[bytes]:
        """Fragments of encapsulated pixels, without the table of offsets before them."""
        at, out = h.at, []
        while (found := self.header(at)).tag == ITEM:
            at = self.end(found)
            out.append(self.raw[found.at : at])
        return out[1:]


def run_lengths(segment: bytes, size: int) -> bytes:
    """The first ``size`` bytes of a run-length coded segment: literal runs, and bytes that are repeated."""
    out, at = bytearray(), 0
    while len(out) < size and at < len(segment):
        n = segment[at]
        if n < 128:
            out += segment[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += segment[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    if len(out) < size:
        raise ValueError("a run-length segment is cut off")
    return bytes(out[:size])


def run_length_frame(frame: bytes, pixels: int, samples: int, size: int) -> np.ndarray:
    """[pixel][sample] values as little-endian bytes; segments are the bytes of the samples, highest first."""
    count, *offsets = struct.unpack_from("<16I", frame)
    if count != samples * size:
        raise ValueError(f"{count} run-length segments for {samples} samples of {size} bytes")
    bounds = [*offsets[:count], len(frame)]
    planes = [np.frombuffer(run_lengths(frame[a:b], pixels), np.uint8) for a, b in zip(bounds, bounds[1:])]
    return np.stack(planes).reshape(samples, size, pixels)[:, ::-1].transpose(2, 0, 1).reshape(-1)


def parse(content: bytes) -> tuple[dict[str, Any], str, str]:
    """What an image needs of a file (pixels as bytes, ``kind`` of floats), its transfer syntax and byte order."""
    at, syntax = 0, IMPLICIT
    if content[128:132] == b"DICM":
        meta, at, close = _Reader(content, True, "<"), 132, len(content)
        while at + 8 <= close and content[at : at + 2] == b"\2\0":
            h = meta.header(at)
            at = meta.end(h)
            if h.tag == GROUP_LENGTH_TAG:
                close = at + struct.unpack_from("<I", content, h.at)[0]
            if h.tag == SYNTAX_TAG:
                syntax = content[h.at : at].rstrip(b"\0 ").decode("ascii")
    if syntax not in SYNTAXES:
        raise ValueError(f"transfer syntax {syntax} is not decoded")
    order = ">" if syntax == BIG_ENDIAN else "<"
    raw = content
    if syntax == DEFLATED:
        inflate = zlib.decompressobj(-15)
        raw, at = inflate.decompress(content[at:], INFLATED), 0
        if inflate.unconsumed_tail:
            raise ValueError("a deflated file of more than 1 GiB")
    reader, found = _Reader(raw, syntax != IMPLICIT, order), {}
    for h in reader.elements(at):
        value = lambda: raw[h.at : h.at + h.length]  # noqa: B023, E731
        if h.tag in SHORTS:
            found[SHORTS[h.tag]] = struct.unpack_from(order + "H", raw, h.at)[0]
        elif h.tag in TEXTS:
            found[TEXTS[h.tag]] = value().split(b"\\")[0].strip(b"\0 ").decode("ascii", "replace")
        elif h.tag in PIXEL_TAGS:
            found["kind"] = PIXEL_TAGS[h.tag]
            found["pixels"] = reader.fragments(h) if h.length == UNDEFINED else value()
            break
    return found, syntax, order


def decode(content: bytes) -> dict[str, Any]:
    """Stored values of a single-frame image, colours as luminance, with what rescaling needs."""
    found, syntax, order = parse(content)
    if "pixels" not in found:
        raise ValueError("no pixel data")
    missing = [n for n in ("height", "width", *(["bits"] if found["kind"] is None else [])) if n not in found]
    if missing:
        raise ValueError(f"no {', '.join(missing)}")
    if int(found.get("frames") or 1) != 1:
        raise ValueError(f"{found['frames']} frames: only single-frame images")
    height, width, samples, bits = found["height"], found["width"], found.get("samples", 1), found.get("bits", 0)
    photometric = found.get("photometric", "").upper()
    if samples not in (1, 3) or photometric.startswith("YBR"):
        raise ValueError(f"{samples} samples of {photometric or 'no photometric interpretation'}")
    n, pixels = height * width * samples, found["pixels"]
    encapsulated = isinstance(pixels, list)
    if encapsulated != (syntax == RLE):
        raise ValueError("pixels are not coded as the transfer syntax says")
    if bits == 1 and found["kind"] is None and not encapsulated:
        values = np.unpackbits(np.frombuffer(pixels, np.uint8), bitorder="little")[:n]
    else:
        if found["kind"] is None and bits not in (8, 16, 32):
            raise ValueError(f"{bits} bits a sample")
        kind = found["kind"] or f"{'i' if found.get('signed') else 'u'}{bits // 8}"
        if encapsulated:
            values = run_length_frame(b"".join(pixels), height * width, samples, bits // 8).view("<" + kind)
        else:
            values = np.frombuffer(pixels, order + kind, min(n, len(pixels) // np.dtype(kind).itemsize))
    if len(values) != n:
        raise ValueError(f"{len(values)} values for {height} x {width} x {samples}")
    stored = str(values.dtype.newbyteorder("="))
    if samples == 3:
        planar = found.get("planar") and not encapsulated
        colours = (values.reshape(3, -1).T if planar else values.reshape(-1, 3)).astype(float)
        values = colours @ [0.299, 0.587, 0.114]
    number = lambda name, default: float(found.get(name) or default)
    return {"height": height, "width": width, "syntax": syntax, "photometric": photometric, "source_dtype": stored, "slope": number("slope", 1), "intercept": number("intercept", 0), "data": values.astype(float)}


def read_dicom(spark: SparkSession, path: str, recursive: bool = False, scaled: bool = True) -> DataFrame:
    """One row a DICOM file: path, height, width, syntax, photometric, source_dtype, data (row-major), error.

    Implicit and explicit little endian, deflated, big endian and run-length coded files of one
    frame are decoded; any other, and a damaged one, is a row with an error and no data (Spark lists
    no files of length 0).  scaled:
    slope, intercept and MONOCHROME1 are applied and each image brought to [0, 1] over its own
    range; else ``data`` has the stored values, with slope and intercept beside them.
    """
    return decoded_images(spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path), scaled)


def decoded_images(files: DataFrame, scaled: bool = True) -> DataFrame:
    """``read_dicom`` of files (path, content) that are rows already; others than DICOM files are left out."""
    names = [c.split()[0] for c in _DECODED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    found = decode(content)
                except (ValueError, struct.error, zlib.error, IndexError, OverflowError) as e:
                    found = {"error": f"{type(e).__name__}: {e}"}
                yield pd.DataFrame({n: pd.Series([found.get(n, p if n == "path" else None)], dtype=object) for n in names})

    out = files.where(is_dicom()).select("path", "content").mapInPandas(run, _DECODED)
    if not scaled:
        return out
    return out.withColumn("data", F.when(F.col("data").isNotNull(), rescale_dicom("data", "slope", "intercept", "photometric"))).drop("slope", "intercept")
