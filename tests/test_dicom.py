"""DICOM files built here, element by element, in every transfer syntax that is decoded."""

import struct
import zlib

import numpy as np
import pytest

from maskframe.sources import dicom

RNG = np.random.default_rng(4)


class Writer:
    def __init__(self, explicit=True, order="<"):
        self.explicit, self.order, self.out = explicit, order, b""

    def tag(self, tag):
        return struct.pack(self.order + "HH", tag >> 16, tag & 0xFFFF)

    def add(self, tag, kind, value, length=None):
        value += b" " * (len(value) % 2) if kind in (b"CS", b"DS", b"IS", b"UI") else b"\0" * (len(value) % 2)
        n = len(value) if length is None else length
        if not self.explicit:
            head = struct.pack(self.order + "I", n)
        elif kind in dicom.LONG_FORMS:
            head = kind + b"\0\0" + struct.pack(self.order + "I", n)
        else:
            head = kind + struct.pack(self.order + "H", n)
        self.out += self.tag(tag) + head + value
        return self

    def short(self, tag, value):
        return self.add(tag, b"US", struct.pack(self.order + "H", value))

    def item(self, inner, closed=True):
        """An item, or with closed False one of undefined length."""
        if closed:
            return self.tag(dicom.ITEM) + struct.pack(self.order + "I", len(inner)) + inner
        return self.tag(dicom.ITEM) + struct.pack(self.order + "I", dicom.UNDEFINED) + inner + self.tag(dicom.ITEM_END) + bytes(4)

    def ends(self):
        return self.tag(dicom.SEQUENCE_END) + bytes(4)


def pack_bits(data):
    """Run-length code: repeats of two bytes and more, the rest as literal runs."""
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while at + n < len(data) and n < 128 and data[at + n] == data[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
        else:
            while at + n < len(data) and n < 128 and (at + n + 1 >= len(data) or data[at + n] != data[at + n + 1]):
                n += 1
            out += bytes([n - 1]) + data[at : at + n]
        at += n
    return bytes(out)


def run_length(image):
    """A frame of run-length segments, high bytes first; image is [pixel][sample]."""
    size = image.dtype.itemsize
    planes = image.astype(image.dtype.newbyteorder(">")).reshape(-1, image.shape[1], 1).view(np.uint8).reshape(-1, image.shape[1], size)
    segments = [pack_bits(planes[:, s, b].tobytes()) for s in range(image.shape[1]) for b in range(size)]
    segments = [s + b"\0" * (len(s) % 2) for s in segments]
    offsets = np.cumsum([64, *map(len, segments)])[:-1]
    return struct.pack("<16I", len(segments), *offsets, *[0] * (15 - len(segments))) + b"".join(segments)


def build(image, syntax, photometric="MONOCHROME2", slope=None, intercept=None, planar=False, frames=None, preamble=True, sequences=True):
    colours = image.ndim == 3
    h, w = image.shape[:2]
    order = ">" if syntax == dicom.BIG_ENDIAN else "<"
    d = Writer(syntax != dicom.IMPLICIT, order)
    if sequences:  # nested, of defined and undefined length, holding the very tags that are looked for
        decoy = Writer(d.explicit, order).short(0x00280010, 999).add(0x7FE00010, b"OW", b"decoy!").out
        inner = Writer(d.explicit, order).add(0x00081155, b"SQ", d.item(decoy, False) + d.ends(), dicom.UNDEFINED).out
        d.add(0x00081140, b"SQ", d.item(inner, False) + d.item(decoy) + d.item(b"") + d.ends(), dicom.UNDEFINED)
        d.add(0x00081199, b"SQ", d.item(inner))
        implicit = Writer(False, order)
        d.add(0x00091010, b"UN", implicit.item(implicit.short(0x00280010, 998).out, False) + d.ends(), dicom.UNDEFINED)
    d.short(0x00280002, 3 if colours else 1).add(0x00280004, b"CS", photometric.encode())
    if colours:
        d.short(0x00280006, int(planar))
    if frames:
        d.add(0x00280008, b"IS", str(frames).encode())
    d.short(0x00280010, h).short(0x00280011, w).short(0x00280100, image.dtype.itemsize * 8).short(0x00280101, image.dtype.itemsize * 8).short(0x00280103, int(image.dtype.kind == "i"))
    if slope is not None:
        d.add(0x00281052, b"DS", str(intercept).encode()).add(0x00281053, b"DS", str(slope).encode())
    if syntax == dicom.RLE:
        frame = run_length(image.reshape(h * w, -1))
        half = len(frame) // 4 * 2
        d.add(0x7FE00010, b"OB", d.item(struct.pack("<I", 0)) + d.item(frame[:half]) + d.item(frame[half:]) + d.ends(), dicom.UNDEFINED)
    else:
        stored = np.moveaxis(image, -1, 0) if planar else image
        d.add(0x7FE00010, b"OW", np.ascontiguousarray(stored).astype(image.dtype.newbyteorder(order)).tobytes())
    body = d.out
    if syntax == dicom.DEFLATED:
        z = zlib.compressobj(wbits=-15)
        body = z.compress(body) + z.flush()
    if not preamble:
        return body
    meta = Writer().add(0x00020010, b"UI", syntax.encode().ljust(len(syntax) + len(syntax) % 2, b"\0")).out
    return bytes(128) + b"DICM" + Writer().add(0x00020000, b"UL", struct.pack("<I", len(meta))).out + meta + body


@pytest.mark.parametrize("syntax", dicom.SYNTAXES)
@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "i4"])
def test_stored_values(syntax, dtype):
    low = -120 if dtype[0] == "i" else 0
    image = (RNG.integers(low, 120, (9, 14)) // 17 * 17).astype(dtype)
    got = dicom.decode(build(image, syntax, slope=2.5, intercept=-7))
    assert (got["height"], got["width"], got["source_dtype"], got["slope"], got["intercept"], got["syntax"]) == (9, 14, str(np.dtype(dtype)), 2.5, -7, syntax)
    assert got["data"].tolist() == image.ravel().astype(float).tolist()


@pytest.mark.parametrize(("syntax", "planar"), [(dicom.EXPLICIT, False), (dicom.EXPLICIT, True), (dicom.RLE, False)])
def test_colours_as_luminance(syntax, planar):
    image = RNG.integers(0, 255, (5, 6, 3), dtype=np.uint8)
    assert dicom.decode(build(image, syntax, "RGB", planar=planar))["data"] == pytest.approx(image.reshape(-1, 3) @ [0.299, 0.587, 0.114])


def test_runs():
    for n in range(300):
        data = RNG.choice([0, 1, 255], n).astype(np.uint8).tobytes()
        assert dicom.run_lengths(pack_bits(data), n) == data
    assert dicom.run_lengths(bytes([128, 0, 7, 128]), 1) == b"\x07"
    with pytest.raises(ValueError, match="cut off"):
        dicom.run_lengths(b"\x05ab", 6)


def test_files_as_rows(spark, tmp_path):
    image = RNG.integers(0, 4000, (8, 10)).astype("u2")
    files = {
        "plain.dcm": build(image, dicom.IMPLICIT), "raw.dcm": build(image, dicom.IMPLICIT, preamble=False), "turned.dicom": build(image, dicom.RLE, "MONOCHROME1", -1.5, 3),
        "bare": build(image, dicom.EXPLICIT), "flat.dcm": build(image * 0 + 9, dicom.BIG_ENDIAN), "jpeg.dcm": build(image, "1.2.840.10008.1.2.4.70"),
        "frames.dcm": build(image, dicom.EXPLICIT, frames=3), "cut.dcm": build(image, dicom.EXPLICIT)[:-40], "empty.dcm": b"", "noise.dcm": RNG.bytes(3000), "other": b"no mark here", "n.txt": bytes(128) + b"DICM",
        "loop.dcm": build(image, dicom.EXPLICIT)[:140] + b"\xff" * 400,
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r for r in dicom.read_dicom(spark, str(tmp_path)).collect()}
    assert set(got) == set(files) - {"other", "n.txt", "empty.dcm"}
    want = (image - image.min()) / float(image.max() - image.min())
    for name in ("plain.dcm", "raw.dcm", "bare"):
        assert got[name]["error"] is None and got[name]["data"] == pytest.approx(want.ravel().tolist())
    assert got["turned.dicom"]["data"] == pytest.approx(want.ravel().tolist())  # a falling slope, turned over
    assert set(got["flat.dcm"]["data"]) == {0}
    for name in ("jpeg.dcm", "frames.dcm", "cut.dcm", "noise.dcm", "loop.dcm"):
        assert got[name]["error"] and got[name]["data"] is None
    assert "1.2.840.10008.1.2.4.70" in got["jpeg.dcm"]["error"] and "3 frames" in got["frames.dcm"]["error"]
    stored = {r["path"].rsplit("/", 1)[1]: r for r in dicom.read_dicom(spark, str(tmp_path), scaled=False).collect()}
    assert stored["plain.dcm"]["data"] == image.ravel().tolist() and stored["turned.dicom"]["slope"] == -1.5
