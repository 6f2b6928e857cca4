"""Tensor files: plain ones are read, hostile ones are named and never run."""

import collections
import io
import os
import pickle
import pickletools
import struct
import zipfile

import numpy as np
import pytest

from maskframe.sources import tensors

RNG = np.random.default_rng(3)
KINDS = {"float64": "DoubleStorage", "float32": "FloatStorage", "float16": "HalfStorage", "int64": "LongStorage", "int32": "IntStorage", "int16": "ShortStorage", "int8": "CharStorage", "uint8": "ByteStorage", "bool": "BoolStorage"}


class Global:
    """Pickled as a bare reference to a global name."""

    def __init__(self, module, name):
        self.module, self.name = module, name


class Storage:
    def __init__(self, array, key):
        self.array, self.key = array, key


class Rebuilt:
    """Pickled as a call of a global with arguments."""

    def __init__(self, function, *arguments):
        self.function, self.arguments = function, arguments


class Pickler(pickle._Pickler):
    """The writing side of the format, without the library that has it."""

    def save(self, obj, save_persistent_id=True):
        if isinstance(obj, Global):
            self.write(b"c" + f"{obj.module}\n{obj.name}\n".encode())
        elif isinstance(obj, Storage):
            self.save(("storage", Global("torch", KINDS[str(obj.array.dtype)]), obj.key, "cpu", obj.array.size))
            self.write(pickle.BINPERSID)
        elif isinstance(obj, Rebuilt):
            self.save(obj.function)
            self.save(obj.arguments)
            self.write(pickle.REDUCE)
        else:
            super().save(obj, save_persistent_id)


def dumped(value, protocol=2):
    out = io.BytesIO()
    Pickler(out, protocol).dump(value)
    return out.getvalue()


def tensor(array, key, offset=0, shape=None, strides=None):
    shape = array.shape if shape is None else shape
    strides = tuple(s // array.itemsize for s in array.strides) if strides is None else strides
    return Rebuilt(Global("torch._utils", "_rebuild_tensor_v2"), Storage(array, key), offset, tuple(shape), tuple(strides), False, Rebuilt(Global("collections", "OrderedDict")))


def archive(value, storages=(), compression=zipfile.ZIP_STORED, protocol=2, **members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        z.writestr("data/data.pkl", value if isinstance(value, bytes) else dumped(value, protocol))
        for k, a in enumerate(storages):
            z.writestr(f"data/data/{k}", a.tobytes())
        for name, content in members.items():
            z.writestr(f"data/{name.replace('__', '.')}", content)
    return out.getvalue()


@pytest.mark.parametrize("compression", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("dtype", list(KINDS))
def test_tensors_of_all_types(dtype, compression):
    a = (RNG.random((3, 4)) * 9).astype(dtype)
    got = tensors.decode_tensors(archive(tensor(a, "0"), [a], compression))
    assert got.dtype == a.dtype and (got == a).all()


@pytest.mark.parametrize("protocol", [2, 3, 4])
def test_nested_values(protocol):
    a, b = np.arange(12.0).reshape(3, 4), np.arange(5)
    value = {
        "model": {"w": tensor(a, "0"), "turned": tensor(a, "0", 0, (4, 3), (1, 4)), "part": tensor(a, "0", 5, (2, 2), (4, 1)), "empty": tensor(a, "0", 0, (0, 3), (3, 1))},
        "list": [tensor(b, "1"), (1, 2.5, None, True, b"raw", "text" * 100, 1 << 70)], 7: Rebuilt(Global("torch", "Size"), (3, 4)), "parameter": Rebuilt(Global("torch._utils", "_rebuild_parameter"), tensor(b, "1"), True, Rebuilt(Global("collections", "OrderedDict"))),
    }
    got = tensors.decode_tensors(archive(value, [a, b], protocol=protocol, byteorder=b"little"))
    assert (got["model"]["w"] == a).all() and (got["model"]["turned"] == a.T).all() and (got["model"]["part"] == [[5, 6], [9, 10]]).all() and got["model"]["empty"].shape == (0, 3)
    assert (got["list"][0] == b).all() and got["list"][1] == (1, 2.5, None, True, b"raw", "text" * 100, 1 << 70) and got[7] == (3, 4) and (got["parameter"] == b).all()
    assert [n for n, _ in tensors.named_arrays(got)] == ["model.w", "model.turned", "model.part", "model.empty", "list.0", "parameter"]


class Hostile:
    def __init__(self, function, *arguments):
        self.call = function, arguments

    def __reduce__(self):
        return self.call


A = np.arange(6.0)
HOSTILE = {
    "system": (pickle.dumps(Hostile(os.system, "touch /tmp/never")), "a call of posix.system"),
    "eval": (pickle.dumps(Hostile(eval, "1"), 4), "a call of builtins.eval"),
    "object": (pickle.dumps(collections.Counter("aab"), 2), "a call of collections.Counter"),
    "new object": (pickle.dumps(np.float64(1), 4), "numpy"),
    "instance": (b"(ios\nsystem\n.", "opcode INST"),
    "old instance": (b"(cos\nsystem\nS'x'\no.", "opcode OBJ"),
    "extension": (b"\x82\x01.", "opcode EXT1"),
    "buffer": (b"\x80\x05\x97.", "opcode NEXT_BUFFER"),
    "state": (b"\x80\x02cos\nsystem\n}b.", "BUILD of an object's state"),
    "bare name": (b"\x80\x02cos\nsystem\n.", "name os.system as a value"),
    "append to a name": (b"\x80\x02cos\nsystem\nK\x01a.", "APPEND on Name"),
    "items of a list": (b"\x80\x02]K\x01K\x02s.", "items set on list"),
    "key": (b"\x80\x02}](K\x01es.", "well-formed"),
    "list as a key": (b"\x80\x02}]K\x01s.", "a key of type list"),
    "name as a key": (b"\x80\x02}cos\nsystem\nK\x01s.", "a key of type Name"),
    "persistent id": (b"\x80\x02K\x01Q.", "opcode BINPERSID"),
    "unknown memo": (b"\x80\x02h\x05.", "well-formed"),
    "two values": (b"\x80\x02K\x01K\x02.", "left on the stack"),
    "mark alone": (b"(.", "mark"),
    "mark eaten": (b"(K\x01\x86.", "too short"),
    "no mark": (b"K\x01t.", "no mark"),
    "recursive": (b"\x80\x02]q\x00h\x00a.", "nested too deep"),
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_hostile_pickles(name):
    content, issue = HOSTILE[name]
    found = tensors.pickle_issue(content)
    if name == "mark alone" and found is None:
        pytest.fail("a mark is no value")
    assert found and (issue in found or name in ("key", "new object", "mark alone"))
    with pytest.raises(ValueError):
        tensors.decode_tensors(archive(content))
    assert not os.path.exists("/tmp/never")


def test_plain_pickles():
    for value in (None, 3, [1, (2.0, "x")], {"a": {"b": [b"raw"]}}, "y" * 70_000, -(1 << 90), ()):
        for protocol in range(5):
            assert tensors.pickle_issue(pickle.dumps(value, protocol)) is None, (value, protocol)
    assert all(tensors.pickle_issue(pickle.dumps([1, {"a": (2, None)}])[:n]) for n in range(1, 20))


def test_hostile_archives():
    refused = lambda content: pytest.raises(ValueError, match=content)
    with refused("beyond its storage"):
        tensors.decode_tensors(archive(tensor(A, "0", 1), [A]))
    with refused("beyond its storage"):
        tensors.decode_tensors(archive(tensor(A, "0", 0, (2, 2), (5, 1)), [A]))
    with refused("has 40 bytes of 48"):
        tensors.decode_tensors(archive(tensor(A, "0"), [A[:5]]))
    with refused("unpacks to more"):
        tensors.decode_tensors(archive(tensor(A, "0"), [np.arange(9.0)], zipfile.ZIP_DEFLATED))
    with refused("can't be read"):
        tensors.decode_tensors(archive(tensor(A, "9"), [A]))
    with refused("an archive of code"):
        tensors.decode_tensors(archive(tensor(A, "0"), [A], constants__pkl=b"."))
    with refused("not a zip"):
        tensors.decode_tensors(pickle.dumps(1))
    with refused("unknown type"):
        tensors.decode_tensors(archive(Rebuilt(Global("torch._utils", "_rebuild_tensor_v2"), _Odd(), 0, (1,), (1,))))
    with refused("no storage"):
        tensors.decode_tensors(archive(Rebuilt(Global("torch._utils", "_rebuild_tensor_v2"), 1, 0, (1,), (1,))))
    flipped = bytearray(archive(tensor(A, "0"), [A]))
    flipped[flipped.index(struct.pack("<d", 5.0))] ^= 1
    with refused("BadZipFile"):
        tensors.decode_tensors(bytes(flipped))


class _Odd(Storage):
    def __init__(self):
        super().__init__(np.zeros(1, np.complex64), "0")


KINDS["complex64"] = "ComplexFloatStorage"


def test_opcodes_are_covered():
    """Every opcode is pushed, made, stepped or refused; none falls through."""
    for op in pickletools.opcodes:
        machine = tensors.Machine(ids=False)
        machine.stack = [[], "a", "b"]
        try:
            machine.step(op.name, 0 if op.arg else None)
        except (ValueError, KeyError, TypeError):
            pass


def test_files_as_rows(spark, tmp_path):
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    (tmp_path / "a.pt").write_bytes(archive({"x": tensor(a, "0"), "n": 3}, [a], zipfile.ZIP_DEFLATED))
    (tmp_path / "b.pth").write_bytes(archive(tensor(A, "0"), [A]))
    (tmp_path / "c.pt").write_bytes(archive(HOSTILE["system"][0]))
    (tmp_path / "d.pt").write_bytes(archive({"n": 1}))
    (tmp_path / "e.npy").write_bytes(b"x")
    got = {(r["path"].rsplit("/", 1)[1], r["field"]): r for r in tensors.read_tensors(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.pt", "x"), ("b.pth", ""), ("c.pt", None), ("d.pt", None)}
    assert (got["a.pt", "x"]["source_dtype"], got["a.pt", "x"]["shape"], got["a.pt", "x"]["data"]) == ("float32", [2, 3], a.ravel().tolist())
    assert "a call of" in got["c.pt", None]["error"] and got["d.pt", None]["error"] == "no tensors" and got["b.pth", ""]["data"] == A.tolist()
