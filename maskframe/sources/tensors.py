"""Tensor files (.pt, .pth) as arrays, read by a restricted stack machine that never unpickles.

The opcodes of a pickle are walked one by one.  Only those that build scalars, text, bytes, lists,
tuples and dicts do anything; a global is a name without an object behind it, and a call is worked
out only if it is one of a few rebuilding functions of tensors.  Everything else is refused by name,
so no code of a file is ever run.  Members of the archive may be compressed.
"""

from __future__ import annotations

import io
import math
import pickletools
import zipfile
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Storages by name, and the numpy types of their elements.
STORAGES = {"DoubleStorage": "f8", "FloatStorage": "f4", "HalfStorage": "f2", "LongStorage": "i8", "IntStorage": "i4", "ShortStorage": "i2", "CharStorage": "i1", "ByteStorage": "u1", "BoolStorage": "?"}
#: Functions that may be called, all of them worked out here.
REBUILD, PARAMETER, ORDERED, SIZE, ENCODE = "torch._utils _rebuild_tensor_v2", "torch._utils _rebuild_parameter", "collections OrderedDict", "torch Size", "_codecs encode"
CALLS = (REBUILD, PARAMETER, ORDERED, SIZE, ENCODE)

#: Bytes that one member of an archive may unpack to, and opcodes of one pickle.
MEMBER_BYTES = 1 << 31
OPCODES = 5_000_000
DEPTH = 200
_MARK = object()
_ROWS = "path string, field string, source_dtype string, shape array<int>, data array<double>, error string"


class Unsafe(ValueError):
    """A payload that asks for more than plain data and tensors."""


class Name(NamedTuple):
    """A global that a pickle names; nothing is imported."""

    name: str


class Storage(NamedTuple):
    """A storage that a pickle refers to, by its place in the archive."""

    kind: str
    key: str
    count: int


class Tensor(NamedTuple):
    """Where a tensor's elements lie in a storage."""

    storage: Storage
    offset: int
    shape: tuple[int, ...]
    strides: tuple[int, ...]


#: Opcodes that push their argument, and those that push a constant or a new container.
_PUSH = {"BININT", "BININT1", "BININT2", "INT", "LONG", "LONG1", "LONG4", "BINFLOAT", "FLOAT", "BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8", "UNICODE", "BINBYTES", "SHORT_BINBYTES", "BINBYTES8", "BINSTRING", "SHORT_BINSTRING", "STRING"}
_MAKE = {"NONE": lambda: None, "NEWTRUE": lambda: True, "NEWFALSE": lambda: False, "EMPTY_DICT": dict, "EMPTY_LIST": list, "EMPTY_TUPLE": tuple, "MARK": lambda: _MARK}
_PASS = {"PROTO", "FRAME"}


class Machine:
    """The stack, the memo and the few operations on them."""

    def __init__(self, ids: bool = True):
        self.stack: list[Any] = []
        self.memo: dict[int, Any] = {}
        self.ids = ids

    def run(self, pickle: bytes) -> Any:
        try:
            for number, (op, arg, _) in enumerate(pickletools.genops(pickle)):
                if number >= OPCODES:
                    raise Unsafe("too many opcodes")
                if op.name == "STOP":
                    if len(self.stack) != 1 or self.stack[0] is _MARK:
                        raise Unsafe("a mark or several values are left on the stack")
                    return self.stack.pop()
                self.step(op.name, arg)
        except (IndexError, KeyError, TypeError, UnicodeDecodeError) as e:
            raise Unsafe(f"not a well-formed pickle: {type(e).__name__}") from e
        raise Unsafe("a pickle without an end")

    def step(self, op: str, arg: Any) -> None:
        s = self.stack
        if op in _PUSH:
            s.append(arg)
        elif op in _MAKE:
            s.append(_MAKE[op]())
        elif op in ("BINPUT", "LONG_BINPUT", "PUT"):
            self.memo[int(arg)] = s[-1]
        elif op == "MEMOIZE":
            self.memo[len(self.memo)] = s[-1]
        elif op in ("BINGET", "LONG_BINGET", "GET"):
            s.append(self.memo[int(arg)])
        elif op in ("TUPLE", "LIST", "DICT"):
            items = self.marked()
            s.append(tuple(items) if op == "TUPLE" else items if op == "LIST" else self.filled({}, items))
        elif op in ("TUPLE1", "TUPLE2", "TUPLE3"):
            n = int(op[-1])
            items = self.popped(n)
            s.append(tuple(items))
        elif op in ("APPEND", "APPENDS"):
            items = self.marked() if op == "APPENDS" else self.popped(1)
            if type(s[-1]) is not list:
                raise Unsafe(f"{op} on {type(s[-1]).__name__}")
            s[-1].extend(items)
        elif op in ("SETITEM", "SETITEMS"):
            items = self.marked() if op == "SETITEMS" else self.popped(2)
            self.filled(s[-1], items)
        elif op == "GLOBAL":
            s.append(Name(str(arg)))
        elif op == "STACK_GLOBAL":
            module, name = self.popped(2)
            s.append(Name(f"{module} {name}"))
        elif op == "BINPERSID" and self.ids:
            s.append(self.storage(*self.popped(1)))
        elif op == "REDUCE":
            function, arguments = self.popped(2)
            s.append(self.call(function, arguments))
        elif op == "BUILD":
            state = self.popped(1)[0]
            if type(s[-1]) is not dict or state not in ({}, None) and not (type(state) is dict and set(state) <= {"_metadata"}):
                raise Unsafe("BUILD of an object's state")
        elif op not in _PASS:
            raise Unsafe(f"opcode {op}")

    def popped(self, n: int) -> list[Any]:
        if len(self.stack) < n or any(x is _MARK for x in self.stack[-n:]):
            raise Unsafe("the stack is too short")
        items = self.stack[-n:]
        del self.stack[-n:]
        return items

    def marked(self) -> list[Any]:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] is _MARK:
                items = self.stack[k + 1 :]
                del self.stack[k:]
                return items
        raise Unsafe("no mark on the stack")

    @staticmethod
    def filled(target: Any, items: list[Any]) -> dict:
        if type(target) is not dict or len(items) % 2:
            raise Unsafe(f"items set on {type(target).__name__}")
        for key, value in zip(items[::2], items[1::2]):
            if not (key is None or type(key) in (str, bytes, int, float, bool)):
                raise Unsafe(f"a key of type {type(key).__name__}")
            target[key] = value
        return target

    @staticmethod
    def storage(given: Any) -> Storage:
        if type(given) is not tuple or len(given) != 5 or given[0] != "storage":
            raise Unsafe("a persistent id that is no storage")
        _, kind, key, _, count = given
        name = kind.name.split(" ") if isinstance(kind, Name) else []
        if name[:1] != ["torch"] or name[1] not in STORAGES or type(key) is not str or type(count) is not int or count < 0:
            raise Unsafe("a storage of an unknown type")
        return Storage(name[1], key, count)

    @staticmethod
    def call(function: Any, arguments: Any) -> Any:
        if not isinstance(function, Name) or function.name not in CALLS or type(arguments) is not tuple:
            raise Unsafe(f"a call of {function.name.replace(' ', '.') if isinstance(function, Name) else type(function).__name__}")
        if function.name == ORDERED:
            if arguments not in ((), ([],)):
                raise Unsafe("a call of collections.OrderedDict with items")
            return {}
        if function.name == ENCODE:  # bytes, in protocols that have no opcode for them
            if len(arguments) != 2 or type(arguments[0]) is not str or arguments[1] != "latin1":
                raise Unsafe("a call of _codecs.encode to another code than latin1")
            return arguments[0].encode("latin1")
        if function.name == SIZE:
            return tuple(arguments[0])
        if function.name == PARAMETER:
            if not isinstance(arguments[0], Tensor):
                raise Unsafe("a parameter that is no tensor")
            return arguments[0]
        storage, offset, shape, strides = arguments[:4]
        whole = lambda x: type(x) is tuple and all(type(n) is int and n >= 0 for n in x)
        if not (isinstance(storage, Storage) and type(offset) is int and offset >= 0 and whole(shape) and whole(strides) and len(shape) == len(strides)):
            raise Unsafe("a tensor of no storage")
        if math.prod(shape) and offset + sum((n - 1) * k for n, k in zip(shape, strides)) >= storage.count:
            raise Unsafe("a tensor beyond its storage")
        return Tensor(storage, offset, shape, strides)


def _members(content: bytes) -> tuple[zipfile.ZipFile, str]:
    """The archive and the folder that its members lie in."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unsafe("not a zip archive (files of before 2020 are not read)") from e
    if any(n.rsplit("/", 1)[-1] == "constants.pkl" for n in archive.namelist()):
        raise Unsafe("an archive of code")
    found = [n for n in archive.namelist() if n.rsplit("/", 1)[-1] == "data.pkl"]
    if len(found) != 1:
        raise Unsafe("no data.pkl, or several")
    return archive, found[0][: -len("data.pkl")]


def _member(archive: zipfile.ZipFile, name: str, most: int) -> bytes:
    try:
        with archive.open(name) as f:
            content = f.read(most + 1)
    except (KeyError, zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
        raise Unsafe(f"member {name} can't be read: {type(e).__name__}") from e
    if len(content) > most:
        raise Unsafe(f"member {name} unpacks to more than {most} bytes")
    return content


def decode_tensors(content: bytes) -> Any:
    """What a tensor file holds, tensors as arrays; ``Unsafe`` if it asks for anything but plain data."""
    archive, folder = _members(content)
    with archive:
        order = _member(archive, folder + "byteorder", 16).decode("ascii", "replace") if folder + "byteorder" in archive.namelist() else "little"
        value = Machine().run(_member(archive, folder + "data.pkl", MEMBER_BYTES))
        stored: dict[Storage, np.ndarray] = {}

        def array(t: Tensor) -> np.ndarray:
            if t.storage not in stored:
                kind = np.dtype(STORAGES[t.storage.kind]).newbyteorder(">" if order == "big" else "<")
                size = t.storage.count * kind.itemsize
                raw = _member(archive, f"{folder}data/{t.storage.key}", min(size, MEMBER_BYTES))
                if len(raw) != size:
                    raise Unsafe(f"storage {t.storage.key} has {len(raw)} bytes of {size}")
                stored[t.storage] = np.frombuffer(raw, kind)
            whole = stored[t.storage][t.offset :]
            return np.lib.stride_tricks.as_strided(whole, t.shape, [k * whole.itemsize for k in t.strides], writeable=False) if math.prod(t.shape) else np.zeros(t.shape, whole.dtype)

        return _plain(value, array, 0)


def _plain(value: Any, array: Any, depth: int) -> Any:
    if depth > DEPTH:
        raise Unsafe("nested too deep")
    if isinstance(value, Tensor):
        return array(value)
    if isinstance(value, (Name, Storage)):
        raise Unsafe(f"{type(value).__name__.lower()} {value[0].replace(' ', '.')} as a value")
    if type(value) is dict:
        return {k: _plain(v, array, depth + 1) for k, v in value.items()}
    if type(value) in (list, tuple):
        return type(value)(_plain(v, array, depth + 1) for v in value)
    return value


def pickle_issue(pickle: bytes) -> str | None:
    """Why a bare pickle is not plain data; null if it is.  Nothing of it is run."""
    try:
        _plain(Machine(ids=False).run(pickle), None, 0)
    except ValueError as e:
        return str(e)
    return None


def named_arrays(value: Any, name: str = "") -> Iterator[tuple[str, np.ndarray]]:
    """Arrays of nested containers, named by their keys and places with dots between."""
    if isinstance(value, np.ndarray):
        yield name, value
    elif isinstance(value, (dict, list, tuple)):
        for key, item in value.items() if isinstance(value, dict) else enumerate(value):
            yield from named_arrays(item, f"{name}.{key}" if name else str(key))


def decoded_tensors(files: DataFrame) -> DataFrame:
    """One row a tensor of files (path, content): path, field, source_dtype, shape, data (row-major), error.

    field names the tensor by its keys; a file that is one tensor has an empty one.  A file that is
    damaged or asks for more than plain data is a row with an error and no data, and so is a file
    without tensors.
    """
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found = [(path, n, str(a.dtype.newbyteorder("=")), list(a.shape), a.astype(float).ravel(), None) for n, a in named_arrays(decode_tensors(content))]
                    found = found or [(path, None, None, None, None, "no tensors")]
                except (ValueError, EOFError, OSError, RecursionError) as e:
                    found = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame({n: pd.Series(list(column), dtype=object) for n, column in zip(names, zip(*found))})

    return files.select("path", "content").mapInPandas(run, _ROWS)


def read_tensors(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``decoded_tensors`` of the .pt and .pth files under a path."""
    return decoded_tensors(spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{pt,pth}").load(path))
