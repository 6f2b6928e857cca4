"""YAML settings and manifests without a YAML library: the part of YAML 1.1 that such files use.

Block and flow mappings and sequences, plain, quoted, literal and folded scalars, comments, anchors,
aliases and merge keys are read; tags, complex keys and several documents are refused.  Scalars get
the types of YAML 1.1, so ``1e-3`` is text and ``yes`` is true.  Every error names its line.
"""

from __future__ import annotations

import datetime
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The spellings of YAML 1.1 scalars, and the escapes of double quotes.
NULLS = {"", "~", "null", "Null", "NULL"}
BOOLS = {w: v for v, words in ((True, "yes true on"), (False, "no false off")) for word in words.split() for w in (word, word.capitalize(), word.upper())}
SPECIAL_FLOATS = {s + d + n: float(s + n) for s in ("", "+", "-") for d in (".",) for n in ("inf", "Inf", "INF")} | {d: float("nan") for d in (".nan", ".NaN", ".NAN")}
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "\\": "\\", "/": "/", "N": "\x85", "_": "\xa0", "L": " ", "P": " "}
CODES = {"x": 2, "u": 4, "U": 8}

_INT = re.compile(r"[-+]?(0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]*|[1-9][0-9_]*(:[0-5]?[0-9])*)$")
_FLOAT = re.compile(r"([-+]?[0-9][0-9_]*\.[0-9_]*([eE][-+][0-9]+)?|\.[0-9][0-9_]*([eE][-+][0-9]+)?|[-+]?[0-9][0-9_]*(:[0-5]?[0-9])+\.[0-9_]*)$")
_DATE = re.compile(r"(\d{4})-(\d\d)-(\d\d)$")
_TIME = re.compile(r"(\d{4})-(\d\d?)-(\d\d?)(?:[Tt]|[ \t]+)(\d\d?):(\d\d):(\d\d)(?:\.(\d*))?(?:[ \t]*(Z|[-+]\d\d?(?::?\d\d)?))?$")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`?:-][^\n]*?|[?:-](?=[^\s])[^\n]*?)[ \t]*:(?=[ \t]|$)""")
_COMMENT = re.compile(r"(^|[ \t])#.*$")
_NAME = re.compile(r"[^\s,\[\]{}]+")
_BLOCK = re.compile(r"([|>])([-+]?)([1-9]?)([-+]?)[ \t]*(#.*)?$")


class YamlError(ValueError):
    """What can't be read, with its line."""


def scalar(text: str) -> Any:
    """The value of a plain scalar."""
    if text in NULLS:
        return None
    if text in BOOLS:
        return BOOLS[text]
    if text in SPECIAL_FLOATS:
        return SPECIAL_FLOATS[text]
    if _INT.match(text):
        sign, digits = (-1 if text[0] == "-" else 1), text.lstrip("+-").replace("_", "")
        if ":" in digits:
            return sign * _sixties(digits, int)
        base = 2 if digits[:2] == "0b" else 16 if digits[:2] == "0x" else 8 if digits[0] == "0" and len(digits) > 1 else 10
        return sign * int(digits[2:] if base in (2, 16) else digits, base)
    if _FLOAT.match(text):
        sign, digits = (-1 if text[0] == "-" else 1), text.lstrip("+-").replace("_", "")
        return sign * (_sixties(digits, float) if ":" in digits else float(digits))
    if m := _DATE.match(text):
        return datetime.date(*map(int, m.groups()))
    if m := _TIME.match(text):
        y, mo, d, h, mi, s = map(int, m.groups()[:6])
        at = datetime.datetime(y, mo, d, h, mi, s, int((m[7] or "").ljust(6, "0")[:6] or 0))
        if m[8] and m[8] != "Z":
            hours, minutes = re.match(r"[-+](\d\d?):?(\d\d)?", m[8]).groups()
            zone = datetime.timezone((-1 if m[8][0] == "-" else 1) * datetime.timedelta(hours=int(hours), minutes=int(minutes or 0)))
            return at.replace(tzinfo=zone)
        return at.replace(tzinfo=datetime.timezone.utc) if m[8] else at
    return text


def _sixties(digits: str, kind: type) -> Any:
    total = 0
    for part in digits.split(":"):
        total = total * 60 + kind(part)
    return total


class _Reader:
    def __init__(self, text: str, unique: bool):
        self.lines = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.at, self.unique = 0, unique
        self.anchors: dict[str, Any] = {}

    def fail(self, message: str, line: int | None = None) -> YamlError:
        return YamlError(f"line {(self.at if line is None else line) + 1}: {message}")

    # -- lines ---------------------------------------------------------------------------------------

    def here(self) -> tuple[int, str] | None:
        """Indent and text of the next line that holds something; None at the end of the document."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            text = line.lstrip(" ")
            if not text.strip() or text.lstrip("\t").startswith("#"):
                self.at += 1
                continue
            if line.rstrip() == "..." or (line[:3] == "---" and line[3:4] in ("", " ")):
                return None
            if text[0] == "\t":
                raise self.fail("a tab in the indentation")
            return len(line) - len(text), text
        return None

    def document(self) -> Any:
        self.here()
        if self.at < len(self.lines) and self.lines[self.at][:3] == "---":
            self.lines[self.at] = "   " + self.lines[self.at][3:]
        if self.here() is None:
            value = None
        else:
            value = self.block(-1)
        if self.here() is not None:
            raise self.fail("this does not belong to what stands before it")
        if self.at < len(self.lines):
            if self.lines[self.at].rstrip() != "...":
                raise self.fail("several documents")
            self.at += 1
            if self.here() is not None or self.at < len(self.lines):
                raise self.fail("several documents")
        return value

    # -- blocks --------------------------------------------------------------------------------------

    def block(self, parent: int) -> Any:
        """The node that starts on the next line, deeper than ``parent``."""
        indent, text = self.here()
        if text == "-" or text.startswith(("- ", "-\t")):
            return self.sequence(indent)
        if text.startswith("? ") or text == "?\n":
            raise self.fail("complex keys are not read")
        if self.key(text):
            return self.mapping(indent)
        return self.value(text, indent, parent)

    def key(self, text: str) -> re.Match | None:
        m = _KEY.match(text)
        return None if m is None or (m[1][0] not in "\"'" and _COMMENT.search(m[1])) else m

    def sequence(self, indent: int) -> list:
        out = []
        while (found := self.here()) is not None and found[0] == indent and (found[1] == "-" or found[1].startswith(("- ", "-\t"))):
            rest = found[1][1:].lstrip(" \t")
            column = indent + len(found[1]) - len(rest)
            out.append(self.entry(rest, column, indent))
        return out

    def entry(self, rest: str, column: int, indent: int) -> Any:
        """What follows a dash: a node whose first line is the rest of this one."""
        if not rest or rest.startswith("#"):
            self.at += 1
            return self.nested(indent, False)
        if rest == "-" or rest.startswith(("- ", "-\t")) or (rest[0] not in "&*!|>[{" and self.key(rest)):
            self.lines[self.at] = " " * column + rest
            return self.block(indent)
        return self.value(rest, column, indent)

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        merged: list[dict] = []
        lines: dict = {}
        while (found := self.here()) is not None and found[0] == indent:
            m = self.key(found[1])
            if m is None:
                raise self.fail("no key of a mapping")
            line = self.at
            name = self.quoted(m[1], 0)[0] if m[1][0] in "\"'" else scalar(m[1].rstrip())
            rest = found[1][m.end() :].lstrip(" \t")
            column = indent + len(found[1]) - len(rest)
            if not rest or rest.startswith("#"):
                self.at += 1
                value = self.nested(indent, True)
            else:
                value = self.value(rest, column, indent, True)
            if name == "<<" and m[1] == "<<":
                merged += self.merges(value, line)
                continue
            self.put(out, lines, name, value, line)
        return self.merged(out, merged)

    def put(self, out: dict, lines: dict, name: Any, value: Any, line: int) -> None:
        if self.unique and name in out:
            raise self.fail(f"key {name!r} stands twice, first in line {lines[name] + 1}", line)
        out[name], lines[name] = value, line

    def merges(self, value: Any, line: int) -> list[dict]:
        found = value if isinstance(value, list) else [value]
        if not all(isinstance(v, dict) for v in found):
            raise self.fail("only mappings can be merged", line)
        return found

    @staticmethod
    def merged(own: dict, others: list[dict]) -> dict:
        out: dict = {}
        for other in reversed(others):
            out |= other
        return out | own

    def nested(self, indent: int, in_mapping: bool) -> Any:
        """The block below a key or dash, or null; the entries of a key's sequence may stand as far left as the key."""
        found = self.here()
        if found is None or found[0] < indent or (found[0] == indent and not (in_mapping and (found[1] == "-" or found[1].startswith("- ")))):
            return None
        return self.block(indent)

    # -- scalars and flow collections --------------------------------------------------------------------

    def value(self, rest: str, column: int, indent: int, in_mapping: bool = False) -> Any:
        """The node that starts at ``column`` of the current line and belongs to a parent at ``indent``; the line is used up."""
        first = rest[0]
        if first == "&":
            name = _NAME.match(rest, 1)
            if name is None:
                raise self.fail("an anchor without a name")
            after = rest[name.end() :].lstrip(" \t")
            if after and not after.startswith("#"):
                value = self.value(after, column + len(rest) - len(after), indent, in_mapping)
            else:
                self.at += 1
                value = self.nested(indent, in_mapping)
            self.anchors[name[0]] = value
            return value
        if first == "*":
            name = _NAME.match(rest, 1)
            self.only_comment(rest[name.end() if name else 1 :])
            if name is None or name[0] not in self.anchors:
                raise self.fail(f"unknown alias {rest.strip()}")
            self.at += 1
            return self.anchors[name[0]]
        if first == "!":
            raise self.fail("tags are not read")
        if first in "@`%" or rest.split()[0] in ("?", "-"):
            raise self.fail(f"a value can't start with {first}")
        if first in "|>":
            return self.literal(rest, indent)
        if first in "\"'":
            self.lines[self.at] = " " * column + rest
            value, end = self.quoted(rest, column)
            self.only_comment(self.lines[self.at][end:])
            self.at += 1
            return value
        if first in "[{":
            self.lines[self.at] = " " * column + rest
            value, end = self.flow(column)
            self.only_comment(self.lines[self.at][end:])
            self.at += 1
            return value
        parts = [_COMMENT.sub("", rest).strip()]
        commented = parts[0] != rest.strip()
        if re.search(r":([ \t]|$)", parts[0]):
            raise self.fail("a key within a value")
        self.at += 1
        while not commented:  # a plain scalar goes on in deeper lines
            start = self.at
            found = self.here()
            if found is None or found[0] <= indent:
                break
            text = _COMMENT.sub("", found[1]).strip()
            if re.search(r":([ \t]|$)", text):
                raise self.fail("a key within a value")
            commented = text != found[1].strip()
            blank = self.at - start
            parts.append("\n" * blank if blank else " ")
            parts.append(text)
            self.at += 1
        return scalar(parts[0]) if len(parts) == 1 else "".join(parts)

    def only_comment(self, rest: str) -> None:
        if rest.strip() and not re.match(r"[ \t]+#", rest):
            raise self.fail(f"{rest.strip()!r} after a value")

    def literal(self, rest: str, indent: int) -> str:
        m = _BLOCK.match(rest)
        if m is None:
            raise self.fail("a literal with something after its mark")
        folded, chomp = m[1] == ">", m[2] or m[4]
        self.at += 1
        body: list[str] = []
        depth = max(indent, 0) + int(m[3]) if m[3] else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            spaces = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if depth is None:
                    depth = spaces if spaces > indent else None
                if depth is None or spaces < depth:
                    break
            body.append(line[depth:] if depth is not None else "")
            self.at += 1
        kept = len(body)
        while kept and not body[kept - 1].strip(" "):
            kept -= 1
        end = "" if chomp == "-" or not kept else "\n"
        if chomp == "+":
            after = len(body) - kept - (self.at == len(self.lines) and len(body) > kept)
            end = "\n" * (after + bool(kept))
        body = body[:kept]
        return (_fold(body) if folded else "\n".join(body)) + end

    def quoted(self, text: str, column: int) -> tuple[str, int]:
        """A quoted scalar that starts at ``column``, and where it ends in its last line; lines that it spans are folded."""
        mark, out, line = text[0], [], self.at
        at, text = 1, text
        base = column
        while True:
            if at >= len(text):
                folds = 0
                while out and out[-1] in " \t":
                    out.pop()
                self.at += 1
                while self.at < len(self.lines) and not self.lines[self.at].strip():
                    folds += 1
                    self.at += 1
                if self.at >= len(self.lines):
                    raise self.fail("a quote is not closed", line)
                out.append("\n" * folds if folds else " ")
                text = self.lines[self.at]
                at = len(text) - len(text.lstrip(" \t"))
                base = 0
                continue
            c = text[at]
            if c == mark:
                if mark == "'" and text[at + 1 : at + 2] == "'":
                    out.append("'")
                    at += 2
                    continue
                return "".join(out), base + at + 1
            if c == "\\" and mark == '"':
                code = text[at + 1 : at + 2]
                if code == "":  # the line break is escaped: nothing is put in its place
                    self.at += 1
                    if self.at >= len(self.lines):
                        raise self.fail("a quote is not closed", line)
                    text = self.lines[self.at]
                    at, base = len(text) - len(text.lstrip(" \t")), 0
                    continue
                if code in CODES:
                    digits = text[at + 2 : at + 2 + CODES[code]]
                    if not re.fullmatch(rf"[0-9a-fA-F]{{{CODES[code]}}}", digits):
                        raise self.fail(f"bad escape \\{code}{digits}")
                    out.append(chr(int(digits, 16)))
                    at += 2 + CODES[code]
                elif code in ESCAPES:
                    out.append(ESCAPES[code])
                    at += 2
                else:
                    raise self.fail(f"unknown escape \\{code}")
                continue
            out.append(c)
            at += 1

    # Flow collections: places are columns of the current line.

    def skip(self, at: int) -> int:
        """The next column of this line or a later one that holds something."""
        start = self.at
        while True:
            line = self.lines[self.at]
            while at < len(line) and line[at] in " \t":
                at += 1
            if at < len(line) and not (line[at] == "#" and (at == 0 or line[at - 1] in " \t")):
                return at
            self.at += 1
            at = 0
            if self.at >= len(self.lines):
                raise self.fail("a bracket is not closed", start)

    def flow(self, at: int) -> tuple[Any, int]:
        line = self.lines[self.at]
        first = line[at]
        if first == "[":
            return self.flow_sequence(at + 1)
        if first == "{":
            return self.flow_mapping(at + 1)
        if first in "\"'":
            return self.quoted(line[at:], at)
        if first == "*":
            name = _NAME.match(line, at + 1)
            if name is None or name[0] not in self.anchors:
                raise self.fail("unknown alias")
            return self.anchors[name[0]], name.end()
        if first in "!&|>@`%":
            raise self.fail(f"{first} is not read here")
        m = re.compile(r"(?:[^,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#)+").match(line, at)
        if m is None:
            raise self.fail(f"{first!r} where a value should stand")
        return scalar(m[0].strip()), m.end()

    def flow_sequence(self, at: int) -> tuple[list, int]:
        out = []
        while True:
            at = self.skip(at)
            if self.lines[self.at][at] == "]":
                return out, at + 1
            value, at = self.flow(at)
            at = self.skip(at)
            if self.lines[self.at][at] == ":":
                name = value
                value, at = self.flow(self.skip(at + 1))
                value, at = {name: value}, self.skip(at)
            out.append(value)
            at = self.separated(at, "]")

    def flow_mapping(self, at: int) -> tuple[dict, int]:
        out: dict = {}
        merged: list[dict] = []
        lines: dict = {}
        while True:
            at = self.skip(at)
            if self.lines[self.at][at] == "}":
                return self.merged(out, merged), at + 1
            line, plain = self.at, self.lines[self.at][at] not in "\"'"
            name, at = self.flow(at)
            if isinstance(name, (dict, list)):
                raise self.fail("complex keys are not read")
            at, value = self.skip(at), None
            if self.lines[self.at][at] == ":":
                at = self.skip(at + 1)
                if self.lines[self.at][at] not in ",}":
                    value, at = self.flow(at)
                    at = self.skip(at)
            if name == "<<" and plain:
                merged += self.merges(value, line)
            else:
                self.put(out, lines, name, value, line)
            at = self.separated(at, "}")

    def separated(self, at: int, close: str) -> int:
        c = self.lines[self.at][at]
        if c == ",":
            return at + 1
        if c != close:
            raise self.fail(f"{c!r} where , or {close} should stand")
        return at


def _fold(lines: list[str]) -> str:
    """Lines of a folded literal: single breaks between lines at the left edge become spaces."""
    out, breaks = "", 0
    before = None
    for line in lines:
        if not line:
            breaks += 1
            continue
        if before is None:
            out = "\n" * breaks + line
        elif line[0] in " \t" or before[0] in " \t":
            out += "\n" * (breaks + 1) + line
        else:
            out += ("\n" * breaks if breaks else " ") + line
        before, breaks = line, 0
    return out


def load(text: str, unique: bool = False) -> Any:
    """The one document of a YAML text.  unique: a key that stands twice in a mapping is an error, else its last value counts."""
    reader = _Reader(text, unique)
    try:
        return reader.document()
    except (IndexError, RecursionError) as e:
        raise reader.fail(f"can't be read ({type(e).__name__})") from e


def as_json(value: Any) -> str:
    """JSON of a document; dates as text in ISO form."""
    return json.dumps(value, default=lambda x: x.isoformat())


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def _converted(texts: pd.Series) -> pd.DataFrame:
    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            return (None if text is None else as_json(load(text))), None
        except (ValueError, TypeError) as e:
            return None, str(e)

    return pd.DataFrame([one(t) for t in texts], columns=["json", "error"], dtype=object)


def to_json(text: str | Column) -> Column:
    """json and error of a column of YAML texts, for ``from_json``; null texts give nulls."""
    return _converted(F.col(text) if isinstance(text, str) else text)
