"""Files of any file system that Arrow knows, for readers and writers that run in Python tasks."""

from __future__ import annotations

import glob

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it; ``file:/x`` and plain paths are local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str, suffixes: tuple[str, ...], recursive: bool = False) -> list[str]:
    """Files of a folder with one of the suffixes, by name; a single file, or a local pattern with ``*``, stands for itself."""
    system, inside = file_system(path)
    if "*" in inside and isinstance(system, fs.LocalFileSystem):
        found = [fs.FileInfo(p, fs.FileType.File) for p in glob.glob(inside, recursive=recursive)]
    else:
        info = system.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=recursive))
    scheme = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffixes))
