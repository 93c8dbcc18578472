"""Files by path or URI, as Python tasks open them: local paths, and every file system that Arrow knows by its URI."""

from __future__ import annotations

import fnmatch
import os
import posixpath
from typing import BinaryIO

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        if scheme == "file":  # Spark writes file:/x as well as file:///x
            path = "file://" + "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def opened(path: str) -> BinaryIO:
    """A file to read, with seek and tell."""
    system, at = _at(path)
    return open(at, "rb") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at)


def length(path: str) -> int:
    system, at = _at(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def listed(path: str) -> list[str]:
    """The files that a path names, ascending: itself, those of a folder (without hidden ones), or of a pattern in the
    last part. Names keep the path's scheme."""
    system, at = _at(path)
    info = system.get_file_info(at)
    prefix = path[: len(path) - len(at)] if "://" in path and path.endswith(at) else ("file://" if path.startswith("file:") else "")
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.Directory:
        inside = system.get_file_info(fs.FileSelector(at))
        found = [f.path for f in inside if f.is_file and not f.base_name.startswith(("_", "."))]
    elif any(c in at for c in "*?["):
        inside = system.get_file_info(fs.FileSelector(posixpath.dirname(at), allow_not_found=True))
        found = [f.path for f in inside if f.is_file and fnmatch.fnmatchcase(f.base_name, posixpath.basename(at))]
    else:
        raise FileNotFoundError(path)
    return sorted(prefix + f for f in found)


def create(path: str) -> BinaryIO:
    """A new file to write, its folder made first."""
    system, at = _at(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    return system.open_output_stream(at, compression=None)


def placed(path: str) -> BinaryIO | None:
    """A file to write at any place, several tasks at once, made if it isn't there; None on file systems that write
    files only from their start (all but local and mounted ones)."""
    system, at = _at(path)
    if not isinstance(system, fs.LocalFileSystem):
        return None
    os.makedirs(os.path.dirname(at), exist_ok=True)
    return os.fdopen(os.open(at, os.O_RDWR | os.O_CREAT, 0o666), "r+b")


def move(source: str, target: str) -> None:
    system, at = _at(source)
    system.move(at, _at(target)[1])


def remove(path: str) -> None:
    """A file or a folder, if it is there."""
    system, at = _at(path)
    kind = system.get_file_info(at).type
    if kind == fs.FileType.Directory:
        system.delete_dir(at)
    elif kind == fs.FileType.File:
        system.delete_file(at)


def exists(path: str) -> bool:
    system, at = _at(path)
    return system.get_file_info(at).type != fs.FileType.NotFound
