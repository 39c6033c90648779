"""Files by path or URI, opened where the work runs.

A plain path or ``file:`` URI is the machine's own file system (or a folder
mounted on all of them); any other URI is opened by ``pyarrow.fs``.
"""

from __future__ import annotations

import os
import posixpath
import time

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def join(folder: str, name: str) -> str:
    return posixpath.join(folder.rstrip("/"), name)


def open_input(path: str):
    """A file to read from, with seek."""
    system, inner = resolve(path)
    return system.open_input_file(inner)


def open_output(path: str, make_folder: bool = True):
    """A file to write to; its folder is made, or must be there."""
    system, inner = resolve(path)
    if make_folder:
        system.create_dir(posixpath.dirname(inner) or ".", recursive=True)
    return system.open_output_stream(inner)


def make(folder: str) -> str:
    system, inner = resolve(folder)
    system.create_dir(inner, recursive=True)
    return folder


def move(source: str, target: str) -> None:
    system, inner = resolve(source)
    system.move(inner, resolve(target)[1])


def copy(source: str, target: str) -> None:
    with open_input(source) as a, open_output(target) as b:
        while part := a.read(8 << 20):
            b.write(part)


def size(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    system, inner = resolve(path)
    info = system.get_file_info(inner)
    return info.size if info.type == fs.FileType.File else None


def names(folder: str, ending: str = "") -> list[str]:
    """Names of the files of a folder, in order; none if there is no such folder."""
    system, inner = resolve(folder)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(ending))


def is_local(path: str) -> bool:
    """Whether the path is of a file system that can be written in place."""
    return isinstance(resolve(path)[0], fs.LocalFileSystem)


def lay_out(path: str, begin: bytes, size: int) -> None:
    """A local file of ``size`` bytes, of which the first are given."""
    with open_output(path) as f:
        f.write(begin)
    os.truncate(resolve(path)[1], size)


def copy_at(source: str, target: str, at: int) -> None:
    """Put a file's bytes in a local file that is there, from the place ``at`` on."""
    with open_input(source) as a, open(resolve(target)[1], "r+b") as b:
        b.seek(at)
        while part := a.read(8 << 20):
            b.write(part)


def listing(path: str) -> list[tuple[str, int]]:
    """Path and bytes of the file, or of the files of the folder but for hidden ones, in order; none if there is neither."""
    system, inner = resolve(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted((join(path, f.base_name), f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def delete(path: str) -> None:
    system, inner = resolve(path)
    system.delete_file(inner)


def clear(folder: str) -> None:
    """Delete what is in a folder."""
    system, inner = resolve(folder)
    system.delete_dir_contents(inner, missing_dir_ok=True)


def is_empty(folder: str) -> bool:
    system, inner = resolve(folder)
    return not system.get_file_info(fs.FileSelector(inner, allow_not_found=True))


def remove(folder: str, missing_ok: bool = False) -> None:
    system, inner = resolve(folder)
    for again in range(5):
        if missing_ok and system.get_file_info(inner).type != fs.FileType.Directory:
            return
        try:
            return system.delete_dir(inner)
        except OSError:  # a task that is not yet stopped has just opened a file there
            if again == 4:
                raise
            time.sleep(0.2)
