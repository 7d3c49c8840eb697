"""Opening files from inside tasks, on any file system Arrow knows (local, HDFS, S3, GCS)."""

from __future__ import annotations

import io
import posixpath
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or plain path."""
    path = re.sub(r"^file:/+", "/", path)
    path = re.sub(r"^s3[an]://", "s3://", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


#: Bytes fetched at a time; neighbouring small reads and short skips share one request.
READ_AHEAD = 1 << 19


def open_input(path: str, ahead: int = READ_AHEAD) -> io.BufferedReader:
    """Random-access file object that reads ahead."""
    system, place = locate(path)
    return io.BufferedReader(system.open_input_file(place), ahead)


@contextmanager
def atomic_output(path: str) -> Iterator:
    """Write to a file that appears under its name only once it is complete.

    A retried or duplicated task writes its own temporary file and then replaces the
    same final file, so a lost executor leaves nothing half-written behind. On an error the temporary file goes.
    """
    system, place = locate(path)
    folder, name = posixpath.split(place)
    system.create_dir(folder, recursive=True)
    temporary = posixpath.join(folder, f"_{uuid.uuid4().hex}.{name}.tmp")
    try:
        with system.open_output_stream(temporary) as out:
            yield out
    except BaseException:
        system.delete_file(temporary)
        raise
    system.move(temporary, place)


def write_text(path: str, text: str) -> None:
    with atomic_output(path) as out:
        out.write(text.encode())


def files_under(path: str, suffixes: tuple[str, ...]) -> list[fs.FileInfo]:
    """The file itself, or the files of a folder that end in one of ``suffixes``, by name."""
    system, place = locate(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(place))
    return sorted((f for f in found if f.is_file and f.path.endswith(suffixes)), key=lambda f: f.path)


def entries(path: str) -> list[fs.FileInfo]:
    """What lies directly in a folder; nothing if there is no such folder."""
    system, place = locate(path)
    return system.get_file_info(fs.FileSelector(place, allow_not_found=True))


def refuse_or_clear(path: str, overwrite: bool) -> None:
    """Make sure that an output folder is empty: clear it, or raise if that is not asked for."""
    system, place = locate(path)
    if not entries(path):
        return
    if not overwrite:
        raise FileExistsError(f"{path} is not empty; choose another folder or overwrite it")
    system.delete_dir_contents(place)


def delete_files(folder: str, names: list[str]) -> None:
    system, place = locate(folder)
    for name in names:
        if system.get_file_info(posixpath.join(place, name)).is_file:
            system.delete_file(posixpath.join(place, name))


def drop_dir(path: str) -> None:
    """Delete a folder and all in it, if it is there."""
    system, place = locate(path)
    if system.get_file_info(place).type == fs.FileType.Directory:
        system.delete_dir(place)
