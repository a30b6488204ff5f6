"""Reading files of a folder that nobody vouches for.

A file is opened below the scan's root one path component at a time and never through a link, must be a regular file of
at most MAX_FILE_BYTES, and must not change while it is read. Whatever is refused leaves a note. This runs on the driver,
which alone sees the folder; parsing is distributed. POSIX systems only.
"""

from __future__ import annotations

import errno
import os
import stat

from .health import Health

MAX_FILE_BYTES = 16 * 1024 * 1024


def file_budget() -> int:
    """MAX_FILE_BYTES, unless the environment sets another bound; 0 is none."""
    try:
        found = int(os.environ.get("TALLYGLASS_MAX_FILE_BYTES", MAX_FILE_BYTES))
    except ValueError:
        return MAX_FILE_BYTES
    return found if found >= 0 else MAX_FILE_BYTES


class Refused(Exception):
    """Why a file is not read."""


def is_below(path: str, folder: str) -> bool:
    return path == folder or path.startswith(folder.rstrip(os.sep) + os.sep)


def _open(path: str, root: str | None) -> int:
    flags = os.O_RDONLY | os.O_NONBLOCK | os.O_CLOEXEC
    if root is None:
        return os.open(path, flags)
    real_root = os.path.realpath(root)
    full = os.path.abspath(path)
    start = next((r for r in (os.path.abspath(root), real_root) if is_below(full, r)), None)
    if start is None:
        raise Refused(f"skipped {path!r}, which lies outside the scan root")
    parts = os.path.relpath(full, start).split(os.sep)
    here = os.open(real_root, flags | os.O_DIRECTORY)
    try:
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            try:
                inner = os.open(part, flags | os.O_NOFOLLOW | (0 if last else os.O_DIRECTORY), dir_fd=here)
            except OSError as e:
                if e.errno in (errno.ELOOP, errno.ENOTDIR):
                    raise Refused(f"skipped {path!r}, as {part!r} is a link or no folder and may lead outside the scan root") from e
                raise
            os.close(here)
            here = inner
        return here
    except BaseException:
        os.close(here)
        raise


def _kind(mode: int) -> str:
    tests = ((stat.S_ISDIR, "folder"), (stat.S_ISFIFO, "pipe"), (stat.S_ISSOCK, "socket"), (stat.S_ISCHR, "device"), (stat.S_ISBLK, "device"))
    return next((name for test, name in tests if test(mode)), "special file")


def _drain(fd: int, most: int) -> bytes:
    out = bytearray()
    while len(out) < most and (piece := os.read(fd, min(1 << 20, most - len(out)))):
        out += piece
    return bytes(out)


def read_bytes(path: str, health: Health, stage: str, required: bool = True) -> bytes | None:
    """The file's bytes, or null with a note. A file that isn't there leaves none if it isn't required."""
    health.protect(path)
    try:
        fd = _open(path, health.root)
    except FileNotFoundError:
        if required:
            health.note(f"{stage}: {path}: the file isn't there", path)
        return None
    except Refused as e:
        health.note(f"{stage}: {e}", path)
        return None
    except OSError as e:
        health.note(f"{stage}: could not read {path}: {e}", path)
        return None
    try:
        before, most = os.fstat(fd), file_budget()
        if not stat.S_ISREG(before.st_mode):
            health.note(f"{stage}: skipped {path!r}, which is a {_kind(before.st_mode)} and no regular file", path)
            return None
        if most and before.st_size > most:
            health.note(f"{stage}: skipped {path!r}: {before.st_size} bytes, and {most} are read at most", path)
            return None
        data, after = _drain(fd, before.st_size + 1), os.fstat(fd)
        same = all(getattr(before, k) == getattr(after, k) for k in ("st_size", "st_mtime_ns", "st_ctime_ns"))
        if len(data) != before.st_size or not same:
            health.note(f"{stage}: skipped {path!r}, which changed while it was read", path)
            return None
    except OSError as e:
        health.note(f"{stage}: could not read {path}: {e}", path)
        return None
    finally:
        os.close(fd)
    health.read[os.path.realpath(path)] = None
    return data


def read_text(path: str, health: Health, stage: str, required: bool = True) -> str | None:
    """The file as UTF-8, without a byte order mark."""
    data = read_bytes(path, health, stage, required)
    if data is None:
        return None
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        health.note(f"{stage}: {path}: this is no UTF-8: {e}", path)
        return None
