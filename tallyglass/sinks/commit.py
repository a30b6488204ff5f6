"""Several files, written together or not at all.

All contents are staged beside their destinations and what is there is copied aside before anything is replaced. If a
replacement fails, the copies are put back; if even that fails, the error says what each file holds now and where its copy is.
While files are replaced an index of the copies lies beside the first destination, so a process that dies leaves what
recover() needs.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import stat
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass, field

PRIVATE = 0o600


@dataclass
class CommitError(Exception):
    """states: old, new, absent or uncertain for each destination; recovery: copies of what was there."""

    message: str
    states: dict[str, str] = field(default_factory=dict)
    recovery: dict[str, str] = field(default_factory=dict)
    index: str | None = None

    def __str__(self) -> str:
        return self.message


def _beside(path: str, what: str) -> tuple[int, str]:
    return tempfile.mkstemp(prefix=f".{os.path.basename(path)}.", suffix=f".{what}", dir=os.path.dirname(path) or ".")


def _stage(path: str, text: str | Iterable[str]) -> str:
    fd, temp = _beside(path, "new")
    try:
        with os.fdopen(fd, "wb") as f:
            for piece in [text] if isinstance(text, str) else text:
                f.write(piece.encode("utf-8", "surrogatepass"))
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temp, stat.S_IMODE(os.stat(path).st_mode) if os.path.exists(path) else PRIVATE)
    except BaseException:
        _forget([temp])
        raise
    return temp


def _copy(path: str) -> str | None:
    if not os.path.exists(path):
        return None
    fd, temp = _beside(path, "old")
    os.close(fd)
    try:
        shutil.copy2(path, temp)
    except BaseException:
        _forget([temp])
        raise
    return temp


def _forget(paths) -> None:
    for p in filter(None, paths):
        with contextlib.suppress(OSError):
            os.unlink(p)


def _sync_folders(paths: list[str]) -> None:
    for folder in {os.path.dirname(p) or "." for p in paths}:
        with contextlib.suppress(OSError):
            fd = os.open(folder, os.O_RDONLY)
            try:
                os.fsync(fd)
            finally:
                os.close(fd)


def commit_all(pairs: list[tuple[str, str | Iterable[str]]]) -> None:
    """pairs: destination and text, whole or in pieces. Raises CommitError if not all of them could be replaced."""
    paths = [os.path.realpath(p) for p, _ in pairs]
    if len(set(paths)) < len(paths):
        raise CommitError("two outputs have the same destination", {p: "old" if os.path.exists(p) else "absent" for p in paths})
    before = {p: "old" if os.path.exists(p) else "absent" for p in paths}
    staged: dict[str, str] = {}
    copies: dict[str, str | None] = {}
    try:
        for p, (_, text) in zip(paths, pairs):
            staged[p] = _stage(p, text)
            copies[p] = _copy(p)
    except OSError as e:
        _forget([*staged.values(), *copies.values()])
        raise CommitError(f"the outputs could not be prepared: {e}", before) from e
    except BaseException:  # pieces are made while they are written
        _forget([*staged.values(), *copies.values()])
        raise
    states = dict(before)
    index = None
    try:
        index = _write_index(copies)
        for p in paths:
            states[p] = "uncertain"
            os.replace(staged[p], p)
            states[p] = "new"
    except OSError as e:
        left = _undo(states, before, copies)
        _forget(staged.values())
        _forget(c for p, c in copies.items() if p not in left)
        if not left:
            _forget([index])
        raise CommitError(f"an output could not be replaced: {e}", states, left, index if left else None) from e
    _sync_folders(paths)
    _forget([index])
    _forget(copies.values())


def _write_index(copies: dict[str, str | None]) -> str | None:
    if not copies:
        return None
    fd, index = _beside(next(iter(copies)), "index")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", errors="surrogatepass") as f:
            json.dump(copies, f)
            f.flush()
            os.fsync(f.fileno())
    except BaseException:
        _forget([index])
        raise
    _sync_folders([index])
    return index


def recover(index: str) -> dict[str, str]:
    """Takes back a commit that died: each destination holds what it held before, or is absent. Returns these states."""
    with open(index, encoding="utf-8", errors="surrogatepass") as f:
        copies = json.load(f)
    states = {}
    for p, copy in copies.items():
        if copy and os.path.exists(copy):
            os.replace(copy, p)
        elif not copy and os.path.exists(p):
            os.unlink(p)
        states[p] = "old" if copy else "absent"
    _sync_folders(list(copies))
    _forget([index])
    return states


def _undo(states: dict[str, str], before: dict[str, str], copies: dict[str, str | None]) -> dict[str, str]:
    """Puts back what was there; returns the copies of files that this failed for."""
    left: dict[str, str] = {}
    for p, state in states.items():
        if state not in ("new", "uncertain"):
            continue
        try:
            if copies[p]:
                os.replace(copies[p], p)
            elif os.path.exists(p):
                os.unlink(p)
            states[p] = before[p]
        except OSError:
            states[p] = "uncertain"
            if copies[p]:
                left[p] = copies[p]
    return left
