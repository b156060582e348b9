"""What a stale answer shows of a local tree as it is now: bounded reads of the files that were meant, and the diff.

A read is refused unless the path is a canonical one of the project, leads to a regular file inside the root without a
link at its end, and the opened file is the one that was looked at.  These run on the driver, for a few paths.
"""

from __future__ import annotations

import os
import stat
import subprocess
from dataclasses import dataclass

from cairn.operators.scan import utf8_prefix

# Bytes of a diff and of an excerpt.
DIFF_BYTES, EXCERPT_BYTES = 16 * 1024, 4 * 1024


class Refused(ValueError):
    """The file that was asked for isn't one that may be shown."""


def _text(data: bytes, most: int) -> str:
    return utf8_prefix(data[:most].decode("utf-8", "replace"), most)


def git_diff(root: str, most: int = DIFF_BYTES) -> str:
    """The first bytes of the uncommitted changes; empty where git fails."""
    command = ["git", "-C", root, "diff", "--no-ext-diff", "--unified=1", "--"]
    try:
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
            data = run.stdout.read(most + 1)
            # Beyond the bound git is not waited for.
            cut = len(data) > most
            run.kill() if cut else run.wait()
        return _text(data, most) if cut or run.returncode == 0 else ""
    except OSError:
        return ""


def canonical(path: str) -> bool:
    """Whether ``path`` is relative, without empty, ``.`` and ``..`` segments, back slashes or NUL."""
    return bool(path) and not any(s in ("", ".", "..") for s in path.split("/")) and "\\" not in path and "\0" not in path


@dataclass(frozen=True)
class Fingerprint:
    """What tells two states of a file apart; ``reusable`` only where it names the file and its times exactly."""

    value: str
    reusable: bool


def fingerprint(root: str, path: str) -> Fingerprint | None:
    """Of the file itself, not of what a link leads to; None where it can't be told."""
    try:
        s = os.lstat(os.path.join(root, path))
    except FileNotFoundError:
        return Fingerprint("missing", True)
    except OSError:
        return None
    kind = "file" if stat.S_ISREG(s.st_mode) else "non-regular"
    return Fingerprint(":".join(map(str, (kind, s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_mode, s.st_ino, s.st_dev))), True)


def read_prefix(root: str, path: str, most: int) -> bytes:
    """The first ``most`` bytes of a file below ``root``."""
    base = os.path.realpath(root)
    where = os.path.join(base, path)
    if not canonical(path):
        raise Refused("not a canonical path")
    seen = os.lstat(where)
    if not stat.S_ISREG(seen.st_mode):
        raise Refused("not a regular file")
    if os.path.commonpath([base, os.path.realpath(where)]) != base:
        raise Refused("outside the root")
    handle = os.open(where, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    with os.fdopen(handle, "rb") as file:
        now = os.fstat(handle)
        if (now.st_dev, now.st_ino) != (seen.st_dev, seen.st_ino):
            raise Refused("another file since")
        return file.read(most)


def excerpt(root: str, path: str, most: int = EXCERPT_BYTES) -> str:
    """The start of a text file; binary files (a NUL in what was read) are refused."""
    data = read_prefix(root, path, most)
    if b"\0" in data:
        raise Refused("not a text")
    return _text(data, most)


class Outcomes:
    """Results by path, valid while the file's fingerprint stands.

    ``work`` runs anew where the fingerprint can't be trusted or has changed while it ran; ``passing`` results are never
    kept.
    """

    def __init__(self, root: str, passing: tuple[str, ...] = ("read-error", "ignored")):
        self.root, self.passing, self.kept = root, passing, {}

    def get(self, path: str, work) -> str:
        before = fingerprint(self.root, path)
        known = self.kept.get(path)
        if known and before and before.reusable and known[0] == before.value:
            return known[1]
        out = work(path)
        after = fingerprint(self.root, path)
        self.kept.pop(path, None)
        if before and after and before.reusable and before == after and out not in self.passing:
            self.kept[path] = before.value, out
        return out

    def retain(self, paths) -> None:
        """Forgets all other paths."""
        paths = set(paths)
        self.kept = {p: x for p, x in self.kept.items() if p in paths}
