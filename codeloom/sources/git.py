"""What git says about a checkout; all of it runs on the driver."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from codeloom.schemas import CHANGED_FILES

UNKNOWN = "unknown"
#: How the status letters of a diff are read.
STATUS = {"A": "added", "C": "added", "M": "modified", "D": "deleted"}


class GitError(RuntimeError):
    """git ended with an error."""


def _git(root: str | Path, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, check=False)
    if done.returncode:
        raise GitError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout


def clone(url: str, root: str | Path) -> Path:
    """A new checkout of a repository; its parent folder is made. The url is never read as an option, and a terminal is never asked
    for a password."""
    root = Path(root)
    root.parent.mkdir(parents=True, exist_ok=True)
    done = subprocess.run(["git", "clone", "--", url, str(root)], capture_output=True, check=False, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    if done.returncode:
        raise GitError(f"git clone failed with exit code {done.returncode}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return root


def head_sha(root: str | Path) -> str:
    """The checked-out commit, ``unknown`` outside a repository."""
    try:
        return _git(root, "rev-parse", "HEAD").decode().strip() or UNKNOWN
    except (GitError, FileNotFoundError):
        return UNKNOWN


def remote_url(root: str | Path) -> str | None:
    try:
        return _git(root, "config", "--get", "remote.origin.url").decode().strip() or None
    except (GitError, FileNotFoundError):
        return None


def changes(root: str | Path, old: str, new: str) -> list[tuple[str, str]]:
    """(path, status) of what differs between two commits; renames are a deletion and an addition."""
    fields = _git(root, "diff", "--name-status", "-z", "--diff-filter=ACDM", "--no-renames", f"{old}..{new}").decode("utf-8", "surrogateescape").split("\0")
    found, i = [], 0
    while i + 1 < len(fields):
        letter = fields[i][:1]
        i += 2 if letter == "C" else 1  # a copy names its source first
        if letter in STATUS:
            found.append((fields[i], STATUS[letter]))
        i += 1
    return found


def changed_files(spark: SparkSession, root: str | Path, old: str, new: str) -> DataFrame:
    return spark.createDataFrame(changes(root, old, new), CHANGED_FILES)
