"""Ignore files as compiled patterns, with git's meaning of nesting, anchoring and negation.

A file's patterns apply below its folder, deeper files come later, and the last pattern that fits a path decides. A
path under an ignored directory stays ignored, whatever is negated below it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _glob(pattern: str) -> str:
    """Regular expression of one pattern's text, without anchors."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.+")
            i += 3
        elif c == "*":
            out.append("[^/]*")
            i += 1 + (pattern[i + 1 : i + 2] == "*")
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            own = pattern[i + 1 : end]
            out.append("[" + ("^/" + own[1:] if own[0] in "!^" else own).replace("\\", "\\\\") + "]")
            i = end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


class Rules:
    """files: folder of each ignore file ("" for the root) and its lines."""

    def __init__(self, files: dict[str, list[str]]):
        self.rules: list[tuple[bool, bool, re.Pattern]] = []  # negated, directories only, pattern
        for folder in sorted(files, key=lambda f: (f.count("/") + bool(f), f)):
            for line in files[folder]:
                if rule := self._rule(folder, line):
                    self.rules.append(rule)

    @staticmethod
    def _rule(folder: str, line: str) -> tuple[bool, bool, re.Pattern] | None:
        line = line.rstrip("\r\n")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line[0] == "#":
            return None
        negated = line[0] == "!"
        line = line[1:] if negated else line
        only_dirs = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            return None
        anchored = "/" in line
        prefix = re.escape(folder + "/") if folder else ""
        return negated, only_dirs, re.compile(prefix + ("" if anchored else "(?:[^/]+/)*") + _glob(line.lstrip("/")) + r"\Z")

    @classmethod
    def load(cls, root: str | Path) -> Rules:
        root = Path(root)
        found = {}
        for path in sorted(root.rglob(".gitignore")):
            folder = path.parent.relative_to(root).as_posix()
            found["" if folder == "." else folder] = path.read_text(encoding="utf-8", errors="replace").splitlines()
        return cls(found)

    def _decides(self, path: str, is_dir: bool) -> bool:
        ignored = False
        for negated, only_dirs, pattern in self.rules:
            if (is_dir or not only_dirs) and pattern.match(path):
                ignored = not negated
        return ignored

    def ignores(self, path: str, is_dir: bool = False) -> bool:
        parts = path.split("/")
        return any(self._decides("/".join(parts[:i]), True) for i in range(1, len(parts))) or self._decides(path, is_dir)

    def column(self, path: Column | str) -> Column:
        rules = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda p: p is not None and rules.ignores(p)).astype(bool)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "boolean")(path)
