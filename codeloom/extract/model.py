"""What the extractors of all languages share: rows of symbols and relationships, and positions in a file."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass, field

from codeloom.functions.identity import SCHEME, SUFFIXES


def sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def text(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


class Source:
    """A file's bytes with line starts; places are byte offsets."""

    def __init__(self, data: bytes):
        self.data = data
        self.lines = [0]
        at = data.find(b"\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = data.find(b"\n", at + 1)

    def at(self, line: int, column: int) -> int:
        """Offset of a 1-based line and a 0-based byte column, at most the line's end."""
        end = self.lines[line] - 1 if line < len(self.lines) else len(self.data)
        return min(self.lines[line - 1] + column, end)

    def location(self, start: int, end: int) -> dict:
        first, last = bisect_right(self.lines, start), bisect_right(self.lines, end)
        return {
            "line_start": first,
            "line_end": last,
            "byte_start": start,
            "byte_end": end,
            "column_start": start - self.lines[first - 1],
            "column_end": end - self.lines[last - 1],
        }

    def text(self, start: int, end: int) -> str:
        return text(self.data[start:end])


@dataclass
class Extraction:
    """Collects the rows of one file in emission order."""

    language: str
    path: str
    repo: str
    source: Source
    scheme: str = SCHEME
    symbols: list[dict] = field(default_factory=list)
    relationships: list[dict] = field(default_factory=list)
    #: What an extractor could not read of the file, in words.
    left_out: str | None = None

    def moniker(self, kind: str, name: str, owner: str | None = None) -> str:
        tail = (f"{owner}#" if kind == "method" else "") + name + SUFFIXES[kind]
        return " ".join(part.replace(" ", "%20") for part in (self.scheme, self.language, self.repo, self.path, tail))

    @property
    def stem(self) -> str:
        return self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0] or self.path.rsplit("/", 1)[-1]

    @property
    def module(self) -> str:
        folder, slash, file = self.path.rpartition("/")
        name, dot, _ = file.rpartition(".")
        return folder + slash + (name if dot and name else file)

    def symbol(self, kind: str, name: str, qualified: str, start: int, end: int, hashed: bytes, visibility: str, exported: bool, owner: str | None = None, moniker_name: str | None = None, **more) -> dict:
        whole = self.source.data[start:end]
        row = {
            "id": self.moniker(kind, moniker_name or name, owner),
            "kind": kind,
            "name": name,
            "qualified_name": qualified,
            "repo_name": self.repo,
            "file_path": self.path,
            "location": self.source.location(start, end),
            "body_hash": sha256(hashed),
            "language": self.language,
            "visibility": visibility,
            "is_exported": exported,
            "meta_hash": sha256(whole),
            "symbol_text": text(whole) if kind in ("function", "method") else None,
            "ord": len(self.symbols),
            **more,
        }
        self.symbols.append(row)
        return row

    def module_symbol(self, qualified: str, docstring: str | None, name: str | None = None, moniker_name: str | None = None) -> dict:
        n = len(self.source.data)
        return self.symbol("module", name or self.stem, qualified, 0, n, self.source.data, "public", True, moniker_name=moniker_name or self.module, docstring=docstring)

    def relate(self, source_id: str, kind: str, target_id: str | None = None, target_name: str | None = None, span: tuple[int, int] | None = None, **metadata) -> None:
        self.relationships.append(
            {
                "source_id": source_id,
                "kind": kind,
                "is_resolved": target_id is not None,
                "target_id": target_id,
                "target_name": target_name,
                "location": self.source.location(*span) if span else None,
                "metadata": metadata or None,
                "repo_name": self.repo,
                "file_path": self.path,
                "ord": len(self.relationships),
            }
        )

    def first_wins(self) -> None:
        """Drop later symbols of a moniker, and the repeated containments that they leave."""
        seen: set[str] = set()
        self.symbols = [s for s in self.symbols if s["id"] not in seen and not seen.add(s["id"])]
        pairs: set[tuple] = set()
        kept = []
        for r in self.relationships:
            pair = (r["source_id"], r["target_id"])
            if r["kind"] == "contains" and pair in pairs:
                continue
            pairs.add(pair)
            kept.append(r)
        self.relationships = kept


def calls_in_order(found: list[tuple[int, int, str, dict]]) -> list[tuple[int, int, str, dict]]:
    """Calls (start, end, target, metadata) from the last to the first that ends; an outer call precedes its arguments."""
    return sorted(found, key=lambda c: (-c[1], c[0]))


def parameter(name: str, annotation: str | None = None, default: str | None = None, variadic: bool = False, keyword_variadic: bool = False) -> dict:
    return {"name": name, "type_annotation": annotation, "default_value": default, "is_variadic": variadic, "is_keyword_variadic": keyword_variadic}
