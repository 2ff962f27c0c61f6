"""Symbols and relationships of Python files, from the standard library's syntax tree.

Its columns count UTF-8 bytes, so places and hashes are those of the file's bytes. A file with a syntax error is read block
by block: in a block that does not parse, the line of each error is put out of the way by a word of its length, or with
what depends on it, until the rest parses. Print statements and handlers of Python 2 are rewritten in place. The lines that are
left out are reported; the module symbol is always there.
"""

from __future__ import annotations

import ast
import codecs
import io
import re
import tokenize
from functools import cache

from codeloom.extract.model import Extraction, Source, calls_in_order, parameter

#: Errors that are mended in one top-level block; what is left of it after so many is left out, and reported.
MENDS = 2_000
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.match_case)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BOM = b"\xef\xbb\xbf"
#: Fields that hold blocks of statements, and fields whose nodes only name an operator or a use.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")
_MARKS = ("ctx", "op", "ops")


@cache
def _fields(kind: type[ast.AST]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Of a kind of node: the fields with blocks, and all fields but marks, both in the order of the tree."""
    blocks = _BLOCKS if issubclass(kind, (ast.mod, ast.stmt, ast.excepthandler, ast.match_case)) else ()
    return tuple(f for f in kind._fields if f in blocks), tuple(f for f in kind._fields if f not in _MARKS)


codecs.register_error("codeloom.marks", lambda e: ("?" * (e.end - e.start), e.end))


def _readable(data: bytes) -> bytes:
    """The bytes with whatever is no UTF-8, or no source text, replaced byte for byte."""
    return data.replace(b"\x00", b" ").decode("utf-8", "codeloom.marks").encode()


#: Strings and comments; a triple quote that is never closed runs to the end.
_QUIET = re.compile(rb"""#[^\n]*|(?P<open>\"{3}|'{3})(?:(?:\\.|(?!(?P=open)).)*(?P=open)|(?P<rest>.*))|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*\"""", re.S)
_ANCHOR = re.compile(rb"(?:async\s+def|def|class|import|from)\b|@")
_FOLLOWS = re.compile(rb"(?:elif|else|except|finally)\b|[)\]}]")
_COMPOUND = re.compile(rb"(?:if|for|while|with|try|elif|else|except|finally|match|case|async\s+(?:for|with))\b")
_DEFINES = re.compile(rb"(?:async\s+def|def|class)\b")
_PRINTS = re.compile(rb"(\s*)print(\s+)([^\s=(.,\[:)>#][^#]*?|\"[^#]*?)(\s*)")
_HANDLES = re.compile(rb"(\s*except\s+(?:[\w.]+|\([^()]*\)))(\s*,\s*\w+)(\s*:.*)", re.S)


def _top_blocks(data: bytes) -> tuple[list[int], int | None]:
    """Rows on which top-level blocks start, outside of strings and brackets, and the row of a triple quote that is never
    closed. A definition or an import in the first column starts a block even where a bracket seems to be open."""
    quiet = bytearray(data)
    unclosed = None
    for m in _QUIET.finditer(data):
        if m.group("rest") is not None:
            unclosed = data.count(b"\n", 0, m.start())
        quiet[m.start() : m.end()] = re.sub(rb"[^\n]", b" ", m.group()) if m.start() and data[m.start() - 1 : m.start()] != b"\n" else b"_" + re.sub(rb"[^\n]", b" ", m.group()[1:])
    starts, depth, joined = [], 0, False
    for row, line in enumerate(bytes(quiet).split(b"\n")):
        if line[:1].strip() and not _FOLLOWS.match(line) and ((depth == 0 and not joined) or _ANCHOR.match(line)):
            starts.append(row)
            depth = 0
        depth = max(0, depth + sum(line.count(c) for c in (b"(", b"[", b"{")) - sum(line.count(c) for c in (b")", b"]", b"}")))
        joined = line.endswith(b"\\") or (line.startswith(b"@") and bool(starts))
    return starts, unclosed


def _indent(line: bytes) -> int:
    return len(line) - len(line.lstrip())


def _word(line: bytes) -> bytes:
    """A name as long as the line's text, in its place."""
    return line[: _indent(line)] + b"_" * len(line.strip())


def _mend(lines: list[bytes], row: int, seen: dict[int, int]) -> None:
    """Put the statement of a row out of the way; each time that a row fails again, more goes with it."""
    while row > 0 and (not lines[row].strip() or seen.get(row, 0) > 2):
        row -= 1
    line, seen[row] = lines[row], seen.get(row, 0) + 1
    text = line.strip()
    if _COMPOUND.match(text) and seen[row] == 1:
        lines[row] = line[: _indent(line)] + b"if 1:"
    elif seen[row] == 1 and not _DEFINES.match(text):
        lines[row] = _word(line)
    else:
        end = row + 1
        while end < len(lines) and (not lines[end].strip() or _indent(lines[end]) > _indent(line)):
            end += 1
        first = row
        while first > 0 and lines[first - 1].strip().startswith(b"@") and _indent(lines[first - 1]) == _indent(line):
            first -= 1
        for k in range(first, end):
            if lines[k].strip():
                seen[k] = max(1, seen.get(k, 0))
            lines[k] = b""
        if seen[row] < 3:
            lines[row] = _word(line)


def _block(lines: list[bytes]) -> tuple[ast.Module, set[int]]:
    """The tree of one block, and the rows that were left out of it."""
    seen: dict[int, int] = {}
    for attempt in range(MENDS):
        try:
            return ast.parse(b"\n".join(lines).decode("utf-8")), set(seen)
        except SyntaxError as e:
            if attempt == 0:
                for k, line in enumerate(lines):
                    if m := _PRINTS.fullmatch(line):
                        lines[k] = m[1] + b"_    " + m[2][:-1] + b"[" + m[3] + b"]"
                    elif m := _HANDLES.fullmatch(line):
                        lines[k] = m[1] + b" " * len(m[2]) + m[3]
            row = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
        except (RecursionError, MemoryError, ValueError):
            row = max(range(len(lines)), key=lambda k: len(lines[k]))
        if attempt:
            _mend(lines, row, seen)
    return ast.Module(body=[], type_ignores=[]), set(range(len(lines)))


def _parse(data: bytes) -> tuple[ast.Module, list[int]]:
    """The tree, and the rows that were left out of it."""
    try:
        return ast.parse(data.decode("utf-8")), []
    except (SyntaxError, RecursionError, MemoryError, ValueError):
        lines, left, body = data.split(b"\n"), [], []
    starts, unclosed = _top_blocks(data)
    end = len(lines)
    if unclosed is not None:
        left += range(unclosed, end)
        lines[unclosed:] = [b""] * (end - unclosed)
    for first, stop in zip(starts, [*starts[1:], end], strict=True):
        tree, lost = _block(lines[first:stop])
        body += ast.increment_lineno(tree, first).body
        left += [first + k for k in lost]
    return ast.Module(body=body, type_ignores=[]), sorted(set(left))


def _spans(rows: list[int]) -> str:
    """1-based line ranges of sorted rows."""
    out: list[list[int]] = []
    for row in rows:
        if out and out[-1][1] == row:
            out[-1][1] = row + 1
        else:
            out.append([row + 1, row + 1])
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in out)


class _Reader:
    def __init__(self, out: Extraction, data: bytes, mark: int = 0):
        self.out, self.data, self.mark = out, data, mark
        self.index = Source(data[mark:])

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.mark + self.index.at(node.lineno, node.col_offset), self.mark + self.index.at(node.end_lineno, node.end_col_offset)

    def text(self, node: ast.AST) -> str:
        return self.out.source.text(*self.span(node))

    def start(self, node: ast.AST) -> int:
        """Start of a statement with its decorators."""
        decorators = getattr(node, "decorator_list", None)
        return self.data.rfind(b"@", 0, self.span(decorators[0])[0] + 1) if decorators else self.span(node)[0]

    def body(self, node: ast.AST) -> tuple[int, int]:
        return self.start(node.body[0]), self.span(node.body[-1])[1]

    def decorators(self, node: ast.AST) -> list[str]:
        return ["@" + self.text(d) for d in node.decorator_list]

    def docstring(self, body: list[ast.stmt]) -> str | None:
        if not body or not isinstance(body[0], ast.Expr) or not isinstance(body[0].value, (ast.Constant, ast.JoinedStr)):
            return None
        value = body[0].value
        if isinstance(value, ast.Constant) and not isinstance(value.value, (str, bytes)):
            return None
        raw = self.text(value)
        if isinstance(value, ast.Constant) and _pieces(raw) != 1:
            return None
        for quote in ('"""', "'''", '"', "'"):
            if len(raw) >= 2 * len(quote) and raw.startswith(quote) and raw.endswith(quote):
                return raw[len(quote) : -len(quote)]
        return raw

    def parameters(self, args: ast.arguments) -> list[dict]:
        note = lambda a: self.text(a.annotation) if a.annotation else None
        plain = [*args.posonlyargs, *args.args]
        defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
        value = lambda d: self.text(d) if d else None
        out = [parameter(a.arg, note(a), value(d)) for a, d in zip(plain, defaults, strict=True)]
        if args.vararg:
            out.append(parameter(args.vararg.arg, note(args.vararg), variadic=True))
        out += [parameter(a.arg, note(a), value(d)) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
        if args.kwarg:
            out.append(parameter(args.kwarg.arg, note(args.kwarg), keyword_variadic=True))
        return out

    def inside(self, body: list[ast.stmt]) -> list[ast.AST]:
        """All nodes of a body but marks; of nested functions only the decorators."""
        found, todo = [], list(body)
        while todo:
            node = todo.pop()
            if isinstance(node, _DEFS):
                todo += node.decorator_list
                continue
            found.append(node)
            for field in _fields(type(node))[1]:
                value = getattr(node, field, None)
                if isinstance(value, ast.AST):
                    todo.append(value)
                elif isinstance(value, list):
                    todo += [v for v in value if isinstance(v, ast.AST)]
        return found

    def complexity(self, nodes: list[ast.AST]) -> int:
        return 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, _BRANCHES) for n in nodes)

    def calls(self, nodes: list[ast.AST]) -> list[tuple[int, int, str, dict]]:
        found = []
        for n in nodes:
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
                found.append((*self.span(n), n.func.id, {"call_form": "direct"}))
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute):
                found.append((*self.span(n), n.func.attr, {"call_form": "method", "receiver": self.text(n.func.value)}))
        return calls_in_order(found)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, qualified: str, owner: dict | None) -> dict:
        start, end = self.span(node)
        first, last = self.body(node)
        decorators = self.decorators(node)
        nodes = self.inside(node.body)
        own = {
            "signature": self.out.source.text(start, first).strip().rstrip(":").strip(),
            "parameters": self.parameters(node.args),
            "return_type": self.text(node.returns) if node.returns else None,
            "docstring": self.docstring(node.body),
            "decorators": decorators,
            "is_async": isinstance(node, ast.AsyncFunctionDef),
            "complexity": self.complexity(nodes),
        }
        if owner:
            own |= {"enclosing_class_id": owner["id"], "is_static": any("staticmethod" in d for d in decorators), "is_constructor": node.name == "__init__"}
        kind = "method" if owner else "function"
        row = self.out.symbol(kind, node.name, qualified, start, end, self.out.source.data[first:last], visibility(node.name), exported(node.name), owner and owner["name"], **own)
        return row | {"_calls": self.calls(nodes)}


def _pieces(raw: str) -> int:
    try:
        return sum(t.type == tokenize.STRING for t in tokenize.generate_tokens(io.StringIO(f"({raw})").readline))
    except (tokenize.TokenError, SyntaxError):
        return 1


def visibility(name: str) -> str:
    return "private" if name.startswith("_") and not _dunder(name) else "public"


def exported(name: str) -> bool:
    return not name.startswith("_") or _dunder(name)


def _dunder(name: str) -> bool:
    return name.startswith("__") and name.endswith("__")


def extract(path: str, data: bytes, repo: str, scheme: str = "loom", future_imports: bool = False) -> Extraction:
    """All rows of one file."""
    out = Extraction("python", path, repo, Source(data), scheme)
    clean = _readable(data)
    mark = len(_BOM) if clean.startswith(_BOM) else 0
    tree, left = _parse(clean[mark:])
    out.left_out = f"left out lines {_spans(left)}" if left else None
    reader = _Reader(out, clean, mark)
    qualified = out.module.replace("/", ".")
    module = out.module_symbol(qualified, reader.docstring(tree.body))

    classes: list[ast.ClassDef] = []
    functions: list[tuple[ast.AST, ast.ClassDef | None]] = []
    imports: list[ast.AST] = []

    # A walk over statements, which no expression holds, with its own stack: blocks may be nested deeper than calls can be.
    todo: list[tuple[ast.AST, ast.AST | None]] = [(tree, None)]
    while todo:
        node, scope = todo.pop()
        if isinstance(node, ast.ClassDef):
            classes.append(node)
        elif isinstance(node, _DEFS) and not isinstance(scope, _DEFS):
            functions.append((node, scope))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            imports.append(node)
        inner = node if isinstance(node, (ast.ClassDef, *_DEFS)) else scope
        todo += [(child, inner) for field in reversed(_fields(type(node))[0]) for child in reversed(getattr(node, field))]
    rows: dict[ast.ClassDef, dict] = {}
    for node in classes:
        start, end = reader.span(node)
        first, last = reader.body(node)
        bases = [reader.text(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        decorators = reader.decorators(node)
        rows[node] = out.symbol(
            "class", node.name, f"{qualified}.{node.name}", start, end, data[first:last], visibility(node.name), exported(node.name), base_classes=bases, docstring=reader.docstring(node.body), decorators=decorators,
            is_abstract=any("ABC" in b for b in bases) or any("ABCMeta" in d for d in decorators),
        )
        out.relate(module["id"], "contains", rows[node]["id"])
        for base in bases:
            out.relate(rows[node]["id"], "extends", target_name=base, import_source=None, call_form="attribute" if "." in base else "direct")
    for node, scope in functions:
        owner = rows[scope] if scope is not None else None
        name = f"{qualified}.{owner['name']}.{node.name}" if owner else f"{qualified}.{node.name}"
        row = reader.function(node, name, owner)
        out.relate(owner["id"] if owner else module["id"], "contains", row["id"])
        for a, b, target, form in row["_calls"]:
            out.relate(row["id"], "calls", target_name=target, span=(a, b), **form)
    for node in tree.body:
        if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            name = node.target.id
            start, end = reader.span(node)
            row = out.symbol("variable", name, f"{qualified}.{name}", start, end, data[start:end], visibility(name), exported(name), type_annotation=reader.text(node.annotation), is_constant=name.isupper())
            out.relate(module["id"], "contains", row["id"])
    for node in imports:
        if isinstance(node, ast.ImportFrom) and (future_imports or node.module != "__future__"):
            origin = "." * node.level + (node.module or "")
            for alias in node.names:
                out.relate(module["id"], "imports", target_name=alias.name, span=reader.span(alias), import_source=origin, alias=alias.asname)
    for node in imports:
        if isinstance(node, ast.Import):
            for alias in node.names:
                out.relate(module["id"], "imports", target_name=alias.name, span=reader.span(alias), import_source=None, alias=alias.asname, call_form="module")
    return out
