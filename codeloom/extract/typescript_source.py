"""Symbols and relationships of TypeScript files (.ts and .tsx), from a scanner over the bytes.

Only top-level declarations are read: classes, interfaces, enums, type aliases, functions, annotated constants and function
values with a return type, imports and re-exports. Types are skipped over by a small grammar, expressions by their
brackets and by where a line can end. Namespaces, ambient declarations and anonymous defaults yield nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from codeloom.extract.model import Extraction, Source, calls_in_order, parameter
from codeloom.extract.model import text as decode

_TOKEN = re.compile(
    rb"""(?P<space>[ \t\r\f\v\n]+)|(?P<comment>//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<number>\.?[0-9](?:[eE][+-]|[\w.])*)|(?P<name>\#?[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<mark>=>|\.\.\.|\?\.(?![0-9])|\?\?=?|&&=?|\|\|=?|===?|!==?|\*\*|\+\+|--|[-+*/%&|^]=|.)""",
    re.X | re.S,
)
_REGEX = re.compile(rb"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_WORDS_BEFORE_VALUE = frozenset(b"return typeof case in of instanceof new delete void throw do else yield await".split())
_NOT_CALLED = frozenset(b"if for while switch catch function return typeof await yield super import new async do else in of case void delete throw with constructor".split())
_OPEN, _CLOSE = {b"(": b")", b"[": b"]", b"{": b"}"}, {b")": b"(", b"]": b"[", b"}": b"{"}
_ACCESS = {b"public": "public", b"private": "private", b"protected": "protected"}
_MODIFIERS = frozenset(b"public private protected static async override readonly abstract get set declare accessor".split())
_TYPE_PREFIXES = frozenset(b"keyof typeof readonly unique infer asserts new abstract".split())
_CONTINUES = frozenset(b". ?. + - * / % && || ?? ? : , = == === != !== => & | < > ** ( [ += -= *= /= `".split())


@dataclass(frozen=True)
class Token:
    kind: str  # name, string, number, mark or template
    text: bytes
    start: int
    end: int
    breaks: bool  # a line ended before it


def tokens(data: bytes) -> tuple[list[Token], list[Token]]:
    out: list[Token] = []
    comments: list[Token] = []
    at, breaks, braces = 0, False, []  # braces: per open brace, whether it is a template's

    def template(start: int) -> int:
        """Scan template text up to its end or to an opening ``${``."""
        i = start
        while i < len(data):
            if data[i : i + 1] == b"\\":
                i += 2
                continue
            if data[i : i + 1] == b"`":
                return i + 1
            if data[i : i + 2] == b"${":
                return i + 2
            i += 1
        return i

    def piece(start: int, text_from: int) -> int:
        end = template(text_from)
        out.append(Token("template", data[start:end], start, end, breaks))
        if data[end - 2 : end] == b"${":
            braces.append(True)
            out.append(Token("mark", b"{", end - 1, end, False))
        return end

    while at < len(data):
        before = out[-1] if out else None
        if data[at : at + 1] == b"`":
            at, breaks = piece(at, at + 1), False
            continue
        if data[at : at + 1] == b"/" and data[at : at + 2] not in (b"//", b"/*"):
            value = before is not None and (before.kind in ("string", "number", "template") or before.kind == "name" and before.text not in _WORDS_BEFORE_VALUE or before.text in (b")", b"]", b"}"))
            if not value and (m := _REGEX.match(data, at)):
                out.append(Token("string", m[0], at, m.end(), breaks))
                at, breaks = m.end(), False
                continue
        m = _TOKEN.match(data, at)
        kind, at = m.lastgroup, m.end()
        if kind in ("space", "comment"):
            breaks |= b"\n" in m[0]
            if kind == "comment":
                comments.append(Token(kind, m[0], m.start(), m.end(), False))
            continue
        out.append(Token(kind, m[0], m.start(), m.end(), breaks))
        breaks = False
        if kind == "mark" and m[0] == b"{":
            braces.append(False)
        elif kind == "mark" and m[0] == b"}" and braces and braces.pop():
            at = piece(m.end(), m.end())
    return out, comments


class Scanner:
    def __init__(self, out: Extraction):
        self.out = out
        self.tokens, self.comments = tokens(out.source.data)
        self.n = len(self.tokens)
        self.pairs: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "mark" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "mark" and t.text in _CLOSE:
                while stack and self.tokens[stack[-1]].text != _CLOSE[t.text]:
                    self.pairs[stack.pop()] = i
                if stack:
                    self.pairs[stack[-1]] = i
                    self.pairs[i] = stack.pop()
        for i in stack:
            self.pairs[i] = self.n - 1

    def is_(self, i: int, text: bytes) -> bool:
        return 0 <= i < self.n and self.tokens[i].text == text and self.tokens[i].kind in ("mark", "name")

    def name(self, i: int) -> str | None:
        return decode(self.tokens[i].text) if 0 <= i < self.n and self.tokens[i].kind == "name" else None

    def text(self, first: int, after: int) -> str:
        return self.out.source.text(self.tokens[first].start, self.tokens[after - 1].end)

    def bytes(self, first: int, after: int) -> bytes:
        return self.out.source.data[self.tokens[first].start : self.tokens[after - 1].end] if after > first else b""

    def opens(self, i: int) -> bool:
        return i < self.n and self.tokens[i].kind == "mark" and self.tokens[i].text in _OPEN

    def closes(self, i: int) -> bool:
        return i < self.n and self.tokens[i].kind == "mark" and self.tokens[i].text in _CLOSE

    def after(self, i: int) -> int:
        return self.pairs.get(i, self.n - 1) + 1

    def angle_end(self, i: int) -> int:
        """Behind the ``>`` of the ``<`` at i; i where there is none."""
        depth, j = 0, i
        while j < self.n:
            t = self.tokens[j]
            if t.kind == "mark" and t.text == b"<":
                depth += 1
            elif t.kind == "mark" and t.text == b">":
                depth -= 1
                if not depth:
                    return j + 1
            elif self.opens(j):
                j = self.after(j)
                continue
            elif self.closes(j) or self.is_(j, b";") or self.is_(j, b"&&") or self.is_(j, b"||"):
                return i
            j += 1
        return i

    # ------------------------------------------------------------ types and expressions

    def type_end(self, i: int) -> int:
        """Behind the type at i."""
        while self.is_(i, b"|") or self.is_(i, b"&"):
            i += 1
        i = self._operand_type(i)
        while i < self.n:
            if self.is_(i, b"|") or self.is_(i, b"&"):
                i = self._operand_type(i + 1)
            elif self.is_(i, b"is") and not self.tokens[i].breaks:
                i = self.type_end(i + 1)
            elif self.is_(i, b"extends"):
                after = self.type_end(i + 1)
                if not self.is_(after, b"?"):
                    return i
                colon = self.type_end(after + 1)
                return self.type_end(colon + 1) if self.is_(colon, b":") else colon
            else:
                break
        return i

    def _operand_type(self, i: int) -> int:
        while i < self.n and self.tokens[i].kind == "name" and self.tokens[i].text in _TYPE_PREFIXES and i + 1 < self.n and (self.tokens[i + 1].kind == "name" or self.opens(i + 1) or self.is_(i + 1, b"<")):
            i += 1
        if i >= self.n:
            return i
        if self.is_(i, b"<"):
            i = max(self.angle_end(i), i + 1)
        if self.is_(i, b"("):
            i = self.after(i)
            if self.is_(i, b"=>"):
                return self.type_end(i + 1)
        elif self.opens(i):
            i = self.after(i)
        elif self.is_(i, b"-"):
            i += 2
        elif self.tokens[i].kind == "template":
            while i < self.n and self.tokens[i].kind == "template":
                i = self.after(i + 1) if self.is_(i + 1, b"{") and self.tokens[i].text.endswith(b"${") else i + 1
        elif self.tokens[i].kind in ("name", "string", "number"):
            i += 1
        else:
            return i
        while i < self.n:
            if self.is_(i, b".") and self.name(i + 1) is not None:
                i += 2
            elif self.is_(i, b"[") and not self.tokens[i].breaks:
                i = self.after(i)
            elif self.is_(i, b"<") and not self.tokens[i].breaks and self.angle_end(i) > i:
                i = self.angle_end(i)
            else:
                break
        return i

    def expression_end(self, i: int) -> int:
        """Behind the expression at i: at a comma, a semicolon, a closing bracket or the end of a line that is complete."""
        start = i
        while i < self.n:
            t = self.tokens[i]
            if self.closes(i) or t.kind == "mark" and t.text in (b";", b","):
                break
            if t.breaks and i > start:
                before = self.tokens[i - 1]
                complete = before.kind != "mark" or before.text in (b")", b"]", b"}", b"++", b"--", b"!")
                if before.kind == "name" and before.text in _WORDS_BEFORE_VALUE:
                    complete = False
                if complete and not (t.kind == "mark" and t.text in _CONTINUES or t.kind == "template"):
                    break
            i = self.after(i) if self.opens(i) else i + 1
        return i

    def statement_end(self, i: int) -> int:
        """Behind the statement at i, with its semicolon."""
        end = i
        while True:
            end = max(self.expression_end(end), end)
            if self.is_(end, b",") or self.closes(end):
                end += 1
                continue
            return end + 1 if self.is_(end, b";") else max(end, i + 1)

    # ------------------------------------------------------------ comments

    def jsdoc(self, start: int) -> str | None:
        """The doc comment that is the last comment before a place with nothing but white space between."""
        last = None
        for c in self.comments:
            if c.end > start:
                break
            last = c
        if last is None or not last.text.startswith(b"/**") or self.out.source.data[last.end : start].strip():
            return None
        return strip_jsdoc(decode(last.text))

    # ------------------------------------------------------------ functions

    def parameters(self, open_: int) -> list[dict]:
        close, i, out = self.pairs.get(open_, self.n - 1), open_ + 1, []
        while i < close:
            while self.is_(i, b"@"):
                i += 2
                while self.is_(i, b".") or self.is_(i, b"("):
                    i = self.after(i) if self.is_(i, b"(") else i + 2
            while self.name(i) and self.tokens[i].text in (b"public", b"private", b"protected", b"readonly", b"override") and (self.name(i + 1) or self.is_(i + 1, b"{")):
                i += 1
            variadic = self.is_(i, b"...")
            i += variadic
            first = i
            i = self.after(i) if self.opens(i) else i + 1
            name = self.text(first, i) if first < close else ""
            i += self.is_(i, b"?")
            note = None
            if self.is_(i, b":"):
                end = self.type_end(i + 1)
                note, i = self.text(i + 1, end) if end > i + 1 else None, max(end, i + 1)
            if first < close and (self.tokens[first].kind == "name" or self.opens(first)):
                out.append(parameter(name, note, variadic=variadic))
            while i < close and not self.is_(i, b","):
                i = self.after(i) if self.opens(i) else i + 1
            i += 1
        return out

    def heading(self, i: int) -> tuple[int, int, int, str | None] | None:
        """Of ``[<T>](parameters)[: type]`` at i: the bracket, behind it, behind the type, and the type."""
        if self.is_(i, b"<"):
            i = self.angle_end(i)
        if not self.is_(i, b"("):
            return None
        after = self.after(i)
        if not self.is_(after, b":"):
            return i, after, after, None
        end = self.type_end(after + 1)
        return i, after, end, self.text(after + 1, end) if end > after + 1 else None

    def arrow_body_end(self, i: int) -> int:
        """Behind the body that follows the ``=>`` at i - 1."""
        return self.after(i) if self.is_(i, b"{") else self.expression_end(i)

    def body_facts(self, first: int, after: int) -> tuple[int, list]:
        """Complexity, and calls as (start, end, target, metadata), outside nested functions."""
        i, count, calls, loops = first, 1, [], set()
        while i < after:
            t = self.tokens[i]
            if t.kind == "mark" and t.text == b"=>":
                i = max(self.arrow_body_end(i + 1), i + 1)
                continue
            member = self.is_(i - 1, b".") or self.is_(i - 1, b"?.")
            if t.kind == "name" and not member:
                if t.text == b"function":
                    j = i + 1 + self.is_(i + 1, b"*")
                    j += self.name(j) is not None
                    head = self.heading(j)
                    if head and self.is_(head[2], b"{"):
                        i = self.after(head[2])
                        continue
                key = self.is_(i + 1, b":") and t.text != b"else"
                if t.text in (b"if", b"for", b"catch", b"do", b"else", b"while", b"case") and not key and i not in loops:
                    count += 1
                    if t.text == b"do":
                        end = self.after(i + 1) if self.is_(i + 1, b"{") else self.expression_end(i + 1) + 1
                        loops.add(end)
            elif t.kind == "mark" and t.text in (b"&&", b"||", b"??"):
                count += 1
            if t.kind == "name" and (member or t.text not in _NOT_CALLED):
                call = self._call(i)
                if call:
                    calls.append(call)
            i += 1
        return count, calls_in_order(calls)

    def _call(self, i: int) -> tuple | None:
        j = i + 1
        if self.is_(j, b"<") and self.angle_end(j) > j and self.is_(self.angle_end(j), b"("):
            j = self.angle_end(j)
        if self.is_(j, b"("):
            last = self.pairs.get(j, self.n - 1)
            head = self.heading(j)
            if head and not self.tokens[min(head[2], self.n - 1)].breaks and (self.is_(head[2], b"{") or self.is_(head[2], b"=>")) and (head[3] is not None or self.is_(last + 1, b"{")):
                return None  # the head of a method, or of a typed arrow function
        elif j < self.n and self.tokens[j].kind == "template" and self.tokens[j].text.startswith(b"`"):
            last = j
            while self.tokens[last].text.endswith(b"${") and self.is_(last + 1, b"{"):
                last = min(self.after(last + 1), self.n - 1)
        else:
            return None
        end, target = self.tokens[last].end, decode(self.tokens[i].text)
        if not (self.is_(i - 1, b".") or self.is_(i - 1, b"?.")):
            return None if self.is_(i - 1, b"new") else (self.tokens[i].start, end, target, {"call_form": "direct"})
        first = self._operand(i - 2)
        if first is None:
            return None
        if self.is_(first - 1, b"new"):
            if not any(self.is_(k, b"(") for k in range(first, i - 1)):
                return None  # the constructor itself
            first -= 1
        return (self.tokens[first].start, end, target, {"call_form": "method", "receiver": self.text(first, i - 1)})

    def _operand(self, i: int) -> int | None:
        """First token of the operand that ends at i."""
        while i >= 0:
            if self.is_(i, b"!"):
                i -= 1
                continue
            t = self.tokens[i]
            if self.closes(i):
                i = self.pairs.get(i, i)
                before = self.tokens[i - 1] if i else None
                if t.text != b"}" and before and (before.kind == "name" and before.text not in (_WORDS_BEFORE_VALUE - {b"await"}) and before.text != b"await" or before.kind == "mark" and before.text in (b")", b"]")):
                    i -= 1
                    continue
                if t.text == b"}":
                    return None
                return i
            if t.kind not in ("name", "string", "number", "template"):
                return None
            if not (self.is_(i - 1, b".") or self.is_(i - 1, b"?.")):
                return i
            i -= 2
        return None


def strip_jsdoc(comment: str) -> str:
    inner = comment.strip().removeprefix("/**").removesuffix("*/")
    return "\n".join(line.strip().lstrip("*").strip() for line in inner.splitlines()).strip()


def extract(path: str, data: bytes, repo: str, scheme: str = "loom") -> Extraction:
    """All rows of one file."""
    out = Extraction("typescript", path, repo, Source(data), scheme)
    s = Scanner(out)
    first = s.comments[0] if s.comments and (not s.tokens or s.comments[0].start < s.tokens[0].start) else None
    doc = strip_jsdoc(decode(first.text)) if first and first.text.startswith(b"/**") else None
    reader = _Program(s, out.module_symbol(out.module.replace("/", "."), doc))
    i = 0
    while i < s.n:
        i = max(reader.statement(i), i + 1)
    out.first_wins()
    return out


class _Program:
    def __init__(self, s: Scanner, module: dict):
        self.s, self.out, self.module = s, s.out, module
        self.seen = {module["id"]}

    def add(self, kind: str, name: str, start: int, after: int, hashed: bytes, exported: bool, **more) -> dict | None:
        """The symbol of tokens [start, after), or None where its moniker is taken."""
        t = self.s.tokens
        if self.out.moniker(kind, name) in self.seen:
            return None
        row = self.out.symbol(kind, name, f"{self.module['qualified_name']}.{name}", t[start].start, t[after - 1].end, hashed, "public", exported, **more)
        self.seen.add(row["id"])
        self.out.relate(self.module["id"], "contains", row["id"])
        return row

    def statement(self, i: int) -> int:
        s, start = self.s, i
        if s.is_(i, b"import") and not s.is_(i + 1, b"(") and not s.is_(i + 1, b"."):
            return self.imports(i)
        begin = i
        while s.is_(i, b"@"):
            i += 2
            while s.is_(i, b".") or s.is_(i, b"("):
                i = s.after(i) if s.is_(i, b"(") else i + 2
        exported = s.is_(i, b"export")
        if exported:
            after = self.reexport(i)
            if after:
                return after
            i += 1 + s.is_(i + 1, b"default")
            while s.is_(i, b"@"):
                i += 2
                while s.is_(i, b".") or s.is_(i, b"("):
                    i = s.after(i) if s.is_(i, b"(") else i + 2
            start = i
        doc = s.jsdoc(s.tokens[begin].start)
        if (s.is_(i, b"declare") or s.is_(i, b"namespace") or s.is_(i, b"module")) and s.tokens[i + 1 : i + 2] and not s.tokens[i + 1].breaks and s.tokens[i + 1].kind in ("name", "string"):
            return self.skip(i + 1)
        abstract = s.is_(i, b"abstract") and s.is_(i + 1, b"class")
        if abstract or s.is_(i, b"class"):
            return self.klass(start, i + abstract, abstract, exported, doc)
        if s.is_(i, b"interface") and s.name(i + 1):
            return self.interface(i, exported, doc)
        if s.is_(i, b"enum") or s.is_(i, b"const") and s.is_(i + 1, b"enum"):
            return self.enum(i, exported, doc)
        if s.is_(i, b"type") and s.name(i + 1) and not s.tokens[i + 1].breaks:
            return self.alias(i, exported)
        is_async = s.is_(i, b"async") and s.is_(i + 1, b"function")
        if is_async or s.is_(i, b"function"):
            return self.function(i, i + is_async, is_async, exported, doc)
        if s.is_(i, b"const") or s.is_(i, b"let") and s.name(i + 1) or s.is_(i, b"let") and s.opens(i + 1):
            return self.values(i, exported, doc)
        return s.statement_end(i) if not s.opens(i) else s.after(i)

    def skip(self, i: int) -> int:
        """Behind a declaration that yields nothing: its block, or its statement."""
        s = self.s
        while i < s.n and not s.is_(i, b";"):
            if s.is_(i, b"{"):
                return s.after(i)
            if s.tokens[i].breaks and i and not s.is_(i - 1, b","):
                break
            i = s.after(i) if s.opens(i) else i + 1
        return i + s.is_(i, b";")

    def origin(self, i: int) -> tuple[int, str] | None:
        s = self.s
        while i < s.n and not s.is_(i, b";"):
            if s.tokens[i].kind == "string":
                return i, decode(s.tokens[i].text).strip("\"'")
            if s.is_(i, b"="):
                return None
            i = s.after(i) if s.opens(i) else i + 1
        return None

    def names(self, open_: int) -> list[tuple[int, int, str, str | None]]:
        """[first, after), name and alias of what stands in an import or export clause."""
        s, out, i = self.s, [], open_ + 1
        close = s.pairs.get(open_, s.n - 1)
        while i < close:
            end = i
            while end < close and not s.is_(end, b","):
                end += 1
            first = i + (s.is_(i, b"type") and end - i in (2, 4))
            if first < end and s.name(first):
                out.append((i, end, s.name(first), s.name(first + 2) if s.is_(first + 1, b"as") else None))
            i = end + 1
        return out

    def imports(self, i: int) -> int:
        s, t = self.s, self.s.tokens
        found = self.origin(i + 1)
        if not found:
            return s.statement_end(i)
        at, source = found
        j = i + 1 + (s.is_(i + 1, b"type") and not s.is_(i + 2, b"from"))
        while j < at:
            if s.is_(j, b"{"):
                for a, b, name, alias in self.names(j):
                    self.out.relate(self.module["id"], "imports", target_name=name, span=(t[a].start, t[b - 1].end), import_source=source, alias=alias, import_form="named")
                j = s.after(j)
            elif s.is_(j, b"*"):
                self.out.relate(self.module["id"], "imports", target_name="*", span=(t[j].start, t[min(j + 2, at)].end), import_source=source, alias=s.name(j + 2), import_form="namespace")
                j += 3
            elif s.name(j) and not s.is_(j, b"from"):
                self.out.relate(self.module["id"], "imports", target_name=s.name(j), span=(t[j].start, t[j].end), import_source=source, alias=None, import_form="default")
                j += 1
            else:
                j += 1
        return at + 1 + s.is_(at + 1, b";")

    def reexport(self, i: int) -> int | None:
        """Behind a re-export or an export of names; None for anything else."""
        s, t = self.s, self.s.tokens
        j = i + 1 + (s.is_(i + 1, b"type") and (s.is_(i + 2, b"{") or s.is_(i + 2, b"*")))
        if s.is_(j, b"{"):
            after = s.after(j)
            if not s.is_(after, b"from"):
                return after + s.is_(after, b";")
            source = decode(t[after + 1].text).strip("\"'")
            for a, b, name, _ in self.names(j):
                self.out.relate(self.module["id"], "imports", target_name=name, span=(t[a].start, t[b - 1].end), import_source=source, alias=None, re_export=True)
            return after + 2 + s.is_(after + 2, b";")
        if s.is_(j, b"*"):
            alias = s.name(j + 2) if s.is_(j + 1, b"as") else None
            found = self.origin(j)
            if not found:
                return s.statement_end(i)
            end = found[0] + 1 + s.is_(found[0] + 1, b";")
            self.out.relate(self.module["id"], "imports", target_name="*", span=(t[i].start, t[end - 1].end), import_source=found[1], alias=alias, re_export=True)
            return end
        return None

    def heritage(self, i: int, generic: bool) -> tuple[list[str], int]:
        """Plain names (and generic types where those count) that commas separate from i on, and where they end."""
        s, out = self.s, []
        while i < s.n:
            first = i
            if s.name(i) is None:
                return out, i
            i += 1
            simple = True
            while s.is_(i, b".") or s.is_(i, b"("):
                simple = False
                i = s.after(i) if s.is_(i, b"(") else i + 2
            plain_end = i
            if s.is_(i, b"<"):
                i = max(s.angle_end(i), i + 1)
            if simple:
                out.append(s.text(first, i if generic else plain_end))
            if not s.is_(i, b","):
                return out, i
            i += 1
        return out, i

    def klass(self, start: int, i: int, abstract: bool, exported: bool, doc: str | None) -> int:
        s = self.s
        j = i + 1
        name = s.name(j) if not (s.is_(j, b"extends") or s.is_(j, b"implements")) else None
        j += name is not None
        if s.is_(j, b"<"):
            j = max(s.angle_end(j), j + 1)
        bases: list[str] = []
        interfaces: list[str] = []
        if s.is_(j, b"extends"):
            bases, j = self.heritage(j + 1, False)
        if s.is_(j, b"implements"):
            interfaces, j = self.heritage(j + 1, True)
        while j < s.n and not s.is_(j, b"{"):
            j += 1
        if j >= s.n:
            return s.n
        after = s.after(j)
        if name is None:
            return after
        row = self.add("class", name, start, after, s.bytes(j, after), exported, base_classes=bases, docstring=doc, decorators=[], is_abstract=abstract)
        if row:
            for kind, names in (("extends", bases), ("implements", interfaces)):
                for target in names:
                    self.out.relate(row["id"], kind, target_name=target, import_source=None)
            self.members(j, row)
        return after

    def interface(self, i: int, exported: bool, doc: str | None) -> int:
        s, name, j = self.s, self.s.name(i + 1), i + 2
        if s.is_(j, b"<"):
            j = max(s.angle_end(j), j + 1)
        bases: list[str] = []
        if s.is_(j, b"extends"):
            bases, j = self.heritage(j + 1, True)
        while j < s.n and not s.is_(j, b"{"):
            j += 1
        if j >= s.n:
            return s.n
        after = s.after(j)
        row = self.add("class", name, i, after, s.bytes(j, after), exported, base_classes=bases, docstring=doc, decorators=[], is_abstract=True)
        if row:
            for target in bases:
                self.out.relate(row["id"], "extends", target_name=target, import_source=None)
            self.members(j, row)
        return after

    def enum(self, i: int, exported: bool, doc: str | None) -> int:
        s = self.s
        j = i + s.is_(i, b"const") + 1
        if s.name(j) is None or not s.is_(j + 1, b"{"):
            return i + 1
        after = s.after(j + 1)
        self.add("class", s.name(j), i, after, s.bytes(j + 1, after), exported, base_classes=[], docstring=doc, decorators=[], is_abstract=False)
        return after

    def alias(self, i: int, exported: bool) -> int:
        s, j = self.s, i + 2
        if s.is_(j, b"<"):
            j = max(s.angle_end(j), j + 1)
        if not s.is_(j, b"="):
            return s.statement_end(i)
        end = max(s.type_end(j + 1), j + 1)
        end += s.is_(end, b";")
        self.add("variable", s.name(i + 1), i, end, s.bytes(i, end), exported, type_annotation=s.text(i, end).strip(), is_constant=True)
        return end

    def function(self, start: int, i: int, is_async: bool, exported: bool, doc: str | None) -> int:
        s = self.s
        generator = s.is_(i + 1, b"*")
        j = i + 1 + generator
        name = s.name(j)
        head = s.heading(j + (name is not None))
        if head is None:
            return i + 1
        if not s.is_(head[2], b"{"):
            return head[2] + s.is_(head[2], b";")
        after = s.after(head[2])
        if name is not None and not generator:
            self.callable(name, start, after, head, (head[2], after), is_async, exported, doc, True)
        return after

    def callable(self, name: str, start: int, after: int, head: tuple, body: tuple[int, int], is_async: bool, exported: bool, doc: str | None, block: bool) -> None:
        s, t = self.s, self.s.tokens
        complexity, calls = s.body_facts(*body)
        signature = self.out.source.text(t[start].start, t[body[0]].start).strip()
        row = self.add("function", name, start, after, s.bytes(*body), exported, signature=signature, parameters=s.parameters(head[0]), return_type=head[3], docstring=doc, decorators=[], is_async=is_async, complexity=complexity)
        for a, b, target, form in calls if row and block else []:
            self.out.relate(row["id"], "calls", target_name=target, span=(a, b), **form)

    def values(self, i: int, exported: bool, doc: str | None) -> int:
        s, constant, j = self.s, self.s.is_(i, b"const"), i + 1
        while j < s.n:
            first, name = j, s.name(j)
            j = s.after(j) if s.opens(j) else j + 1
            j += s.is_(j, b"!")
            note = None
            if s.is_(j, b":"):
                end = max(s.type_end(j + 1), j + 1)
                note, j = s.text(j + 1, end), end
            value = j + 1 if s.is_(j, b"=") else None
            if value is not None:
                j = self.value(name, value, exported, doc) or -s.expression_end(value)
            if not (value is not None and j > 0) and name and note:
                end = max(abs(j), first + 1)
                self.add("variable", name, first, end, s.bytes(first, end), exported, type_annotation=note, is_constant=constant)
            j = max(abs(j), first + 1)
            if not s.is_(j, b","):
                break
            j += 1
        return j + s.is_(j, b";")

    def value(self, name: str | None, i: int, exported: bool, doc: str | None) -> int | None:
        """Behind a value that is a function, which is a symbol if it has a name and a return type; None for others."""
        s, start = self.s, i
        is_async = s.is_(i, b"async") and not s.is_(i + 1, b"=>")
        i += is_async
        if s.is_(i, b"function"):
            j = i + 1 + s.is_(i + 1, b"*")
            head = s.heading(j + (s.name(j) is not None))
            if head is None or not s.is_(head[2], b"{"):
                return None
            after, body, block = s.after(head[2]), (head[2], s.after(head[2])), True
        elif s.name(i) and s.is_(i + 1, b"=>"):
            return max(s.arrow_body_end(i + 2), i + 2)
        else:
            head = s.heading(i)
            if head is None or not s.is_(head[2], b"=>"):
                return None
            first = head[2] + 1
            after, block = max(s.arrow_body_end(first), first + 1), s.is_(first, b"{")
            body = (first, after)
        if s.expression_end(after) != after and not s.is_(after, b",") and not s.is_(after, b";") and after < s.n and not s.tokens[after].breaks:
            return None  # part of a longer expression
        if name and head[3]:
            self.callable(name, start, after, head, body, is_async, exported, doc, block)
        return after

    def members(self, open_: int, owner: dict) -> None:
        s, t = self.s, self.s.tokens
        close, i = s.pairs.get(open_, s.n - 1), open_ + 1
        while i < close:
            if s.is_(i, b";") or s.is_(i, b","):
                i += 1
                continue
            doc_at, decorators = t[i].start, []
            while s.is_(i, b"@"):
                first = i
                i += 2
                while s.is_(i, b".") or s.is_(i, b"("):
                    i = s.after(i) if s.is_(i, b"(") else i + 2
                decorators.append(s.text(first, i))
            doc = s.jsdoc(doc_at) or (s.jsdoc(t[i].start) if i < close else None)
            first, words = i, []
            while i < close and t[i].kind == "name" and t[i].text in _MODIFIERS and not (s.is_(i + 1, b"(") or s.is_(i + 1, b"<") or s.is_(i + 1, b":") or s.is_(i + 1, b"=") or s.is_(i + 1, b"?") or s.is_(i + 1, b";")):
                words.append(t[i].text)
                i += 1
            i += s.is_(i, b"*")
            name = s.name(i)
            j = i + 1 + (s.is_(i + 1, b"?") or s.is_(i + 1, b"!"))
            head = s.heading(j) if name and (s.is_(j, b"(") or s.is_(j, b"<")) else None
            if head is None or name.startswith("#") or name == "new":
                i = self.member_end(i, close)
                continue
            body = head[2] if s.is_(head[2], b"{") else None
            after = s.after(body) if body is not None else head[2]
            self.method(name, first, after, head, body, words, decorators, doc, owner)
            i = after

    def member_end(self, i: int, close: int) -> int:
        """Behind a member that is no method."""
        s = self.s
        j = s.after(i) if s.opens(i) else i + 1
        j += s.is_(j, b"?") or s.is_(j, b"!")
        if s.is_(j, b"(") or s.is_(j, b"<"):
            head = s.heading(j)
            if head:
                return s.after(head[2]) if s.is_(head[2], b"{") else max(head[2], i + 1)
        if s.is_(j, b":"):
            j = max(s.type_end(j + 1), j + 1)
        if s.is_(j, b"="):
            j = max(s.expression_end(j + 1), j + 1)
        elif s.is_(j, b"{"):
            j = s.after(j)
        return min(max(j, i + 1), close)

    def method(self, name: str, first: int, after: int, head: tuple, body: int | None, words: list[bytes], decorators: list[str], doc: str | None, owner: dict) -> None:
        s, t = self.s, self.s.tokens
        begin, end = t[first].start, t[after - 1].end
        stop = t[body].start if body is not None else end
        complexity, calls = s.body_facts(body, after) if body is not None else (None, [])
        visibility = next((_ACCESS[w] for w in words if w in _ACCESS), "public")
        if self.out.moniker("method", name, owner["name"]) in self.seen:
            return
        row = self.out.symbol(
            "method", name, f"{self.module['qualified_name']}.{owner['name']}.{name}", begin, end, s.bytes(body, after) if body is not None else b"", visibility, owner["is_exported"], owner["name"],
            signature=self.out.source.text(begin, stop).strip(), parameters=s.parameters(head[0]), return_type=head[3], docstring=doc, decorators=decorators, is_async=b"async" in words, complexity=complexity,
            enclosing_class_id=owner["id"], is_static=b"static" in words, is_constructor=name == "constructor",
        )
        self.seen.add(row["id"])
        self.out.relate(owner["id"], "contains", row["id"])
        for a, b, target, form in calls:
            self.out.relate(row["id"], "calls", target_name=target, span=(a, b), **form)
