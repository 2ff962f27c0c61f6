"""Symbols and relationships of Go files, from a scanner over the bytes.

Tokens are cut with one expression, statements end as the language inserts semicolons, and only what symbols need is
parsed: package, imports, functions, methods, types, constants and variables at the top level, and the branches and calls
inside bodies. What does not fit is skipped, never guessed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from codeloom.extract.model import Extraction, Source, calls_in_order, parameter
from codeloom.extract.model import text as decode

_TOKEN = re.compile(
    rb"""(?P<space>[ \t\r\f\v]+)|(?P<newline>\n)|(?P<comment>//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z))|(?P<string>`[^`]*(?:`|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
    |(?P<number>\.?[0-9](?:[eEpP][+-]|[\w.])*)|(?P<name>[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<mark><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|<<|>>|&\^|[-+*/%&|^]=|.)""",
    re.X | re.S,
)
_IGNORED = re.compile(rb"^//go:build\s+ignore\b", re.M)
_KEYWORDS = frozenset(b"break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset(b") ] } ++ --".split())
_ENDING_WORDS = frozenset(b"break continue fallthrough return".split())
_OPEN, _CLOSE = {b"(": b")", b"[": b"]", b"{": b"}"}, {b")": b"(", b"]": b"[", b"}": b"{"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: bytes
    start: int
    end: int


def tokens(data: bytes) -> tuple[list[Token], list[Token]]:
    """Tokens with inserted semicolons, and the comments."""
    out, comments = [], []
    for m in _TOKEN.finditer(data):
        kind = m.lastgroup
        if kind == "space":
            continue
        if kind == "comment":
            comments.append(Token(kind, m[0], m.start(), m.end()))
        if kind == "newline" or kind == "comment" and b"\n" in m[0]:
            last = out[-1] if out else None
            if last and (last.kind in ("string", "number") or last.kind == "name" and (last.text not in _KEYWORDS or last.text in _ENDING_WORDS) or last.text in _ENDS):
                out.append(Token("end", b";", m.start(), m.start()))
        elif kind != "comment":
            out.append(Token("end" if m[0] == b";" else kind, m[0], m.start(), m.end()))
    out.append(Token("end", b";", len(data), len(data)))
    return out, comments


class Scanner:
    def __init__(self, out: Extraction):
        self.out = out
        self.tokens, self.comments = tokens(out.source.data)
        self.n = len(self.tokens)
        self.pairs: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE:
                while stack and self.tokens[stack[-1]].text != _CLOSE[t.text]:
                    self.pairs[stack.pop()] = i
                if stack:
                    self.pairs[stack[-1]] = i
                    self.pairs[i] = stack.pop()
        for i in stack:
            self.pairs[i] = self.n - 1

    def is_(self, i: int, mark: bytes) -> bool:
        return i < self.n and self.tokens[i].text == mark and self.tokens[i].kind != "string"

    def name(self, i: int) -> str | None:
        t = self.tokens[i] if i < self.n else None
        return decode(t.text) if t and t.kind == "name" and t.text not in _KEYWORDS else None

    def text(self, first: int, after: int) -> str:
        return self.out.source.text(self.tokens[first].start, self.tokens[after - 1].end)

    def after(self, i: int) -> int:
        """Behind the bracket that closes the one at i."""
        return self.pairs.get(i, self.n - 2) + 1

    def statement_end(self, i: int) -> int:
        """The semicolon, or the closing bracket, that ends the statement at i."""
        while i < self.n and self.tokens[i].kind != "end" and not (self.tokens[i].kind == "mark" and self.tokens[i].text in _CLOSE):
            i = self.after(i) if self.tokens[i].kind == "mark" and self.tokens[i].text in _OPEN else i + 1
        return i

    def type_end(self, i: int) -> int:
        """Behind the type at i; i itself where there is none."""
        if self.is_(i, b"*") or self.is_(i, b"..."):
            return self.type_end(i + 1)
        if self.is_(i, b"["):
            return self.type_end(self.after(i))
        if self.is_(i, b"("):
            return self.after(i)
        if self.is_(i, b"<-"):
            return self.type_end(i + 1)
        word = self.tokens[i].text if i < self.n and self.tokens[i].kind == "name" else b""
        if word == b"map" and self.is_(i + 1, b"["):
            return self.type_end(self.after(i + 1))
        if word == b"chan":
            return self.type_end(i + 2 if self.is_(i + 1, b"<-") else i + 1)
        if word == b"func" and self.is_(i + 1, b"("):
            return self.type_end(self.after(i + 1))
        if word in (b"struct", b"interface") and self.is_(i + 1, b"{"):
            return self.after(i + 1)
        if self.name(i) is None:
            return i
        i += 1
        while self.is_(i, b".") and self.name(i + 1) is not None:
            i += 2
        if self.is_(i, b"[") and self.tokens[i].start == self.tokens[i - 1].end:
            i = self.after(i)
        return i

    def parts(self, open_: int) -> list[tuple[int, int]]:
        """What commas separate inside a bracket, as [first, after)."""
        close, out, i = self.pairs.get(open_, self.n - 1), [], open_ + 1
        first = i
        while i < close:
            if self.is_(i, b","):
                out.append((first, i))
                first = i + 1
            i = self.after(i) if self.tokens[i].kind == "mark" and self.tokens[i].text in _OPEN else i + 1
        out.append((first, close))
        return [(a, b) for a, b in out if a < b and not all(t.kind == "end" for t in self.tokens[a:b])]

    def _named(self, a: int, b: int) -> bool:
        """Whether an entry of a parameter list is a name and a type."""
        return b - a > 1 and self.name(a) is not None and not self.is_(a + 1, b".") and (self.type_end(a) != b or self.is_(a + 1, b"[") and self.is_(a + 2, b"]"))

    def parameters(self, open_: int) -> list[dict]:
        entries = self.parts(open_)
        if not any(self._named(a, b) for a, b in entries):
            return [parameter("", self.text(a + self.is_(a, b"..."), b), variadic=self.is_(a, b"...")) for a, b in entries]
        out, later = [], (None, False)
        for a, b in reversed(entries):
            if b - a > 1:
                variadic = self.is_(a + 1, b"...")
                later = (self.text(a + 1 + variadic, b), variadic)
            out.append(parameter(self.name(a) or "", later[0], variadic=later[1]))
        return out[::-1]

    def doc(self, start: int) -> str | None:
        """The comment lines right above a declaration."""
        at, lines = start, []
        for c in reversed([c for c in self.comments if c.end <= start]):
            gap = self.out.source.data[c.end : at]
            if gap.strip() or gap.count(b"\n") > 1:
                break
            at = c.start
            line = decode(c.text)
            if line.startswith("//") and not line.startswith("//go:"):
                lines.insert(0, (line[3:] if line.startswith("// ") else line[2:]).rstrip())
        lines = [line for line in lines if line.strip()]
        return "\n".join(lines) or None

    # ------------------------------------------------------------ bodies

    def literal_end(self, i: int) -> int:
        """Behind the function literal or type whose ``func`` is at i."""
        after = self.after(i + 1) if self.is_(i + 1, b"(") else i + 1
        result = self.type_end(after) if not self.is_(after, b"{") else after
        return self.after(result) if self.is_(result, b"{") else result

    def body_facts(self, open_: int) -> tuple[int, list]:
        """Complexity, and calls as (start, end, target, metadata), outside function literals."""
        close, i, count, calls, selects = self.pairs.get(open_, self.n - 1), open_ + 1, 1, [], []
        while i < close:
            t = self.tokens[i]
            if t.text == b"func" and t.kind == "name":
                i = self.literal_end(i)
                continue
            while selects and i > selects[-1][1]:
                selects.pop()
            if t.kind == "name":
                if t.text in (b"if", b"for", b"switch", b"select"):
                    count += 1
                    if t.text == b"select" and self.is_(i + 1, b"{"):
                        selects.append((i + 1, self.pairs.get(i + 1, close)))
                elif t.text == b"case" and selects and self._directly_in(i, selects[-1][0]):
                    count += 1
                elif t.text not in _KEYWORDS and self.is_(i + 1, b"("):
                    calls.append(self._call(i))
            elif t.kind == "mark" and t.text in (b"&&", b"||"):
                count += 1
            i += 1
        return count, calls_in_order([c for c in calls if c])

    def _directly_in(self, i: int, open_: int) -> bool:
        j = i - 1
        while j > open_:
            t = self.tokens[j]
            if t.kind == "mark" and t.text in _OPEN:
                return False
            j = self.pairs.get(j, j) - 1 if t.kind == "mark" and t.text in _CLOSE else j - 1
        return True

    def _call(self, i: int) -> tuple | None:
        end = self.tokens[self.pairs.get(i + 1, self.n - 1)].end
        target = decode(self.tokens[i].text)
        if not self.is_(i - 1, b"."):
            return (self.tokens[i].start, end, target, {"call_form": "direct"})
        first = self._operand(i - 2)
        if first is None:
            return None
        return (self.tokens[first].start, end, target, {"call_form": "method", "receiver": self.text(first, i - 1)})

    def _operand(self, i: int) -> int | None:
        """First token of the operand that ends at i."""
        while True:
            t = self.tokens[i]
            if t.kind == "mark" and t.text in _CLOSE:
                i = self.pairs.get(i, i)
                before = self.tokens[i - 1]
                if before.kind == "mark" and before.text in (b")", b"]", b"}") or before.kind == "name" and before.text not in _KEYWORDS:
                    if t.text != b"}" or before.kind == "name" or before.text == b"]":
                        i -= 1
                        continue
                if before.kind == "name" and before.text == b"func":
                    return i - 1
                return i if t.text == b")" else None
            if t.kind not in ("name", "string", "number"):
                return None
            if not self.is_(i - 1, b"."):
                return i
            i -= 2

    # ------------------------------------------------------------ declarations

    def specs(self, i: int) -> tuple[list[tuple[int, int]], int]:
        """[first, after) of the specs of a declaration whose keyword is at i - 1, and where to go on."""
        if not self.is_(i, b"("):
            end = self.statement_end(i)
            return [(i, end)], end
        return self.specs_inside(i), self.after(i)

    def specs_inside(self, open_: int) -> list[tuple[int, int]]:
        """[first, after) of the statements inside a bracket."""
        close, out, at = self.pairs.get(open_, self.n - 1), [], open_ + 1
        while at < close:
            end = self.statement_end(at)
            if end > at:
                out.append((at, end))
            at = end + 1
        return out


def visibility(name: str) -> tuple[str, bool]:
    return ("public", True) if name[:1].isupper() else ("internal", False)


def extract(path: str, data: bytes, repo: str, scheme: str = "loom") -> Extraction:
    """All rows of one file; a file that is excluded from builds has none."""
    out = Extraction("go", path, repo, Source(data), scheme)
    if _IGNORED.search(data):
        return out
    s = Scanner(out)
    t = s.tokens
    package = next((s.name(i + 1) for i in range(s.n - 1) if t[i].text == b"package" and t[i].kind == "name"), None) or out.stem
    module = out.module_symbol(package, None, moniker_name=path.removesuffix(".go"))
    types: dict[str, str] = {}
    top: list[str] = []
    for start in _declarations(s, b"type"):
        for a, b in s.specs(start + 1)[0]:
            kind = _type_start(s, a, b)
            if kind < b and t[kind].text in (b"struct", b"interface"):
                types[s.name(a)] = out.moniker("class", s.name(a))

    i = 0
    while i < s.n:
        word = t[i].text if t[i].kind == "name" else b""
        if word == b"import":
            specs, i = s.specs(i + 1)
            for a, b in specs:
                _import(s, module["id"], a, b)
        elif word == b"func":
            i = _function(s, i, package, types, top)
        elif word == b"type":
            doc, (specs, i) = s.doc(t[i].start), s.specs(i + 1)
            for a, b in specs:
                _type(s, a, b, package, doc, top)
        elif word in (b"const", b"var"):
            specs, i = s.specs(i + 1)
            for a, b in specs:
                _values(s, a, b, package, word == b"const", top)
        elif t[i].kind == "mark" and t[i].text in _OPEN:
            i = s.after(i)
        else:
            i += 1
    for symbol_id in top:
        out.relate(module["id"], "contains", symbol_id)
    return out


def _declarations(s: Scanner, keyword: bytes) -> list[int]:
    found, i = [], 0
    while i < s.n:
        if s.tokens[i].kind == "name" and s.tokens[i].text == keyword:
            found.append(i)
        i = s.after(i) if s.tokens[i].kind == "mark" and s.tokens[i].text in _OPEN and not (i and s.tokens[i - 1].text == keyword) else i + 1
    return found


def _type_start(s: Scanner, a: int, b: int) -> int:
    """Where the type of a type spec starts, behind name, type parameters and ``=``."""
    i = a + 1
    if s.is_(i, b"[") and s.name(i + 1) is not None and not s.is_(i + 2, b"]"):
        i = s.after(i)
    return i + 1 if s.is_(i, b"=") else i


def _import(s: Scanner, module_id: str, a: int, b: int) -> None:
    at = next((i for i in range(a, b) if s.tokens[i].kind == "string" and s.tokens[i].text[:1] == b'"'), None)
    if at is None:
        return
    origin = decode(s.tokens[at].text).strip('"')
    alias = decode(s.tokens[a].text) if at > a else None
    if alias in ("_", "."):
        return
    s.out.relate(module_id, "imports", target_name=alias or origin.rsplit("/", 1)[-1], span=(s.tokens[at].start, s.tokens[at].end), import_source=origin, alias=alias)


def _function(s: Scanner, i: int, package: str, types: dict[str, str], top: list[str]) -> int:
    out, t, start = s.out, s.tokens, i
    i += 1
    receiver = None
    if s.is_(i, b"("):
        receiver, i = i, s.after(i)
    name = s.name(i)
    if name is None:
        return max(i, start + 1)
    i += 1
    if s.is_(i, b"["):
        i = s.after(i)
    if not s.is_(i, b"("):
        return i
    params, i = s.parameters(i), s.after(i)
    result_end = s.type_end(i) if not s.is_(i, b"{") else i
    returns = s.text(i, result_end) if result_end > i else None
    body = result_end if s.is_(result_end, b"{") else None
    after = s.after(body) if body is not None else result_end
    begin, end = t[start].start, t[after - 1].end
    signature = out.source.data[begin : t[body].start if body is not None else end]
    complexity, calls = s.body_facts(body) if body is not None else (None, [])
    seen, exported = visibility(name)
    hashed = out.source.data[t[body].start : end] if body is not None else b""
    own = {"signature": decode(signature).strip(), "parameters": params, "return_type": returns, "docstring": s.doc(begin), "decorators": [], "is_async": False, "complexity": complexity}
    if receiver is None:
        unique = f"init@{out.source.location(begin, begin)['line_start']}" if name == "init" else name
        row = out.symbol("function", name, f"{package}.{unique}", begin, end, hashed, seen, exported, moniker_name=unique, **own)
        top.append(row["id"])
    else:
        entries = s.parts(receiver)
        if not entries:
            return after
        a, b = entries[0]
        base = a + 1 if b - a > 1 and s.name(a) is not None and not s.is_(a + 1, b".") and not s.is_(a + 1, b"[") else a
        pointer = s.is_(base, b"*")
        owner = s.name(base + pointer)
        if owner is None or s.is_(base + pointer + 1, b"."):
            return after
        row = out.symbol("method", name, f"{package}.{owner}.{name}", begin, end, hashed, seen, exported, owner, enclosing_class_id=types.get(owner), is_static=False, is_constructor=False, receiver_kind="pointer" if pointer else "value", **own)
    for a, b, target, form in calls:
        out.relate(row["id"], "calls", target_name=target, span=(a, b), **form)
    if row.get("enclosing_class_id"):
        out.relate(row["enclosing_class_id"], "contains", row["id"])
    return after


def _type(s: Scanner, a: int, b: int, package: str, doc: str | None, top: list[str]) -> None:
    out, t, name = s.out, s.tokens, s.name(a)
    kind = _type_start(s, a, b)
    if name is None or kind >= b:
        return
    begin, end = t[a].start, t[b - 1].end
    seen, exported = visibility(name)
    whole, qualified = out.source.data[begin:end], f"{package}.{name}"
    word = t[kind].text
    if word not in (b"struct", b"interface") or not s.is_(kind + 1, b"{"):
        row = out.symbol("variable", name, qualified, begin, end, whole, seen, exported, type_annotation=s.text(kind, b), is_constant=True)
        top.append(row["id"])
        return
    fields = s.specs_inside(kind + 1)
    abstract = word == b"interface"
    bases = [n for x, y in fields if (n := _embedded(s, x, y, abstract))]
    row = out.symbol("class", name, qualified, begin, end, whole, seen, exported, base_classes=bases, docstring=doc, decorators=[], is_abstract=abstract)
    top.append(row["id"])
    for x, y in fields:
        base = _embedded(s, x, y, abstract)
        if base:
            out.relate(row["id"], "extends", target_name=base, embedding_kind="interface" if abstract else "struct")
        elif abstract and s.name(x) and s.is_(x + 1, b"("):
            _interface_method(s, x, y, package, row)


def _embedded(s: Scanner, a: int, b: int, interface: bool) -> str | None:
    """Name of an embedded type of the package itself; a struct's may have a star and a tag."""
    if not interface:
        a += s.is_(a, b"*")
        b -= s.tokens[b - 1].kind == "string" and b - a > 1
    return s.name(a) if b - a == 1 else None


def _interface_method(s: Scanner, a: int, b: int, package: str, owner: dict) -> None:
    out, t, name = s.out, s.tokens, s.name(a)
    after = s.after(a + 1)
    begin, end = t[a].start, t[b - 1].end
    whole = out.source.data[begin:end]
    seen, exported = visibility(name)
    row = out.symbol(
        "method", name, f"{package}.{owner['name']}.{name}", begin, end, whole, seen, exported, owner["name"], signature=decode(whole).strip(), parameters=s.parameters(a + 1), return_type=s.text(after, b) if after < b else None,
        docstring=None, decorators=[], is_async=False, complexity=None, enclosing_class_id=owner["id"], is_static=False, is_constructor=False,
    )
    out.relate(owner["id"], "contains", row["id"])


def _values(s: Scanner, a: int, b: int, package: str, constant: bool, top: list[str]) -> None:
    out, t, names, i = s.out, s.tokens, [], a
    while i < b and s.name(i) is not None:
        names.append(s.name(i))
        i += 1
        if not s.is_(i, b","):
            break
        i += 1
    after = s.type_end(i) if i < b and not s.is_(i, b"=") else i
    note = s.text(i, after) if after > i else None if constant else "<inferred>"
    begin, end = t[a].start, t[b - 1].end
    for name in names:
        seen, exported = visibility(name)
        row = out.symbol("variable", name, f"{package}.{name}", begin, end, out.source.data[begin:end], seen, exported, type_annotation=note, is_constant=constant)
        top.append(row["id"])
