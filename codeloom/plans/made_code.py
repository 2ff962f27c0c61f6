"""Code made from the customer table, and what its extraction must give, as SQL.

Each template has a customer's key at @K and a name at @S. Where a symbol lies is told by its text: the SQL looks for that
text in the made file, so its places and hashes come from the file and not from an extractor.
"""

from __future__ import annotations

PYTHON = '''"""Module @K."""
from base import Root as R
LIMIT: int = @K

class @SBase(R):
    def run(self, n: int = 1) -> int:
        """Run it."""
        if n and n > @K:
            return self.walk(n)
        return helper(n)

def helper(n):
    return R.of(n)
'''
GO = """package made@K

import "fmt"

// @SBase is made.
type @SBase struct {
	Root
}

func (b *@SBase) Run(n, m int) error {
	if n > 1 && m > 2 {
		return fmt.Errorf("x")
	}
	return nil
}
"""
TYPESCRIPT = """import { Root } from './root';
/** Made. */
export class @SBase extends Root {
  async run(n: number): Promise<void> { if (n) { this.walk(n); } }
}
export const LIMIT: number = @K;
"""
TEMPLATES = {"python": (PYTHON, ".py"), "go": (GO, ".go"), "typescript": (TYPESCRIPT, ".ts")}


def _part(text: str, first: str, last: str) -> str:
    """The part of a template from one phrase to the end of another."""
    start = text.index(first)
    return text[start : text.index(last, start) + len(last)]


#: tail of the moniker, kind, qualified name, text of the symbol (none: the file), text that is hashed, signature, complexity.
_SYMBOLS = {
    "python": [
        ("src/f@K/", "module", "src.f@K", None, None, None, None),
        ("@SBase#", "class", "src.f@K.@SBase", _part(PYTHON, "class @S", "helper(n)"), _part(PYTHON, "def run", "helper(n)"), None, None),
        ("@SBase#run().", "method", "src.f@K.@SBase.run", _part(PYTHON, "def run", "helper(n)"), _part(PYTHON, '"""Run it', "helper(n)"), "def run(self, n: int = 1) -> int", 3),
        ("helper().", "function", "src.f@K.helper", _part(PYTHON, "def helper", "of(n)"), "return R.of(n)", "def helper(n)", 1),
        ("LIMIT.", "variable", "src.f@K.LIMIT", "LIMIT: int = @K", "LIMIT: int = @K", None, None),
    ],
    "go": [
        ("src/f@K/", "module", "made@K", None, None, None, None),
        ("@SBase#", "class", "made@K.@SBase", _part(GO, "@SBase struct", "}"), _part(GO, "@SBase struct", "}"), None, None),
        ("@SBase#Run().", "method", "made@K.@SBase.Run", _part(GO, "func (b", "nil\n}"), _part(GO, "{\n\tif", "nil\n}"), "func (b *@SBase) Run(n, m int) error", 3),
    ],
    "typescript": [
        ("src/f@K/", "module", "src.f@K", None, None, None, None),
        ("@SBase#", "class", "src.f@K.@SBase", _part(TYPESCRIPT, "class @S", "\n}"), _part(TYPESCRIPT, "{\n  async", "\n}"), None, None),
        ("@SBase#run().", "method", "src.f@K.@SBase.run", _part(TYPESCRIPT, "async run", "} }"), _part(TYPESCRIPT, "{ if", "} }"), "async run(n: number): Promise<void>", 2),
        ("LIMIT.", "variable", "src.f@K.LIMIT", "LIMIT: number = @K", "LIMIT: number = @K", None, None),
    ],
}
#: tail of the source, kind, tail of the target (resolved), name of the target (not resolved).
_RELATIONSHIPS = [
    ("src/f@K/", "contains", "@SBase#", None),
    ("src/f@K/", "contains", "helper().", None),
    ("src/f@K/", "contains", "LIMIT.", None),
    ("src/f@K/", "imports", None, "Root"),
    ("@SBase#", "contains", "@SBase#run().", None),
    ("@SBase#", "extends", None, "R"),
    ("@SBase#run().", "calls", None, "walk"),
    ("@SBase#run().", "calls", None, "helper"),
    ("helper().", "calls", None, "of"),
]
_CHUNKS = [
    ("@SBase#", "Class: src.f@K.@SBase\nFile: src/f@K.py\nExtends: R\nMethods:\n  run(n: int) -> int"),
    (
        "@SBase#run().",
        "Method: src.f@K.@SBase.run\nFile: src/f@K.py\nSignature: def run(self, n: int = 1) -> int\nParameters: n: int\nReturns: int\nDocstring: Run it.\nCalls: helper, walk\n"
        "Implementation:\n        if n and n > @K:\n            return self.walk(n)\n        return helper(n)",
    ),
    ("helper().", "Function: src.f@K.helper\nFile: src/f@K.py\nTags: delegates_to=R.of\nSignature: def helper(n)\nCalls: of\nImplementation: delegates to R.of"),
]


def _literal(value: str | int | None) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _rows(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") v({names})"


_MADE = "made AS (SELECT c_custkey::VARCHAR AS k, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS s FROM customer)"


def _put(column: str) -> str:
    return f"replace(replace({column}, '@K', k), '@S', s)"


def _moniker(language: str, tail: str) -> str:
    return f"'loom {language} made src/f' || k || '{TEMPLATES[language][1]} ' || {_put(tail)}"


def symbols_sql(language: str) -> str:
    rows = _rows(_SYMBOLS[language], "tail, kind, name, part, hashed, sig, complexity")
    return f"""WITH {_MADE},
t AS (SELECT *, {_put(_literal(TEMPLATES[language][0]))} AS code, {_put("part")} AS own, {_put("hashed")} AS body FROM made, {rows})
SELECT {_moniker(language, "tail")} AS id, kind, {_put("name")} AS qualified_name, CASE WHEN own IS NULL THEN 0 ELSE instr(code, own) - 1 END::INT AS byte_start,
  CASE WHEN own IS NULL THEN length(code) ELSE instr(code, own) - 1 + length(own) END::INT AS byte_end, 'sha256:' || sha256(coalesce(body, code)) AS body_hash, {_put("sig")} AS signature, complexity::INT AS complexity FROM t"""


def relationships_sql() -> str:
    rows = _rows(_RELATIONSHIPS, "source, kind, target, name")
    return f"""WITH {_MADE} SELECT {_moniker("python", "source")} AS source_id, kind, target IS NOT NULL AS is_resolved, {_moniker("python", "target")} AS target_id, name AS target_name FROM made, {rows}"""


def chunks_sql() -> str:
    rows = _rows(_CHUNKS, "tail, text")
    return f"""WITH {_MADE} SELECT {_moniker("python", "tail")} AS moniker, {_put("text")} AS chunk FROM made, {rows}"""
