"""Extraction from our own snippets: places, hashes, names and relationships."""

import hashlib

from codeloom.extract import go_source, python_source, typescript_source


def sha(b):
    return "sha256:" + hashlib.sha256(b).hexdigest()


def by_tail(out):
    return {s["id"].split(" ")[-1]: s for s in out.symbols}


def rels(out, kind):
    return [(r["source_id"].split(" ")[-1], r["target_name"] or r["target_id"].split(" ")[-1], r["metadata"]) for r in out.relationships if r["kind"] == kind]


PY = b'''"""Orders."""
from decimal import Decimal as D, getcontext
from . import *
import os.path as p, sys

RATE: float = 0.1
_hidden: "int"
untyped = 3
BIG = 4


class Error(Exception):
    pass


@register(1)
class Order(base.Model, Generic[T], metaclass=ABCMeta):
    """An order."""

    def __init__(self, lines: list[int], *args, flag=True, **kw: str) -> None:
        self.lines = lines

    @staticmethod
    async def load(a, /, b: int = 3, *, c) -> "Order":
        """Load
        it."""
        def inner():
            hidden()
        if a and b or c:
            for x in [y for y in z if y]:
                await Order.fetch(x).one(f(x))
        elif b:
            pass
        return (lambda: called())() if a else None


def total(order):
    class Local:
        def method(self):
            return 1
    try:
        return sum(order.lines)
    except ValueError:
        raise
'''


def test_python_symbols():
    out = python_source.extract("src/shop/order.py", PY, "r")
    s = by_tail(out)
    assert list(s) == ["src/shop/order/", "Error#", "Order#", "Local#", "Order#__init__().", "Order#load().", "total().", "Local#method().", "RATE.", "_hidden."]
    m = s["src/shop/order/"]
    assert (m["qualified_name"], m["docstring"], m["body_hash"]) == ("src.shop.order", "Orders.", sha(PY))
    assert m["location"] == {"line_start": 1, "line_end": PY.count(b"\n") + 1, "byte_start": 0, "byte_end": len(PY), "column_start": 0, "column_end": 0}
    assert s["Error#"]["body_hash"] == sha(b"pass") and s["Error#"]["base_classes"] == ["Exception"]
    o = s["Order#"]
    assert (o["base_classes"], o["decorators"], o["is_abstract"], o["docstring"]) == (["base.Model"], ["@register(1)"], False, "An order.")
    assert PY[o["location"]["byte_start"] :].startswith(b"class Order")
    i = s["Order#__init__()."]
    assert i["is_constructor"] and not i["is_static"] and i["visibility"] == "public" and i["enclosing_class_id"] == o["id"]
    assert [(p["name"], p["type_annotation"], p["default_value"], p["is_variadic"], p["is_keyword_variadic"]) for p in i["parameters"]] == [
        ("self", None, None, False, False), ("lines", "list[int]", None, False, False), ("args", None, None, True, False), ("flag", None, "True", False, False), ("kw", "str", None, False, True),
    ]
    load = s["Order#load()."]
    assert load["is_static"] and load["is_async"] and load["return_type"] == '"Order"' and load["docstring"] == "Load\n        it."
    assert load["signature"] == 'async def load(a, /, b: int = 3, *, c) -> "Order"'
    assert load["complexity"] == 1 + 2 + 1 + 1 + 1 + 1  # and/or, if, for, elif, conditional
    assert s["total()."]["complexity"] == 2 and s["RATE."]["is_constant"] and s["_hidden."]["visibility"] == "private"


def test_python_relationships():
    out = python_source.extract("src/shop/order.py", PY, "r")
    assert [t for _, t, _ in rels(out, "contains")] == ["Error#", "Order#", "Local#", "Order#__init__().", "Order#load().", "total().", "Local#method().", "RATE.", "_hidden."]
    assert rels(out, "extends") == [("Error#", "Exception", {"import_source": None, "call_form": "direct"}), ("Order#", "base.Model", {"import_source": None, "call_form": "attribute"})]
    assert rels(out, "imports") == [
        ("src/shop/order/", "Decimal", {"import_source": "decimal", "alias": "D"}), ("src/shop/order/", "getcontext", {"import_source": "decimal", "alias": None}),
        ("src/shop/order/", "*", {"import_source": ".", "alias": None}),
        ("src/shop/order/", "os.path", {"import_source": None, "alias": "p", "call_form": "module"}), ("src/shop/order/", "sys", {"import_source": None, "alias": None, "call_form": "module"}),
    ]
    calls = rels(out, "calls")
    assert ("Order#load().", "one", {"call_form": "method", "receiver": "Order.fetch(x)"}) in calls
    assert {t for s, t, _ in calls if s == "Order#load()."} == {"called", "one", "f", "fetch"}
    assert [t for s, t, _ in calls if s == "total()."] == ["sum"]


def test_python_edge_cases():
    assert [s["kind"] for s in python_source.extract("a.py", b"", "r").symbols] == ["module"]
    broken = b"def good():\n    return 1\n\ndef bad(:\n    pass\n\nx: int = 1\n"
    assert set(by_tail(python_source.extract("a.py", broken, "r"))) == {"a/", "good().", "x."}
    assert set(by_tail(python_source.extract("a.py", b"\xff\xfe(((", "r"))) == {"a/"}
    utf = "# é\ndef f(ä='ß'):\n    return 'ü'\n".encode()
    f = by_tail(python_source.extract("a b.py", utf, "r"))["f()."]
    assert f["id"] == "loom python r a%20b.py f()." and f["body_hash"] == sha("return 'ü'".encode()) and f["parameters"][0]["name"] == "ä"
    assert by_tail(python_source.extract("a.py", b"\xef\xbb\xbfdef f():\n  pass\n", "r"))["f()."]["location"]["byte_start"] == 3
    old, new = (by_tail(python_source.extract("a.py", b"def f(%s):\n  pass\n" % a, "r"))["f()."] for a in (b"a", b"b"))
    assert old["body_hash"] == new["body_hash"] and old["meta_hash"] != new["meta_hash"]
    assert python_source.extract("a.py", b"def f():\n    'a' 'b'\n", "r").symbols[1]["docstring"] is None
    assert python_source.extract("a.py", b"def f():\n    r'''a'''\n", "r").symbols[1]["docstring"] == "r'''a'''"
    assert rels(python_source.extract("a.py", b"from __future__ import annotations\n", "r"), "imports") == []


def test_go():
    code = b'''package shop

import (
	"fmt"
	str "strings"
	_ "embed"
)

// Cart holds
//go:generate x
// items.
type Cart struct {
	*Base
	Logger `json:"l"`
	pkg.Other
	n, m int
}

// Far.

type Shape interface {
	Area() float64
	Scale(by float64, to ...string) (int, error)
	Named
	~int | string
}

type ID = string
const (
	A, B = 1, 2
	C Kind = iota
)
var x, y = 3, "a)"

func init() {}
func init() { go func() { hidden() }() }

func (c *Cart) Add(a, b int, f func(int) error) (map[string]interface{}, error) {
	if a > 0 && b > 0 { c.log.With("x").Info(str.ToUpper(f(1))) }
	select {
	case <-ch:
	default:
	}
	return nil, nil
}
func (o Other[T]) Get() {}
'''
    out = go_source.extract("a/b.go", code, "r")
    s = by_tail(out)
    assert s["a/b/"]["qualified_name"] == "shop" and s["Cart#"]["docstring"] == "Cart holds\nitems." and s["Shape#"]["docstring"] is None
    assert s["Cart#"]["base_classes"] == ["Base", "Logger"] and s["Shape#"]["base_classes"] == ["Named"] and s["Shape#"]["is_abstract"]
    add = s["Cart#Add()."]
    assert [(p["name"], p["type_annotation"]) for p in add["parameters"]] == [("a", "int"), ("b", "int"), ("f", "func(int) error")]
    assert add["return_type"] == "(map[string]interface{}, error)" and add["receiver_kind"] == "pointer" and add["complexity"] == 5
    assert add["enclosing_class_id"] == s["Cart#"]["id"] and s["Other#Get()."]["enclosing_class_id"] is None and s["Other#Get()."]["receiver_kind"] == "value"
    assert [t for _, t, _ in rels(out, "calls")] == ["Info", "ToUpper", "f", "With"]
    assert {k for k in s if k.startswith("init@")} == {"init@35().", "init@36()."}
    assert (s["A."]["type_annotation"], s["C."]["type_annotation"], s["x."]["type_annotation"], s["y."]["is_constant"], s["ID."]["type_annotation"]) == (None, "Kind", "<inferred>", False, "string")
    assert s["Shape#Scale()."]["parameters"][1]["is_variadic"] and s["Shape#Scale()."]["complexity"] is None
    assert rels(out, "imports") == [("a/b/", "fmt", {"import_source": "fmt", "alias": None}), ("a/b/", "str", {"import_source": "strings", "alias": "str"})]
    assert go_source.extract("a.go", b"//go:build ignore\npackage a\nfunc f() {}\n", "r").symbols == []
    assert len(go_source.extract("a.go", b"package a\nfunc f( {{{ `", "r").symbols) >= 1


def test_typescript():
    code = b'''/** Module doc. */
import fs, { read as rd } from 'fs';
import * as path from "path";
import './side';
export { a } from './x';
export * as ns from './z';

/** Runs. */
export async function run<T>(x: number, y?: Map<string, T>, ...rest: string[]): Promise<{ a: T }> {
  if (x > 1 && y) { go(x); } else { new Thing().ok() }
  const f = (q: number): number => { hidden(q); return 1 };
  return helper.a().b(`t ${inner(x)} u`);
}
export const add = (a: number, b = 2): number => a + b;
const skipped = (a) => a;
export const LIMIT: number = 10, other = 3;
const { p, q } = obj;
export type Pair<A> = { a: A } | [A];
enum Color { Red }
export interface Shape extends Base, Gen<string> { area(): number; size: string; new (x: number): Shape }
@Component({ s: '}' })
export abstract class Foo<T> extends Bar<T> implements I1, I2<string> {
  handler = () => { this.nope() };
  constructor(private secret: string) { super(); this.init(); }
  /** M. */
  @Log() protected static async m(a: string): Promise<void> { do { x() } while (y()); }
  abstract n(): void;
  m(a: string): void {}
}
export default function () {}
export default class Named {}
declare function amb(): void;
namespace N { export function inside() {} }
interface Shape { again(): void }
'''
    out = typescript_source.extract("a/b.ts", code, "r")
    s = by_tail(out)
    assert list(s) == ["a/b/", "run().", "add().", "LIMIT.", "Pair.", "Color#", "Shape#", "Shape#area().", "Foo#", "Foo#constructor().", "Foo#m().", "Foo#n().", "Named#"]
    assert s["a/b/"]["docstring"] == "Module doc." and s["run()."]["docstring"] == "Runs." and s["Foo#m()."]["docstring"] == "M."
    assert s["run()."]["complexity"] == 4 and s["run()."]["return_type"] == "Promise<{ a: T }>" and s["run()."]["is_async"]
    assert [(p["name"], p["type_annotation"], p["is_variadic"]) for p in s["run()."]["parameters"]] == [("x", "number", False), ("y", "Map<string, T>", False), ("rest", "string[]", True)]
    assert s["add()."]["return_type"] == "number" and s["add()."]["body_hash"] == sha(b"a + b")
    assert (s["Foo#"]["is_abstract"], s["Foo#"]["base_classes"], s["Shape#"]["base_classes"]) == (True, ["Bar"], ["Base", "Gen<string>"])
    m = s["Foo#m()."]
    assert (m["visibility"], m["is_static"], m["is_async"], m["decorators"], m["complexity"]) == ("protected", True, True, ["@Log()"], 2)
    assert s["Foo#constructor()."]["parameters"][0]["name"] == "secret" and s["Foo#constructor()."]["is_constructor"] and s["Foo#n()."]["complexity"] is None
    assert [t for _, t, _ in rels(out, "implements")] == ["I1", "I2<string>"]
    assert {t for a, t, _ in rels(out, "calls") if a == "run()."} == {"b", "inner", "a", "go", "ok"}
    assert [t for a, t, _ in rels(out, "calls") if a == "Foo#constructor()."] == ["init"]
    assert len([1 for a, t, _ in rels(out, "contains") if t == "Foo#m()."]) == 1
    assert [(t, m.get("import_form"), m.get("re_export")) for _, t, m in rels(out, "imports")] == [("fs", "default", None), ("read", "named", None), ("*", "namespace", None), ("a", None, True), ("*", None, True)]


def names_and_left_out(code):
    out = python_source.extract("a.py", code, "r")
    return list(by_tail(out)), out.left_out


def test_python_files_with_errors_lose_only_what_is_broken():
    member = b"class A:\n    def a(self):\n        return 1\n    def b(self:\n        return 2\n    @deco\n    def c(self):\n        return f(3)\n\ndef z():\n    pass\n"
    assert names_and_left_out(member) == (["a/", "A#", "A#a().", "A#c().", "z()."], "left out lines 4-5")
    many = b"".join(b"def bad%d(:\n    pass\ndef good%d():\n    return 1\n" % (i, i) for i in range(80))
    assert names_and_left_out(many)[0] == ["a/", *(f"good{i}()." for i in range(80))]
    unclosed = b'def f():\n    return 1\nx = """open\ndef g():\n    pass\n'
    assert names_and_left_out(unclosed) == (["a/", "f()."], "left out lines 3-6")
    deep = b"def f():\n    return 1\nx = " + b"+".join([b"1"] * 20000) + b"\ndef g():\n    return " + b"(" * 300 + b")" * 300 + b"\ndef h(): pass\n"
    assert names_and_left_out(deep) == (["a/", "f().", "g().", "h()."], "left out lines 3, 5")
    assert names_and_left_out(b"def f():\n    return 1\n\xff\xff\xff\n") == (["a/", "f()."], "left out lines 3")
    assert names_and_left_out(member.replace(b"self:", b"self):"))[1] is None


def test_python_two_files_keep_their_functions_and_calls():
    code = b"import os\ndef f(x):\n    print \"x %s\" % g(x)\n    try:\n        y()\n    except ValueError, e:\n        raise\n\nclass B:\n    def m(self):\n        print 'a', h(1)\n        exec 'code'\n        return 2\n"
    out = python_source.extract("a.py", code, "r")
    s = by_tail(out)
    assert set(s) == {"a/", "B#", "f().", "B#m()."} and out.left_out == "left out lines 12"
    assert [t for _, t, _ in rels(out, "calls")] == ["y", "g", "h"]
    f = s["f()."]["location"]
    assert code[f["byte_start"] : f["byte_end"]].endswith(b"except ValueError, e:\n        raise") and s["f()."]["body_hash"] == sha(code[code.index(b"print") : f["byte_end"]])
    prints = b"class A:\n" + b"".join(b"    def m%d(self):\n        print >>f, 1\n        return 1\n" % i for i in range(300))
    assert len(names_and_left_out(prints)[0]) == 302


def test_expressions_nested_deeper_than_calls_can_be():
    code = b"def f():\n    return " + b"a." * 900 + b"b(1)\n"
    assert names_and_left_out(code) == (["a/", "f()."], None)
