"""Own small sources for each language, with all symbols, imports and calls expected."""

import pytest

from symloom.sources.tree import parse_source


def brief(code, language):
    p = parse_source(code.encode(), language)
    names = [(s.kind, s.name, p.symbols[s.parent].name if s.parent is not None else None) for s in p.symbols]
    return p, names, [(i.module, i.names) for i in p.imports], [n for n, _, _ in p.references]


PY = '''"""Module."""
import os, sys as system
from .shapes import Square
from geo.units import metre as m, foot

LIMIT = 3
Mixed = 4
_LOW: int = 1


@decorated
class Tower(Base):
    """Tall thing.

    More.
    """

    def __init__(self, é: int = 3):
        self.é = é
        helper(super().build(é))

    @staticmethod
    async def _rise(
        a,
        b,
    ):
        return Square(a).area()


def helper(x):
    def inner():
        pass
    return f"{measure(x)}"
'''


def test_python():
    p, names, imports, calls = brief(PY, "python")
    assert names == [("const", "LIMIT", None), ("const", "_LOW", None), ("class", "Tower", None), ("method", "__init__", "Tower"), ("method", "_rise", "Tower"), ("function", "helper", None)]
    assert imports == [("os", ["os", "sys"]), (".shapes", ["Square"]), ("geo.units", ["geo.units", "metre", "foot"])]
    assert sorted(calls) == sorted(["helper", "build", "area", "Square", "measure"])
    raw = PY.encode()
    tower = p.symbols[2]
    assert tower.docstring == "Tall thing." and tower.signature == "class Tower(Base):" and raw[tower.start :].startswith(b"class Tower")
    assert p.symbols[4].signature.startswith("async def _rise(") and p.symbols[4].visibility == "private"
    assert p.symbols[3].signature == "def __init__(self, é: int = 3):"
    assert raw[p.symbols[5].start : p.symbols[5].end].decode().endswith('return f"{measure(x)}"')


def test_python_with_errors():
    _, names, imports, calls = brief("import a\nclass A:\n    def f(self):\n        g(1\n\ndef h(:\n    k()\n", "python")
    assert names == [("class", "A", None), ("method", "f", "A"), ("function", "h", None)]
    assert imports == [("a", ["a"])] and "k" in calls and "g" in calls


TS = """import { Thing, type Other as O } from './things';
import fs from "fs";
export const SIZE = 3, wide = { a: () => go(1) };
let count = 0;
/* class Ghost {} */
export interface Shape { area(): number; }
export type Pair = {
  a: string;
};
@sealed
export default class Box<T> extends Base {
  private size: number = 3;
  static names: string[];
  constructor(private readonly x: string) { super(x); }
  async open(a: { b: number }): Promise<void> {
    const y = new Thing(); this.size = y.load(`${render(a)} ( `);
  }
  get label(): string { return 'class No {'; }
}
export async function* stream() { yield* each((v) => v.map(f)); }
function plain() { return plain(); }
"""


def test_typescript():
    p, names, imports, calls = brief(TS, "typescript")
    assert names == [("const", "SIZE", None), ("const", "wide", None), ("function", "count", None), ("interface", "Shape", None), ("type", "Pair", None), ("class", "Box", None), ("const", "size", "Box"), ("const", "names", "Box"), ("method", "constructor", "Box"), ("method", "open", "Box"), ("method", "label", "Box"), ("function", "stream", None), ("function", "plain", None)]
    assert [m for m, _ in imports] == ["./things", "fs"] and "Thing" in imports[0][1]
    assert {"go", "load", "render", "each", "map", "plain"} <= set(calls) and "Thing" not in calls and "super" not in calls
    vis = {s.name: s.visibility for s in p.symbols}
    assert vis["Box"] == "public" and vis["count"] == "internal" and vis["plain"] == "internal"
    assert [s.signature for s in p.symbols if s.name == "open"] == ["async open(a: { b: number }): Promise<void>"]


def test_javascript_has_no_types():
    _, names, _, _ = brief("interface X {}\nclass A { x = 1; go() { run(); } }\nvar b = function () {}\n", "javascript")
    assert names == [("class", "A", None), ("method", "go", "A"), ("function", "b", None)]


RS = """use std::collections::HashMap;
#[derive(Debug)]
pub struct Point<'a> { x: &'a str }
enum Kind { A, B(u8) }
pub trait Draw { fn draw(&self); fn twice(&self) { self.draw(); } }
impl<'a> Draw for Point<'a> { fn draw(&self) { paint('}', "fn x() {"); } }
impl Kind { pub fn make() -> Self { Kind::B(1) } }
pub const MAX: usize = 3;
static mut N: i32 = 1;
type Map = HashMap<String, i32>;
fn free<T: Into<u8>>(x: T) -> u8 where T: Copy { helper::<u8>(x); vec.iter().map(|v| v).collect::<Vec<_>>() }
mod inner { fn hidden() {} }
"""


def test_rust():
    p, names, imports, calls = brief(RS, "rust")
    assert names == [("type", "Point", None), ("type", "Kind", None), ("interface", "Draw", None), ("method", "twice", "Draw"), ("method", "Point::draw", None), ("method", "Kind::make", None), ("const", "MAX", None), ("const", "N", None), ("type", "Map", None), ("function", "free", None)]
    assert imports == [("std::collections::HashMap", ["std::collections::HashMap"])]
    assert {"draw", "paint", "helper", "iter", "map", "collect"} <= set(calls)
    assert {s.name: s.visibility for s in p.symbols}["Kind::make"] == "public"


GO = """package main
import "fmt"
import (
\t"os"
)
type Server struct {
\tport int
}
type (
\tReader interface { Read() }
\tid int
)
func (s *Server) Start(a int) error {
\tfmt.Println(s.port)
\treturn run(func() { stop() })
}
func run(f func()) error { return nil }
"""


def test_go():
    p, names, imports, calls = brief(GO, "go")
    assert names == [("type", "Server", None), ("interface", "Reader", None), ("type", "id", None), ("method", "Server.Start", None), ("function", "run", None)]
    assert [m for m, _ in imports] == ["fmt", None] and {"Println", "run", "stop"} <= set(calls)
    assert [s.visibility for s in p.symbols][:3] == ["public", "public", "private"]


JAVA = """package a.b;
import java.util.List;
@Entity
public class Order {
    private static final int MAX = 3;
    private int n;
    public Order(int n) { this.n = n; check(n); }
    @Override
    public List<String> names() throws IOException { return new ArrayList<>(build()); }
    class Inner { void no() {} }
}
interface Item { void use(); }
"""


def test_java():
    _, names, imports, calls = brief(JAVA, "java")
    assert names == [("class", "Order", None), ("const", "MAX", "Order"), ("method", "Order", "Order"), ("method", "names", "Order"), ("interface", "Item", None)]
    assert imports == [("java.util.List", ["List"])] and {"check", "ArrayList", "build"} <= set(calls)


C = """#include <stdio.h>
#include "own/list.h"
#define TWICE(x) ((x) * 2)
typedef struct { int a; } pair_t;
struct node { struct node *next; };
enum color { RED };
static const int LIMIT = 5;
int add(int a, int b) { return printf("%d {", a + b); }
void decl(int);
"""


def test_c():
    _, names, imports, calls = brief(C, "c")
    assert names == [("type", "pair_t", None), ("type", "node", None), ("type", "color", None), ("const", "LIMIT", None), ("function", "add", None)]
    assert imports == [("stdio.h", ["stdio.h"]), ("own/list.h", ["own/list.h"])] and "printf" in calls


CPP = """#include <vector>
namespace geo {
class Shape : public Base {
public:
    Shape(int x);
    virtual double area() const;
};
int helper() { return std::max(1, other()); }
}
double Shape::area() const { return helper(); }
template <typename T> T pick(T a) { return a; }
"""


def test_cpp():
    _, names, imports, calls = brief(CPP, "cpp")
    assert names[:2] == [("module", "geo", None), ("class", "Shape", None)]
    assert ("method", "area", "Shape") in names and ("function", "helper", None) in names and ("function", "pick", None) in names
    assert {"max", "other", "helper"} <= set(calls) and imports == [("vector", ["vector"])]


RB = """require 'json'
require_relative "lib/a"
module Tools
  def self.hidden
  end
end
class Cart < Base
  def add(x)
    if x
      store(x)
    end
    items.each do |i|
      i.touch
    end
  end
  def self.open; new(1) end
end
def main
  Cart.open.add(3)
end
def self.late
end
"""


def test_ruby():
    p, names, imports, calls = brief(RB, "ruby")
    assert names == [("module", "Tools", None), ("class", "Cart", None), ("method", "add", "Cart"), ("method", "self.open", "Cart"), ("function", "main", None), ("method", "self.late", None)]
    assert [m for m, _ in imports] == ["json", "lib/a"] and {"store", "touch", "new", "add"} <= set(calls)
    assert RB[p.symbols[4].start : p.symbols[4].end] == "def main\n  Cart.open.add(3)\nend"


@pytest.mark.parametrize("language", ["python", "typescript", "javascript", "rust", "go", "java", "c", "cpp", "ruby"])
def test_broken_code_never_fails(language):
    import random

    rng = random.Random(1)
    for code in ("", "{", "}}}", "class", '"', "/*", "func (", "def", "'''", "fn x(", "é{(["):
        parse_source(code.encode(), language)
    for sample in (PY, TS, RS, GO, JAVA, C, CPP, RB):
        for _ in range(8):
            cut = "".join(c for c in sample if rng.random() > 0.03)[: rng.randint(0, len(sample))]
            p = parse_source(cut.encode(), language)
            assert all(0 <= s.start <= s.end <= len(cut.encode()) for s in p.symbols)
