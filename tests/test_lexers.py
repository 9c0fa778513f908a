"""Tokens and facts of scripts and Go, by hand."""

from tallyforge.operators import lexers as L
from tallyforge.operators import symbols as S


def symbols(text, lang="typescript"):
    return [(f[2], f[3], f[4], f[5]) for f in L.facts(text, lang) if f[0] == "symbol"]


def named(text, fact, lang="typescript"):
    return [f[1] for f in L.facts(text, lang) if f[0] == fact]


def test_strings_and_comments():
    text = 'function f() { const t = "}}}"; /* } */ // }\n const r = /[}/]}/g, s = \'}\'; return `}${g({a: `${h("}")}`})}}` }\nfunction k() {}\n'
    assert symbols(text) == [("f", "function", 1, 2), ("k", "function", 3, 3)]
    assert named(text, "call") == ["g", "h"]
    assert symbols("<p>don't</p>\nfunction a() { return x / y / 2 }\nfunction b() {}", "javascript") == [("a", "function", 2, 2), ("b", "function", 3, 3)]


def test_scripts():
    text = """import x, { y } from './x'
import "side"
export default class A<T extends {a: 1}> extends B {
  static #p = 1
  @Input() name: string
  constructor(private a: number) { super(a); this.run() }
  get value(): { a: number } { return this.go?.(1) }
  async *run<T>(x: T = f(1)): Promise<Map<string, number[]>> {
    const inner = async (q) => { new Thing(q) }
    if (x) { call(x) }
  }
  ['computed'](a) {}
  declared(a: number): void;
  field = () => 3
}
interface I { m(): void }
abstract class Abs { m() {} }
export const arrow = (a: number): string => b(a), other = function named() { return 1 }, plain = 3
let one = z => z
  .map(w)
const obj = { method(a) { return a }, async other() {}, value: 1, key: function () {} }
export async function* gen() { const m = await import('dyn'); tag`a${b}` }
const x = cond ? class Q { inside() {} } : null
"""
    assert symbols(text) == [
        ("A", "class", 3, 15), ("A.constructor", "method", 6, 6), ("A.value", "method", 7, 7), ("A.run", "method", 8, 11), ("A.run.inner", "function", 9, 9), ("A.['computed']", "method", 12, 12),
        ("I", "interface", 16, 16), ("m", "method", 17, 17), ("arrow", "function", 18, 18), ("other", "function", 18, 18), ("one", "function", 19, 20), ("method", "method", 21, 21), ("other", "method", 21, 21),
        ("gen", "function", 22, 22), ("inside", "method", 23, 23),
    ]
    assert named(text, "import") == ["./x", "side", "dyn"]
    assert set(named(text, "call")) >= {"run", "go", "f", "Thing", "call", "b", "map", "tag"} and not set(named(text, "call")) & {"constructor", "super", "if", "method", "import", "gen"}
    signature = {f[2]: f[9] for f in L.facts(text, "typescript") if f[0] == "symbol"}
    assert signature["A"] == "class A<T extends {a: 1}> extends B" and signature["A.value"] == "get value(): { a: number }" and signature["gen"] == "async function* gen()"
    assert symbols("interface I { a: 1 }\nclass C { m() {} }", "javascript") == [("C", "class", 2, 2), ("C.m", "method", 2, 2)]


def test_go():
    text = """package p
import "fmt"
import (
  a "x/y"
  `raw`
  "z"
)
type T struct { f func() int }
type Alias = T
type (
  U interface{ M() }
  V int
)
func (t *T) Run(x map[string]int) (interface{}, error) {
  s := "}" + `}
}` + string('}')
  return fmt.Sprint(s), func() { t.f() }
}
func Gen[K comparable](k K) interface{} { return nil }
func external(x int) int
func last() {}
"""
    assert symbols(text, "go") == [("T", "type", 8, 8), ("U", "type", 10, 13), ("U.V", "type", 10, 13), ("Run", "method", 14, 18), ("Gen", "function", 19, 19), ("external", "function", 20, 20), ("last", "function", 21, 21)]
    assert named(text, "import", "go") == ["fmt", "x/y", "z"]
    assert named(text, "call", "go") == ["string", "Sprint", "f"]
    assert {f[9] for f in L.facts(text, "go") if f[1] == "Run"} == {"func (t *T) Run(x map[string]int) (interface{}, error)"}


def test_vue_offsets():
    text = "<template>é {{ x() }}</template>\n<script lang=\"ts\" setup>\nconst f = () => go()\n</script>\n<script>\nfunction g() {}\n</script>\n"
    rows = list(L.facts(text, "vue"))
    raw = text.encode()
    assert [(f[1], f[4], f[8]) for f in rows] == [("f", 3, "typescript"), ("go", 3, "typescript"), ("g", 6, "javascript")]
    assert [raw[f[6] : f[7]].decode() for f in rows] == ["f = () => go()", "go", "function g() {}"]


def test_broken():
    for text in ("", "}", "function", "class {", "const", "const a = (", "a`${", "`", "'", "/", "x = {", "func", "type", "type (", "import", "import (", "func (a", "const [a] = b, {c} = d", "({[", ")]}", "=>" * 50, "class A { m( } )", "let a: = ", "new", "`${`${"):
        for lang in ("javascript", "tsx", "go", "vue"):
            list(L.facts(text, lang))
    deep = "(" * 20_000 + ")" * 20_000
    assert list(L.facts(deep, "go")) == []


def test_parents(spark):
    text = "class A {\n  m() { const f = () => 1 }\n}\n"
    files = spark.createDataFrame([("a.ts", text), ("b.PY", "class B:\n    @d\n    def m(self,\n          x): return q.r(x)\n"), ("c.txt", text), (".py", "def f(): pass"), ("n.go", None)], "path string, text string")
    facts = S.extract(files)
    got = {(r.path, r.qualified_name): (r.parent_id, r.signature, r.kind) for r in S.symbol_rows(facts).collect()}
    assert got == {
        ("a.ts", "A"): (None, "class A", "class"), ("a.ts", "A.m"): ("a.ts::A@0", "m()", "method"), ("a.ts", "A.m.f"): ("a.ts::A.m@12", "f = () => 1", "function"),
        ("b.PY", "B"): (None, "class B:", "class"), ("b.PY", "B.m"): ("b.PY::B@0", "def m(self, x):", "function"),
    }
    calls = [(r.name, r.start_line, r.start_byte) for r in facts.filter("fact = 'call' AND path = 'b.PY'").collect()]
    assert calls == [("r", 4, 55)]
