import pytest

from topolane.llm import syntax as S

GOOD = {
    "py": ["", "# only\n", "x = 1", "def f(a, *, b=2, **k):\n    if a:\n        return [x for x in b if x]\n    elif b: pass\n    else:\n        yield\n", '"""\n<<<<<<< HEAD\n"""\n', "@d\nclass A(B):\n\tx: int = 3\n\n\tasync def g(self):\n\t\tasync with a as b: ...\n", "try:\n    f()\nexcept (A, B) as e:\n    raise\nelse:\n    pass\nfinally:\n    pass\n", "x = (1,\n     2)\nprint(f'{x!r}' 'b', *a, **k)\n", "a = lambda x: (x, 'y')\nb[1:2] = {**c, 'k': not d}\n", "match x:\n    case 1:\n        pass\n"],
    "rs": ["", "/* a /* b */ c */", "use a::{B, c};\n#[derive(Debug)]\npub struct S<'a> { pub x: &'a str }\nimpl<'a> S<'a> { fn f(&self) -> Option<Vec<u8>> { let c = '\\''; match c { '{' => None, _ => Some(vec![1u8; 3]) } } }\n", 'fn f() { let s = r#"{ "a": [ "#; for i in 0..n { g::<u64>(i)?; } }', "const X: &str = \"a\";\nstatic Y: [u8; 2] = [1, 2];\nmacro_rules! m { () => {}; }\nmod t;\n"],
    "ts": ["", "import { a } from './a';\nexport async function f(x: any, n: number = 1): Promise<any> {\n  const r = /[({]+\\/x/g;\n  return x as unknown as Array<number>;\n}\nexport interface I { a?: number[]; b?: () => void; }\nexport type T = { a: string } | null;\n", "export const o: string = `a ${b ? `c` : d} e`;\nexport class A { async m(x: number) { if (!x) { return 1; } x?.y?.(2) ?? 'z'; return x; } }\n"],
    "js": ["", "import a from 'b'\nexport class A extends B { async m(x) { a.map((x) => x * 1); return x < 2 ? 'p' : x; } }\nfor (const x of q) { f(x, 1); }\nexport default { 'k': \"v\", n: 3 };\n", "/* <<<<<<< HEAD */ let o = { a: 1, 'b c': [2] }\nif (a) b(); else c()\n"],
    "go": ["// only a comment\n", "\n\n", "package a\n", "package a\n\nimport (\n\t\"fmt\"\n)\n\ntype S struct {\n\tA []byte\n\tM map[string]int\n}\n\nfunc (s *S) f(a []int, n int) (int, error) {\n\tfor i := 0; i < n; i++ {\n\t\ta = append(a, i)\n\t}\n\tswitch n {\n\tcase '{':\n\t\tg()\n\tdefault:\n\t}\n\tgo func() { c <- 1 }()\n\treturn n, nil\n}\n"],
    "java": ["", "// c", "package a.b;\nimport c.*;\npublic class A<T> extends B implements C {\n  @Override\n  private int f(String s, int n) throws E { int[] t = {1, 2}; var x = (int) n; try { g(); } catch (E e) { } l.forEach(y -> h(y)); return n; }\n  String s = \"\"\"\n   a \" b\n   \"\"\";\n}\n"],
    "c": ["", "/* c */", "#include <a.h>\n#define X(a) \\\n  (a)\nstruct s { int a; };\ntypedef struct s t;\nstatic int f(struct s *p, int n) { char c = '{'; for (int i = 0; i < n; i++) { g(p->a, i); } switch (n) { case 1: break; default: break; } return n ? 1 : 0; }\nint a[] = {1, 2};\n"],
    "xml": ["<!-- only -->\n", " \n", '<?xml version="1.0"?>\n<!-- c --><a b="c"><d/>x &amp; <![CDATA[ <<<<<<< ]]></a>\n'],
    "yaml": ["", "# c\n", "a:\n  b: 1\n  c:\n    - x\n    - y: [1, 2]\n  d: |\n    <<<<<<< x\n    y\nseq:\n- 1\n- 2\n", "k: \"a: b\"\n# c\nl: 'it''s'\nm: {a: 1,\n  b: 2}\n"],
    "properties": ["anything <<<<<<< goes {{{"],
}
BAD = {
    "py": ["def f(:\n    pass\n", "def f():\n", "x = (1,\n", "    x = 1\n", "x = 'abc\n", "if a\n    b\n", "<<<<<<< HEAD\nx = 1\n=======\n", "try:\n    x\n", "const a = 1;\n", "def f():\n    a\n   b\n", "x = 1 2\n", "[... 66 lines omitted ...]\n", "package a\n"],
    "rs": ["fn f() { (", "fn f()", "use a::b", "fn f() { let s = \"x; }", "<<<<<<< a\n", "fn f() {}}", "def f(): pass", "fn f() { a b }", "[... 3 lines omitted ...]"],
    "ts": ["export class A {", "const a = /x", "export function f(a", "a b c d", "import { a } from", "<truncated 22 bytes>", "fn main() {}"],
    "js": ["function f(x: number) { }", "const a: any = 1;", "interface A { }", "export default {", "let s = 'a\n';", "f(1;", ">>>>>>> x"],
    "go": ["func f() {}\n", "package a\nfunc f() {\n", "package a\nx := \"a\n", "package a\n\n=======\n", "package a\nfunc f( {\n}\n"],
    "java": ["class A {", "class A { int f() { return 1 } }}", "public static", "class A { String s = \"a; }", "<<<<<<< x\nclass A { }"],
    "c": ["int f( {", "int f() { return 1; ", "/* open", "int x = ;", "public class A { }", "package a.b;"],
    "xml": ["<a>", "<a></b>", "<a b=c/>", "text", "", "<a>&x;</a>", "<a/><b/>", "<a"][:4] + ["<a>&x;</a>", "<a/><b/>", "<a"],
    "yaml": ["a: 1\n<<<<<<< x\n", "a: [1, 2\n", "  a: 1\nb: 2\n", "a: \"x\n", "a: b: c\n", "a:\n\t- x\n", "a: 1\nplain\n"],
}


#: One construct after another, valid ones and faults in statements.
MORE_GOOD = [
    ('js', 'const f = function () { return 1; };'),
    ('js', 'const C = class extends D {}'),
    ('go', 'package a\nfunc f() func(int) int {\n\treturn nil\n}\n'),
    ('rs', 'union U { a: u8 }'),
    ('c', 'int (f)(void);'),
    ('c', 'int (f)(void) { return 1; }'),
    ('go', 'package a\ntype X = int\n'),
    ('py', 'def f[T](a): pass\n'),
    ('py', 'x = f"{b["c"]}"\n'),
    ('java', 'class A { int f(Object o) { return switch (o) { case String s when s.length() > 1 -> 1; default -> 0; }; } }'),
    ('java', 'class A { void f(Object o) { switch (o) { case String s when s.length() > 1 -> g(); case B b -> { h(); } default -> throw new E(); } } }'),
    ('yaml', 'a: one\n  two\nb: 1\n'),
    ('yaml', '? a\n: b\n'),
    ('xml', '<über/>'),
    ('c', 'union U { int a; };'),
    ('c', 'typedef int (*fn)(int, char *);\nstatic fn table[] = { f, g };'),
    ('c', 'struct s { int a : 3; struct { int x; } b; };'),
    ('c', 'enum e { A = 1, B, };'),
    ('c', 'int f(void) { for (;;) { if (a) b(); else if (c) d(); else { e(); } do { x--; } while (x); goto out; out: return (int)x; } }'),
    ('c', 'int x = sizeof(struct s), *p = &x, **q;'),
    ('c', 'int a[3] = { [0] = 1, [2] = 3 };\nstruct p o = { .x = 1, .y = { 2 } };'),
    ('java', 'interface I<T extends Comparable<T>> extends J, K<T> { default int f() { return 1; } static <U> U g(U u) { return u; } int X = 1, Y = 2; }'),
    ('java', 'enum E { A(1) { int f() { return 1; } }, B; private int x; E() {} E(int x) { this.x = x; } }'),
    ('java', 'record P(int x, int y) implements I { P { if (x < 0) throw new E(); } }'),
    ('java', 'class A { int[][] a = {{1, 2}, {3}}; Map<String, List<Integer>> m = new HashMap<>(); Runnable r = () -> {}; { init(); } static { x = 1; } @Override public void f() throws A, B { label: for (int i = 0, j = 1; i < n; i++, j--) { continue label; } for (var x : xs) y(); synchronized (this) { z(); } try (var a = b(); var c = d) { } finally { } int k = a ? b : c; List<int[]> l = x.<T>foo().stream().map(A::new).toList(); if (a) for (;;) { break; } else return; } }'),
    ('java', 'sealed interface S permits A, B {}\nnon-sealed class A implements S {}\n@interface Q { int v() default 1; }'),
    ('java', 'class A { void f() { int x = (int) y; String s = (String) o; foo((a, b) -> a + b); new Thread() { public void run() {} }.start(); var t = new int[]{1, 2}[0]; assert x > 1 : "m"; do x++; while (x < 3); } }'),
    ('js', 'if (a) b(); else if (c) d(); else { e() }\nfor (let i = 0; i < n; i++) f(i)\nfor (const k in o) g(k)\nwhile (x) y()\ndo { z() } while (q)\nlabel: for (;;) { break label }\nswitch (a) { case 1: b(); break; default: c() }\ntry { a() } catch { b() } finally { c() }\n'),
    ('js', "const {a, b: {c}, ...d} = e, [f, , g = 1] = h;\nlet o = { a, b() {}, get c() { return 1 }, async *d() {}, [k]: 1, 'x': 2, ...y, if: 3 };\nclass A { #x = 1; static y; static { z() } get v() { return this.#x } async m() {} constructor(a) { super(a) } }\nexport { a as b, default } from 'x'; export * as n from 'y'; export default class {}\nconst r = a ? b : c ? d : e; x ??= y?.z?.[0]?.(1); (async () => { await f() })();\nnew A; new A().b; `t${x}`; a = b\n++c\n"),
    ('js', "import a, {b as c, default as d} from 'x';\nimport * as e from 'y';\nimport 'z';\nconst f = async (x) => { for await (const y of x) {} };\nexport const g = () => ({ a: 1 });\nexport function* h() { yield* x; }\n"),
    ('ts', "export abstract class A<T extends B = C> extends D<T> implements E, F { private readonly x: number = 1; constructor(private a: string, public b?: number) { super(); } abstract m(): void; get y(): T { return this.z!; } static s<U>(x: U): x is U { return true; } [k: string]: any; }\ninterface I { (x: number): string; new (x: number): I; a?: number; readonly b: Array<{ c: string }>; m<T>(x: T): void }\ntype M = { [K in keyof T]?: T[K] } & Partial<U> | ((a: number) => void);\ntype N = T extends infer U ? U : never;\nenum E { A = 1, B }\ndeclare module 'x' { export function f(a: number): void; }\nlet x = <any>y; let z = a as const; function f(this: Window, ...r: number[]): asserts r is X {}\nexport type { A } from 'b'; import type { C } from 'd';\nconst m = new Map<string, number>([['a', 1]]);\n"),
    ('rs', "fn main() { let x = if a { 1 } else { 2 }; let Some(y) = z else { return }; match x { 1 | 2 if q => {} A { b, .. } => f(), _ => (), } for i in 0..n { g(i); } loop { break; } let c = |a, b| a + b; let s = S { a: 1, ..d }; while let Some(x) = y.pop() {} x.iter().map(|x| { x }).collect::<Vec<_>>(); unsafe { *p = 1; } 'a: loop { break 'a; } if let Some(x) = y && x > 1 { } return; }"),
    ('rs', '#![allow(x)]\npub mod a;\npub(crate) use b::{c, d as e, f::*};\npub trait T: A + B where Self: Sized { const X: u8; type Y; fn f(&self) -> Self::Y; fn g() {} }\nimpl<T: Clone> Tr for S<T> where T: A { type Y = u8; fn f(&self) -> u8 { self.0 } }\npub enum E { A, B(u8), C { x: u8 }, D = 4 }\npub struct P(pub u8, u16);\nstruct U;\nstatic mut X: [u8; 3] = [0; 3];\nextern "C" { fn f(a: i32); }\nmacro_rules! m { ($x:expr, $($y:tt)*) => { $x } }\nlazy! { static ref A: u8 = 1; }\ntype R<T> = std::result::Result<T, E>;\npub async unsafe fn q<\'a, const N: usize>(x: &\'a mut [u8; N]) -> impl Iterator<Item = u8> + \'a { todo!() }\nconst fn z() -> u8 { 1 }\nunion W { a: u8, b: u16 }\n'),
    ('go', 'package a\n\nimport f "fmt"\n\nvar (\n\tx = 1\n\ty, z int = 2, 3\n)\n\nconst (\n\tA = iota\n\tB\n)\n\ntype (\n\tT struct{ a, b int; c string `json:"c"` }\n\tI interface {\n\t\tf() error\n\t\tG\n\t}\n)\n\ntype N[T any] struct{ x T }\n\nfunc (t *T) f(a, b int, c ...string) (err error) {\n\tif x := g(); x > 1 {\n\t\treturn nil\n\t} else if y {\n\t} else {\n\t}\n\tfor i, v := range xs {\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tfor x < 1 {\n\t}\n\tswitch t := x.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase d <- 1:\n\tdefault:\n\t}\n\tm := map[string][]int{"a": {1, 2}, "b": nil}\n\tdefer func() { recover() }()\n\tL:\n\tfor {\n\t\tcontinue L\n\t}\n\tp := &T{a: 1, b: 2}\n\tx, y = y, x\n\tx++\n\tgo f(a...)\n\tvar q = func(a int) int { return a }\n\treturn\n}\n\nfunc G[T any](x T) T { return x }\n'),
    ('py', 'from a import (b as c, d,)\nfrom . import x\nfrom ..y import *\nimport a.b as c, d\nx: int = 3\na, *b = c\na = b = c\nx += 1\nx[1:2, ::3] = y\nf(a, *b, c=1, **d)\nf(x for x in y)\nprint(*a, sep=\'\')\nassert x, \'m\'\ndel x[0], y\nlambda: 0\nf = lambda a, *b, c=1, **d: (a, b)\nz = a if b else c if d else e\nw = [x for x in y if x if z]\nd = {**a, \'b\': 1, c: 2}\ns = {1, *a}\nwith open(a) as f, b as (c, d): pass\nwith (open(a) as f, b): pass\nasync def g(): \n    async for x in y: await z\n    return [i async for i in q]\nwhile (n := f()) > 1: n -= 1\nfor i, (a, b) in enumerate(z): continue\nelse: pass\ntry: a\nexcept* E: b\nraise E from e\nglobal q, r\nx = yield\n@a.b(1)\nclass K(B, metaclass=M):\n    x: \'int\'\n    def m(self, a, /, b=1, *, c, d=2, **e) -> \'T\': return not a\nmatch x:\n    case [1, 2, *r] if r: pass\n    case {\'a\': 1, **k}: pass\n    case P(x=0) | None: pass\n    case _: pass\ntype A = int\nprint(f\'{a!r:>{w}} {b=} {{x}}\', f"{d[\'k\']}")\nx = (yield)\nx = a @ b ** -c // d\nif not a and b is not c or d not in e: pass\n'),
    ('py', '"""doc"""\n'),
    ('yaml', 'a: &x\n  b: *y\nc: !t v\nd: >-\n  text: x\n  more\ne:\n- f: 1\n  g: 2\n- - h\n  - i\n- j\nk: {l: 1, "m":2, n}\no: \'it\'\'s\n  two\'\n---\np: http://x.y/z#q\n...\n'),
    ('yaml', '- a\n- b: c\n  d:\n  - e\n-\n  f: g\n- |\n  x\n  y\n- "q": r\n'),
    ('yaml', 'plain text\nover lines\n'),
    ('yaml', 'a: [\n  b,\n  c: d\n]\nx y: z w # c\n'),
    ('xml', '<!DOCTYPE a [<!ENTITY b "c">]><a x="1" y=\'2\'>&b;<b:c/></a>'),
    ('xml', '<a><!-- c --><?pi x?></a>\n'),
]
MORE_BAD = [
    ('java', 'class A { void f() { int x = 1 } }'),
    ('c', 'int f() { return 0 }'),
    ('js', 'else {}'),
    ('java', 'class A { void f() { else {} } }'),
    ('js', 'if x {}'),
    ('java', 'class A { void f() { if x {} } }'),
    ('c', 'int f() { if x {} }'),
    ('js', 'let let x'),
    ('js', 'for (;;;) {}'),
    ('java', 'class A { void f() { for (;;;) {} } }'),
    ('c', 'int f() { for (;;;) {} }'),
    ('java', 'class A { void f() { try {} } }'),
    ('js', 'try {}'),
    ('java', 'class A { void f() { int a = 1 int b = 2; } }'),
    ('js', 'function f() { let a = 1 let b = 2 }'),
    ('py', '1 = x\n'),
    ('py', 'if x = 1:\n    pass\n'),
    ('py', 'f(a=1, 2)\n'),
    ('py', 'from x import\n'),
    ('py', 'while: pass\n'),
    ('py', 'x if y\n'),
    ('py', 'def f(a=1, b): pass\n'),
    ('py', 'f() = 1\n'),
    ('py', 'x = = 1\n'),
    ('py', 'class: pass\n'),
    ('py', 'import\n'),
    ('py', 'return return\n'),
    ('py', 'for x y: pass\n'),
    ('py', 'else: pass\n'),
    ('py', 'try: pass\n'),
    ('py', 'lambda x\n'),
    ('py', 'a b\n'),
    ('py', 'x = \n'),
    ('py', 'def f: pass\n'),
    ('py', 'with: pass\n'),
    ('py', '{1: 2, 3}\n'),
    ('py', '(a, b\n'),
    ('py', 'x ++\n'),
    ('go', 'package a\nfunc f() { if { } }\n'),
    ('go', 'package a\nfunc f() {\n\tx := \n}\n'),
    ('go', 'package a\nfunc f() {\n\telse {\n\t}\n}\n'),
    ('go', 'package a\nfunc f() {\n\tfor ;;; {\n\t}\n}\n'),
    ('go', 'package a\nfunc f() {\n\tx = 1 y = 2\n}\n'),
    ('go', 'package a\nvar x = [1,2\n'),
    ('rs', 'fn f() { let x = 1 let y = 2; }'),
    ('rs', 'fn f() { else { } }'),
    ('rs', 'fn f() { if { } }'),
    ('rs', 'fn f() { let = 3; }'),
    ('rs', 'struct S { a u8 }'),
    ('rs', 'fn f() { match x { a b } }'),
    ('rs', 'fn f() { x = ; }'),
    ('rs', 'impl { }'),
    ('rs', 'enum E { A B }'),
    ('rs', 'fn f() { return 1 2; }'),
    ('rs', 'fn f() { for x { } }'),
    ('java', 'class A { void f() { x; } }'),
    ('java', 'class A { int; }'),
    ('java', 'class A { void f( { } }'),
    ('java', 'class A { void f() { return return; } }'),
    ('java', 'class A { void f() { case 1: x(); } }'),
    ('java', 'class A { int f { } }'),
    ('java', 'class A void f() { }'),
    ('java', 'class A { void f() { while () {} } }'),
    ('java', 'import a.b'),
    ('java', 'class A { void f() { f(a,); } }'),
    ('java', 'class A { void f() { else x(); } }'),
    ('js', 'const = 1;'),
    ('js', 'function () {}'),
    ('js', 'class { }'),
    ('js', 'let x = {a: 1 b: 2};'),
    ('js', 'return { a b }'),
    ('js', 'switch (x) { foo(); }'),
    ('js', 'while () {}'),
    ('js', 'f(a b)'),
    ('js', "import { a b } from 'c';"),
    ('js', 'export x;'),
    ('js', 'var 1x;'),
    ('js', 'a = ;'),
    ('js', 'if (a) else b;'),
    ('js', 'x => { return 1 2 }'),
    ('ts', 'interface I { a number }'),
    ('ts', 'let let x'),
    ('ts', 'enum E { A B }'),
    ('ts', 'try {}'),
    ('ts', 'if x {}'),
    ('c', 'int f() { int x = 1 int y; }'),
    ('c', 'int f() { else {} }'),
    ('c', 'struct s { int a }'),
    ('c', 'int f() { while () {} }'),
    ('c', 'int f() { x = ; }'),
    ('c', 'int f() { do { } }'),
    ('c', 'int a[] = {1, 2;'),
    ('c', '#include <a.h>\nint x'),
    ('c', 'int f() { a b c; 1 2; }'),
    ('yaml', 'a: b\n c: d\n'),
    ('yaml', '- a\nb: c\n'),
    ('yaml', "a: 'x' y\n"),
    ('yaml', 'a:\n   b: 1\n  c: 2\n'),
    ('yaml', 'a: - b\n'),
    ('yaml', '{a: b\n'),
    ('yaml', 'a: [b]]\n'),
    ('xml', "<a b='1' b='2'/>"),
    ('xml', '<a>&</a>'),
    ('xml', '<a><b></a></b>'),
    ('xml', '<a></a>x'),
    ('xml', '<1/>'),
    ('xml', '<a b="<"/>'),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows, want = [], {}
    for expect, cases in ((False, GOOD), (True, BAD)):
        for ext, texts in cases.items():
            for t in texts:
                for variant in (t, t.replace("\n", "\r\n")) if "\\\n" not in t and '"""' not in t else (t,):
                    want[len(rows)] = (expect, ext, variant)
                    rows.append((len(rows), f"d/x.{ext}", variant, "repo", "ignored"))
    for expect, cases in ((False, MORE_GOOD), (True, MORE_BAD)):
        for ext, text in cases:
            want[len(rows)] = (expect, ext, text)
            rows.append((len(rows), f"d/x.{ext}", text, "repo", "ignored"))
    n = len(rows)
    rows += [(n, None, "(((", "repo", ""), (n + 1, "a.unknown", "(((", "repo", ""), (n + 2, "a.py", None, "repo", ""), (n + 3, "a.py", "x = (", None, ""), (n + 3, "a.py", "x = (", None, "")]
    want[n + 3] = (True, "py", "x = (")
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string, repo string, defect string")
    return {r.file_id for r in S.defects(df).collect()}, want, df


def test_every_case(judged):
    found, want, _ = judged
    wrong = [(i, w) for i, w in want.items() if (i in found) != w[0]]
    assert not wrong, wrong
    assert found <= set(want)


def test_rates(judged):
    _, want, df = judged
    r = {(x.repo, x.language): (x.n_files, x.n_invalid) for x in S.rates(df, S.defects(df)).collect()}
    assert r[(None, "python")] == (2, 2) and r[("repo", "properties")] == (2, 0)


def test_deep_and_long(spark):
    deep = 5000
    rows = [
        ("a.py", "x = 1\n" * 20000, False), ("b.js", "(" * deep + "1" + ")" * deep + ";\n", False), ("c.js", "(" * deep + "1" + ")" * (deep - 1) + ";\n", True),
        ("d.c", "int f(int a) { return a; }\n" * 5000, False), ("e.py", "if a:\n    b\n" + "elif a:\n    b\n" * 10000, False), ("f.py", "try:\n    b\n" + "except A:\n    b\n" * 5000, False),
        ("g.py", "@d\n" * 5000 + "def f(): pass\n", False), ("h.c", "int " + ", ".join(f"x{i}" for i in range(20000)) + ";\n", False), ("i.js", "if (a) b();" + " else if (a) b();" * 10000 + " else c();", False),
        ("j.js", "if (a) b();" + " else if (a) b();" * 5000 + " else c(); else d();", True), ("k.java", "class A { int[] x = {" + "1, " * 100000 + "1}; }", False), ("l.xml", "<a>" * deep + "</a>" * deep, False),
        ("m.xml", "<a>" * deep + "</a>" * (deep - 1) + "</b>", True), ("n.yaml", "".join(" " * i + f"k{i}:\n" for i in range(500)) + " " * 500 + "v\n", False), ("o.yaml", "- a: 1\n  b: [1, 2]\n" * 20000 + "c: 1\n", True),
        ("p.rs", "fn f() { " + "let x = a(1); " * 30000 + "}", False), ("q.go", "package a\n\nfunc f() {\n" + "\tx := g(1)\n" * 30000 + "}\n", False), ("r.ts", "const x = { " + "a: [1, 'b'], " * 30000 + "};\n", False),
        ("s.json", "{", False), ("t.properties", "{", False),
    ]
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(rows)], "file_id bigint, path string, content string")
    assert {r.file_id for r in S.defects(df).collect()} == {i for i, r in enumerate(rows) if r[2]}
    assert S.defects(df.limit(0)).count() == 0


def test_permitted_pairs_are_bounded():
    assert all(500 < len(S.permitted(x)) < 20000 for x in S.KEYWORDS)
