import pytest

from cstloom.llm import grammars, syntax

VALID = {
    "python": ["", "x = 1\n", "def f(a, *b, c=1, **d) -> int:\n    \"\"\"it's\"\"\"\n    return [i for i in a if i]\n", "@d\nclass A(B):\n  x: int = 3\n  async def g(self): await y\n", "if x:\n\ty\nelse: z\n", "try:\n  pass\nexcept (A, B) as e:\n  raise X from e\n", "s = '<<<<<<< HEAD'\n", "with a as b, c: d = {**e, 'f': lambda g: g}\n", "x[1:2, ::3] = not a if b else -c\n"],
    "javascript": ["import { a, b as c } from 'x';\nexport default function f(a = 1, ...b) { return a ? b : c; }", "var f=o=>o.map(x=>({a:x.b,c:x[2]}));", "for(;n<x;n++)e[s]^=71;", "class A extends B { static x = 1; get y() { return `a${1}` } }", "a = b\nc = d\n", "try{a()}catch(e){}finally{}", "switch(m){case 1:return v;default:break}", "!function(n){n.d=[1]}(d);", "for (const a of b) { if (c) d(); else e(); }"],
    "typescript": ["export function f(a: string, b?: X[]): Y { const c: Z = a; return c; }", "interface A { x: number; y(a: B): C; }", "type T = A | B;", "class A { private x: number = 1; f(a: B): C { return a; } }"],
    "java": ["package a.b;\nimport c.D;\n@X public class E<T> extends F { private int[] a = {1, 2}; public E(int b) { for (var c : d) { e(c); } } }", "interface A { void f(); }"],
    "go": ["package a\n\nimport \"b/c\"\n\ntype T struct {\n\ta B\n}\n\nfunc (t *T) f(a B, c D) E {\n\tfor _, x := range a {\n\t\tif x > 1 {\n\t\t\tg(x)\n\t\t}\n\t}\n\treturn t.a + 1\n}\n"],
    "rust": ["use a::B;\n\n#[inline]\npub fn f(a: &B, c: D) -> E {\n    let x = a.g(c + 1);\n    for y in x { if y > 1 { h(y); } }\n    x\n}\n", "impl A for B { fn f(&self) -> C { self.d() } }", "pub struct A { b: C, d: E }"],
    "c": ["#include <a.h>\n\nstatic long f(const long a, long b[]) {\n  for (long i = 0; i < a; i++) { g(i); }\n  return a * 2;\n}\n", "struct A { int b; };\nlong x[] = {1, 2};"],
    "cpp": ["#include <a>\nclass A {\n public:\n  B f(const C& d) { for (auto& e : d) { g(e); } return d.h(); }\n};\n", "namespace a { int b = 1; }"],
    "csharp": ["using A.B;\n\npublic class C {\n    public D F(E g) { foreach (var x in g) { h(x); } return g; }\n}\n"],
}
INVALID = {
    "python": ["def f(:\n", "x = (1\n", "if x:\ny\n", "<<<<<<< HEAD\nx = 1\n=======\n>>>>>>> b\n", "pub fn f() {}\n", "x = 'a\n", "  x = 1\ny = 2\n", "if x\n  y\n", "@@ -1 +1 @@\n+x = 1\n", "x = 0123\n"],
    "javascript": ["function f() {", "f(a;", "def f(x):\n  return 1\n", "public class A {}", "export function f(a: B): C { }", "a = [1)", "package a\n", "x = 'a\n';"],
    "typescript": ["fn f(a: B) -> C { a }", "import a.b.C;", "{ x = (1 }"],
    "java": ["public class A { void f() { for (var a in b) {} } }", "function f() {}", "public class A {", "using A;"],
    "go": ["package a\nimport b.C;\n", "func f() {\n\tx := (1\n}\n", "use a::B;\n"],
    "rust": ["def f(): pass", "fn f() { let x = ; }", "func f(a B) C { }", "fn f() {"],
    "c": ["class A { };", "long f(const A& b) { }", "#foo\n", "int f( { }"],
    "cpp": ["fn f(a: B) {}", "int f() { return 1 }", "def f(): x"],
    "csharp": ["import a.b.C;\npublic class D { }", "public class A { void f() { for (var x : y) { } } }"],
}


def is_valid(text, language):
    shapes, brackets = syntax.lexed(text, language)
    depth = []
    for b in brackets:
        if b in "([{":
            depth.append(b)
        elif not depth or {")": "(", "]": "[", "}": "{"}[b] != depth.pop():
            return False
    return not depth and all(syntax.derivable(language, *x.split(":", 1)) for x in shapes)


@pytest.mark.parametrize("language", sorted(VALID))
def test_cases(language):
    for text in VALID[language]:
        assert is_valid(text, language) and is_valid("﻿" + text.replace("\n", "\r\n"), language), text
        shapes, _ = syntax.lexed(text, language)
        permitted = grammars.permissible_pairs(language)
        for s in shapes:
            s = s.partition(":")[2]
            assert all(p in permitted or p[0] + "*" in permitted or "*" + p[1] in permitted for p in (s[i : i + 2] for i in range(len(s) - 1))), (text, s)
    for text in INVALID[language]:
        assert not is_valid(text, language), text


def test_files(spark):
    ext = {"python": "py", "javascript": "js", "typescript": "ts", "java": "java", "go": "go", "rust": "rs", "c": "c", "cpp": "cpp", "csharp": "cs"}
    rows, bad = [], set()
    for group, source in enumerate((VALID, INVALID)):
        for language, texts in source.items():
            for text in texts:
                rows.append((len(rows), f"r/a.{ext[language]}", "file", text, "clash"))
                bad |= {len(rows) - 1} if group else set()
    rows += [(900, "r/a.py", "file", None, ""), (901, "r/a.toml", "file", "(", ""), (902, "r/a.py", "function_definition", "(", ""), rows[0], rows[-1], (903, "r/a.js", "file", "f(1);" * 20_000, "")]
    chunks = spark.createDataFrame(rows, "file_id bigint, filepath string, chunk_type string, text string, shapes string")
    scans = spark.createDataFrame([(800, "r/b.py", "r", False, "SyntaxError: x", 1), (800, "r/b.py", "r", True, None, 2), (801, "r/b.py", "r", False, "unexpected token at 1:2", 3), (802, "r/b.py", "r", False, "timed out after 3.0s", 3), (803, "r/b.ini", "r", False, "invalid syntax", 3), (0, "r/a.c", "r", False, "invalid syntax", 3)], "file_id bigint, filepath string, repo string, success boolean, error string, scanned_at bigint")
    assert {r.file_id for r in syntax.invalid_files(scans, chunks).collect()} == bad | {801}
    assert syntax.invalid_rates(scans, chunks).filter("invalid_files > files").count() == 0
    assert syntax.invalid_files(scans.limit(0), chunks.limit(0)).count() == 0


JAVA_BODIES = [
    "int a = 1; assert a > 0 : \"x\"; return a;", "a.b(c); List<String> d = new ArrayList<>();", "boolean q = a instanceof B b && b.c();", "x = 1; int y = switch (x) { case 1, 2 -> 3; default -> throw z; };", "a(); switch (b) { case C: d(); break; default: return; }",
    "f(() -> { g(); }); h(A::b);", "int[] a = {1, 2}; for (int b : a) { c(b); }", "a = b ? c : d; synchronized (a) { b(); }", "Object a = new B() { int c; public D e() { return c; } };", "x++; try (A a = b()) { c(); } catch (D | E f) { } finally { g(); }",
]
JAVA_MEMBERS = ["int a; @X(1) private int b; static { b = 2; } public <T extends C> T f(T d) throws E { return d; }", "A, B(1) { int f() { return 1; } }, C;  int d; int f() { return d; }", "X; static int y = 3;", "A, B,", "int a(); default void f() { g(); }"]
JAVA_BROKEN = ["int a = 1 int b = 2;", "x = 1; a b c;", "x = 1; return a", "int a; x = a + ;", "a(); b = = c;", "A, B; int c = ; int d;", "a(); if b { c(); }", "x = 1; for (int a : b) c d e;"]


def test_java_bodies_that_begin_with_a_name(spark):
    texts = [f"class A {{ void f() {{ {body} }} }}" for body in JAVA_BODIES] + [f"enum A {{ {members} }}" for members in JAVA_MEMBERS]
    for text in texts:
        assert is_valid(text, "java"), text
    broken = [f"class A {{ void f() {{ {body} }} }}" for body in JAVA_BROKEN] + ["class A { int a; int b int c; }"]
    for text in broken:
        assert not is_valid(text, "java"), text
    assert not any("*" in pair for pair in grammars.permissible_pairs("java")) and not {"dn", "o;"} & grammars.permissible_pairs("java")
    rows = [(i, "r/a.java", "java", text) for i, text in enumerate(texts + broken)]
    found = syntax.judged_texts(spark.createDataFrame([(i, lang, text) for i, _, lang, text in rows], "file_id bigint, language string, text string"))
    assert {r.file_id for r in found.collect()} == set(range(len(texts), len(rows)))
