import pytest
from pyspark.sql import functions as F

from topolane.sources import extract as E
from topolane.sources.index import IndexStore, fnv1a64, is_supported_path, language_of, scan, supported_languages
from topolane.sources.routes import arguments, page_route, routes_in


def has(found, kind, label):
    return any(n["kind"] == kind and n["label"] == label for n in found[0])


def edge(found, kind, target):
    return any(p["kind"] == kind and p["target_name"] == target for p in found[1])


CASES = [
    ("rust", "a.rs", "trait Run { fn go(&self); }\nstruct A;\nimpl Run for A {\n  fn run(&self) { helper(); }\n}\nfn helper() {}\n", [("trait", "Run"), ("method", "run"), ("function", "helper"), ("impl", "impl Run for A")], [("implements", "Run"), ("calls", "helper")]),
    ("python", "a.py", "import os.path\nclass App(Base):\n    def run(self):\n        helper()\ndef helper(): pass\n", [("class", "App"), ("method", "run"), ("function", "helper")], [("extends", "Base"), ("imports", "path"), ("calls", "helper")]),
    ("python", "bad.py", "class A:\n    def run(self):\n        x = (\n", [("class", "A"), ("method", "run")], []),
    ("typescript", "a.ts", "import { x } from './y';\ninterface I {}\nclass A extends B implements I {\n  go(n: number): void {\n    f(n);\n  }\n}\nconst g = (a: number) => f(a);\nfunction f(a) { return <Card/>; }\n", [("interface", "I"), ("class", "A"), ("method", "go"), ("function", "g"), ("function", "f")], [("extends", "B"), ("implements", "I"), ("calls", "f"), ("imports", "x"), ("renders", "Card")]),
    ("go", "a.go", 'package app\nimport "fmt"\ntype S struct {}\nfunc (s S) Do() { run() }\nfunc run() {}\n', [("module", "app"), ("struct", "S"), ("method", "Do"), ("function", "run")], [("calls", "run"), ("imports", "fmt")]),
    ("java", "A.java", "package a.b;\nimport x.Y;\npublic class A extends B implements C {\n  public int run(int a) {\n    return helper(a);\n  }\n}\n", [("class", "A"), ("method", "run")], [("extends", "B"), ("implements", "C"), ("calls", "helper"), ("imports", "Y")]),
    ("c", "a.c", '#include "x/helper.h"\nstruct s { int a; };\nstatic int run(int a) {\n  return helper(a);\n}\n', [("struct", "s"), ("function", "run")], [("imports", "helper.h"), ("calls", "helper")]),
    ("cpp", "a.cpp", "namespace n {\nclass A : public B {\n};\n}\n", [("module", "n"), ("class", "A")], [("inherits", "B")]),
    ("cuda", "a.cu", "__global__ void add(int *a) { go(); }\n", [("kernel", "add")], []),
    ("csharp", "A.cs", "using System;\nnamespace N {\n  class App : Base, IRun {\n    public void Run() {\n      Go();\n    }\n  }\n}\n", [("class", "App"), ("method", "Run")], [("inherits", "Base"), ("inherits", "IRun"), ("calls", "Go")]),
    ("php", "a.php", "<?php\nrequire 'lib/x.php';\nclass A extends B {\n  function go() { run(); }\n}\n", [("class", "A"), ("method", "go")], [("imports", "x.php"), ("inherits", "B"), ("calls", "run")]),
    ("ruby", "a.rb", "require 'helper'\nclass A < B\n  def go\n    run(1)\n  end\nend\n", [("class", "A"), ("method", "go")], [("imports", "helper.rb"), ("inherits", "B"), ("calls", "run")]),
    ("kotlin", "a.kt", "class A : B {\n  fun go() { run() }\n}\n", [("class", "A"), ("method", "go")], [("inherits", "B"), ("calls", "run")]),
    ("swift", "a.swift", "protocol P {}\nstruct S: P {\n  func go() { run() }\n}\nextension S {}\n", [("interface", "P"), ("struct", "S"), ("method", "go"), ("impl", "impl S")], [("inherits", "P")]),
    ("scala", "a.scala", "object O {\n  def go(): Unit = { run() }\n}\nclass A extends B\n", [("module", "O"), ("class", "A")], [("inherits", "B")]),
    ("dart", "a.dart", "class A extends B {\n  void go() {\n    run();\n  }\n}\n", [("class", "A"), ("method", "go")], [("inherits", "B"), ("calls", "run")]),
    ("lua", "a.lua", "local m = require('x.y')\nfunction M.go()\n  run()\nend\nfunction plain() end\n", [("method", "go"), ("function", "plain")], [("imports", "y.lua"), ("calls", "run")]),
    ("objective_c", "a.m", "@interface A : B\n@end\n", [("interface", "A")], [("inherits", "B")]),
    ("yaml", "a.yml", "spring:\n  datasource:\n    url: ${DATABASE_URL}\n", [("constant", "spring.datasource.url")], [("references", "DATABASE_URL")]),
    ("properties", "a.properties", "spring.url=${DATABASE_URL}\nb: 1\n", [("constant", "spring.url"), ("constant", "b")], [("references", "DATABASE_URL")]),
    ("xml", "m.xml", '<mapper namespace="app.M">\n<select id="find" resultMap="R">x</select>\n<sql id="c">y</sql></mapper>', [("module", "app.M"), ("query", "find"), ("query_fragment", "c")], [("binds", "find"), ("references", "R")]),
    ("twig", "card.html.twig", "{% extends 'layout.html.twig' %}\n{% macro badge(x) %}{{ user }}{% endmacro %}", [("component", "card.html"), ("function", "badge")], [("renders", "layout"), ("binds", "user")]),
    ("terraform", "a.tf", 'resource "aws_x" "y" {\n}\nmodule "m" {\n  source = "./mod"\n}\n', [("resource", "aws_x.y"), ("module", "m")], [("imports", "mod")]),
    ("nix", "a.nix", "{ f = x: x;\n  v = 1;\n  g = import ./lib.nix; }\n", [("constant", "v")], []),
    ("r", "a.r", "library(dplyr)\nf <- function(x) {\n  g(x)\n}\n", [("function", "f")], [("imports", "dplyr"), ("calls", "g")]),
    ("erlang", "a.erl", "-module(m).\nf(X) -> g(X).\n", [("module", "m"), ("function", "f")], [("calls", "g")]),
    ("solidity", "a.sol", "contract A is B {\n  event E(int x);\n  function f() public { g(); }\n}\n", [("class", "A"), ("event", "E"), ("method", "f")], [("inherits", "B"), ("calls", "g")]),
    ("pascal", "a.pas", "unit U;\nuses A, B;\ntype TX = class(TY)\nprocedure Go;\n", [("module", "U"), ("class", "TX"), ("function", "Go")], [("imports", "A"), ("inherits", "TY")]),
    ("arkts", "a.ets", "@Entry\nstruct Page {\n}\n", [("component", "Page")], []),
    ("razor", "A.cshtml", '@page "/x"\n<Card />\n', [("component", "A"), ("route", "GET /x")], []),
    ("vbnet", "a.vb", "Imports System\nPublic Class A\n  Sub Go()\n    Run()\n  End Sub\nEnd Class\n", [("class", "A"), ("method", "Go"), ("reference", "System")], [("calls", "Run")]),
    ("cfml", "a.cfc", '<cffunction name="go">\n<cfquery name="q">x</cfquery></cffunction>', [("function", "go"), ("query", "q")], []),
    ("cobol", "a.cbl", "       PROGRAM-ID. MAIN.\n       COPY 'LIB'.\n", [("module", "MAIN")], [("imports", "LIB")]),
    ("svelte", "src/routes/[id]/+page.svelte", '<script lang="ts">\nfunction go() { run(); }\n</script>\n<Card on:click={go}/>', [("component", "+page"), ("function", "go"), ("route", "GET /:id")], [("renders", "Card"), ("binds", "go"), ("calls", "run")]),
]


@pytest.mark.parametrize("lang, path, text, nodes, edges", CASES, ids=[f"{c[0]}-{c[1]}" for c in CASES])
def test_language(lang, path, text, nodes, edges):
    found = E.extract(path, lang, text)
    for n in nodes:
        assert has(found, *n), (n, [(x["kind"], x["label"]) for x in found[0]])
    for e in edges:
        assert edge(found, *e), (e, [(x["kind"], x["target_name"]) for x in found[1]])
    assert found[0][0]["kind"] == "file"
    ids = {n["local_id"] for n in found[0]}
    assert all(p["source_local_id"] in ids for p in found[1])


@pytest.mark.parametrize("text", ["", None, "\n\n", "}}}}((((", "'", '"""', "x" * 50000])
def test_any_text_is_taken(text):
    for lang in [*supported_languages(), None, "none"]:
        assert E.extract("p", lang, text)[0][0]["label"] == "p"


ROUTES = [
    ("javascript", "app.get('/a/:id', auth, show);\napp.use('x');", "GET /a/:id", "show"),
    ("python", "@app.get('/x')\nasync def show(): pass", "GET /x", "show"), ("python", "urlpatterns = [path('a/', views.show)]", "ANY /a", "show"), ("python", "r.register(r'u', UserView)", "VIEWSET /u", "UserView"),
    ("ruby", "get '/a', to: 'x#show'", "GET /a", "show"), ("ruby", "resources :posts", "DELETE /posts/:id", "destroy"), ("php", "Route::get('/a', [A::class, 'show']);", "GET /a", "show"),
    ("java", '@RequestMapping("/p") class A {\n@GetMapping("/x")\npublic String show() {}}', "GET /p/x", "show"), ("csharp", '[Route("api/[controller]")] class UserController {\n[HttpGet("{id}")]\npublic X Show(int id) {}}', "GET /api/user/{id}", "Show"),
    ("go", 'r.GET("/a", h.Show)', "GET /a", "Show"), ("rust", '#[get("/a")]\nasync fn show() {}', "GET /a", "show"), ("rust", 'Router::new().route("/a", get(show))', "GET /a", "show"),
    ("swift", 'let a = app.grouped("api")\na.get("x", use: show)', "GET /api/x", "show"), ("typescript", '<Route path="/a" element={<Page/>} />', "GET /a", "Page"),
]


@pytest.mark.parametrize("lang, text, label, target", ROUTES)
def test_routes(lang, text, label, target):
    assert (label, target) in [(r[1], r[3]) for r in routes_in("p", lang, text)]


def test_route_helpers():
    assert arguments("f(a, 'x,)', g(1, 2))", 1)[0] == ["a", "'x,)'", "g(1, 2)"]
    assert page_route("pages/blog/[slug].vue") == "/blog/:slug" and page_route("src/routes/[...all]/+page.svelte") == "/*all" and page_route("lib/x.ts") is None
    assert ("GET /x", "Home::index") in [(r[1], r[3]) for r in routes_in("conf/routes", "scala", "GET  /x  controllers.Home.index")]


def test_registry(spark):
    assert len(supported_languages()) == 39 and is_supported_path("a/b.rs") and not is_supported_path("a/b") and is_supported_path("x.app.src")
    d = spark.createDataFrame([("a.rs",), ("conf/routes",), ("x.app.src",), ("none",), (None,)], "p string")
    assert [r.l for r in d.select(language_of(F.col("p")).alias("l")).collect()] == ["rust", "scala", "erlang", None, None]


def test_hash(spark):
    d = spark.createDataFrame([("abc",), ("",), (None,), ("é" * 1000,)], "x string")

    def want(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = ((h ^ x) * 0x100000001B3) % 2**64
        return h - 2**64 if h >= 2**63 else h

    assert [r.h for r in d.select(fnv1a64(F.col("x")).alias("h")).collect()] == [want(b"abc"), want(b""), None, want(("é" * 1000).encode())]


def test_scan_and_store(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / ".hidden").mkdir()
    (src / ".gitignore").write_text("skip.py\n/sub/no\n")
    for name, text in (("a.py", "x = 1\n"), ("skip.py", ""), ("sub/b.rs", "fn a() {}"), (".hidden/c.py", ""), ("note.txt", "")):
        (src / name).write_text(text)
    got = {r.path: (r.language, r.n_lines) for r in scan(spark, str(src)).collect()}
    assert got == {"a.py": ("python", 1), "sub/b.rs": ("rust", 1)}
    (src / "bad.rs").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="not UTF-8"):
        scan(spark, str(src)).collect()
    store = IndexStore(spark, str(tmp_path / "store"))
    assert store.load() is None
    store.save(t=spark.range(3))
    store.save(t=spark.range(5))
    assert store.load()["t"].count() == 5
    (tmp_path / "store" / "current.json").write_text("{")
    assert store.load() is None
