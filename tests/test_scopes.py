"""Comments, symbols, calls and scopes of literal sources, one or more for each language."""

import pytest

from factweave import rules as R
from factweave.functions import lexer
from factweave.operators import extract, scopes
from pyspark.sql import functions as F

FILES = "file string, language string, src string"

#: language, source, symbols (name, kind, first line, last line), calls (line, name).
SOURCES = [
    ("typescript", "function handler(req) {\n  saveOrder(req);\n  if (req) {\n    it(\"x\", function () {\n    });\n  }\n}\nsetTimeout(function () {\n}, 1);\nlater();",
     {("handler", "function", 1, 7)}, {(2, "saveOrder"), (4, "it"), (8, "setTimeout"), (10, "later")}),
    ("javascript", "function handler(req) {\n  saveOrder(req);\n}\nclass A extends B {\n  // save(y) {\n  async save(x = f({})) {\n    const inner = (a) => {\n      return go(a);\n    };\n    end(`save(${x}`);\n  }\n}\nlast(/\\(\"/, '/*');",
     {("handler", "function", 1, 3), ("A", "class", 4, 12), ("save", "function", 6, 11), ("inner", "function", 7, 9)}, {(2, "saveOrder"), (6, "f"), (8, "go"), (10, "end"), (13, "last")}),
    ("typescript", "export abstract class A {\n  abstract load(x: number): Promise<T>;\n  private async find<T>(x: number): Promise<T> {\n    this.load(x);\n  }\n}\nexport const make: Maker = async (x) => {\n  api.get('a');\n};\nconst one = (x) => x + 1;\nmake(1);",
     {("A", "class", 1, 6), ("load", "function", 2, 2), ("find", "function", 3, 5), ("make", "function", 7, 9), ("one", "function", 10, 10)}, {(4, "load"), (8, "get"), (11, "make")}),
    ("java", "public class Shop {\n  public Shop(int a) {\n    init();\n  }\n  @GetMapping(\"/a\") public final synchronized List<A> show(int x) {\n    Thread t = new Thread() {\n      public void run() {\n        call(x);\n      }\n    };\n    return find(x); // gone(x)\n  }\n  abstract int calc(int a);\n  static int main(String[] args) {}\n}",
     {("Shop", "class", 1, 15), ("show", "function", 5, 12), ("run", "function", 7, 9), ("calc", "function", 13, 13), ("main", "function", 14, 14)}, {(3, "init"), (6, "Thread"), (8, "call"), (11, "find")}),
    ("php", "class A {\n  final public static function f(array $x = []) {\n    g($x); # h($x)\n  }\n  abstract protected function k();\n}\nrun();", {("A", "class", 1, 6), ("f", "function", 2, 4), ("k", "function", 5, 5)}, {(3, "g"), (7, "run")}),
    ("rust", "pub(crate) fn f<'a>(x: &'a str) -> u8 {\n  let c = '{';\n  g(r#\"}\"\"#);\n}\npub unsafe fn h() {}\npub const fn k() -> u8 { 1 }\ntrait T {\n  fn req(&self);\n  fn wide(&self) {\n    self.req();\n  }\n}\n/* fn no() { */", {("f", "function", 1, 4), ("h", "function", 5, 5), ("k", "function", 6, 6), ("T", "class", 7, 12), ("req", "function", 8, 8), ("wide", "function", 9, 11)}, {(3, "g"), (10, "req")}),
    ("go", "import (\n\t\"fmt\"\n\tx \"a/b\"\n)\nfunc (s *S) Get(m map[string]struct{}) interface{} {\n\tfmt.Println(\"}\")\n}\nfunc main() { run() }", {("Get", "function", 5, 7), ("main", "function", 8, 8)}, {(6, "Println"), (8, "run")}),
    ("python", "import os\ndef a(x,\n      y=f(1)):\n    \"\"\"call(x) }\"\"\"\n    def b():\n        return g('(')\n\n    # h()\n    return b()\n\nclass C:\n    def m(self): return n()\n    k = 1\nz = a(1)", {("a", "function", 2, 9), ("b", "function", 5, 6), ("C", "class", 11, 13), ("m", "function", 12, 12)}, {(3, "f"), (6, "g"), (9, "b"), (12, "n"), (14, "a")}),
    ("ruby", "class A\n  def self.f(x)\n    x.each do |y|\n      g(y) if y\n    end\n    z = if x then 1 else 2 end\n  end\n  def one(x) = h(x)\n  while go(1) do\n    step(\"end\") # end\n  end\n  private def last\n  end\nend\nrun(1)", {("A", "class", 1, 14), ("f", "function", 2, 7), ("one", "function", 8, 8), ("last", "function", 12, 13)}, {(4, "g"), (8, "h"), (9, "go"), (10, "step"), (15, "run")}),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(str(i), language, src) for i, (language, src, *_) in enumerate(SOURCES)], FILES).cache()


def by_file(rows, key, value):
    out = {i: set() for i in range(len(SOURCES))}
    for r in rows:
        out[int(r[key])].add(value(r))
    return out


def test_symbols_and_their_ends(files):
    got = by_file(scopes.scopes(files).collect(), "file", lambda r: (r.name, r.kind, r.line, r.end_line))
    for i, (language, _, want, _) in enumerate(SOURCES):
        assert got[i] == want, language


def test_calls(files):
    got = by_file(extract.edges(files).where("rel = 'calls'").collect(), "src_file", lambda r: (r.line, r.dst_symbol))
    for i, (language, _, _, want) in enumerate(SOURCES):
        assert got[i] == want, language


def test_grouped_imports(files):
    rows = extract.edges(files).where("rel = 'imports'").collect()
    assert {(r.line, r.dst_file) for r in rows if SOURCES[int(r.src_file)][0] == "go"} == {(2, "fmt"), (3, "a/b")}


def test_innermost_function_of_every_line(spark, files):
    lines = files.select("file", F.explode(F.sequence(F.lit(1).cast("long"), F.size(F.split("src", "\n")).cast("long"))).alias("line")).withColumn("fn_name", F.lit("<module>"))
    got = by_file(scopes.enclosing(lines, scopes.scopes(files)).collect(), "file", lambda r: (r.line, r.fn_name))
    for i, (language, src, want, _) in enumerate(SOURCES):
        functions = [s for s in want if s[1] == "function"]
        for line in range(1, src.count("\n") + 2):
            inside = [s for s in functions if s[2] <= line <= s[3]]
            assert (line, max(inside, key=lambda s: s[2])[0] if inside else "<module>") in got[i], (language, line)


def test_functions_that_share_a_line(spark):
    src = "function a() {\n} function b() {\n  x();\n} function c() { }\ny();"
    df = spark.createDataFrame([("f", "rust", src.replace("function", "fn"))], FILES)
    lines = spark.createDataFrame([("f", i, "<module>") for i in range(1, 6)], "file string, line long, fn_name string")
    # one symbol a line: `} fn b` isn't at the start of its line, so only a is known, and ends on line 2
    assert {(r.line, r.fn_name) for r in scopes.enclosing(lines, scopes.scopes(df)).collect()} == {(1, "a"), (2, "a"), (3, "<module>"), (4, "<module>"), (5, "<module>")}
    spans = spark.createDataFrame([("a", "function", "f", 1, True, 0, 2, 0), ("b", "function", "f", 2, True, 1, 4, 0), ("c", "function", "f", 4, True, 1, 4, 3)], "name string, kind string, file string, line long, is_exported boolean, at int, end_line long, end_k int")
    assert {(r.line, r.fn_name) for r in scopes.enclosing(lines, spans).collect()} == {(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "<module>")}


@pytest.mark.parametrize(("language", "line"), [("javascript", '// redis.get("k")'), ("typescript", '/* redis.get("k") */'), ("java", '// redis.get("k")'), ("go", '/* redis.Get(ctx, "k") */'), ("rust", '// conn.get("k")'), ("php", '# $redis->get("k")'), ("ruby", '# redis.get("k")'), ("python", '"""redis.get("k")"""')])
def test_comments_give_nothing(spark, language, line):
    df = spark.createDataFrame([("f", language, f"\n{line}\n  {line}"), ("g", language, None), ("h", language, "")], FILES)
    assert extract.boundary_events(df).count() == 0 and extract.symbols(df).count() == 0 and extract.edges(df).count() == 0


def test_lexers_keep_places_and_are_linear(spark):
    src = 'a = "x\\"#y" # z "\n' * 20_000 + 's = "' + '\\"' * 50_000 + '"\n' + "'unclosed"
    df = spark.createDataFrame([(language, src) for language in ("python", "ruby", "javascript", "java", "php", "rust", "go", "typescript")], "language string, src string")
    code = df.withColumn("code", lexer.code_of(F.col("language"), F.col("src"))).withColumn("bare", lexer.bare_of(F.col("language"), F.col("code")))
    for r in code.collect():
        assert len(r.code) == len(r.bare) == len(src) and r.code.count("\n") == r.bare.count("\n") == src.count("\n")
    python = code.where("language = 'python'").first()
    assert python.code.split("\n")[0] == 'a = "x\\"#y"' + " " * 6 and python.bare.split("\n")[0].strip() == "a ="


def test_comments_hold_a_mark(spark):
    """Sources without the marks of their language aren't searched for comments; every kind of comment has one."""
    rows = [("javascript", "a // b"), ("typescript", "a /* b */"), ("python", "a # b"), ("python", "'''b'''"), ("python", '"""b"""'), ("ruby", "a # b"), ("ruby", "=begin\nb\n=end"),
        ("rust", "a // b"), ("go", "a /* b"), ("java", "a // b"), ("php", "a # b"), ("php", "a // b")]
    assert all(any(mark in src for mark in R.COMMENT_MARKS[language]) for language, src in rows)
    found = spark.createDataFrame(rows, "language string, src string").select("src", lexer.code().alias("code")).collect()
    assert all("b" not in r.code and len(r.code) == len(r.src) for r in found)
