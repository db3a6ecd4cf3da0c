"""What single lines and small files give: literal rows, written from the rules' descriptions."""

import re

import pytest

from factweave import rules as R
from factweave import views as V
from factweave.operators import extract

#: language, line, the events (medium, direction, key) of the call layer or, where it has none, of the pattern layer.
LINES = [
    ("javascript", "res.setHeader('X-A')", {("http_header", "write", "X-A")}),
    ("javascript", "response.header('X-B')", {("http_header", "write", "X-B")}),
    ("javascript", "const u = request.headers['x-c']", {("http_header", "read", "x-c")}),
    ("javascript", "anything.get('key:1')", {("redis", "read", "key:1")}),
    ("javascript", "anything.get('key:1', 2)", set()),
    ("javascript", "anything.lset('list', 0, 'last')", {("redis", "write", "last")}),
    ("javascript", "bus.emit('saved')", {("websocket", "write", "saved")}),
    ("javascript", "process.env.port", {("env", "read", "port")}),
    ("javascript", "fs.writeFileSync('/tmp/a', b)", {("filesystem", "write", "/tmp/a")}),
    ("javascript", "const API_URL = '/v1/items'", {("http_out", "write", "/v1/items")}),
    ("javascript", "fetch(`https://h.org/a/b`)", {("http_out", "write", "/a/b")}),
    ("typescript", "axios.get('api/users')", {("http_out", "write", "/users"), ("redis", "read", "api/users")}),
    ("python", "os.environ.get('HOME')", {("env", "read", "HOME")}),
    ("python", "anything.ttl('k')", {("redis", "read", "k")}),
    ("python", "anything.get('k')", set()),
    ("python", "anything.persist('k')", {("redis", "write", "k")}),
    ("python", "resp.set_cookie('sid')", {("cookie", "write", "sid")}),
    ("ruby", "User.find_or_create_by(a: 1)", {("sql", "read", "User")}),
    ("ruby", "User.minimum(:a)", {("sql", "read", "User")}),
    ("ruby", "User.insert_all!(x)", {("sql", "write", "User")}),
    ("ruby", "connection.execute('UPDATE w SET b = 1')", {("sql", "write", "w")}),
    ("ruby", "queue_as :mail", {("queue", "write", "mail")}),
    ("ruby", "kafka_producer.produce('t')", {("kafka", "write", "t")}),
    ("ruby", "headers['X-D'] = 1", {("http_header", "write", "X-D")}),
    ("ruby", "rows.zcard('z')", {("redis", "read", "z")}),
    ("ruby", "ENV.dig('A')", {("env", "read", "A")}),
    ("php", "$redis->get('a');", {("redis", "read", "a")}),
    ("php", "$predis->put('a', 1);", {("redis", "write", "a")}),
    ("php", "$guzzle->request('GET', 'https://h.org/x');", {("http_out", "write", "/x")}),
    ("php", "$client->post('/y');", {("http_out", "write", "/y")}),
    ("php", "$producer->produce('t', $m);", {("kafka", "write", "t")}),
    ("java", '@KafkaListener(id = "a", topics = "t")', {("kafka", "read", "t")}),
    ("java", 'em.createNativeQuery("SELECT 1 FROM t");', {("sql", "read", "t")}),
    ("java", 'jdbcTemplate.update("UPDATE t SET a = ?", a);', set()),
    ("go", "proto.Unmarshal(b, &pb.Order{})", {("grpc", "read", "Order")}),
    ("go", 'rdb.Get("k")', set()),
    ("go", 'rdb.Get(ctx, "k")', {("redis", "read", "k")}),
    ("go", 'db.Query("SELECT a FROM t JOIN u")', {("sql", "read", "t"), ("sql", "read", "u")}),
    ("rust", "String::decode(b)", set()),
    ("rust", "Item::decode(b)", {("grpc", "read", "Item")}),
    ("rust", 'headers.get("x-zone")', {("http_header", "read", "x-zone")}),
    ("rust", "conn.get(&key)", {("redis", "read", "key")}),
    ("rust", 'sqlx::query_file_as!(T, "SELECT a FROM t")', {("sql", "read", "t")}),
    ("rust", 'env::var("A")', {("env", "read", "A")}),
    ("rust", 'conn.get(format!("user:{}", id))', {("redis", "read", 'format!("user:{}", id)')}),
    ("rust", "self.pool.set(key(&a), &values[f(1)])", {("redis", "write", "values[f(1)]")}),
    ("java", 'kafkaTemplate.send(pick(a, b), "topic");', {("kafka", "write", "topic")}),
    ("java", 'em.createQuery("SELECT e FROM t", new Mapper());', set()),
    ("go", 'rdb.Get(context.Background(), "k)")', {("redis", "read", "k)")}),
    ("javascript", "list.rpush(key(a, [1, 2]), 'v',)", {("redis", "write", "v")}),
    ("python", "bus.set(name, json.dumps({'a': (1, 2)}), 'k, l')", {("redis", "write", "k, l")}),
    ("ruby", "conn.execute(sql(a), 'DELETE FROM d')", {("sql", "write", "d")}),
    ("php", "$redis->get('a' . f(1));", {("redis", "read", "a")}),
]


def one_file(spark, language, src, name="a/x"):
    return spark.createDataFrame([(name, language, src)], "file string, language string, src string")


def test_lines(spark):
    files = spark.createDataFrame([(str(i), language, f"\n{line}\n") for i, (language, line, _) in enumerate(LINES)], "file string, language string, src string")
    found = {}
    for r in extract.boundary_events(files).collect():
        assert r.line == 2 and r.raw_context == LINES[int(r.file)][1]
        found.setdefault(int(r.file), set()).add((r.medium, r.direction, r.key_norm))
    for i, (language, line, want) in enumerate(LINES):
        assert found.get(i, set()) == want, (language, line)


def test_several_and_long_matches(spark):
    src = "redis.get('a'); redis.get('b')\nproducer.send({\n  x,\n  topic: 't' })\n\nredis.get('c')\x01 redis.get('d')"
    got = {(r.line, r.key_norm) for r in extract.boundary_events(one_file(spark, "python", src), [r for r in R.EVENT_RULES if r.name in ("redis_get", "kafka_send")]).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "t"), (6, "c"), (6, "d")}
    many = "redis.get('k')\n" * 30_000  # linear: done in seconds
    assert extract.boundary_events(one_file(spark, "python", many), [r for r in R.EVENT_RULES if r.name == "redis_get"]).agg({"line": "max"}).first()[0] == 30_000


def test_every_rule_is_matched_by_the_sources(spark):
    files = V.src_files(spark, "/root/testdata/sf0.001")
    seen = {r.rule for r in extract.boundary_events(files).select("rule").distinct().collect()}
    assert {r.name for r in (*R.CALL_RULES, *R.EVENT_RULES) if r.enabled} - seen == set()
    assert {h.framework for h in R.HINT_RULES} <= {r.framework for r in extract.entry_hints(files).select("framework").distinct().collect()}


@pytest.mark.parametrize(
    ("language", "src", "want"),
    [
        ("javascript", "class A {\n  save(x) {\n    if (x) {\n    }\n  }\n}", {("A", "class", 1), ("save", "function", 2)}),
        ("typescript", "class A {\n  private async find(x: number): Promise<T> {\n  }\n}", {("A", "class", 1), ("find", "function", 2)}),
        ("java", "class A {\n  int calc(int a) {\n    for (int i = 0; i < 1; i++) {\n    }\n  }\n}", {("A", "class", 1), ("calc", "function", 2)}),
        ("java", "class A {\n  public void run() {\n  }\n}", {("A", "class", 1), ("run", "function", 2)}),
    ],
)
def test_methods_are_symbols(spark, language, src, want):
    assert {(r.name, r.kind, r.line) for r in extract.symbols(one_file(spark, language, src)).collect()} == want


@pytest.mark.parametrize(
    ("language", "src", "want"),
    [
        ("javascript", "app.get('/a', list)", {("list", "GET", "/a", "express"), ("list", "GET", "/a", "fastify")}),
        ("python", "@app.get('/a')\n@cached\ndef f(x):\n  pass", {("f", "GET", "/a", "fastapi/flask")}),
        ("rust", '.route("/a", with_auth(post(h::f)))', {("f", "POST", "/a", "axum")}),
        ("rust", "pub async fn f(s: State<A>) {", {("f", None, None, "axum")}),
        ("php", "Route::get('/l', 'C@i');\nprotected $signature = 'x';", {("<route>", "GET", "/l", "laravel"), ("<artisan_command>", None, None, "artisan")}),
        ("java", '@GetMapping("/a") @Cached public List<A> f() {', {("f", "GET", "/a", "spring-mvc")}),
        ("ruby", "class UserProfilesController < ApplicationController\n  def show\n  end\n  def initialize\n  end\n  private\n  def secret\n  end\nend", {("user_profiles#show", None, None, "rails")}),
        ("ruby", "get '/a' => 'b#c'\nresource :b", {("b#c", "GET", "/a", "rails"), *[(f"b#{a}", v, f"/b{t}", "rails") for a, v, t in R.RESOURCE_ACTIONS if a != "index"]}),
    ],
)
def test_hints(spark, language, src, want):
    assert {(r.fn_name, r.method, r.path, r.framework) for r in extract.entry_hints(one_file(spark, language, src)).collect()} == want


def test_middleware_of_a_hint(spark):
    python = "@app.get('/a')\ndef f(u=Depends(user), d=Depends(db)):\n  pass\ndef g(u=Depends(user)):\n  pass"
    got = {(r.fn_name, r.heuristic, tuple(r.middleware)) for r in extract.entry_hints(one_file(spark, "python", python)).collect()}
    assert got == {("f", "route_decorator", ("user", "db")), ("g", "depends_fn", ("user",))}
    rust = extract.entry_hints(one_file(spark, "rust", '.route("/a", with_auth(post(f)))')).collect()
    assert [list(r.middleware) for r in rust] == [["with_auth"]]


def test_needed_texts():
    """Every match of a rule holds one of the texts without which a file isn't searched."""
    seen = set()
    for language, _, src in (*V.TEMPLATES, *V.SCOPED):
        for r in (*R.CALL_RULES, *R.EVENT_RULES):
            if r.needs and language in r.languages:
                for m in re.finditer(r.pattern, src):
                    assert any(n in m[0] for n in r.needs), (r.name, m[0])
                    seen.add(r.name)
    assert len(seen) > 30


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 4, 30])
def test_arguments_of_nested_calls(spark, depth):
    """Whether brackets nest few or many times, the last argument is the key; a call that doesn't end has none."""
    nested = "(" * depth + "a, ']'" + ")" * depth
    events = lambda src: [(r.line, r.key_raw) for r in extract.boundary_events(one_file(spark, "python", src), [r for r in R.CALL_RULES if r.name == "py_redis_set"]).collect()]
    assert events(f"x.hset(f{nested}, 'k')\nx.hset('open', (1\n") == [(1, "k")]
