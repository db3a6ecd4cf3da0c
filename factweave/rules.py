"""What is looked for in source code, as plain tables.

Patterns, word lists, confidences and labels are fixed values: results depend on
them, so they are stated as text.
"""

from __future__ import annotations

from dataclasses import dataclass

#: File extensions of each language.
EXTENSIONS = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "py": "python", "rb": "ruby", "rs": "rust", "go": "go", "java": "java", "php": "php",
}
#: Folders that are never entered, besides hidden ones.
SKIP_DIRS = (".git", ".svn", ".hg", "node_modules", "vendor", "target", "__pycache__", ".next", "dist", "build", ".cache", "coverage")

JS = ("javascript", "typescript")
ALL = tuple(dict.fromkeys(EXTENSIONS.values()))
Q = "['\"`]"  # a quote
N = "[^'\"`]"  # anything else

LEXICAL, PATTERN, SYMBOL = 0.90, 0.65, 0.95  # confidences


@dataclass(frozen=True)
class Rule:
    """One pattern: for which languages, the groups that may hold the key, and how to label it.

    direction: read, write, or how the match decides (see operators.extract.direction_of).
    never: keys that don't count. strip: the key is an expression, of which a literal loses its marks.
    A call of one of ``methods`` on what ends with ``receivers`` is looked at by its arguments, which may hold
    brackets: the key is the ``last`` one or the first; ``least`` says how many there must be, ``prefix`` what may stand before the first. For these,
    ``pattern`` states the same for arguments without brackets. A file with none of the texts ``needs``, of which every match holds one, isn't searched.
    """

    name: str
    languages: tuple[str, ...]
    pattern: str
    key: tuple[int, ...]
    medium: str
    direction: str
    confidence: float = PATTERN
    enabled: bool = True
    never: tuple[str, ...] = ()
    strip: bool = False
    receivers: str = ""
    methods: tuple[str, ...] = ()
    last: bool = True
    least: int = 1
    prefix: str = ""
    dot: str = r"\."
    needs: tuple[str, ...] = ()


#: Pattern layer: in any file unless the rule names languages.
EVENT_RULES = (
    Rule("js_env", JS, r"process\.env\.([A-Z_][A-Z0-9_]+)", (1,), "env", "read", needs=("process.env.",)),
    Rule("py_env", ("python",), r"os\.environ(?:\.get)?\s*\(\s*['\"]([^'\"]+)['\"]\)|os\.getenv\s*\(\s*['\"]([^'\"]+)['\"]\)|os\.environ\[['\"]([^'\"]+)['\"]\]", (1, 2, 3), "env", "read", needs=("os.environ", "os.getenv")),
    Rule("rb_env", ("ruby",), r"ENV\[['\"]([^'\"]+)['\"]\]|ENV\.fetch\s*\(\s*['\"]([^'\"]+)['\"]\)", (1, 2), "env", "read", needs=("ENV[", "ENV.fetch")),
    Rule("rs_env", ("rust",), r"(?:std::env|env)::var\s*\(\s*\"([^\"]+)\"\s*\)", (1,), "env", "read", needs=("env::var",)),
    Rule("redis_get", ALL, rf"(?:client|redis|cache|\br\b)\.(get|hget|lrange|smembers|zscore|zrange|type|ttl|exists)\s*\(\s*[f`]?{Q}({N}+){Q}", (2,), "redis", "read", receivers=r"(?:client|redis|cache|\br)", methods=("get", "hget", "lrange", "smembers", "zscore", "zrange", "type", "ttl", "exists"), last=False, prefix="[f`]?"),
    Rule("redis_set", ALL, rf"(?:client|redis|cache|\br\b)\.(set|hset|setex|psetex|lpush|rpush|sadd|zadd|incr|decr)\s*\(\s*[f`]?{Q}({N}+){Q}", (2,), "redis", "write", receivers=r"(?:client|redis|cache|\br)", methods=("set", "hset", "setex", "psetex", "lpush", "rpush", "sadd", "zadd", "incr", "decr"), last=False, prefix="[f`]?"),
    Rule("kafka_send", ALL, rf"producer\.send\s*\(\s*\{{[^}}]*topic:\s*{Q}({N}+){Q}", (1,), "kafka", "write", needs=("producer.send",)),
    Rule("kafka_subscribe", ALL, rf"consumer\.subscribe\s*\(\s*\{{[^}}]*topics?:\s*\[?{Q}({N}+){Q}", (1,), "kafka", "read", needs=("consumer.subscribe",)),
    Rule("kafka_produce", ALL, r"producer\.produce\s*\(\s*['\"]([^'\"]+)['\"]\s*,", (1,), "kafka", "write", needs=("producer.produce",)),
    Rule("kafka_subscribe_list", ALL, r"consumer\.subscribe\s*\(\s*\[['\"]([^'\"]+)['\"]\]", (1,), "kafka", "read", needs=("consumer.subscribe",)),
    Rule("db_query", ALL, rf"(?:db|conn|pool|client)\.(query|execute|run|raw)\s*\(\s*{Q}({N}{{5,}})", (2,), "sql", "select", needs=(".query", ".execute", ".run", ".raw")),
    Rule("prisma", ALL, r"prisma\.([a-zA-Z_][a-zA-Z0-9_]*)\.(findMany|findFirst|findUnique|create|update|upsert|delete|deleteMany|updateMany|count)", (1,), "sql", "find", needs=("prisma.",)),
    Rule("django", ALL, r"([A-Z][a-zA-Z0-9_]*)\.objects\.(filter|get|all|create|update|delete|bulk_create|first|last)", (1,), "sql", "manager", needs=(".objects.",)),
    Rule("sqlalchemy", ALL, r"(?:session|db\.session)\.(query|add|delete|merge|flush|commit)\s*\(\s*([A-Z][a-zA-Z0-9_]*)", (2,), "sql", "session", needs=("session",)),
    Rule("set_header", ALL, rf"res\.(setHeader|set)\s*\(\s*{Q}({N}+){Q}", (2,), "http_header", "write", needs=("res.set",)),
    Rule("req_header", ALL, rf"req\.headers\[{Q}({N}+){Q}\]|req\.headers\.get\s*\(\s*{Q}({N}+){Q}", (1, 2), "http_header", "read", needs=("req.headers",)),
    Rule("fetch", JS, rf"fetch\s*\(\s*{Q}(https?://[^'\"`\s]+|/[A-Za-z0-9_/\-.:]+){Q}", (1,), "http_out", "write", needs=("fetch",)),
    Rule("fetch_template", JS, r"fetch\s*\(\s*`(/[^`]+)`", (1,), "http_out", "write", needs=("fetch",)),
    Rule("proto_client", JS, rf"proto(?:Post|Get|Request)\s*(?:<[^>]*>)?\s*\(\s*{Q}(/[^'\"`\s]+){Q}", (1,), "http_out", "write", needs=("protoPost", "protoGet", "protoRequest")),
    Rule("http_client", JS, rf"\b(?:axios|api|apiClient|client|http|httpClient|request)\.(get|post|put|delete|patch)\s*\(\s*{Q}({N}+){Q}", (2,), "http_out", "write", needs=(".get", ".post", ".put", ".delete", ".patch")),
    Rule("url_const", JS, rf"(?:const|let|var)\s+\w*(?:URL|ENDPOINT|API|HOST|BASE)\w*\s*=\s*{Q}(https?://[^'\"`\s]+|/[A-Za-z0-9_/\-.:]+){Q}", (1,), "http_out", "write", needs=("URL", "ENDPOINT", "API", "HOST", "BASE")),
    Rule("rabbit_publish", ALL, rf"channel\.(?:publish|sendToQueue)\s*\(\s*{Q}({N}*){Q}\s*,\s*{Q}({N}+){Q}", (2,), "rabbitmq", "write", needs=("channel.publish", "channel.sendToQueue")),
    Rule("rabbit_consume", ALL, rf"channel\.consume\s*\(\s*{Q}({N}+){Q}", (1,), "rabbitmq", "read", needs=("channel.consume",)),
    Rule("sqs_send", ALL, rf"sqs\.sendMessage\s*\(\s*\{{[^}}]*QueueUrl:\s*{Q}({N}+){Q}", (1,), "sqs", "write", needs=("sqs.sendMessage",)),
    Rule("sqs_receive", ALL, rf"sqs\.receiveMessage\s*\(\s*\{{[^}}]*QueueUrl:\s*{Q}({N}+){Q}", (1,), "sqs", "read", needs=("sqs.receiveMessage",)),
    Rule("fs_js", ALL, rf"(?:fs|promises)\.(readFile|writeFile|appendFile|readFileSync|writeFileSync)\s*\(\s*{Q}({N}+){Q}", (2,), "filesystem", "file", needs=("fs.", "promises.")),
    Rule("prost_encode", ("rust",), r"([A-Z]\w+)\s*\{[^}]*\}\s*\.encode_to_vec\s*\(\s*\)", (1,), "grpc", "write", needs=("encode_to_vec",)),
    Rule("prost_decode", ("rust",), r"([A-Z]\w+)::decode\s*\(", (1,), "grpc", "read", never=("base64", "hex", "utf8", "str", "String", "Vec", "u8", "i64", "f64"), needs=("::decode",)),
    Rule("tonic_request", ("rust",), r"(?:tonic::)?Request::new\s*\(\s*(\w+)\s*[{\(]", (1,), "grpc", "write", needs=("Request::new",)),
    Rule("proto_encode", JS, r"(\w+)\.encode\s*\([^)]+\)\.finish\s*\(\s*\)", (1,), "grpc", "write", needs=(".encode",)),
    Rule("proto_decode", JS, r"(\w+)\.decode\s*\(\s*\w+", (1,), "grpc", "read", needs=(".decode",)),
    Rule("js_stub", JS, r"(?:client|stub|grpcClient)\s*\.\s*([A-Z][a-zA-Z]+)\s*\(", (1,), "grpc", "write", needs=("client", "stub", "grpcClient")),
    Rule("py_stub", ("python",), r"(?:stub|channel|client)\s*\.\s*([A-Z][a-zA-Z]+)\s*\(", (1,), "grpc", "write", needs=("stub", "channel", "client")),
    Rule("py_channel", ("python",), r"grpc\.(?:insecure_channel|secure_channel)\s*\(\s*['\"]([^'\"]+)['\"]", (1,), "grpc", "write", needs=("grpc.",)),
    Rule("rb_stub", ("ruby",), r"(?:stub|client)\s*\.\s*([a-z_]+(?:_call|_request)?)\s*\(", (1,), "grpc", "write", needs=("stub", "client")),
    # stated but not in use
    Rule("redis_delete", ALL, rf"(?:client|redis|cache|\br\b)\.(del|delete|unlink|expire)\s*\(\s*[f`]?{Q}({N}+){Q}", (2,), "redis", "write", enabled=False),
    Rule("gorm", ("go",), r"db\.(Create|Save|First|Find|Delete|Update|Table)\s*\(&?([A-Z][a-zA-Z0-9_]*)", (2,), "sql", "write", enabled=False),
    Rule("pubsub_publish", ALL, rf"pubsub\.topic\s*\(\s*{Q}({N}+){Q}\s*\)\.publish", (1,), "pubsub", "write", enabled=False),
    Rule("pubsub_subscribe", ALL, rf"pubsub\.subscription\s*\(\s*{Q}({N}+){Q}\s*\)", (1,), "pubsub", "read", enabled=False),
    Rule("open_py", ("python",), r"\bopen\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*\)", (1,), "filesystem", "write", enabled=False),
)


def _call(name: str, language, receivers: str, methods: str, medium: str, direction: str, dot: str = r"\.", last: bool = True) -> Rule:
    """A call ``receiver.method(..., "key")``: the key is the last argument, or (last=False) the first one."""
    names = methods.replace(" ", "|")
    quote = "['\"]" if language == JS else Q  # a template isn't a plain string
    key = rf"(?:[^()]*,\s*)?{quote}({N}+){quote}\s*,?\s*\)" if last else rf"{quote}({N}+){quote}"
    languages = language if isinstance(language, tuple) else (language,)
    return Rule(name, languages, rf"(?:{receivers}){dot}(?:{names})\s*\(\s*{key}", (1,), medium, direction, LEXICAL, receivers=receivers, methods=tuple(methods.split()), last=last, dot=dot)


#: Receivers by language and medium: fixed values.
GO_REDIS = r"\b(?:rdb|client|redis|cache|redisClient)"
JAVA_REDIS = r"\b(?:jedis|redis|redisClient|valueOps|hashOps|listOps)"
PY_REDIS = r"\b(?:r|redis|cache|conn|client|redis_client|redis_conn|pipe|pipeline)"
RB_REDIS = r"\b(?:redis|cache|r|store|client|redis_client)"
PHP_REDIS = r"\$(?:redis|cache|predis|client)"
ANY = r"\b\w+"

#: Call layer: what a syntax tree's call patterns state, matched lexically. Fixed values.
CALL_RULES = (
    _call("go_env", "go", r"\bos", "Getenv", "env", "read", last=False),
    _call("go_sql", "go", ANY, "Query QueryContext Exec ExecContext QueryRow QueryRowContext Prepare PrepareContext", "sql", "verb"),
    Rule("go_redis_get", ("go",), rf"{GO_REDIS}\.(?:Get|HGet|LRange|ZRange|Exists|TTL)\s*\([^()]*,\s*{Q}({N}+){Q}\s*,?\s*\)", (1,), "redis", "read", LEXICAL, receivers=GO_REDIS, methods=("Get", "HGet", "LRange", "ZRange", "Exists", "TTL"), least=2),
    Rule("go_redis_set", ("go",), rf"{GO_REDIS}\.(?:Set|HSet|SetEX|LPush|RPush|ZAdd|Expire)\s*\([^()]*,\s*{Q}({N}+){Q}\s*,?\s*\)", (1,), "redis", "write", LEXICAL, receivers=GO_REDIS, methods=("Set", "HSet", "SetEX", "LPush", "RPush", "ZAdd", "Expire"), least=2),
    Rule("go_grpc_decode", ("go",), r"\b(?:proto|protojson|encoding)\.(?:Unmarshal|UnmarshalText|UnmarshalJSON)\s*\([^)]*?&?(?:\w+\.)?([A-Z]\w*)\{", (1,), "grpc", "read", LEXICAL, needs=("Unmarshal",)),
    _call("java_env", "java", r"\bSystem", "getenv", "env", "read", last=False),
    _call("java_sql", "java", r"\b(?:jdbcTemplate|jdbc|db|conn|connection|namedJdbc)", "query queryForObject queryForList queryForMap update execute batchUpdate", "sql", "verb"),
    _call("java_jpa", "java", r"\b(?:entityManager|em|session)", "createQuery createNativeQuery createNamedQuery", "sql", "verb"),
    _call("java_redis_get", "java", JAVA_REDIS, "get hget lrange exists ttl", "redis", "read"),
    _call("java_redis_set", "java", JAVA_REDIS, "set hset setex lpush rpush zadd expire", "redis", "write"),
    _call("java_kafka", "java", r"\b(?:kafkaTemplate|producer|kafka)", "send", "kafka", "write"),
    _call("java_http", "java", r"\b(?:restTemplate|client|httpClient|webClient)", "getForObject getForEntity postForObject postForEntity exchange execute", "http_out", "write"),
    Rule("java_kafka_listen", ("java",), r"@KafkaListener\s*\([^)]*topics\s*=\s*\{?\s*\"([^\"]+)\"", (1,), "kafka", "read", LEXICAL, needs=("@KafkaListener",)),
    _call("js_header_set", JS, r"\b\w*(?:res|response)\w*", "setHeader set header", "http_header", "write"),
    Rule("js_header_get", JS, r"\b\w*(?:req|request)\w*\.headers\[\s*['\"]([^'\"]+)['\"]\s*\]", (1,), "http_header", "read", LEXICAL, needs=(".headers[",)),
    _call("js_redis_get", JS, ANY, "get hget del rpop lrange zrange exists ttl", "redis", "read"),
    _call("js_redis_set", JS, ANY, "set hset setex lpush rpush zadd lset expire persist", "redis", "write"),
    Rule("js_process_env", JS, r"\bprocess\.env\.(\w+)", (1,), "env", "read", LEXICAL, needs=("process.env.",)),
    _call("js_socket", JS, ANY, "emit on send", "websocket", "write"),
    Rule("js_fs", ("javascript",), r"\b(?:fs|promises)\.(readFile|writeFile|readFileSync|writeFileSync)\s*\(\s*['\"]([^'\"]+)['\"]", (2,), "filesystem", "file", LEXICAL, needs=("fs.", "promises.")),
    Rule("php_env", ("php",), rf"\b(?:getenv|env)\s*\(\s*{Q}({N}+){Q}", (1,), "env", "read", LEXICAL, needs=("env",)),
    Rule("php_db", ("php",), rf"\bDB::(?:select|insert|update|delete|statement|unprepared)\s*\(\s*{Q}({N}+){Q}", (1,), "sql", "verb", LEXICAL, needs=("DB::",)),
    Rule("php_table", ("php",), rf"\bDB::table\s*\(\s*{Q}({N}+){Q}", (1,), "sql", "read", LEXICAL, needs=("DB::table",)),
    Rule("php_sql", ("php",), rf"\$(?:pdo|db|conn|connection)->(?:query|prepare|exec)\s*\(\s*{Q}({N}+){Q}", (1,), "sql", "verb", LEXICAL, needs=("->query", "->prepare", "->exec")),
    Rule("php_facade_get", ("php",), rf"\b(?:Redis|Cache)::(?:get|hget|lrange|exists|ttl)\s*\(\s*{Q}({N}+){Q}", (1,), "redis", "read", LEXICAL, needs=("Redis::", "Cache::")),
    Rule("php_facade_set", ("php",), rf"\b(?:Redis|Cache)::(?:set|hset|setex|lpush|rpush|zadd|put|forever)\s*\(\s*{Q}({N}+){Q}", (1,), "redis", "write", LEXICAL, needs=("Redis::", "Cache::")),
    _call("php_redis_get", "php", PHP_REDIS, "get hget lrange", "redis", "read", "->", last=False),
    _call("php_redis_set", "php", PHP_REDIS, "set hset setex lpush rpush put", "redis", "write", "->", last=False),
    Rule("php_http", ("php",), rf"\bHttp::(?:get|post|put|delete|patch)\s*\(\s*{Q}({N}+){Q}", (1,), "http_out", "write", LEXICAL, needs=("Http::",)),
    Rule("php_client", ("php",), rf"\$(?:client|http|httpClient|guzzle)->(?:get|post|put|delete|request|send)\s*\(\s*(?:{Q}[A-Z]+{Q}\s*,\s*)?{Q}({N}+){Q}", (1,), "http_out", "write", LEXICAL, needs=("$client", "$http", "$guzzle")),
    _call("php_kafka", "php", r"\$(?:producer|kafka|kafkaProducer)", "produce send publish", "kafka", "write", "->", last=False),
    _call("py_environ", "python", r"\bos\.environ", "get", "env", "read"),
    _call("py_getenv", "python", r"\bos", "getenv", "env", "read"),
    _call("py_redis_get", "python", PY_REDIS, "get", "redis", "read"),
    _call("py_redis_read", "python", ANY, "hget rpop lrange zrange exists ttl", "redis", "read"),
    _call("py_redis_set", "python", ANY, "set hset setex lpush rpush zadd lset expire persist", "redis", "write"),
    _call("py_kafka", "python", ANY, "produce", "kafka", "write"),
    _call("py_cookie", "python", r"\b(?:response|resp)", "set_cookie", "cookie", "write"),
    _call("rb_env_call", "ruby", r"\bENV", "fetch dig", "env", "read"),
    _call("rb_redis_get", "ruby", RB_REDIS, "get hget lrange zrange exists ttl rpop", "redis", "read"),
    _call("rb_redis_read", "ruby", ANY, "hget lrange zrange llen scard zcard smembers sismember zscore zrank rpop", "redis", "read"),
    _call("rb_redis_set", "ruby", RB_REDIS, "set hset setex lpush rpush zadd lset expire persist del delete incr decr setnx psetex sadd", "redis", "write"),
    _call("rb_redis_write", "ruby", ANY, "hset lpush rpush zadd sadd srem zrem hincrby incrby decrby", "redis", "write"),
    Rule("rb_record_read", ("ruby",), r"\b([A-Z]\w*)\.(?:find|find_by|find_by_sql|find_or_create_by|find_or_initialize_by|first|last|all|take|where|joins|includes|eager_load|preload|order|group|having|select|count|sum|average|minimum|maximum|exists|pluck|ids|none|limit|offset|distinct|from|reorder|unscope|lock|readonly)\b", (1,), "sql", "read", LEXICAL),
    Rule("rb_record_write", ("ruby",), r"\b([A-Z]\w*)\.(?:create|insert|insert_all|upsert|upsert_all|update_all|delete_all|destroy_all|destroy_by|delete_by)\b", (1,), "sql", "write", LEXICAL),
    _call("rb_sql", "ruby", r"\b(?:connection|conn)", "execute exec_query exec_update exec_insert exec_delete select_all select_rows select_values select_value", "sql", "verb"),
    _call("rb_http", "ruby", r"\b(?:Faraday|HTTParty|RestClient|HTTP|Typhoeus|Excon)", "get post put delete patch head request", "http_out", "write"),
    _call("rb_http_client", "ruby", r"\b(?:conn|connection|client|faraday|http_client|http)", "get post put delete patch", "http_out", "write"),
    Rule("rb_job", ("ruby",), r"\b([A-Z]\w*)\.perform_async\b", (1,), "queue", "write", LEXICAL, needs=("perform_async",)),
    Rule("rb_queue_as", ("ruby",), r"\bqueue_as\s*\(?\s*:(\w+)", (1,), "queue", "write", LEXICAL, needs=("queue_as",)),
    _call("rb_kafka", "ruby", r"\b(?:producer|kafka|kafka_producer)", "produce", "kafka", "write"),
    Rule("rb_header_set", ("ruby",), r"\b(?:response|headers)\[\s*['\"]([^'\"]+)['\"]\s*\]\s*=", (1,), "http_header", "write", LEXICAL, needs=("response[", "headers[")),
    Rule("rs_env_var", ("rust",), r"\b(?:std::)?env::var\s*\(\s*\"([^\"]+)\"", (1,), "env", "read", LEXICAL, needs=("env::var",)),
    Rule("rs_sql", ("rust",), r"\b(?:query|query_as|query_scalar|query_file|query_file_as)!?\s*(?:::<[^>]*>)?\s*\(\s*(?:\w+\s*,\s*)?r?#?\"([^\"]{5,})\"", (1,), "sql", "verb", LEXICAL, needs=("query",)),
    Rule("rs_redis_read", ("rust",), r"\b\w+\.(?:hget|rpop|lrange|zrange|exists|ttl)\s*\(\s*(?:[^()]*,\s*)?([^(),]+)\)", (1,), "redis", "read", LEXICAL, strip=True, receivers=r"\b\w+", methods=("hget", "rpop", "lrange", "zrange", "exists", "ttl")),
    Rule("rs_redis_get", ("rust",), r"\b\w*(?:conn|redis|headers)\w*\.get\s*\(\s*(?:[^()]*,\s*)?([^(),]+)\)", (1,), "redis", "header", LEXICAL, strip=True, receivers=r"\b\w*(?:conn|redis|headers)\w*", methods=("get",)),
    Rule("rs_redis_set", ("rust",), r"\b\w+\.(?:set|set_ex|hset|lpush|rpush|zadd|lset|expire|persist|del)\s*\(\s*(?:[^()]*,\s*)?([^(),]+)\)", (1,), "redis", "write", LEXICAL, strip=True, receivers=r"\b\w+", methods=("set", "set_ex", "hset", "lpush", "rpush", "zadd", "lset", "expire", "persist", "del")),
)

#: Lexers: (comments, strings and other literals) of the languages. Possessive, so that no text is scanned twice.
_DOUBLE, _SINGLE, _TICK = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?', r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?", r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
_C_COMMENT = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"
_JS_REGEX = r"(?<=[=(,:\[!&|?;{}]\x20{0,3})/(?![/*])[^/\\\n]++(?:\\.[^/\\\n]*+)*+/"
_TRIPLE = r'"{3}[\s\S]*?(?:"{3}|\z)'
_LONG = _TRIPLE + "|" + _TRIPLE.replace('"', "'")
LEXERS = {
    "javascript": (_C_COMMENT, f"{_DOUBLE}|{_SINGLE}|{_TICK}|{_JS_REGEX}"),
    "typescript": (_C_COMMENT, f"{_DOUBLE}|{_SINGLE}|{_TICK}|{_JS_REGEX}"),
    "python": (rf"#[^\n]*+|(?m:^[ \t]*+)(?:{_LONG})", f"{_LONG}|{_DOUBLE}|{_SINGLE}"),  # a string that is a statement documents
    "ruby": (r"#[^\n]*+|(?m:^=begin\b[\s\S]*?(?:^=end\b|\z))", f"{_DOUBLE}|{_SINGLE}"),
    "rust": (_C_COMMENT, r'\br(?<hash>#*+)"[\s\S]*?(?:"\k<hash>|\z)|' + _DOUBLE + r"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'"),
    "go": (_C_COMMENT, _DOUBLE + "|`[^`]*+`?|" + r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'"),
    "java": (_C_COMMENT, f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}"),
    "php": (_C_COMMENT + r"|#(?!\[)[^\n]*+", r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?' + r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'?"),
}
#: Texts of which every comment holds one: a source without them has none.
COMMENT_MARKS = {
    **dict.fromkeys(("javascript", "typescript", "rust", "go", "java"), ("//", "/*")), "python": ("#", '"' * 3, "'" * 3), "ruby": ("#", "=begin"), "php": ("//", "/*", "#"),
}
#: Marks of blocks and statements; in Ruby words that open or close a block.
BRACKETS = r"[(){}\[\];]"
RUBY_BLOCKS = (
    r"(?:^|[;=(]|\b(?:private|public|protected|private_class_method)\s)\s*(?:(?:while|until|for)\b[^;]*+|(?:if|unless|case|begin|class|module)\b|def\b(?!\s+[\w.?!]+(?:\([^)]*\))?\s*=\s))"
    r"|(?<![.:\w])do\b|(?<![.:\w])end\b(?!:)"
)
#: A Ruby method that is one expression and has no end.
RUBY_ENDLESS = r"^\s*def\s+[\w.?!]+(?:\([^)]*\))?\s*=\s"

#: Parameters: brackets may hold one more level of brackets, but no function.
_PARAMS = r"\((?![^{]*(?:\bfunction\b|=>))(?:[^()]|\([^()]*\))*\)"
_TS_MODIFIERS = r"(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*"
#: (language, kind, pattern of a line without comments and strings, what counts as exported)
SYMBOL_RULES = (
    ("javascript", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)", "export"),
    ("javascript", "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>)", "export"),
    ("javascript", "class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", "export"),
    ("javascript", "function", r"^\s+(?:(?:static|async|get|set)\s+)*\*?\s*(\w+)\s*" + _PARAMS + r"\s*\{", "export"),
    ("typescript", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)", "export"),
    ("typescript", "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::\s*[\w<>\[\]]+\s*)?=>|\w+\s*=>)", "export"),
    ("typescript", "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|type|enum)\s+(\w+)", "export"),
    ("typescript", "function", r"^\s+(?:(?:public|protected)\s+)?abstract\s+(?:async\s+)?(\w+)\s*(?:<[^>]*>)?" + _PARAMS + r"[^{}]*;", "export"),
    ("typescript", "function", r"^\s+" + _TS_MODIFIERS + r"\*?\s*(\w+)\s*(?:<[^>]*>)?" + _PARAMS + r"\s*(?::\s*[\w<>\[\], |.]+\s*)?\{", "export"),
    ("python", "function", r"^\s*(?:async\s+)?def\s+(\w+)", "public"),
    ("python", "class", r"^\s*class\s+(\w+)", "public"),
    ("ruby", "function", r"^\s*(?:(?:private|public|protected|private_class_method)\s+)?def\s+(?:self\.)?(\w+)", "public"),
    ("ruby", "class", r"^\s*(?:class|module)\s+(\w+)", "public"),
    ("rust", "function", r"^\s*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*fn\s+(\w+)", "pub"),
    ("rust", "class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:struct|enum|trait)\s+(\w+)", "pub"),
    ("go", "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "upper"),
    ("go", "class", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)", "upper"),
    ("java", "function", r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)+(?:<[^>]*>\s*)?(?!new\b)[A-Za-z_][\w<>\[\], .?]*\s+(\w+)\s*\(", "always"),
    ("java", "function", r"^\s+(?:@\w+(?:\([^)]*\))?\s+)*(?:<[^>]*>\s*)?(?!(?:public|private|protected|new|return|else|throw|assert|yield)\b)[A-Za-z_][\w<>\[\],.?]*\s+(\w+)\s*" + _PARAMS + r"\s*(?:throws\s+[\w, .]+)?\{", "always"),
    ("java", "class", r"^\s*(?:(?:public|private|protected|static|abstract|final|sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)", "always"),
    ("php", "function", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?\s*(\w+)", "always"),
    ("php", "class", r"^\s*(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum)\s+(\w+)", "always"),
)
NOT_DEFINED = ("if", "for", "while", "switch", "return", "catch", "function", "new", "else", "do", "try", "with", "super", "await", "typeof", "throw", "synchronized")
#: A name before a bracket, and words that aren't callees; what a Java annotation or constructor or a Rust attribute names isn't called either.
CALL_PATTERN = r"\b(\w+)\s*\("
NOT_CALLED = ("if", "for", "while", "switch", "return", "catch", "def", "function", "func", "fn", "class", "super", "elif", "and", "or", "not", "in", "await", "new", "print", "match", "pub", "import", "async")
NOT_CALLS = {"java": r"@\w+\s*\(|^\s*(?:public|private|protected)\s+\w+\s*\(", "rust": r"#!?\[[^\]]*\]"}
#: Go's imports in brackets, and each one in there.
GO_IMPORTS, GO_IMPORT = r"(?m)^import\s*\([^)]*\)", r"^\s*(?:[\w.]+\s+)?\"([^\"]+)\""
IMPORT_RULES = (
    (JS, rf"^\s*(?:import|export)\s[^'\"`]*{Q}({N}+){Q}"),
    (JS, rf"\brequire\s*\(\s*{Q}({N}+){Q}"),
    (("python",), r"^\s*(?:import|from)\s+([\w.]+)"),
    (("ruby",), rf"^\s*require(?:_relative)?\s+{Q}({N}+){Q}"),
    (("rust",), r"^\s*use\s+([\w:]+)"),
    (("go",), r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\""),
    (("java",), r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    (("php",), r"^use\s+([\w\\]+)"),
)
EXTENDS_RULES = (
    ((*JS, "java", "php"), r"\bclass\s+(\w+)[^{]*?\bextends\s+([\w.\\]+)"),
    (("python",), r"^\s*class\s+(\w+)\s*\(\s*([\w.]+)"),
    (("ruby",), r"^\s*class\s+(\w+)\s*<\s*([\w:]+)"),
    (("rust",), r"^\s*impl\s+(\w+)\s+for\s+(\w+)"),
)

#: A call of one of some methods ({} stands for them), and so many characters after its bracket.
CALL_SITE, CALL_SPAN = r"(?<![\w$])(?:\$?\w++(?:\.|->))?\$?\w++(?:\.|->)(?:{})\s*\(", 1000
#: Pieces of arguments: strings, brackets, commas, anything else.
ARGUMENT_PIECES = rf"{_DOUBLE}|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'|{_TICK}|[(){{}}\[\],]|[^'\"`(){{}}\[\],]++|[\s\S]"
#: From a call's opening bracket to its end, for calls whose arguments hold two levels of brackets at most; pieces as above.
_FLAT = rf"{_DOUBLE}|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'|{_TICK}|[^'\"`(){{}}\[\]]++|'"
_NESTED = rf"[(\[{{](?:{_FLAT})*+[)\]}}]"
CALL_END = rf"\A(?:{_FLAT}|[(\[{{](?:{_FLAT}|{_NESTED})*+[)\]}}])*+[)\]}}]"

VERBS = "get|post|put|delete|patch"


@dataclass(frozen=True)
class Hint:
    """An entry point: groups of method, path, function and guarding wrapper in the pattern, 0 where there is none.

    name: the function's name where the pattern has none.
    """

    languages: tuple[str, ...]
    framework: str
    pattern: str
    method: int
    path: int
    fn: int
    confidence: float
    heuristic: str = "route_decorator"
    kind: str = "route"
    name: str = "<route>"
    guard: int = 0


HINT_RULES = (
    Hint(JS, "express", rf"(?:app|router)\.({VERBS}|use)\s*\(\s*{Q}({N}+){Q}\s*,\s*(\w+)", 1, 2, 3, 0.90),
    Hint(JS, "fastify", rf"(?:fastify|server|app)\.({VERBS})\s*\(\s*{Q}({N}+){Q}\s*,\s*(?:async\s+)?(?:function\s+)?(\w+)", 1, 2, 3, 0.90),
    Hint(("python",), "fastapi/flask", rf"@(?:app|router|blueprint)\.({VERBS}|route)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)[\s\S]{{0,100}}?(?:async\s+)?def\s+(\w+)", 1, 2, 3, 0.90),
    Hint(("python",), "django", r"(?:path|re_path)\s*\(\s*r?['\"]([^'\"]+)['\"]\s*,\s*(\w+)", 0, 1, 2, 0.88),
    Hint(("python",), "celery", r"@(?:app\.task|celery\.task|shared_task)[^\n]*\n(?:async\s+)?def\s+(\w+)", 0, 0, 1, 0.85, "cron", "cron"),
    Hint(("ruby",), "rails", rf"\b({VERBS})\s+[\"']([^\"']+)[\"']\s*(?:,\s*to:|=>)\s*[\"']([^\"'#]+#\w+)[\"']", 1, 2, 3, 0.90),
    Hint(("rust",), "actix/rocket", rf"#\[({VERBS})\s*\(\s*\"([^\"]+)\"\s*\)\s*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", 1, 2, 3, 0.90),
    Hint(("rust",), "axum", rf"\.route\s*\(\s*\"([^\"]+)\"\s*,\s*({VERBS}|head|options)\s*\(\s*(?:\w+::)*(\w+)\s*\)", 2, 1, 3, 0.90),
    Hint(("rust",), "axum", rf"\.route\s*\(\s*\"([^\"]+)\"\s*,\s*(\w+)\s*\(\s*({VERBS}|head|options)\s*\(\s*(?:\w+::)*(\w+)\s*\)", 3, 1, 4, 0.90, guard=2),
    Hint(("go",), "net/http", r"http\.HandleFunc\s*\(\s*\"([^\"]+)\"\s*,\s*(\w+)\s*\)", 0, 1, 2, 0.90),
    Hint(("go",), "gin/chi/echo/fiber", r"\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*\"([^\"]+)\"\s*,\s*(?:\w+\.)*(\w+)\s*\)", 1, 2, 3, 0.90),
    Hint(("java",), "spring-mvc", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?\"([^\"]*)\"\s*\)[^{]*?(?:public|protected)\s+\S+\s+(\w+)\s*\(", 1, 2, 3, 0.90),
    Hint(("java",), "spring-kafka", r"@KafkaListener\s*\([^)]*topics\s*=\s*\"([^\"]*)\"[^)]*\)[^{]*?(?:public|protected)\s+\S+\s+(\w+)\s*\(", 0, 1, 2, 0.90, "kafka_listener", "cron"),
    Hint(("php",), "laravel", rf"Route::({VERBS}|any|match)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2, 0, 0.90, "route_facade"),
    Hint(("php",), "artisan", r"protected\s+\$signature\s*=", 0, 0, 0, 0.85, "artisan_signature", "cron", "<artisan_command>"),
)
#: A Rust function with one of these parameter types handles requests.
EXTRACTOR_PATTERN = r"fn\s+(\w+)\s*\([^)]*\b(?:State|Extension|Json|Path|Query|Form|Multipart)\b[^)]*\)"
#: A Python function whose parameters are injected, and each such injection.
DEPENDS_PATTERN, DEPENDS_NAME = r"def\s+(\w+)\s*\([^)]*Depends\s*\(\s*(\w+)\s*\)[^)]*\)", r"Depends\s*\(\s*(\w+)\s*\)"
#: A Rails controller, its class and its actions; what follows the first private mark isn't an action.
CONTROLLER_CLASS, ACTION_PATTERN, PRIVATE_MARK = r"class\s+(?:\w+::)*(\w+)\s*<\s*[\w:]+", r"(?m)^\s*def\s+(\w+)", r"\n(?:  )?private"
NOT_ACTIONS = ("initialize", "new", "helper_method")
#: Text that marks a program's start: (language, text, confidence).
MAIN_MARKS = (("python", "if __name__", 0.80), ("rust", "fn main(", 0.95), ("go", "func main(", 0.95), ("java", "public static void main", 0.95))
#: Names of middleware that a file installs: (languages, pattern).
MIDDLEWARE_RULES = (
    (JS, rf"(?:router|app)\.use\s*\(\s*{Q}[^'\"`]*{Q}\s*,\s*(\w+)\s*,"),
    (("typescript",), r"@UseGuards\s*\(\s*(\w+)"),
    (("ruby",), r"before_action\s+:(\w+)"),
)
#: resources :name gives these: (action, verb, path after the name); `resource` has no index.
RESOURCE_ACTIONS = (("index", "GET", ""), ("show", "GET", "/:id"), ("new", "GET", "/new"), ("create", "POST", ""), ("edit", "GET", "/:id/edit"), ("update", "PATCH", "/:id"), ("destroy", "DELETE", "/:id"))

#: Substrings that count as exports and imports of a file: language -> (exports, imports).
META_COUNTS = {
    "python": (("def ",), ("import ", "from ")), "go": (("\nfunc ",), ("import ",)), "java": (("public ",), ("import ",)),
    "javascript": (("export ",), ("import ", "require(")), "typescript": (("export ",), ("import ",)), "ruby": (("def ",), ("require",)),
    "rust": (("pub fn ", "pub struct "), ("use ",)), "php": (("public function ", "function "), ("use ", "require")),
}

#: Words that a table name is not.
RESERVED = ("select", "from", "where", "join", "on", "and", "or", "null", "true", "false", "not", "in", "as", "by")
TABLE_PATTERN = r"(?i)\b(?:FROM|JOIN|UPDATE|INTO|TABLE)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
#: Header names that a key-value read may really be, besides names that begin with x-.
HEADER_NAMES = (
    "authorization", "content-type", "content-length", "accept", "accept-language", "accept-encoding", "cache-control", "connection",
    "host", "origin", "referer", "user-agent", "cookie", "set-cookie", "location", "etag", "if-none-match", "if-modified-since",
    "last-modified", "vary", "access-control-allow-origin",
)
#: Layout folders that don't name a service.
LAYOUT_DIRS = (
    "src", "lib", "app", "test", "tests", "spec", "pkg", "internal", "cmd", "bin", "scripts", "utils", "helpers", "handlers", "services",
    "controllers", "routes", "middleware", "views", "models", "serializers", "resolvers", "api", "backend", "auth", "data", "hooks", "screens",
    "navigation", "context", "store", "components", "static", "public", "assets", "dist", "build",
)
#: Texts in Rust sources that show a gRPC transport.
TRANSPORT_MARKS = ("tonic::transport::Server", "tonic::transport::Channel", "tonic::Request::new", ".serve_with_incoming")
#: Type names that confirm or reject an event of a medium when an editor's hover text shows them.
HOVER = {
    "redis": (
        ("redis", "ioredis", "redisclient", "connectionpool", "strictredis"),
        ("map<", "dict[", "hashmap<", "btreemap<", "object", "any", "pgrow", "sqliterow", "mysqlrow", "row", "pgpool", "headermap", "value", "jsonvalue", "serde_json", "urlsearchparams", "string", "number", "boolean", "undefined", "null", "import", "function", "array", "promise"),
    ),
    "kafka": (("kafka", "producer", "consumer", "kafkaclient"), ()),
    "sql": (("prisma", "pool", "connection", "querybuilder", "sequelize", "typeorm", "db", "database"), ()),
    "http_header": (("request", "response", "incomingmessage", "serverresponse", "headers", "headermap", "http"), ("redis", "map<", "dict[", "pgrow", "sqliterow", "value")),
    "grpc": (("grpc", "tonic", "protobuf", "prost", "request", "response", "stub"), ()),
}
TYPED_HOVER = ("```rust", "```typescript", "```python")
VERIFIABLE = ("redis", "kafka", "sql", "http_header")
AUTH_WORDS = ("auth", "lp_auth", "admin")
#: Files that mark a workspace's folder, by language; and methods whose receiver is looked up, by medium: fixed values.
MANIFESTS = {"rust": ("Cargo.toml",), "typescript": ("tsconfig.json", "package.json"), "javascript": ("tsconfig.json", "package.json"), "python": ("pyproject.toml", "setup.cfg", "setup.py", "requirements.txt")}
RECEIVER_METHODS = {
    "redis": ("get(", "set(", "hget(", "hset(", "del(", "setex(", "lpush("), "kafka": ("send(", "produce(", "subscribe(", "publish("),
    "sql": ("query(", "execute(", "findMany(", "findFirst(", "create("), "http_header": ("setHeader(", "header(", "set(", "get("),
}
#: Kinds of edges between spans of a trace, as shown.
EDGE_KINDS = {"Root": "root", "Call": "call", "DataFlow": "data_flow", "BoundaryFlow": "boundary_flow"}
