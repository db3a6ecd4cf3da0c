"""Scalar functions on columns: keys, paths, SQL texts, services, hover texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave import rules as R


def normalise_key(key: Column) -> Column:
    """Interpolations and format marks become {}, as does a trailing concatenation."""
    for pattern in (r"\$\{[^}]*\}", r"\{[^}]+\}", r"%[dsfv]|%\([^)]+\)[dsfv]", r"\s*\+\s*\w+\s*\z"):
        key = F.regexp_replace(key, pattern, "{}")
    return F.trim(key)


def strip_base_url(url: Column) -> Column:
    """The path of a URL: from the first slash after the host; without a scheme, from the first slash."""
    rest = F.regexp_replace(url, r"^https?://", "")
    at = F.instr(rest, "/")
    return F.when(url.startswith("/"), url).when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit(""))


def template_path(text: Column) -> Column:
    """Template expressions become :param."""
    return F.regexp_replace(text, r"\$\{[^}]*\}", ":param")


def outgoing_path(url: Column) -> Column:
    """Path of an outgoing request: no host, no template expression, no trailing slash; null if nothing is left."""
    path = F.rtrim(strip_base_url(template_path(url)), F.lit("/"))
    return F.when(F.length(path) > 1, path)


def sql_tables(sql: Column) -> Column:
    """Lower-case table names after FROM, JOIN, UPDATE, INTO and TABLE."""
    found = F.transform(F.regexp_extract_all(sql, F.lit(R.TABLE_PATTERN), 1), F.lower)
    return F.filter(found, lambda t: ~t.isin(*R.RESERVED))


def sql_primary_table(sql: Column) -> Column:
    """The word after the first FROM, else INTO, else UPDATE, else JOIN; lower case, null without one."""
    flat = F.regexp_replace(sql, r"\s+", " ")
    after = lambda word: F.nullif(F.regexp_extract(flat, rf"(?i){word} (\S+)", 1), F.lit(""))
    return F.lower(F.regexp_replace(F.coalesce(*[after(w) for w in ("FROM", "INTO", "UPDATE", "JOIN")]), r"^\W+|\W+\z", ""))


def sql_verb(sql: Column, default: Column | None = None) -> Column:
    """read or write by the statement's first word."""
    first = F.upper(F.regexp_extract(sql, r"^\s*(\w+)", 1))
    return (
        F.when(first.isin("SELECT", "WITH"), F.lit("read"))
        .when(first.isin("INSERT", "UPDATE", "DELETE", "MERGE", "UPSERT"), F.lit("write"))
        .otherwise(F.lit("read") if default is None else default)
    )


def header_medium(key: Column) -> Column:
    """http_header for names of headers, else redis."""
    low = F.lower(key)
    return F.when(low.isin(*R.HEADER_NAMES) | low.startswith("x-"), F.lit("http_header")).otherwise(F.lit("redis"))


def strip_literal(text: Column) -> Column:
    """A Rust string literal without &, r#" "# and quotes."""
    bare = F.regexp_replace(F.trim(text), r"^&", "")
    return F.regexp_replace(F.regexp_replace(bare, r'^r#*"', ""), r'^"|"#*\z', "")


def camel_to_snake(name: Column) -> Column:
    """UserProfilesController -> user_profiles."""
    base = F.regexp_replace(name, r"Controller\z", "")
    return F.lower(F.regexp_replace(base, r"([a-z0-9])([A-Z])", "$1_$2"))


def directories(file: Column) -> Column:
    """Folder names of a path, without empty and dot parts."""
    parts = F.split(file, "/")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.isin("", ".", ".."))


def service_from_path(file: Column) -> Column:
    """Service that a file belongs to: its first folder, in deep trees the last one that isn't layout."""
    parts = directories(file)
    named = F.filter(parts, lambda p: ~p.isin(*R.LAYOUT_DIRS))
    return (
        F.when(F.size(parts) == 0, F.lit("root"))
        .when(F.size(parts) <= 2, F.get(parts, F.lit(0)))
        .otherwise(F.coalesce(F.try_element_at(named, F.lit(-1)), F.element_at(parts, -1)))
    )


def is_monolith_path(file: Column) -> Column:
    """src/services/<name>/<more> with at least four parts."""
    path = F.array_join(F.filter(F.split(file, "/"), lambda p: ~p.isin("", ".")), "/")
    return path.rlike(r"(^|/)src/services/[^/]+/[^/]+") & (F.size(F.split(path, "/")) >= 4)


def classify_hover(text: Column, medium: Column) -> Column:
    """Confirmed, Rejected or Unknown, by the type names that a hover text shows."""
    low = F.lower(text)
    any_of = lambda words: reduce(or_, [low.contains(w) for w in words], F.lit(False))
    out = None
    for name, (yes, no) in R.HOVER.items():
        verdict = F.when(any_of(yes), F.lit("Confirmed")).when(any_of(no) | any_of(R.TYPED_HOVER), F.lit("Rejected")).otherwise(F.lit("Unknown"))
        out = F.when(medium == name, verdict) if out is None else out.when(medium == name, verdict)
    return out.otherwise(F.lit("Unknown"))


def auth_bucket(path: Column, middleware: Column) -> Column:
    """Background without a path, [auth: ...] with such middleware, else Public."""
    words = F.filter(middleware, lambda m: F.exists(F.array(*[F.lit(w) for w in R.AUTH_WORDS]), lambda w: F.contains(F.lower(m), w)))
    return F.when(path.isNull(), F.lit("Background")).when(F.size(words) == 0, F.lit("Public")).otherwise(F.concat(F.lit("[auth: "), F.array_join(words, ", "), F.lit("]")))


def language_of(file: Column) -> Column:
    """Language by lower-case extension; null for others."""
    pairs = F.create_map(*[F.lit(x) for kv in R.EXTENSIONS.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.regexp_extract(file, r"\.(\w+)\z", 1)))


def server_language(file: Column) -> Column:
    """Language of a file as an editor's server names it: other extensions stand for themselves."""
    extension = F.regexp_extract(file, r"\.(\w+)\z", 1)
    named = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), extension), extension)


def symbol_column(line: Column, symbol: Column) -> Column:
    """Bytes before the first whole-word occurrence of a symbol in a line; null without one."""
    parts = F.split(line, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), symbol, F.lit(r"\E(?![A-Za-z0-9_])")), 2)
    return F.when(F.size(parts) == 2, F.octet_length(F.get(parts, F.lit(0))))


def receiver_column(line: Column, medium: Column) -> Column:
    """Bytes before the receiver of the first method call that shows a medium; null without one."""
    found = None
    for name, methods in R.RECEIVER_METHODS.items():
        # of a method only its first occurrence counts, and only behind a dot
        each = [F.when(F.regexp_extract(before, r"(\w+)\.\z", 1) != "", F.octet_length(F.regexp_replace(before, r"\w+\.\z", ""))) for m in methods for before in [F.when(line.contains(m), F.substring_index(line, m, 1))]]
        column = F.coalesce(*each)
        found = F.when(medium == name, column) if found is None else found.when(medium == name, column)
    return found


def path_to_uri(path: Column, root: str = "/") -> Column:
    """file:// with the absolute path; relative paths lie below ``root``."""
    return F.concat(F.lit("file://"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)))


def uri_to_path(uri: Column) -> Column:
    """The path of a file:// URI; null for others."""
    return F.when(uri.startswith("file://"), F.substring(uri, 8, 1 << 30))


def edge_kind(kind: Column) -> Column:
    """How the kind of an edge between spans is shown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in R.EDGE_KINDS.items() for x in kv]), kind)
