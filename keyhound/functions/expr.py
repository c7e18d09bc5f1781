"""The expression language of filters and prefilters, compiled to Spark columns.

Values are columns or, where all parts are known on the driver, Python values; lists of patterns and terms must be
known. A compiled filter that is null (a missing key, an error) doesn't skip.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import secrets as S
from . import text as T


class ExprError(ValueError):
    """An expression that can't be compiled."""


_TOKEN = re.compile(
    r"\s+|//[^\n]*|#[^\n]*|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\||&&|==|!=|<=|>=|\?\?|\?\.|\*\*|\.\.|[-+*/%<>!?:.,()\[\]{};=^])",
    re.S,
)
_BINARY = {"??": 9, "||": 2, "or": 2, "&&": 3, "and": 3, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "in": 4, "not": 4, "contains": 4, "startsWith": 4, "endsWith": 4, "matches": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "**": 7, "^": 7}


_RAW = re.compile(r"r(\"\"\"(?P<a>.*?)\"\"\"|\"(?P<b>[^\"]*)\"|'(?P<c>[^']*)')", re.S)


def _tokens(source: str) -> list[tuple[str, str]]:
    """The tokens of an expression, white space and comments left out; raw strings become quoted ones."""
    out, at = [], 0
    while at < len(source):
        raw = _RAW.match(source, at) if not at or not (source[at - 1].isalnum() or source[at - 1] == "_") else None
        if raw:
            text = next(x for x in (raw["a"], raw["b"], raw["c"]) if x is not None)
            quoted = "`" + text + "`" if "`" not in text else '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
            out.append(("str", quoted))
            at = raw.end()
            continue
        m = _TOKEN.match(source, at)
        if not m:
            raise ExprError(f"unexpected {source[at]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def _arguments(tokens: list, at: int) -> tuple[list[list], int]:
    """The arguments of a call whose opening bracket is at `at`, and the place after its closing one."""
    found, depth, at = [[]], 1, at + 1
    while at < len(tokens):
        text = tokens[at][1] if tokens[at][0] == "op" else ""
        depth += (text in ("(", "[", "{")) - (text in (")", "]", "}"))
        if not depth:
            return found, at + 1
        if text == "," and depth == 1:
            found.append([])
        else:
            found[-1].append(tokens[at])
        at += 1
    raise ExprError("a bracket isn't closed")


def current(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Older spellings as current ones: optional access and bindings. Strings stay as they are."""
    out, at = [], 0
    while at < len(tokens):
        here = [t for _, t in tokens[at : at + 4]]
        plain = tokens[at][0] != "str"
        if plain and here[:2] == [".", "?"]:
            out.append(("op", "?."))
            at += 2
        elif plain and here[:2] == ["[", "?"]:
            out.append(("op", "["))
            at += 2
        elif plain and here == ["cel", ".", "bind", "("]:
            given, at = _arguments(tokens, at + 3)
            if len(given) != 3:
                raise ExprError("bind takes a name, a value and an expression")
            name, value, body = given
            out += [("op", "("), ("name", "let"), *name, ("op", "="), *current(value), ("op", ";"), *current(body), ("op", ")")]
        else:
            out.append(tokens[at])
            at += 1
    return out


def _unquote(s: str) -> str:
    if s[0] == "`":
        return s[1:-1]
    plain = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else plain.get(m[1], m[1]), s[1:-1], flags=re.S)


class _Parser:
    def __init__(self, source: str, scope: dict[str, Any]):
        self.tokens, self.scope, self.i = [*current(_tokens(source)), ("end", "")], dict(scope), 0

    def peek(self, *texts: str) -> bool:
        return self.tokens[self.i][0] in ("op", "name") and self.tokens[self.i][1] in texts

    def take(self, *texts: str) -> str:
        kind, text = self.tokens[self.i]
        if texts and text not in texts or kind == "end":
            raise ExprError(f"expected {' or '.join(texts)}, found {text or 'the end'}")
        self.i += 1
        return text

    def parse(self) -> Any:
        value = self.sequence()
        if self.tokens[self.i][0] != "end":
            raise ExprError(f"unexpected {self.tokens[self.i][1]}")
        return value

    def sequence(self) -> Any:
        if self.peek("let"):
            self.take()
            name = self.take()
            self.take("=")
            value = self.ternary()
            self.take(";")
            had, old = name in self.scope, self.scope.get(name)
            self.scope[name] = value
            result = self.sequence()
            if had:
                self.scope[name] = old
            else:
                del self.scope[name]
            return result
        return self.ternary()

    def ternary(self) -> Any:
        value = self.binary(0)
        if self.peek("?"):
            self.take()
            a = self.ternary()
            self.take(":")
            b = self.ternary()
            return F.when(_col(value), _col(a)).otherwise(_col(b))
        return value

    def binary(self, least: int) -> Any:
        left = self.unary()
        while True:
            kind, op = self.tokens[self.i]
            rank = _BINARY.get(op, 0) if kind in ("op", "name") else 0
            if rank <= least and not (rank == least and op in ("**", "^")) or not rank:
                return left
            self.take()
            negated = op == "not"
            if negated:
                op = self.take("in", "contains", "startsWith", "endsWith", "matches")
            value = _apply(op, left, self.binary(rank))
            left = ~_col(value) if negated else value

    def unary(self) -> Any:
        if self.peek("!", "not"):
            self.take()
            return ~_col(self.unary())
        if self.peek("-"):
            self.take()
            v = self.unary()
            return -v
        return self.postfix(self.primary())

    def primary(self) -> Any:
        kind, t = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            return float(t) if re.search(r"[.eE]", t) else int(t)
        if kind == "str":
            return _unquote(t)
        if t == "(":
            value = self.sequence()
            self.take(")")
            return value
        if t == "[":
            return self.items("]")
        if t == "{":
            found = {}
            while not self.peek("}"):
                key = self.primary() if self.tokens[self.i][0] != "name" else self.take()
                self.take(":")
                found[key] = self.ternary()
                if not self.peek("}"):
                    self.take(",")
            self.take("}")
            return found
        if kind == "name":
            if t in ("true", "false", "nil", "null"):
                return {"true": True, "false": False}.get(t)
            name = t
            while self.peek(".") and (name in _MODULES):
                self.take()
                name += "." + self.take()
            if self.peek("("):
                self.take()
                return _call(name, self.items(")"), self.scope)
            if name not in self.scope:
                raise ExprError(f"unknown name {name}")
            return self.scope[name]
        raise ExprError(f"unexpected {t or 'end'}")

    def items(self, close: str) -> list:
        found = []
        while not self.peek(close):
            found.append(self.sequence())
            if not self.peek(close):
                self.take(",")
        self.take(close)
        return found

    def postfix(self, value: Any) -> Any:
        while True:
            if self.peek("[", "?."):
                if self.take() == "?.":
                    if self.peek("["):
                        continue
                    value = _index(value, self.take())
                    continue
                low = None if self.peek(":") else self.sequence()
                if self.peek(":"):
                    self.take()
                    high = None if self.peek("]") else self.sequence()
                    self.take("]")
                    value = _slice(value, low, high)
                else:
                    self.take("]")
                    value = _index(value, low)
            elif self.peek("."):
                self.take()
                name = self.take()
                if self.peek("("):
                    self.take()
                    value = _call(name, [value, *self.items(")")], self.scope)
                else:
                    value = _index(value, name)
            else:
                return value


_MODULES = {"filter", "strings", "crypto", "hex", "base64", "json", "time", "env", "validate"}


def _col(v: Any) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, list):
        return F.array(*map(_col, v))
    if isinstance(v, dict):
        raise ExprError("a map can't stand here")
    return F.lit(v)


def _index(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        if not isinstance(key, str):
            raise ExprError("keys must be known")
        if key not in value:
            raise ExprError(f"unknown key {key}")
        return value[key]
    return F.try_element_at(value, _col(key)) if isinstance(key, str) else value[key]


def _slice(value: Any, low: Any, high: Any) -> Column:
    a = _col(0 if low is None else low)
    return T.bytes_between(_col(value), a, F.octet_length(_col(value)) if high is None else _col(high))


def _apply(op: str, a: Any, b: Any) -> Any:
    if op in ("||", "or"):
        return F.coalesce(_col(a), F.lit(False)) | F.coalesce(_col(b), F.lit(False))
    if op in ("&&", "and"):
        return F.coalesce(_col(a), F.lit(False)) & F.coalesce(_col(b), F.lit(False))
    if op == "??":
        return F.coalesce(_col(a), _col(b))
    if op == "in":
        if isinstance(b, list):
            return _col(a).isin([x for x in b]) if b else F.lit(False)
        if isinstance(b, dict):
            return F.lit(a in b) if isinstance(a, str) else _col(a).isin(list(b))
        return F.coalesce(F.array_contains(F.map_keys(b), _col(a)), F.lit(False))
    if op == "matches":
        return T.matches_any(_col(a), [_known(b)])
    x, y = _col(a), _col(b)
    return {
        "==": lambda: x.eqNullSafe(y), "!=": lambda: ~x.eqNullSafe(y), "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y,
        "contains": lambda: F.contains(x, y), "startsWith": lambda: F.startswith(x, y), "endsWith": lambda: F.endswith(x, y),
        "+": lambda: F.concat(x, y) if isinstance(a, str) or isinstance(b, str) else x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y, "**": lambda: F.pow(x, y), "^": lambda: F.pow(x, y),
    }[op]()


def _known(v: Any) -> str:
    if not isinstance(v, str):
        raise ExprError("a pattern must be a string")
    return v


def _strings(v: Any) -> list[str] | None:
    return v if isinstance(v, list) and all(isinstance(x, str) for x in v) else None


def _any(f, s: Any, v: Any) -> Column:
    known = _strings(v)
    return F.lit(False) if known is None else F.coalesce(f(_col(s), known), F.lit(False))


def _path(value: Any, path: str, default: Any) -> Column:
    parts = path.split(".")
    if isinstance(value, dict):
        found = value.get(path, value.get(parts[0]))
        return _col(default) if found is None else F.coalesce(_col(found), _col(default))
    return F.coalesce(F.get_json_object(value, "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)), _col(default))


def _environment(scope: dict, name: str) -> Column:
    """A variable that the caller allows, by the scope's `__environment__`; nothing else is read."""
    return F.lit(scope.get("__environment__", {}).get(name)).cast("string")


def _call(name: str, a: list, scope: dict) -> Any:
    alias = {"matchesAny": "filter.matchesAny", "containsAny": "filter.containsAny", "findMatch": "filter.findMatch", "entropy": "filter.entropy", "failsTokenEfficiency": "filter.failsTokenEfficiency",
             "hmac_sha256": "crypto.hmacSha256", "hmac_sha1": "crypto.hmacSha1", "obfuscate": "strings.obfuscate", "env_get": "env.get",
             "url_query_escape": "strings.urlQueryEscape", "now_unix": "time.nowUnix", "unknown": "validate.unknown"}
    name = alias.get(name, name)
    if name in scope.get("__functions__", {}):
        return scope["__functions__"][name](*map(_col, a))
    known = {
        "filter.matchesAny": lambda s, v: _any(T.matches_any, s, v),
        "filter.containsAny": lambda s, v: _any(T.contains_any, s, v),
        "filter.findMatch": lambda s, p: T.find_match(_col(s), _known(p)),
        "filter.entropy": lambda s: T.byte_entropy(_col(s)),
        "orValue": lambda v, d: F.coalesce(_col(v), _col(d)),
        "get": lambda m, k, d: F.coalesce(_col(_index(m, k)), _col(d)),
        "getPath": _path,
        "len": lambda s: F.octet_length(_col(s)),
        "size": lambda s: F.octet_length(_col(s)),
        "bytes": lambda s: _col(s).cast("binary"),
        "lower": lambda s: F.lower(_col(s)),
        "upper": lambda s: F.upper(_col(s)),
        "trim": lambda s: F.btrim(_col(s), F.lit(" \t\n\r\f\x0b")),
        "max": lambda *v: F.greatest(*map(_col, v)),
        "min": lambda *v: F.least(*map(_col, v)),
        "abs": lambda v: F.abs(_col(v)),
        "int": lambda v: _col(v).cast("int"),
        "float": lambda v: _col(v).cast("double"),
        "string": lambda v: _col(v).cast("string"),
        "hasPrefix": lambda s, p: F.startswith(_col(s), _col(p)),
        "hasSuffix": lambda s, p: F.endswith(_col(s), _col(p)),
        "indexOf": lambda s, p: F.when(F.contains(_col(s), _col(p)), F.octet_length(F.substring_index(_col(s), _known(p), 1))).otherwise(F.lit(-1)),
        "lastIndexOf": lambda s, p: F.when(F.contains(_col(s), _col(p)), F.octet_length(_col(s)) - F.octet_length(F.substring_index(_col(s), _known(p), -1)) - len(_known(p).encode())).otherwise(F.lit(-1)),
        "replace": lambda s, x, y: F.replace(_col(s), _col(x), _col(y)),
        "substring": lambda s, i, *e: T.bytes_between(_col(s), _col(i), _col(e[0]) if e else F.octet_length(_col(s))),
        "strings.urlQueryEscape": lambda s: F.url_encode(_col(s)),
        "crypto.md5": lambda s: F.unhex(F.md5(_col(s))),
        "crypto.sha1": lambda s: F.unhex(F.sha1(_col(s))),
        "crypto.sha256": lambda s: F.unhex(F.sha2(_col(s), 256)),
        "crypto.hmacSha1": lambda k, m: S.hmac_sha1(_col(k), _col(m)),
        "crypto.hmacSha256": lambda k, m: S.hmac_sha256(_col(k), _col(m)),
        "strings.obfuscate": lambda s: S.obfuscate(_col(s)),
        "validate.unknown": lambda r: S.unknown(_col(_index(r, "status"))),
        "env.get": lambda k: _environment(scope, _known(k)),
        "env.getOrDefault": lambda k, d: F.coalesce(_environment(scope, _known(k)), _col(d)),
        "hex.encode": lambda s: F.lower(F.hex(_col(s))),
        "base64.encode": lambda s: F.base64(_col(s).cast("binary")),
        "base64.decode": lambda s: F.try_to_binary(_col(s), F.lit("base64")),
        "json.string": lambda s: F.regexp_extract(F.to_json(F.struct(_col(s).alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1),
        "time.nowUnix": lambda: F.unix_timestamp().cast("string"),
        "time.nowRFC3339": lambda: F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }.get(name)
    if known is None:
        raise ExprError(f"unknown function {name}")
    try:
        return known(*a)
    except TypeError as e:
        raise ExprError(f"{name}: {e}") from None


def lifted(source: str) -> tuple[str, list[float]]:
    """An expression with the numbers that something is compared with replaced by names __n0, __n1, ..., and the numbers."""
    out, numbers, compared = [], [], False
    for kind, text in current(_tokens(source)):
        if kind == "num" and compared:
            out.append(f"__n{len(numbers)}")
            numbers.append(float(text))
        else:
            out.append(text)
        compared = kind == "op" and text in ("<", "<=", ">", ">=")
    return " ".join(out), numbers


def compile_expr(source: str, scope: dict[str, Any]) -> Column:
    """A column of the expression's value; scope: what its names stand for."""
    return _col(_Parser(source, scope).parse())


def skips(source: str, scope: dict[str, Any]) -> Column:
    """Whether a filter skips a row; null doesn't."""
    return F.coalesce(compile_expr(source, scope).cast("boolean"), F.lit(False))
