"""Configurations as a command handles them: where they come from, what they say, whether they can be used."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import functions as F

from keyhound.functions.expr import compile_expr

from . import rules
from .rules import Config, ConfigError

VERSION = "1.0.0"
ENV_PATH, ENV_TEXT, FILE = "KEYHOUND_CONFIG", "KEYHOUND_CONFIG_TOML", ".keyhound.toml"


def located(flag: str = "", target: str = "", env: Mapping[str, str] | None = None) -> tuple[str, str]:
    """(kind, value): the first of a given path, a path and a text in the environment, a file in the target; or the default.

    kind is path, text or default; value the path or the text.
    """
    env = os.environ if env is None else env
    if flag or env.get(ENV_PATH):
        return "path", flag or env[ENV_PATH]
    if env.get(ENV_TEXT):
        return "text", env[ENV_TEXT]
    if target and (at := Path(target, FILE)).is_file():
        return "path", str(at)
    return "default", ""


def resolved(flag: str = "", target: str = "", env: Mapping[str, str] | None = None) -> Config:
    """The configuration of located(). One from a path isn't scanned itself."""
    kind, value = located(flag, target, env)
    if kind == "path":
        return rules.load(value, rules.DEFAULT)
    return rules.parse(value, rules.DEFAULT) if kind == "text" else rules.default_config()


def _version(text: str) -> tuple[tuple[int, ...], bool, list]:
    m = re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", text)
    if not m:
        raise ConfigError(f"invalid minVersion {text!r}")
    pre = [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in (m[4] or "").split(".") if p]
    return tuple(int(x) for x in m.groups()[:3]), not pre, pre


def warnings(config: Config, version: str = VERSION) -> list[str]:
    """What may be wrong with a configuration that can be used: it asks for a later version."""
    if config.min_version and _version(version) < _version(config.min_version):
        return [f"the configuration asks for version {config.min_version}, this is {version}"]
    return []


def checked(config: Config, functions: dict | None = None) -> tuple[int, int]:
    """(rules with validation, rules without); compiles every filter. Needs a session; patterns are checked on loading."""
    text = {k: F.lit("x") for k in ("secret", "match", "line", "rule_id", "description", "entropy", "fragment_raw")}
    finding = text | {k: F.lit(0) for k in ("match_start_idx", "match_end_idx")}
    attributes = F.create_map(F.lit("path"), F.lit("a.txt"))
    parts = [("prefilter", config.prefilter, {"attributes": attributes})]
    scope = {"attributes": attributes, "finding": finding, "__functions__": {"filter.failsTokenEfficiency": lambda s: F.lit(False)} | (functions or {})}
    parts += [("filter", config.filter, scope), *((f"{r.id}: filter", r.filter, scope) for r in config.rules.values())]
    for where, source, names in parts:
        if source:
            try:
                compile_expr(source, names)
            except ValueError as e:
                raise ConfigError(f"{where}: {e}") from None
    n = sum(bool(r.validate) for r in config.rules.values())
    return n, len(config.rules) - n


def _value(v) -> str:
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")
    if isinstance(v, bool):
        return str(v).lower()
    return "[" + ", ".join(map(_value, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


def rendered(config: Config) -> str:
    """The resolved configuration as TOML; parse() of it gives the same rules."""
    lines = [f"{k} = {_value(v)}" for k, v in (("title", config.title), ("minVersion", config.min_version), ("prefilter", config.prefilter), ("filter", config.filter)) if v]
    for r in sorted(config.rules.values(), key=lambda r: r.id):
        said = {"id": r.id, "description": r.description, "regex": r.regex, "path": r.path, "secretGroup": r.secret_group, "keywords": r.keywords, "tags": r.tags, "skipReport": r.skip_report, "filter": r.filter, "validate": r.validate}
        lines += ["", "[[rules]]", *(f"{k} = {_value(v)}" for k, v in said.items() if v), f"specificity = {r.specificity}"]
        for q in r.required:
            near = {"id": q.rule_id, "withinLines": q.within_lines, "withinColumns": q.within_columns}
            lines += ["[[rules.required]]", *(f"{k} = {_value(v)}" for k, v in near.items() if v is not None)]
    return "\n".join(lines) + "\n"
