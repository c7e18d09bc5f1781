"""Patterns of the rule language (RE2 syntax) as patterns of Spark's rlike and regexp functions (Java syntax)."""

from __future__ import annotations

import re
from functools import lru_cache

#: Members of the POSIX classes and of the escapes that differ between the two dialects. Fixed values.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z",
    "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
SPACE = r"\t\n\f\r "
#: Case apart: ignoring it, Java would count the Kelvin sign and long s as letters of ASCII.
_BOUNDARY = r"(?-i:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_NO_BOUNDARY = r"(?-i:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
_RANGES = r"\[(?:[0-9]-[0-9]|[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9A-Za-z_])+\]"
_STARTS = re.compile(rf"(?:\((?:\?:|\?P?<\w+>)?)*(?:\\[wd]|{_RANGES}|[0-9A-Za-z_])(?![*?]|\{{0)")
_ENDS = re.compile(rf"(?:\\[wd]|{_RANGES}|(?<!\\)[0-9A-Za-z_])(?:\+|\{{[1-9]\d*(?:,\d*)?\}})?\)*\Z")


def _boundary(pattern: str, i: int) -> str:
    """A word boundary at i. Where a word character must follow, or stand before, one look to the other side is enough."""
    if not re.search(r"\(\?[A-Za-z]*i", pattern):
        if "|" not in pattern[i:] and _STARTS.match(pattern, i + 2):
            return "(?<![0-9A-Za-z_])"
        if "|" not in pattern[:i] and _ENDS.search(pattern[:i]):
            return "(?![0-9A-Za-z_])"
    return _BOUNDARY


class PatternError(ValueError):
    """A pattern that the rule language doesn't allow."""


class Translated:
    """java: the pattern for Spark; names: group name to number; groups: how many groups there are."""

    def __init__(self, java: str, names: dict[str, int], groups: int):
        self.java, self.names, self.groups = java, names, groups


@lru_cache(4096)
def translate(pattern: str) -> Translated:
    out, names, groups, i, n = ["(?d)(?u)"], {}, 0, 0, len(pattern)
    multiline = [False]
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise PatternError("trailing backslash")
            e = pattern[i + 1]
            if e.isdigit() and e != "0" or e == "k":
                raise PatternError("back-references are not allowed")
            if e == "Q":
                end = pattern.find("\\E", i + 2)
                literal = pattern[i + 2 : end if end >= 0 else n]
                out.append("".join(x if x.isalnum() else "\\" + x for x in literal))
                i = n if end < 0 else end + 2
                continue
            out.append({"b": _boundary(pattern, i), "B": _NO_BOUNDARY, "s": f"[{SPACE}]", "S": f"[^{SPACE}]", "z": r"\z", "C": "(?s:.)"}.get(e, c + e))
            i += 2
        elif c == "[":
            text, i = _class(pattern, i)
            out.append(text)
        elif c == "(":
            m = re.compile(r"\(\?(?:P?<([A-Za-z_]\w*)>|([imsU]*)(-[imsU]+)?([:)])|(<?[=!]|>|#))").match(pattern, i)
            if pattern.startswith("(?", i) and not m:
                raise PatternError(f"unknown group at {i}")
            if m and m[5]:
                raise PatternError("look-around is not allowed")
            if m and m[1]:
                groups += 1
                names[m[1]] = groups
                out.append("(")
                multiline.append(multiline[-1])
            elif m:
                on, off = m[2] or "", (m[3] or "")[1:]
                flag = "m" in on or (multiline[-1] and "m" not in off)
                shown = "".join(f for f in on if f != "U") + ("-" + off if off else "")
                out.append(f"(?{shown}{m[4]}" if shown or m[4] == ":" else "")
                if m[4] == ":":
                    multiline.append(flag)
                else:
                    multiline[-1] = flag
            else:
                groups += 1
                out.append("(")
                multiline.append(multiline[-1])
            i = m.end() if m else i + 1
        elif c == ")":
            if len(multiline) > 1:
                multiline.pop()
            out.append(c)
            i += 1
        elif c == "$":
            out.append("$" if multiline[-1] else r"\z")
            i += 1
        elif c == "+" and out[-1] in "*+?}" and len(out) > 1 and pattern[i - 1] in "*+?}" and not (i > 1 and pattern[i - 2] == "\\"):
            raise PatternError("possessive quantifiers are not allowed")
        else:
            out.append(c)
            i += 1
    return Translated("".join(out), names, groups)


def _class(p: str, i: int) -> tuple[str, int]:
    """A bracket expression from i on, and where it ends."""
    out, i = ["["], i + 1
    if p.startswith("^", i):
        out.append("^")
        i += 1
    first = True
    while i < len(p):
        c = p[i]
        if c == "]" and not first:
            return "".join([*out, "]"]), i + 1
        m = re.compile(r"\[:(\^?)(\w+):\]").match(p, i)
        if m:
            if m[2] not in POSIX:
                raise PatternError(f"unknown class {m[2]}")
            out.append(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]])
            i = m.end()
        elif c == "\\" and i + 1 < len(p):
            out.append({"s": SPACE, "S": f"[^{SPACE}]"}.get(p[i + 1], p[i : i + 2]))
            i += 2
        else:
            out.append("\\" + c if c in "[]&~^" else c)
            i += 1
        first = False
    raise PatternError("missing ]")


def joined(patterns: list[str]) -> str:
    """One Java pattern that finds any of the patterns."""
    return "|".join(f"(?:{translate(p).java})" for p in patterns)


def glob(pattern: str) -> str:
    """A shell pattern as a Java pattern for a whole string; * and ? don't cross a slash."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{body}]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + r"\z"
