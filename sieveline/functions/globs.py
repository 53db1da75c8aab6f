"""Globs as anchored regular expressions, path scopes and visibility, on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ALWAYS_LEFT_OUT = (".git", ".sieveline")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" else c for c in text)


def simple(glob: str) -> bool:
    """Whether a glob has but whole `**` segments, not last and not twice in a row, and
    `*`; the index can apply those alone."""
    if not glob or glob[0] == "/" or glob[-1] == "/" or re.search(r"[!?\[\]{}\\\x00\r\n]", glob):
        return False
    parts = glob.split("/")
    for before, part, last in zip([None, *parts], parts, [*[False] * (len(parts) - 1), True], strict=False):
        if part in ("", ".", "..") or ("**" in part and part != "**"):
            return False
        if part == "**" and (last or before == "**"):
            return False
    return True


def _segment(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out += _quoted(text[i])
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            body = text[i + 1 : end]
            out += "[" + ("^/" if body[0] in "!^" else "") + body[body[0] in "!^" :].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]"
            i = end
        else:
            out += _quoted(c)
        i += 1
    return out


def expanded(glob: str) -> list[str]:
    """A glob's alternatives: braces, which may hold slashes and further braces, come before
    anything else. A brace that isn't closed stands for itself."""
    i, start, depth, cuts = 0, -1, 0, []
    while i < len(glob):
        c = glob[i]
        if c == "\\":
            i += 1
        elif c == "[" and not depth and (end := glob.find("]", i + 2)) > 0:
            i = end
        elif c == "{":
            if not depth:
                start, cuts = i, [i]
            depth += 1
        elif c == "," and depth == 1:
            cuts.append(i)
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                cuts.append(i)
                bodies = [glob[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                return list(dict.fromkeys(x for body in bodies for x in expanded(glob[:start] + body + glob[i + 1 :])))
        i += 1
    return [glob]


def to_regex(glob: str) -> str:
    """An anchored pattern. Without a slash the glob is for names at any depth; with one
    it is for whole paths."""
    each = list(map(_one_regex, expanded(glob)))
    return f"^{each[0]}$" if len(each) == 1 else "^(?:" + "|".join(each) + ")$"


def _one_regex(glob: str) -> str:
    if "/" not in glob:
        return f"(?:.*/)?{_segment(glob)}"
    out, parts = "", glob.lstrip("/").split("/")
    for i, part in enumerate(parts):
        if part == "**":
            out += ".*" if i == len(parts) - 1 else "(?:[^/]+/)*"
        else:
            out += _segment(part) + ("/" if i < len(parts) - 1 else "")
    return out


def matches(path: Column, glob: str | None) -> Column:
    """Whether the glob takes the path; a leading `!` turns it round."""
    if glob is None:
        return F.lit(True)
    return ~path.rlike(to_regex(glob[1:])) if glob.startswith("!") else path.rlike(to_regex(glob))


def mandatory_literals(glob: str | None) -> list[str]:
    """Strings of two bytes and more that every path taken by a plain glob holds."""
    if glob is None or glob.startswith("!") or re.search(r"[\x00\r\n\\\[\]{}]", glob):
        return []
    return list(dict.fromkeys(x for x in re.split(r"[/*?]+", glob) if len(x.encode()) >= 2))


def in_scope(path: Column, scope: str | None) -> Column:
    """The file of this name, or all below the folder of this name."""
    scope = (scope or "").strip("/")
    if scope in ("", "."):
        return F.lit(True)
    return (path == scope) | path.startswith(scope + "/")


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def left_out(path: Column) -> Column:
    out = F.lit(False)
    for name in ALWAYS_LEFT_OUT:
        out = out | (path == name) | path.startswith(name + "/")
    return out
