"""The four path-pattern languages, translated to regular expressions that Java, RE2 and Python read alike.

Each translator reads the pattern once, component by component.  The expressions match whole paths: they
begin with ``\\A`` and end with ``\\z`` (Python: ``\\Z``).
"""

from __future__ import annotations

import re

_SPECIAL = frozenset(r".^$*+?{}[]\|()-&~# ")
NEVER = r"\A[^\s\S]\z"


def quote(char: str) -> str:
    return "\\" + char if char in _SPECIAL else char


def _component(text: str, keep_hash: bool = True) -> str:
    """One path component of dialects 1 and 4: stars and question marks stay inside it, a backslash makes them literal."""
    out, chars = [], iter(text)
    for c in chars:
        if c == "\\":
            nxt = next(chars, "")
            out.append((quote("\\") if nxt == "#" and keep_hash else "") + (quote(nxt) if nxt else ""))
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or quote(c))
    return "".join(out)


def rule_regex(pattern: str) -> str:
    """Dialect 1: rule files.  A pattern without an inner slash floats; a name covers its contents; ``dir/*`` covers direct children only."""
    only_stars = pattern.lstrip("/") not in ("", "**") and not pattern.replace("/", "").replace("**", "")
    body = pattern.strip("/")
    if not body or "***" in pattern or only_stars:
        return NEVER
    names = body.split("/")
    floats = not pattern.startswith("/") and len(names) == 1
    head = "".join("(?:[^/]+/)*" if n == "**" else ("[^/]+/" if n == "*" else _component(n) + "/") for n in names[:-1])
    last = names[-1]
    if last == "**":
        tail = ".*"
    else:
        tail = "[^/]+" if last == "*" else _component(last)
        if pattern.endswith("/"):
            tail += "/.+"
        elif last != "*" and not tail.endswith(".*"):
            tail += "(?:/.*)?"
    return r"\A" + ("(?:[^/]+/)*" if floats else "") + head + tail + r"\z"


def rule_supported(pattern: str) -> bool:
    return pattern[:1] != "!" and not set(pattern) & set("[]")


def exclude_regex(pattern: str) -> str:
    """Dialect 3: shell globs over the whole path; ``*`` crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] in ("!", "]")))) > 0:
            inner = pattern[i:end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else "\\" + inner if inner[0] in "^[" else inner) + "]")
            i = end + 1
        else:
            out.append(quote(c))
    return r"\A(?s:" + "".join(out).replace("\\\\", "/") + r")\z"


def target_regex(pattern: str) -> str:
    """Dialect 2: user targets.  As dialect 3, and a bare directory covers what is below it."""
    bare = pattern.rstrip("/")
    below = "".join(map(quote, bare)) + "/.*"
    return "(?:" + exclude_regex(pattern) + r"|\A(?s:" + below + r")\z" + ")" if bare else exclude_regex(pattern)


def attribute_regex(pattern: str) -> str:
    """Dialect 4: attribute files.  Floats unless anchored; a directory does not imply its contents."""
    body = pattern.rstrip("/")
    anchored = "/" in body
    names = body.lstrip("/").split("/")
    if not body.strip("/"):
        return NEVER
    head = "".join("(?:[^/]+/)*" if n == "**" else _component(n, False) + "/" for n in names[:-1])
    tail = ".*" if names[-1] == "**" else _component(names[-1], False)
    return r"\A" + ("" if anchored else "(?:[^/]+/)*") + head + tail + r"\z"


def matches(regex: str, path: str) -> bool:
    return re.search(regex.replace(r"\z", r"\Z"), path) is not None
