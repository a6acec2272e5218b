"""Small builders of SQL expressions shared by the native operators."""

from __future__ import annotations

#: The six ASCII white-space characters, as an SQL string literal.
WS = r"' \t\n\u000B\u000C\r'"
WORD_GAP = r"'[\\x20\\x09-\\x0D]+'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def trimmed(text: str) -> str:
    return f"trim(BOTH {WS} FROM {text})"


def words(text: str) -> str:
    """Array of the maximal runs of other characters than ASCII white space."""
    return let("tt", trimmed(text), f"if(tt = '', cast(array() as array<string>), split(tt, {WORD_GAP}))")


def count_of(chars: str, text: str) -> str:
    """How many characters of ``text`` are among ``chars``."""
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"
