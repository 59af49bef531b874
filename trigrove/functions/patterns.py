"""What a regular expression's matches must contain: literal trigrams for candidate search.

Nothing is required unless it is certain.  A construct that this planner does
not know, or that changes what characters mean (inline flags, quotations,
character codes, nested or oddly closed classes), makes it give up: the search
then scans, and loses nothing.
"""

from __future__ import annotations

import re

from . import trigrams

_SPECIAL = set(".*+?|()[]{}^$\\")
#: Escapes that stand for a class, a place or one character, wherever they are.
_PLAIN_ESCAPES = set("dDwWsShHvVbBAzZGRtnrfae")
_GROUPS = ("(?:", "(?=", "(?!", "(?<=", "(?<!", "(?>")


class _Unknown(Exception):
    """The pattern has something that isn't understood."""


def _escape(pattern: str, at: int, plain: set[str] = _PLAIN_ESCAPES) -> int:
    """Where the escape that begins at ``at`` ends."""
    if at + 1 >= len(pattern):
        raise _Unknown
    c = pattern[at + 1]
    if c in plain or (c.isascii() and not c.isalnum()):
        return at + 2
    raise _Unknown


def _class(pattern: str, at: int) -> int:
    """Where the class that begins at ``at`` ends."""
    at += 1
    if pattern[at : at + 1] == "^":
        at += 1
    if pattern[at : at + 1] == "]":
        raise _Unknown
    while at < len(pattern):
        c = pattern[at]
        if c == "]":
            return at + 1
        if c == "[" or pattern[at : at + 2] == "&&":
            raise _Unknown
        at = _escape(pattern, at, set("dDwWsStnrf")) if c == "\\" else at + 1
    raise _Unknown


def _group(pattern: str, at: int) -> int:
    """Where the group that begins at ``at`` ends."""
    depth = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at = _escape(pattern, at)
        elif c == "[":
            at = _class(pattern, at)
        elif c == "(":
            if pattern[at + 1 : at + 2] == "?" and not pattern.startswith(_GROUPS, at):
                raise _Unknown
            depth += 1
            at += 1
        elif c == ")":
            depth -= 1
            at += 1
            if not depth:
                return at
        else:
            at += 1
    raise _Unknown


_REPEAT = re.compile(r"\{\d+(?:,\d*)?\}")


def _runs(pattern: str) -> list[str]:
    runs: list[str] = []
    run = ""
    at = 0
    while at < len(pattern):
        c = pattern[at]
        if c not in _SPECIAL:
            run += c
            at += 1
            continue
        if c in "?*{":
            run = run[:-1]
        runs.append(run)
        run = ""
        if c == "|":
            return []
        if c == "\\":
            at = _escape(pattern, at)
        elif c == "(":
            at = _group(pattern, at)
        elif c == "[":
            at = _class(pattern, at)
        elif c == "{":
            m = _REPEAT.match(pattern, at)
            if m is None:
                raise _Unknown
            at = m.end()
        elif c in ")]}":
            raise _Unknown
        else:
            at += 1
    return [r for r in [*runs, run] if r]


def literals(pattern: str) -> list[str]:
    """Runs of plain characters that every match holds.

    Groups, classes and escapes end a run and give none; so does a character
    that a quantifier makes optional.  A top-level alternative gives nothing,
    since no run is then required, and neither does a pattern with anything
    that isn't understood.
    """
    try:
        return _runs(pattern)
    except _Unknown:
        return []


def required_trigrams(pattern: str) -> list[str]:
    found: dict[str, None] = {}
    for run in literals(pattern):
        if "\n" not in run and len(run.encode()) <= trigrams.MAX_LINE:
            found |= dict.fromkeys(trigrams.of_query(run))
    return list(found)[: trigrams.MAX_TRIGRAMS]
