"""Python's regular expressions in Java's dialect, construct by construct.

``java`` walks the parsed pattern and writes every construct so that Java's matcher finds
what Python's does: Unicode classes and borders, line ends at ``\\n`` alone, ``$`` before a
last line end.  A pattern with a construct that Java lacks has no translation.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

from textloom.functions.patterns import WS

WORD = r"\p{L}\p{N}_"
CLASSES = {C.CATEGORY_DIGIT: r"\p{Nd}", C.CATEGORY_NOT_DIGIT: r"\P{Nd}", C.CATEGORY_SPACE: WS, C.CATEGORY_NOT_SPACE: f"[^{WS}]", C.CATEGORY_WORD: WORD, C.CATEGORY_NOT_WORD: f"[^{WORD}]"}
BORDER = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
INSIDE = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
KNOWN = re.IGNORECASE | re.MULTILINE | re.DOTALL | re.VERBOSE | re.UNICODE


class _Missing(Exception):
    pass


def _char(code: int) -> str:
    return f"\\x{{{code:x}}}"


def _member(op, value) -> str:
    if op is C.LITERAL:
        return _char(value)
    if op is C.RANGE:
        return f"{_char(value[0])}-{_char(value[1])}"
    if op is C.CATEGORY:
        return CLASSES[value]
    raise _Missing


def _times(low: int, high) -> str:
    return f"{{{low},{'' if high is C.MAXREPEAT else high}}}"


def _place(where, flags: int) -> str:
    many = flags & re.MULTILINE
    return {
        C.AT_BEGINNING: r"(?:\A|(?<=\n))" if many else r"\A", C.AT_BEGINNING_STRING: r"\A",
        C.AT_END: r"(?=\n|\z)" if many else r"(?=\n?\z)", C.AT_END_STRING: r"\z",
        C.AT_BOUNDARY: BORDER, C.AT_NON_BOUNDARY: INSIDE,
    }[where]


def _cased(text: str, flags: int) -> str:
    return f"(?iu:{text})" if flags & re.IGNORECASE else text


def _one(op, value, flags: int) -> str:
    if op is C.LITERAL:
        return _cased(_char(value), flags)
    if op is C.NOT_LITERAL:
        return _cased(f"[^{_char(value)}]", flags)
    if op is C.ANY:
        return r"(?s:.)" if flags & re.DOTALL else r"[^\n]"
    if op is C.IN:
        away = value[0][0] is C.NEGATE
        inside = "".join(_member(*m) for m in value[away:])
        return _cased(f"[{'^' if away else ''}{inside}]", flags)
    if op is C.CATEGORY:
        return f"[{CLASSES[value]}]"
    if op is C.AT:
        return _place(value, flags)
    if op is C.BRANCH:
        return "(?:" + "|".join(_all(p, flags) for p in value[1]) + ")"
    if op is C.SUBPATTERN:
        group, add, drop, inside = value
        if (add | drop) & ~KNOWN:
            raise _Missing
        return ("(" if group is not None else "(?:") + _all(inside, (flags | add) & ~drop) + ")"
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inside = value
        mark = {C.MAX_REPEAT: "", C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}[op]
        return f"(?:{_all(inside, flags)}){_times(low, high)}{mark}"
    if op is C.ATOMIC_GROUP:
        return f"(?>{_all(value, flags)})"
    if op in (C.ASSERT, C.ASSERT_NOT):
        ahead, inside = value
        return f"(?{'' if ahead > 0 else '<'}{'=' if op is C.ASSERT else '!'}{_all(inside, flags)})"
    if op is C.GROUPREF:
        return _cased(f"(?:\\{value})", flags)
    raise _Missing


def _all(parts, flags: int) -> str:
    return "".join(_one(op, value, flags) for op, value in parts)


def java(pattern: str) -> str | None:
    """``pattern`` as Java writes it, or None if it has no such form."""
    parsed = _parser.parse(pattern)
    flags = parsed.state.flags
    if flags & ~KNOWN:
        return None
    try:
        return _all(parsed, flags)
    except (_Missing, KeyError):
        return None
