"""One spelling of each pattern, rendered for the engine that runs it.

Patterns in this library are written with the plain classes ``\\b``, ``\\s``,
``\\S``, ``\\w`` and ``\\d``. Word characters and word edges are ASCII;
white space is the wide Unicode set below. Java's own ``\\b`` and ``\\s`` differ,
so they are spelled out when a pattern is handed to Spark. ``\\x{h}`` code points
mean the same in both dialects.
"""

from __future__ import annotations

# Code points of the white-space set.
SPACE_POINTS = (
    9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
SPACE_CHARS = "".join(chr(point) for point in SPACE_POINTS)
_SPACE = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_JAVA_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


#: Java asks the ranges of a class one after the other: visible ASCII is told apart before the long list.
_JAVA_SPACE = (f"[[^!-~]&&[{_SPACE}]]", f"[!-~[^{_SPACE}]]")


def _render(pattern: str, edge: str, space: tuple[str, str] = (f"[{_SPACE}]", f"[^{_SPACE}]")) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2]
        if token == r"\s":
            out.append(_SPACE if in_class else space[0])
        elif token == r"\S" and not in_class:
            out.append(space[1])
        elif token == r"\b":
            out.append(edge)
        elif pattern[i] == "\\":
            out.append(token)
        else:
            if pattern[i] == "[":
                in_class = True
            elif pattern[i] == "]":
                in_class = False
            out.append(pattern[i])
            i += 1
            continue
        i += 2
    return "".join(out)


def for_spark(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _render(pattern, _JAVA_EDGE, _JAVA_SPACE)


def for_duckdb(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _render(pattern, r"\b")
