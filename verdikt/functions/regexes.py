"""Patterns in the dialect of the JVM: Unicode classes and Unix lines, as the patterns' authors mean them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def searched(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the pattern occurs; false for NULL."""
    return F.coalesce(text.rlike(translated(pattern, ignore_case)), F.lit(False))


def matched(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the pattern matches from the start."""
    flags, body = split_flags(pattern)
    return searched(text, f"{flags}\\A(?:{body})", ignore_case)


def split_flags(pattern: str) -> tuple[str, str]:
    m = re.match(r"\(\?[aiLmsux]+\)", pattern)
    return (m[0], pattern[m.end() :]) if m else ("", pattern)


def translated(pattern: str, ignore_case: bool = False) -> str:
    """Flags of the dialect first; named groups, \\Z and nested brackets rewritten."""
    re.compile(pattern)
    flags, body = split_flags(pattern)
    letters = set(flags[2:-1]) & set("imsx") | {"U", "d"} | ({"i"} if ignore_case else set())
    body = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", body)
    body = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', '')}>", body)
    body = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", body)
    out, inside, k = [], False, 0
    while k < len(body):
        c = body[k]
        if c == "\\" and k + 1 < len(body):
            out.append(body[k : k + 2])
            k += 2
            continue
        if inside and (c == "[" or body[k : k + 2] == "&&"):
            out.append("\\" + c)
        else:
            out.append(c)
        if c == "[" and not inside:
            inside = True
            if body[k + 1 : k + 2] == "^":
                out.append("^")
                k += 1
            if body[k + 1 : k + 2] == "]":
                out.append("\\]")
                k += 1
        elif c == "]" and inside:
            inside = False
        k += 1
    return f"(?{''.join(sorted(letters))})" + "".join(out)
