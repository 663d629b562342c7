"""Portable regular expressions.

The screening rules were written for Python's ``re`` module, whose ``\\s``,
``\\w`` and ``\\d`` are Unicode-aware and whose IGNORECASE folds Unicode.
Java's regex engine (Spark) and RE2 (DuckDB, used as the test oracle) treat
the same escapes as ASCII-only.  ``portable`` rewrites the three escapes into
explicit Unicode classes that mean the same thing in all three engines, so a
rule gives the same answer whichever engine evaluates it.
"""

from __future__ import annotations

# Whitespace as Python's str.isspace() sees it: ASCII \t..\r, the four
# information separators, NEL and every Unicode separator (Zs, Zl, Zp).
_SPACE_BODY = r"\t-\r\x1c-\x1f \x{85}\p{Z}"
SPACE = "[" + _SPACE_BODY + "]"
NON_SPACE = "[^" + _SPACE_BODY + "]"
# Python's \w on str: letters, numbers (incl. superscripts) and underscore.
WORD = r"[\p{L}\p{N}_]"
# Python's \d on str: any decimal digit.
DIGIT = r"\p{Nd}"
# str.isalnum() over a whole value (\z, not $: Java's $ also matches before a
# final line break).
ALNUM_ONLY = r"^[\p{L}\p{N}]+\z"

_ESCAPES = {"s": SPACE, "w": WORD, "d": DIGIT}


def portable(pattern: str) -> str:
    """Rewrite ``\\s``, ``\\w`` and ``\\d`` outside character classes."""
    out = []
    i = 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if not in_class and nxt in _ESCAPES:
                out.append(_ESCAPES[nxt])
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def _no_second(opening: str) -> str:
    """Content of a call's parentheses that does not run past the next such
    call with content of its own: a match from the earlier opening is then also
    one from the later, and each opening reads on only as far as the next."""
    return rf"[^)](?:(?!{opening}[^)])[^)])*+\)"


# Patterns that read a long run again from each of its places, and forms that
# give the same answer in linear time. Searches need one character of a leading
# or trailing run; counts whose matches end (or begin) at a fixed character
# need one character of the run before (or after) it.
_LINEAR = {
    r"\d+\s*=\s*\d+": r"\d\s*=\s*\d",
    r"\w+\s*\(": r"\w\s*\(",
    r"\s+AND\s+": r"\sAND\s+",
    r"\s+OR\s+": r"\sOR\s+",
    r"\s+UNION\s+": r"\sUNION\s+",
    r"IF\s*\([^)]+\)\s*\w+": r"IF\s*\(" + _no_second(r"IF\s*\(") + r"\s*\w",
    r"IF\s*\([^)]+\)\s*SLEEP": r"IF\s*\(" + _no_second(r"IF\s*\(") + r"\s*SLEEP",
    r"CHAR\s*\([^)]+\)": r"CHAR\s*\(" + _no_second(r"CHAR\s*\("),
    r"FLOOR\s*\([^)]*RAND\s*\(": r"FLOOR\s*\((?:(?!FLOOR\s*\(|RAND\s*\()[^)])*+RAND\s*\(",
}


def linear(pattern: str) -> str:
    """The pattern, or a form with the same answer that is linear on any text."""
    return _LINEAR.get(pattern, pattern)


_CLASS_ESCAPES = set("swdSWDbB")


def mandatory(pattern: str) -> list[list[str]]:
    """Literals without which ``pattern`` cannot match: of each list at least
    one occurs in every match. Shortest first, since many patterns share those.
    Empty when nothing can be said."""
    out, run, i = [], "", 0
    while i < len(pattern):
        ch, literal, branches = pattern[i], "", None
        if ch == "\\":
            literal = "" if pattern[i + 1] in _CLASS_ESCAPES else pattern[i + 1]
            i += 2
        elif ch == "[":
            i = pattern.index("]", i) + 1
        elif ch == "(":
            end = pattern.find(")", i)
            inner = pattern[i + 1:end].split("|")
            if end < 0 or "(" in pattern[i + 1:end]:
                return []  # nested groups: such patterns are always run
            if all(b.replace("_", "").isalnum() for b in inner):
                branches = inner
            i = end + 1
        elif ch == "|":
            return []
        else:
            literal, i = ("" if ch in ".^$" else ch), i + 1
        after = pattern[i:i + 1]
        optional = after in ("?", "*", "{") and after != ""
        if literal and not optional:
            run += literal
        if run and (not literal or optional or after == "+"):
            out.append([run])
            run = ""
        if branches and not optional:
            out.append(branches)
        if after == "{":
            i = pattern.index("}", i) + 1
        elif after and after in "?*+":
            i += 1
    if run:
        out.append([run])
    return sorted({tuple(o): list(o) for o in out}.values(), key=lambda o: min(map(len, o)))


def spark_ci(pattern: str) -> str:
    """Case-insensitive with Unicode folding in Java (``(?i)`` alone is ASCII)."""
    return "(?iu)" + pattern


def duckdb_ci(pattern: str) -> str:
    """RE2's ``(?i)`` already folds Unicode."""
    return "(?i)" + pattern
