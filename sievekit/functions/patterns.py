"""Attack pattern rules (input of feature ``pattern_match_count``).

Each rule is a case-insensitive regular-expression search over the raw text;
a row scores one point per rule that matches anywhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import linear, mandatory, portable, spark_ci

# ---------------------------------------------------------------------------
# The 44 attack rules, in their original order and spelling
# (Python regex syntax; ``portable`` adapts the classes per engine). The
# INTO DUMPFILE rule appears twice on purpose and therefore scores twice.
# ---------------------------------------------------------------------------
ATTACK_PATTERNS: list[str] = [
    r"('|(\\')|(;)|(--)|(/\*)|(\*/)|(\+)|(\%)|(\=)|(\()|(\))|(\[)|(\])|(\{)|(\}))",
    r"(OR|AND)\s+\d+\s*=\s*\d+",
    r"(OR|AND)\s+['\"]\w+['\"]\s*=\s*['\"]\w+['\"]",
    r"UNION\s+(ALL\s+)?SELECT",
    r"EXEC\s*\(",
    r"xp_\w+",
    r"sp_\w+",
    r"CAST\s*\(",
    r"CONVERT\s*\(",
    r"WAITFOR\s+DELAY",
    r"BENCHMARK\s*\(",
    r"LOAD_FILE\s*\(",
    r"INTO\s+OUTFILE",
    r"INTO\s+DUMPFILE",
    r"SLEEP\s*\(",
    r"PG_SLEEP\s*\(",
    r"IF\s*\([^)]+\)\s*SLEEP",
    r"'\s*(OR|AND)\s+['\"]?\d+['\"]?\s*=\s*['\"]?\d+",
    r"'\s*(OR|AND)\s+['\"]?\w+['\"]?\s*=\s*['\"]?\w+",
    r"UNION\s+SELECT\s+NULL",
    r"ORDER\s+BY\s+\d+",
    r"GROUP\s+BY\s+\d+",
    r"HAVING\s+\d+\s*=\s*\d+",
    r"INFORMATION_SCHEMA",
    r"sys\.\w+",
    r"@@\w+",
    r"CONCAT\s*\(",
    r"CHAR\s*\(",
    r"ASCII\s*\(",
    r"SUBSTRING\s*\(",
    r"MID\s*\(",
    r"HEX\s*\(",
    r"UNHEX\s*\(",
    r"0x[0-9a-fA-F]+",
    r"%[0-9a-fA-F]{2}",
    r"CHR\s*\(",
    r"STRCMP\s*\(",
    r"LIKE\s+['\"]%",
    r"RLIKE\s+",
    r"REGEXP\s+",
    r"EXTRACTVALUE\s*\(",
    r"UPDATEXML\s*\(",
    r"LOAD_DATA\s+INFILE",
    r"INTO\s+DUMPFILE",
]


# Characters outside ASCII that case-insensitive matching equates with an
# ASCII letter (long s, Kelvin sign, dotted capital I, dotless small i).
_FOLD_FROM, _FOLD_TO = "\u017f\u212a\u0130\u0131", "SKII"
_PLAIN = re.compile(r"\((?:\(?(?:\\.|[^\\()\[\]{}?*+.^$|])+\)?\|?)+\)")


def plain_alternatives(pattern: str) -> list[str] | None:
    """The literals of a pattern that is nothing but ``(a|(b)|(c))``, else None."""
    if not _PLAIN.fullmatch(pattern):
        return None
    parts = re.findall(r"(?:\\.|[^\\()|])+", pattern)
    literals = [re.sub(r"\\(.)", r"\1", p) for p in parts]
    # one that holds another adds nothing
    return [x for x in literals if not any(y != x and y in x for y in literals)]


def folded_upper(text: Column) -> Column:
    """Upper case after folding the four non-ASCII case partners of ASCII
    letters: any case-insensitive match of an ASCII literal shows up here as
    the upper-case literal."""
    return F.upper(F.translate(text, _FOLD_FROM, _FOLD_TO))


def pattern_flags(text: Column, patterns: list[str] | None = None,
                  folded: Column | None = None) -> list[Column]:
    """One boolean Column per rule: does the rule match somewhere in ``text``.

    A rule is only run on rows whose folded text holds every literal its match
    needs (byte searches); the regex, slow in case-insensitive Unicode mode,
    then runs on few rows. A rule made of punctuation alone is a byte search
    itself. The answer is the same as that of the regex.
    """
    rules = ATTACK_PATTERNS if patterns is None else patterns
    folded = folded_upper(text) if folded is None else folded
    out = []
    for p in rules:
        plain = plain_alternatives(p)
        if plain and not any(ch.isalpha() for ch in "".join(plain)):
            out.append(any_of(text, plain))
            continue
        rx = text.rlike(spark_ci(portable(linear(p))))
        out.append(gated(text, folded, [[x.upper() for x in alts] for alts in mandatory(p)], rx, F.lit(False)))
    return out


def any_of(text: Column, literals: list[str]) -> Column:
    found = text.contains(literals[0])
    for more in literals[1:]:
        found = found | text.contains(more)
    return found


def gated(text: Column, searched: Column, needed: list[list[str]], value: Column, absent: Column) -> Column:
    """``value`` where ``searched`` holds one literal of each list, else
    ``absent``; NULL for a NULL text."""
    if not needed:
        return value
    gate = any_of(searched, needed[0])
    for more in needed[1:]:
        gate = gate & any_of(searched, more)
    return F.when(gate, value).when(text.isNotNull(), absent)


def pattern_count(text: Column, patterns: list[str] | None = None, folded: Column | None = None) -> Column:
    """Number of rules that match (feature ``pattern_match_count``)."""
    flags = [f.cast("int") for f in pattern_flags(text, patterns, folded)]
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return total.cast("long")


def pattern_hits(text: Column, patterns: list[str] | None = None) -> Column:
    """1-based ids of the matching rules, in rule order (analyst view)."""
    flags = pattern_flags(text, patterns)
    ids = F.array(*[F.when(f, F.lit(i + 1)) for i, f in enumerate(flags)])
    return F.filter(ids, lambda x: x.isNotNull())
