"""Regular expressions written in the Unicode-aware dialect, spelled for Java.

The engine's fixed patterns treat letters, digits and word characters as Unicode. Java needs
the U flag for that, and even then its word class differs: it takes combining marks and
leaves out superscript digits, so ``m²`` followed by a boundary behaves differently. The
word class and the boundary are therefore written out.
"""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def java_pattern(pattern: str, *, ignore_case: bool = False, dotall: bool = False) -> str:
    """Spell a Unicode-aware pattern for Spark's regex functions."""
    spelled = re.sub(r"\\([wb])", lambda m: WORD if m.group(1) == "w" else BOUNDARY, pattern)
    flags = "U" + ("i" if ignore_case else "") + ("s" if dotall else "")
    return f"(?{flags}){spelled}"


def quoted(literal: str) -> str:
    """A literal as a Java pattern."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"
