"""String helpers as column expressions (no Python on the executors)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space is Unicode white space plus the four ASCII separators U+001C..U+001F.
_SPACE = r"[\s\x1c-\x1f]"
# The same characters one by one: trimming by them needs no pattern to be tried at every place of a text.
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` removes U+0020 only)."""
    return F.btrim(text, F.lit(_SPACES))


def squeeze(text: Column) -> Column:
    """Collapse every white-space run to one space and strip."""
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def normalise_label(label: Column) -> Column:
    """Case- and margin-insensitive form of a label; ids are built from it."""
    return F.lower(strip(label))


def slug(key: Column) -> Column:
    """Every non-alphanumeric character becomes ``_`` after stripping."""
    return F.regexp_replace(strip(key), r"[^\p{L}\p{N}]", "_")


def short_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256, the id form used throughout."""
    return F.substring(F.sha2(text, 256), 1, 16)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def last_segment(text: Column, separator: str = "/") -> Column:
    return F.substring_index(text, separator, -1)


def local_name(iri: Column) -> Column:
    """What follows the last ``/`` or ``#``; a pattern anchored at the end only would be tried from every place of an IRI."""
    return last_segment(last_segment(iri), "#")


def after(text: Column, prefix: Column) -> Column:
    """What follows a prefix known to be there."""
    return F.substring(text, F.length(prefix) + 1, F.length(text))


@lru_cache(maxsize=1)
def _latin_folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility folding derived by rule from the Unicode database.

    One-to-one foldings go into a translate table; the few letters that fold to several
    ASCII characters (ligatures, digraphs, vulgar fractions) become replacements.
    """
    single_from, single_to, several = [], [], []
    for code in range(0x80, 0x110000):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char or not any(c.isascii() and c.isalnum() for c in plain):
            continue
        if len(plain) == 1:
            single_from.append(char)
            single_to.append(plain)
        else:
            several.append((char, plain))
    return "".join(single_from), "".join(single_to), tuple(several)


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition of Latin text without its combining marks."""
    source, target, several = _latin_folding()
    folded = F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), source, target)
    # Characters that fold to several are rare: the fold over their pairs runs on hits only.
    pairs = F.expr("array(" + ", ".join(f"named_struct('c', '{c}', 'p', '{p}')" for c, p in several) + ")")
    expanded = F.reduce(pairs, folded, lambda text, pair: F.replace(text, pair["c"], pair["p"]))
    return F.when(folded.rlike("[" + "".join(c for c, _ in several) + "]"), expanded).otherwise(folded)


def fold(text: Column) -> Column:
    """Lower-case ASCII letters and digits separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", " "))
