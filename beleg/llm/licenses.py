"""License scan by conditional compression.

A text is cut into sentences (at line ends, and after . ! ? before white space). Sentences with a cue word are candidates, as are
the sentences around them most of whose words occur in the templates; a run of candidates is a block. Each block, as lower-case
words, is compressed alone and with each template as zstandard raw dictionary; the templates are ranked by the bytes that they
save. They are confirmed by the exact wording: the words of the template that a stretch of the block lacks and the words it has
beyond, as the least number of single-word differences. Every stretch with differences of at most ``DIFFERENCE`` of the template's
words, and with exactly the template's distinguishing words (family, version, clause; ``marks_of``), is confirmed; of overlapping ones that with most words less twice its differences stays. A block has a row for each.

The compression ranks; only wording decides: each template that could be within its differences by the words the block has
is aligned, whatever it saves. A block without a confirmed template is reported as ``unconfirmed``, with the best ranked
template as candidate where any saves bytes, and as a whole.

Defined results: null and empty texts, and texts without a cue word, have no blocks and no rows. Offsets are code points, end exclusive. Ties in the
ranking go to the longer template, then to the name that sorts first. Repeated rows are reported each. An empty table gives an
empty result. Blocks are whole, however long: a block is scanned in windows of the template's length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beleg.llm.license_texts import TEMPLATES
from beleg.llm.tables import map_rows

DIFFERENCE = 0.2
SHARE = 0.8
LEVEL = 3
UNCONFIRMED = "unconfirmed"

# Words one of which any license sentence holds.
CUES = ("licens", "licenc", "copyright", "rights reserved", "warrant", "permission", "redistribut", "public domain", "free software", "spdx", "unencumbered")

# Words that tell licenses of like wording apart.
MARKS = frozenset(
    "mit bsd isc apache mozilla mpl eclipse epl zlib boost gpl lgpl agpl lesser affero cc0 attribution sharealike noncommercial noderivatives noderivs nc sa nd "
    "later endorse advertising".split())

_DECIMAL = re.compile(r"v?[0-9]+(?:\.[0-9]+)+")
_CUE = re.compile("|".join(CUES), re.I | re.A)
_SENTENCE = re.compile(r"\n|(?<=[.!?])[^\S\n]")
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def marks_of(words: list[str]) -> list[tuple[int, str]]:
    """Distinguishing words with their places: fixed ones, decimal numbers, the number after "version", the clauses of a BSD license."""
    out = []
    for i, word in enumerate(words):
        parts = word.split("-")
        if "clause" in parts or (parts[0].isdigit() and words[i + 1:i + 2] == ["clause"]):
            out.append((i, f"{next((p for p in parts if p.isdigit()), '')}-clause"))
        for part in parts:
            if part in MARKS:
                out.append((i, part))
            elif _DECIMAL.fullmatch(part):
                out.append((i, part.removeprefix("v").removesuffix(".0")))
            elif part.removeprefix("v").isdigit() and (part[0] == "v" or i and words[i - 1] in ("version", "v")):
                out.append((i, part.removeprefix("v")))
        if word == "library" and words[i + 1:i + 2] == ["general"]:
            out.append((i, word))
    return out


class Templates:
    """Compressors and words of the templates; one for a task."""

    def __init__(self, texts: dict[str, str]):
        self.words = {name: words_of(text) for name, text in sorted(texts.items())}
        self.marks = {name: {mark for _, mark in marks_of(words)} for name, words in self.words.items()}
        self.vocabulary = {w for words in self.words.values() for w in words}
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        self.given = {
            name: zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
                " ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, words in self.words.items()}
        self.known: dict[str, tuple] = {}

    def ranked(self, words: list[str]) -> tuple[int, list[tuple[int, str]]]:
        """Compressed size alone, and (bytes saved, template) from the most saved on."""
        data = " ".join(words).encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(data))
        saved = [(size - len(c.compress(data)), name) for name, c in self.given.items()]
        return size, sorted(saved, key=lambda s: (-s[0], -len(self.words[s[1]]), s[1]))

    def judge(self, words: list[str]) -> tuple[str, str | None, int, int, int]:
        """The first of ``all`` but its place: the license with the most words less twice its differences."""
        return max(self.all(words), key=lambda f: len(self.words.get(f[0], ())) - 2 * f[4])[:5]

    def all(self, words: list[str]) -> list[tuple[str, str | None, int, int, int, int, int]]:
        """Confirmed licenses by place, else one unconfirmed: license, best ranked template, compressed size, bytes saved, word differences
        (of the license, else of the best ranked), first and last word + 1."""
        key = " ".join(words)
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            size, ranked = self.ranked(words)
            best = ranked[0][1] if ranked and ranked[0][0] > 0 else None
            marks = marks_of(words)
            matches = [(len(self.words[name]) - 2 * m[0], place, name, saved, *m) for place, (saved, name) in enumerate(ranked) for m in self.matches(name, words, marks)]
            taken: list[tuple] = []
            for _, _, name, saved, differences, start, stop in sorted(matches, key=lambda m: (-m[0], m[1], m[5])):
                if all(stop <= t[5] or start >= t[6] for t in taken):
                    taken.append((name, best, size, saved, differences, start, stop))
            if not taken:
                taken.append((UNCONFIRMED, best, size, ranked[0][0] if best else 0, wording(self.words[best], words) if best else -1, 0, len(words)))
            self.known[key] = sorted(taken, key=lambda t: t[5])
        return self.known[key]

    def matches(self, name: str, words: list[str], marks: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
        """Confirmed stretches that don't overlap: differences, first and last word + 1."""
        template = self.words[name]
        limit, have = int(DIFFERENCE * len(template)), set(words)
        if sum(w not in have for w in template) > limit or not self.marks[name].issubset(mark for _, mark in marks):
            return []
        differences, starts = alignments(template, words)
        ends = np.flatnonzero(differences <= limit)
        out: list[tuple[int, int, int]] = []
        free, places = np.ones(len(words) + 1, dtype=bool), [i for i, _ in marks]
        for stop in ends[np.argsort(differences[ends], kind="stable")].tolist():
            start = int(starts[stop])
            inside = marks[bisect_left(places, start):bisect_left(places, stop)]
            if start < stop and {mark for _, mark in inside} == self.marks[name] and free[start:stop].all():
                free[start:stop] = False
                out.append((int(differences[stop]), start, stop))
        return out


def alignments(template: list[str], block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each end in the block: the least number of words to insert, delete or replace to make the template of a stretch with that
    end, and where the shortest such stretch starts."""
    numbers: dict[str, int] = {}
    text = np.array([numbers.setdefault(w, len(numbers)) for w in block], dtype=np.int64)
    n = len(text) + 1
    steps = np.arange(n, dtype=np.int64) * n
    row = n - 1 - np.arange(n, dtype=np.int64)  # differences * n + words after the start; a stretch may start anywhere
    for i, word in enumerate(template, 1):
        change = row[:-1] + n * (text != numbers.get(word, -1))
        row = np.concatenate(([i * n + n - 1], np.minimum(change, row[1:] + n)))
        row = np.minimum.accumulate(row - steps) + steps
    return row // n, n - 1 - row % n


def wording(template: list[str], block: list[str]) -> int:
    """The least number of words to insert, delete or replace to make the template of some stretch of the block."""
    if not set(template) & set(block):
        return len(template)
    return int(alignments(template, block)[0].min())


def blocks_of(text: str, vocabulary: set[str]) -> list[tuple[int, int]]:
    """Runs of candidate sentences."""
    low = text.lower()
    if not any(c in low for c in CUES):
        return []
    cuts = [0, *(m.end() for m in _SENTENCE.finditer(text)), len(text)]
    sentences = [(a, b) for a, b in zip(cuts, cuts[1:]) if not text[a:b].isspace() and a < b]
    cue, at = [False] * len(sentences), 0
    for m in _CUE.finditer(text):
        while sentences[at][1] <= m.start():
            at += 1
        cue[at] = True
    taken: list[list[int]] = []

    def fits(i: int) -> bool:
        words = words_of(text[sentences[i][0]:sentences[i][1]])
        return bool(words) and sum(w in vocabulary for w in words) >= SHARE * len(words)

    i = 0
    while i < len(sentences):
        if not cue[i]:
            i += 1
            continue
        first, low = i, taken[-1][1] + 1 if taken else 0
        while first > low and fits(first - 1):
            first -= 1
        last = i
        while last + 1 < len(sentences) and (cue[last + 1] or fits(last + 1)):
            last += 1
        if taken and taken[-1][1] + 1 == first:
            taken[-1][1] = last
        else:
            taken.append([first, last])
        i = last + 1
    out = []
    for first, last in taken:
        a, b = sentences[first][0], sentences[last][1]
        raw = text[a:b]
        out.append((a + len(raw) - len(raw.lstrip()), b - len(raw) + len(raw.rstrip())))
    return out


SCHEMA = "doc_id long, start long, stop long, license string, candidate string, n_words long, bytes_alone long, bytes_saved long, n_different long, match_start long, match_stop long"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per license of a block: doc_id, start, stop (of the block), license, candidate (best ranked template), sizes, number
    of word differences, match_start, match_stop (of the license's wording)."""

    def run(ids: list, texts: list) -> Iterator[dict[str, list]]:
        known = Templates(templates)
        rows: list[tuple] = []
        for i, text in zip(ids, texts):
            for start, stop in blocks_of(text, known.vocabulary) if text else ():
                spans = [m.span() for m in _WORD.finditer(text, start, stop)]
                words = [text[a:b].lower() for a, b in spans]
                for name, candidate, size, saved, differences, first, last in known.all(words) if words else ():
                    rows.append((i, start, stop, name, candidate, len(words), size, saved, differences, spans[first][0], spans[last - 1][1]))
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        yield {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), SCHEMA, run, "doc_id", "text")
