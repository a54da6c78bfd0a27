"""Secrets in texts: fixed patterns, and strings in a sensitive context that a primed compressor cannot shorten.

The fixed patterns are assignments to secret names, access keys and long hexadecimal strings. Beyond them, every string
of mixed letters and digits, or with `LETTERS` letters in a row, which ordinary words do not reach, is a candidate after a sensitive word, whole however long it is, and so are strings that follow a candidate
directly, over a dot or a line break, as in web tokens and key files. Its novelty is what it adds, in bytes
per character, to the zstandard size of the text around it, with a compressor primed with the identifiers that the corpus
uses most. A copied name or ordinary word costs next to nothing, a random string nearly its full information, which is
less a sign where a string has letters alone, so the threshold is too. More words than the
dictionary has would change little: a name that is rare in the whole corpus is found near its other uses, in the text around.

The identifier dictionary is counted over all documents by Spark; only its fixed number of most frequent words (`DICTIONARY`)
goes to the tasks. Documents are then read once, each by itself.

Cases: a null or empty text has no spans; very long texts are searched whole, each string is scored against the same short surroundings; offsets are code points with the end exclusive; overlapping spans of different kinds are
all reported, a novel string only where it touches no span of a pattern; equal rows give equal results; empty tables give no rows;
only id and text are read, `redacted` passes all other columns through.
"""

from __future__ import annotations

import re
from math import log

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlog.llm.common import field, id_text, map_texts, masked, rewritten

DICTIONARY = 4096
NOVELTY = 0.7
CONTINUED = 0.8     # a string that follows a novel one directly needs this share of the novelty
BEFORE, AFTER, REACH = 160, 80, 40

# fixed values: the patterns of secrets, and the least lengths of what they find
KINDS = ["assign", "access", "hex", "novel"]
_NAMES = ["password", "passwd", "secret", "token", "api_?key"]
_ASSIGN = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in _NAMES) + ")"
                     + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SIGNS = [b"passw", b"secret", b"token", b"api"]

_SENSITIVE = re.compile(r"(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secrets?|tokens?|api|keys?|apikey|auth|authorization|bearer|credentials?|creds|"
                        r"private|signature|salt|cookie|session|webhook|jwt|ssh|rsa)(?![a-z])", re.ASCII | re.IGNORECASE)
LEAST, LETTERS = 12, 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_LETTERS = re.compile(r"[A-Za-z]{%d}" % LETTERS)
_LINE = r"[\x20\t]*(?:\r?\n|\\r|\\n)+[\x20\t]*"
_STEP = re.compile(rf"(?:\.|{_LINE})(?=[A-Za-z0-9+/_=-]{{{LEAST}}})")
_TAIL = re.compile(rf"{_LINE}([A-Za-z0-9+/=]+)(?={_LINE}-----END)")       # the last line of a key file
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,39}(?=\x20{0,2}[=:(\[{])"


def patterns(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    out = []
    low = text.encode().lower()
    if any(s in low for s in _SIGNS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def richness(string: str) -> float:
    """What a random sign of the string's kinds tells, as a share of one of letters in both cases and digits: less for letters alone."""
    if not string.isalpha():
        return 1.0
    return log(26 if string.islower() or string.isupper() else 52, 62)


class Novelty:
    """Marginal compressed size against a primed dictionary and the text around."""

    def __init__(self, identifiers: list[str], level: int = 9):
        raw = "\n".join(reversed(identifiers)).encode()         # the most frequent nearest to the text
        primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False)

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes per character that the string adds to its context."""
        around = (text[max(0, start - BEFORE):start] + text[end:end + AFTER] + "\n").encode()
        one = self.compressor.compress(around)
        two = self.compressor.compress(around + text[start:end].encode())
        return (len(two) - len(one)) / (end - start)

    def spans(self, text: str, known: list[tuple[int, int, str]], least: float) -> list[tuple[int, int, float]]:
        out = []
        reach, follows = 0, -1
        for word in _SENSITIVE.finditer(text):
            reach, last = max(reach, word.end()), word.end() + REACH
            while reach <= last and (near := _CANDIDATE.search(text, reach, min(len(text), last + LEAST))):
                m = _CANDIDATE.match(text, near.start())        # to its end, however far that is
                reach = m.end()
                string = m[0]
                scored = (any(c.isdigit() for c in string) and any(c.isalpha() for c in string)) or _LETTERS.search(string)
                enough = richness(string) * (CONTINUED * least if m.start() == follows else least)
                if scored and (step := _STEP.match(text, reach)):
                    last = max(last, step.end())
                if scored and not any(s < m.end() and m.start() < e for s, e, _ in known):
                    novelty = self.of(text, m.start(), m.end())
                    if novelty >= enough:
                        out.append((m.start(), m.end(), novelty))
                        follows = step.end() if (step := _STEP.match(text, reach)) else -1
                        if tail := _TAIL.match(text, reach):
                            out.append((*tail.span(1), novelty))
                            reach = tail.end()
        return out


def identifiers(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The `size` identifiers that stand before an assignment, call or bracket most often in all documents."""
    each = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({IDENTIFIER})"), F.lit(1))).alias("word"))
    top = each.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r["word"] for r in top.collect()]


def _finder(words: list[str], least: float):
    made: list[Novelty] = []

    def find(text: str) -> list[tuple[int, int, str, float | None]]:
        if not made:
            made.append(Novelty(words))
        known = patterns(text)
        spans = [(s, e, kind, None) for s, e, kind in known] + [(s, e, "novel", x) for s, e, x in made[0].spans(text, known, least)]
        return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
    return find


_FOUND = [field("kinds", "string[]"), field("starts", "int[]"), field("ends", "int[]"), field("novelty", "double[]")]


def find(docs: DataFrame, least: float = NOVELTY, size: int = DICTIONARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the spans found, by start and kind: kinds, starts, ends, and the novelty where that found it."""
    finder = _finder(identifiers(docs, text_col, size), least)

    def work(texts: list[str]) -> dict:
        found = [finder(t) for t in texts]
        return {"kinds": [[s[2] for s in f] for f in found], "starts": [[s[0] for s in f] for f in found],
                "ends": [[s[1] for s in f] for f in found], "novelty": [[s[3] for s in f] for f in found]}

    return map_texts(id_text(docs, id_col, text_col), work, _FOUND)


def redacted(docs: DataFrame, least: float = NOVELTY, size: int = DICTIONARY, text_col: str = "text") -> DataFrame:
    """The documents with every secret replaced by its kind."""
    finder = _finder(identifiers(docs, text_col, size), least)
    return rewritten(docs, text_col, lambda text: masked(text, [(s, e, f"<{kind}>") for s, e, kind, _ in finder(text)]))
