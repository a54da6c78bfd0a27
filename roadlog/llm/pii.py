"""Personal data in texts: fixed patterns, and candidate spans that boosted trees take for such data.

Generators with high recall propose spans that may overlap: the patterns of e-mail addresses, network addresses, card and
phone numbers whether or not their checks hold, addresses with the sign spelled out, and long runs of digits and separators.

Trees see the form of a candidate and the words around it, as it is without the marks that the checks go by: an address without
its sign, a phone number without its plus. They learn from candidates on which something sure can be said: those whose checks
hold are personal, in their markless form and, for phone numbers, without the country too; those whose checks fail, dates, grouped
numbers and the prose before addresses are not. Candidates of the last two generators are no examples of either: they are
what the trees decide about. A sigmoid fitted on examples that the trees have not seen gives probabilities; for addresses and for numbers
the threshold is the least probability that is right often enough on these. A candidate is added only if its shape (the last
part of an address, the groups of a number) is one that enough sure examples have and that is personal in nearly all of them,
so a corpus teaches nothing about shapes it has no sure examples of: a number of a social insurance, say, is not found.
Spans of the fixed patterns always stay; the trees add spans beyond them, the likeliest first where they overlap.

The trees, the sigmoid, the thresholds and the shapes are learned from all sure examples of all documents: three of four by hash fit the trees, the
fourth is what they have not seen. Examples stay in tables; the driver gets sums over them (`boosting.learned`) and the shapes that are known as personal.

Cases: a null or empty text has no spans; offsets are code points with the end exclusive; without candidates of both classes only
the fixed patterns count; texts of every length are searched whole; equal rows give equal results; empty tables give no rows; only
id and text are read, `redacted` passes all other columns through.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlog.llm.boosting import Trees, learned, threshold
from roadlog.llm.common import cut, field, id_text, map_texts, masked, pieces, rewritten

SLOT = 4000                 # examples that are put into the order of hashes at once
PRECISION = 0.95
LEAST_OF_SHAPE = 20
AROUND = 32

# fixed values: the patterns of personal data
KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# generators beyond the patterns
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{2,40} ?[\[(]? ?(?:at|AT) ?[\])]? ?[A-Za-z0-9-]{2,40}(?:(?: ?[\[(]? ?\b(?:dot|DOT)\b ?[\])]? ?|\.)[A-Za-z0-9-]{2,40}){1,4}(?![A-Za-z0-9])")
_DIGITS = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9][0-9 ().\-/]{5,30}[0-9](?![0-9A-Za-z])")
GENERATORS = [*KINDS, "spelled", "digits"]
CONTEXT = ["mail", "contact", "write", "ip", "host", "server", "address", "card", "visa", "credit", "pay", "phone", "tel", "call", "mobile", "fax",
           "version", "v.", "section", "page", "date", "isbn", "id", "no", "ssn", "account", "iban", "passport"]


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(generator, start, end, whether the fixed checks hold), patterns first."""
    out: list[tuple[int, int, int, bool]] = [(0, s, e, True) for s, e in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        out.append((1, *m.span(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 7:
            digits = "".join(c for c in m[0] if c.isdigit())
            out.append((2, *m.span(), 13 <= len(digits) <= 19 and luhn(digits)))
    for m in _PHONE.finditer(text):
        out.append((3, *m.span(), 9 <= sum(c.isdigit() for c in m[0]) <= 15))
    out += [(4, *m.span(), False) for m in _SPELLED.finditer(text)] if "dot" in text or "DOT" in text or " at" in text else []
    out += [(5, *m.span(), False) for m in _DIGITS.finditer(text)]
    return out


_SIGNS = re.compile(r"@|[\[(]? ?\b(?:at|AT|dot|DOT)\b ?[\])]?|\.")
_COUNTRY = re.compile(r"\+?[0-9]{1,3}[ .-]*(?=\(?[0-9])")
# fixed values: forms of numbers that are dates, times or counts
_PLAIN = re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?|[0-9]{1,3}(?:,[0-9]{3})+)(?![0-9])")
# the last three to five words of prose
_PROSE = [re.compile(rf"(?:[^\W\d_]+ ){{{n}}}[^\W\d_]+(?= ?$)") for n in (2, 3, 4)]
MAIL, NUMBER = 0, 1


def markless(generator: int, string: str) -> str:
    """The candidate without what its check goes by."""
    if GENERATORS[generator] in ("email", "spelled"):
        return " ".join(_SIGNS.sub(" ", string).split())
    return string.removeprefix("+")


def family(generator: int) -> int:
    return MAIL if GENERATORS[generator] in ("email", "spelled") else NUMBER


def shape(kind: int, string: str) -> str:
    """The last part of an address, or a number with its groups of digits as their lengths."""
    if kind == MAIL:
        return string.rsplit(" ", 1)[-1].lower()
    return re.sub("[0-9]+", lambda m: str(len(m[0])), string)


def features(kind: int, string: str, before: str, after: str) -> list[float]:
    """Form and surroundings of a markless candidate."""
    groups, words = re.findall(r"[0-9]+", string), string.split()
    digits = sum(map(len, groups))
    low = before.lower()
    return [kind, len(string), digits, sum(c.isalpha() for c in string), string.count("."), string.count("-"), string.count(" "),
            string.count("("), len(words), len(words[-1]) if words else 0, float(any(c.isdigit() for c in words[0])) if words else 0.0,
            len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(set("".join(groups))),
            float(before[-1:].isspace()), float(after[:1].isspace()), float(before[-1:].isalnum()), float(after[:1].isalnum()),
            sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), *[float(w in low) for w in CONTEXT]]


def _sides(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - AROUND):start], text[end:end + AROUND]


def examples(text: str) -> list[tuple[int, bool, str, list[float]]]:
    """What a text says for sure: (place, whether personal, shape, features)."""
    out = []

    def add(kind: int, place: int, personal: bool, string: str, before: str, after: str) -> None:
        out.append((place, personal, f"{kind}:{shape(kind, string)}", features(kind, string, before, after)))

    found = [c for c in candidates(text) if c[0] < len(KINDS)]
    sure = [(s, e) for _, s, e, holds in found if holds]
    for g, s, e, holds in found:
        short = GENERATORS[g] == "card" and not 13 <= sum(c.isdigit() for c in text[s:e]) <= 19      # fails as a card, and may be anything else
        if not holds and (short or any(a < e and s < b for a, b in sure)):
            continue
        kind, plain, (before, after) = family(g), markless(g, text[s:e]), _sides(text, s, e)
        add(kind, s, holds, plain, before, after)
        if GENERATORS[g] == "phone" and holds:
            add(kind, s, True, _COUNTRY.sub("", plain, count=1), before, after)
        if kind == MAIL and (prose := _PROSE[s % 3].search(before) or _PROSE[0].search(before)):
            add(kind, s - len(before) + prose.start(), False, prose[0], before[:prose.start()], before[prose.end():] or " ")
    for m in _PLAIN.finditer(text):
        add(NUMBER, m.start(), False, m[0], *_sides(text, *m.span()))
    return out


_TOLD = [field("place", "long[]"), field("personal", "boolean[]"), field("shape", "string[]"), field("features", "string[]")]


def told(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every sure example of all documents, a written table: doc_id, place, shape, features, personal and their hash h."""
    def work(texts: list[str]) -> dict:
        found = [examples(t) for t in texts]
        return {"place": [[x[0] for x in f] for f in found], "personal": [[x[1] for x in f] for f in found], "shape": [[x[2] for x in f] for f in found],
                "features": [[" ".join(map(str, x[3])) for x in f] for f in found]}

    rows = map_texts(id_text(docs, id_col, text_col), work, _TOLD)
    each = rows.select("doc_id", F.inline(F.arrays_zip("place", "personal", "shape", "features")))
    return cut(each.withColumn("h", F.xxhash64("doc_id", "place", "shape", "features")))


def parted(each: DataFrame) -> DataFrame:
    """Equal examples as one row, a written table: shape, features, hit (whether personal), held and how many (n).

    Every fourth example in the order of hashes is held. The order is made in slots of about `SLOT` examples.
    """
    slots = pieces(each.count(), SLOT)
    placed = each.withColumn("slot", F.least(F.floor((F.col("h") / 2.0 ** 64 + 0.5) * slots), F.lit(slots - 1).cast("long")))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("slot").agg(F.count("*").alias("n")).select("slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("slot").orderBy("h", "features", "shape", "personal")
    numbered = placed.withColumn("place", F.row_number().over(order)).join(starts, "slot")
    held = (F.col("start") + F.col("place") - 1) % 4 == 0
    return cut(numbered.groupBy("shape", "features", F.col("personal").alias("hit"), held.alias("held")).agg(F.count("*").alias("n")))


class Model:
    """Trees, their calibration, a threshold for addresses and one for numbers, and the shapes that are known as personal."""

    def __init__(self, rows: DataFrame, precision: float = PRECISION):
        """`rows` as of `parted`."""
        self.trees, self.bounds = None, [1.1, 1.1]
        hits = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))
        known = rows.groupBy("shape").agg(hits.alias("hits"), F.sum("n").alias("n")).filter((F.col("hits") >= LEAST_OF_SHAPE) & (F.col("hits") >= precision * F.col("n")))
        self.shapes = {r["shape"] for r in known.select("shape").collect()}
        sides = {(r["held"], r["hit"]): r["n"] for r in rows.groupBy("held", "hit").agg(F.sum("n").alias("n")).collect()}
        if sum(sides.values()) < 40 or len(sides) < 4:
            return
        self.trees, unseen = learned(rows.groupBy("features", "hit", "held").agg(F.sum("n").alias("n")))
        found = unseen.toArrow()
        kinds, margin, n = (found.column(c).to_numpy() for c in ("kind", "margin", "n"))
        y = found.column("hit").to_numpy().astype(float)
        p = self.trees.calibrate(margin, y, n).likely(margin)
        for kind in (MAIL, NUMBER):
            mine = kinds == kind
            if y[mine].any():
                self.bounds[kind] = threshold(p[mine], y[mine], n[mine], precision)

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, probability): the patterns that hold, and what the trees add to them."""
        found = candidates(text)
        out = [(s, e, GENERATORS[g], 1.0) for g, s, e, holds in found if holds]
        open_ = []
        for g, s, e, _ in found if self.trees else []:
            if g >= len(KINDS) and not any(a < e and s < b for a, b, _, _ in out):
                plain = markless(g, text[s:e])
                if f"{family(g)}:{shape(family(g), plain)}" in self.shapes:
                    open_.append((g, s, e, features(family(g), plain, *_sides(text, s, e))))
        if open_:
            p = self.trees.probability(np.array([f for *_, f in open_]))
            extra: list[tuple[int, int, str, float]] = []
            for at in sorted(range(len(open_)), key=lambda k: (-p[k], open_[k][1], -open_[k][2])):
                g, s, e, _ = open_[at]
                if p[at] >= self.bounds[family(g)] and not any(a < e and s < b for a, b, _, _ in extra):
                    extra.append((s, e, f"likely_{GENERATORS[g]}", float(p[at])))
            out += extra
        order = [*KINDS, *[f"likely_{g}" for g in GENERATORS]]
        return sorted(out, key=lambda s: (order.index(s[2]), s[0], s[1]))


def fit(docs: DataFrame, precision: float = PRECISION, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return Model(parted(told(docs, id_col, text_col)), precision)


_FOUND = [field("kinds", "string[]"), field("starts", "int[]"), field("ends", "int[]"), field("probability", "double[]")]


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the spans found, by kind and start: kinds, starts, ends, probability."""
    model = model or fit(docs, id_col=id_col, text_col=text_col)

    def work(texts: list[str]) -> dict:
        found = [model.spans(t) for t in texts]
        return {"kinds": [[s[2] for s in f] for f in found], "starts": [[s[0] for s in f] for f in found],
                "ends": [[s[1] for s in f] for f in found], "probability": [[s[3] for s in f] for f in found]}

    return map_texts(id_text(docs, id_col, text_col), work, _FOUND)


def redacted(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced by its kind."""
    model = model or fit(docs, id_col=id_col, text_col=text_col)
    return rewritten(docs, text_col, lambda text: masked(text, [(s, e, f"<{kind.removeprefix('likely_')}>") for s, e, kind, _ in model.spans(text)]))
