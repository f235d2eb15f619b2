"""Quantities written as text: a multi-pattern automaton over unit names, number reading, and unit choice by context.

Pure Python on one value at a time, for use inside Arrow batches; see
``wayloom.operators.units`` for the operator.
"""

from __future__ import annotations

import re
from fractions import Fraction

import ahocorasick

# What each unit is called, the quantity it measures, and its size
# in the base unit of that quantity (m, m/s, kg), as exact fractions of SI.
UNITS: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("m", "length", "1", ("m", "m.", "mtr", "mtrs", "metre", "metres", "meter", "meters")),
    ("cm", "length", "1/100", ("cm", "cm.", "cms", "centimetre", "centimetres", "centimeter", "centimeters")),
    ("mm", "length", "1/1000", ("mm", "mm.", "mms", "millimetre", "millimetres", "millimeter", "millimeters")),
    ("km", "length", "1000", ("km", "km.", "kms", "kilometre", "kilometres", "kilometer", "kilometers")),
    ("ft", "length", "3048/10000", ("ft", "ft.", "foot", "feet", "'", "′", "’")),
    ("in", "length", "254/10000", ("in", "in.", "inch", "inches", '"', "″", "”", "''", "′′")),
    ("yd", "length", "9144/10000", ("yd", "yd.", "yds", "yard", "yards")),
    ("mi", "length", "1609344/1000", ("mi", "mi.", "mile", "miles")),
    ("dm", "length", "1/10", ("dm", "dm.", "decimetre", "decimetres", "decimeter", "decimeters")),
    ("nmi", "length", "1852", ("nmi", "nmi.", "naut mi", "nautical mile", "nautical miles")),
    ("km/h", "speed", "1000/3600", ("km/h", "kmh", "km/hr", "kph", "k.p.h.", "kmph", "kilometres per hour", "kilometers per hour", "kilometre per hour", "km per hour")),
    ("mph", "speed", "1609344/3600000", ("mph", "m.p.h.", "mi/h", "mi/hr", "miles/hour", "miles per hour", "mile per hour")),
    ("m/s", "speed", "1", ("m/s", "m/sec", "mps", "metres per second", "meters per second", "metre per second")),
    ("ft/s", "speed", "3048/10000", ("ft/s", "ft/sec", "fps", "feet per second", "foot per second")),
    ("kn", "speed", "1852/3600", ("kn", "kt", "kts", "knot", "knots")),
    ("kg", "weight", "1", ("kg", "kg.", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes")),
    ("t", "weight", "1000", ("t", "t.", "tonne", "tonnes", "metric ton", "metric tons")),
    ("lb", "weight", "45359237/100000000", ("lb", "lb.", "lbs", "lbs.", "pound", "pounds")),
    ("g", "weight", "1/1000", ("g", "g.", "gr", "gram", "grams", "gramme", "grammes")),
    ("oz", "weight", "45359237/1600000000", ("oz", "oz.", "ounce", "ounces")),
    ("lt", "weight", "2240*45359237/100000000", ("long ton", "long tons", "uk ton", "uk tons", "imperial ton", "imperial tons")),
    ("cwt", "weight", "112*45359237/100000000", ("cwt", "cwt.", "hundredweight", "hundredweights", "long hundredweight", "long hundredweights")),
    ("us cwt", "weight", "100*45359237/100000000", ("us cwt", "short hundredweight", "short hundredweights")),
    ("st", "weight", "2000*45359237/100000000", ("short ton", "short tons", "us ton", "us tons", "ton (us)", "tons (us)", "st")),
)
# The size of each common unit in the base unit of its quantity.
COMMON_UNITS = {"tenth of a km/h": "100/3600", "cm": "1/100", "kg": "1", "km/h": "1000/3600", "m/s": "1", "m": "1", "t": "1000"}
# Numbers in words, and words that may stand beside an amount without changing it.
WORDS = {
    w: i
    for i, w in enumerate(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    )
} | {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)} | {"hundred": 100}
ASIDE = re.compile(
    r"approximately|approx\.?|about|around|circa|ca\.?|c\.|max(?:imum)?\.?|min(?:imum)?\.?|est\.?|estimated|measured|nominal|roughly|nearly"
    r"|up to|\(?posted\)?|\(?signed\)?|at narrowest point|at widest point|\(est\.?\)|[~≈?!()*,;:]|\.(?!\d)"
)
FRACTIONS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}

_NUMBER = re.compile(
    r"(?P<whole>\d{1,3}(?:[ ,'’]\d{3})+(?:\.\d+)?(?!\d)|\d{1,3}(?:\.\d{3}){2,}(?:,\d+)?(?!\d)|\d{1,3}(?:\.\d{3})+,\d+|\d+[.,]\d+|\d+|[.,]\d+)?"
    r"(?:(?P<gap>\s*)(?P<num>\d+)\s*/\s*(?P<den>\d+))?"
)
_WORD = re.compile(r"(?:" + "|".join(sorted(WORDS, key=len, reverse=True)) + r")(?:[ -](?:" + "|".join(sorted(WORDS, key=len, reverse=True)) + r"))*")


def size_of(text: str) -> Fraction:
    """A size written as a product and one division."""
    top, _, bottom = text.partition("/")
    value = Fraction(1)
    for factor in top.split("*"):
        value *= Fraction(factor)
    return value / Fraction(bottom or 1)


def unit_table() -> list[tuple[str, str, float]]:
    """(unit, quantity, size in the base unit) for the broadcast join."""
    return [(u, q, float(size_of(s))) for u, q, s, _ in UNITS]


class UnitAutomaton:
    """Finds unit names in text: one pass, every name at once, the longest at a place wins.

    A name of letters must not touch other letters. A name may mean several
    units (``t``, ``m``); the quantity the field records decides.
    """

    def __init__(self) -> None:
        self.meaning: dict[str, dict[str, str]] = {}
        for unit, quantity, _, names in UNITS:
            for name in names:
                self.meaning.setdefault(name, {})[quantity] = unit
        self.automaton = ahocorasick.Automaton()
        for name in self.meaning:
            self.automaton.add_word(name, name)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name), leftmost longest, without overlaps."""
        hits = []
        for last, name in self.automaton.iter(text):
            start, end = last - len(name) + 1, last + 1
            if name[0].isalpha() and start and text[start - 1].isalpha():
                continue
            if name[-1].isalpha() and end < len(text) and (text[end].isalpha() or text[end] == "_"):
                continue
            hits.append((start, end, name))
        hits.sort(key=lambda h: (h[0], h[0] - h[1]))
        out, free = [], 0
        for hit in hits:
            if hit[0] >= free:
                out.append(hit)
                free = hit[1]
        return out


def _spelled(words: str) -> Fraction:
    total = current = 0
    for word in re.split(r"[ -]", words):
        n = WORDS[word]
        current = max(1, current) * 100 if n == 100 else current + n
    return Fraction(total + current)


def _plain(text: str) -> Fraction:
    """A number with marks for thousands or a decimal comma.

    A comma before exactly three digits marks thousands unless the whole part is
    0 or missing; any other single comma is the decimal mark.
    """
    t = text.replace(" ", "").replace("'", "").replace("’", "")
    if "," in t and "." in t:
        t = t.replace(",", "") if t.rindex(".") > t.rindex(",") else t.replace(".", "").replace(",", ".")
    elif t.count(".") > 1:
        t = t.replace(".", "")
    elif "," in t:
        head, *rest = t.split(",")
        grouped = all(len(r) == 3 for r in rest) and 1 <= len(head) <= 3 and head.lstrip("0") != ""
        t = t.replace(",", "") if grouped else t.replace(",", ".")
    return Fraction("0" + t if t.startswith(".") else t)


def numbers(text: str) -> list[tuple[int, int, Fraction]]:
    """(start, end, value) of each number in the text."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c.isdigit() or c in ".," and at + 1 < len(text) and text[at + 1].isdigit():
            m = _NUMBER.match(text, at)
            whole, num, den = m["whole"], m["num"], m["den"]
            end = m.end()
            if num is not None and (den == "0" or (whole and m["gap"] == "")):
                num, end = None, m.end("whole")  # 12/5 is no mixed number unless it is the whole of it
                if den != "0" and whole and not re.search(r"[.,]", whole):
                    num = None
            if whole is None and num is None:
                at += 1
                continue
            value = _plain(whole) if whole else Fraction(0)
            if num is not None:
                value += Fraction(int(num), int(den))
            out.append((at, end, value))
            at = end
        elif c.isalpha() and (at == 0 or not text[at - 1].isalpha()) and (m := _WORD.match(text, at)) and not (m.end() < len(text) and (text[m.end()].isalpha() or text[m.end()] == "_")):
            out.append((at, m.end(), _spelled(m[0])))
            at = m.end()
        else:
            at += 1
    return out


class QuantityReader:
    """Reads the amount that a text states for a quantity.

    ``read(value, quantity, default_unit)`` gives ``[(number, unit), ...]``:
    one pair for a plain amount, two for a compound one (feet and inches), none
    when the text states no amount of that quantity. A number without a unit
    takes ``default_unit``, and counts only if nothing else stands beside it
    than words that don't change an amount.
    """

    def __init__(self) -> None:
        self.units = UnitAutomaton()

    @staticmethod
    def clean(value: str) -> str:
        text = "".join(f" {FRACTIONS[c]}" if c in FRACTIONS else c for c in value)
        # full-width digits and letters to ASCII; primes stay as they are
        text = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in text)
        return re.sub(r"\s+", " ", text.replace("⁄", "/")).strip().lower()

    def read(self, value: str | None, quantity: str, default_unit: str | None) -> list[tuple[Fraction, str]]:
        if value is None:
            return []
        text = self.clean(value)
        if not text:
            return []
        found = self.units.find(text)
        spans = [(s, e, v) for s, e, v in numbers(text) if not any(a < e and s < b for a, b, n in found if n[0].isalpha())]
        if not spans:
            return []
        pairs: list[tuple[Fraction, str]] = []
        rest, at, bare = [], 0, []
        used = set()
        for s, e, v in spans:
            rest.append(text[at:s])
            at = e
            unit = next(((a, b, n) for a, b, n in found if a >= e and text[e:a].strip() == "" and (a, b) not in used), None)
            if unit is None:
                bare.append(v)
                continue
            used.add((unit[0], unit[1]))
            at = unit[1]
            meaning = self.units.meaning[unit[2]].get(quantity)
            if meaning is None:
                return []
            pairs.append((v, meaning))
        rest.append(text[at:])
        left = ASIDE.sub(" ", " ".join(rest)).strip()
        if left.startswith("-") and spans[0][0] > 0 and text[spans[0][0] - 1] == "-":
            return []  # a negative amount, or the tail of a code
        if left:
            return []
        if pairs and bare:
            # 5 ft 7 or 5' 7: the inches go without saying
            if len(pairs) == 1 and len(bare) == 1 and pairs[0][1] == "ft":
                pairs.append((bare[0], "in"))
                return pairs
            return []
        if pairs:
            if len(pairs) > 1 and not self._compound(pairs):
                return []
            return pairs
        if len(bare) == 1 and default_unit:
            return [(bare[0], default_unit)]
        return []

    @staticmethod
    def _compound(pairs: list[tuple[Fraction, str]]) -> bool:
        order = {"km": 0, "mi": 0, "yd": 1, "m": 2, "ft": 2, "dm": 3, "cm": 4, "in": 4, "mm": 5, "t": 0, "st": 0, "lt": 0, "cwt": 1, "us cwt": 1, "kg": 2, "lb": 2, "g": 3, "oz": 3}
        ranks = [order.get(u, 9) for _, u in pairs]
        return all(a < b for a, b in zip(ranks, ranks[1:])) and 9 not in ranks
