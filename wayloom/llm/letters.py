"""Counting classes of letters in many texts at once.

The letters of a batch lie in one array, each text ended by a line break; every
statistic is a sum over runs of it. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, LOWER, UPPER, NUMBER, END, COLON, CLOSER, PLAIN, SEPARATOR, COMMA = (1 << k for k in range(11))
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The classes of each letter of Unicode, by its category and a few marks of their own, and its lower case."""
    classes, lower = np.zeros(0x110000, dtype=np.uint16), np.arange(0x110000, dtype=np.uint32)
    kinds = {"L": LETTER, "M": LETTER, "N": NUMBER, "Z": SPACE}
    classes[0x20000:0x323B0] = LETTER  # the further planes of ideographs
    for code in range(0x20000):
        category = unicodedata.category(chr(code))
        classes[code] = kinds.get(category[0], 0) | (LOWER if category == "Ll" else UPPER if category == "Lu" else 0)
        if category in ("Lu", "Lt"):
            small = chr(code).lower()
            lower[code] = ord(small) if len(small) == 1 else code

    def add(marks: str, kind: int) -> None:
        for mark in marks:
            classes[ord(mark)] |= kind

    add("\t\n\x0b\x0c\r", SPACE)
    add(".!?…。！？", END)
    add(":", COLON)
    add("\"'»”’“)", CLOSER)
    add(".,;:!?'\"«»„“”‘’—–-()…¿¡", PLAIN)
    add(";:|/·•&=\t", SEPARATOR)
    add(",，、", COMMA)
    return classes, lower


def _hash(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word, from its letters and their places."""
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint64)
    n = int(size.sum())
    place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(start, size) + place
    with np.errstate(over="ignore"):
        mixed = (codes[at].astype(np.uint64) + np.uint64(1)) * (_BASE + place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        return np.add.reduceat(mixed, np.cumsum(size) - size)


def hashes(words: Sequence[str]) -> np.ndarray:
    """The sorted hashes of words."""
    codes = np.array([ord(c) for w in words for c in w], dtype=np.uint32)
    size = np.array([len(w) for w in words], dtype=np.int64)
    return np.sort(_hash(codes, np.cumsum(size) - size, size))


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if len(listed) == 0 or len(values) == 0:
        return np.zeros(len(values), dtype=bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def measure(texts: pa.Array, common: Sequence[np.ndarray], window: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The statistics of each text by name, and how many words of each list of ``common`` (sorted hashes) it holds."""
    rows = len(texts)
    if rows == 0:
        return {n: np.zeros(0) for n in NAMES}, np.zeros((0, len(common)), dtype=np.int64)
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    code = np.frombuffer(("\n".join(texts.to_pylist()) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes, lower = tables()
    kind = classes[code]
    first = np.cumsum(size) - size
    text_of = np.repeat(np.arange(rows), size)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, first, dtype=np.int64).astype(float)

    def counted(at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(text_of[at], weights, rows).astype(float)

    def at(place: np.ndarray) -> np.ndarray:
        return code[np.minimum(place, len(code) - 1)]

    def is_a(place: np.ndarray, what: int) -> np.ndarray:
        return (kind[np.minimum(place, len(code) - 1)] & what) > 0

    space = (kind & SPACE) > 0
    # words, and how they vary in windows
    start, long = _runs((kind & LETTER) > 0)
    words, letter_sum = counted(start), counted(start, long)
    value = _hash(lower[code], start, long)
    held = np.stack([counted(start, _among(value, own)) for own in common], axis=1).astype(np.int64) if len(common) else np.zeros((rows, 0), dtype=np.int64)
    every = np.unique(np.concatenate(common)) if len(common) else np.zeros(0, dtype=np.uint64)
    usual = counted(start, _among(value, every))
    number = np.cumsum(words).astype(np.int64) - words.astype(np.int64)  # the first word of each text
    n = words.astype(np.int64)
    whole, over = n // window, n % window
    parts = whole + (over > 0)
    opened = np.repeat(number, parts) + window * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    last = np.repeat(number + np.maximum(n - window, 0), parts)
    opened = np.minimum(opened, last)  # the last window ends with the text
    long_part = np.minimum(np.repeat(n, parts), window)
    which = np.repeat(np.arange(len(opened)), long_part)
    inside = np.arange(long_part.sum()) - np.repeat(np.cumsum(long_part) - long_part, long_part)
    word = value[np.repeat(opened, long_part) + inside] if len(opened) else value[:0]
    order = np.lexsort((word, which))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (which[order][1:] != which[order][:-1]) | (word[order][1:] != word[order][:-1])
    differing = np.bincount(which, fresh[np.argsort(order, kind="stable")], len(opened)) if len(opened) else np.zeros(0)
    share = np.bincount(np.repeat(np.arange(rows), parts), differing / np.maximum(long_part, 1), rows) / np.maximum(parts, 1)
    full = np.minimum(words, window)
    variety = np.where(n > 0, (share * full + (window - full) * 0.9) / window, 0.9)
    # lines: those that hold anything, whether they end like a sentence, and whether the next one runs on
    breaks = np.flatnonzero(code == 10)
    line_start = np.concatenate([[0], breaks[:-1] + 1])
    solid = np.flatnonzero(~space)
    head = np.searchsorted(solid, line_start)
    tail = np.searchsorted(solid, breaks) - 1
    filled = np.flatnonzero(tail >= head)
    opens = solid[head[filled]]
    owner = text_of[opens]
    plain = np.flatnonzero(~space & ((kind & CLOSER) == 0))
    ending = np.searchsorted(plain, breaks[filled]) - 1
    closing = np.where(ending >= 0, plain[np.maximum(ending, 0)], 0)
    finished = (ending >= 0) & (closing >= opens) & is_a(closing, END | COLON)
    lines = np.bincount(owner, minlength=rows).astype(float)
    done = np.bincount(owner, finished, rows)
    bullet = np.isin(at(opens), _BULLETS) & is_a(opens + 1, SPACE)
    bullet |= (at(opens) == ord("[")) & (((at(opens + 1) == ord("]")) & is_a(opens + 2, SPACE)) | ((at(opens + 2) == ord("]")) & is_a(opens + 3, SPACE)))
    label = opens + (at(opens) == ord("("))
    for k in (1, 2, 3):
        spelt = np.ones(len(opens), dtype=bool)
        for m in range(k):
            spelt &= is_a(label + m, LETTER | NUMBER) | (at(label + m) == ord("_"))
        bullet |= spelt & np.isin(at(label + k), (ord("."), ord(")"))) & is_a(label + k + 1, SPACE)
    loud = count((kind & UPPER) > 0) > letter_sum / 2
    runs_on = is_a(opens, LOWER) | (loud[owner] & is_a(opens, LETTER))
    follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    broken = np.bincount(owner[follows], ~finished[follows - 1] & (bullet[follows] | ~runs_on[follows]), rows)
    # ends of sentences: a mark, perhaps closing quotes, then blank
    marks = np.flatnonzero((kind & END) > 0)
    beyond = np.flatnonzero((kind & CLOSER) == 0)
    after = np.searchsorted(beyond, marks, side="right")
    ends = counted(marks, space[beyond[np.minimum(after, len(beyond) - 1)]])
    first_line = np.full(rows, -1)
    first_line[owner[::-1]] = np.arange(len(owner))[::-1]
    listed = (lines > 1) & (first_line >= 0) & bullet[np.maximum(first_line, 0)] if len(owner) else np.zeros(rows, dtype=bool)
    ends = np.where(listed, done, ends)  # 1. or a) end no sentence
    # marks
    chars = (size - 1).astype(float)
    tokens = counted(_runs(~space)[0])
    dots, many = _runs(code == ord("."))
    symbols = count(((kind & (LETTER | NUMBER | SPACE | PLAIN)) == 0) | (code == ord("_")) | (code == 9)) + counted(dots, many // 3)
    questions = np.flatnonzero(code[:-1] == ord("?"))
    symbols += counted(questions, code[questions + 1] == ord("!"))
    gaps, wide = _runs(code == 32)
    fit = (wide >= 3) & (gaps > 0) & ~space[np.maximum(gaps - 1, 0)] & ~is_a(gaps + wide, SPACE)
    quoted = count(code == ord("«")) > 0
    separators = count((kind & SEPARATOR) > 0) + counted(gaps, fit) + np.where(quoted, 0.0, count(code == ord("»")))
    return {
        "words": words, "mean_word_length": np.where(n > 0, letter_sum / np.maximum(words, 1), 0.0), "lines": lines,
        "punctuated_lines": np.where(lines > 0, done / np.maximum(lines, 1), 0.0),
        "common_share": np.where(tokens > 0, (usual + 3.0) / (words + 6.0), 0.5),
        "symbol_ratio": symbols / (chars + 10.0),
        "digit_ratio": counted(_runs((kind & NUMBER) > 0)[0]) / (tokens + 4.0),
        "token_length": (size - count(space) + 30.0) / (tokens + 6.0),
        "item_breaks": np.where(lines > 0, broken / np.maximum(lines + ends, 1), 0.0),
        "separator_ratio": separators / (words + 4.0), "comma_ratio": count((kind & COMMA) > 0) / (words + 4.0),
        "word_variety": variety, "sentence_length": words / (ends + 1.0), "chars": chars, "breaks": lines + ends,
    }, held


_BULLETS = np.array([ord(c) for c in "-–—*+•·▪>"], dtype=np.uint32)
NAMES = (
    "words", "mean_word_length", "lines", "punctuated_lines", "common_share", "symbol_ratio", "digit_ratio", "token_length", "item_breaks", "separator_ratio",
    "comma_ratio", "word_variety", "sentence_length", "chars", "breaks",
)
