"""Freely typed values to the entry of a reference list that they mean.

A BK-tree over all accepted wordings, under the unrestricted
Damerau-Levenshtein distance (a true metric, so the triangle inequality may
prune), returns every wording within the threshold of a typed value; a second
one, over the beginnings of wordings, does the same for abbreviations. Every
answer comes out of a tree. Words that people put around an entry without
changing its meaning are learned from the typed values themselves. A short
reference list is broadcast whole; a longer one is split into shards, each value
is looked up in each shard, and the shards' winners are merged.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.unpack import BLANK, SPECIAL, unpack
from wayloom.session import checkpointed

#: Wordings up to which the reference list is broadcast; beyond that it is sharded.
MAX_BROADCAST_WORDINGS = 5_000
#: Wordings in a shard, and values looked up in one task of a shard.
SHARD_WORDINGS, TASK_VALUES = 5_000, 200_000
#: A phrase is a remark if it stands before, or after, the wordings of at least so many different entries. Up to MOST_PHRASES are broadcast; beyond that each value is joined with those that it holds.
PHRASE_ENTRIES, MOST_PHRASES = 3, 20_000

# Marks that part a remark at the end from what it is about: brackets, a dash, a delimiter inside one value.
REMARKS = re.compile(r"\s*(?:\([^()]*\)|\s-+\s*\w[\w ]*|[,;|/]\s*[\w\"][\w\" ]*)\s*$")
# Where such a remark may begin, in folded text.
REMARK_STARTS = re.compile(r" ?[(,;|/]| -")
# Letters that digits stand in for, and marks at a value's end.
LEET = str.maketrans("013457", "oieast")
TAIL = " .!?*_-~:#"


def distance(a: str, b: str, limit: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, and swap neighbours with edits between.

    With ``limit`` the search stops once the distance must exceed it; what comes
    back is then only known to be larger than the limit.
    """
    if a == b:
        return 0
    if limit is not None and abs(len(a) - len(b)) > limit:
        return abs(len(a) - len(b))
    n, m = len(a), len(b)
    big = n + m
    last: dict[str, int] = {}
    d = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        match = 0
        row, above = d[i + 1], d[i]
        x = a[i - 1]
        for j in range(1, m + 1):
            k, same = last.get(b[j - 1], 0), match
            if x == b[j - 1]:
                cost, match = 0, j
            else:
                cost = 1
            row[j + 1] = min(above[j] + cost, row[j] + 1, above[j + 1] + 1, d[k][same] + (i - k - 1) + 1 + (j - same - 1))
        last[x] = i
    return d[n + 1][m + 1]


class BKTree:
    """Words with their entries, searched within a distance."""

    def __init__(self, words: Iterable[tuple[str, int]] = ()) -> None:
        self.root: list | None = None
        for word, entry in words:
            self.add(word, entry)

    def add(self, word: str, entry: int) -> None:
        node = [word, {entry}, {}]
        if self.root is None:
            self.root = node
            return
        at = self.root
        while True:
            d = distance(word, at[0])
            if d == 0:
                at[1].add(entry)
                return
            if d not in at[2]:
                at[2][d] = node
                return
            at = at[2][d]

    def within(self, word: str, most: int) -> list[tuple[int, str, int]]:
        """(distance, wording, entry) of all wordings at most that far away."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            own, entries, children = todo.pop()
            d = distance(word, own, most + max(children, default=0))
            if d <= most:
                out += [(d, own, e) for e in entries]
            # |d(word, x) - d(own, x)| <= d(word, own) for every x below
            todo += [child for edge, child in children.items() if d - most <= edge <= d + most]
        return sorted(out)


def fold(text: str) -> str:
    """Lower case without accents, full-width forms or repeated blanks."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", plain).strip().casefold()


def compact(text: str) -> str:
    """Letters and digits only, digits inside words as the letters they stand for."""
    words = re.split(r"[^0-9a-z]+", text)
    return "".join(w.translate(LEET) if re.search("[a-z]", w) and re.search("[0-9]", w) else w for w in words)


def single_tail(text: str) -> str:
    """A repeated last letter once."""
    return re.sub(r"(.)\1+$", r"\1", text)


def threshold(length: int) -> int:
    """Typing errors allowed in a wording of that length."""
    return 0 if length <= 2 else 1 if length <= 4 else 2 if length <= 8 else 3


class Phrases:
    """Phrases that may be taken off a value, before or after what it means."""

    def __init__(self, leads: Iterable[str] = (), tails: Iterable[str] = ()) -> None:
        self.leads, self.tails = frozenset(leads), frozenset(tails)
        self.most = max((p.count(" ") + 1 for p in self.leads | self.tails), default=0)

    def off(self, text: str) -> str:
        """Folded text without the longest phrase."""
        words = text.split(" ")
        for k in range(min(self.most, len(words) - 1), 0, -1):
            if " ".join(words[:k]) in self.leads:
                return " ".join(words[k:])
            if " ".join(words[-k:]) in self.tails:
                return " ".join(words[:-k])
        return text


def held(value: str, most: int) -> set[tuple[bool, str]]:
    """(leads, phrase) of all phrases of at most ``most`` words that could be taken off a value, now or once others and remarks are off.

    What is left of a value begins with one of its words and ends with one, or
    where a remark begins.
    """
    text = fold(value)
    starts = [0, *(m.end() for m in re.finditer(" ", text))]
    ends = [s - 1 for s in starts[1:]]
    out = {(True, text[s:e]) for k, s in enumerate(starts) for e in ends[k : k + most]}
    for end in {*ends, len(text), *(m.start() for m in REMARK_STARTS.finditer(text))}:
        inside = bisect_left(starts, end)
        out |= {(False, text[s:end]) for s in starts[max(1, inside - most) : inside]}
    return out


class Mapper:
    """Finds the entries a typed value may mean among the wordings of one field.

    ``find`` gives (rank, cost, entry), the best first: 0 the wording itself, 1
    the wording with a drawn-out last letter, 2 the beginning of a wording
    followed by dots, 3 a wording within the threshold of typing errors, 4 the
    bare beginning of a wording. All are answers of a BK-tree: of the wordings
    (0 and 3), of the wordings with their last letter once (1), and of the
    beginnings of wordings (2 and 4), the last three at distance 0 but for typing errors.
    ``leads`` and ``tails`` are phrases that may be taken off a value.
    """

    def __init__(self, wordings: Iterable[tuple[str, int]], leads: Iterable[str] = (), tails: Iterable[str] = ()) -> None:
        words = sorted({(word, entry) for text, entry in wordings if (word := compact(fold(text)))})
        self.tree = BKTree(words)
        self.drawn = BKTree(sorted((single_tail(w), e) for w, e in words))
        self.beginnings = BKTree(_halved(sorted({(w[:k], (len(w) - k, e)) for w, e in words for k in range(3, len(w))})))
        self.longest = max((len(w) for w, _ in words), default=0)
        self.off = Phrases(leads, tails)
        self.known: dict[str, tuple[int, int, int, int, int] | None] = {}

    def readings(self, value: str, off: Phrases | None = None) -> list[tuple[str, bool]]:
        """Compact forms to try in turn, each with whether dots cut it off: the value itself, then without remarks and learned phrases."""
        text = fold(value)
        forms, off = [text], off or self.off
        while True:
            shorter = REMARKS.sub("", text)
            if shorter == text or not shorter:
                shorter = off.off(text)
            if shorter == text or not shorter:
                break
            forms.append(text := shorter)
        out: dict[str, bool] = {}
        for form in forms:
            if word := compact(form.strip(TAIL)):
                out.setdefault(word, form.rstrip(" ").endswith("."))
        return list(out.items())

    def phrases(self, value: str) -> list[tuple[bool, str, int]]:
        """(leads, phrase, entry) where a value is a wording with something before or after it."""
        words = fold(value).split(" ")
        out = []
        for leads in (True, False):
            rest = ""
            for k in range(1, len(words)):
                # a blank parts what is made compact, so the rest grows word by word
                rest = compact(words[-k]) + rest if leads else rest + compact(words[k - 1])
                if len(rest) > self.longest:
                    break
                if rest and (hits := self.tree.within(rest, 0)):
                    phrase = " ".join(words[:-k] if leads else words[k:])
                    out += [(leads, phrase, entry) for _, _, entry in hits]
        return out

    def find(self, value: str) -> tuple[int, int, int] | None:
        hit = self.order(value)
        return hit and (hit[0], hit[2], hit[4])

    def order(self, value: str) -> tuple[int, int, int, int, int] | None:
        """(rank, number of the reading, cost, letters in common at the beginning as a negative number, entry): the least over any split of the wordings is what all of them together give."""
        if value not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[value] = self._order(value)
        return self.known[value]

    def order_without(self, value: str, leads: Iterable[str], tails: Iterable[str]) -> tuple[int, int, int, int, int] | None:
        """``order`` where a value comes with the phrases that may be taken off it."""
        return self._order(value, Phrases(leads, tails))

    def _order(self, value: str, off: Phrases | None = None) -> tuple[int, int, int, int, int] | None:
        readings = self.readings(value, off)
        for k, (word, _) in enumerate(readings):
            if hits := self.tree.within(word, 0):
                return 0, k, 0, 0, hits[0][2]
        for k, (word, _) in enumerate(readings):
            if len(short := single_tail(word)) < len(word) and (hits := self.drawn.within(short, 0)):
                return 1, k, 0, 0, hits[0][2]
        for k, (word, cut) in enumerate(reversed(readings)):
            if cut and len(word) >= 3 and (hits := self.beginnings.within(word, 0)):
                missing, entry = min(e for *_, e in hits)
                return 2, k, missing, 0, entry
        for k, (word, _) in enumerate(reversed(readings)):
            best = min(
                ((d, -self._alike(word, w), e) for form in {word, single_tail(word)} for d, w, e in self.tree.within(form, threshold(len(form)))),
                default=None,
            )
            if best:
                return 3, k, *best
        for k, (word, _) in enumerate(reversed(readings)):
            if len(word) >= 4 and (hits := self.beginnings.within(word, 0)):
                missing, entry = min(e for *_, e in hits)
                return 4, k, missing, 0, entry
        return None

    @staticmethod
    def _alike(a: str, b: str) -> int:
        """Letters that both begin with, to settle ties."""
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n


def _halved(words: list) -> list:
    """Sorted words in an order that keeps a tree of them shallow: the middle first, then those of either half."""
    out, todo = [], [(0, len(words))]
    for lo, hi in todo:
        if lo < hi:
            mid = (lo + hi) // 2
            out.append(words[mid])
            todo += [(lo, mid), (mid + 1, hi)]
    return out


_MAPPERS: dict[int, dict[str, Mapper]] = {}


def _mappers(model: tuple) -> dict[str, Mapper]:
    """Each field's mapper, built once a worker process."""
    wordings, phrases = model
    mark = hash(model)
    if mark not in _MAPPERS:
        by_field: dict[str, list[tuple[str, int]]] = {}
        for field, wording, ref in wordings:
            by_field.setdefault(field, []).append((wording, ref))
        if len(_MAPPERS) > 3:
            _MAPPERS.clear()
        _MAPPERS[mark] = {f: Mapper(w, [p for g, leads, p in phrases if g == f and leads], [p for g, leads, p in phrases if g == f and not leads]) for f, w in by_field.items()}
    return _MAPPERS[mark]


def wordings_of(reference: DataFrame) -> DataFrame:
    """(field, wording, ref_id) of all canonical values and their aliases."""
    return reference.select(
        "field", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("wording"), "ref_id"
    ).where("field is not null and wording is not null")


def free_entries(df: DataFrame, key: str, fields: Sequence[str], reference: DataFrame) -> DataFrame:
    """(key, field, entry, value) of entries that aren't blank, hold one value, and aren't a canonical value as it stands.

    Rows equal in key and entry count once. ``value`` is the entry without list
    wrapping.
    """
    def value(text: Column) -> Column:
        return F.when(text.rlike(SPECIAL), unpack(text)).otherwise(F.array(text))

    canonical = reference.select("field", F.col("canonical").alias("entry")).distinct()
    cells = df.select(F.col(key).alias("_key"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("entry")) for f in fields])))
    return (
        cells.where(F.col("entry").rlike(f"[^{BLANK}]"))
        .join(canonical, ["field", "entry"], "left_anti")
        .withColumn("_values", value(F.col("entry")))
        .where(F.size("_values") == 1)
        .select("_key", "field", "entry", F.element_at("_values", 1).alias("value"))
        .distinct()
        .withColumnRenamed("_key", key)
    )


def _broadcast_lookup(wordings: tuple, phrases: tuple):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappers = _mappers((wordings, phrases))
        for batch in batches:
            out = []
            for field, value in zip(batch.column("field").to_pylist(), batch.column("value").to_pylist()):
                hit = mappers[field].find(value) if field in mappers else None
                out.append(hit or (None, None, 0))
            rank, cost, ref = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ref, pa.int32()), pa.array(rank, pa.int32()), pa.array(cost, pa.int32())],
                names=[*batch.schema.names, "ref_id", "rank", "cost"],
            )

    return look


def _broadcast_lookup_each(wordings: tuple):
    """As _broadcast_lookup, for values that come with their phrases."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappers = _mappers((wordings, ()))
        for batch in batches:
            out = []
            for field, value, leads, tails in zip(*(batch.column(c).to_pylist() for c in ("field", "value", "leads", "tails"))):
                if field in mappers and (hit := mappers[field].order_without(value, leads, tails)):
                    out.append((field, value, hit[4], hit[0], hit[2]))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], names=["field", "value", "ref_id", "rank", "cost"])

    return look


def _held(most: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.string(), pa.bool_(), pa.string()))], names=["field", "value", "leads", "phrase"])

        for batch in batches:
            out = []
            for field, value in zip(batch.column("field").to_pylist(), batch.column("value").to_pylist()):
                out += [(field, value, *p) for p in held(value, most)]
                if len(out) > 50_000:
                    yield handed()
                    out = []
            yield handed()

    return look


def _broadcast_phrases(wordings: tuple):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappers = _mappers((wordings, ()))
        for batch in batches:
            out = [(f, *p) for f, v in zip(batch.column("field").to_pylist(), batch.column("value").to_pylist()) if f in mappers for p in mappers[f].phrases(v)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.bool_(), pa.string(), pa.int32()))], names=["field", "leads", "phrase", "ref_id"])

    return look


def _shard_phrases(key, values: pd.DataFrame, wordings: pd.DataFrame) -> pd.DataFrame:
    out = []
    for field, own in values.groupby("field"):
        mapper = Mapper(wordings[wordings.field == field][["wording", "ref_id"]].itertuples(index=False, name=None))
        out += [(field, *p) for v in own.value for p in mapper.phrases(v)]
    return pd.DataFrame(out, columns=["field", "leads", "phrase", "ref_id"])


def _shard_lookup(phrases: tuple | None):
    """``phrases`` None: values come with their own."""
    def look(key, values: pd.DataFrame, wordings: pd.DataFrame) -> pd.DataFrame:
        out = []
        for field, own in values.groupby("field"):
            mine = wordings[wordings.field == field][["wording", "ref_id"]].itertuples(index=False, name=None)
            if phrases is None:
                mapper = Mapper(mine)
                out += [(field, v, *hit) for v, leads, tails in zip(own.value, own.leads, own.tails) if (hit := mapper.order_without(v, leads, tails))]
                continue
            mapper = Mapper(mine, [p for g, leads, p in phrases if g == field and leads], [p for g, leads, p in phrases if g == field and not leads])
            out += [(field, v, *hit) for v in own.value if (hit := mapper.order(v))]
        numbers = ["rank", "reading", "cost", "unlike", "ref_id"]
        return pd.DataFrame(out, columns=["field", "value", *numbers]).astype({n: "int32" for n in numbers})

    return look


def _learned(phrases: DataFrame) -> DataFrame:
    """Of (field, leads, phrase, ref_id): the phrases that stand beside the wordings of PHRASE_ENTRIES entries."""
    counted = phrases.groupBy("field", "leads", "phrase").agg(F.count_distinct("ref_id").alias("n"))
    return checkpointed(counted.where(F.col("n") >= PHRASE_ENTRIES).select("field", "leads", "phrase"))


def _listed(learned: DataFrame) -> tuple | None:
    """All phrases, or None if they are too many to be broadcast."""
    rows = learned.limit(MOST_PHRASES + 1).collect()
    return tuple(sorted((r.field, r.leads, r.phrase) for r in rows)) if len(rows) <= MOST_PHRASES else None


def _with_phrases(distinct: DataFrame, learned: DataFrame) -> DataFrame:
    """``distinct`` with ``leads`` and ``tails``: the learned phrases that may be taken off each value."""
    most = learned.agg(F.max(F.size(F.split("phrase", " ")))).first()[0]
    own = (
        distinct.mapInArrow(_held(most), "field string, value string, leads boolean, phrase string")
        .join(learned, ["field", "leads", "phrase"])
        .groupBy("field", "value")
        .agg(F.collect_list(F.when(F.col("leads"), F.col("phrase"))).alias("leads"), F.collect_list(F.when(~F.col("leads"), F.col("phrase"))).alias("tails"))
    )
    none = F.array().cast("array<string>")
    return distinct.join(own, ["field", "value"], "left").select("field", "value", F.coalesce("leads", none).alias("leads"), F.coalesce("tails", none).alias("tails"))


def map_to_canonical(entries: DataFrame, reference: DataFrame, max_broadcast: int = MAX_BROADCAST_WORDINGS, shard_wordings: int = SHARD_WORDINGS) -> DataFrame:
    """``entries`` (with ``field`` and ``value``) plus ``ref_id`` (0: none), ``rank`` and ``cost``.

    ``reference`` has ``ref_id int, field, canonical, aliases array<string>``.
    Null or blank values mean none; of entries equally near, the one that begins
    alike wins, then the lower id. The size of the reference list is looked at:
    up to ``max_broadcast`` wordings every worker builds the whole trees, beyond
    that the list is sharded, each distinct value is looked up in every shard in
    tasks of bounded size, and the best of all shards is joined back: the same
    answer. Distinct values are gone through once before, for the phrases that
    people put around entries. Up to MOST_PHRASES of these go to every worker;
    if there are more, each distinct value is joined with those that it holds.
    """
    wordings = wordings_of(reference)
    listed = [tuple(r) for r in wordings.limit(max_broadcast + 1).collect()]
    entries = entries.withColumn("value", F.coalesce("value", F.lit("")))
    distinct = entries.select("field", "value").distinct()
    found = "field string, leads boolean, phrase string, ref_id int"
    if len(listed) <= max_broadcast:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema]
        known = tuple(sorted(listed))
        learned = _learned(distinct.mapInArrow(_broadcast_phrases(known), found))
        if (phrases := _listed(learned)) is not None:
            return entries.mapInArrow(_broadcast_lookup(known, phrases), ", ".join([*fields, "ref_id int", "rank int", "cost int"]))
        won = _with_phrases(checkpointed(distinct), learned).mapInArrow(_broadcast_lookup_each(known), "field string, value string, ref_id int, rank int, cost int")
        joined = entries.join(won, ["field", "value"], "left").withColumn("ref_id", F.coalesce("ref_id", F.lit(0)))
        return joined.select(*[f"`{c}`" for c in entries.columns], "ref_id", "rank", "cost")
    distinct = checkpointed(distinct)
    shards = -(-wordings.count() // shard_wordings)
    salts = -(-distinct.count() // TASK_VALUES) or 1
    right = wordings.withColumn("shard", F.pmod(F.xxhash64("field", "wording"), F.lit(shards)).cast("int")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    ).groupBy("shard", "salt")

    def met(values: DataFrame):
        salted = values.withColumn("salt", F.pmod(F.xxhash64("field", "value"), F.lit(salts)).cast("int"))
        return salted.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("shard", "salt").cogroup(right)

    learned = _learned(met(distinct).applyInPandas(_shard_phrases, found))
    phrases = _listed(learned)
    won = (
        met(distinct if phrases is not None else _with_phrases(distinct, learned))
        .applyInPandas(_shard_lookup(phrases), "field string, value string, rank int, reading int, cost int, unlike int, ref_id int")
        .groupBy("field", "value").agg(F.min(F.struct("rank", "reading", "cost", "unlike", "ref_id")).alias("best"))
        .select("field", "value", "best.ref_id", "best.rank", "best.cost")
    )
    return entries.join(won, ["field", "value"], "left").withColumn("ref_id", F.coalesce("ref_id", F.lit(0)))


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """``field, value, records`` of values that mean no entry."""
    return mapped.where("ref_id = 0").groupBy("field", "value").agg(F.count("*").alias("records"))
