"""How often every distinct term occurs, and in how many records.

Each task counts into burst tries: a container holds the rest of each term under
a common prefix with its two counters, and bursts into one container per next
letter when it has grown too large, so frequent prefixes get deep routes and
rare ones stay shallow. Tasks hand over their containers as compact subtrees.

Where these meet is learned from their own sizes: a route is a prefix below which
about ROUTE_TERMS terms lie, longer where terms crowd. Subtrees are cut at the
routes, sent by route, and all that share one are merged at once, in Arrow; a
route's terms are all that a task holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.unpack import unpack_each
from wayloom.session import checkpointed

#: Terms that a container holds before it bursts.
BURST = 512
#: Terms that a task holds before it hands over what it has; counts add up anyway.
FLUSH = 400_000


class BurstTrie:
    """Terms with an occurrence and a record counter each."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.size = 0
        self.root: dict = {}  # a container: rest of the term -> [occurrences, records]

    def add(self, term: str, occurrences: int, records: int) -> None:
        parent, letter, node, at = None, "", self.root, 0
        while isinstance(node, tuple):
            inner, ends = node
            if at == len(term):
                ends[0] += occurrences
                ends[1] += records
                return
            letter = term[at]
            at += 1
            if letter not in inner:
                inner[letter] = {}
            parent, node = inner, inner[letter]
        counters = node.get(term[at:])
        if counters is None:
            node[term[at:]] = [occurrences, records]
            self.size += 1
            if len(node) > self.burst:
                grown = self._burst(node)
                if parent is None:
                    self.root = grown
                else:
                    parent[letter] = grown
        else:
            counters[0] += occurrences
            counters[1] += records

    def _burst(self, container: dict) -> tuple[dict, list[int]]:
        inner: dict = {}
        ends = [0, 0]
        for rest, counters in container.items():
            if rest == "":
                ends[0] += counters[0]
                ends[1] += counters[1]
            else:
                inner.setdefault(rest[0], {})[rest[1:]] = counters
        return {c: self._burst(sub) if len(sub) > self.burst else sub for c, sub in inner.items()}, ends

    def subtrees(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """(prefix, rests, occurrences, records) of each container."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if isinstance(node, tuple):
                inner, ends = node
                if ends[1]:
                    yield prefix, [""], [ends[0]], [ends[1]]
                todo += [(prefix + c, child) for c, child in inner.items()]
            elif node:
                rests = sorted(node)
                yield prefix, rests, [node[r][0] for r in rests], [node[r][1] for r in rests]


_SUBTREES = "field string, prefix string, rests array<string>, occurrences array<bigint>, records array<bigint>, counted bigint"
_ARROW = pa.schema(
    [("field", pa.string()), ("prefix", pa.string()), ("rests", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64())), ("counted", pa.int64())]
)


def _count_batches(batches: Iterator[pa.RecordBatch], burst: int = BURST) -> Iterator[pa.RecordBatch]:
    tries: dict[str, BurstTrie] = {}
    counted: dict[str, int] = {}

    def handed_over() -> pa.RecordBatch:
        rows = [(f, *s, 0) for f, trie in tries.items() for s in trie.subtrees()] + [(f, None, [], [], [], n) for f, n in counted.items()]
        tries.clear()
        counted.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)] if rows else [pa.array([], t.type) for t in _ARROW], schema=_ARROW)

    for batch in batches:
        table = pa.Table.from_batches([batch]).combine_chunks()
        for field in pc.unique(table.column("field")).to_pylist():
            terms = table.filter(pc.equal(table.column("field"), field)).column("terms").combine_chunks()
            counted[field] = counted.get(field, 0) + len(terms)
            codes = pc.dictionary_encode(terms.flatten())
            words = codes.dictionary.to_pylist()
            code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            record = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            occurrences = np.bincount(code, minlength=len(words))
            records = np.bincount(np.unique(record * len(words) + code) % max(1, len(words)), minlength=len(words))
            trie = tries.setdefault(field, BurstTrie(burst))
            for word, o, r in zip(words, occurrences.tolist(), records.tolist()):
                trie.add(word, o, r)
        if sum(t.size for t in tries.values()) > FLUSH:
            yield handed_over()
    yield handed_over()


#: Terms, over all tasks, that a route should have; and routes that the driver may see. With more terms, routes grow instead.
ROUTE_TERMS, MOST_ROUTES = 20_000, 100_000


def learn_routes(subtrees: DataFrame, route_terms: int = ROUTE_TERMS) -> dict[str, dict[str, int]]:
    """For each field, the prefixes where routes part, each with the number of hands that its terms are dealt out to.

    A prefix is a route if more than ``route_terms`` terms of all subtrees lie
    below it. Subtrees count by their whole prefix and every beginning of it, so
    routes are as deep as the tasks' tries have burst. What a route has besides
    longer ones, as where many tasks hand over small tries, is dealt out by a
    hash of the terms if it is too much.
    """
    sized = subtrees.where("prefix is not null").select("field", "prefix", F.size("rests").alias("n"))
    totals = sized.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.length("prefix") + 1)).alias("counted")).first()
    least = max(route_terms, (totals["counted"] or 0) // MOST_ROUTES)  # so there are at most MOST_ROUTES
    beginnings = F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda k: F.substring("prefix", F.lit(1), k))
    rows = sized.select("field", F.explode(beginnings).alias("prefix"), "n").groupBy("field", "prefix").agg(F.sum("n").alias("n")).where((F.col("n") > least) | (F.col("prefix") == "")).collect()
    out: dict[str, dict[str, int]] = {}
    loads = {(r.field, r.prefix): r.n for r in rows}
    own = dict(loads)
    for field, prefix in loads:
        above = next((prefix[:k] for k in range(len(prefix) - 1, -1, -1) if (field, prefix[:k]) in loads), None)
        if above is not None:
            own[field, above] -= loads[field, prefix]
    for (field, prefix), n in own.items():
        out.setdefault(field, {})[prefix] = max(1, -(-n // least))
    return out


_ROUTED = "field string, route string, hand int, prefix string, rests array<string>, occurrences array<bigint>, records array<bigint>"


def _cut_at_routes(routes: dict[str, dict[str, int]]):
    """Each subtree to its longest route and hand; a subtree above several is cut into the pieces that each of them is to have."""
    deepest = {f: max(map(len, p)) for f, p in routes.items()}
    above = {f: {p[:k] for p in own for k in range(len(p))} for f, own in routes.items()}

    def route_of(field: str, term: str) -> tuple[str, int]:
        known = routes.get(field, {})
        for k in range(min(len(term), deepest.get(field, 0)), -1, -1):
            if hands := known.get(term[:k]):
                return term[:k], zlib.crc32(term.encode()) % hands if hands > 1 else 0
        return "", 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ("rests", "occurrences", "records")
        schema = pa.schema([("field", pa.string()), ("route", pa.string()), ("hand", pa.int32()), ("prefix", pa.string()), *[(n, _ARROW.field(n).type) for n in lists]])
        for batch in batches:
            out: list[tuple] = []
            for field, prefix, *held in zip(*[batch.column(n).to_pylist() for n in ("field", "prefix", *lists)]):
                pieces: dict[tuple[str, int], list[int]] = {}
                if prefix in above.get(field, ()) or routes.get(field, {}).get(route_of(field, prefix)[0], 1) > 1:
                    for k, rest in enumerate(held[0]):
                        pieces.setdefault(route_of(field, prefix + rest), []).append(k)
                    out += [(field, *route, prefix, *[[values[k] for k in own] for values in held]) for route, own in pieces.items()]
                else:
                    out.append((field, *route_of(field, prefix), prefix, *held))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return cut


def _merge_subtrees(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One route's subtrees, of equal or different depth, as one: their terms with all counters added up."""
    rests = table.column("rests").combine_chunks()
    parent = pc.list_parent_indices(rests)
    terms = pc.binary_join_element_wise(table.column("prefix").combine_chunks().take(parent), rests.flatten(), "")
    counters = {n: table.column(n).combine_chunks().flatten() for n in ("occurrences", "records")}
    merged = pa.table({"term": terms, **counters}).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
    return pa.table({"field": pa.array([key[0].as_py()] * merged.num_rows, pa.string()), "term": merged.column("term"), "occurrences": merged.column("occurrences_sum"), "records": merged.column("records_sum")})


def term_frequencies(terms: DataFrame, route_terms: int = ROUTE_TERMS, burst: int = BURST) -> tuple[DataFrame, DataFrame]:
    """Counts of ``terms`` (``field string, terms array<string>``, one row for each record and field).

    Gives (``field, term, occurrences, records``) and (``field, counted``), the
    records of each field. Null arrays and null terms don't count; an empty array
    is no record.
    """
    clean = terms.select("field", F.filter("terms", lambda t: t.isNotNull()).alias("terms")).where(F.col("field").isNotNull() & (F.size("terms") > 0))
    # the subtrees are read twice, to learn the routes and to merge, and are small against the records
    subtrees = checkpointed(clean.mapInArrow(partial(_count_batches, burst=burst), _SUBTREES))
    routes = learn_routes(subtrees, route_terms)
    cut = subtrees.where("prefix is not null").mapInArrow(_cut_at_routes(routes), _ROUTED)
    merged = cut.groupBy("field", "route", "hand").applyInArrow(_merge_subtrees, "field string, term string, occurrences bigint, records bigint")
    return merged, subtrees.where("prefix is null").groupBy("field").agg(F.sum("counted").alias("counted"))


def mark_terms(merged: DataFrame, counted: DataFrame, rare_records: int = 2, common_share: float = 0.1) -> DataFrame:
    """Adds ``share`` of the field's records and ``mark``: ``rare``, ``common`` or null.

    A term in at most ``rare_records`` records is rare even where that is a large
    share. ``counted`` has one row a field, so it is broadcast.
    """
    share = F.col("records") / F.col("counted")
    mark = F.when(F.col("records") <= rare_records, "rare").when(share > common_share, "common")
    return merged.join(F.broadcast(counted), "field").select("field", "term", "occurrences", "records", share.alias("share"), mark.alias("mark"))


def field_terms(df: DataFrame, key: str | Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``field, terms``: the unpacked values of each record's field in lower case, one row for each record and field that holds any.

    Rows equal in the key and the fields are one record.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kinds = dict(df.dtypes)
    records = df.select(*keys, *fields).distinct()
    strings = [F.col(f) if kinds[f] == "array<string>" else F.array(F.col(f)) for f in fields]
    made = [
        F.struct(F.lit(f).alias("field"), F.transform(F.flatten(unpack_each(s)), F.lower).alias("terms")) for f, s in zip(fields, strings)
    ]
    return records.select(F.inline(F.array(*made))).where(F.size("terms") > 0)
