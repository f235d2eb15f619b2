"""Documents into containers of fixed capacity, by bounded-space online packing.

Each task keeps a fixed number of open windows. A piece goes to the fullest
window that still holds it; when none does and all windows are open, the fullest
is closed. What is open at the end of a task are leftovers: these are merged
over groups of tasks, best fit decreasing, and groups of groups, until one is
left; each time only a fixed number of the emptiest containers moves on.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.tokens import VOCABULARY, encode
from wayloom.session import checkpointed

CAPACITY = 2048
#: Open windows of a task.
WINDOWS = 96
#: Groups whose leftovers are merged together.
FAN_IN = 32


class OpenWindows:
    """A bounded number of partly filled windows."""

    def __init__(self, capacity: int, most: int, first: int) -> None:
        self.capacity, self.most, self.next = capacity, most, first
        self.open: list[tuple[int, int]] = []  # (room, window), by room

    def place(self, size: int) -> int:
        """The window that takes a piece of this size."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)
            room, window = self.capacity, self.next
            self.next += 1
        if room > size:
            insort(self.open, (room - size, window))
        return window


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin of each item, fill of each bin)."""
    rooms: list[tuple[int, int]] = []
    bins, fills = [0] * len(sizes), []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(rooms, (sizes[item], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[item] = b
        fills[b] += sizes[item]
        if room > sizes[item]:
            insort(rooms, (room - sizes[item], b))
    return bins, fills


def text_digest() -> Column:
    """Digest of ``text``, by which rows of one ``doc_id`` are told apart; null and empty text are the same."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _counted(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, digest, tokens`` of each row."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(ids) for ids in encode(batch.column("text").to_pylist(), vocabulary)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(n, pa.int64())], names=["doc_id", "digest", "tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", text_digest().alias("digest")).mapInArrow(count, f"doc_id {kind}, digest binary, tokens bigint")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, tokens`` of each row of ``documents`` (``doc_id, text``); 0 for null and empty text."""
    return _counted(documents, vocabulary).drop("digest")


def _packer(capacity: int, windows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        state = OpenWindows(capacity, windows, task << 36)
        names = ["doc_id", "piece", "start", "tokens", "window", "task"]
        key_type = None
        for batch in batches:
            keys = batch.column("doc_id")
            key_type = keys.type
            row, piece, start, size, window = [], [], [], [], []
            for r, total in enumerate(batch.column("tokens").to_pylist()):
                if total == 0:
                    row.append(r), piece.append(0), start.append(0), size.append(0), window.append(None)
                for p, at in enumerate(range(0, total, capacity)):
                    n = min(capacity, total - at)
                    row.append(r), piece.append(p), start.append(at), size.append(n), window.append(state.place(n))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(window, pa.int64()), pa.nulls(len(row), pa.int32())],
                names=names,
            )
        if state.open:  # leftovers: rows with a task and no document
            n = len(state.open)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, key_type), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([capacity - room for room, _ in state.open], pa.int64()), pa.array([w for _, w in state.open], pa.int64()), pa.array([task] * n, pa.int32())],
                names=names,
            )

    return pack


def _merger(capacity: int, keep: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """Rows (grp, window, unit, fill): units of a group are packed anew; of the new ones the emptiest ``keep`` move on."""
        units = rows.groupby("unit", sort=True).fill.first()
        bins, fills = best_fit_decreasing(units.tolist(), capacity)
        names = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(names, np.array(bins), units.index.to_numpy())  # a container is named after its first window
        at = pd.Series(bins, index=units.index)
        open_ones = set(sorted(range(len(fills)), key=lambda b: (fills[b], b))[:keep])
        b = at.loc[rows.unit].to_numpy()
        return pd.DataFrame(
            {"grp": rows.grp.to_numpy(), "window": rows.window.to_numpy(), "unit": names[b], "fill": np.array(fills)[b], "moves": [x in open_ones for x in b]}
        )

    return merge


def pack_documents(
    documents: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS, vocabulary: str = VOCABULARY, sizes: DataFrame | None = None
) -> DataFrame:
    """``doc_id, piece, start, tokens, container`` of each document.

    A document of at most ``capacity`` tokens is one piece; a longer one is split
    into full pieces and a rest (``piece`` from 0, ``start`` in tokens). No
    container holds more than ``capacity``. Rows repeating a ``doc_id`` with the
    same text (of ``sizes``: with the same size) count once; null ids are ids, and
    different texts under one id are documents of their own. Documents without tokens take no
    room: their container is null. ``sizes`` (``doc_id, tokens``) stands in for
    counting tokens. Which container a document gets depends on the order in
    which tasks see documents, which is written down once.
    """
    counted = sizes.distinct() if sizes is not None else _counted(documents, vocabulary).distinct().drop("digest")
    kind = counted.schema["doc_id"].dataType.simpleString()
    # read several times and not repeatable in its order: written to the shared checkpoint folder
    placed = checkpointed(
        counted.mapInArrow(_packer(capacity, windows), f"doc_id {kind}, piece int, start bigint, tokens bigint, window bigint, task int")
    )
    left = placed.where("task is not null").select(F.col("task").alias("grp"), "window", F.col("window").alias("unit"), F.col("tokens").alias("fill"))
    tasks = (left.agg(F.max("grp")).first()[0] or 0) + 1
    merged = None
    while True:
        tasks = -(-tasks // FAN_IN)
        step = checkpointed(
            left.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("int"))
            .groupBy("grp").applyInPandas(_merger(capacity, windows), "grp int, window bigint, unit bigint, fill bigint, moves boolean")
        )
        done = step if tasks == 1 else step.where("not moves")
        merged = done if merged is None else merged.unionByName(done)
        if tasks == 1:
            break
        left = step.where("moves").drop("moves")
    return (
        placed.where("task is null")
        .join(merged.select("window", "unit"), "window", "left")
        .select("doc_id", "piece", "start", "tokens", F.coalesce("unit", "window").alias("container"))
    )


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the fewest possible, tokens, the unused share and the fullest container."""
    each = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("fill"))
    return each.agg(
        F.count("*").alias("containers"),
        F.ceil(F.sum("fill") / capacity).alias("fewest"),
        F.sum("fill").alias("tokens"),
        F.round(1 - F.sum("fill") / (F.count("*") * capacity), 6).alias("unused_share"),
        F.max("fill").alias("fullest"),
    )
