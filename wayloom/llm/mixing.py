"""A mixture of sources in target shares of tokens.

1. A classifier learned from all documents whose source is known (multinomial
   naive Bayes over hashed tokens, its evidence weakened to the power that
   foretells recorded sources best) gives every document a posterior over the
   sources. A recorded source counts as evidence, by how far labels are trusted.
2. Rates, how often each document is used, between 0 and what its source allows,
   are found by projected-gradient least squares: the expected tokens of the
   sources are brought to their targets. Of all rates that do, those nearest to
   zero are chosen; they are the documents' posteriors times one price a source,
   cut off at their bounds, so only the prices need be kept and every step is one
   aggregate over all documents.
3. Rates become whole numbers of copies by error diffusion.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.packing import text_digest
from wayloom.llm.tokens import VOCABULARY, encode
from wayloom.session import checkpointed

#: Buckets of hashed tokens: bounds the model at buckets x sources numbers.
BUCKETS = 4096
#: Numbers that the model may have (64 MB); with more than 4,096 sources the tokens are hashed into fewer buckets, down to LEAST_BUCKETS at 65,536 sources.
MODEL_SIZE, LEAST_BUCKETS = 1 << 24, 256
#: How often a recorded source is right.
LABEL_TRUST = 0.999


def buckets_for(sources: int) -> int:
    """Buckets of hashed tokens for so many sources: the model always fits a broadcast."""
    return min(BUCKETS, max(LEAST_BUCKETS, MODEL_SIZE // max(1, sources)))


def _feature_batches(names: list[str], vocabulary: str):
    """(doc_id, digest, source, tokens, bucket, count) of each document, and each task's counts by source (tokens -1)."""
    known, width = set(names), buckets_for(len(names))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        columns = ["doc_id", "digest", "source", "tokens", "bucket", "count"]
        ints = pa.list_(pa.int32())
        key_type = digest_type = None
        for batch in batches:
            sources = batch.column("source").to_pylist()
            key_type, digest_type = batch.column("doc_id").type, batch.column("digest").type
            buckets, numbers, tokens = [], [], []
            for source, ids in zip(sources, encode(batch.column("text").to_pylist(), vocabulary)):
                tokens.append(len(ids))
                at, own = np.unique(np.asarray(ids, dtype=np.int64) % width, return_counts=True)
                if source in known:
                    if source not in counts:
                        counts[source] = np.zeros(width, dtype=np.int64)
                    counts[source][at] += own
                buckets.append(at.astype(np.int32))
                numbers.append(own.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array([s if s and s.strip() else None for s in sources], pa.string()), pa.array(tokens, pa.int64()), pa.array(buckets, ints), pa.array(numbers, ints)],
                names=columns,
            )
        for source, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, key_type), pa.nulls(1, digest_type), pa.array([source]), pa.array([-1], pa.int64()), pa.array([at.tolist()], ints), pa.array([own[at].tolist()], ints)], names=columns
            )

    return read


def fit_classifier(features: DataFrame, names: list[str]) -> np.ndarray:
    """Log-odds, sources x (buckets + prior), of naive Bayes over all documents of known source.

    The driver sees at most sources x buckets sums, in Arrow: MODEL_SIZE numbers.
    """
    table = (
        features.where("tokens = -1").select("source", F.explode(F.arrays_zip("bucket", "count")).alias("e"))
        .groupBy("source", F.col("e.bucket").alias("bucket")).agg(F.sum("e.count").alias("n")).toArrow()
    )
    at = {name: k for k, name in enumerate(names)}
    counts = np.full((len(names), buckets_for(len(names))), 0.5, dtype=np.float32)
    rows = np.array([at[x] for x in table.column("source").to_pylist()], dtype=np.int64)
    counts[rows, table.column("bucket").to_numpy().astype(np.int64)] += table.column("n").to_numpy()
    listed = F.broadcast(features.sparkSession.createDataFrame([(n,) for n in names], "source string"))
    documents = features.where(F.col("tokens") >= 0).join(listed, "source", "left_semi").groupBy("source").count().collect()
    prior = np.full(len(names), 1e-6)
    for r in documents:
        if r.source in at:
            prior[at[r.source]] = r["count"]
    return np.column_stack([np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(prior / prior.sum())]).astype(np.float32)


#: Powers that the evidence of a text may be taken to; the one that foretells recorded sources best is used.
POWERS = (0.0, 1 / 256, 1 / 128, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)


#: Numbers gathered at a time, so that a worker's memory is bounded.
CHUNK = 4_000_000


def _documents(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, document of each bucket, bucket, count) for runs of documents whose buckets times ``width`` stay within CHUNK."""
    n = pc.list_value_length(batch.column("bucket")).to_numpy(zero_copy_only=False).astype(np.int64)
    bucket, count = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("bucket", "count"))
    end = np.cumsum(n)
    lo = 0
    while lo < len(n):
        before = end[lo] - n[lo]
        hi = max(lo + 1, int(np.searchsorted(end, before + CHUNK // max(1, width), side="right")))
        own = slice(before, end[hi - 1])
        yield lo, hi, np.repeat(np.arange(hi - lo), n[lo:hi]), bucket[own], count[own]
        lo = hi


def _evidence(model: np.ndarray, rows: int, own: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(document x source) log-likelihoods of the documents' buckets, less the prior."""
    out = np.zeros((rows, len(model)))
    if len(own):
        first = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
        out[own[first]] = np.add.reduceat(model[:, :-1].T[bucket] * count[:, None].astype(np.float32), first, axis=0)
    return out


def _normal(score: np.ndarray) -> np.ndarray:
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def posteriors(model: np.ndarray, evidence: np.ndarray, power: float, labels: np.ndarray, trust: float = LABEL_TRUST) -> np.ndarray:
    """(document x source) memberships: the prior, the text's evidence to a power (its tokens aren't independent), and a recorded source (-1: none) as far as it is trusted."""
    score = model[:, -1] + power * evidence
    told = np.flatnonzero(labels >= 0)
    if len(model) > 1:
        score[told, labels[told]] += np.log(trust) - np.log((1 - trust) / (len(model) - 1))
    return _normal(score)


def fit_power(features: DataFrame, model, names: list[str]) -> float:
    """Which of POWERS gives recorded sources the greatest likelihood, over all documents that have one; each is left out of the counts it is judged by."""
    number = {n: k for k, n in enumerate(names)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, logs = np.zeros(len(POWERS)), model.value
        likely = np.exp(logs[:, :-1].astype(np.float64))
        for batch in batches:
            labels = np.array([number[s] for s in batch.column("source").to_pylist()], dtype=np.int64)
            for lo, hi, own, bucket, count in _documents(batch, len(names)):
                evidence, label = _evidence(logs, hi - lo, own, bucket, count), labels[lo:hi]
                # without the document's own counts its source foretells it less well
                size = model_tokens[label][own]
                left = np.log(np.maximum(likely[label[own], bucket] - count / size, 0.5 / size)) * count
                rows = np.arange(hi - lo)
                evidence[rows, label] = np.bincount(own, left, hi - lo)
                for k, power in enumerate(POWERS):
                    loss[k] -= np.log(np.maximum(_normal(logs[:, -1] + power * evidence)[rows, label], 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(POWERS)), pa.int32()), pa.array(loss)], names=["k", "loss"])

    model_tokens = model_sizes(features, names)
    rows = features.where("tokens > 0").join(F.broadcast(features.sparkSession.createDataFrame([(n,) for n in names], "source string")), "source", "left_semi")
    losses = {r.k: r.loss for r in rows.select("source", "bucket", "count").mapInArrow(add, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
    return POWERS[min(losses, key=losses.get)] if losses else 1.0


def model_sizes(features: DataFrame, names: list[str]) -> np.ndarray:
    """The tokens counted for each source, with those imagined."""
    counted = {r.source: float(r.n) for r in features.where("tokens = -1").select("source", F.aggregate("count", F.lit(0).cast("bigint"), lambda s, c: s + c).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    return np.array([counted.get(n, 0.0) for n in names]) + 0.5 * buckets_for(len(names))


def _membership(model, power: float, names: list[str], caps: np.ndarray, soft_cap: float, least: float = 1e-5):
    """(doc_id, source, tokens, cap, at, p): each document's likeliest sources; what is below ``least`` is left out and the rest adds up to one."""
    number = {n: k for k, n in enumerate(names)}

    def member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array([number.get(s, -1) for s in batch.column("source").to_pylist()], dtype=np.int64)
            sizes, at, shares = [], [], []
            for lo, hi, own, bucket, count in _documents(batch, len(names)):
                p = posteriors(model.value, _evidence(model.value, hi - lo, own, bucket, count), power, labels[lo:hi])
                kept = p >= np.minimum(least, p.max(axis=1, keepdims=True))
                p = np.where(kept, p, 0.0)
                p /= p.sum(axis=1, keepdims=True)
                sizes.append(kept.sum(axis=1))
                at.append(np.nonzero(kept)[1].astype(np.int32))
                shares.append(p[kept])
            offsets = pa.array(np.concatenate([[0], *([np.cumsum(np.concatenate(sizes))] if sizes else [])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v) if v else np.zeros(0), t)) for v, t in ((at, pa.int32()), (shares, pa.float64()))]
            cap = np.where(labels >= 0, caps[np.maximum(labels, 0)], soft_cap)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "source", "tokens")), pa.array(cap, pa.float64()), *lists], names=["doc_id", "source", "tokens", "cap", "at", "p"])

    return member


def _rates(batch: pa.RecordBatch, price: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rates, document of each membership, its source, its share)."""
    at = batch.column("at")
    n = pc.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.repeat(np.arange(len(n)), n)
    source, share = at.flatten().to_numpy(zero_copy_only=False), batch.column("p").flatten().to_numpy(zero_copy_only=False)
    rate = np.clip(np.bincount(own, share * price[source], len(n)), 0.0, batch.column("cap").to_numpy(zero_copy_only=False))
    return rate, own, source, share


def solve_prices(members: DataFrame, wanted: np.ndarray, most: np.ndarray, rounds: int = 60, tolerance: float = 1e-3) -> np.ndarray:
    """The price of each source for which the expected tokens of all documents meet ``wanted``.

    Each round is one aggregate over the documents: the tokens that the rates
    of these prices give each source, and those of documents whose rate may still
    move. The gradient of the squares is divided by the latter, which bounds its
    curvature; so no step goes too far, and few rounds are needed. Prices stay
    within 0 and ``most``: a source whose own documents are all at their bound
    isn't sought in others. It ends when no source is off by more than
    ``tolerance`` of its target, or can get nearer.
    """
    width = len(wanted)
    price = np.zeros(width)
    for _ in range(rounds):
        now = price.copy()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given, free = np.zeros(width), np.zeros(width)
            for batch in batches:
                rate, own, source, share = _rates(batch, now)
                tokens = batch.column("tokens").to_numpy().astype(float)
                given += np.bincount(source, (rate * tokens)[own] * share, width)
                moves = tokens * (rate < batch.column("cap").to_numpy(zero_copy_only=False))
                free += np.bincount(source, moves[own] * share, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(given), pa.array(free)], names=["s", "given", "free"])

        given, free = np.zeros(width), np.zeros(width)
        for r in members.mapInArrow(add, "s int, given double, free double").groupBy("s").agg(F.sum("given").alias("given"), F.sum("free").alias("free")).collect():
            given[r.s], free[r.s] = r.given, r.free
        missing = wanted - given
        step = np.clip(price + np.divide(missing, free, out=np.zeros(width), where=free > 0), 0.0, most) - price
        if (np.abs(missing) <= tolerance * np.maximum(wanted, 1.0)).all() or np.abs(step).max(initial=0.0) < 1e-6:
            break
        price = price + step
    return price


class Diffusion:
    """Whole copies from rates; what rounding leaves of a source's tokens passes to its next document."""

    def __init__(self, seed: int) -> None:
        self.seed = seed
        self.rest: dict = {}

    def copies(self, source, rate: float, tokens: int, cap: int) -> int:
        low = int(np.floor(rate + 1e-9))
        if tokens == 0 or rate - low < 1e-9:
            return min(low, cap)
        if source not in self.rest:
            start = zlib.crc32(f"{self.seed}/{source}".encode()) / 2**32 - 0.5
            self.rest[source] = start * tokens
        owed = self.rest[source] + (rate - low) * tokens
        extra = int(owed >= tokens / 2 and low < cap)
        self.rest[source] = owed - extra * tokens
        return low + extra


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, soft_cap: int = 1, vocabulary: str = VOCABULARY, keep_shares: bool = True) -> DataFrame:
    """``doc_id, source, tokens, copies, at, p`` of each document that is used.

    ``documents`` has ``doc_id, text, source``; ``targets`` has ``source,
    target_share, max_repeats``. Shares of sources that don't exist are spread
    over the others. ``total_tokens`` is the size aimed at, by default the
    largest at which every existing source can keep its share; without
    ``keep_shares`` all tokens of known sources, if that is more, and a source
    that its cap keeps from its share falls short. Every document belongs to the
    sources numbered ``at`` (from 0, in the order of their names) by shares ``p``;
    one of a null or blank source is used at most ``soft_cap`` times; a source
    without a target is not used. A ``doc_id`` counts once: of rows that repeat
    it with different texts or sources the one of the least source, then digest,
    is taken; rows of null id are told apart by their text. Documents without
    tokens are not used, and without targets nothing is.
    """
    listed = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").limit(MODEL_SIZE // LEAST_BUCKETS + 1).collect()
    if len(listed) > MODEL_SIZE // LEAST_BUCKETS:
        raise ValueError(f"more than {MODEL_SIZE // LEAST_BUCKETS} sources have targets")
    names = [r.source for r in listed]
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    if not names:
        return spark.createDataFrame([], f"doc_id {kind}, source string, tokens bigint, copies int, at array<int>, p array<double>")
    schema = f"doc_id {kind}, digest binary, source string, tokens bigint, bucket array<int>, count array<int>"
    once = documents.select("doc_id", "text", "source", text_digest().alias("digest")).groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("digest")).alias("_d")).agg(
        F.min_by(F.struct("text", "source", "digest"), F.struct(F.coalesce("source", F.lit("")), "digest")).alias("r")
    ).select("doc_id", "r.*")
    features = checkpointed(once.mapInArrow(_feature_batches(names, vocabulary), schema))
    has_target = F.broadcast(spark.createDataFrame([(n, True) for n in names], "source string, _target boolean"))
    rows = features.where("tokens > 0").join(has_target, "source", "left").where("source is null or _target").drop("_target")
    sums = {r.source: float(r.t) for r in rows.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    known = np.array([sums.get(n, 0.0) for n in names])
    caps = np.array([float(r.cap) for r in listed])
    share = np.array([float(r.share) for r in listed]) * (known > 0)
    share = share / share.sum() if share.sum() else share
    able = [c * t / s for c, t, s in zip(caps, known, share) if s > 0]
    largest = min(able, default=0.0)
    total = float(total_tokens or (largest if keep_shares else max(largest, known.sum())))
    model = spark.sparkContext.broadcast(fit_classifier(features, names))
    members = checkpointed(
        rows.select("doc_id", "source", "tokens", "bucket", "count").mapInArrow(_membership(model, fit_power(features, model, names), names, caps, float(soft_cap)), f"doc_id {kind}, source string, tokens bigint, cap double, at array<int>, p array<double>")
    )
    price = solve_prices(members, share * total, 1.1 * np.maximum(caps, soft_cap))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        diffusion = Diffusion(TaskContext.get().partitionId())
        for batch in batches:
            rate, *_ = _rates(batch, price)
            got = [diffusion.copies(s, r, t, int(c)) for s, r, t, c in zip(batch.column("source").to_pylist(), rate.tolist(), batch.column("tokens").to_pylist(), batch.column("cap").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "source", "tokens")), pa.array(got, pa.int32()), batch.column("at"), batch.column("p")], names=["doc_id", "source", "tokens", "copies", "at", "p"])

    return members.mapInArrow(copy, f"doc_id {kind}, source string, tokens bigint, copies int, at array<int>, p array<double>").where("copies > 0")


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, share, expected_share, documents, tokens, most_copies, size``, one row a target source and one for unknown ones.

    ``size`` is the tokens of the whole mixture, the same in each row.
    ``share`` counts documents by their recorded source; ``expected_share`` deals
    every document out by its membership.
    """
    used = mixture.withColumn("used", F.col("tokens") * F.col("copies"))
    names = targets.where("source is not null").select("source").distinct()
    listed = names.select(F.col("source").alias("name"), (F.row_number().over(Window.orderBy("source")) - 1).alias("k"))
    by_source = used.groupBy("source").agg(F.count("*").alias("documents"), F.sum("used").alias("tokens"), F.max("copies").alias("most_copies"))
    dealt = used.select("used", F.inline(F.arrays_zip(F.col("at").alias("k"), F.col("p").alias("w")))).groupBy("k").agg(F.sum(F.col("used") * F.col("w")).alias("dealt")).join(listed, "k").drop("k")
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    total = by_source.agg(F.sum("tokens").alias("all"))
    rows = wanted.unionByName(
        targets.sparkSession.range(1).select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("target_share"))
    )
    joined = rows.alias("w").join(by_source.alias("b"), F.expr("w.source <=> b.source"), "left").select("w.source", "target_share", "documents", "tokens", "most_copies")
    return (
        joined.join(dealt, F.col("source") == F.col("name"), "left").join(F.broadcast(total))
        .select(
            "source", "target_share",
            F.round(F.coalesce("tokens", F.lit(0)) / F.col("all"), 6).alias("share"),
            F.round(F.when(F.col("source").isNotNull(), F.coalesce("dealt", F.lit(0.0))) / F.col("all"), 6).alias("expected_share"),
            F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("all", F.lit(0)).alias("size"),
        )
    )
