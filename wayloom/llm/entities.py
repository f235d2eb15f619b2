"""Matching street sections of two sources that share no key.

Both sides are dealt out over the leaves of a quadtree, with replication at the
leaves' edges; a leaf with too many rows is split further where it is worked on.
In each leaf

1. records, their attributes and the attributes' tokens (cells of the plane,
   pieces of names, classes, lengths) form a graph, and random walks over it
   train skip-gram vectors of the tokens;
2. a record's vector is the weighted mean of its tokens' vectors, less the mean
   of all records; signs against random hyperplanes hash it into several tables,
   and records that share a bucket in any table are candidates, however full;
3. candidates are reranked exactly: how far the shorter runs along the longer,
   how far apart, and how alike the names are.

Over all leaves, a mixture of two classes (the same street or not) is fitted to
the counts of what was seen: the cosine of the vectors without names, the
distance, the overlap and the names. Its posterior is the confidence: the cosine
calibrated, with what the exact measures add, by weights that the data give.

A pair counts in the leaf that owns its reference point, so each comes out once.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.operators.proximity import PackedRTree, QuadTree, Shapes, _lists, _ramp, assigner, learn_quadtree
from wayloom.session import checkpointed

# Words of street names that say the kind of street or the direction.
KINDS = frozenset(
    "street st road rd avenue ave av boulevard blvd lane ln drive dr court ct place pl terrace ter parkway pkwy alley aly walk mews way frontage circle cir "
    "square sq close highway hwy trail trl north south east west n s e w northeast northwest southeast southwest ne nw se sw".split()
)
_ROUTE = re.compile(r"^(?:route|rt|highway|hwy|county road|cr|sr)\s*\d+$")


@dataclass(frozen=True)
class Settings:
    """How records are embedded, blocked and accepted."""

    reach: float = 20.0  # farthest that two drawings of one street lie apart, in map units
    cell: float = 64.0  # side of the cells that places are told by; each is used on two shifted grids
    dimensions: int = 32
    walks: int = 12
    steps: int = 5
    window: int = 2
    negatives: int = 1
    rate: float = 0.25
    tables: int = 32
    bits: int = 12
    overlap: float = 0.5  # of the shorter section
    same_name: float = 0.75  # likeness of names that counts as agreeing
    name_trust: float = 0.99  # share of pairs with agreeing names that are one street, and of others that aren't
    least_confidence: float = 0.5
    leaf_rows: int = 800
    seed: int = 11
    trained: bool = True  # without, token vectors keep their random start: what training is held against


DEFAULT = Settings()


def name_core(name: str | None) -> str:
    """A street name without kind, direction, case and punctuation; empty where it names nothing (null, a route number)."""
    text = " ".join(re.sub(r"[^a-z0-9 ]", " ", (name or "").lower()).split())
    if _ROUTE.match(text):
        return ""
    words = [w for w in text.split() if w not in KINDS]
    return "".join(words) or text.replace(" ", "")


# --- the graph and its vectors --------------------------------------------


def tokens_of(shapes: Shapes, cores: list[str], classes: list[str | None], lengths: np.ndarray, side: int, s: Settings) -> list[tuple[int, str | tuple, float]]:
    """(record, token, weight) edges of the graph; weights of a record's attributes add up to one an attribute."""
    seg = shapes.segment
    own = np.repeat(np.arange(len(shapes.size)), shapes.size)
    long = np.hypot(seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1])
    n = np.maximum(1, np.ceil(long / (s.cell / 3)).astype(np.int64)) + 1
    t = _ramp(n) / np.repeat(n - 1, n)
    x = np.repeat(seg[:, 0], n) + t * np.repeat(seg[:, 2] - seg[:, 0], n)
    y = np.repeat(seg[:, 1], n) + t * np.repeat(seg[:, 3] - seg[:, 1], n)
    rec = np.repeat(own, n)
    out: list[tuple[int, str | tuple, float]] = []
    for shift in (0.0, 0.5):
        cells = np.column_stack([rec, np.floor(x / s.cell + shift), np.floor(y / s.cell + shift)]).astype(np.int64)
        cells, counts = np.unique(cells, axis=0, return_counts=True)
        share = counts / np.bincount(cells[:, 0], counts, minlength=len(shapes.size))[cells[:, 0]]
        out += [(r, (shift, cx, cy), w) for (r, cx, cy), w in zip(cells.tolist(), share.tolist())]
    for r, core in enumerate(cores):
        if core:
            grams = {core[i : i + 3] for i in range(max(1, len(core) - 2))}
            out += [(r, "n:" + g, 0.5 / len(grams)) for g in grams]
        if classes[r]:
            out.append((r, f"c{side}:{classes[r]}", 0.1))
        if lengths[r] > 0:
            out.append((r, f"l:{int(np.log(lengths[r]) * 4)}", 0.1))
    return out


def token_vectors(record: np.ndarray, token: np.ndarray, weight: np.ndarray, n_records: int, n_tokens: int, s: Settings, seed: int) -> np.ndarray:
    """Skip-gram vectors with negative sampling, trained on walks record - token - record - ..."""
    rng = np.random.default_rng(seed)
    d = s.dimensions
    vectors = rng.standard_normal((n_tokens, d), dtype=np.float32) / np.float32(np.sqrt(d))
    context = np.zeros((n_tokens, d), dtype=np.float32)
    if not s.trained:
        return vectors

    def chooser(key: np.ndarray, value: np.ndarray, count: int):
        order = np.argsort(key, kind="stable")
        k, v = key[order], value[order]
        running = np.concatenate([[0.0], np.cumsum(weight[order])])
        start = np.searchsorted(k, np.arange(count))
        end = np.searchsorted(k, np.arange(count), side="right")

        def choose(at: np.ndarray) -> np.ndarray:
            low, high = running[start[at]], running[end[at]]
            hit = np.searchsorted(running, low + rng.random(len(at)) * (high - low), side="right") - 1
            return v[np.clip(hit, start[at], end[at] - 1)]

        return choose

    of_record, of_token = chooser(record, token, n_records), chooser(token, record, n_tokens)
    at = np.repeat(np.unique(record), s.walks)
    walk = [of_record(at)]
    for _ in range(s.steps - 1):
        at = of_token(walk[-1])
        walk.append(of_record(at))
    left = np.concatenate([walk[i] for w in range(1, s.window + 1) for i in range(s.steps - w)])
    right = np.concatenate([walk[i + w] for w in range(1, s.window + 1) for i in range(s.steps - w)])
    keep = left != right
    left, right = np.concatenate([left[keep], right[keep]]), np.concatenate([right[keep], left[keep]])
    order = rng.permutation(len(left))
    left, right = left[order], right[order]

    rate = np.float32(s.rate)

    def scatter(into: np.ndarray, at: np.ndarray, change: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0]))
        into[at[order][first]] -= rate * np.clip(np.add.reduceat(change[order], first), -4, 4)

    for lo in range(0, len(left), 4096):
        a = left[lo : lo + 4096]
        b = np.concatenate([right[lo : lo + 4096][:, None], rng.integers(0, n_tokens, (len(a), s.negatives))], axis=1)
        va, ub = vectors[a], context[b]
        pull = 1 / (1 + np.exp(-np.matmul(ub, va[:, :, None])[:, :, 0]))
        pull[:, 0] -= 1
        scatter(context, b.ravel(), (pull[:, :, None] * va[:, None, :]).reshape(-1, d))
        scatter(vectors, a, np.matmul(pull[:, None, :], ub)[:, 0, :])
    return vectors


def record_vectors(edges: list[tuple[int, object, float]], n_records: int, s: Settings, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the records, with and without the tokens of their names: the weighted mean of their tokens' vectors."""
    numbers: dict = {}
    token = np.array([numbers.setdefault(t, len(numbers)) for _, t, _ in edges], dtype=np.int64)
    record = np.array([r for r, _, _ in edges], dtype=np.int64)
    weight = np.array([w for _, _, w in edges])
    vectors = token_vectors(record, token, weight, n_records, len(numbers), s, seed)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    named = np.array([isinstance(t, str) and t.startswith("n:") for t in numbers])

    def mean(weight: np.ndarray) -> np.ndarray:
        order = np.argsort(record, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(record[order]) != 0]))
        out = np.zeros((n_records, s.dimensions))
        out[record[order][first]] = np.add.reduceat(vectors[token[order]] * weight[order][:, None], first)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        if n_records > s.dimensions:  # all vectors share a direction, which tells nothing apart
            out -= out.mean(axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return mean(weight), mean(np.where(named[token], 0.0, weight))


def candidates(a: np.ndarray, b: np.ndarray, s: Settings, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that share a bucket in any table."""
    rng = np.random.default_rng(seed)
    found = []
    power = 1 << np.arange(s.bits)
    for _ in range(s.tables):
        planes = rng.standard_normal((a.shape[1], s.bits))
        ha, hb = (a @ planes > 0) @ power, (b @ planes > 0) @ power
        order = np.argsort(hb, kind="stable")
        start, end = np.searchsorted(hb[order], ha), np.searchsorted(hb[order], ha, side="right")
        n = end - start
        found.append(np.repeat(np.arange(len(a)), n) * len(b) + order[np.repeat(start, n) + _ramp(n)])
    pair = np.unique(np.concatenate(found))
    return pair // len(b), pair % len(b)


# --- exact measures -------------------------------------------------------


def along(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray, samples: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(overlap, offset) of sections ``a[i]`` and ``b[j]``.

    Points spread evenly along the shorter are dropped onto the longer: the
    overlap is the stretch they span there, as a share of the shorter; the
    offset is the median distance of points that don't fall off its ends
    (infinite where all do).
    """
    both = Shapes(np.concatenate([a.segment, b.segment]), np.concatenate([a.start, b.start + len(a.segment)]), np.concatenate([a.size, b.size]))
    seg = both.segment
    long = np.hypot(seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1])
    total = np.add.reduceat(long, both.start)
    before = np.concatenate([[0.0], np.cumsum(long)[:-1]])
    before -= np.repeat(before[both.start], both.size)
    j = j + len(a.size)
    swap = total[i] > total[j]
    short, other = np.where(swap, j, i), np.where(swap, i, j)
    # the points along each shorter one
    share = np.linspace(0, 1, samples)
    wanted = total[short][:, None] * share
    n = both.size[short]
    s = np.repeat(both.start[short], n) + _ramp(n)
    first = np.cumsum(n) - n
    passed = before[s][:, None] <= np.repeat(wanted, n, axis=0)
    at = both.start[short][:, None] + np.maximum(np.add.reduceat(passed, first, axis=0) - 1, 0)
    t = np.clip((wanted - before[at]) / np.where(long[at] > 0, long[at], 1.0), 0, 1)
    px, py = seg[at, 0] + t * (seg[at, 2] - seg[at, 0]), seg[at, 1] + t * (seg[at, 3] - seg[at, 1])
    # dropped onto the longer one
    n = both.size[other]
    e = np.repeat(both.start[other], n) + _ramp(n)
    first = np.cumsum(n) - n
    qx, qy = np.repeat(px, n, axis=0), np.repeat(py, n, axis=0)
    ax, ay = seg[e, 0][:, None], seg[e, 1][:, None]
    dx, dy = (seg[e, 2] - seg[e, 0])[:, None], (seg[e, 3] - seg[e, 1])[:, None]
    size = dx * dx + dy * dy
    t = np.clip(((qx - ax) * dx + (qy - ay) * dy) / np.where(size > 0, size, 1.0), 0, 1)
    far = np.hypot(qx - ax - t * dx, qy - ay - t * dy)
    place = before[e][:, None] + t * long[e][:, None]
    nearest = np.minimum.reduceat(far, first, axis=0)
    place = np.maximum.reduceat(np.where(far <= np.repeat(nearest, n, axis=0), place, -1.0), first, axis=0)
    inner = (place > 1e-6) & (place < total[other][:, None] - 1e-6)
    # a point sitting exactly on an end lies beside it too
    inner |= nearest <= 1e-6
    offset = np.full(len(i), np.inf)
    some = inner.any(axis=1)
    offset[some] = np.nanmedian(np.where(inner[some], nearest[some], np.nan), axis=1)
    overlap = (place.max(axis=1) - place.min(axis=1)) / np.maximum(total[short], 1e-9)
    return overlap, offset


class NameLikeness:
    """Likeness of two name cores in 0..1, or None where either is empty."""

    def __init__(self, least: float) -> None:
        self.least = least
        self.known: dict[tuple[str, str], float] = {}

    def __call__(self, a: str, b: str) -> float | None:
        if not a or not b:
            return None
        if a == b:
            return 1.0
        got = self.known.get((a, b))
        if got is None:
            m = difflib.SequenceMatcher(None, a, b, autojunk=False)
            got = self.known[a, b] = m.ratio() if m.quick_ratio() >= self.least else 0.0
        return got


# --- a leaf ---------------------------------------------------------------

_OUT = "target_id {}, match_id {}, cosine double, place double, overlap double, offset double, likeness double"


def _side(table: pa.Table) -> tuple[pa.Table, Shapes]:
    seen = {k: n for n, k in reversed(list(enumerate(table.column("key").to_pylist())))}
    table = table.take(pa.array(sorted(seen.values()), pa.int64())).combine_chunks()
    xy = table.column("xy").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    sizes, _ = _lists(table.column("sizes").combine_chunks())
    return table, Shapes.of(xy, sizes.to_numpy(zero_copy_only=False).astype(np.int64))


def _blocks(a: Shapes, b: Shapes, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, Callable]]:
    """(rows of a, rows of b, which reference points are its own) of each part of a leaf: the whole leaf unless it holds too many rows."""
    if len(a.size) + len(b.size) <= 4 * s.leaf_rows:
        yield np.arange(len(a.size)), np.arange(len(b.size)), lambda x, y: np.ones(len(x), dtype=bool)
        return
    tree = QuadTree.build(np.concatenate([a.segment[a.start, :2], b.segment[b.start, :2]]), s.leaf_rows, 3 * s.reach)
    rows, parts = tree.cover(a.box + np.array([-s.reach, -s.reach, s.reach, s.reach]))
    cols, theirs = tree.cover(b.box)
    for part in np.intersect1d(parts, theirs).tolist():
        yield rows[parts == part], cols[theirs == part], lambda x, y, part=part: tree.locate(x, y) == part


def _taken(shapes: Shapes, rows: np.ndarray) -> Shapes:
    n = shapes.size[rows]
    return Shapes(shapes.segment[np.repeat(shapes.start[rows], n) + _ramp(n)], np.cumsum(n) - n, n)


def _leaf_matcher(tree_of, s: Settings, schema: pa.Schema, exhaustive: bool):
    grow = np.array([-s.reach, -s.reach, s.reach, s.reach])

    def pairs(lt: pa.Table, a: Shapes, rt: pa.Table, b: Shapes, mine, seed: int) -> Iterator[pa.Table]:
        cores = [[name_core(n) for n in t.column("name").to_pylist()] for t in (lt, rt)]
        va = vb = pa_ = pb = np.zeros((0, 0))
        if exhaustive:  # every pair whose boxes meet: what the blocking is held against
            i, j = PackedRTree(b.box).probe(a.box + grow)
        if not exhaustive or s.trained:
            edges, base = [], 0
            for side, (t, shapes) in enumerate(((lt, a), (rt, b))):
                lengths = np.nan_to_num(t.column("length").to_numpy().astype(float))
                made = tokens_of(shapes, cores[side], t.column("kind").to_pylist(), lengths, side, s)
                edges += [(r + base, token, w) for r, token, w in made]
                base += len(shapes.size)
            v, p = record_vectors(edges, base, s, seed)
            va, vb, pa_, pb = v[: len(a.size)], v[len(a.size) :], p[: len(a.size)], p[len(a.size) :]
            if not exhaustive:
                i, j = candidates(va, vb, s, seed)
        grown, box = a.box + grow, b.box
        near = np.flatnonzero((grown[i, 0] <= box[j, 2]) & (grown[i, 2] >= box[j, 0]) & (grown[i, 1] <= box[j, 3]) & (grown[i, 3] >= box[j, 1]))
        i, j = i[near], j[near]
        own = mine(np.maximum(grown[i, 0], box[j, 0]), np.maximum(grown[i, 1], box[j, 1]))
        i, j = i[own], j[own]
        like = NameLikeness(0.5)
        for k in range(0, len(i), 20_000):
            x, y = i[k : k + 20_000], j[k : k + 20_000]
            overlap, offset = along(a, b, x, y)
            beside = np.flatnonzero((overlap >= s.overlap) & (offset <= s.reach))
            x, y, overlap, offset = x[beside], y[beside], overlap[beside], offset[beside]
            names = [like(cores[0][m], cores[1][n]) for m, n in zip(x.tolist(), y.tolist())]
            cosine, place = ((np.einsum("ij,ij->i", u[x], w[y]) if len(u) else np.zeros(len(x))) for u, w in ((va, vb), (pa_, pb)))
            columns = [lt.column("key").combine_chunks().take(pa.array(x)), rt.column("key").combine_chunks().take(pa.array(y)), *(pa.array(c) for c in (cosine, place, overlap, offset)), pa.array(names, pa.float64())]
            yield pa.Table.from_arrays(columns, schema=schema)

    def match(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        leaf, salt, tree = key[0].as_py(), key[1].as_py(), tree_of()
        (lt, a), (rt, b) = _side(left), _side(right)
        out = [schema.empty_table()]
        for part, (rows, cols, inside) in enumerate(_blocks(a, b, s)):
            mine = lambda x, y: (tree.locate(x, y) == leaf) & inside(x, y)  # noqa: B023, E731
            out += pairs(lt.take(pa.array(rows)), _taken(a, rows), rt.take(pa.array(cols)), _taken(b, cols), mine, s.seed + 7919 * leaf + 31 * part + salt)
        return pa.concat_tables(out)

    return match


def measured_pairs(targets: DataFrame, matches: DataFrame, settings: Settings = DEFAULT, exhaustive: bool = False) -> DataFrame:
    """``target_id, match_id, cosine, place, overlap, offset, likeness`` of candidates that run alongside each other.

    Both sides have ``key, g`` (``array<struct<x,y>>``), ``name, kind, length``.
    Rows that repeat a key count once; null or empty geometries match nothing;
    null names, classes and lengths say nothing (``likeness`` is null where a name
    does); a section of one vertex has no length and matches nothing. ``place`` is
    the cosine without names. ``exhaustive`` measures every pair whose boxes meet
    instead of the blocked ones, to measure what blocking misses.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    # read by the count, the sample and the leaves; what precedes may be a join
    left, right = (checkpointed(df.select("key", "g", "name", "kind", F.col("length").cast("double").alias("length")).where("key is not null and g is not null")) for df in (targets, matches))
    tree_of = learn_quadtree([(left, F.get("g", F.lit(0))), (right, F.get("g", F.lit(0)))], left.count() + right.count(), settings.leaf_rows, 3 * settings.reach)
    kinds = [df.schema["key"].dataType.simpleString() for df in (left, right)]
    rows = "leaf int, salt int, key {}, xy array<double>, sizes array<int>, name string, kind string, length double"
    a = left.mapInArrow(assigner(tree_of, settings.reach, rings=False, first=True), rows.format(kinds[0]))
    b = right.mapInArrow(assigner(tree_of, 0.0, rings=False, first=False), rows.format(kinds[1]))
    out = _OUT.format(*kinds)
    schema = to_arrow_schema(_parse_datatype_string(out))
    return a.groupBy("leaf", "salt").cogroup(b.groupBy("leaf", "salt")).applyInArrow(_leaf_matcher(tree_of, settings, schema, exhaustive), out)


# --- confidence -----------------------------------------------------------

#: Bounds of the classes that measures are counted in (cosine without names; distance as a share of the reach; overlap; likeness of names, with one class more where a name says nothing).
PLACE, OFFSET, OVERLAP, LIKENESS = (0.0, 0.2, 0.4, 0.6, 0.75, 0.85, 0.92, 0.97), (0.025, 0.05, 0.1, 0.15, 0.25, 0.4, 0.55, 0.7, 0.85), (0.6, 0.75, 0.9, 0.98), (0.5, 0.65, 0.75, 0.85, 0.95)
FEATURES = ["place_class", "offset_class", "overlap_class", "name_class"]


def _classed(value: Column, bounds: Sequence[float]) -> Column:
    """How many bounds a value reaches."""
    return sum(((value >= b).cast("int") for b in bounds), F.lit(0))


def with_classes(pairs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return pairs.withColumns({
        "place_class": _classed(F.col("place"), PLACE), "offset_class": _classed(F.col("offset") / settings.reach, OFFSET), "overlap_class": _classed(F.col("overlap"), OVERLAP),
        "name_class": F.when(F.col("likeness").isNull(), -1).otherwise(_classed(F.col("likeness"), LIKENESS)),
    })


def isotonic(hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing rates nearest to hits / counts, by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []
    for h, n in zip(hits.tolist(), counts.tolist()):
        blocks.append([h, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * max(blocks[-1][1], 1e-9) >= blocks[-1][0] * max(blocks[-2][1], 1e-9):
            h2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([[h / n if n else 0.0] * k for h, n, k in blocks])


@dataclass
class Mixture:
    """Two classes of pairs; ``ratio[f][c]`` is how much likelier class c of feature f is for the same street, ``odds`` what it is beforehand."""

    odds: float
    ratio: list[np.ndarray]

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, settings: Settings = DEFAULT, rounds: int = 60) -> Mixture:
        """By expectation and maximisation over counted patterns (rows of FEATURES' classes).

        Pairs whose names both say something count as ``name_trust`` says; the others
        are worked out. A feature without a class (-1) says nothing. The ratios of the cosine and
        of the names may only rise, those of the distance only fall (isotonic
        regression); one pair of either kind is imagined in every class.
        """
        widths = [len(PLACE) + 1, len(OFFSET) + 1, len(OVERLAP) + 1, len(LIKENESS) + 1]
        agreeing = sum(b < settings.same_name + 1e-9 for b in LIKENESS)
        names = patterns[:, 3]
        told = np.where(names >= agreeing, settings.name_trust, 1 - settings.name_trust)
        same = np.where(names < 0, 0.5, told)
        model = cls(1.0, [np.ones(w) for w in widths])
        for _ in range(rounds):
            total = counts.sum() + 2.0
            share = ((same * counts).sum() + 1.0) / total
            ratio = []
            for f, width in enumerate(widths):
                known = patterns[:, f] >= 0
                at, n, p = patterns[known, f], counts[known], same[known]
                m, u = np.bincount(at, n * p, width) + 1.0, np.bincount(at, n * (1 - p), width) + 1.0
                if f != 2:
                    turn = slice(None, None, -1 if f == 1 else 1)
                    rates = np.clip(isotonic(m[turn], (m + u)[turn])[turn], 1e-9, 1 - 1e-9)
                    m, u = (m + u) * rates, (m + u) * (1 - rates)
                ratio.append((m / m.sum()) / (u / u.sum()))
            model = cls(share / (1 - share), ratio)
            after = np.where(names < 0, model.posterior(patterns), told)
            if np.abs(after - same).max(initial=0.0) < 1e-6:
                break
            same = after
        return model

    def posterior(self, patterns: np.ndarray, without: Sequence[int] = ()) -> np.ndarray:
        """The share of such pairs that are the same street; ``without`` leaves features out."""
        odds = np.full(len(patterns), self.odds)
        for f, ratio in enumerate(self.ratio):
            if f not in without:
                odds = odds * np.where(patterns[:, f] >= 0, ratio[np.maximum(patterns[:, f], 0)], 1.0)
        return odds / (1 + odds)


def counted_patterns(classed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Every pattern of classes with its pairs; the driver sees at most 9 x 10 x 5 x 7 rows."""
    rows = classed.groupBy(*FEATURES).agg(F.count("*").alias("n")).collect()
    return np.array([[r[f] for f in FEATURES] for r in rows], dtype=np.int64).reshape(-1, len(FEATURES)), np.array([r.n for r in rows], dtype=float)


def with_confidence(pairs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``pairs`` with ``confidence``: the posterior of the mixture that is fitted to all of them."""
    classed = checkpointed(with_classes(pairs, settings))
    patterns, counts = counted_patterns(classed)
    model = Mixture.fit(patterns, counts, settings)
    odds = F.lit(float(model.odds))
    for name, ratio in zip(FEATURES, model.ratio):
        odds = odds * F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in ratio]), F.col(name)), F.lit(1.0))
    return classed.withColumn("_o", odds).withColumn("confidence", F.col("_o") / (1 + F.col("_o"))).drop("_o", *FEATURES)


def calibration(pairs: DataFrame, settings: Settings = DEFAULT, parts: int = 10) -> DataFrame:
    """``part, pairs, confidence, agreeing``: how the confidence without the names compares with whether the names agree.

    The mixture is fitted to pairs of even targets and looked at on those of odd
    ones whose names both say something; their names are withheld from the
    confidence, so they are an attribute held out. ``agreeing`` is their share.
    """
    classed = checkpointed(with_classes(pairs, settings).withColumn("_odd", F.pmod(F.xxhash64("target_id"), F.lit(2)) == 1))
    model = Mixture.fit(*counted_patterns(classed.where("not _odd")), settings)
    held = classed.where("_odd and name_class >= 0")
    patterns, counts = counted_patterns(held)
    agreeing = sum(b < settings.same_name + 1e-9 for b in LIKENESS)
    confidence = model.posterior(patterns, without=[3])
    part = np.minimum((confidence * parts).astype(int), parts - 1)
    rows = []
    for k in np.unique(part).tolist():
        own = part == k
        n = counts[own].sum()
        rows.append((k, int(n), float((confidence[own] * counts[own]).sum() / n), float(counts[own & (patterns[:, 3] >= agreeing)].sum() / n)))
    return pairs.sparkSession.createDataFrame(rows, "part int, pairs bigint, confidence double, agreeing double")


def matched_sections(targets: DataFrame, matches: DataFrame, settings: Settings = DEFAULT, exhaustive: bool = False) -> DataFrame:
    """The measured pairs that are likelier the same stretch of the same street than not, with their ``confidence``."""
    return with_confidence(measured_pairs(targets, matches, settings, exhaustive), settings).where(F.col("confidence") >= settings.least_confidence)


def end_key(geometry: Column) -> Column:
    """A hash of a line's two ends, the same for both directions."""

    def text(p):
        return F.concat_ws(",", F.format_number(p["x"], 2), F.format_number(p["y"], 2))

    a, b = text(F.element_at(geometry, 1)), text(F.element_at(geometry, -1))
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def recorded_lengths(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``targets`` with ``length`` filled from the recorded length of the edge section they cover, where it is missing.

    Sections are recognised by their two ends; of several records of one section
    the greatest length counts, and zero lengths don't.
    """
    known = (
        edges.where("length > 0 and size(geometry) > 1").select(end_key(F.col("geometry")).alias("_ends"), F.col("length").alias("_recorded"))
        .groupBy("_ends").agg(F.max("_recorded").alias("_recorded"))
    )
    keyed = targets.withColumn("_ends", F.when(F.size("geometry") > 1, end_key(F.col("geometry"))))
    return keyed.join(known, "_ends", "left").withColumn("length", F.coalesce(F.when(F.col("length") > 0, F.col("length")), F.col("_recorded"))).drop("_ends", "_recorded")
