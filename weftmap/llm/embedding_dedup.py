"""Embedding near-duplicates by collision-counting projections.

Vectors are projected on many lines; on each line a vector looks for others in a window centred at its own
value, and pairs that meet on enough lines are verified by their cosine. The lines come in families: a family's lines
are the normalised sums of one signed axis from each of two (or three) random rotations, (2d)^2 or (2d)^3 of them. A vector takes
part only in the lines of each family where it projects farthest out. There the sorted line is sparsely populated,
while near vectors are far out on the same lines, so windows hold few strangers. The number of families and the count a pair must
reach are calibrated on simulated pairs at the cosine limit.

What is shuffled for the lines is a number, a projection and a few codes, never the vector. A line's entries are sorted by
projection, and a window centred at each sweeps over them. Its collisions are handed to the pair's lower vector as lists, where collisions of
all families are counted. A pair that has met in both families before is not told again, so near copies, which meet in all, are told twice or so.
Pairs that pass the count are verified where they first met: only there, and only for vectors that such pairs need, are vectors sent.
Equal vectors are one class with a multiplicity. Links are added to counts and stars on the spot: no row per pair is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pairs import meet, pairs, star, whole_groups, windows
from ._rows import join_hot
from ._store import materialize, release
from .components import connected_components

COSINE = 0.9
#: Lines of a family in which a vector takes part.
LINES = 2
#: Families in which a pair must meet.
COUNT = 2
#: Share of pairs at the limit that may be missed, by calibration.
MISS = 1e-4
#: More are an error: pairs would be missed. Their numbers must fit into FAMILY_BITS.
MAX_FAMILIES, FAMILY_BITS = 1000, 10
#: Shorter vectors are filled up with zeros, which changes no cosine.
LEAST_DIM = 4
#: Windows reach this many standard deviations of the difference of a pair at the limit.
WINDOW_SIGMAS = 4.0
#: Projections are kept as integers of this step; GUARD keeps the windows of neighbouring line numbers apart.
STEP, GUARD, VALUE_BITS = 1 / 512, 512, 11
#: Vectors that a line holds on average, about, before rotations are added.
LINE_FILL = 16
#: Earlier families whose codes an entry carries.
EARLIER = 2
#: Vectors behind a part of a vector's partners: more are counted part by part.
PART_VECTORS = 1 << 22
#: Collisions counted in one go, about.
AT_ONCE = 2_000_000


@lru_cache(maxsize=8)
def _rotations(dim: int, families: int, arity: int) -> np.ndarray:
    """Seeded random rotations: [family, factor, dim, dim]."""
    rng = np.random.default_rng(20_000 + dim)
    return np.stack([np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(arity)]) for _ in range(families)])


def _taken(x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The LINES lines of one family on which unit vectors project farthest out: numbers and projections."""
    dim, few = x.shape[1], LEAST_DIM
    line = np.zeros((len(x), 1), dtype=np.int64)
    value = np.zeros((len(x), 1))
    for r in rotation:
        p = x @ r
        top = np.argpartition(-np.abs(p), few - 1, axis=1)[:, :few]
        far = np.take_along_axis(p, top, 1)
        line = (line[:, :, None] * (2 * dim) + (2 * top + (far > 0))[:, None, :]).reshape(len(x), -1)
        value = (value[:, :, None] + np.abs(far)[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-value, axis=1, kind="stable")[:, : max(few, LINES)]
        line, value = np.take_along_axis(line, best, 1), np.take_along_axis(value, best, 1)
    return line[:, :LINES], value[:, :LINES] / len(rotation) ** 0.5


def _coded(line: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Line number and projection in one integer, so that a window is a range of integers."""
    return (line << VALUE_BITS) + GUARD + np.minimum((value / STEP).astype(np.int64), (1 << VALUE_BITS) - 2 * GUARD - 1)


def window_of(dim: int, cosine: float) -> int:
    """Half the window's width in steps."""
    return min(GUARD - 1, int(np.ceil(WINDOW_SIGMAS * (2 - 2 * cosine) ** 0.5 / dim**0.5 / STEP)))


@lru_cache(maxsize=8)
def calibrate(dim: int, cosine: float, arity: int, simulated: int = 2000) -> int:
    """Families needed so that pairs at the limit meet in COUNT of them, but for a share of MISS."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(simulated, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(simulated, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = cosine * x + (1 - cosine**2) ** 0.5 * z
    w, met = window_of(dim, cosine), []
    for rotation in _rotations(dim, 8, arity):
        a, b = _coded(*_taken(x, rotation)), _coded(*_taken(y, rotation))
        met.append((np.abs(a[:, :, None] - b[:, None, :]) <= w).any((1, 2)).mean())
    p = float(np.mean(met)) - 2 * (0.25 / (8 * simulated)) ** 0.5  # a cautious estimate
    for n in range(COUNT, MAX_FAMILIES + 1):
        if p > 0 and sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(COUNT)) <= MISS:
            return n
    raise ValueError(f"vectors of {dim} components would need over {MAX_FAMILIES} families of lines to miss at most {MISS} of pairs at the limit")


def _keys(dim: int, family: int, line: np.ndarray) -> np.ndarray:
    """One integer for length, family and line: with 13, 10 and 40 bits, or 17, 10 and 36 for long vectors, as negative numbers."""
    if dim < 1 << 13:
        return (((dim << FAMILY_BITS) + family) << 40) + line
    if dim >= 1 << 17:
        raise ValueError(f"vectors of {dim} components are too long")
    return -1 - ((((dim << FAMILY_BITS) + family) << 36) + line)


def _key_parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Family and line of keys."""
    short = key >= 0
    plain, bits = np.where(short, key, -1 - key), np.where(short, 40, 36)
    return (plain >> bits) & ((1 << FAMILY_BITS) - 1), plain & ((np.int64(1) << bits) - 1)


def _arity(n: int, dim: int) -> int:
    for arity in (1, 2):
        if n * LINES <= LINE_FILL * (2 * dim) ** arity:
            return max(2, arity)
    return 3 if (2 * dim) ** 3 < 1 << 40 else 2


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in a list column, in the column's own precision."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)
    start = column.offsets.to_numpy()[:-1]
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, flat[start[rows][:, None] + np.arange(dim)]


def _on_lines(n: int, cosine: float):
    """A mapInArrow function: (node, e) to an entry for each line a vector takes part in, with its codes of this family and EARLIER ones before."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                node = batch.column("node").to_numpy()
                for rows, raw in _vectors(pa.concat_arrays([batch.column("e")])):
                    dim, space = raw.shape[1], max(raw.shape[1], LEAST_DIM)
                    arity = _arity(n, space)
                    x = np.pad(raw.astype(np.float64), ((0, 0), (0, space - dim)))
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    known: list[np.ndarray] = []
                    for family, r in enumerate(_rotations(space, calibrate(space, cosine, arity), arity)):
                        known = [*known, _coded(*_taken(x, r))][-1 - EARLIER :]
                        carried = np.ascontiguousarray(np.concatenate(known, axis=1).astype("<i8" if _is_wide(space, arity) else "<u4"))
                        packed = pa.array([c.tobytes() for c in carried], pa.binary())
                        for line in known[-1].T:
                            yield pa.RecordBatch.from_arrays([pa.array(_keys(dim, family, line >> VALUE_BITS)), pa.array(line & ((1 << VALUE_BITS) - 1)), pa.array(node[rows]), pa.array(np.full(len(rows), space, dtype=np.int32)), packed], names=["key", "value", "node", "dim", "codes"])

    return emit


def _is_wide(space: int, arity: int) -> bool:
    """Whether codes need over 32 bits."""
    return arity * (2 * space - 1).bit_length() + VALUE_BITS > 32


def _met(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Which of the codes of two vectors in one family lie in each other's windows: [pair, line of a, line of b]."""
    return np.abs(a[:, :, None] - b[:, None, :]) <= width


def _collisions(n: int, cosine: float, parts: int):
    """A mapInArrow function: sorted lines to lists (u, part, at, family, partners): the higher nodes that node u meets there. ``at`` names the place, a block of a line."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, count in whole_groups(batches, "key"):
            dims = table.column("dim").to_numpy()
            value, node, key = (table.column(c).to_numpy() for c in ("value", "node", "key"))
            place = _place_names(key, table.column("_lo").to_numpy(), table.column("_hi").to_numpy())
            codes = table.column("codes").combine_chunks() if len(table) else table.column("codes")
            for dim in np.unique(dims):
                own = dims == dim
                width = window_of(int(dim), cosine)
                lo, size = windows(first, np.where(own, count, 0), value, width)
                if size.any():
                    yield from _told(codes, lo, size, node, key, place, int(dim), width)

    def _told(codes, lo, size, node, key, place, dim, width) -> Iterator[pa.RecordBatch]:
        wide, found = np.dtype("<i8" if _is_wide(dim, _arity(n, dim)) else "<u4"), []
        data, edge = _flat(codes, wide)
        family, line = _key_parts(key)
        held = 0
        for a, b in pairs(lo, size):
            f = family[a]
            keep = np.ones(len(a), dtype=bool)
            for depth in np.unique(np.minimum(f, EARLIER)).tolist():
                at = np.flatnonzero(np.minimum(f, EARLIER) == depth)
                x, y = (data[edge[side[at]][:, None] + np.arange((depth + 1) * LINES)].astype(np.int64).reshape(len(at), depth + 1, LINES) for side in (a, b))
                now = _met(x[:, depth], y[:, depth], width)
                lowest = np.where(now, (x[:, depth] >> VALUE_BITS)[:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
                keep[at] = lowest == line[a[at]]  # once a family
                if depth == EARLIER:
                    before = np.all([_met(x[:, k], y[:, k], width).any(axis=(1, 2)) for k in range(EARLIER)], axis=0)
                    keep[at[before]] = False
            a, b = a[keep], b[keep]
            found.append((np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), place[a], family[a]))
            held += len(a)
            if held > AT_ONCE:
                yield _listed(found, parts)
                found, held = [], 0
        if held:
            yield _listed(found, parts)

    return sweep


def _place_names(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A number for each block of each line."""
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + hi.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)


def _flat(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a binary column without nulls as one array, and the edges between them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return np.ascontiguousarray(raw).view(dtype), (offsets - offsets[0]) // dtype.itemsize


def _binary(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """A binary column whose entries are the stretches of ``values`` between the edges."""
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _listed(found: list[tuple], parts: int) -> pa.RecordBatch:
    u, v, place, family = (np.concatenate(x) for x in zip(*found))
    part = ((v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
    by = np.lexsort((v, place, part, u))
    u, v, place, family, part = u[by], v[by], place[by], family[by], part[by]
    new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (place[1:] != place[:-1]) | (part[1:] != part[:-1])]))
    columns = [pa.array(u[new]), pa.array(part[new]), pa.array(place[new]), pa.array(family[new].astype(np.int64)), _binary(v.astype("<i8"), np.append(new, len(v)))]
    return pa.RecordBatch.from_arrays(columns, names=["u", "part", "at", "family", "partners"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collisions sorted by (u, part) to what is verified: lists (at, u, partners) of pairs that met in COUNT families, at the place of their
    first meeting, and the nodes that a place needs (at, u, null)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        u, at, family = (batch.column(c).to_numpy() for c in ("u", "at", "family"))
        v, edge = _flat(batch.column("partners"), np.dtype("<i8"))
        lo = 0
        while lo < len(u):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + AT_ONCE, "right")) - 1)
            n = np.diff(edge[lo : hi + 1])
            held.append((np.repeat(u[lo:hi], n), v[edge[lo] : edge[hi]], np.repeat(family[lo:hi], n), np.repeat(at[lo:hi], n)))
            size += int(n.sum())
            lo = hi
            if size > AT_ONCE:  # all but the last node, which may go on
                whole = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
                if cut and (np.diff(whole[0]) >= 0).all():
                    yield from _passed(*(x[:cut] for x in whole))
                    whole = [x[cut:] for x in whole]
                held, size = [tuple(whole)], len(whole[0])
    if held:
        yield from _passed(*(np.concatenate(x) for x in zip(*held)))


def _passed(u: np.ndarray, v: np.ndarray, family: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    by = np.lexsort((at, family, v, u))
    u, v, family, at = u[by], v[by], family[by], at[by]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
    start = np.flatnonzero(new)
    again = np.concatenate([[False], ~new[1:] & (family[1:] == family[:-1])])
    met = np.add.reduceat((~again).astype(np.int64), start)
    start = start[met >= COUNT]
    if not len(start):
        return
    u, v, at = u[start], v[start], at[start]
    by = np.lexsort((v, u, at))
    u, v, at = u[by], v[by], at[by]
    new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (at[1:] != at[:-1])]))
    yield pa.RecordBatch.from_arrays([pa.array(at[new]), pa.array(u[new]), _binary(v.astype("<i8"), np.append(new, len(v)))], names=["at", "u", "partners"])
    need = np.unique(np.stack([np.concatenate([at, at]), np.concatenate([u, v])], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(need[:, 0]), pa.array(need[:, 1]), pa.nulls(len(need), pa.binary())], names=["at", "u", "partners"])


def _verified(cosine: float):
    """A mapInArrow function: places with their vectors first and then their lists, to links of nodes as partial counts (node, null, n) and stars (u, v, 0)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, mults, vectors, lists = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if lists:
                yield from _links(np.array(nodes), np.array(mults), vectors, lists, cosine)

        for batch in batches:
            for at, u, mult, e, partners in zip(*(batch.column(c).to_pylist() if c != "e" else _rows_of(batch.column("e")) for c in ("at", "u", "mult", "e", "partners"))):
                if at != now:
                    yield from done()
                    now, nodes, mults, vectors, lists = at, [], [], [], []
                if partners is None:
                    nodes.append(u)
                    mults.append(mult)
                    vectors.append(e)
                else:
                    lists.append((u, np.frombuffer(partners, dtype="<i8")))
        yield from done()

    return check


def _rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each list as an array, null as None."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] if ok else None for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist())]


def _links(nodes: np.ndarray, mults: np.ndarray, vectors: list, lists: list[tuple[int, np.ndarray]], cosine: float) -> Iterator[pa.RecordBatch]:
    order = np.argsort(nodes)
    nodes, mults = nodes[order], mults[order]
    length = np.array([len(vectors[i]) for i in order])
    matrix = np.zeros((len(nodes), length.max()), dtype=vectors[0].dtype)
    for row, i in enumerate(order):
        matrix[row, : length[row]] = vectors[i]
    us, vs = [], []
    for lo in range(0, len(lists), 1000):
        some = lists[lo : lo + 1000]
        a = np.searchsorted(nodes, np.repeat([u for u, _ in some], [len(v) for _, v in some]))
        b = np.searchsorted(nodes, np.concatenate([v for _, v in some]))
        near = (_cosines(matrix, a, b) >= cosine) & (length[a] == length[b])
        us.append(a[near])
        vs.append(b[near])
    a, b = np.concatenate(us), np.concatenate(vs)
    if len(a):
        n_links = np.bincount(a, weights=mults[b], minlength=len(nodes)) + np.bincount(b, weights=mults[a], minlength=len(nodes))
        some = np.flatnonzero(n_links)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.nulls(len(some), pa.int64()), pa.array(n_links[some].astype(np.int64))], names=["u", "v", "n"])
        u, v = star(nodes[a], nodes[b])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.zeros(len(u), dtype=np.int64))], names=["u", "v", "n"])


def _cosines(vec: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, in double precision; rows are scaled by powers of two, so that no product overflows."""
    vec = vec.astype(np.float64)
    vec = np.ldexp(vec, -np.frexp(np.abs(vec).max(axis=1, keepdims=True))[1])
    norm = np.sqrt(np.einsum("ij,ij->i", vec, vec))
    out = np.empty(len(a))
    for lo in range(0, len(a), 100_000):
        x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
        out[lo : lo + 100_000] = np.einsum("ij,ij->i", vec[x], vec[y]) / (norm[x] * norm[y])
    return out


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and vectors of
    different lengths do not link. Rows with a null id link with nothing and have a null component_id. Rows that share an
    id but not the vector are vectors of their own. Other columns are ignored; an empty table gives no row.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("d"), F.col(vector_col).alias("e"))
    good = F.coalesce(
        F.col("d").isNotNull() & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("e", lambda x: x != 0), F.lit(False)
    )
    rows = rows.withColumn("good", good)
    classes = rows.where("good").groupBy("e").agg(F.min("d").alias("low"), F.count("*").alias("mult"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    lines = materialize(classes.select("node", "e").mapInArrow(_on_lines(n, cosine), "key long, value long, node long, dim int, codes binary"), "lines")
    told = meet(lines, "key", "node", "value").mapInArrow(_collisions(n, cosine, 1 + n // PART_VECTORS), "u long, part int, at long, family long, partners binary")
    passed = materialize(told.repartition("u", "part").sortWithinPartitions("u", "part").mapInArrow(_counted, "at long, u long, partners binary"), "passed")
    release(lines)
    needed = passed.where(F.col("partners").isNull()).select("at", "u").distinct()
    sent = needed.join(classes.select(F.col("node").alias("u"), "mult", "e"), "u").select("at", "u", "mult", "e", F.lit(None).cast("binary").alias("partners"))
    lists = passed.where(F.col("partners").isNotNull()).select("at", "u", F.lit(None).cast("long").alias("mult"), F.lit(None).cast(rows.schema["e"].dataType).alias("e"), "partners")
    met = sent.unionByName(lists).repartition("at").sortWithinPartitions("at", F.col("partners").isNotNull())
    found = materialize(met.mapInArrow(_verified(cosine), "u long, v long, n long"), "found")
    counts = found.where(F.col("v").isNull()).groupBy("u").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where(F.col("v").isNotNull()).select("u", "v"))
    named = classes.join(parts, classes.node == parts.node, "left").select(classes.node, "e", "low", "mult", F.coalesce(parts.component, classes.node).alias("label"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("_n"))
    done = join_hot(named, lowest, "label", "_n").join(counts, F.col("node") == counts.u, "left").select("e", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id", F.col("mult").alias("_n"))
    linked = join_hot(rows.where("good"), materialize(done, "done"), "e", "_n").select("d", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("d", F.lit(0).cast("long").alias("n_links"), F.col("d").alias("component_id"))
    return linked.union(alone).select(F.col("d").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("d") == F.col("component_id"), F.lit(False)).alias("kept"))
