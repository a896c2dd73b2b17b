"""Operator 10: all pairs of near vectors by an epsilon grid order join."""

from __future__ import annotations

from functools import partial
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import scratch, write_out
from sitegauge.llm.components import connected_components, forest
from sitegauge.sources.tables import read_table

THRESHOLD = 0.95
#: Leading principal dimensions of the grid, and vectors on which the principal axes are fitted at most.
AXES, FIT_ROWS = 8, 5000
#: Bytes of a block of vectors, and of the stretch of blocks that a task compares with another stretch, at least and at most.
BLOCK_BYTES, STRETCH_BYTES = (64 << 10, 1 << 20), (256 << 10, 32 << 20)
#: Blocks and stretches that the vectors make where those bounds allow it; vectors in an interval that is not split further.
BLOCKS, STRETCHES, LEAF = 32, 8, 64
#: Intervals of a level that make one interval of the level above.
FAN = 8
#: Links that a task holds before it shrinks them to a forest.
HELD = 1_000_000


def usable(vector: str) -> Column:
    """Non-empty, without null or non-finite components, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Orthonormal leading axes (width x AXES), fitted on at most FIT_ROWS vectors. They only steer the order."""
    some = classes.orderBy(F.xxhash64("vector")).limit(FIT_ROWS).select("vector").toPandas()["vector"]
    rows = np.zeros((len(some), width))
    for i, v in enumerate(some):
        rows[i, : len(v)] = np.asarray(v, dtype=np.float64)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(np.atleast_2d(np.cov(rows.T)) if len(rows) > 1 else np.eye(width))
    return axes[:, ::-1][:, :AXES]


def units(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to ``width``."""
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    scale = np.abs(out).max(axis=1, keepdims=True)  # against overflow of squares
    out /= np.where(scale > 0, scale, 1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def boxed(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes, and the length of what the axes leave: two vectors are at least as far apart as these."""
    on = unit @ axes
    return np.column_stack([on, np.sqrt(np.maximum(0, 1 - (on * on).sum(axis=1)))])


def between(bounds: tuple[int, int], size: int) -> int:
    return min(bounds[1], max(bounds[0], size))


def order_blocks(classes: DataFrame, axes: np.ndarray, width: int, eps: float) -> DataFrame:
    """Classes sorted in epsilon grid order and packed: one row per block of vectors that follow one another.

    A block has its place, its stretch of blocks, its box (lo0.., hi0.., see ``boxed``), and its vectors as bytes.
    """
    k = axes.shape[1]
    cells = ", ".join(f"c{i} int" for i in range(k))

    def place(batches):
        for batch in batches:
            flat, sizes = list_parts(batch.column("vector"))
            cell = np.floor(units(flat, sizes, width) @ axes / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(cell[:, i]) for i in range(k)]], names=[*batch.schema.names, *[f"c{i}" for i in range(k)]]
            )

    many, item = classes.count(), (4 if element_type(classes) == "float" else 8) * width
    rows = max(LEAF, between(BLOCK_BYTES, many * item // BLOCKS) // item)
    stretch = max(1, between(STRETCH_BYTES, many * item // STRETCHES) // (rows * item))  # blocks
    names = [f"lo{i}" for i in range(k + 1)] + [f"hi{i}" for i in range(k + 1)]

    def pack(batches):
        part, at = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block(n):
            nonlocal at, held
            flat = np.concatenate([h[2] for h in held])
            sizes, ids, copies = (np.concatenate([h[i] for h in held]) for i in (3, 0, 1))
            take = int(sizes[:n].sum())
            box = boxed(units(flat[:take].astype(np.float64), sizes[:n], width), axes)
            row = [[part], [at], [ids[:n].tobytes()], [copies[:n].tobytes()], [sizes[:n].astype(np.int32).tobytes()], [flat[:take].tobytes()]]
            row += [[x] for x in (*box.min(0).tolist(), *box.max(0).tolist())]
            at += 1
            held = [(ids[n:], copies[n:], flat[take:], sizes[n:])] if n < len(ids) else []
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "at", "ids", "copies", "sizes", "flat", *names])

        for batch in batches:
            flat, sizes = list_parts(batch.column("vector"))
            held.append((batch.column("class").to_numpy(), batch.column("copies").to_numpy(), flat, sizes))
            while sum(len(h[0]) for h in held) >= rows:
                yield block(rows)
        if sum(len(h[0]) for h in held):
            yield block(sum(len(h[0]) for h in held))

    placed = classes.select("class", "copies", "vector").mapInArrow(place, f"class long, copies long, vector array<{element_type(classes)}>, {cells}")
    parts = max(1, ceil(many / rows))
    order = [f"c{i}" for i in range(k)] + ["class"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("class", "copies", "vector")
    boxes = ", ".join(f"{n} double" for n in names)
    packed = write_out(ordered.mapInArrow(pack, f"part long, at long, ids binary, copies binary, sizes binary, flat binary, {boxes}"))
    most = packed.agg(F.max("at")).first()[0] or 0
    span = FAN
    while span <= most:
        span *= FAN
    stretched = F.floor(F.col("part") / stretch).alias("stretch")
    return packed.select("*", (F.col("part") * span + F.col("at")).alias("place"), stretched).drop("part", "at")


def element_type(classes: DataFrame) -> str:
    return classes.schema["vector"].dataType.elementType.simpleString()


def near_blocks(blocks: DataFrame, k: int, eps: float) -> DataFrame:
    """(i, j), i <= j, of blocks whose boxes lie within ``eps``.

    Pairs of long intervals are tried first; only those within reach are split into pairs of their parts,
    level by level, so that distant stretches of the sequence are never compared.
    """
    box = [F.min(f"lo{d}").alias(f"lo{d}") for d in range(k)] + [F.max(f"hi{d}").alias(f"hi{d}") for d in range(k)]
    levels = [blocks.select("place", *[f"{s}{d}" for s in ("lo", "hi") for d in range(k)])]
    last = levels[0].agg(F.max("place")).first()[0]
    if last is None:
        return blocks.sparkSession.createDataFrame([], "i long, j long")
    while last:
        levels.append(levels[-1].groupBy(F.floor(F.col("place") / FAN).alias("place")).agg(*box))
        last //= FAN
    pairs = blocks.sparkSession.createDataFrame([(0, 0)], "i long, j long")

    def side(level: DataFrame, name: str) -> DataFrame:
        return level.select(F.col("place").alias(name), *[F.col(f"{s}{d}").alias(f"{name}_{s}{d}") for s in ("lo", "hi") for d in range(k)])

    def gap(d: int):
        apart = F.greatest(F.col(f"i_lo{d}") - F.col(f"j_hi{d}"), F.col(f"j_lo{d}") - F.col(f"i_hi{d}"), F.lit(0.0))
        return apart * apart

    for level in reversed(levels[:-1]):
        left = pairs.select(F.explode(F.array(*[F.col("i") * FAN + x for x in range(FAN)])).alias("i"), "j")
        left = left.join(side(level, "i"), "i")  # intervals that exist, before the others are split
        tried = left.withColumnRenamed("j", "__j").select("*", F.explode(F.array(*[F.col("__j") * FAN + x for x in range(FAN)])).alias("j"))
        tried = tried.where("i <= j").join(side(level, "j"), "j")
        pairs = write_out(tried.where(sum(gap(d) for d in range(k)) <= eps * eps * (1 + 1e-9)).select("i", "j"))
    return pairs


class Block:
    def __init__(self, ids: bytes, copies: bytes, sizes: bytes, flat: bytes, axes: np.ndarray, width: int, dtype):
        self.ids, self.copies, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), np.frombuffer(sizes, np.int32)
        self.units = units(np.frombuffer(flat, dtype).astype(np.float64), self.sizes, width)
        box = boxed(self.units, axes)
        self.leaves = [(a, min(a + LEAF, len(self.ids))) for a in range(0, len(self.ids), LEAF)]
        low = np.array([box[a:b].min(0) for a, b in self.leaves])
        high = np.array([box[a:b].max(0) for a, b in self.leaves])
        self.boxes = [(low, high)]  # of leaves, of pairs of leaves, and so on up to one interval
        while len(low) > 1:
            odd = [*range(0, len(low), 2)]
            low, high = np.minimum.reduceat(low, odd, axis=0), np.maximum.reduceat(high, odd, axis=0)
            self.boxes.append((low, high))


def near_leaves(a: Block, b: Block, eps: float) -> np.ndarray:
    """Pairs of leaves within reach: intervals are halved as long as their boxes are."""
    top = max(len(a.boxes), len(b.boxes)) - 1
    pairs = np.zeros((1, 2), dtype=np.int64)
    for level in reversed(range(top + 1)):
        (la, ha), (lb, hb) = a.boxes[min(level, len(a.boxes) - 1)], b.boxes[min(level, len(b.boxes) - 1)]
        if level < top:
            fa = [0, 1] if level < len(a.boxes) - 1 else [0]
            fb = [0, 1] if level < len(b.boxes) - 1 else [0]
            i, j = pairs[:, 0] * len(fa), pairs[:, 1] * len(fb)
            pairs = np.concatenate([np.column_stack([i + x, j + y]) for x in fa for y in fb])
            pairs = pairs[(pairs[:, 0] < len(la)) & (pairs[:, 1] < len(lb))]
        i, j = pairs[:, 0], pairs[:, 1]
        gap = np.maximum(np.maximum(la[i] - hb[j], lb[j] - ha[i]), 0)
        pairs = pairs[(gap * gap).sum(1) <= eps * eps * (1 + 1e-9)]
    return pairs


def join_blocks(a: Block, b: Block, same: bool, threshold: float, eps: float) -> list[tuple[int, int, int]]:
    """(class, links with vectors of the other side, smallest class reached) of the classes that link here."""
    n = len(a.ids)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    links = np.zeros(len(ids), dtype=np.int64)
    label = np.arange(len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # nodes in order of ids, so that the least is the root
    node_of = np.argsort(rank)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def shrink():
        nonlocal label, held, size
        keep = np.flatnonzero(label != np.arange(len(label)))
        r, c = [np.concatenate([keep if k == 0 else label[keep], *[h[k] for h in held]]) for k in (0, 1)]
        label = forest(len(ids), r, c)
        held, size = [], 0

    for i, j in near_leaves(a, b, eps):
        if same and i > j:
            continue
        (s, e), (u, v) = a.leaves[i], b.leaves[j]
        hit = (a.units[s:e] @ b.units[u:v].T >= threshold) & (a.sizes[s:e, None] == b.sizes[None, u:v])
        if not hit.any():
            continue
        links[s:e] += hit @ b.copies[u:v]
        other = u if same else n + u
        if not (same and i == j):
            links[other : other + v - u] += a.copies[s:e] @ hit
        r, c = np.nonzero(hit)
        held.append((rank[r + s], rank[c + other]))
        size += len(r)
        if size > HELD:
            shrink()
    shrink()
    found = np.flatnonzero(links)
    roots = ids[node_of[label[rank[found]]]]
    return list(zip(ids[found].tolist(), links[found].tolist(), roots.tolist()))


def stretch_rows(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """What the tasks read: for each two stretches with near blocks, every block that one of these pairs needs, once.

    A row has the stretches (a, b), its block, ``mates``, the blocks of stretch a that it is compared with, and
    whether it is ``held`` as such a mate. By (a, b, side, place), mates come before those that need them.
    """
    place = blocks.select(F.col("place").alias("i"), F.col("stretch").alias("a"))
    near = pairs.join(place, "i").join(place.select(F.col("i").alias("j"), F.col("a").alias("b")), "j")
    compared = near.groupBy("a", "b", F.col("j").alias("place")).agg(F.collect_list("i").alias("mates"))  # blocks of a stretch
    compared = compared.select("a", "b", (F.col("a") < F.col("b")).cast("int").alias("side"), "place", "mates", (F.col("a") == F.col("b")).alias("held"))
    mates = near.where("a < b").select("a", "b", F.lit(0).alias("side"), F.col("i").alias("place")).distinct()
    rows = compared.unionByName(mates.select("*", F.array().cast("array<long>").alias("mates"), F.lit(True).alias("held")))
    filled = rows.join(blocks.select("place", "ids", "copies", "sizes", "flat"), "place")
    return filled.repartition("a", "b").sortWithinPartitions("a", "b", "side", "place")


def compared_stretches(batches, axes: np.ndarray, width: int, dtype, threshold: float, eps: float):
    """(class, links, root) of the blocks of ``stretch_rows``; one stretch is held, the other streams by."""
    key, held = None, {}
    for batch in batches:
        names = ("a", "b", "place", "mates", "held", "ids", "copies", "sizes", "flat")
        for k in range(batch.num_rows):
            a, b, place, mates, holds, *parts = (batch.column(n)[k].as_py() for n in names)
            if key != (a, b):
                key, held = (a, b), {}
            block = Block(*parts, axes, width, dtype)
            if holds:
                held[place] = block
            for i in mates:
                found = join_blocks(held[i], block, i == place, threshold, eps)
                yield pa.RecordBatch.from_arrays([pa.array([f[x] for f in found], type=pa.int64()) for x in range(3)], names=["class", "links", "root"])


def near_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``df``.

    Rows with equal vectors are one class, whose members link with one another. Classes are sorted by the
    cells of a grid with the width of the largest distance that two linked unit vectors can have, on the
    leading principal axes; intervals of that order are joined where their boxes are within reach, and
    every pair of vectors in reach is compared in double precision. n_links counts rows linked with,
    component_id is the smallest id reachable. Null, empty, zero and non-finite vectors, and rows without an
    id, link with nothing (component_id is then the row's id). Vectors of different lengths don't link.
    Vectors of any numeric type and of any length from 1 are taken; repeated rows are rows like others.
    """
    with scratch(df.sparkSession):
        return write_out(linked(df, vec_id, vector, threshold), outlive=True)


def linked(df: DataFrame, vec_id: str, vector: str, threshold: float) -> DataFrame:
    eps = sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    kind = "array<float>" if df.schema[vector].dataType.elementType.simpleString() == "float" else "array<double>"
    own = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    rows = own.select("vec_id", F.when(F.col("vec_id").isNotNull() & usable("vector"), F.col("vector")).alias("vector"))
    grouped = rows.where("vector is not null").groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    classes = write_out(grouped.withColumn("class", F.monotonically_increasing_id()))
    width = classes.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dtype = np.float32 if kind == "array<float>" else np.float64
    axes = principal_axes(classes, width)
    blocks = order_blocks(classes, axes, width, eps)
    pairs = near_blocks(blocks, axes.shape[1] + 1, eps)
    compare = partial(compared_stretches, axes=axes, width=width, dtype=dtype, threshold=threshold, eps=eps)
    found = write_out(stretch_rows(pairs, blocks).mapInArrow(compare, "class long, links long, root long"))
    roots = connected_components(found.select("class", "root"), "class", "root")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    member = classes.join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    member = write_out(member.select("vector", "first", "links", F.coalesce("root", "class").alias("root")))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    known = member.join(smallest, "root").select("vector", "links", "component_id")
    return rows.join(known, "vector", "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(c, r) AS (SELECT vec_id, vec_id FROM usable UNION SELECT x.c, y.b FROM reach x JOIN links y ON y.a = x.r),
roots AS (SELECT c, min(r) AS r FROM reach GROUP BY c),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(r, e.vec_id) AS component_id, e.vec_id = coalesce(r, e.vec_id) AS kept
FROM embeddings e LEFT JOIN roots ON roots.c = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id"""


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
