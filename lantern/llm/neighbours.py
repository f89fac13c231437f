"""Near-duplicate vectors by NN-descent.

A neighbour list holds the ``LIST`` nearest vectors that are known. The first lists come from random hyperplane trees:
vectors on the same sides of some planes are compared. Then each vector compares the members of its list with each
other (neighbours of neighbours meet there), and all lists keep what is nearer than what they have, until few change.

Vectors that can be reached through near neighbours (at ``REACH`` or more) are a family, and all of a family are compared
block against block, so that every link within is counted and none is written out as a pair. A list whose members are all
linked is saturated: links beyond its last member are in no list, and may lead out of the family. Saturated vectors of
each family are therefore put into cells, with a centre and a radius; cells of different families that are near enough
to have a link are compared vector by vector, and families with a link become one. Recall is audited against brute force for a fixed number of vectors; if it is
below ``RECALL``, it all happens again with twice the trees.

Equal vectors are one class and enter once, with their number. A group of very many near vectors gives more blocks; no
group has to fit in a task.

Defined results: vectors that are null, empty, zero or have null or non-finite components link with nothing, as do vectors
of different lengths. Rows are vectors of their own: rows with equal vec_id count each and have each the links of its
vector. A null vec_id is no identifier: component_id is the smallest that is not null among the rows reachable, and null if there
is none; kept is then true. An empty table gives no rows. Recall below ``RECALL`` after all attempts is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components
from .minhash import BLOCK, Forest, meeting_blocks

LIST, FLOOR, REACH = 10, 0.6, 0.8
#: Vectors of a tree's leaf on average, and the chance that a link at the threshold is in no common leaf.
LEAF, MISS = 256, 0.01
ROUNDS, CHANGED = 6, 0.005
AUDIT, RECALL, ATTEMPTS = 64, 0.98, 3
#: Hyperplanes that part the saturated vectors of a family into cells, at most.
_SIDES = 24


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, vec (components as 64-bit floats; null if the vector links with nothing)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raws = [], []
            for v in batch.column(1):
                x = None if not v.is_valid else v.values
                if x is None or len(x) == 0 or x.null_count:
                    dims.append(0)
                    raws.append(None)
                    continue
                a = x.to_numpy(zero_copy_only=False).astype("<f8")
                with np.errstate(over="ignore", invalid="ignore"):
                    size = float(np.sqrt((a * a).sum()))
                good = np.isfinite(a).all() and math.isfinite(size) and size > 0
                dims.append(len(a) if good else 0)
                raws.append(a.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], ["vec_id", "dim", "vec"])

    return common.arrow_map(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")), run, "vec_id long, dim int, vec binary")


def _unit(column: pa.Array) -> np.ndarray:
    data, offsets = common.column_bytes(column)
    x = np.frombuffer(data.tobytes(), "<f8").reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _nearest(ids: np.ndarray, x: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
    """u, v, sim: for each vector its nearest of a group, at FLOOR or more."""
    n = len(ids)
    sims = x @ x.T
    sims[np.arange(n), np.arange(n)] = -2
    if side.any() and not side.all():
        sims[side[:, None] == side[None, :]] = -2
    k = min(LIST, n - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-sims, axis=1)[:, :k]
    value = np.take_along_axis(sims, near, axis=1)
    i, j = np.nonzero(value >= FLOOR)
    return [ids[i], ids[near[i, j]], value[i, j]]


def _grouped_nearest(df: DataFrame, keys: list[str]) -> DataFrame:
    """df: keys, side, vec_id, vec, dim; (u, v, sim) within each group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in common.whole_groups(batches, keys):
            column = {n: whole.column(whole.schema.get_field_index(n)) for n in ("vec_id", "side", "vec")}
            ids, side = column["vec_id"].to_numpy(), column["side"].to_numpy()
            found: list[list[np.ndarray]] = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a > 1:
                    found.append(_nearest(ids[a:b], _unit(column["vec"].slice(a, b - a)), side[a:b]))
            if found:
                u, v, s = (np.concatenate([f[i] for f in found]) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], ["u", "v", "sim"])

    return common.arrow_map(df.repartition(*keys).sortWithinPartitions(*keys), run, "u long, v long, sim double")


def _best(edges: DataFrame) -> DataFrame:
    """The LIST nearest of each vector, from pairs in either order."""
    both = edges.select("u", "v", "sim").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    one = both.where("u <> v").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return one.withColumn("place", place).where(F.col("place") <= LIST).select("u", "v", "sim")


def first_lists(classes: DataFrame, count: int, threshold: float, trees_times: int) -> DataFrame:
    """Lists from random hyperplane trees. classes: vec_id, dim, vec."""
    bits = max(0, math.ceil(math.log2(max(1, count / LEAF))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    trees = (1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - together))) * trees_times

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = _unit(batch.column(2).take(pa.array(rows)))
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([7, d])).normal(size=(d, trees * bits))
                sides = (x @ planes[d] > 0).reshape(len(rows), trees, bits).astype(np.uint64)
                code = (sides << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                key = common.mix(code * np.uint64(2 * trees + 1) + np.arange(trees, dtype=np.uint64)[None, :] + common.mix(np.array([d], np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy()[rows], trees)), pa.array(key.ravel().view(np.int64))], ["vec_id", "key"])

    rows = common.written(common.arrow_map(classes.select("vec_id", "dim", "vec"), leaves, "vec_id long, key long"), "leaves")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    dealt = meeting_blocks(rows.join(sizes, "key"), "vec_id").select("key", "pair", "side", "vec_id").join(classes.select("vec_id", "vec"), "vec_id")
    return common.written(_best(_grouped_nearest(dealt, ["key", "pair"])), "lists")


def descend(classes: DataFrame, lists: DataFrame) -> DataFrame:
    """Neighbours of neighbours, until few lists change."""
    for _ in range(ROUNDS):
        members = lists.select(F.col("u").alias("at"), F.col("v").alias("vec_id")).unionAll(lists.select(F.col("u").alias("at"), F.col("u").alias("vec_id")).distinct())
        met = members.join(classes.select("vec_id", "vec"), "vec_id").withColumn("side", F.lit(0))
        better = common.written(_best(_grouped_nearest(met, ["at"]).unionByName(lists)), "lists")
        before = lists.count()
        new = better.join(lists.select("u", "v"), ["u", "v"], "left_anti").count()
        lists = better
        if new <= CHANGED * max(1, before):
            break
    return lists


def _cells(full: DataFrame) -> DataFrame:
    """full: vec_id, dim, vec, component_id. The same with ``cell``: at most about BLOCK vectors of one family, by sides of hyperplanes and then by hash."""
    size = full.groupBy("component_id").agg(F.count(F.lit(1)).alias("members"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("members") / BLOCK)), F.lit(0)), F.lit(_SIDES)).cast("int")

    def sides(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, used = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            code = np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                planes = np.random.Generator(np.random.PCG64([11, d])).normal(size=(d, _SIDES))
                on = (_unit(batch.column(3).take(pa.array(rows))) @ planes > 0) & (np.arange(_SIDES) < used[rows][:, None])
                code[rows] = (on.astype(np.int64) << np.arange(_SIDES)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(code)], ["vec_id", "component_id", "dim", "vec", "code"])

    coded = full.join(size, "component_id").select("vec_id", "component_id", "dim", "vec", bits.alias("bits"))
    coded = common.written(common.arrow_map(coded, sides, "vec_id long, component_id long, dim int, vec binary, code long"), "sides")
    parts = coded.groupBy("component_id", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = common.written(parts.withColumn("cell", F.monotonically_increasing_id()), "cells")
    own = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return common.written(coded.join(parts, ["component_id", "code"]).where(F.col("part") == own).select("cell", "vec_id", "component_id", "dim", "vec"), "cells")


def _facing(cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b) cells of different families that are near enough to have a link."""

    def centres(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in common.whole_groups(batches, ["cell"]):
            column = {n: whole.column(whole.schema.get_field_index(n)) for n in ("cell", "component_id", "dim", "vec")}
            middle, radius = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                x = _unit(column["vec"].slice(a, b - a))
                c = x.sum(axis=0)
                size = float(np.sqrt(c @ c))
                c = c / size if size > 1e-9 else x[0]
                middle.append(c.astype("<f8").tobytes())
                radius.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
            rows = pa.array(at[:-1])
            yield pa.RecordBatch.from_arrays([*(column[n].take(rows) for n in ("cell", "component_id", "dim")), pa.array(middle, pa.binary()), pa.array(radius)], ["cell", "component_id", "dim", "vec", "radius"])

    balls = common.written(common.arrow_map(cells.repartition("cell").sortWithinPartitions("cell"), centres, "cell long, component_id long, dim int, vec binary, radius double"), "balls")
    size = balls.groupBy("dim").agg(F.count(F.lit(1)).alias("members"))
    reach = math.acos(min(1.0, max(-1.0, threshold)))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in common.whole_groups(batches, ["dim", "pair"]):
            column = {n: whole.column(whole.schema.get_field_index(n)) for n in ("cell", "component_id", "side", "vec", "radius")}
            cell, family, side, radius = (column[n].to_numpy() for n in ("cell", "component_id", "side", "radius"))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                x, r = _unit(column["vec"].slice(a, b - a)), radius[a:b]
                near = np.arccos(np.clip(x @ x.T, -1, 1)) <= reach + r[:, None] + r[None, :] + 1e-6
                near &= family[a:b, None] != family[None, a:b]
                if side[a:b].any():
                    near &= side[a:b, None] != side[None, a:b]
                i, j = np.nonzero(np.triu(near))
                yield pa.RecordBatch.from_arrays([pa.array(cell[a + i]), pa.array(cell[a + j])], ["a", "b"])

    dealt = meeting_blocks(balls.join(size, "dim"), "cell").select("dim", "pair", "side", "cell", "component_id", "vec", "radius")
    return common.written(common.arrow_map(dealt.repartition("dim", "pair").sortWithinPartitions("dim", "pair"), meet, "a long, b long"), "facing")


def saturated_links(classes: DataFrame, lists: DataFrame, families: DataFrame, threshold: float) -> DataFrame | None:
    """(u, v): a link for any two cells of saturated vectors of different families that have one; None if no list is saturated."""
    full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least")).where((F.col("n") >= LIST) & (F.col("least") >= threshold))
    full = full.select(F.col("u").alias("vec_id")).join(families.withColumnRenamed("id", "vec_id"), "vec_id")
    full = common.written(full.join(classes.select("vec_id", "dim", "vec"), "vec_id"), "saturated")
    if full.select("component_id").distinct().limit(2).count() < 2:
        return None
    cells = _cells(full)
    pairs = _facing(cells, threshold).withColumn("pair", F.monotonically_increasing_id())
    pairs = common.written(pairs, "facing")
    ends = pairs.select("pair", F.col("a").alias("cell"), F.lit(0).alias("side")).unionAll(pairs.select("pair", F.col("b").alias("cell"), F.lit(1).alias("side")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in common.whole_groups(batches, ["pair"]):
            column = {n: whole.column(whole.schema.get_field_index(n)) for n in ("vec_id", "side", "vec")}
            ids, side = column["vec_id"].to_numpy(), column["side"].to_numpy()
            u, v = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                x = _unit(column["vec"].slice(a, b - a))
                one, two = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
                linked = x[one] @ x[two].T >= threshold
                if linked.any():
                    i, j = np.unravel_index(int(linked.argmax()), linked.shape)
                    u.append(ids[a + one[i]])
                    v.append(ids[a + two[j]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    met = ends.join(cells.select("cell", "vec_id", "vec"), "cell").select("pair", "side", "vec_id", "vec")
    return common.written(common.arrow_map(met.repartition("pair").sortWithinPartitions("pair"), run, "u long, v long"), "joined")


def count_links(classes: DataFrame, families: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Within families: (vec_id, n) links of each class to others, by number of vectors; and (u, v), a forest of the links."""
    size = families.groupBy("component_id").agg(F.count(F.lit(1)).alias("members"))
    member = families.join(size, "component_id").withColumnRenamed("id", "vec_id")
    dealt = meeting_blocks(member, "vec_id").select("component_id", "pair", "side", "vec_id").join(classes.select("vec_id", "vec", "number"), "vec_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in common.whole_groups(batches, ["component_id", "pair"]):
            column = {n: whole.column(whole.schema.get_field_index(n)) for n in ("vec_id", "side", "vec", "number")}
            ids, side, number = (column[n].to_numpy() for n in ("vec_id", "side", "number"))
            counts = np.zeros(len(ids), np.int64)
            u, v = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                x = _unit(column["vec"].slice(a, b - a))
                linked = x @ x.T >= threshold
                linked[np.arange(b - a), np.arange(b - a)] = False
                if side[a:b].any():
                    linked &= side[a:b, None] != side[None, a:b]
                counts[a:b] = linked @ number[a:b]
                forest = Forest(b - a)
                # a vector's first link makes a forest but for the roots, which all links join
                first = np.where(linked.any(axis=1), linked.argmax(axis=1), -1)
                for i in np.flatnonzero(first >= 0).tolist():
                    if forest.join(i, int(first[i])):
                        u.append(ids[a + i])
                        v.append(ids[a + int(first[i])])
                roots = np.array([forest.root(i) for i in range(b - a)])
                if len(np.unique(roots[first >= 0])) > 1:
                    for i, j in zip(*np.nonzero(np.triu(linked & (roots[:, None] != roots[None, :])))):
                        if forest.join(int(i), int(j)):
                            u.append(ids[a + i])
                            v.append(ids[a + j])
            some = counts > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[some], np.array(u, np.int64)])), pa.array(np.concatenate([counts[some], np.zeros(len(u), np.int64)])), pa.array([None] * int(some.sum()) + [int(i) for i in v], pa.int64())],
                ["u", "n", "v"],
            )

    grouped = dealt.repartition("component_id", "pair").sortWithinPartitions("component_id", "pair")
    found = common.written(common.arrow_map(grouped, run, "u long, n long, v long"), "links")
    return found.where("v is null").groupBy(F.col("u").alias("vec_id")).agg(F.sum("n").alias("n")), found.where("v is not null").select("u", "v")


def audit(classes: DataFrame, counts: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """The share of true links, by brute force for ``sample`` vectors, that counts (vec_id, n) has."""
    asked = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).join(counts, "vec_id", "left").select("vec_id", "dim", "vec", F.coalesce("n", F.lit(0)).alias("n")).collect()
    sent = [(r.vec_id, r.dim, bytes(r.vec)) for r in asked]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            dims, number = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for d in {d for _, d, _ in sent}:
                rows = np.flatnonzero(dims == d)
                if not len(rows):
                    continue
                own = [(i, raw) for i, dim, raw in sent if dim == d]
                y = _unit(pa.array([raw for _, raw in own], pa.binary()))
                linked = _unit(batch.column(2).take(pa.array(rows))) @ y.T >= threshold
                linked &= batch.column(0).to_numpy()[rows][:, None] != np.array([i for i, _ in own])[None, :]
                total += int((linked * number[rows][:, None]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["n"])

    true = common.arrow_map(classes.select("vec_id", "dim", "vec", "number"), run, "n long").agg(F.sum("n").alias("n")).first().n or 0
    return sum(r.n for r in asked) / true if true else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    rows = common.written(clean(vectors, id_col, vector_col).withColumn("row_id", F.monotonically_increasing_id()), "vectors")
    # classes go by a row's number, as vec_ids may be equal or null
    classes = rows.where("vec is not null").groupBy("dim", "vec").agg(F.min("row_id").alias("vec_id"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("number"))
    classes = common.written(classes, "classes")
    count = classes.count()
    for attempt in range(ATTEMPTS):
        lists = descend(classes, first_lists(classes, count, threshold, 2**attempt))
        near = lists.where(F.col("sim") >= min(REACH, threshold)).select("u", "v")
        families = components(near)
        joined = saturated_links(classes, lists, families, threshold)
        if joined is not None:
            families = components(near.unionAll(joined))
        counts, links = count_links(classes, families, threshold)
        recall = audit(classes, counts, threshold)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"recall of links is {recall:.3f} after {ATTEMPTS} attempts; {RECALL} is asked for")
    of_class = classes.withColumnRenamed("vec_id", "class_id").join(counts.withColumnRenamed("vec_id", "class_id"), "class_id", "left")
    of_class = of_class.join(components(links).select(F.col("id").alias("class_id"), F.col("component_id").alias("group_id")), "class_id", "left")
    # only groups of several classes: aggregated before their members meet, so a large group is no large task
    smallest = of_class.where("group_id is not null").groupBy("group_id").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(smallest, "group_id", "left").select("dim", "vec", "n", "number", F.when(F.col("group_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.join(of_class, ["dim", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("number") - 1, F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
