"""Near-duplicate documents by one-permutation MinHash.

One hash of each shingle chooses a bin and its value; the least value of each bin is kept, and empty bins
borrow from full ones by optimal densification: bin i asks bins g(i, 1), g(i, 2), ... of a fixed random
function until one is full. Bands of bins are bucket keys; how many bins a band has, and how many must be alike for
a candidate, follows from the similarity (``plan``).

Documents with the same set of shingles are one class, and only one row of it goes on. In a bucket,
members form stars: the member that collides most is a star's centre, and every member whose signature
agrees with it hangs on it. A bucket beyond BLOCK members is dealt to blocks, each of which gets a copy of the centre;
members that agree with no centre are compared with all others of the bucket by signature, in their own block and
then in the others, and hang on their neighbours in the same way, so a bucket of n
members gives fewer than n candidate edges whatever its size. The candidate edges make families. In each
family links are confirmed on full sets of shingles, in the same two steps, and a spanning forest of the
confirmed links comes out. Components of these are the result. Nothing is capped; a hot bucket or family is
more blocks. Rows are copied once a block only for members that the centre doesn't take (``star_blocks``, ``rest_blocks``).

Chance of missing a link at the threshold, if bins are alike independently: no band in common under ``NO_BAND``, too few bins
alike about 1e-11. Sets of few shingles fill few bins, and what bins borrow is alike or not together: the
standard deviation of the bins alike is then up to 1.26 times as much (measured at 5 to 20 shingles), for which ``SPREAD`` allows.

Defined results: a document without words has an empty set, links with nothing and is its own component.
Fewer words than a shingle: the whole sequence is its one shingle. Null text counts as empty. Each row has
a result, rows with equal doc_id by their own texts. A null doc_id is no identifier: component_id is the smallest that is
not null among the rows reachable, and null if there is none; kept is then true. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .components import components

BINS = 128
SHINGLE = 5
#: The chance that a link at the threshold has no band in common, and how many standard deviations (of short sets) below the mean bins may be alike.
NO_BAND, SPREAD = 1e-9, 5.2 * 1.3
#: Members of a block; two blocks meet in a task.
BLOCK = 512
_TRIES = 64
_GUIDE = np.random.Generator(np.random.PCG64(77)).integers(0, BINS, (_TRIES, BINS))


def plan(percent: int) -> tuple[int, int]:
    """Bins of a band, and bins that must be alike for two members of a bucket to be put in a family, for links at percent / 100."""
    alike = percent / 100
    rows = max((r for r in range(1, BINS + 1) if (1 - alike**r) ** (BINS // r) <= NO_BAND), default=0)
    if not rows or alike > 1:
        raise ValueError(f"near duplicates at {percent} percent can't be found in {BINS} bins")
    return rows, max(1, math.floor(BINS * alike - SPREAD * math.sqrt(BINS * alike * (1 - alike))))


def shingle_sets(batch: pa.RecordBatch, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, joined, and the texts' offsets."""
    data, offsets = common.column_bytes(batch.column(column))
    owner, hashes = common.Words(data, offsets).shingles(SHINGLE)
    return common.distinct_by_owner(owner, hashes, batch.num_rows)


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of BINS values (unsigned 32-bit) for each set; sets that are empty have zeros."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bins = (sets >> np.uint64(57)).astype(np.int64)
    slot = owner * BINS + bins
    out = np.zeros(n * BINS, np.uint32)
    full = np.zeros(n * BINS, bool)
    # the sets are sorted, so a slot's first hash is its least
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    out[slot[first]] = ((sets[first] >> np.uint64(20)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    full[slot[first]] = True
    out, full = out.reshape(n, BINS), full.reshape(n, BINS)
    some = full.any(axis=1)
    row, bin_ = np.nonzero(~full & some[:, None])
    for t in range(_TRIES):
        if not len(row):
            break
        asked = _GUIDE[t, bin_]
        found = full[row, asked]
        out[row[found], bin_[found]] = out[row[found], asked[found]]
        row, bin_ = row[~found], bin_[~found]
    for r in np.unique(row):  # few full bins: the rest take, each by its own order of all bins, the first full one
        have = np.flatnonzero(full[r])
        for b in bin_[row == r]:
            order = common.mix(np.uint64(b * 1009) + have.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[r, b] = out[r, have[np.argmin(order)]]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A bucket key (signed 64-bit) for each band of ``rows`` bins, for each row."""
    bands = BINS // rows
    with np.errstate(over="ignore"):
        parts = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
        key = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
        for r in range(rows):
            key = common.mix(key * common.BASE + parts[:, :, r])
    return key.view(np.int64)


def profiles(docs: DataFrame, rows: int, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, set_hash, keys (bucket keys of bands of ``rows`` bins), sig (the low byte of each bin), carried (a struct of the columns to carry, text if none are named)."""
    bands = BINS // rows
    source = common.texts(docs, carry=carry or ["text"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=1 << 20):
            sets, offsets = shingle_sets(batch)
            sizes = np.diff(offsets)
            signature = signatures(sets, offsets)
            keys = band_keys(signature, rows)
            with np.errstate(over="ignore"):
                totals = np.concatenate([[np.uint64(0)], np.cumsum(common.mix(sets ^ np.uint64(0x1234567)))])
                others = np.concatenate([[np.uint64(0)], np.cumsum(common.mix(sets + np.uint64(0x7654321)))])
            marks = [np.stack([(x[offsets[1:]] - x[offsets[:-1]]) for x in (totals, others)], axis=1)]
            mark = np.ascontiguousarray(marks[0]).view(np.uint8).reshape(len(sizes), 16)
            low = (signature & np.uint32(0xFF)).astype(np.uint8)
            key_lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sizes) + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array([m.tobytes() for m in mark], pa.binary()), key_lists, pa.array([x.tobytes() for x in low], pa.binary()), batch.column(2)],
                ["doc_id", "n_shingles", "set_hash", "keys", "sig", "carried"],
            )

    made = StructType.fromDDL("doc_id long, n_shingles long, set_hash binary, keys array<long>, sig binary").add(source.schema["carried"])
    return common.arrow_map(source, run, made)


class Forest:
    """Union-find over 0 .. n - 1, for a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def star_edges(linked: Callable[[int], np.ndarray], order: np.ndarray, side: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(edges of a forest of what is linked, members not linked with order[0]). linked(i): which members i is linked with.

    The first member is the centre of a star and takes all that are linked with it. Every member that it doesn't
    take is compared with all members in turn, so that no two linked members stay in different trees;
    those that the first centre takes are in one tree and needn't be compared with each other. With side 0 and 1 only
    members of different sides are compared, and those of side 1 with all of side 0.
    """
    edges: list[tuple[int, int]] = []
    tree = np.arange(len(order))
    paired = bool(side.any())
    taken = side == 0 if paired else np.zeros(len(order), bool)
    rest = np.zeros(0, np.int64)
    for c in order.tolist():
        if taken[c]:
            continue
        alike = linked(c)
        if paired:
            alike &= side == 0
        alike[c] = False
        if c == order[0] and not paired:
            taken |= alike
            rest = np.flatnonzero(~alike)
            rest = rest[rest != c]
        # one edge to each tree that isn't its own
        members = np.flatnonzero(alike & (tree != tree[c]))
        if len(members):
            roots, first = np.unique(tree[members], return_index=True)
            edges += [(j, c) for j in members[first].tolist()]
            met = np.zeros(len(order), bool)
            met[roots] = True
            tree[met[tree]] = tree[c]
    return edges, rest


def meeting_blocks(sized: DataFrame, id_col: str) -> DataFrame:
    """Rows with (key, pair) such that all rows of a key meet in blocks of about BLOCK, each block with each other. sized: has ``members``, the rows of its key."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64(id_col), F.col("n_blocks")).cast("long")
    out = sized.withColumn("n_blocks", blocks).withColumn("block", own)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    out = out.withColumn("pair", F.least("block", "other") * F.lit(1 << 31).cast("long") + F.greatest("block", "other"))
    return out.withColumn("side", (F.col("block") > F.col("other")).cast("int"))


#: How members of a key are told to be linked: a batch with ``payload`` to (some of its rows to (number of one of these to a mask of those it is linked with)).
Linker = Callable[[pa.RecordBatch], Callable[[slice], Callable[[int], np.ndarray]]]


def stars(members: DataFrame, payloads: DataFrame, linker: Linker, what: str) -> DataFrame:
    """(u, v) edges that join all linked members of each key, fewer than members. members: key, id, weight, written; payloads: id, payload, which join last."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    sizes = common.written(sizes.select("key", blocks.alias("blocks"), (-F.col("top.id")).alias("centre")), f"{what}-sizes")
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # each block gets the centre: in its own block it stands anyway
    copies = F.when(F.col("id") == F.col("centre"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = dealt.select("key", "id", "weight", "blocks", "centre", F.explode(copies).alias("block")).join(payloads, "id")

    def star(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in common.whole_groups(batches, ["key", "block"]):
            key, ids, weight, blocks, centre = (whole.column(whole.schema.get_field_index(c)).to_numpy() for c in ("key", "id", "weight", "blocks", "centre"))
            u, v, of, linked = [], [], [], linker(whole)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a < 2:
                    continue
                own = ids[a:b]
                if b - a == 2 and blocks[a] == 1:
                    if linked(slice(a, b))(0)[1]:
                        u.append(own[0])
                        v.append(own[1])
                        of.append(None)
                    continue
                order = np.lexsort((own, -weight[a:b], own != centre[a:b]))
                edges, rest = star_edges(linked(slice(a, b)), order, np.zeros(b - a, np.int64))
                u += [own[i] for i, _ in edges]
                v += [own[j] for _, j in edges]
                of += [None] * len(edges)
                if blocks[a] > 1:
                    u += own[rest].tolist()
                    v += own[rest].tolist()
                    of += [key[a]] * len(rest)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(of, pa.int64())], ["u", "v", "rest_of"])

    grouped = dealt.repartition("key", "block").sortWithinPartitions("key", "block")
    found = common.written(common.arrow_map(grouped, star, "u long, v long, rest_of long"), f"{what}-stars")
    edges = found.where("rest_of is null").select("u", "v").distinct()
    rest = found.where("rest_of is not null").select(F.col("rest_of").alias("key"), F.col("u").alias("id"))
    if rest.isEmpty():
        return edges
    return edges.unionAll(_rest(members, payloads, rest, sizes, linker))


def _rest(members: DataFrame, payloads: DataFrame, rest: DataFrame, sizes: DataFrame, linker: Linker) -> DataFrame:
    """(u, v) edges between members that their key's centre doesn't take (rest: key, id) and all of the other blocks."""
    left = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("waves")).join(sizes, "key")
    every = members.join(left, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    own = every.select("key", "id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("waves") - 1)).alias("wave"), F.lit(0).alias("side"))
    lone = every.join(rest, ["key", "id"], "left_semi").withColumn("wave", F.pmod(F.xxhash64("id", "key"), F.col("waves"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block")
    met = own.unionByName(lone.select("key", "id", F.col("other").alias("block"), "wave", F.lit(1).alias("side"))).join(payloads, "id")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in common.whole_groups(batches, ["key", "block", "wave"]):
            ids, side = (whole.column(whole.schema.get_field_index(c)).to_numpy() for c in ("id", "side"))
            u, v, linked = [], [], linker(whole)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if side[a:b].any():
                    edges, _ = star_edges(linked(slice(a, b)), np.arange(b - a), side[a:b])
                    u += [ids[a + i] for i, _ in edges]
                    v += [ids[a + j] for _, j in edges]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return common.arrow_map(met.repartition("key", "block", "wave").sortWithinPartitions("key", "block", "wave"), meet, "u long, v long").distinct()


def candidate_edges(classes: DataFrame, agree: int) -> DataFrame:
    """(u, v) star edges between classes that meet in buckets. classes: class_id, keys, sig."""
    rows = classes.select("class_id", F.explode("keys").alias("key"))
    # few keys are left of all: written, their size is known, and Spark needn't shuffle the rows again if it is small
    sizes = common.written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "bucket-sizes")
    crowded = common.written(rows.join(sizes, "key"), "buckets")
    # only members of buckets go on, and only they bring their signatures
    weights = crowded.groupBy("class_id").agg(F.sum("members").alias("weight"))
    members = common.written(crowded.select("key", "class_id").join(weights, "class_id").select("key", F.col("class_id").alias("id"), "weight"), "members")
    common.forget(sizes, crowded)
    payloads = classes.select(F.col("class_id").alias("id"), F.col("sig").alias("payload"))

    def linker(whole: pa.RecordBatch) -> Callable[[slice], Callable[[int], np.ndarray]]:
        sigs = common.fixed_bytes(whole.column(whole.schema.get_field_index("payload")), BINS)
        return lambda rows: lambda i: (sigs[rows] == sigs[rows.start + i]).sum(axis=1, dtype=np.int16) >= agree

    return stars(members, payloads, linker, "buckets")


def set_links(sets: list[np.ndarray], percent: int) -> Callable[[int], np.ndarray]:
    """Which sets have 100 * intersection >= percent * union with set i, by a table of what values stand in which sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]

    def linked(i: int) -> np.ndarray:
        a, b = np.searchsorted(values, sets[i], side="left"), np.searchsorted(values, sets[i], side="right")
        n = b - a
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        both = np.bincount(owner[at], minlength=len(sets))
        return (100 * both >= percent * (sizes + sizes[i] - both)) & (sizes > 0) & (sizes[i] > 0)

    return linked


def links(texts: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) within families. families: id, component_id; texts: id, text, one row for each id at least of families."""
    members = common.written(families.select(F.col("component_id").alias("key"), "id", F.lit(0).alias("weight")), "families")
    # only texts of families are shuffled if the written identifiers are few enough for Spark to send them to all
    texts = texts.join(members.select("id"), "id", "left_semi")

    def linker(whole: pa.RecordBatch) -> Callable[[slice], Callable[[int], np.ndarray]]:
        sets: list[np.ndarray] = []
        at = whole.schema.get_field_index("payload")
        for batch in common.pieces([whole], "payload", 1 << 20):
            values, offsets = shingle_sets(batch, at)
            sets += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        return lambda rows: set_links(sets[rows], percent)

    return stars(members, texts.withColumnRenamed("text", "payload"), linker, "links")


def _grouped(docs: DataFrame, percent: int, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: row_id, doc_id, n_shingles, carried, class_id, group_id, component_id; a written table of the rows). Rows without words have null for the last three."""
    band_rows, agree = plan(percent)
    found = common.written(profiles(docs, band_rows, carry).withColumn("row_id", F.monotonically_increasing_id()), "profiles")
    classes = found.where("n_shingles > 0").groupBy("n_shingles", "set_hash").agg(F.min("row_id").alias("class_id"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("number"))
    classes = common.written(classes, "classes")
    # rows that are no representatives, by their numbers: what is wide stays where it is if these are few
    copies = found.where("n_shingles > 0").select("n_shingles", "set_hash", "row_id").join(classes.where("number > 1"), ["n_shingles", "set_hash"]).where("row_id <> class_id").select("row_id")
    copies = common.written(copies, "copies")
    representatives = common.written(found.where("n_shingles > 0").join(copies, "row_id", "left_anti").select(F.col("row_id").alias("class_id"), "keys", "sig"), "representatives")
    families = components(candidate_edges(representatives, agree))
    common.forget(copies, representatives)
    texts = found.select(F.col("row_id").alias("id"), F.coalesce("carried.text", F.lit("")).alias("text"))
    linked = components(links(texts, families, percent)).withColumnRenamed("id", "class_id").withColumnRenamed("component_id", "group_id")
    least = classes.join(linked, "class_id").groupBy("group_id").agg(F.min("least").alias("component_id"))
    of_class = classes.join(linked.join(least, "group_id"), "class_id", "left")
    of_class = of_class.select("n_shingles", "set_hash", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.when(F.col("group_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return found.select("row_id", "doc_id", "n_shingles", "set_hash").join(of_class, ["n_shingles", "set_hash"], "left"), found


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    rows, _ = _grouped(docs, percent)
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id (rows without doc_id come last; of several any one).

    Rows without words all stay. Rows are told apart by themselves and not by doc_id, so rows with equal or null doc_id
    stay or go each by its own text.
    """
    rows, found = _grouped(docs, percent, docs.columns)
    first = rows.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first"))
    stay = first.select("first.row_id").unionAll(rows.where("group_id is null").select("row_id"))
    return found.join(stay, "row_id", "left_semi").select("carried.*")
