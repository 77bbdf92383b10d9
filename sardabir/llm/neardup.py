"""Operator 6: near-duplicates by b-bit MinHash, links confirmed on full shingle sets.

1. Each row becomes a digest of its shingle set, its band keys, and a packed signature of BITS low bits of each
   minimum. Rows of one digest are one class, a node of the graph; ids don't tell classes apart, as they may repeat.
2. Classes are dealt by band key. In a bucket, a leader takes whatever is near by the estimate from the signatures'
   bit counts; what isn't very near to any leader so far leads next. Jaccard distance obeys the triangle inequality,
   so two classes that are to be linked always share a leader: if one of them is within CORE of it, the other is
   within Bars.join, which is farther by the link's own distance and the estimates' errors. Members that leaders
   connect get one edge each, and the connected components of all edges hold every link. A bucket of more than HOT
   classes is dealt over several tasks: each elects leaders of its own rows, and then compares its rows with the
   leaders of all, so the same holds across them.
3. Inside such a cluster all links are sought on full sets, in blocks of at most BLOCK_SHINGLES: an estimate rules out
   what is far of large sets, and pairs that are connected already are passed over. A cluster of several blocks goes
   in three steps: links inside each block; links among one class of each component so far; and last, if anything is
   still apart, what is not of the cluster's main component against all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import cut, ensure_checkpoint_dir, hinted, map_rows, settled
from .components import connected_components

HASHES, BITS = 128, 2
#: Two sets at the bar share none of the bands with at most this probability; bands are at least so many.
MISSED, LEAST_BANDS = 5e-8, 24
#: Estimates at true similarity s have a standard error of at most 0.06 for any s, 0.037 at 0.85 and 0.042 at 0.80.
CORE = 0.85
#: An estimate that is so much less than the bar rules a link out: more than eight standard errors at 0.80 and 0.85.
MARGIN = 0.35
#: Low bits of few minima depend on each other, so sets of fewer shingles are compared without an estimate.
FEW = 64
#: Classes of a bucket, and shingles of a block (8 bytes each), that one task takes at once.
HOT, BLOCK_SHINGLES = 8192, 1 << 20
_RNG = np.random.default_rng(20_240_601)
FACTORS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_FIELDS = np.uint64(0x5555555555555555)


@dataclass(frozen=True)
class Bars:
    """What follows from the least similarity of a link, in percent."""

    bands: int
    band_rows: int
    #: CORE less the link's own distance, and MARGIN for the errors of both estimates.
    join: float
    #: Estimates under this are no links.
    least_estimate: float


def bars(percent: int) -> Bars:
    """Bands of the most rows, four at most, that HASHES suffice for; at 85 24 of 4 (2e-8), at 80 32 of 4 (5e-8)."""
    s = percent / 100
    for rows in (4, 3, 2, 1):
        missed = 1 - s**rows
        bands = max(LEAST_BANDS, math.ceil(math.log(MISSED) / math.log(missed)) if missed > 0 else 1)
        if bands * rows <= HASHES:
            return Bars(bands, rows, CORE - (1 - s) - MARGIN, s - MARGIN)
    raise ValueError(f"{HASHES} hashes are too few for links at {percent} %")


def pack(minima: np.ndarray) -> np.ndarray:
    """The BITS = 2 low bits of each minimum, 32 to a 64-bit word."""
    low = (minima & np.uint32(3)).astype(np.uint64).reshape(len(minima), minima.shape[1] // 32, 32)
    return (low << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by bit counts, corrected for low bits that agree by chance (one in 2**BITS)."""
    differ = a ^ b
    differ = (differ | (differ >> np.uint64(1))) & _FIELDS
    chance = 1 / (1 << BITS)
    return (1 - np.bitwise_count(differ).sum(axis=-1) / HASHES - chance) / (1 - chance)


def _describe(batch: pa.RecordBatch, at: Bars) -> dict:
    sets = shingles.shingle_sets([t or "" for t in batch.column(2).to_pylist()])
    some = [i for i, s in enumerate(sets) if len(s)]
    minima = shingles.minima([sets[i] for i in some], FACTORS, SHIFTS)
    banded = minima[:, :at.bands * at.band_rows].reshape(len(some), at.bands, at.band_rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, at.bands + 1, dtype=np.uint64), (len(some), at.bands)).copy()
        for k in range(at.band_rows):
            keys = shingles.mix(keys * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, k])
    packed = pack(minima)
    out: dict = {"id": batch.column(0), "text_hash": batch.column(1), "n_shingles": [len(s) for s in sets]} | {c: [None] * len(sets) for c in ("digest", "bands", "packed")}
    for row, i in enumerate(some):
        out["digest"][i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
        out["bands"][i] = keys[row].view(np.int64)
        out["packed"][i] = packed[row].tobytes()
    return out


# ---- buckets ---------------------------------------------------------------------------------------------------


def _elect(packed: np.ndarray) -> np.ndarray:
    """Places of the leaders of a bucket: every member is within CORE of one of them."""
    left, leaders = np.ones(len(packed), dtype=bool), []
    while left.any():
        leader = int(np.argmax(left))
        leaders.append(leader)
        left &= estimate(packed[leader], packed) < CORE
        left[leader] = False
    return np.array(leaders, dtype=np.int64)


def _lead(nodes: np.ndarray, packed: np.ndarray, given: int, join: float) -> np.ndarray:
    """Edges (centre, member) of one bucket: a star for each set of members that leaders connect, one edge a member.

    The first ``given`` members are leaders of the whole bucket of which these may be a part. A star's centre is its
    first member, so it is a given leader wherever there are any.
    """
    places, left, group = np.arange(len(nodes)), np.ones(len(nodes), dtype=bool), np.arange(len(nodes))
    leader = 0
    while group.any() and (leader < given or left.any()):
        at = leader if leader < given else int(np.argmax(left))
        near = estimate(packed[at], packed)
        left &= near < CORE
        left[at] = False
        met = np.unique(group[(near >= join) | (places == at)])
        if len(met) > 1:
            group[np.isin(group, met)] = met[0]
        leader += 1
    members = np.flatnonzero(group != places)
    return np.stack((nodes[group[members]], nodes[members]))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole buckets of rows (band, part, given, node, packed) sorted by (band, part): starts of buckets, bands, given, nodes, packed."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
        new.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1))
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        band, part = held[:2]
        starts = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (part[1:] != part[:-1]))))
        if len(starts) > 1:
            last = starts[-1]
            yield (starts[:-1], *(x[:last] for x in (band, held[2], held[3], held[4])))
            held = [x[last:] for x in held]
    if held is not None:
        yield np.zeros(1, dtype=np.int64), held[0], held[2], held[3], held[4]


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, node and packed of the leaders of every bucket's parts."""
    for starts, bands, _, nodes, packed in _by_bucket(batches):
        for s, e in zip(starts, np.append(starts[1:], len(nodes))):
            at = s + _elect(packed[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(bands[at]), pa.array(nodes[at]), pa.array([p.tobytes() for p in packed[at]], pa.binary())], names=["band", "node", "packed"])


def _bucket_edges(batches: Iterator[pa.RecordBatch], join: float) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of all buckets."""
    for starts, _, given, nodes, packed in _by_bucket(batches):
        sizes = np.diff(np.append(starts, len(nodes)))
        first = np.repeat(starts, sizes)
        near = estimate(packed[first], packed)
        # at once, the buckets whose members are all very near to their first; one by one, the others
        plain = (np.minimum.reduceat(near, starts) >= CORE) & ~given[starts]
        take = np.repeat(plain, sizes) & (first != np.arange(len(nodes)))
        found = [np.stack((nodes[first[take]], nodes[take]))]
        for s, n in zip(starts[~plain], sizes[~plain]):
            found.append(_lead(nodes[s:s + n], packed[s:s + n], int(given[s:s + n].sum()), join))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _hot_bands(banded: DataFrame, classes: int, bands: int) -> DataFrame | None:
    """band and parts (how many tasks share it) of the bands with more than HOT classes; none if there can't be any.

    Bands are counted in bins first, whose counts are summed before they are shuffled; only the bands of bins that hold
    more than HOT are counted one by one. At most classes * bands / HOT bands are hot.
    """
    if classes <= HOT:
        return None
    bins = 1 << min(20, max(12, (classes * bands // 256).bit_length()))
    binned = banded.select("band", F.pmod("band", F.lit(bins)).alias("bin"))
    crowded = binned.groupBy("bin").count().where(F.col("count") > HOT).select("bin").checkpoint()
    if crowded.isEmpty():
        return None
    hot = binned.join(F.broadcast(crowded), "bin", "left_semi").groupBy("band").count().where(F.col("count") > HOT)
    hot = hot.select("band", F.ceil(F.col("count") / HOT).cast("int").alias("parts")).checkpoint()
    return None if hot.isEmpty() else hot


def _cluster_edges(classes: DataFrame, at: Bars) -> DataFrame:
    """Edges (a, b) between nodes, whose connected components hold all links."""
    spark = classes.sparkSession
    tasks, count = int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count()
    banded = classes.select(F.explode("bands").alias("band"), "node", "packed")
    hot = _hot_bands(banded, count, at.bands)
    columns = ("band", "part", "given", "node", "packed")
    in_order = lambda rows: rows.select(*columns).repartition(tasks, "band", "part").sortWithinPartitions("band", "part", F.desc("given"), "node")
    if hot is None:
        dealt = banded.withColumn("part", F.lit(0)).withColumn("given", F.lit(False))
    else:
        hot = hinted(hot, hot.count())
        parted = banded.join(hot, "band", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")).withColumn("given", F.lit(False))
        leaders = in_order(parted.where("parts IS NOT NULL")).mapInArrow(_leaders, "band long, node long, packed binary")
        everywhere = leaders.join(hot, "band").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("given", F.lit(True))
        dealt = parted.select(*columns).unionByName(everywhere.select(*columns))
    return in_order(dealt).mapInArrow(lambda batches: _bucket_edges(batches, at.join), "a long, b long").where("a <> b")


# ---- links -----------------------------------------------------------------------------------------------------


class _Sets:
    """Shingle sets of a block, and which of them have a shingle."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.sizes)
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.codes = codes.astype(np.int32)
        self.owners = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[np.argsort(codes, kind="stable")]
        self.counts = np.bincount(codes)
        self.until = np.cumsum(self.counts)

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many members of set i each of the others has."""
        own = self.codes[self.ends[i] - self.sizes[i]:self.ends[i]]
        counts = self.counts[own]
        if counts.sum() <= 8 * self.sizes[others].sum():
            at = np.repeat(self.until[own] - np.cumsum(counts), counts) + np.arange(counts.sum())
            return np.bincount(self.owners[at], minlength=len(self.sets))[others]
        return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in others], dtype=np.int64)


def _links(nodes: list[int], sides: list[int], labels: list[int], sets: list[np.ndarray], percent: int, exact: bool = False) -> list[tuple[int, int]]:
    """(member, least linked) of one block, or of two: then only links across them count.

    Members of one label are connected already. With ``exact``, no pair is ruled out by an estimate.
    """
    order = np.argsort(nodes, kind="stable")
    nodes, sides, labels = (np.array(x)[order] for x in (nodes, sides, labels))
    first_of, group = np.unique(labels, return_index=True, return_inverse=True)[1:]
    group = first_of[group]
    if not (group != group[0]).any():
        return []
    sets = [sets[i] for i in order]
    packed, block, least_estimate = pack(shingles.minima(sets, FACTORS, SHIFTS)), _Sets(sets), bars(percent).least_estimate
    sizes, across = block.sizes, len(np.unique(sides)) > 1
    found = []
    for i in range(len(nodes) - 1):
        rest = np.arange(i + 1, len(nodes))
        able = (group[rest] != group[i]) & (100 * np.minimum(sizes[i], sizes[rest]) >= percent * np.maximum(sizes[i], sizes[rest]))
        if across:
            able &= sides[rest] != sides[i]
        rest = rest[able]
        if sizes[i] >= FEW and not exact:
            rest = rest[estimate(packed[i], packed[rest]) >= least_estimate]
        if not len(rest):
            continue
        both = block.shared(i, rest)
        for j in rest[100 * both >= percent * (sizes[i] + sizes[rest] - both)]:
            if group[j] != group[i]:
                found.append((int(nodes[j]), int(nodes[i])))
                a, b = sorted((group[i], group[j]))
                group[group == b] = a
    return found


def _sets_of(rows: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """``placed``'s columns (at most ``n`` rows) with the sorted shingle hashes of each node (binary), from the rows (id, text_hash, text) they stand for."""
    names = [c for c in placed.columns if c not in ("id", "text_hash")]
    kinds = dict(placed.dtypes)
    joined = rows.join(hinted(placed, n), ["id", "text_hash"]).select(*names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            sets = shingles.shingle_sets([t or "" for t in batch.column(len(names)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "hashes"])

    return joined.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", hashes binary")


def _compared(sets: DataFrame, partners: object, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) of blocks (component, block, label, node, hashes) with their ``partners`` (a column of block numbers)."""
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.withColumn("partner", F.explode(partners)).select(
        "component", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("two"), F.col("block").alias("side"), "label", "node", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def told() -> pa.RecordBatch:
            sides, labels, sets = zip(*held.values())
            got = _links(list(held), list(sides), list(labels), [np.frombuffer(s, dtype=np.uint64) for s in sets], percent, exact) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

        for batch in cut(batches):
            for *now, side, label, node, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if key is not None:
                        yield told()
                    key, held = now, {}
                held[node] = side, label, hashes  # a row that is there twice is one node
        if key is not None:
            yield told()

    return dealt.repartition(tasks, "component", "one", "two").sortWithinPartitions("component", "one", "two").mapInArrow(run, "a long, b long")


def _in_blocks(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """``rows`` (at most ``n``, with n_shingles) with ``blocks`` and ``block``: as many blocks for each ``by`` as its shingles ask for."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.sum(F.col("n_shingles") + 8) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    return rows.join(hinted(sizes, n), by).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _cluster_links(rows: DataFrame, classes: DataFrame, clusters: DataFrame, n: int, percent: int, exact: bool) -> DataFrame:
    """Confirmed links (a, b) inside ``clusters`` (``n`` nodes), a few for each member."""
    members = classes.select("node", "id", "text_hash", "n_shingles").join(hinted(clusters, n), "node")
    placed = _in_blocks(members, ["component"], n).withColumn("label", F.col("node")).checkpoint()
    links = _compared(_sets_of(rows, placed, n), F.array("block"), percent, exact).checkpoint()
    large = placed.where("blocks > 1").drop("blocks", "block", "label")
    return links if large.isEmpty() else _links_across(rows, large, links, n, percent, exact)


def _links_across(rows: DataFrame, large: DataFrame, links: DataFrame, n: int, percent: int, exact: bool) -> DataFrame:
    """``links`` inside blocks, and those across the blocks of one cluster."""

    def labelled() -> DataFrame:
        known, count = connected_components(links)
        return settled(large.join(hinted(known.withColumnRenamed("component", "label"), count), "node", "left").withColumn("label", F.coalesce("label", "node")))[0]

    # one class of each component so far
    heads = settled(_in_blocks(labelled().where("node = label"), ["component"], n))[0]
    links = links.unionByName(_compared(_sets_of(rows, heads, n), F.sequence(F.lit(0), F.col("blocks") - 1), percent, exact)).checkpoint()
    now = labelled()
    sizes = now.groupBy("component", "label").agg(F.sum("n_shingles").alias("n"))
    main, clusters = settled(sizes.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("component", "main"))
    if not clusters:
        return links
    split = now.join(hinted(main, clusters), "component").withColumn("of_main", F.col("label") == F.col("main")).drop("main")
    parts = settled(_in_blocks(split, ["component", "of_main"], n))[0]
    most = lambda which: F.coalesce(F.max(F.when(which, F.col("blocks"))), F.lit(0))
    counts = parts.groupBy("component").agg(most(~F.col("of_main")).alias("others"), most(F.col("of_main")).alias("mains"))
    # blocks of the main component come after the others', and meet those only
    met = parts.join(hinted(counts, clusters), "component").withColumn("block", F.when(F.col("of_main"), F.col("block") + F.col("others")).otherwise(F.col("block")))
    met = settled(met.drop("blocks", "of_main", "n_shingles"))[0]
    partners = F.sequence(F.lit(0), F.when(F.col("block") >= F.col("others"), F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    return links.unionByName(_compared(_sets_of(rows, met, n), partners, percent, exact)).checkpoint()


# ---- documents -------------------------------------------------------------------------------------------------


def _labelled(docs: DataFrame, percent: int, id_col: str, text_col: str, exact: bool) -> DataFrame:
    """id, text_hash, n_shingles, component (its number; null for what is linked with nothing) and component_id of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    at = bars(percent)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    described = map_rows(rows, lambda batch: _describe(batch, at), "id long,text_hash long,n_shingles long,digest binary,bands array<long>,packed binary").checkpoint()
    able = described.where("id IS NOT NULL AND digest IS NOT NULL")
    # a class is one node, and one row of it stands for its text; nodes are numbered as they are written
    classes = able.groupBy("digest").agg(F.min(F.struct("id", "text_hash")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "digest", "row.id", "row.text_hash", "n_shingles", "bands", "packed").checkpoint()
    components, count = connected_components(_cluster_links(rows, classes, *connected_components(_cluster_edges(classes, at)), percent, exact))

    named = classes.select("node", "id").join(hinted(components, count), "node").groupBy("component").agg(F.min("id").alias("component_id")).checkpoint()
    of_node = components.join(hinted(named, count), "component")
    of_class = classes.select("digest", "node", "id").join(hinted(of_node, count), "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "id").alias("component_id"))
    known = described.select("id", "text_hash", "n_shingles", "digest").join(of_class, "digest", "left")
    return known.select("id", "text_hash", "n_shingles", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id and kept (it has its component's least id).

    Null or empty text: no shingles, linked with nothing. Null id: linked with nothing, component null, kept. Rows that
    repeat an id: each by its own text, so they may be of different components and have different verdicts; rows that
    repeat id and text are equal. Ties do not arise, as a component goes by its least id. Empty table: no rows. Other
    columns are not read. Texts of any length are worked through whole. With ``exact``, every pair of a cluster is
    compared in full, whatever its estimate.
    """
    told = _labelled(docs, percent, id_col, text_col, exact)
    return told.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component does, with all their columns.

    That is the row with the component's least id; of several such rows, the one whose text has the least hash, and of
    rows with the same id and text, the one whose other columns have. Rows without id or without words all stay.
    """
    told = _labelled(docs, percent, id_col, text_col, False).checkpoint()
    heads = told.where("id = component_id AND n_shingles > 0")
    again = heads.groupBy("id", "component").agg(F.count("*").alias("rows"), F.min("text_hash").alias("least")).where("rows > 1").checkpoint()
    gone = told.where("id <> component_id").select("id", "text_hash")
    repeated, n = None, again.count()
    if n:
        more = heads.join(hinted(again, n), ["id", "component"])
        gone = gone.unionByName(more.where("text_hash <> least").select("id", "text_hash"))
        repeated = more.where("text_hash = least").groupBy("id", "text_hash").count().where("count > 1").select("id", "text_hash").checkpoint()
    gone = gone.distinct().checkpoint()
    keys = lambda df: df.select(F.col("id").alias("__id"), F.col("text_hash").alias("__text_hash"))
    same = (docs[id_col].cast("bigint") == F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__text_hash"))
    kept = docs.join(hinted(keys(gone), gone.count()), same, "left_anti")
    if repeated is None or repeated.isEmpty():
        return kept
    once = hinted(keys(repeated), repeated.count())
    some = kept.join(once, same).groupBy("__id", "__text_hash").agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.xxhash64(*[docs[c] for c in docs.columns])).alias("row")).select("row.*")
    return kept.join(once, same, "left_anti").unionByName(some)
