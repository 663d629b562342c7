"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct word shingles. Documents are linked when
the Jaccard similarity of their sets reaches the threshold; groups are the
connected components. Equal sets are folded first, so everything after works
on one row per distinct set.

Forest: every tree orders the sets by its own sequence of minhash values.
Sets that agree on the first value form a region; a region that is too large
goes one value deeper, and so on (adaptive depth). At similarity 0.8 two sets
share a region of depth 1 in a tree with probability 0.8, of depth 3 with
0.51: all 16 trees miss a pair with probability 7e-12 to 1e-5.

   Sets whose sketch and size agree with no other of the region leave it.
1. Neighbours: in each region every set is paired with the next one in
   signature order (longest common prefix). Pairs pass a size test and a
   sketch test, then full sets decide. Confirmed links give first components.
2. Rest: sets of one region that the neighbours left in different components
   are compared as well. Small regions do it pair by pair. In large ones
   (many near copies) only the sets outside the region's largest component
   are compared, with all others, in tiles whose full sets meet in one task.
   No cap is set on partners, and copies are never expanded into all pairs.

Every link is confirmed on full sets of 64-bit shingle hashes.

Defined results: texts without a word (NULL, empty, white space) have an
empty set, are linked with nothing and stay. ``component_id`` is the smallest
doc_id reachable, NULL ids aside (NULL if there is no other). ``kept`` marks
rows whose id is the component's, so a repeated row is kept as often as it
occurs; ``keep_one`` keeps exactly one row of each component. Extra columns
pass through ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, only_ids
from .components import components
from .words import hashes_by_text, mix


@dataclass(frozen=True)
class Params:
    words: int = 4            # words of a shingle
    percent: int = 80         # least similarity, in hundredths
    trees: int = 16
    depth: int = 3            # minhash values of a tree
    region: int = 64          # sets above which a region goes deeper
    tile: int = 256           # sets of a tile of a large region
    seed: int = 1

    @property
    def values(self) -> int:
        return self.trees * self.depth

    @property
    def sketch_least(self) -> int:
        """Equal 4-bit values a pair needs: six deviations below the mean at
        the least similarity, so a pair is missed with probability 1e-8."""
        q = self.percent / 100 + (1 - self.percent / 100) / 16
        return int(self.values * q - 6 * (self.values * q * (1 - q)) ** 0.5)


# --- sets and signatures ------------------------------------------------------

class Shingler:
    """Word shingles of a text as sorted distinct 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        raws = [(t or "").encode().lower() for t in texts]  # bytes: A-Z only
        hashes, counts = hashes_by_text(raws)
        ends = np.cumsum(counts)
        return [self._shingles(hashes[hi - n:hi]) for hi, n in zip(ends.tolist(), counts.tolist())]

    def _shingles(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        n = max(1, len(h) - self.words + 1)
        out = h[:n].copy()
        for k in range(1, min(self.words, len(h))):
            out = mix(out) + h[k:k + n]
        return np.unique(mix(out))


def minhash(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """len(sets) x values minhash values (32 bits), of non-empty sets."""
    draw = np.random.default_rng(p.seed)
    a = draw.integers(1, 1 << 63, p.values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 1 << 63, p.values, dtype=np.uint64)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), p.values), np.uint32)
    buffer = np.empty_like(flat)
    for i in range(p.values):
        np.multiply(flat, a[i], out=buffer)
        np.add(buffer, b[i], out=buffer)
        out[:, i] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
    return out


def sketch(signatures: np.ndarray) -> np.ndarray:
    """Low 4 bits of every value, two to a byte."""
    low = (signatures & 15).astype(np.uint8)
    if low.shape[1] % 2:
        low = np.pad(low, ((0, 0), (0, 1)))
    return low[:, ::2] << 4 | low[:, 1::2]


_ZERO_NIBBLES = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)


def agreeing(one: np.ndarray, many: np.ndarray, values: int) -> np.ndarray:
    """Equal sketch values of ``one`` and each row of ``many``."""
    return _ZERO_NIBBLES[one ^ many].sum(axis=-1) - values % 2


def linked(common, n, m, percent: int):
    """100 * |A & B| >= percent * |A | B|."""
    return 100 * common >= percent * (n + m - common)


def _signed(docs: DataFrame, p: Params) -> DataFrame:
    """The input with its set's key and size, and the signature."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       F.monotonically_increasing_id().alias("uid"))
    spec = held.select(F.col("_doc"), "uid", F.col("_doc.text").alias("text")).schema

    def run(batches):
        shingles = Shingler(p.words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingles.many(part.column(2).to_pylist())
                some = [i for i, s in enumerate(sets) if len(s)]
                signatures = [None] * len(sets)
                if some:
                    for i, s in zip(some, minhash([sets[i] for i in some], p)):
                        signatures[i] = s.astype("<u4").tobytes()
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(signatures, pa.binary())],
                    names=["_doc", "uid", "set_key", "n", "signature"])

    kind = spec["_doc"].dataType.simpleString()
    return cut(held.select("_doc", "uid", F.col("_doc.text").alias("text")).mapInArrow(
        run, f"_doc {kind}, uid long, set_key binary, n long, signature binary"), "near-signed")


# --- the forest ---------------------------------------------------------------

TREE_ROW = "at long, rest binary, node long, n long, sketch binary"
REGION_ROW = "region long, node long, n long, sketch binary, next long"


def _tree_rows(reps: DataFrame, p: Params) -> DataFrame:
    """A row per tree and set: first value (with the tree), further values."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u4").reshape(-1, p.values)
                sketches = pa.array([s.tobytes() for s in sketch(sig)], pa.binary())
                for t in range(p.trees):
                    own = sig[:, t * p.depth:(t + 1) * p.depth]
                    rest = pa.array([r.tobytes() for r in own[:, 1:].astype(">u4")], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_first_value(t, own)), rest, part.column(0), part.column(1), sketches],
                        names=["at", "rest", "node", "n", "sketch"])

    return reps.select("node", "n", "signature").mapInArrow(run, TREE_ROW)


def _first_value(tree: int, own: np.ndarray) -> np.ndarray:
    return np.int64(tree) << np.int64(32) | own[:, 0].astype(np.int64)


def _first_counts(reps: DataFrame, p: Params) -> DataFrame:
    """(at, count): how many sets share a tree's first value."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(-1, p.values)
            at = [_first_value(t, sig[:, t * p.depth:t * p.depth + 1]) for t in range(p.trees)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at))], names=["at"])

    return reps.select("signature").mapInArrow(run, "at long").groupBy("at").count()


def _regions(rows: DataFrame, p: Params) -> DataFrame:
    """Regions of two sets or more among rows whose first value is not hot.

    Rows come sorted by all values, so a group is a run; it is split by one
    more value as long as it is too large, and its next neighbours are tested.
    """

    def split(group, used):
        """Runs of ``group`` by the value after ``used`` bytes, deeper if large."""
        if len(group) < 2:
            return
        if len(group) <= p.region or used >= 4 * (p.depth - 1):
            yield group, used
            return
        lo = 0
        for i in range(1, len(group) + 1):
            if i == len(group) or group[i][1][used:used + 4] != group[lo][1][used:used + 4]:
                yield from split(group[lo:i], used + 4)
                lo = i

    def emit(group, out):
        for run_, used in split(group, 0):
            region = _region_id(run_[0], used)
            run_ = _with_partner(run_, p) if len(run_) <= p.region else run_
            for i, r in enumerate(run_):
                out.append((region, r[2], r[3], r[4], _next(r, run_[i + 1], p) if i + 1 < len(run_) else None))

    def run(batches):
        group, out = [], []
        for row in _rows(batches):
            if group and row[0] != group[0][0]:
                emit(group, out)
                group = []
                if len(out) >= 8192:
                    yield _region_batch(out)
            group.append(row)
        emit(group, out)
        if out:
            yield _region_batch(out)

    return rows.repartition(F.col("at")).sortWithinPartitions("at", "rest", "node").mapInArrow(run, REGION_ROW)


def _deep_regions(rows: DataFrame, p: Params) -> DataFrame:
    """Regions of full depth, however large: rows are range-partitioned by
    signature order and node, so one region may spread over many tasks."""

    def run(batches):
        last, out = None, []
        for row in _rows(batches):
            if last is not None:
                same = row[0] == last[0] and row[1] == last[1]
                out.append((_region_id(last, len(last[1])), *last[2:], _next(last, row, p) if same else None))
                if len(out) >= 8192:
                    yield _region_batch(out)
            last = row
        if last is not None:
            out.append((_region_id(last, len(last[1])), *last[2:], None))
            yield _region_batch(out)

    return (rows.repartitionByRange("at", "rest", "node").sortWithinPartitions("at", "rest", "node")
            .mapInArrow(run, REGION_ROW))


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _region_id(row, used: int) -> int:
    return xxhash.xxh3_64_intdigest(row[0].to_bytes(8, "big") + row[1][:used]) >> 1


def _with_partner(rows, p: Params):
    """The rows whose sketch and size agree with some other row."""
    sketches = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
    sizes = np.array([r[3] for r in rows])
    near = agreeing(sketches[:, None], sketches, p.values) >= p.sketch_least
    near &= 100 * np.minimum(sizes[:, None], sizes) >= p.percent * np.maximum(sizes[:, None], sizes)
    np.fill_diagonal(near, False)
    return [rows[i] for i in np.flatnonzero(near.any(axis=1))]


def _next(one, other, p: Params):
    """The neighbour's node, if the pair can be similar enough."""
    near = agreeing(np.frombuffer(one[4], np.uint8), np.frombuffer(other[4], np.uint8), p.values)
    return other[2] if near >= p.sketch_least and _sizes_fit(one[3], other[3], p.percent) else None


def _region_batch(out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                       names=["region", "node", "n", "sketch", "next"])
    out.clear()
    return batch


def _sizes_fit(n, m, percent: int):
    return 100 * min(n, m) >= percent * max(n, m)


def forest(reps: DataFrame, n_reps: int, p: Params) -> DataFrame:
    """(region, node, n, sketch, next): every tree's regions of two or more.

    First values that over 1/1000 of the sets share are hot: fewer than 1000
    a tree. They go to the full depth at once, and no task has to hold them.
    """
    rows = _tree_rows(reps, p)
    large = max(p.region, n_reps // 1000)
    hot = cut(_first_counts(reps, p).where(F.col("count") > large).select("at"), "near-hot")
    mark = F.broadcast(hot)  # fewer than trees * 1000 rows
    cold = _regions(rows.join(mark, "at", "left_anti").select(*rows.columns), p)
    deep = _deep_regions(rows.join(mark, "at", "left_semi").select(*rows.columns), p)
    return cut(cold.unionByName(deep), "near-regions")


# --- confirmation on full sets --------------------------------------------------

def _texts(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed text) of the sets that take part in a comparison."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                packed = [packer.compress(t.encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())],
                                                 names=["node", "text"])

    nodes = cut(nodes.distinct(), "near-need")
    rows = only_ids(signed.select(F.col("uid").alias("node"), F.col("_doc.text").alias("text")), nodes, "node")
    return cut(rows.select("node", "text").mapInArrow(run, "node long, text binary"), "near-texts")


class _Sets:
    """Sets of the texts last seen, by node."""

    def __init__(self, words: int, size: int = 512):
        self.shingles, self.size = Shingler(words), size
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()

    def get(self, node: int, packed: bytes) -> np.ndarray:
        if node in self.held:
            self.held.move_to_end(node)
            return self.held[node]
        found = self.held[node] = self.shingles(self.unpack(packed).decode())
        if len(self.held) > self.size:
            self.held.popitem(last=False)
        return found


def _confirmed(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""

    def run(batches):
        sets = _Sets(p.words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                a, b, ta, tb = (c.to_pylist() for c in batch.slice(lo, 256).columns)
                ok = []
                for i in range(len(a)):
                    x, y = sets.get(a[i], ta[i]), sets.get(b[i], tb[i])
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if linked(common, len(x), len(y), p.percent):
                        ok.append(i)
                yield _links_batch([(a[i], b[i]) for i in ok])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _rest(placed: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """What regions with several components still have to compare: pairs
    (a, b) of small regions, and the tile rows of large ones (role 0: a set of
    the tile; role 1: a set outside the largest component, for every tile)."""
    by_comp = placed.groupBy("region", "comp").count()
    about = cut(by_comp.groupBy("region").agg(
        F.sum("count").alias("sets"), F.max_by("comp", F.struct("count", "comp")).alias("largest"),
        F.count("*").alias("comps")).where("comps > 1"), "near-about")
    total = about.agg(F.coalesce(F.sum("sets"), F.lit(0))).first()[0]
    open_ = join_hot(placed, about, "region", "sets", total).where("comps > 1")
    small = (open_.where(F.col("sets") <= p.region).select("region", "node", "n", "sketch", "comp")
             .repartition(F.col("region")).sortWithinPartitions("region", "node"))

    def pairs_of(group):
        sketches = np.frombuffer(b"".join(r[3] for r in group), np.uint8).reshape(len(group), -1)
        for i in range(len(group) - 1):
            near = agreeing(sketches[i], sketches[i + 1:], p.values) >= p.sketch_least
            for j in np.flatnonzero(near) + i + 1:
                if group[i][4] != group[j][4] and _sizes_fit(group[i][2], group[j][2], p.percent):
                    yield group[i][1], group[j][1]

    def run(batches):
        group, out = [], []
        for row in _rows(batches):
            if group and group[0][0] != row[0]:
                out += pairs_of(group)
                group = []
                if len(out) >= 8192:
                    yield _links_batch(out)
                    out = []
            group.append(row)
        if group:
            out += pairs_of(group)
        if out:
            yield _links_batch(out)

    tiles = F.ceil(F.col("sets") / p.tile).cast("int")
    large = open_.where(F.col("sets") > p.region).withColumn("tiles", tiles)
    members = large.select("region", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"),
                           F.lit(0).alias("role"), "comp", "node")
    others = large.where("comp <> largest").select(
        "region", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("role"),
        "comp", "node")
    return small.mapInArrow(run, "a long, b long").distinct(), members.unionByName(others)


def _links_batch(pairs):
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)],
                                      names=["a", "b"])


def _tile_links(rows: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Links between the sets of a tile and those compared with it: for each
    compared set, one confirmed link to each component it reaches."""

    def run(batches):
        sets = _Sets(p.words)
        key, members, local = None, [], None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for region, tile, role, comp, node, text in zip(
                        *(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    if (region, tile) != key:
                        key, members, local = (region, tile), [], None
                    own = sets.get(node, text)
                    if role == 0:
                        members.append((node, comp, own))
                        continue
                    if members:  # a tile, dealt by hash, may be empty
                        local = local or _Tile(members)
                        out += local.links(node, comp, own, p.percent)
                yield _links_batch(out)

    full = rows.join(texts, "node").select("region", "tile", "role", "comp", "node", "text")
    return (full.repartition("region", "tile").sortWithinPartitions("region", "tile", "role", "node")
            .mapInArrow(run, "a long, b long"))


class _Tile:
    """The sets of a tile, side by side."""

    def __init__(self, members):
        self.nodes = [m[0] for m in members]
        self.comps = np.array([m[1] for m in members])
        self.sizes = np.array([len(m[2]) for m in members])
        self.universe, self.flat = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True)
        self.starts = np.cumsum([0, *self.sizes[:-1]])

    def links(self, node, comp, own, percent):
        at = np.searchsorted(self.universe, own)
        at[at == len(self.universe)] = 0
        mark = np.zeros(len(self.universe), np.int32)
        mark[at[self.universe[at] == own]] = 1
        common = np.add.reduceat(mark[self.flat], self.starts)
        hits = np.flatnonzero(linked(common, len(own), self.sizes, percent) & (self.comps != comp))
        _, first = np.unique(self.comps[hits], return_index=True)
        return [(node, self.nodes[i]) for i in hits[first]]


# --- the operator ---------------------------------------------------------------

def _grouped(docs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, (set_key, node, rows), (node, root) of linked sets)."""
    signed = _signed(docs, p)
    some = signed.where(F.col("n") > 0)
    folded = cut(some.groupBy("set_key").agg(
        F.first("n").alias("n"), F.first("signature").alias("signature"), F.count("*").alias("rows"),
        F.min("_doc.doc_id").alias("low_id"), F.min("uid").alias("uid")), "near-sets")
    reps = folded.withColumnRenamed("uid", "node")  # the first row of a set names it
    n_reps = reps.count()
    regions = forest(reps, n_reps, p)
    texts = _texts(signed, regions.select("node"))

    first_pairs = cut(regions.where(F.col("next").isNotNull()).select(
        F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b")).distinct(), "near-pairs")
    first = cut(_confirmed(first_pairs, texts, p), "near-links")
    comps = components(first)

    placed = regions.drop("next").join(comps, "node", "left").withColumn(
        "comp", F.coalesce("root", "node")).drop("root")
    pairs, tiles = _rest(cut(placed, "near-placed"), p)
    pairs = pairs.join(first_pairs, ["a", "b"], "left_anti")  # those have been compared
    more = cut(_confirmed(pairs, texts, p).unionByName(_tile_links(tiles, texts, p)), "near-links")
    links = comps.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return signed, reps, components(links.unionByName(more))


def _labelled(docs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, int]:
    """(signed rows, table by set_key with component_id, keep_uid and rows, total)."""
    signed, reps, groups = _grouped(docs, p)
    tagged = reps.select("set_key", "node", "rows", "low_id").join(groups, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    tagged = cut(tagged, "near-tagged")
    # The row that stays: smallest id (NULL last), then the first such row.
    best = F.min(F.struct(F.col("low_id").isNull(), F.col("low_id"), F.col("node")))
    n_roots = tagged.groupBy("root").agg(F.min("low_id").alias("component_id"), best.alias("_best"),
                                         F.sum("rows").alias("group_rows"), F.count("*").alias("sets"))
    by_root = cut(n_roots.select("root", "component_id", F.col("_best.node").alias("keep_node"), "sets"),
                  "near-roots")
    by_set = cut(join_hot(tagged, by_root, "root", "sets", tagged.count()).select(
        "set_key", "component_id", F.col("keep_node"), F.col("node").alias("set_node"), "rows"), "near-labels")
    total = by_set.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return signed, by_set, total


def near_dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    signed, by_set, total = _labelled(docs, p)
    rows = signed.select(F.col("_doc.doc_id").cast("long").alias("doc_id"), "set_key", "n")
    some = join_hot(rows.where("n > 0"), by_set, "set_key", "rows", total)
    none = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id",
               F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    return some.select(*columns).unionByName(none.select(*columns))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The input without near copies: exactly one row of each component."""
    signed, by_set, total = _labelled(docs, p)
    # Of the set that stays, the row with the component's id that comes first.
    first = signed.where("n > 0").groupBy("set_key").agg(
        F.min_by("uid", F.struct(F.col("_doc.doc_id").isNull(), F.col("_doc.doc_id"), F.col("uid"))).alias("keep_uid"))
    stays = by_set.where(F.col("keep_node") == F.col("set_node")).join(first, "set_key").select(
        F.col("keep_uid").alias("uid"))
    kept = only_ids(signed.where("n > 0"), cut(stays, "near-stay"), "uid")
    return kept.unionByName(signed.where("n = 0").select(*kept.columns)).select("_doc.*")
