"""Size-aware heavy-light join of word-shingle sets by Jaccard similarity, and its connected components.

Sets linked at similarity t (a fraction p / q) share o >= t / (1 + t) (|a| + |b|) shingles, so at most
d = (1 - t) / (1 + t) (|a| + |b|) differ, and their sizes differ by a factor 1 / t at most.

* Small (light) sets list, for each size a partner may have, the digests of all their subsets of that fixed overlap:
  linked sets have such a subset in common.
* Large (heavy) sets scan inverted lists. Single shingles make bad list keys: a passage found in many documents puts
  all of them on its lists. A list key is instead the digest of all of a set's shingles in one of M ranges of the
  hash space. At most d ranges differ, so a set of which more than d ranges aren't empty agrees with each linked set
  in one of those, and lists only those; the rare others list their empty ranges too, so no link is lost. Sizes form
  levels with a common M; a set that can be linked to one of the level below is listed in both.
* The boundary is the largest size up to which listing subsets costs no more than ranges and their chance meetings.

Lists are then pruned, so that a passage that many documents share makes no list of all of them. Linked sets of one
level agree in all but d of their ranges, so each needs to be found only on the d + 1 shortest of its lists (ties in
the order of keys: both sets go by one order, and the first key they share is among those of both). Keys that no other
set lists are the shortest lists: a set with more than d of them is linked with none and leaves all lists. Subsets, and
ranges of sets that list their empty ranges too, are not pruned.

Copies share a digest of the whole set and are one node from the start. On every list the smallest node is the
centre; each other node is compared with it (a linear number of pairs), and links form components. Lists on which more
than REFINED pairs a node of different components are left then are those of a passage that unlinked documents share; their
nodes are listed anew by single shingles, again only the rarest that linked sets can't all differ in. Where more pairs
than a few for each node are left on all lists, further rounds name other centres: first nodes that are on most lists
(edits take a copy off some of its original's), then others by chance. All pairs of different components that are left
on a list then are compared as well, so that components are exact.
Before texts are read again to compare a pair, its sizes and a folded form of its sets (a bound on how many shingles
differ) must allow a link; for unrelated documents that share a passage they don't.

Sets without shingles (null, empty or blank texts) are linked with nothing. Rows with repeated ids are kept each.
Equal sets are known by 64-bit digests, as shingles are by 64-bit hashes: distinct sets of a corpus of 10^9 documents
meet with a probability under 0.03. An empty table gives no rows. Of other columns, whatever their names, only
without_near_copies makes use: it keeps them. Long texts are sets like others, a batch of texts at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, utf8, written
from .components import components
from .words import mix, shingles

#: Ids that a node's text is fetched for by a broadcast table at most; above, by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Bits of a set's folded form at least.
BITS = 1024
#: Further rounds of stars at most.
STARS = 6
#: Pairs of different components for each node of a list that are compared as they are; a list with more is made anew by
#: single shingles.
REFINED = 4
#: Shingles of a bucket, about, where there are more than 4 buckets for each partition of a shuffle.
BUCKET = 1 << 21
#: Digests of sets whose keys a task has written already and need not write again, at most.
REMEMBERED = 1 << 20


@dataclass(frozen=True)
class Level:
    """Sizes low to high, and up to reach for partners above, with a common number of ranges."""

    number: int
    low: int
    high: int
    reach: int
    ranges: int


class Plan:
    """Which keys a set of a size lists, for similarity p / q."""

    def __init__(self, p: int, q: int, ratio: float = 1.4, largest: int = 1 << 33):
        self.p, self.q = p, q
        self.boundary = next(n for n in range(1, 200) if self._subset_cost(n + 1) > self._range_cost(n + 1))
        self.levels: list[Level] = []
        low = self.boundary + 1
        while low < largest:
            high = max(low, int(low * ratio))
            reach = high * q // p
            ranges = 1
            while ranges < 2 * low and any(not self._enough(n, ranges) for n in (low, high)):
                ranges += max(1, ranges // 64)
            self.levels.append(Level(len(self.levels), low, high, reach, ranges))
            low = high + 1
        self._lows = np.array([x.low for x in self.levels], np.int64)

    def overlap(self, a: int, b: int) -> int:
        return -(-self.p * (a + b) // (self.p + self.q))

    def differing(self, a: int, b: int) -> int:
        return (self.q - self.p) * (a + b) // (self.q + self.p)

    def _enough(self, n: int, ranges: int) -> bool:
        """Nearly all sets of n have more ranges that aren't empty than may differ."""
        each = n / ranges
        empty = exp(-each)
        spread = (ranges * max(0.0, empty - (1 + each) * empty**2)) ** 0.5
        return ranges * (1 - empty) - 4 * spread > self.differing(n, n * self.q // self.p)

    def partners(self, n: int) -> range:
        return range(-(-n * self.p // self.q), n * self.q // self.p + 1)

    def subsets(self, n: int) -> list[int]:
        """Sizes of the subsets that a set of n lists: with partners of which one at least is small."""
        return sorted({self.overlap(n, b) for b in self.partners(n) if min(n, b) <= self.boundary} - {0})

    def _subset_cost(self, n: int) -> float:
        return sum(comb(n, c) for c in {self.overlap(n, b) for b in self.partners(n)} if 0 < c <= n)

    def _range_cost(self, n: int) -> float:
        """Keys, and meetings by chance: a range holds n / m shingles, each shared by chance one time in two; a
        comparison costs as much as 64 keys."""
        m = self.differing(n, n * self.q // self.p) + 2
        return m * (1 + 64 * 0.5 ** (n / m))

    def listed(self, n: int) -> list[Level]:
        if n <= self.boundary:
            return []
        own = int(np.searchsorted(self._lows, n, "right")) - 1
        return [x for x in self.levels[max(0, own - 1) : own + 1] if n <= x.reach]


@lru_cache(maxsize=4)
def plan(p: int, q: int) -> Plan:
    return Plan(p, q)


def keys(hashes: np.ndarray, plan: Plan) -> tuple[np.ndarray, list[int]]:
    """The list keys of a set, its ascending hashes given: first those of its own level and of the one below that may be
    pruned, and how many these are, then all others."""
    n = len(hashes)
    scrambled = mix(hashes ^ np.uint64(0xD1B54A32D192ED03))
    pruned, whole = [], []
    if n * plan.p <= plan.boundary * plan.q:
        total = scrambled.sum(dtype=np.uint64)
        for c in plan.subsets(n):
            if c <= n:
                gone = np.array([scrambled[list(x)].sum(dtype=np.uint64) if x else np.uint64(0) for x in combinations(range(n), n - c)], np.uint64)
                whole.append(mix(mix(total - gone) + np.uint64(c)))
    if levels := plan.listed(n):
        summed = np.concatenate([[np.uint64(0)], np.cumsum(scrambled)])
        for x in levels[::-1]:
            part = ((hashes >> np.uint64(32)) * np.uint64(x.ranges)) >> np.uint64(32)
            at = np.searchsorted(part, np.arange(x.ranges + 1, dtype=np.uint64))
            full = at[1:] > at[:-1]
            digests = mix(mix(summed[at[1:]] - summed[at[:-1]]) + (np.uint64(x.number + 1) << np.uint64(40)) + np.arange(x.ranges, dtype=np.uint64))
            if full.sum() > plan.differing(n, n * plan.q // plan.p):
                pruned.append(digests[full])
            else:
                whole.append(digests)
    sizes = [len(x) for x in pruned]
    return np.concatenate([hashes[:0], *pruned, *whole]), sizes + [0] * (2 - len(sizes))


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bits, BITS or a power of two from the set's size on, each whether an odd number of the set's shingles fall on it.
    Two sets differ in as many shingles at least as their bits do; halves laid over each other are the bits for half."""
    bits = max(BITS, 1 << int(max(len(hashes) - 1, 1)).bit_length())
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(p: int, q: int) -> F.Column:
    """Whether sizes n_a, n_b and bits bits_a, bits_b allow a link."""
    words = BITS // 64
    short = sum((F.bit_count(F.get("bits_a", i).bitwiseXOR(F.get("bits_b", i))) for i in range(words)), F.lit(0))

    def halved(c: str, other: str) -> F.Column:
        half = (F.size(c) / 2).cast("int")
        folded = F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) == 2 * F.size(other), folded).otherwise(F.col(c))

    apart = F.zip_with(halved("bits_a", "bits_b"), halved("bits_b", "bits_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differing = F.when((F.size("bits_a") == words) & (F.size("bits_b") == words), short).otherwise(F.aggregate(apart, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))))
    return (q * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b")) & ((q + p) * differing <= (q - p) * (F.col("n_a") + F.col("n_b")))


def profiles(docs: DataFrame, id: str, text: str, k: int, p: int, q: int) -> DataFrame:
    """id, hash (of the text), row (a number), n (shingles), digest (of the set), bits, and keys, of which the first n0
    and the n1 after them may be pruned, of every row; keys only for the first row of a digest that a task meets."""

    def of(batches):
        own, seen = plan(p, q), set()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            body, offsets = utf8(batch.column(1))
            sizes, nodes, folded, listed, ends, prunable = [], [], [], [], [0], []
            first, row = row, row + batch.num_rows
            for h in shingles(body, offsets, k):
                digest = int(mix(mix(h).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))[0])
                fresh = digest not in seen and len(h) > 0
                if fresh:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    found, counts = keys(h, own)
                    listed.append(found)
                prunable.append(counts if fresh else [0, 0])
                sizes.append(len(h))
                folded.append(parity(h))
                nodes.append(digest)
                ends.append(ends[-1] + (len(listed[-1]) if fresh else 0))
            flat = np.concatenate(listed).view(np.int64) if listed else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.arange(first, row)), pa.array(sizes, pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, folded)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *folded]))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), *(pa.array([x[i] for x in prunable], pa.int32()) for i in (0, 1))], ["id", "hash", "row", "n", "digest", "bits", "keys", "n0", "n1"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(of, f"id {kind}, hash long, row long, n long, digest long, bits array<long>, keys array<long>, n0 int, n1 int")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """a, b, linked of the pairs (a, b), whose sets are made again from texts (node, text)."""

    def compare(batches):
        for batch in batches:
            first, second = (shingles(*utf8(batch.column(c)), k) for c in (2, 3))
            same = []
            for x, y in zip(first, second, strict=True):
                shared = len(x) + len(y) - len(np.union1d(x, y))
                same.append(q * shared >= p * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], ["a", "b", "linked"])

    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, linked boolean")


def _rows(docs: DataFrame, id: str, text: str, wanted: DataFrame) -> DataFrame:
    """node, text of the rows at wanted (node, id, hash); whole repeats of a row come each."""
    all_texts = docs.select(F.col(id).alias("id_"), F.col(text).alias("text"), F.xxhash64(text).alias("hash_"))
    found = all_texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, F.col("id_").eqNullSafe(F.col("id")) & (F.col("hash_") == F.col("hash")))
    return found.select("node", "text")


def _wanted(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, id, hash: where the text of each node wanted (node) is."""
    return written(wanted.distinct().join(nodes, "node").select("node", "n", "at.*"), "wanted")


def _texts(docs: DataFrame, id: str, text: str, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the nodes wanted (node), each read from one of its rows."""
    return _rows(docs, id, text, _wanted(wanted, nodes)).groupBy("node").agg(F.first("text").alias("text"))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of 64-bit numbers, all first bytes first: those that hardly change are packed by the shuffle."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplaned(data: bytes, width: int) -> np.ndarray:
    found = np.zeros((len(data) // width, 8), np.uint8)
    found[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return found.view("<u8").reshape(-1).astype(np.uint64)


def _meeting(texts: DataFrame, k: int, buckets: int) -> DataFrame:
    """key, node, size: the shingles that several nodes of texts (node, text; whole repeats count once) have, as numbers.

    Shingles go through one shuffle, a row for each bucket of a batch, in eight bytes or so with their node: 48 bits
    beside their bucket's number are the key. Two shingles of one key are one longer list, which loses nothing."""

    def single(batches):
        for batch in batches:
            sets = list(shingles(*utf8(batch.column(1)), k))
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(h) for h in sets])
            hashes = np.concatenate([np.zeros(0, np.uint64), *sets])
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((nodes, bucket))
            hashes, nodes, bucket = hashes[order] >> np.uint64(16), nodes[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
            ends = [*at[1:], len(bucket)]
            packed = [(_planes(hashes[x:y], 6), _planes(np.diff(nodes[x:y], prepend=0).view(np.uint64), 8)) for x, y in zip(at, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), pa.array([x for x, _ in packed], pa.binary()), pa.array([y for _, y in packed], pa.binary())], ["bucket", "keys", "nodes"])

    def shared(table_: pa.Table) -> pa.Table:
        keys_ = np.concatenate([_unplaned(x, 6) for x in table_.column("keys").to_pylist()])
        nodes = np.concatenate([np.cumsum(_unplaned(x, 8).view(np.int64)) for x in table_.column("nodes").to_pylist()])
        order = np.lexsort((nodes, keys_))
        keys_, nodes = keys_[order], nodes[order]
        fresh = np.concatenate([[True], (keys_[1:] != keys_[:-1]) | (nodes[1:] != nodes[:-1])])
        keys_, nodes = keys_[fresh], nodes[fresh]
        _, which, sizes = np.unique(keys_, return_inverse=True, return_counts=True)
        several = sizes[which] > 1
        named = mix(keys_[several] ^ mix(np.full(1, table_.column("bucket")[0].as_py(), np.uint64) + np.uint64(1)))
        return pa.table({"key": named.view(np.int64), "node": nodes[several], "size": sizes[which][several]})

    packed = texts.select("node", "text").mapInArrow(single, "bucket long, keys binary, nodes binary")
    return packed.groupBy("bucket").applyInArrow(shared, "key long, node long, size long")


def _refined(texts: DataFrame, nodes: DataFrame, k: int, p: int, q: int, buckets: int = 64) -> DataFrame:
    """key, node: the lists of single shingles on which linked sets among texts (node, text) meet: those of a set's
    rarest n - ceil(p n / q) + 1 shingles that other sets have, too."""
    every = written(_meeting(texts, k, buckets), "shingles")
    own = Window.partitionBy("node")
    shared = every.join(nodes.select("node", "n"), "node")
    # shingles that no other set has are rarest, and on no list
    left = F.expr(f"n - (n * {p} + {q - 1}) div {q} + 1") - (F.col("n") - F.count("*").over(own))
    ranked = shared.withColumn("left", left).withColumn("rank", F.row_number().over(own.orderBy("size", "key")))
    out = written(ranked.where(F.col("rank") <= F.col("left")).select("key", "node"), "refined")
    dropped(every)
    return out


def jaccard_components(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (shingles), component (its smallest id) for every row of docs; links are at similarity p / q or more.

    A row's id may be null or repeated: such rows are linked by their texts like all others, the component being the
    smallest id that is not null. Other columns of docs are not read."""
    marked = _labelled(docs, k, p, q, id, text)
    return marked.select("id", "n", F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component"))


def _compared(docs: DataFrame, id: str, text: str, candidates: DataFrame, nodes: DataFrame, k: int, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """The different candidates (a, b with a < b) whose sizes and bits allow a link, and the linked ones among them."""
    size_a, size_b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    pairs = written(candidates.distinct().join(size_a, "a").join(size_b, "b").where(_may_link(p, q)).select("a", "b"), "pairs")
    if pairs.isEmpty():
        return pairs, pairs
    return pairs, written(_linked(pairs, _texts(docs, id, text, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes), k, p, q).where("linked").select("a", "b"), "found")


def _named(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """lists (key, node) with each node's label."""
    return written(lists.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "named")


def without_near_copies(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (null is smallest), then the smallest text hash.

    Rows without shingles stay. Whole repeats of a row count as one row."""
    marked = _labelled(docs, k, p, q, id, text).where("n > 0")
    kept = written(marked.groupBy("label", "id", "hash").agg(F.count("*").alias("times")).groupBy("label").agg(F.min(F.struct("id", "hash", "times")).alias("row")).select("row.*"), "kept")
    rows, most = kept.agg(F.count("*"), F.max("times")).first()
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id).alias("id_"), F.xxhash64(text).alias("hash_"), (words == 0).alias("blank"))
    same = F.col("id_").eqNullSafe(F.col("id")) & (F.col("hash_") == F.col("hash"))
    found = whole.where("not blank").join(F.broadcast(kept) if rows <= BROADCAST_IDS else kept, same)
    once = found.where("times = 1")
    if (most or 0) > 1:
        once = once.unionByName(found.where("times > 1").dropDuplicates(["id_", "hash_"]))
    return once.select("row.*").unionByName(whole.where("blank").select("row.*"))


def _pruned(lists: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """key, node, n of the lists (key, node, level, size) on which nodes have to be found; see above. level: 0 own, 1 the one
    below, 2 not pruned."""
    known = lists.join(nodes.select("node", "n", "n0", "n1"), "node")
    differing = F.expr(f"({q - p} * (n + n * {q} div {p})) div {q + p}")
    own = Window.partitionBy("node", "level")
    alone = F.when(F.col("level") == 0, F.col("n0")).otherwise(F.col("n1")) - F.count("*").over(own)
    ranked = known.withColumn("left", differing + 1 - alone).withColumn("rank", F.row_number().over(own.orderBy("size", "key")))
    return ranked.where((F.col("level") == 2) | (F.col("rank") <= F.col("left"))).select("key", "node", "n")


def _labelled(docs: DataFrame, k: int, p: int, q: int, id: str, text: str) -> DataFrame:
    """id, hash, n, label (of the component), low (its smallest id that is not null) of every row."""
    profiled = written(profiles(docs, id, text, k, p, q), "profiles")
    rows = written(profiled.select("id", "hash", "n", "digest"), "rows")
    some = profiled.where("n > 0")
    # a node is the smallest row number of a digest; the first row of a digest in a task lists keys
    nodes = some.groupBy("digest").agg(F.min(F.struct("row", "n", "n0", "n1", "bits")).alias("first"), F.min(F.struct("id", "hash")).alias("at"), F.min("id").alias("low"))
    nodes = written(nodes.select("digest", "low", F.col("first.row").alias("node"), "first.n", "first.n0", "first.n1", "first.bits", "at"), "nodes")
    repeats = written(some.where(F.size("keys") > 0).select("row", "digest").join(nodes.select("digest", "node"), "digest").where("row <> node").select("row"), "repeats")
    keyed = some.where(F.size("keys") > 0).select("row", "n0", "n1", "keys").join(F.broadcast(repeats) if repeats.count() <= BROADCAST_IDS else repeats, "row", "left_anti")
    level = F.when(F.col("pos") < F.col("n0"), 0).when(F.col("pos") < F.col("n0") + F.col("n1"), 1).otherwise(2).cast("byte")
    # a window, as a count joined with its own rows is two shuffles: the count's has fewer columns
    listed = keyed.select(F.col("row").alias("node"), "n0", "n1", F.posexplode("keys").alias("pos", "key")).select("node", "key", level.alias("level"))
    one_list = Window.partitionBy("key")
    sized = listed.select("key", "node", "level", F.count("*").over(one_list).alias("size"), F.min("node").over(one_list).alias("low"), F.max("node").over(one_list).alias("high"))
    all_ = written(sized.where("low <> high").select("key", "node", "level", "size"), "lists")
    dropped(profiled, repeats)
    kept = written(_pruned(all_, nodes, p, q).distinct(), "pruned")
    dropped(all_)
    centres = kept.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.max("node").alias("most")).where("c.node <> most").select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("n_centre"))
    members = written(kept.join(centres, "key").where("node <> centre"), "members")
    dropped(kept)

    near = F.expr(f"{q} * least(n, n_centre) >= {p} * greatest(n, n_centre)")
    centred = members.where(near).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    pairs, links = _compared(docs, id, text, centred, nodes, k, p, q)
    labels = components(links)

    # all nodes of each list; from round to round only lists that still have nodes of different components
    lists = members.select("key", "node").union(members.select("key", "centre")).distinct()
    used: list[DataFrame] = []
    for turn in range(STARS + 1):
        lists = _named(lists, labels)
        used.append(lists)
        # first the node that is on most lists: edits take a copy off some of its original's. Then others by chance.
        if turn == 1:
            ranked = lists.join(lists.groupBy("node").agg((-F.count("*")).alias("rank")), "node")
        else:
            ranked = lists.withColumn("rank", F.xxhash64(F.lit(turn), "node"))
        each = ranked.groupBy("key", "label").agg(F.count("*").alias("n"), F.min(F.struct("rank", "node", "label")).alias("c"))
        each = each.groupBy("key").agg(F.sum("n").alias("nodes"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("labels"), F.min("c").alias("c"))
        open_ = written(each.where("labels > 1").withColumn("pairs", ((F.col("nodes") * F.col("nodes") - F.col("same")) / 2).cast("long")).select("key", "pairs", (4 * F.col("nodes")).alias("many"), F.col("c.node").alias("centre"), F.col("c.label").alias("top"), (F.col("pairs") > REFINED * F.col("nodes")).alias("hot")), "open")
        stars = written(lists.join(open_.select("key", "centre", "top", "hot"), "key"), "stars")
        left, few = open_.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("many"), F.lit(0))).first()
        dropped(*used, open_)
        used = [stars]
        lists = stars.select("key", "node")
        if not left:
            break
        if turn == 0:
            # lists with many pairs of different components are those of shared passages: there, single shingles tell.
            # Each list is judged by itself, so that a larger table is not worked on in another way than a small one
            hot = stars.where("hot").select("node")
            if not hot.isEmpty():
                wanted = _wanted(hot, nodes)
                buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted.agg(F.sum("n")).first()[0] // BUCKET)
                used.append(_refined(_rows(docs, id, text, wanted), nodes, k, p, q, buckets))
                lists = stars.where("not hot").select("key", "node").union(used[-1])
            continue
        if left <= few:
            break
        star = stars.where("label <> top").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        done, found = _compared(docs, id, text, star.join(pairs, ["a", "b"], "left_anti"), nodes, k, p, q)
        pairs = pairs.union(done)
        if found.isEmpty():
            break
        links = written(links.union(found), "links")
        labels = components(links)

    # what is left: pairs of nodes of different components on one list
    rest = _named(lists.select("key", "node"), labels).join(nodes.select("node", "n", "bits"), "node")
    one, two = (rest.select("key", *(F.col(x).alias(f"{x}_{c}") for x in ("node", "label", "n", "bits"))) for c in "ab")
    more = one.join(two, (one.key == two.key) & (F.col("label_a") != F.col("label_b")) & (F.col("node_a") < F.col("node_b")) & _may_link(p, q))
    more = more.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    _, found = _compared(docs, id, text, more.join(pairs, ["a", "b"], "left_anti"), nodes, k, p, q)
    if not found.isEmpty():
        labels = components(links.union(found))
    dropped(members, *used)
    # components' smallest ids come from nodes, so that rows are joined once, and by digest
    named = written(nodes.join(labels, "node", "left").select("digest", "low", F.coalesce("label", "node").alias("label")), "named")
    lowest = written(named.groupBy("label").agg(F.min("low").alias("low")), "lowest")
    named = written(named.select("digest", "label").join(F.broadcast(lowest) if lowest.count() <= BROADCAST_IDS else lowest, "label"), "components")
    return rows.select("id", "hash", "n", "digest").join(named, "digest", "left").select("id", "hash", "n", "label", "low")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9."""
    found = jaccard_components(table(spark, sf_dir, "documents"), 3, 9, 10)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
