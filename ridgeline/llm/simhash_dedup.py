"""SimHash near-duplicates, linked exactly by the generalised pigeonhole principle.

Fingerprints: 64 bits; a bit is 1 if more than half of the text's word shingles, repeats included, have it in their XXH64.

Links: two fingerprints link if they differ in at most ``radius`` bits. The bits are grouped into partitions, correlated bits
together, and each partition i gets a threshold t_i with sum(t_i + 1) = radius + 1, so that two linked fingerprints differ
by at most t_i bits in some partition i (with t_i = -1 a partition isn't probed at all). Which partitions and thresholds to
use is decided by dynamic programming on the estimated number of candidates and of index rows; the estimate comes from the
bits' joint counts over all distinct fingerprints (a 64 x 64 table). A row is dealt by (partition, key); for t = 1 each
fingerprint has one key for each bit, with that bit left out.

Within a key the candidates are verified on all 64 bits. Pairs aren't written out: large groups are searched breadth first
and give one link for each member reached, and the links of a task are reduced to a forest. Keys with over ``BLOCK`` members are
dealt in pairs of blocks to many tasks, so no task holds an unbounded group; with over ``radius + 1`` times as many their members are first
dealt once more by the bits outside the partition, as copies that agree there too are few. Components of the links come from label
propagation over all links with alternating star operations, checkpointed each round; nothing of it goes to the driver
but counts.

The pipeline's stage links besides these all texts whose sets of five-word shingles have a Jaccard similarity J of at least
0.8, exactly: with all shingles in any one order, two such sets of n hashes share one of their first n - ceil(0.8 n) + 1
(prefix filter). The order is that of the hashes, with those last that a sample of the texts shows to be common. These are
dealt by hash; within a hash the sizes and the places rule pairs out. What is left is compared by parities first: each set has
a bitmap of a power of two of buckets, at least as many as hashes, that says which buckets have an odd number of its hashes.
Two bitmaps differ in no more bits than the sets in hashes, so the filter loses nothing; it has a sixty-fourth of the sets' size and leaves few pairs but
those near 0.8 and over, which are compared as whole sets. Neighbours by size are compared first, and what they link
isn't paired again, so that a large group of near copies doesn't write out its pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle make one
shingle; repeated rows and equal texts share a fingerprint and so a component; a null id can't be a component's name, it
gets the smallest id that is not null, or null. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import cut_lineage, fresh, most_counted, slices

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Of the pipeline's stage: words of a shingle, and the least Jaccard similarity.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint."""
    import xxhash

    # bytes.split() without arguments cuts at exactly these blanks: space and 0x09 to 0x0D
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    lanes = hashes.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *carried, fp)`` for each row; fp holds the 64 bits as a signed long."""
    kept = [id_col, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, shingle) for t in part.column(len(kept)).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(fps, pa.int64())], names=[*kept, "fp"])

    columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, text_col).mapInArrow(run, f"{columns}, fp long")


# --- the plan of partitions and thresholds


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def joint_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows, and for each pair of bits how many rows have both; over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            bits = ((np.asarray(batch.column(0)).view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,096 rows
    both = np.zeros(4096)
    for cell, n in cells:
        both[cell] = n
    return fps.count(), both.reshape(64, 64)


def agreement(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two rows drawn at random: the chance that they agree on bit i, and that they agree on both i and j."""
    n = max(n, 1)
    p11 = both / n
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    return p**2 + (1 - p) ** 2, p11**2 + p10**2 + p01**2 + p00**2


def near_chance(bits: tuple[int, ...], most: int, single: np.ndarray, double: np.ndarray) -> float:
    """Estimated chance that two rows differ in at most ``most`` of the bits, as a chain of neighbouring bits."""
    first = bits[0]
    state = {(True, 0): single[first], (False, 1): 1 - single[first]}  # (agree on the last bit, differing bits so far)
    for a, b in pairwise(bits):
        both = double[a, b]
        only_a, only_b = max(single[a] - both, 0.0), max(single[b] - both, 0.0)
        neither = max(1 - both - only_a - only_b, 0.0)
        step = {(True, True): both / max(single[a], 1e-12), (True, False): only_a / max(single[a], 1e-12), (False, True): only_b / max(1 - single[a], 1e-12), (False, False): neither / max(1 - single[a], 1e-12)}
        new: dict[tuple[bool, int], float] = {}
        for (agree, off), chance in state.items():
            for now in (True, False):
                k = off + (not now)
                if k <= most:
                    new[now, k] = new.get((now, k), 0.0) + chance * step[agree, now]
        state = new
    return sum(x for (_, off), x in state.items() if off <= most)


def chained(single: np.ndarray, double: np.ndarray) -> list[int]:
    """The bits in a chain in which each next bit is the one most tied to the last, so that a cut leaves ties together."""
    tie = np.abs(double - np.outer(single, single))
    chain, left = [int(np.argmax(tie.sum(1) - np.diag(tie)))], set(range(64))
    left.discard(chain[0])
    while left:
        chain.append(max(sorted(left), key=lambda b: tie[chain[-1], b]))
        left.discard(chain[-1])
    return chain


ROW_COST, PAIR_COST = 600.0, 5.0  # nanoseconds of an index row dealt, and of a candidate verified


def plan(n: int, both: np.ndarray, radius: int = RADIUS) -> list[Part]:
    """Partitions and thresholds of least estimated cost.

    For each number of partitions the chain of bits is cut evenly; thresholds -1, 0 or 1 are given out by dynamic
    programming on the partitions' estimated costs.
    """
    single, double = agreement(n, both)
    chain = chained(single, double)
    best: tuple[float, list[Part]] | None = None
    for m in range((radius + 2) // 2, radius + 2):
        edges = [round(64 * k / m) for k in range(m + 1)]
        groups = [tuple(chain[a:b]) for a, b in pairwise(edges)]
        # least[s]: cheapest way to give out s = sum(t + 1) so far
        least: dict[int, tuple[float, list[Part]]] = {0: (0.0, [])}
        for bits in groups:
            new: dict[int, tuple[float, list[Part]]] = {}
            for threshold in (-1, 0, 1):
                keys = 0 if threshold < 0 else len(bits) if threshold else 1
                pairs = n * n / 2 * near_chance(bits, threshold, single, double) if threshold >= 0 else 0.0
                cost = ROW_COST * keys * n + PAIR_COST * pairs * (1 + threshold)
                for given, (so_far, parts) in least.items():
                    s = given + threshold + 1
                    if s <= radius + 1 and (s not in new or so_far + cost < new[s][0]):
                        new[s] = (so_far + cost, parts + ([Part(bits, threshold)] if threshold >= 0 else []))
            least = new
        if radius + 1 in least and (best is None or least[radius + 1][0] < best[0]):
            best = least[radius + 1]
    return best[1]


# --- probing and verifying

BLOCK = 4096
#: Groups up to this size are compared shift by shift; larger ones are searched breadth first.
SMALL = 64


def _keys(part: Part, number: int, fp: F.Column) -> F.Column:
    """Structs (part, key) of a fingerprint; a key that leaves bit b out has part number + 1 + b."""
    rows = [F.struct(F.lit(number).alias("part"), fp.bitwiseAND(F.lit(_signed(part.mask))).alias("key"))] if part.threshold == 0 else [
        F.struct(F.lit(number + 1 + b).alias("part"), fp.bitwiseAND(F.lit(_signed(part.mask & ~(1 << b)))).alias("key")) for b in part.bits
    ]
    return F.array(*rows)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Union-find by smallest label, over the members of one task's links."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def links(self) -> tuple[list[int], list[int]]:
        pairs = [(x, self.root(x)) for x in list(self.up)]
        return [a for a, b in pairs if a != b], [b for a, b in pairs if a != b]


def link_sorted(group: np.ndarray, fp: np.ndarray, node: np.ndarray, left: np.ndarray, radius: int, forest: Forest) -> None:
    """Join the nodes of rows that share a group and differ in at most ``radius`` bits. Rows come sorted by group.

    ``left``: for groups in blocks, -1 or 1 for the two blocks (only rows of different blocks are compared), else 0.
    """
    n = len(group)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    sizes = np.diff(edges)
    small = np.repeat(sizes <= SMALL, sizes) & (np.repeat(sizes, sizes) > 1)
    at = np.flatnonzero(small)
    shift = 1
    while len(at):
        at = at[at + shift < n]
        at = at[group[at] == group[at + shift]]
        near = (np.bitwise_count(fp[at] ^ fp[at + shift]) <= radius) & ((left[at] == 0) | (left[at] != left[at + shift]))
        for a, b in zip(node[at[near]].tolist(), node[at[near] + shift].tolist(), strict=True):
            forest.join(a, b)
        shift += 1
    for start, size in zip(edges[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        rows = np.arange(start, start + size)
        while len(rows):
            queue, rows = [int(rows[0])], rows[1:]
            while queue and len(rows):
                x = queue.pop()
                near = np.bitwise_count(fp[rows] ^ fp[x]) <= radius
                if left[x]:
                    near &= left[rows] != left[x]
                if near.any():
                    for y in rows[near].tolist():
                        forest.join(int(node[x]), int(node[y]))
                        queue.append(y)
                    rows = rows[~near]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        rest: list[np.ndarray] | None = None

        def done(columns: list[np.ndarray]) -> None:
            part, key, pair, fp, node, left = columns
            if len(part):
                change = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
                link_sorted(np.concatenate(([0], np.cumsum(change))), fp.view(np.uint64), node, left, radius, forest)

        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            if not len(columns[0]):
                continue
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            done([c[:cut] for c in columns])
            rest = [c[cut:] for c in columns]
        if rest is not None:
            done(rest)
        a, b = forest.links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows ``(part, key, ...)``, told apart by their third column, with ``pair`` and ``left``: those of a key in one task.

    Keys with more members than a block are few; they are dealt in pairs of blocks.
    """
    rest = rows.columns[2:]
    large = rows.groupBy("part", "key").agg(F.count("*").alias("members")).where(F.col("members") > block)
    large = cut_lineage(large)
    if large.head(1):
        blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
        tagged = rows.join(large, ["part", "key"], "left")
        mine = F.pmod(F.xxhash64(rest[0]), blocks).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        small = tagged.where(F.col("members").isNull()).select("part", "key", F.lit(0).cast("long").alias("pair"), *rest, F.lit(0).alias("left"))
        split = tagged.where(F.col("members").isNotNull()).withColumn("mine", mine).withColumn("blocks", blocks).withColumn("other", other)
        low, high = F.least("mine", "other").cast("long"), F.greatest("mine", "other").cast("long")
        split = split.select("part", "key", (low * F.col("blocks") + high + 1).alias("pair"), *rest, F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), -1).otherwise(1).alias("left"))
        whole = small.unionByName(split)
    else:
        whole = rows.select("part", "key", F.lit(0).cast("long").alias("pair"), *rest, F.lit(0).alias("left"))
    return whole.repartition("part", "key", "pair")


#: Up to so many large keys are broadcast (16 bytes each), more go by a shuffle.
MOST_LARGE = 100_000


def _divided(rows: DataFrame, parts: list[Part], radius: int, block: int) -> DataFrame:
    """Rows ``(part, key, fp, node)``, those of large keys dealt once more, by the bits outside their part.

    These are cut into radius + 1 groups, in one of which two linked fingerprints agree; so members of a key of any size are
    written radius + 1 times, and only those that agree there too meet. (The new key is a hash; what it throws together by chance is told
    apart by verifying.)
    """
    large = cut_lineage(rows.groupBy("part", "key").agg(F.count("*").alias("members")).where(F.col("members") > (radius + 1) * block).select("part", "key"))
    n = large.count()
    if not n:
        return rows
    met = rows.join((F.broadcast if n <= MOST_LARGE else lambda df: df)(large.withColumn("large", F.lit(True))), ["part", "key"], "left")
    keys = F.lit(None)
    for k, part in enumerate(parts):
        rest = [b for b in range(64) if b not in part.bits]
        masks = [sum(1 << b for b in rest[g :: radius + 1]) for g in range(radius + 1)]
        again = F.array(*[F.struct(F.lit(10_000 + g).alias("part"), F.xxhash64("part", "key", F.lit(g), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key")) for g, m in enumerate(masks)])
        keys = F.when(F.floor(F.col("part") / 100) == k, again).otherwise(keys)
    alone = F.array(F.struct("part", "key"))
    return met.select("fp", "node", F.explode(F.when(F.col("large"), keys).otherwise(alone)).alias("k")).select("k.part", "k.key", "fp", "node")


def near_links(nodes: DataFrame, parts: list[Part], radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)``, a > b, whose components are those of all pairs within ``radius``; nodes has distinct ``(fp, node)``."""
    keys = F.concat(*[_keys(p, 100 * k, F.col("fp")) for k, p in enumerate(parts)])
    rows = nodes.select("fp", "node", F.explode(keys).alias("k")).select("k.part", "k.key", "fp", "node")
    dealt = _dealt(_divided(rows, parts, radius, block), block).sortWithinPartitions("part", "key", "pair")
    return dealt.select("part", "key", "pair", "fp", "node", "left").mapInArrow(_links(radius), "a long, b long")


# --- similar sets of shingles


def shingle_set(text: str | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's word shingles, ascending; words as in fingerprint(), few words make one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def prefix_length(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


#: Common shingles: in so many sampled texts or more; the most common ones go to the driver, at most so many.
COMMON_FROM, MOST_COMMON = 4, 100_000


def common_hashes(texts: DataFrame) -> np.ndarray:
    """Hashes that many of the texts ``(row, text)`` have, by a sample, ascending. They only order the prefixes, for speed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                found = [shingle_set(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).view(np.int64), pa.int64())], names=["hash"])

    n = texts.count()
    one_in = max(1, n // (4000 + n // 50))
    sample = texts.where(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0).select("text").distinct()
    counted = sample.mapInArrow(run, "hash long").groupBy(F.col("hash").alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_FROM)
    return np.sort(np.array(most_counted(counted, MOST_COMMON), dtype=np.int64).view(np.uint64))


def prefix_of(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes, common ones last."""
    if len(common) and len(hashes):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate((hashes[~late], hashes[late]))
    return hashes[: prefix_length(len(hashes), similarity)]


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each of a power of two of buckets, at least 64 and as many as hashes: whether it has an odd number of them."""
    size = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """In how many hashes two sets differ at least, by their parities."""
    a, b = sorted((np.frombuffer(z, dtype="<u8") for z in (x, y)), key=len)
    while len(b) > len(a):  # buckets that are one in the shorter map
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def signatures(docs: DataFrame, id_col: str, text_col: str, row: str, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """``(row, id, fp, sig, n, prefix, odd)``: the fingerprint; a hash of the shingle set, its size, first hashes and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch):
                texts = part.column(2).to_pylist()
                sets = [shingle_set(t) for t in texts]
                fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
                sigs = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                firsts = [prefix_of(s, common, similarity).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fps, pa.int64()), pa.array(sigs, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(map(parities, sets), pa.binary())],
                    names=["row", "id", "fp", "sig", "n", "prefix", "odd"],
                )

    return docs.select(row, id_col, text_col).mapInArrow(run, f"row long, id {docs.schema[id_col].dataType.simpleString()}, fp long, sig long, n int, prefix array<long>, odd binary")


def paired_sorted(group: np.ndarray, sig: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, left: np.ndarray, similarity: float, chain: bool) -> Iterator[np.ndarray]:
    """Pairs of a group that sizes and places allow, of different roots; rows come sorted by group and n. ``chain``: neighbours only."""
    at, shift, total = np.arange(len(group)), 1, len(group)
    while len(at):
        at = at[at + shift < total]
        to = at + shift
        at = at[(group[at] == group[to]) & (n[at] >= similarity * n[to] - 1e-9)]
        to = at + shift
        most = np.minimum(n[at] - place[at], n[to] - place[to])  # shared hashes, if this is the first
        ok = (root[at] != root[to]) & ((left[at] == 0) | (left[at] != left[to])) & (most >= similarity / (1 + similarity) * (n[at] + n[to]) - 1e-9)
        if ok.any():
            a, b = sig[at[ok]], sig[to[ok]]
            yield np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        if chain:
            return
        shift += 1


def _pairs(similarity: float, chain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, pair, *others = columns
            if len(key):
                change = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
                for found in paired_sorted(np.concatenate(([0], np.cumsum(change))), *others, similarity, chain):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            if not len(columns[0]):
                continue
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            yield from done([c[:cut] for c in columns])
            rest = [c[cut:] for c in columns]
        if rest is not None:
            yield from done(rest)

    return run


#: Up to so many shared hashes are broadcast (16 bytes each), more go by a shuffle.
MOST_SHARED = 1_000_000


def shared_hashes(signed: DataFrame) -> DataFrame:
    """``(sig, n, place, key)``: the prefixes' hashes that two signatures or more have; signed has ``(sig, n, prefix)``."""
    rows = signed.select("sig", "n", F.posexplode("prefix").alias("place", "key"))
    keys = cut_lineage(rows.groupBy("key").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("key"))
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_SHARED else keys, "key").select("sig", "n", "place", "key").distinct()


def similar_candidates(shared: DataFrame, similarity: float, chain: bool, block: int = BLOCK) -> DataFrame:
    """Distinct pairs of signatures ``(a, b)`` that may be similar; shared has ``(sig, n, place, key, root)``, pairs of a root are left out."""
    rows = shared.select(F.lit(0).alias("part"), "key", "sig", "n", "place", "root")
    dealt = _dealt(rows, block).sortWithinPartitions("key", "pair", "n")
    return dealt.select("key", "pair", "sig", "n", "place", "root", "left").mapInArrow(_pairs(similarity, chain), "a long, b long").distinct()


#: Up to so many texts to compare are picked by a broadcast of their numbers (16 bytes each), more by a shuffle.
MOST_PICKED = 200_000


def possible_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` that the sets' parities don't rule out; sets has ``(sig, n, odd)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))
            apart = np.array([least_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], dtype=np.int64)
            ok = (sizes - apart) / 2 >= similarity / (1 + similarity) * sizes - 1e-9
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    a, b = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("odd").alias("x")), sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def similar_links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose whole sets are similar; sets has ``(sig, row, n, odd)``, texts ``(row, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [shingle_set(t).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["sig", "hashes"])

    pairs = cut_lineage(possible_links(pairs, sets, similarity))
    wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = cut_lineage(wanted.join(sets.select("sig", "row"), "sig"))
    picked = texts.join(F.broadcast(wanted) if wanted.count() <= MOST_PICKED else wanted, "row").select("sig", "text")
    hashes = cut_lineage(picked.mapInArrow(run, "sig long, hashes array<long>"))
    met = pairs.join(hashes.toDF("a", "x"), "a").join(hashes.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return met.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def _similar_roots(every: DataFrame, texts: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """``(node, root)`` over the links ``near`` between fingerprints and those of similar sets; every as of signatures()."""
    sets = every.where("n > 0").groupBy("sig").agg(F.min("fp").alias("node"), F.min("row").alias("row"), F.min("n").alias("n"), F.min("odd").alias("odd"))
    sets, shared = cut_lineage(sets), cut_lineage(shared_hashes(every))
    same = every.join(sets.select("sig", "node"), "sig").where("fp <> node").select(F.col("fp").alias("a"), F.col("node").alias("b"))
    links = cut_lineage(near.unionByName(same).distinct())
    roots = components(links)
    for chain in (True, False):
        rooted = sets.join(roots.withColumnRenamed("node", "fp"), F.col("node") == F.col("fp"), "left").select("sig", F.coalesce("root", "node").alias("root"))
        found = similar_links(similar_candidates(shared.join(rooted, "sig"), similarity, chain), sets, texts, similarity)
        a, b = sets.select(F.col("sig").alias("a"), F.col("node").alias("x")), sets.select(F.col("sig").alias("b"), F.col("node").alias("y"))
        links = links.unionByName(found.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
        roots = components(links)
    return roots


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for the nodes of links ``(a, b)``: the smallest node reachable. Alternating large and small stars."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def star(pairs: DataFrame, both_ways: bool) -> DataFrame:
        # (u, v): v is a neighbour of u; each neighbour is tied to the smallest one
        around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else pairs
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = around.join(least, "a")
        if both_ways:  # larger neighbours go to the smallest
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # smaller neighbours and the node itself
            out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    for _ in range(most_rounds):
        # A forest of stars has each a once, and no b that is an a.
        state = edges.groupBy("a").agg(F.count("*").alias("n"))
        deep = state.where("n > 1").limit(1).count() or edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi").limit(1).count()
        if not deep:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = cut_lineage(star(star(edges, True), False))
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def _near(nodes: DataFrame, radius: int) -> DataFrame:
    """Links ``(a, b)`` between fingerprints; nodes has distinct ``(fp, node)``."""
    n, both = joint_counts(nodes)
    if n < 2:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    return near_links(nodes.select("fp", "node"), plan(n, both, radius), radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per row ``(id, fingerprint, component_id)``: 16 hex digits, and the smallest id reachable over links."""
    every = cut_lineage(fingerprints(docs, id_col, text_col, shingle).toDF("id", "fp"))
    nodes = cut_lineage(every.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.col("fp")))
    roots = components(_near(nodes, radius))
    named = nodes.select("fp", "least")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    # component -> smallest id of its fingerprints
    joined = named.join(roots, named.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(least, "root").select("fp", "component_id")
    return every.join(by_fp, "fp").select(F.col("id").alias(id_col), hexed, "component_id")


def _firsts(every: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``row`` to keep of each root; every has ``(row, id, root)``, texts ``(row, text)``. Nulls come last among ids."""
    by_id = every.groupBy("root", "id").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    least = by_id.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row", "n")).alias("f"))
    least = cut_lineage(least.select("root", "f.id", "f.row", "f.n"))
    tied = least.where("n > 1").select(F.col("root").alias("r"), F.col("id").alias("i"))
    if not tied.head(1):
        return least.select("row")
    # Only rows that share the smallest id of their group need their texts compared.
    rows = every.join(tied, (F.col("root") == F.col("r")) & F.col("id").eqNullSafe(F.col("i"))).select("row", "root")
    smallest = rows.join(texts, "row").groupBy("root").agg(F.min(F.struct("text", "row")).alias("f"))
    return least.where("n = 1").select("row").unionByName(smallest.select("f.row"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The documents, in their own columns, with one row of each group of near-duplicates: the one with the smallest id.

    Rows are told apart by a number of their own, so ids may repeat or be null. Among rows of a group with the same smallest
    id the one with the smallest text stays; null ids come last. With ``similarity`` texts link too whose sets of
    ``SIMILAR_SHINGLE``-word shingles have that Jaccard similarity or more.
    """
    row = fresh(docs.columns, "_row")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    if similarity is None:
        every = cut_lineage(fingerprints(numbered, row, text_col, shingle, (id_col,)).toDF("row", "id", "fp"))
    else:
        every = cut_lineage(signatures(numbered, id_col, text_col, row, shingle, similarity, common_hashes(texts)))
    near = _near(cut_lineage(every.select("fp", F.col("fp").alias("node")).distinct()), radius)
    roots = components(near) if similarity is None else _similar_roots(every, texts, near, similarity)
    rooted = every.join(roots, every.fp == roots.node, "left").select("row", "id", F.coalesce("root", "fp").alias("root"))
    winners = _firsts(rooted, texts).select(F.col("row").alias(row))
    return numbered.join(winners, row, "left_semi").select(*docs.columns)
