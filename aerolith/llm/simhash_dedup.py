"""SimHash near-duplicate groups with BK-trees (operator 7).

Fingerprints of word shingles are made in one pass over the texts; equal fingerprints collapse to one row. Each
distinct fingerprint is sent to shards, one per key mask: a shard is the set of fingerprints that agree on a mask's
bits. A shard's BK-tree (children keyed by their Hamming distance to the parent) is searched for each of its
fingerprints: from a node at distance d only the edges from d - radius to d + radius are followed. Trees and searches
are arrays: a tree is built level by level, and a block of searches walks down it in step. A broadcast of shard trees
would first gather all fingerprints at the driver, so the tree is built in the task that owns the shard and serves all
searches of that shard there.

Masks for radius r on 64 bits: the bits are cut into m > r bands and a mask takes bits of any m - r of them, so two
fingerprints within r bits agree on some mask and no link is lost. m and the bits taken follow from the number of
fingerprints, so that a shard of evenly spread ones holds about ``shard``, whatever the corpus holds. A shard with more
than ``block`` (of much alike texts) is dealt into blocks, and each pair of blocks is a search of its own, so that no
task gathers an unbounded shard. For a threshold on the similarity of the shingle sets (``near_groups``), fingerprints
only propose: masks are random sets of bits, the radius and the number of masks set by a rule so that a pair at the
threshold is met with probability ``recall``, and all pairs of the sets that proposals connect are judged on the sets.

From a shard only links that join two of its groups so far are emitted (at most one less than its fingerprints), which
keeps every component and never lists the pairs of a large group.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import join_by_size, map_batches, map_rows, materialise, passing, small_side, text_or_empty, without
from aerolith.llm.components import connected_components

SEED = 42


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of A-Z-lowered words; all words as one shingle if they are fewer; empty if none."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)], np.uint64)
    line, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(parts) - words]]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.ascontiguousarray(hashes[at : at + 65536])
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64) -> DataFrame:
    """doc_id and ``fp`` (binary, big-endian, ``bits`` / 8 bytes) of each row; null text counts as empty."""

    def kernel():
        from aerolith.llm.simhash_dedup import SEED, fold, shingle_hashes

        def step(cols):
            out = []
            for text in cols["text"].to_pylist():
                parts = [fold(shingle_hashes(text, words, SEED + k)) for k in range(bits // 64)]
                out.append(b"".join(p.to_bytes(8, "big") for p in parts))
            return {"doc_id": cols["doc_id"], "fp": out}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_rows(rows, kernel, "doc_id long, fp binary", pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())]))


def pigeonhole_masks(bits: int, radius: int, n: int = 0, shard: int = 2048) -> list[int]:
    """Masks of which any two fingerprints within ``radius`` agree on at least one.

    Their keys have as many bits as deal ``n`` evenly spread fingerprints into shards of about ``shard``.
    """
    want = math.ceil(math.log2(max(n, 1) / shard)) if n > shard else 0
    if not want:
        return [0]
    count = radius + 1
    while bits * (count - radius) // count < want and count < bits:
        count += 1
    edges = [round(i * bits / count) for i in range(count + 1)]
    each = -(-want // (count - radius))
    bands = [((1 << min(each, b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(bands, count - radius)]


def sampled_masks(bits: int, similarity: float, n: int, recall: float, shard: int = 128) -> tuple[list[int], int]:
    """Random masks and a search radius for pairs of shingle sets at ``similarity`` among ``n`` fingerprints.

    The distance of such a pair is binomial; the radius lies four standard deviations over its mean. Shards hold about
    ``shard`` fingerprints. Masks are as many as make the chance that the pair is within the radius and meets under some
    mask at least ``recall``; a mask meets a pair at distance d with the hypergeometric chance of missing all d bits.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = min(bits, math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p))))
    size = max(8, math.ceil(math.log2(max(n, 2) / shard)))
    chance = [math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(radius + 1)]
    apart = [1 - math.comb(bits - d, size) / math.comb(bits, size) for d in range(radius + 1)]
    count = 1
    while sum(c * (1 - a**count) for c, a in zip(chance, apart)) < recall:
        count += 1
    rng = random.Random(SEED)
    return [sum(1 << b for b in rng.sample(range(bits), size)) for _ in range(count)], radius


def as_words(fps: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of 64-bit words, most significant first."""
    return np.frombuffer(b"".join(fps), ">u8").reshape(len(fps), len(fps[0]) // 8 if fps else 1).astype(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def as_words(fps: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of 64-bit words, most significant first."""
    return np.frombuffer(b"".join(fps), ">u8").reshape(len(fps), len(fps[0]) // 8 if fps else 1).astype(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class BKTree:
    """Distances are integers; an edge is keyed by the child's distance to its parent.

    ``values``: rows of 64-bit words. Nodes are the distinct values, each one inserted in order of its first place.
    """

    def __init__(self, values: np.ndarray):
        _, first, which = np.unique(values, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.values, self.span = values[first[order]], 64 * values.shape[1] + 1
        by = place[which.ravel()]
        self.members = np.argsort(by, kind="stable")  # places in ``values`` of each node's copies
        self.first_member = np.searchsorted(by[self.members], np.arange(len(order) + 1))
        self.node = by
        n = len(self.values)
        at, waiting, keys, children = np.zeros(n, np.int64), np.arange(1, n), [], []
        while len(waiting):  # all values go down one level; the first to take an edge becomes its child
            key = at[waiting] * self.span + distances(self.values[waiting], self.values[at[waiting]])
            edge, new, taken = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(waiting[new])
            at[waiting] = waiting[new][taken]
            waiting = np.delete(waiting, new)
        keys, children = (np.concatenate([np.empty(0, np.int64), *x]) for x in (keys, children))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def search(self, queries: np.ndarray, radius: int, last: np.ndarray | None = None):
        """(query, place in the tree's values, distance) of all values within ``radius``.

        ``last``: the node up to which a query looks; nodes below one that came later came later still.
        """
        q = np.arange(len(queries)) if len(self.values) else np.empty(0, np.int64)
        node, out = np.zeros(len(q), np.int64), []
        while len(q):
            if last is not None:
                early = node <= last[q]
                q, node = q[early], node[early]
            d = distances(self.values[node], queries[q])
            near = np.flatnonzero(d <= radius)
            out.append((q[near], node[near], d[near]))
            lo = np.searchsorted(self.keys, node * self.span + np.maximum(d - radius, 0))
            count = np.searchsorted(self.keys, node * self.span + np.minimum(d + radius, self.span - 1), side="right") - lo
            q, below = np.repeat(q, count), np.repeat(lo - np.cumsum(count) + count, count)
            node = self.children[below + np.arange(len(below))]
        q, node, d = (np.concatenate([np.empty(0, np.int64), *(o[i] for o in out)]) for i in range(3))
        count = self.first_member[node + 1] - self.first_member[node]
        at = np.repeat(self.first_member[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(q, count), self.members[at], np.repeat(d, count)


def searches(values: np.ndarray, radius: int, own: int):
    """(position, other position, distance) of pairs within the radius, in blocks of searches.

    The first ``own`` values form the tree. If these are all, each pair is given once, the later position first; else the
    others are searched for.
    """
    tree, alone = BKTree(values[:own]), own == len(values)
    step = max(1, 250_000 // max(own, 1))
    for lo in range(0 if alone else own, len(values), step):
        q, at, d = tree.search(values[lo : lo + step], radius, tree.node[lo : lo + step] if alone else None)
        q = q + lo
        yield (q[q > at], at[q > at], d[q > at]) if alone else (q, at, d)


def shard_links(values: np.ndarray, labels: list, radius: int, own: int, window: int = 256):
    """Links (position, other position) that join groups not joined yet.

    A whole shard is searched among near positions first; then the members of a large group need no search among
    themselves, so that the work on a shard of much alike texts does not grow with the square of its size.
    """
    root = np.arange(len(values))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def joins(part, first):
        for a, b, _ in searches(values[part], radius, first):
            a, b = part[a], part[b]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            _, some = np.unique(root[a] * len(values) + root[b], return_index=True)
            for i, j in zip(a[some].tolist(), b[some].tolist()):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    yield i, j
            while (root[root] != root).any():
                root[:] = root[root]

    rest = np.arange(len(values))
    if own == len(values) > 2 * window:
        for lo in range(0, len(values) - window, window):
            part = rest[lo : lo + 2 * window]
            yield from joins(part, len(part))
        while len(rest):
            inside = root[rest] == np.bincount(root[rest]).argmax()
            if inside.sum() < 32:
                break
            group, rest = rest[inside], rest[~inside]
            if len(rest):
                yield from joins(np.concatenate([group, rest]), len(group))
        own = len(rest)
    if len(rest) > 1:
        yield from joins(rest, own)


def nearest_of_each(q: np.ndarray, at: np.ndarray, d: np.ndarray, most: int):
    """The ``most`` nearest partners of each ``q``: (q, at)."""
    by = np.lexsort((at, d, q))
    q, at = q[by], at[by]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < most
    return q[keep], at[keep]


def shard_candidates(values: np.ndarray, labels: list, radius: int, own: int, most: int = 3, window: int = 256):
    """Pairs of each value with the nearest ``most`` within the radius among the ``window`` values to each side, in the order given."""
    if own < len(values):
        return
    found = [[np.empty(0, np.int64)] * 3]
    for lo in range(0, max(1, len(values) - window), window):
        part = values[lo : lo + 2 * window]
        found += [(a + lo, b + lo, d) for a, b, d in searches(part, radius, len(part))]
    a, b, d = (np.concatenate(x) for x in zip(*found))
    q, at = nearest_of_each(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d]), most)
    yield from zip(q.tolist(), at.tolist())


def shard_pairs(values: np.ndarray, labels: list, radius: int, own: int, most: int = 64):
    """Pairs of each value with the nearest ``most`` within the radius whose labels differ from its own.

    The members of a large label are not searched for among themselves.
    """
    names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    if len(names) == 1:
        return
    label, rest = np.array([names[x] for x in labels]), np.arange(len(values))

    def pairs(part, first):
        for a, b, d in searches(values[part], radius, first):
            a, b = part[a], part[b]
            apart = label[a] != label[b]
            q, at = nearest_of_each(a[apart], b[apart], d[apart], most)
            yield from zip(q.tolist(), at.tolist())

    if own < len(values):
        yield from pairs(rest, own)
        return
    for k in np.argsort(-np.bincount(label), kind="stable"):
        of_label = label[rest] == k
        if of_label.sum() < 32:
            break
        inside, rest = rest[of_label], rest[~of_label]
        if len(rest):
            yield from pairs(np.concatenate([inside, rest]), len(inside))
    if len(rest):
        yield from pairs(rest, len(rest))


#: Odd multipliers that scramble a shard's masked words and the number of its mask into one name (fixed values).
SCRAMBLE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
HELD = [("shard", pa.int64()), *((n, pa.binary()) for n in ("fp", "key", "label"))]


def shard_names(values: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """64-bit names of the shards of ``values`` under mask number ``k``; two shards with one name would be searched as one."""
    name = np.full(len(values), k + 1, np.uint64)
    for word in (values & mask).T:
        name = (name ^ word) * np.uint64(SCRAMBLE[0])
        name = (name ^ (name >> np.uint64(32))) * np.uint64(SCRAMBLE[1])
    return name.view(np.int64)


def shard_search(nodes: DataFrame, masks: list[int], bits: int, close, radius: int, block: int = 65_536) -> DataFrame:
    """(a, b): keys of the pairs that ``close`` finds in each shard of ``nodes`` (fp, key, label), the greater key first."""
    words = [as_words([m.to_bytes(bits // 8, "big")]) for m in masks]

    def spread(batches):
        from aerolith.llm.simhash_dedup import HELD, as_words, shard_names

        for batch in batches:
            if batch.num_rows:
                values = as_words(batch.column(0).to_pylist())
                for k, mask in enumerate(words):
                    yield pa.RecordBatch.from_arrays([pa.array(shard_names(values, mask, k)), *batch.columns], schema=pa.schema(HELD))

    def search(batches):
        from aerolith.llm.simhash_dedup import as_words

        def pairs():
            rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
            for (_, lo, hi), group in itertools.groupby(rows, key=lambda r: r[:3]):
                group = list(group)
                own = sum(r[3] == lo for r in group)
                if len(group) > 1 and (lo == hi or 0 < own < len(group)):
                    for i, j in close(as_words([r[4] for r in group]), [r[6] for r in group], radius, own):
                        a, b = group[i][5], group[j][5]
                        if a != b:
                            yield max(a, b), min(a, b)

        found = pairs()
        while part := list(itertools.islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in part], pa.binary()) for i in (0, 1)], names=["a", "b"])

    keyed = map_batches(nodes.select("fp", "key", "label"), spread, "shard long, fp binary, key binary, label binary")
    large = materialise(keyed.groupBy("shard").count().where(F.col("count") > block), "large-shards")
    zero, held = F.lit(0), ("fp", "key", "label")
    if large.isEmpty():
        dealt = keyed.repartition("shard").sortWithinPartitions("shard", "fp", "key").select("shard", *(zero.alias(c) for c in ("lo", "hi", "part")), *held)
    else:
        large = large.select("shard", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
        dealt = keyed.join(small_side(large, 64), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
        by = ("shard", "lo", "hi")
        dealt = dealt.select(*by, "part", *held).repartition(*by).sortWithinPartitions(*by, "part", "fp", "key")
    return map_batches(dealt, search, "a binary, b binary").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3, bits: int = 64) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links) of each row of ``docs``.

    Links join fingerprints at ``radius`` or fewer differing bits.

    Defined results: null and word-less texts have fingerprint zero and are linked like any other; rows with a null
    doc_id keep it and never name a component unless it has no other row; repeated rows are answered row by row; an
    empty table gives no rows; columns other than doc_id and text are ignored.
    """
    rows = materialise(fingerprints(docs, words, bits), "fingerprints")
    with passing() as keep:
        distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
        masks = pigeonhole_masks(bits, radius, distinct.count())
        nodes = distinct.select("fp", F.col("fp").alias("key"), F.lit(b"").alias("label"))
        linked = connected_components(shard_search(nodes, masks, bits, shard_links, radius))
        nodes = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
        nodes = materialise(nodes, "nodes")
        names = materialise(nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "names")
        named = keep(materialise(join_by_size(nodes, names, "component", "size").select("fp", "component_id", "n"), "named"))
    return join_by_size(rows, named, "fp", "n").select("doc_id", "fp", "component_id")


def scrambled(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th of the hashes that follow from ``hashes`` (SplitMix64); these themselves for 0."""
    if not k:
        return hashes
    h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """doc_id, digest (MD5 of the text), fp (SimHash of its distinct shingles), shingles (their sorted 64-bit hashes) and key
    (MD5 of these)."""

    def kernel():
        from aerolith.llm.simhash_dedup import SEED, fold, scrambled, shingle_hashes

        def step(cols):
            digests, fps, sets, keys = [], [], [], []
            for text in cols["text"].to_pylist():
                digests.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                own = np.unique(shingle_hashes(text, words, SEED))
                fps.append(b"".join(fold(scrambled(own, k)).to_bytes(8, "big") for k in range(bits // 64)))
                sets.append(own.astype("<u8").tobytes())
                keys.append(hashlib.md5(sets[-1]).digest())
            return {"doc_id": cols["doc_id"], "digest": digests, "fp": fps, "shingles": sets, "key": keys}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    names = ("digest", "fp", "shingles", "key")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.binary()) for n in names)])
    return map_rows(rows, kernel, "doc_id long, " + ", ".join(f"{n} binary" for n in names), schema)


class SetFamily:
    """Shingle sets (sorted 64-bit hashes) by place, and for each shingle the places that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        names, which = np.unique(np.concatenate(sets), return_inverse=True)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.which, self.held = which.ravel(), np.bincount(which.ravel(), minlength=len(names))
        self.start = np.concatenate([[0], np.cumsum(self.held)])
        self.places = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(self.which, kind="stable")]

    def alike(self, i: int, similarity: float) -> np.ndarray:
        """Places of the sets whose Jaccard similarity with set ``i`` is ``similarity`` or more, its own included."""
        own = self.which[self.first[i] : self.first[i + 1]]
        count = self.held[own]
        at = np.repeat(self.start[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(self.places[at], minlength=len(self.sizes))
        near = both >= similarity * (self.sizes + self.sizes[i] - both)
        near[i] = True
        return np.flatnonzero(near)


def family_links(sets: list[np.ndarray], similarity: float):
    """Links (place, other place) between sets at ``similarity`` or more that join groups not joined yet.

    Sets are compared with all others, one by one, until all that are left lie in one group: of any two groups one was
    compared whole, so no link between two is lost. The set of the most often held shingles goes first; its group is the
    large one if there is any.
    """
    family = SetFamily(sets)
    group, left = np.arange(len(sets)), np.ones(len(sets), bool)
    i = int((np.add.reduceat(np.append(family.held[family.which], 0), family.first[:-1]) * (family.sizes > 0)).argmax())
    while True:
        left[i] = False
        near = family.alike(i, similarity)
        _, some = np.unique(group[near], return_index=True)
        for j in near[some].tolist():
            if group[j] != group[i]:
                yield i, j
        group[np.isin(group, group[near])] = group[i]
        outside = left & (group != np.bincount(group).argmax())
        if not outside.any():
            return
        i = int(outside.argmax())


def set_links(families: DataFrame, similarity: float, most: int = 4096, most_bytes: int = 8 << 20) -> DataFrame:
    """(a, b): links at ``similarity`` or more that join the sets of each family; ``families``: family, key, shingles.

    All pairs of a family are judged, in a task that holds its sets. A family of more than ``most`` sets or ``most_bytes``
    is dealt into blocks, and each pair of blocks is judged by itself.
    """

    def run(batches):
        from aerolith.llm.simhash_dedup import family_links

        def pairs():
            rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
            for _, group in itertools.groupby(rows, key=lambda r: r[:3]):
                keys, sets = zip(*(r[3:] for r in group))
                for i, j in family_links([np.frombuffer(x, "<u8") for x in sets], similarity):
                    yield max(keys[i], keys[j]), min(keys[i], keys[j])

        found = pairs()
        while part := list(itertools.islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in part], pa.binary()) for i in (0, 1)], names=["a", "b"])

    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / most, F.col("bytes") / most_bytes)).cast("int")
    large = materialise(sizes.select("family", blocks.alias("blocks")).where("blocks > 1"), "large-families")
    zero, by = F.lit(0), ("family", "lo", "hi")
    if large.isEmpty():
        dealt = families.withColumns({"lo": zero, "hi": zero})
    else:
        dealt = families.join(small_side(large, 64), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1))).where("blocks = 1 or other <> part")
        dealt = dealt.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    dealt = dealt.select(*by, "key", "shingles").repartition(*by).sortWithinPartitions(*by, "key")
    return map_batches(dealt, run, "a binary, b binary").distinct()


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 256, recall: float = 0.99) -> DataFrame:
    """doc_id, digest (MD5 of the text), component_id (smallest doc_id reachable by links; null if no row has any), first_id
    and first_digest (the row that stands for the component) of each row of ``docs``.

    Links join texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more. Fingerprints of the sets
    propose pairs in shards; the sets that proposals connect are a family, and all pairs of a family are judged on the sets
    themselves. Both steps give out only links that join groups, so the pairs of a large group are never listed, and none
    is left out.
    """
    rows = materialise(shingle_sets(docs, words, bits), "sets")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("best")
    nodes = materialise(rows.groupBy("key").agg(F.min("fp").alias("fp"), best, F.count(F.lit(1)).alias("n")), "nodes")
    masks, radius = sampled_masks(bits, similarity, nodes.count(), recall)

    proposed = connected_components(shard_search(nodes.withColumn("label", F.lit(b"")), masks, bits, shard_links, radius))
    proposed = materialise(proposed.select(F.col("node").alias("key"), F.col("component").alias("family")), "families")
    sets = rows.select("key", "shingles").join(small_side(proposed, 64), "key").groupBy("key").agg(F.first("family").alias("family"), F.first("shingles").alias("shingles"))
    found = connected_components(set_links(materialise(sets, "family-sets"), similarity))

    named = nodes.join(found, F.col("key") == F.col("node"), "left").select("key", "best", "n", F.coalesce("component", "key").alias("component"))
    named = materialise(named, "named")
    names = materialise(named.groupBy("component").agg(F.min("best").alias("first"), F.count(F.lit(1)).alias("size")), "names")
    named = materialise(join_by_size(named, names, "component", "size", 96).select("key", "first", "n"), "named")
    out = join_by_size(rows.select("doc_id", "digest", "key"), named, "key", "n", 96)
    return out.select("doc_id", "digest", F.col("first.doc_id").alias("component_id"), F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 256) -> DataFrame:
    """``docs`` with one row for each group of near copies: the one with the smallest doc_id, null last, and of different
    texts with that doc_id the one with the smallest MD5. All columns are kept.

    Rows are judged by doc_id and text together, so a row that shares its doc_id with a near copy is not lost with it; of
    rows equal in both one stays; texts without words are one group.
    """
    names = (F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    with passing() as keep:
        groups = near_groups(docs, words, similarity, bits).select(*names, stays.alias("stays"))
        rows = keep(materialise(groups.groupBy("__id", "__digest").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "judged"))
    lost, again = rows.where("not stays"), rows.where("stays and n > 1")
    return without(docs, lost.select("__id", "__digest"), again.select("__id", "__digest"), F.unhex(F.md5(text_or_empty())))
