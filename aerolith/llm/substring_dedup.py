"""Removal of repeated passages with sharded FM-indexes (operator 8).

A window is ``window`` consecutive words. A word goes if a window that covers it occurs at any other place.

1. Anchors. Each window is named by its least ``gram``-word hash; equal windows have equal names. A maximal run of
   windows named by the same occurrence is a fragment (its windows' words and nothing else), known by two hashes. Each
   window lies in exactly one fragment.
2. Names that occur once in the corpus hold no repeated window (unless the text repeats itself there, which is marked)
   and are dropped, after aggregating equal fragments before
   the shuffle. Of equal fragments one stands for all, with their number as its weight.
3. Shards. The words of the remaining fragments (as hashes) go to the shard of their name, so all windows with equal
   words meet in one shard. A shard is worked off in blocks of whole names of at most ``block_words`` words; a name with
   more fragments than ``hot`` is split further by the hash of each single window, so no name is gathered in one task.
4. A block's fragments form a text; its FM-index is the Burrows-Wheeler transform in a wavelet matrix of bit vectors
   with rank counts. Each fragment is streamed backwards through the index, all fragments of a block in step: the
   interval of the current match is extended by one word to the left, and, at full window length, cut by one word on the
   right. The matching statistic is capped at ``window``: an interval at full length whose fragments weigh 2 or more is
   a repeated window. As no match is ever longer, suffixes are sorted by their first ``window`` words only.
5. Repeated windows go back to the texts by fragment, are merged to word intervals, and the words outside are kept.

Texts are known by MD5, so copies of a text share one set of intervals, each copy counting as an occurrence.

Defined results: null and white-space texts have no words, and the SHA-256 of the empty string; texts shorter than a
window lose nothing; repeated rows are copies of each other; an empty table gives no rows; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import EMIT_ROWS, Memo, map_batches, materialise, ship, text_or_empty

#: Odd multipliers of the polynomial hashes of word sequences (fixed values).
BASE_A = np.uint64(0x9E3779B97F4A7C15)
BASE_B = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes:
    """64-bit hashes of words, memorised for short words."""

    def __init__(self):
        self.memo = Memo(xxhash.xxh64_intdigest, 120_000, 24)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that least values are spread evenly."""
    x = x ^ (x >> np.uint64(31))
    x = x * BASE_B
    return x ^ (x >> np.uint64(29))


def sequence_hashes(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hash of each run of ``size`` items: sum of items times powers of ``base``, modulo 2**64."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, power, done = np.zeros(n, np.uint64), {1: h}, 0
    span, block = 1, h
    left = size
    while left:  # doubling: block holds the hashes of runs of ``span``
        if left & 1:
            shift = np.uint64(pow(int(base), done, 1 << 64))
            out += block[done : done + n] * shift
            done += span
        left >>= 1
        if left:
            block = block[: len(block) - span] + block[span:] * np.uint64(pow(int(base), span, 1 << 64))
            span *= 2
    return out


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of each run of ``size`` values."""
    span, block = 1, x
    while span * 2 <= size:
        block = np.minimum(block[: len(block) - span], block[span:])
        span *= 2
    n = len(x) - size + 1
    return np.minimum(block[:n], block[size - span : size - span + n])


def fragments(h: np.ndarray, window: int, gram: int):
    """Fragments of one text's word hashes: names, starts, window counts, content hashes and ``again``.

    A run ends where the least gram hash changes; longer runs are cut, so that a fragment has a bounded length.
    ``again`` marks fragments in which some gram occurs twice: only these can hold one window twice.
    """
    n = len(h) - window + 1
    if n <= 0:
        return None
    grams = mixed(sequence_hashes(h, gram, BASE_A))
    least = sliding_least(grams, window - gram + 1)
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(change[1:], n)
    longest = window - gram + 1
    if (ends - change > longest).any():
        parts = [np.arange(a, b, longest) for a, b in zip(change, ends)]
        change = np.concatenate(parts)
        ends = np.append(change[1:], n)
    count = ends - change
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h) * powers(len(h)), dtype=np.uint64)])
    sums = (prefix[change + count + window - 1] - prefix[change]) * inverse_powers(change)
    again = np.zeros(len(grams) + 1, np.int32)
    for apart in range(1, min(longest, len(grams))):
        same = grams[apart:] == grams[:-apart]
        if same.any():
            again[1 : len(grams) - apart + 1] |= same
    again = np.cumsum(again)
    again = again[change + count + window - gram] > again[change]
    return least[change], change, count, sums ^ count.astype(np.uint64), again


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_INVERSE = pow(int(BASE_B), -1, 1 << 64)


def _grow(key: str, base: int, n: int) -> np.ndarray:
    table = _POWERS[key]
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
        _POWERS[key] = table
    return table


def powers(n: int) -> np.ndarray:
    return _grow("up", int(BASE_B), n)[:n]


def inverse_powers(at: np.ndarray) -> np.ndarray:
    return _grow("down", _INVERSE, int(at.max()) + 1 if len(at) else 1)[at]


class WaveletMatrix:
    """Rank over a sequence of small integers: one packed bit vector per bit, with counts every 64 bits."""

    def __init__(self, values: np.ndarray, levels: int):
        self.n, self.levels, self.bits, self.counts, self.zeros = len(values), levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int32)
            self.bits.append(packed)
            self.counts.append(counts)
            self.zeros.append(len(bit) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` values, plus the place where the symbol's values begin."""
        for level in range(self.levels):
            word, off = at >> 6, (at & 63).astype(np.uint64)
            ones = self.counts[level][word] + np.bitwise_count(self.bits[level][word] & ((np.uint64(1) << off) - np.uint64(1)))
            up = (symbols >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(up, self.zeros[level] + ones, at - ones)
        return at


def packed_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs in lexicographic order."""
    key = a.astype(np.int64) * (int(b.max()) + 1) + b
    return np.unique(key, return_inverse=True)[1]


class FragmentIndex:
    """FM-index over fragments (arrays of word hashes) with weights; finds windows that occur twice or more."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, weights: np.ndarray, window: int):
        self.window, self.sizes = window, sizes
        symbols = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        ends = np.cumsum(sizes + 1)
        self.starts = ends - sizes - 1
        n = int(ends[-1])
        seq = np.zeros(n, np.int64)  # 0 ends each fragment
        seq[np.delete(np.arange(n), ends - 1)] = symbols
        self.seq = seq
        weight = np.repeat(weights, sizes + 1)
        # ranks of suffixes by their first window - 1 and window symbols, by doubling
        ranks, depth = seq, 1
        while depth * 2 <= window - 1:
            ranks = packed_pairs(ranks, self._shift(ranks, depth))
            depth *= 2
        short = packed_pairs(ranks, self._shift(ranks, window - 1 - depth)) if depth < window - 1 else ranks
        full = packed_pairs(short, self._shift(seq, window - 1))
        order = np.argsort(full, kind="stable")
        sorted_short = short[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_short[1:] != sorted_short[:-1], [True]]))
        which = np.cumsum(np.concatenate([[0], (sorted_short[1:] != sorted_short[:-1]).astype(np.int64)]))
        self.low, self.high = edge[which], edge[which + 1]
        self.mass = np.concatenate([[0], np.cumsum(weight[order])])
        before = seq[order - 1]
        levels = max(1, int(seq.max()).bit_length())
        self.matrix = WaveletMatrix(before, levels)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=1 << levels))])
        self.base = self.matrix.rank(np.arange(int(seq.max()) + 1), np.zeros(int(seq.max()) + 1, np.int64))

    @staticmethod
    def _shift(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Backward step: intervals of ``symbol`` followed by the current matches."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) - np.concatenate([self.base[symbol]] * 2)
        start = self.first[symbol]
        return start + both[: len(symbol)], start + both[len(symbol) :]

    def repeated(self) -> list[np.ndarray]:
        """Per fragment, the starts of its windows that occur twice or more, weights counted."""
        n, w = len(self.sizes), self.window
        order = np.argsort(-self.sizes, kind="stable")  # longest first: the active ones are a prefix
        sizes = self.sizes[order]
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.seq), np.int64)
        hits_fragment, hits_start = [], []
        for step in range(int(sizes[0]) if n else 0):
            active = int(np.searchsorted(-sizes, -step, side="left"))
            place = sizes[:active] - 1 - step
            a, b = self.extend(self.seq[self.starts[order[:active]] + place], lo[:active], hi[:active])
            if step >= w - 1:
                twice = self.mass[b] - self.mass[a] >= 2
                hits_fragment.append(order[:active][twice])
                hits_start.append(place[twice])
                a, b = self.low[a], self.high[a]
            lo[:active], hi[:active] = a, b
        if not hits_fragment:
            return [np.empty(0, np.int64)] * n
        fragment, start = np.concatenate(hits_fragment), np.concatenate(hits_start)
        by = np.lexsort((start, fragment))
        cuts, start = np.searchsorted(fragment[by], np.arange(n + 1)), start[by]
        return [start[cuts[i] : cuts[i + 1]] for i in range(n)]


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


FRAGMENT = "name long, hash long, text_id binary, start int, windows int, again boolean"


def _fragments_of(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row per fragment of each text."""

    def run(batches):
        from aerolith.llm.substring_dedup import WordHashes, fragments, to_signed

        hashes = WordHashes()
        schema = pa.schema([("name", pa.int64()), ("hash", pa.int64()), ("text_id", pa.binary()), ("start", pa.int32()), ("windows", pa.int32()), ("again", pa.bool_())])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out, ids = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    got = fragments(hashes(text.encode("utf-8", "surrogatepass").split()), window, gram)
                    if got is not None:
                        out.append(got)
                        ids += [key] * len(got[0])
                if out:
                    name, start, count, content, again = (np.concatenate([o[i] for o in out]) for i in range(5))
                    columns = [to_signed(name), to_signed(content), ids, start.astype(np.int32), count.astype(np.int32), again]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return map_batches(docs, run, FRAGMENT)


def _fragment_words(texts: DataFrame, window: int, split: bool) -> DataFrame:
    """Words (packed hashes) of the wanted fragments of each text; with ``split``, of each of their windows.

    ``texts``: text, wanted (array of name, hash, start, windows, weight). A window's shard is its own hash.
    """

    def run(batches):
        from aerolith.llm.substring_dedup import BASE_B, WordHashes, mixed, sequence_hashes, to_signed

        hashes = WordHashes()
        schema = pa.schema([("shard", pa.int64()), ("name", pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("weight", pa.int64()), ("words", pa.binary())])
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            fields = [lists.values.field(k).to_numpy() for k in range(5)]
            out, held = [[] for _ in schema], 0
            for i, text in enumerate(batch.column(0).to_pylist()):
                h = hashes(text.encode("utf-8", "surrogatepass").split())
                for name, digest, start, n, weight in zip(*(f[offsets[i] : offsets[i + 1]].tolist() for f in fields)):
                    part = h[start : start + n + window - 1]
                    if split:
                        for k, key in enumerate(to_signed(mixed(sequence_hashes(part, window, BASE_B))).tolist()):
                            for c, v in zip(out, (key, name, digest, k, weight, part[k : k + window].tobytes())):
                                c.append(v)
                    else:
                        for c, v in zip(out, (name, name, digest, -1, weight, part.tobytes())):
                            c.append(v)
                if len(out[0]) > EMIT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in schema]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    return map_batches(texts, run, "shard long, name long, hash long, place int, weight long, words binary")


def _search(words: DataFrame, window: int, block_words: int) -> DataFrame:
    """name, hash, place and starts of each row of ``words`` with repeated windows; rows of a shard come one after the other."""

    def run(batches):
        from aerolith.llm.substring_dedup import FragmentIndex

        schema = pa.schema([("name", pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("starts", pa.list_(pa.int32()))])

        def work(held):
            text = np.frombuffer(b"".join(r[4] for r in held), np.uint64)
            sizes = np.array([len(r[4]) // 8 for r in held], np.int64)
            found = FragmentIndex(text, sizes, np.array([r[3] for r in held], np.int64), window).repeated()
            out = [(r[0], r[1], r[2], s.astype(np.int32)) for r, s in zip(held, found) if len(s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        held, size, last = [], 0, None
        for batch in batches:
            for shard, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if shard != last and size >= block_words:
                    yield from work(held)
                    held, size = [], 0
                last = shard
                held.append(row)
                size += len(row[4]) // 8
        if held:
            yield from work(held)

    dealt = words.repartition("shard").sortWithinPartitions("shard", "name", "hash", "place")
    return map_batches(dealt, run, "name long, hash long, place int, starts array<int>")


def _once_per_task(texts: DataFrame) -> DataFrame:
    """text_id and text, each text at most once from each task, so that copies of one text do not meet in one task."""

    def run(batches):
        seen = set()
        for batch in batches:
            keep = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int32())) if len(keep) < batch.num_rows else batch

    return map_batches(texts.select("text_id", "text"), run, "text_id binary, text string")


def _kept(texts: DataFrame, window: int) -> DataFrame:
    """text_id, n_words, n_removed, kept_sha256 and removed ([start, end) word intervals) of each text with its window starts."""

    def run(batches):
        names = [("text_id", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.list_(pa.int32())))]
        schema = pa.schema(names)
        for batch in batches:
            out = [[] for _ in schema]
            for text_id, text, starts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.encode("utf-8", "surrogatepass").split()
                spans, kept, at = [], [], 0
                for s in sorted({s for part in starts or () for s in part}):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = s + window
                    else:
                        spans.append([s, s + window])
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                row = (text_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans)
                for c, v in zip(out, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    return map_batches(texts, run, "text_id binary, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>")


def substring_dedup(docs: DataFrame, window: int = 35, gram: int = 8, block_words: int = 300_000, hot: int = 2000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed word intervals of each row of ``docs``."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("text_id", F.unhex(F.md5("text")))
    pieces = materialise(_fragments_of(texts.select("text_id", "text"), window, gram), "fragments")
    # equal fragments first, then names: both sums combine before they are shuffled
    distinct = pieces.groupBy("name", "hash").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("text_id", "start", "windows")).alias("at"), F.max("again").alias("again"))
    names = distinct.groupBy("name").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max("again").alias("again"))
    names = names.where("total > 1 or again").drop("again")
    wanted = distinct.join(names, "name").select(
        F.col("at.text_id").alias("text_id"), (F.col("kinds") > hot).alias("hot"),
        F.struct("name", "hash", F.col("at.start").alias("start"), F.col("at.windows").alias("windows"), "weight").alias("f"),
    )
    wanted = materialise(wanted, "wanted")
    once = _once_per_task(texts).repartition("text_id")  # one exchange of the texts serves all joins below

    def words(part: DataFrame, split: bool) -> DataFrame:
        lists = part.groupBy("text_id").agg(F.collect_list("f").alias("wanted"))
        return _fragment_words(once.join(lists, "text_id").dropDuplicates(["text_id"]).select("text", "wanted"), window, split)

    searched = words(wanted.where("not hot"), False)
    if wanted.where("hot").isEmpty():
        found = _search(searched, window, block_words).select("name", "hash", "starts")
    else:
        single = materialise(words(wanted.where("hot"), True), "windows")
        kinds = single.groupBy("shard", "words").agg(F.sum("weight").alias("weight"))
        kinds = kinds.select("shard", F.col("shard").alias("name"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("place"), "weight", "words")
        got = materialise(_search(searched.unionByName(kinds), window, block_words), "found")
        whole = got.where("place < 0").select("name", "hash", "starts")
        hits = got.where("place = 0").select(F.col("name").alias("shard"))
        split = single.join(hits, "shard").groupBy("name", "hash").agg(F.collect_list("place").alias("starts"))
        found = whole.unionByName(split)
    back = pieces.select("name", "hash", "text_id", "start").join(found, ["name", "hash"])
    back = back.select("text_id", "start", F.transform("starts", lambda s: s + F.col("start")).alias("starts"))
    back = back.dropDuplicates(["text_id", "start"]).groupBy("text_id").agg(F.collect_list("starts").alias("starts"))
    kept = _kept(once.join(back, "text_id", "left").dropDuplicates(["text_id"]).select("text_id", "text", "starts"), window)
    return texts.select("doc_id", "text_id").join(kept, "text_id").select("doc_id", "n_words", "n_removed", "kept_sha256", "removed")
