"""Line dedup by pairwise alignment (operator 5).

A line goes if it stands in a run of consecutive lines with ``min_chars`` characters or more in all that an earlier
document holds as well, line for line.

1. Seeds. A document's seeds are the hashes of its shortest runs of ``min_chars`` characters: from each line onwards and
   up to each line backwards (a single line, if it is long enough). Any run that two documents share is covered by seeds
   that they share.
2. Rare seeds (at most ``rare`` holders) link each holder to the seed's first holder. A linked pair is aligned by
   patience diff on the seeds at each line: common beginnings and ends are matched, seeds that occur once in both texts
   and keep their order (longest increasing subsequence) are anchors, gaps between anchors are aligned in the same way,
   and in a gap without any the first seed that the other text has is one. A match grows to the longest common block
   around it, and blocks are deleted from the later document. What is left is aligned again until no seed of the pair is
   left, so blocks that changed places are found too.
3. Frequent seeds, which more documents share than are worth a pair each, need no partner: they are deleted wherever they
   stand, but for their first holder. No pairs of holders are listed, and the result does not depend on ``rare``.

Documents are ordered by doc_id, null first, then by text hash. Defined results: null and empty texts have one empty
line and lose nothing; rows with the same doc_id and text are one document and share its result; documents with one
doc_id and different texts are different documents; an empty table gives no rows; a document's own repeated lines are
not touched; blank lines go with a run that they stand in; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import join_by_size, map_batches, materialise, text_or_empty
from aerolith.llm.substring_dedup import inverse_powers, mixed, powers


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64)


def short_runs(hashes: np.ndarray, sizes: np.ndarray, least: int):
    """Starts, ends and hashes of the shortest runs of ``least`` characters that begin at each line and that end at each line.

    Lines too near an end of the text have none.
    """
    n = len(hashes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes) * powers(n), dtype=np.uint64)])
    ends = np.searchsorted(upto, upto[:-1] + least)
    starts = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    found = []
    for a, b in ((np.arange(n), ends), (starts, np.arange(1, n + 1))):
        ok = (a >= 0) & (b <= n)
        a, b = a[ok], b[ok]
        found.append((a, b, (sums[b] - sums[a]) * inverse_powers(a) ^ (b - a).astype(np.uint64)))
    return found


def increasing(places: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence of ``places``, by piles of least ends."""
    tops, at, back = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        tops[k : k + 1] = [p]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], rising in both; some, if the two share anything."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        pairs = [(i, once[x]) for i, x in enumerate(a[a0:a1], a0) if x in once]
        anchors = [pairs[k] for k in increasing([j for _, j in pairs])]
        if not anchors:
            anchors = [(i, b.index(x, b0, b1)) for i, x in enumerate(a[a0:a1], a0) if x in in_b][:1]
            if not anchors:
                continue
        for i, j in [*anchors, (a1, b1)]:
            if i > a0 and j > b0:
                todo.append((a0, i, b0, j))
            if i < a1:
                out.append((i, j))
            a0, b0 = i + 1, j + 1
    return sorted(out)


def seeds_at(hashes: np.ndarray, sizes: np.ndarray, least: int, side: str) -> tuple[list, list]:
    """The seed that begins at each line and its end; lines without one have a token that equals no other."""
    starts, ends, names = short_runs(hashes, sizes, least)[0]
    tokens, upto = [(side, i) for i in range(len(hashes))], [0] * len(hashes)
    for i, e, x in zip(starts.tolist(), ends.tolist(), names.tolist()):
        tokens[i], upto[i] = x, e
    return tokens, upto


def common_blocks(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, least: int) -> list[int]:
    """Positions of ``a`` in runs of lines, ``least`` characters or more, that ``b`` has too."""
    n, gone = len(a), np.zeros(len(a), bool)
    for turn in (1, -1):  # seeds that begin at each line, then, read backwards, those that end there
        x, y, lost = a[::turn], b[::turn], gone[::turn]
        xs, ys = x.tolist(), y.tolist()
        tokens, upto = seeds_at(x, a_sizes[::turn], least, "a")
        theirs, _ = seeds_at(y, b_sizes[::turn], least, "b")
        known = set(theirs)
        while True:
            left = [t if t in known and not lost[i : upto[i]].all() else ("done", i) for i, t in enumerate(tokens)]
            matches = patience(left, theirs)
            if not matches:
                break
            for i, j in matches:
                if not lost[i : upto[i]].all():
                    lo, hi = 0, upto[i] - i
                    while i > lo and j > lo and xs[i - lo - 1] == ys[j - lo - 1]:
                        lo += 1
                    while i + hi < n and j + hi < len(ys) and xs[i + hi] == ys[j + hi]:
                        hi += 1
                    lost[i - lo : i + hi] = True
    return np.flatnonzero(gone).tolist()


def _lines(texts: DataFrame, least: int) -> DataFrame:
    """key, doc_id, and hashes, sizes and distinct seeds of the lines of each text."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("seeds", pa.list_(pa.int64()))])

    def run(batches):
        from aerolith.llm.line_dedup import line_hashes, short_runs

        for batch in batches:
            hashes, sizes, seeds = [], [], []
            for text in batch.column(2).to_pylist():
                lines = text.split("\n")
                h, n = line_hashes(lines), np.array(list(map(len, lines)), np.int32)
                hashes.append(h.view(np.int64))
                sizes.append(n)
                seeds.append(np.unique(np.concatenate([r[2] for r in short_runs(h, n, least)])).view(np.int64))
            columns = [batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip((hashes, sizes, seeds), list(schema)[2:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_batches(texts.select("key", "doc_id", "text"), run, "key binary, doc_id long, hashes array<long>, sizes array<int>, seeds array<long>")


def _align(pairs: DataFrame, least: int) -> DataFrame:
    """key and lines to delete of each aligned pair (key, a, a_sizes, b, b_sizes) that has any."""
    schema = pa.schema([("key", pa.binary()), ("lines", pa.list_(pa.int32()))])

    def run(batches):
        from aerolith.llm.line_dedup import common_blocks

        for batch in batches:
            keys, lines = [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                a, n, b, m = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 5))
                found = common_blocks(a.view(np.uint64), n, b.view(np.uint64), m, least)
                if found:
                    keys.append(key)
                    lines.append(found)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], schema=schema)

    return map_batches(pairs.select("key", "a", "a_sizes", "b", "b_sizes"), run, "key binary, lines array<int>")


def _cut(rows: DataFrame, least: int) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256, removed and kept text of each row (doc_id, text, lines, seeds)."""
    names = [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int32())), ("kept", pa.string())]
    schema = pa.schema(names)

    def run(batches):
        from aerolith.llm.line_dedup import line_hashes, short_runs

        for batch in batches:
            out = [[] for _ in schema]
            for doc_id, text, aligned, seeds in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines = text.split("\n")
                gone = set(aligned or ())
                if seeds:
                    common = np.array(seeds, np.int64).view(np.uint64)
                    for starts, ends, found in short_runs(line_hashes(lines), np.array(list(map(len, lines)), np.int32), least):
                        hit = np.isin(found, common)
                        for a, b in zip(starts[hit].tolist(), ends[hit].tolist()):
                            gone.update(range(a, b))
                kept = "\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text
                row = (doc_id, len(lines), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), sorted(gone), kept)
                for c, v in zip(out, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    return map_batches(rows, run, "doc_id long, n_lines long, n_removed long, kept_sha256 string, removed array<int>, kept string")


def line_dedup(docs: DataFrame, min_chars: int = 24, rare: int = 32) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256, removed (line numbers from 0) and kept (text) of each row of ``docs``.

    ``rare`` only decides which way a seed takes, by alignment or by itself.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    texts = texts.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("text")))))
    one = materialise(_lines(texts, min_chars).dropDuplicates(["key"]), "lines")
    holds = materialise(one.select(F.struct("doc_id", "key").alias("doc"), F.explode("seeds").alias("seed")), "holds")
    shared = holds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).where("n > 1")
    met = join_by_size(holds, materialise(shared, "shared"), "seed", "n").where("doc <> first")
    met = materialise(met.select(F.col("doc.key").alias("key"), F.col("first.key").alias("earlier"), "seed", "n"), "met")
    pairs = materialise(met.where(F.col("n") <= rare).select("key", "earlier").distinct(), "pairs")
    a = one.select("key", F.col("hashes").alias("a"), F.col("sizes").alias("a_sizes"))
    b = one.select(F.col("key").alias("earlier"), F.col("hashes").alias("b"), F.col("sizes").alias("b_sizes"))
    aligned = _align(pairs.join(b, "earlier").join(a, "key"), min_chars)
    alone = met.where(F.col("n") > rare).groupBy("key").agg(F.collect_list("seed").alias("seeds"))
    none = lambda t: F.lit(None).cast(t)
    cut = aligned.select("key", "lines", none("array<bigint>").alias("seeds")).unionByName(alone.select("key", none("array<int>").alias("lines"), "seeds"))
    cut = cut.groupBy("key").agg(F.flatten(F.collect_list("lines")).alias("lines"), F.flatten(F.collect_list("seeds")).alias("seeds"))
    return _cut(texts.join(cut, "key", "left").select("doc_id", "text", "lines", "seeds"), min_chars)
