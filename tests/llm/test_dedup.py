import collections
import hashlib
import itertools
import math
import random

import numpy as np
import xxhash

from aerolith.llm import simhash_dedup
from aerolith.llm.components import connected_components
from aerolith.llm.exact_dedup import chunks_of, drop_exact_copies, exact_groups
from aerolith.llm.line_dedup import common_blocks, increasing, line_dedup, patience, short_runs
from aerolith.llm.simhash_dedup import BKTree, as_words, drop_near_copies, family_links, pigeonhole_masks, set_links, shard_candidates, shard_links, shard_pairs, shard_search, simhash_groups
from aerolith.llm.substring_dedup import sequence_hashes, substring_dedup
from tests.llm.helpers import LONG, awkward, docs, empty


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def test_exact_groups(spark):
    got = collections.defaultdict(list)
    for r in exact_groups(awkward(spark)).collect():
        got[r.doc_id].append(r)
    assert got[1][0].keep_id == 4 and got[1][0].group_size == 3 and not got[1][0].kept and got[4][0].kept
    assert not got[None][0].kept
    assert got[3][0].keep_id == 3 and got[3][0].group_size == 3 and not any(r.kept for r in got[2])
    assert got[3][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.kept for r in got[7]) == [False, True]
    assert got[5][0].n_bytes == len(LONG) and got[5][0].n_chunks > 1
    assert exact_groups(empty(spark)).count() == 0


def test_drop_exact_copies_keeps_one_row_of_each_text(spark):
    kept = drop_exact_copies(awkward(spark))
    rows = kept.collect()
    assert kept.columns == awkward(spark).columns
    assert sorted((r.doc_id for r in rows), key=str) == [3, 4, 5, 6, 7]


def test_chunks_are_content_defined(spark):
    text = ". ".join(" ".join(prose(i, 30)) for i in range(80))
    df = spark.createDataFrame([(text,), ("inserted words. " + text,)], "text string")
    a, b = (r.c for r in df.select(chunks_of(df.text, 100, 2000).alias("c")).collect())
    assert "".join(a) == text and len(set(a) & set(b)) > len(a) // 2


def brute_simhash(rows, words=3):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        out[d] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    group = {d: d for d in out}
    for a, b in itertools.combinations(out, 2):
        if (out[a] ^ out[b]).bit_count() <= 3:
            ga, gb = group[a], group[b]
            group = {d: min(ga, gb) if g in (ga, gb) else g for d, g in group.items()}
    return out, group


def test_simhash_groups_equal_brute_force(spark):
    rng, rows = random.Random(3), [(1, None), (2, ""), (3, "one"), (4, "one two")]
    base = prose(0, 300)
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "x"
        rows.append((10 + i, " ".join(w)))
    rows += [(100 + i, " ".join(prose(50 + i, 40))) for i in range(20)]
    fp, group = brute_simhash(rows)
    got = {r.doc_id: r for r in simhash_groups(docs(spark, rows)).collect()}
    assert {d: int.from_bytes(r.fp, "big") for d, r in got.items()} == fp
    assert {d: r.component_id for d, r in got.items()} == group
    assert simhash_groups(empty(spark)).count() == 0
    assert simhash_groups(awkward(spark)).count() == 10


def test_masks_meet_all_pairs_within_the_radius():
    rng = random.Random(0)
    for n in (10, 5000, 10**6, 10**9, 10**12):
        masks = pigeonhole_masks(64, 3, n)
        assert n <= 2048 or abs(sum(m.bit_count() for m in masks) / len(masks) - math.log2(n / 2048)) < 4
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 3):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def numbers(values, size=8):
    return as_words([v.to_bytes(size, "big") for v in values])


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(16) for _ in range(300)] + [5] * 4
    tree = BKTree(numbers(values))
    for q in [*values[:40], 5]:
        _, at, d = tree.search(numbers([q]), 3)
        assert sorted(zip(at.tolist(), d.tolist())) == [(i, (v ^ q).bit_count()) for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]
    assert len(list(shard_links(numbers([5] * 50), None, 3, 50))) == 49
    assert not list(shard_links(numbers([]), None, 3, 0))


def test_bk_tree_prunes():
    """On evenly spread fingerprints far fewer nodes are met than there are."""
    rng = random.Random(2)
    tree, met = BKTree(numbers([rng.getrandbits(64) for _ in range(4000)])), []
    seen = simhash_dedup.distances
    simhash_dedup.distances = lambda a, b: (met.append(len(a)), seen(a, b))[1]
    try:
        tree.search(numbers([rng.getrandbits(64) for _ in range(100)]), 3)
    finally:
        simhash_dedup.distances = seen
    assert sum(met) < 0.35 * 100 * 4000


def test_shard_searches():
    rng = random.Random(4)
    values = [rng.getrandbits(128) & ~(3 << 60) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(128)) for v in values[:30]]
    near = {(i, j) for i, j in itertools.combinations(range(90), 2) if (values[i] ^ values[j]).bit_count() <= 2}
    sorted_pairs = lambda pairs: {(min(p), max(p)) for p in pairs}
    v = numbers(values, 16)
    assert sorted_pairs(shard_pairs(v, list(range(90)), 2, 90)) == near == sorted_pairs(shard_candidates(v, None, 2, 90))
    assert sorted_pairs(shard_pairs(v, [i % 2 for i in range(90)], 2, 90)) == {(i, j) for i, j in near if (i - j) % 2}
    assert sorted_pairs(shard_pairs(v, list(range(90)), 2, 60)) == {(i, j) for i, j in near if i < 60 <= j}
    alike = numbers([rng.getrandbits(3) << 9 | rng.getrandbits(4) for _ in range(3000)], 16)
    assert len(list(shard_candidates(alike, None, 36, 3000))) <= 3 * 3000 and not list(shard_candidates(v, None, 2, 60))
    two = list(shard_pairs(alike, [0] * 2900 + [1] * 60 + [2] * 40, 36, 3000))
    assert len(two) == 100 * 64 + 40 * 60


def test_drop_near_copies(spark):
    base = prose(9, 400)
    near = base[:200] + ["changed"] + base[201:]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(prose(10, 400))), (4, None), (5, ""), (None, " ".join(base))]
    kept = {r.doc_id for r in drop_near_copies(docs(spark, rows)).collect()}
    assert kept == {1, 3, 4}


def test_near_copies_are_dropped_row_by_row(spark):
    base, other = prose(9, 400), " ".join(prose(10, 400))
    near = " ".join(base[:200] + ["changed"] + base[201:])
    rows = [(1, " ".join(base)), (2, near), (2, other), (None, other + " end"), (None, "a clean text of its own"), (3, "x"), (3, "x")]
    kept = sorted((str(r.doc_id), r.text) for r in drop_near_copies(docs(spark, rows)).collect())
    assert kept == sorted([("1", " ".join(base)), ("2", other), ("None", "a clean text of its own"), ("3", "x")])


def test_large_shards_are_searched_in_blocks(spark):
    rng = random.Random(5)
    fps = sorted({(7 << 40) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(200)})
    nodes = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")),) * 2 + (bytearray(),) for f in fps], "fp binary, key binary, label binary")
    want = connected_components(shard_search(nodes, [0], 64, shard_links, 2))
    got = connected_components(shard_search(nodes, [0], 64, shard_links, 2, block=20))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == len(fps)
    every = {tuple(r) for r in shard_search(nodes.withColumn("label", nodes["key"]), [0], 64, shard_pairs, 2, block=20).collect()}
    assert len(every) == sum((a ^ b).bit_count() <= 2 for a, b in itertools.combinations(fps, 2))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_passages(rows, window):
    count, texts = collections.Counter(), [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in texts:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = {}
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()
    return out


def test_passages_equal_brute_force(spark):
    shared, rows = prose(1, 90), [(1, None), (2, ""), (3, " ".join(["same"] * 80)), (4, " ".join(prose(2, 34))), (5, " ".join(["ab", "cd"] * 60))]
    for i in range(30):
        a, b = prose(20 + i, 40), prose(60 + i, 25)
        rows.append((10 + i, " ".join(a + shared[i % 3 * 15 : 60 + i % 5 * 6] + b)))
    rows += [(60, rows[7][1]), (61, " ".join(prose(22, 40)))]
    want = brute_passages(rows, 35)
    for how in ({}, {"hot": 2}, {"block_words": 100}):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs(spark, rows), **how).collect()}
        assert got == want
    assert substring_dedup(empty(spark)).count() == 0
    assert substring_dedup(awkward(spark)).count() == 10


def test_sequence_hashes():
    import numpy as np

    h = np.arange(1, 40, dtype=np.uint64)
    for size in (1, 5, 8, 35):
        got = sequence_hashes(h, size, np.uint64(3))
        assert got.tolist() == [sum(int(h[i + j]) * 3**j for j in range(size)) % 2**64 for i in range(len(h) - size + 1)]


def test_patience():
    a, b = [1, 2, 3, 4, 5, 9, 9, 6], [0, 2, 3, 7, 5, 9, 9, 8]
    assert patience(a, b) == [(1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    assert [5, 1, 6, 2, 7][increasing([5, 1, 6, 2, 7])[0]] in (1, 5) and len(increasing([5, 1, 6, 2, 7])) == 3
    assert patience([], [1]) == [] and patience([1, 5, 5, 2], [3, 5, 5, 4]) == [(1, 1), (2, 2)]


def runs_in_common(a, b, least):
    """Positions of the lines ``a`` in runs of ``least`` characters or more that ``b`` has as consecutive lines too."""
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (not i or not j or a[i - 1] != b[j - 1]):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                if sum(map(len, a[i : i + k])) >= least:
                    gone.update(range(i, i + k))
    return gone


def hashed(lines):
    return np.array([hash(x) % 2**60 for x in lines], np.uint64), np.array(list(map(len, lines)), np.int32)


def test_blocks_of_a_pair_equal_brute_force():
    rng = random.Random(6)
    pool = ["", "x", "a short one", "twelve chars", "a line of just over twenty-four", "y" * 30, "another that is long enough by itself"]
    for _ in range(400):
        a, b = ([rng.choice(pool) for _ in range(rng.randint(1, 14))] for _ in "ab")
        for least in (1, 24, 40):
            assert common_blocks(*hashed(a), *hashed(b), least) == sorted(runs_in_common(a, b, least)), (a, b, least)
    moved = ["p" * 30, "q" * 30, "r" * 30], ["r" * 30, "q" * 30, "p" * 30]
    assert common_blocks(*hashed(moved[0]), *hashed(moved[1]), 24) == [0, 1, 2]
    assert [x.tolist() for x in short_runs(*hashed(["ab", "c", "def"]), 3)[0][:2]] == [[0, 1, 2], [2, 3, 3]]


def brute_lines(rows, least):
    own = sorted({(d is not None, d or 0, hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).digest(), t or "") for d, t in rows})
    out = {}
    for k, (some, d, _, t) in enumerate(own):
        lines, gone = t.split("\n"), set()
        for e in own[:k]:
            gone |= runs_in_common(lines, e[3].split("\n"), least)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[d if some else None, t] = len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return sorted((out[d, t or ""] for d, t in rows), key=str)


def line_rows():
    rng = random.Random(8)
    pool = [f"short {i}" for i in range(6)] + [f"a line that is long enough, number {i}" for i in range(30)] + ["", "the one that everybody has at the end"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(70)]
    rows += [(100 + i, "\n".join([f"text {i}", *pool[:6][:: 1 if i % 2 else -1], "the one that everybody has at the end"])) for i in range(50)]
    rows += [(200, "\n".join(f"twenty characters {k:02}" for k in range(12))), (201, "\n".join(f"twenty characters {k:02}" for k in range(12)) + "\nend")]
    return rows + [(None, rows[3][1]), (None, None), (300, None), (301, ""), (3, "another text of a known id\n" + rows[5][1]), rows[7], rows[7]]


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    want = brute_lines(rows, 24)
    assert sum(r[1] > 0 for r in want) > 60
    for rare in (2, 32):
        got = line_dedup(docs(spark, rows), rare=rare).collect()
        assert sorted(((r.n_lines, r.n_removed, r.kept_sha256) for r in got), key=str) == want


def test_line_dedup(spark):
    block = "a shared line that is long enough\nand a second one of the same block"
    rows = [(1, f"first text\n{block}\nend one"), (2, f"other beginning\n{block}\nend two"), (3, "nothing in common"), (4, None), (5, ""), (6, block)]
    got = {r.doc_id: r for r in line_dedup(docs(spark, rows, repeat=[(6, block)])).collect()}
    assert got[1].n_removed == 0 and got[2].removed == [1, 2] and got[2].kept == "other beginning\nend two"
    assert got[6].n_removed == 2 and got[6].kept == "" and got[3].n_removed == got[4].n_removed == 0 and got[4].n_lines == 1
    assert line_dedup(empty(spark)).count() == 0 and line_dedup(awkward(spark)).count() == 10


def test_near_copies_equal_exact_jaccard(spark):
    rng, rows = random.Random(11), []
    for f in range(40):  # a base text, and one whose words are changed in a few places: similarities on both sides of 0.8
        base = [f"b{f}x{rng.randrange(5000)}" for _ in range(120)]
        near = list(base)
        for at in rng.sample(range(5, 115), 1 + f % 6):
            near[at] = f"new{f}x{at}"
        rows += [(2 * f, " ".join(base)), (2 * f + 1, " ".join(near))]
    body = prose(77, 60)
    rows += [(200, " ".join(body + prose(78, 3) * 60)), (201, " ".join(body + prose(78, 3)))]  # repeats are one shingle each
    rows += [(202, " ".join(prose(79, 60) + ["a b c d e"] * 400)), (203, " ".join(prose(80, 60) + ["a b c d e"] * 400))]

    def shingles(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {d: shingles(t) for d, t in rows}
    lost, group = set(), {d: d for d in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            group[b] = group[a]
    lost = {d for d, g in group.items() if g != d}
    assert 10 < len(lost) < 35
    assert {r.doc_id for r in drop_near_copies(docs(spark, rows)).collect()} == set(sets) - lost


def test_the_one_near_copy_among_many_almost_near_texts_is_found(spark):
    """Two texts at a similarity of exactly 0.8, each with 1,500 others at 0.79 that have no near copy."""
    rng, new = random.Random(3), itertools.count()

    def changed(words, starts):
        return [f"n{next(new)}" if i in starts else w for i, w in enumerate(words)]

    base = [f"w{i}" for i in range(184)]
    twin = changed(base, {20, 60, 100, 140})
    rows = [(0, " ".join(base)), (1, " ".join(twin))]
    for i in range(3000):
        a, b, c, d = rng.sample(range(10, 170, 10), 4)
        rows.append((2 + i, " ".join(changed((base, twin)[i % 2], {a, a + 1, b, c, d}))))
    assert {r[0] for r in rows} - {r.doc_id for r in drop_near_copies(docs(spark, rows)).collect()} == {1}


def test_links_of_a_family_equal_brute_force():
    rng = random.Random(4)
    for n in (1, 2, 60, 200):
        base = rng.sample(range(10**6), 60)
        sets = [np.array(sorted({x if rng.random() > i / n / 4 else rng.randrange(10**6) for x in base}), np.uint64) for i in range(n)] + [np.empty(0, np.uint64)]
        have = [set(x.tolist()) for x in sets]
        near = {(i, j) for i, j in itertools.combinations(range(n + 1), 2) if len(have[i] & have[j]) >= 0.8 * len(have[i] | have[j])}
        links = {(min(p), max(p)) for p in family_links(sets, 0.8)}
        assert links <= near and joined(n + 1, links) == joined(n + 1, near) and len(links) <= n


def joined(n, links):
    group = list(range(n))
    for a, b in links:
        group = [group[a] if g == group[b] else g for g in group]
    return {frozenset(i for i in range(n) if group[i] == g) for g in group}


def test_large_families_are_judged_in_blocks(spark):
    rng, base = random.Random(6), list(range(60))
    sets = [sorted({x if rng.random() > i / 400 else rng.randrange(10**6) for x in base}) for i in range(100)]
    rows = [(bytearray(b"f"), bytearray(b"%03d" % i), bytearray(np.array(x, "<u8").tobytes())) for i, x in enumerate(sets)]
    families = spark.createDataFrame(rows, "family binary, key binary, shingles binary")
    want = joined(100, list(family_links([np.array(x, np.uint64) for x in sets], 0.8)))
    for how in ({}, {"most": 7}, {"most_bytes": 9000}):
        assert joined(100, [(int(r.a), int(r.b)) for r in set_links(families, 0.8, **how).collect()]) == want
    assert 1 < len(want) < 90
