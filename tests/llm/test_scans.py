import collections
import math
import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from aerolith.llm.hilbert_ann import Orderings, choose, hilbert_keys, nearest
from aerolith.llm.license_scan import KNOWN, license_scan
from aerolith.llm.mixing import fit_exponent, mix, mixture, source_totals
from aerolith.llm.toxicity import PRIOR, LexiconAutomaton, Scorer, drop_toxic, fit_logistic, held_out_rows, score_texts, stems_of, toxicity
from tests.llm.helpers import awkward, docs, empty


def test_license_scan(spark):
    mit = "Copyright (c) 2020 Some One\nPermission is hereby granted, free of charge, to any person"
    rows = [(1, "Licensed under the Apache Licence, Version 2.0!"), (2, "Some text\n*  Released under the MIT license *\nmore"), (3, None), (4, ""), (5, mit), (6, "Copyright 2021 X\nreleased under the MIT License.")]
    got = {r.doc_id: r for r in license_scan(docs(spark, rows, repeat=[rows[0]])).collect()}
    assert got[1].license_id == "Apache-2.0" and got[2].license_id is None and got[2].license_ids == "MIT" and got[2].n_license_units == 1
    assert got[6].license_id == "MIT" and got[5].license_id is None and got[3].license_id is None and got[3].digest == got[4].digest
    known = dict((i, t) for i, t in KNOWN[::-1])
    wrapped = known["MIT"].replace(" Software", "\nSoftware").replace("\n\n", "\n \n\n")
    rows = [(1, f"Tool\n\nMIT License\n\nCopyright (c) 2024 A B\n\n{wrapped}\n\nx = 1"), (2, "# " + known["BSD-3-Clause"].replace("\n\n2.", "\n2.").replace("\n\n3.", "\n3.") + "\n\n\nend"), (3, known["Zlib"].replace("acknowledgment", "acknowledgement")),
            (4, known["Unlicense"].rsplit("\n\n", 1)[0]), (5, "before\n\n" + known["BSL-1.0"]), (6, "\n\n".join([known["0BSD"], known["ISC"]])), (7, known["BSD-2-Clause"] + "\n\nand more")]
    got = {r.doc_id: r for r in license_scan(docs(spark, rows)).collect()}
    assert got[1].license_ids == "MIT" and got[1].n_license_units == 2 and got[1].license_id is None  # with and without its title
    assert got[2].license_ids == "BSD-3-Clause" and got[3].license_id == "Zlib" and got[4].license_ids == "" and got[5].license_ids == "BSL-1.0"
    assert got[6].license_ids == "0BSD,ISC" and got[7].license_ids == "BSD-2-Clause"
    long = "/usr/share/common-licenses/Apache-2.0"
    if os.path.exists(long):
        text = open(long, encoding="utf-8").read()
        found = license_scan(docs(spark, [(1, text), (2, f"Notice\n\n{text}\n\nend"), (3, text[:-200])])).collect()
        assert {r.doc_id: (r.license_id, r.license_ids) for r in found} == {1: ("Apache-2.0", "Apache-2.0"), 2: (None, "Apache-2.0"), 3: (None, "")}
    own = spark.createDataFrame([("X", "Foo, BAR"), (None, "a"), ("Y", "!!"), ("W", "foo bar")], "license_id string, text string")
    assert license_scan(docs(spark, [(1, "foo bar!")]), own).first().license_id == "W"
    assert license_scan(empty(spark)).count() == 0 and license_scan(awkward(spark)).count() == 10


def test_hilbert_keys_visit_all_cells_in_steps():
    n, bits = 3, 2
    cells = np.array(np.meshgrid(*[range(1 << bits)] * n, indexing="ij")).reshape(n, -1).T
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(1 << bits * n))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_large_tables_without_contrast_are_cut_into_many_ranges():
    rng = np.random.default_rng(2)
    for n in (2000, 6000):
        x = rng.normal(size=(n, 32))
        d = (x[:100] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[:100] @ x.T
        near = np.argsort(d, axis=1)[:, 1:11].ravel()
        turn = Orderings(32, 0.0, 1.0, 24, 10, 6, 7)
        keys = [turn.keys(x, o) for o in range(24)]
        share, borders = choose(keys, [k[:100] for k in keys], [k[near] for k in keys], np.repeat(np.arange(100), 10), 0.98)
        assert share >= 0.98 and (len(borders[0]) > 1) == (n == 6000)


def brute(vectors, k):
    out = {}
    for q, x in vectors.items():
        if q % 10 == 0:
            d = sorted((math.dist(x, y), v) for v, y in vectors.items() if v != q)
            out[q] = [(v, s) for s, v in d[:k]]
    return out


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=8).astype(np.float32).astype(float).tolist() for i in range(400)}
    vectors |= {i: vectors[7] for i in range(400, 460)}
    vectors |= {500: vectors[20]}
    rows = [(i, v, 0) for i, v in vectors.items()]
    bad = [(600, None, 0), (610, [0.0] * 8, 0), (620, [float("nan")] + [1.0] * 7, 0), (630, [None] + [1.0] * 7, 0), (640, [], 0), (650, [1.0] * 7, 0), (None, [1.0] * 8, 0), (660, [float("inf")] + [1.0] * 7, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, entry int")
    got = collections.defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(vectors, 5)
    assert set(got) == set(want)
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    assert got[400] == want[400] and all(abs(dict(want[q]).get(v, s) - s) < 1e-12 for q in got for v, s in got[q])
    assert nearest(df.where("vec_id in (10, 11, 610)"), F.col("vec_id") % 10 == 0).collect()[0].vec_id == 11
    assert nearest(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def mix_rows():
    rows = [(i, "w " * (5 + i % 7), "big") for i in range(3000)] + [(5000 + i, "w " * 10, "small") for i in range(300)]
    return rows + [(9000, None, None), (9001, "", "none")]


def test_mixture_meets_its_limits(spark):
    out = mixture(docs(spark, mix_rows()), max_epochs=2.0).collect()
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in out:
        assert r.copies >= 1
        by[r.source][0] += r.n_tokens
        by[r.source][1] += r.n_tokens * r.copies
        by[r.source][2] = r.epochs
    for tokens, mixed, epochs in by.values():
        assert epochs <= 2.000001 and tokens * epochs - 10 <= mixed <= tokens * epochs + 1e-3 * tokens
    budget = mixture(docs(spark, mix_rows()), max_epochs=None, entropy=0.9, budget=10_000).collect()
    assert 9_900 <= sum(r.n_tokens * r.copies for r in budget) <= 10_001
    assert abs(sum({r.source: r.weight for r in budget}.values()) - 1) < 1e-5
    assert mixture(empty(spark)).count() == 0


def test_exponent_meets_entropy(spark):
    totals = spark.createDataFrame([("a", 900, 1), ("b", 90, 1), ("c", 10, 1), ("d", 0, 1)], "source string, tokens long, n_rows long")
    a = fit_exponent(totals, entropy=0.95)
    p = np.array([900, 90, 10]) ** a
    p = p / p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.95 * math.log(3)) < 1e-6
    assert fit_exponent(totals, max_epochs=1000.0) == 0.0 and source_totals(docs_rows(spark)).count() == 1


def docs_rows(spark):
    return spark.createDataFrame([("a", 1), ("a", 2)], "source string, n_tokens long")


def test_mix_keeps_all_rows_and_columns(spark):
    d = docs(spark, mix_rows() + [(None, "null id", "small")])
    twins = docs(spark, [(1, "one two", "small"), (1, "three", "big"), (1, "three", "big"), (2, "x " * 40, "big")])
    assert sorted(r.text for r in mix(twins, max_epochs=1000.0).select("text").distinct().collect()) == ["one two", "three", "x " * 40]
    assert sum(r.copies * r.n_tokens for r in mixture(twins, max_epochs=1000.0).collect()) == sum(len(r.text.split()) for r in mix(twins, max_epochs=1000.0).collect())
    m = mix(d, max_epochs=2.0)
    assert m.columns == d.columns and m.select("doc_id").distinct().count() == d.select("doc_id").distinct().count() and m.count() > d.count()


def test_automaton_equals_edit_distance():
    terms = {"idiot": 5.0, "worthless": 5.0, "scum": 5.0, "moron": 4.0}
    auto = LexiconAutomaton(terms, limit=50)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    allowed = {"idiot": 1, "worthless": 2, "scum": 0, "moron": 1}
    for w in ["idiot", "idi0t", "iidiot", "idit", "wrthles", "worthles5", "wxrxhxess", "scum", "scam", "moroon", "morxxn", "clean", "", "i"]:
        near = min(((edits(w, t), t) for t in terms if edits(w, t) <= allowed[t]), default=None)
        got = auto.find(w)
        assert (got is None) == (near is None) and (got is None or got[0] == near[0]), w


def plain_score(text, model):
    """The score by definition: edit distances of each word to every term, one by one."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    tokens, counts, best = text.split(), {"plain": 0, "misspelt": 0, "stem": 0, "quoted": 0}, 0.0
    for i, token in enumerate(tokens):
        word = re.sub(r"^\W+|\W+$", "", token.lower())
        word = re.sub(r"(.)\1{2,}", r"\1", word) if len(word) > 3 else word
        if not word:
            continue
        kind = "plain" if word in model["terms"] else None
        if kind is None and word not in model["clean"]:
            near = [t for t in model["terms"] if t not in model["exact_only"] and edits(word, t) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)]
            kind = "misspelt" if near else None
        if kind is None:
            counts["stem"] += any(word.startswith(s) for s in model["stems"])
        elif Scorer.quoted(tokens, i):
            counts["quoted"] += 1
        else:
            counts[kind] += 1
            best = max(best, model["terms"][word]) if kind == "plain" else best
    x = [1, counts["plain"] > 0, *(math.log2(1 + counts[k]) for k in ("plain", "misspelt", "stem", "quoted")), best / 8, max(0, best - 5.5) / 2]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model["weights"], x))))


def test_scores_equal_brute_force(spark):
    rng = random.Random(12)
    terms = {"idiot": 7.0, "worthless": 6.0, "scum": 5.0, "moron": 4.5, "blockhead": 6.5, "loweiheit": 3.0}
    model = {"terms": terms, "stems": ["lowei"], "exact_only": ["moron"], "clean": ["idiom"], "weights": PRIOR.tolist()}
    words = [*terms, "idi0t", "idiom", "moran", "wortless", "bl0ckhed", "scam", "loweiung", "flower", "said", '"quoted', 'end"', "IDIOT!!", "moooron", "…", "a" * 60]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(400, None), (401, "idiot " * 500)]
    got = {r.doc_id: r.score for r in score_texts(docs(spark, rows), model).collect()}
    assert all(abs(got[i] - plain_score(t or "", model)) < 1e-9 for i, t in rows)
    assert Scorer(model).features("idiot " * 500) > Scorer(model).features("idiot " * 5)


def test_toxic_rows_go_row_by_row(spark):
    rows, labels = [], []
    for i in range(600):
        filler = " ".join(f"w{(i * 7 + j * 13) % 50}" for j in range(12))
        rows.append((i, f"{filler} {'blockhead' if i % 3 == 0 else 'flower'} {filler[::-1]}"))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(3, "a clean text about gardens"), (None, "you blockhead"), (None, "a clean text of no number"), (1, "a blockhead of its own"), (None, None)]
    kept = drop_toxic(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert got == {r for r in rows if "blockhead" not in (r[1] or "")} and kept.columns == docs(spark, rows[:1]).columns


def test_quotation_counts_less():
    s = Scorer({"terms": {"idiot": 7.0}})
    assert s.score("you are an idiot and that is all") > 0.7 > s.score('the article said "idiot" is an old word of the language')
    assert s.score("you idi0t of a man") > 0.5 and s.score("") == s.score("nothing here") < 0.1
    assert stems_of({"abcx": 1, "abcy": 1, "abcz": 1, "abcw": 1, "q": 1}) == ["abc"]


def test_toxicity_learns_and_holds_out(spark):
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        filler = " ".join(f"w{(i * 7 + j * 13) % 50}" for j in range(12))
        rows.append((i, f"{filler} {'blockhead' if bad else 'flower'} {filler[::-1]}"))
        labels.append((i, 1, int(bad)))
    d = docs(spark, rows + [(2000, None), (2001, ""), (2002, "you bl0ckhead there"), (None, "x")])
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(d, lab).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(900) if got[i].held_out)
    assert got[2000].predicted == 0 and got[2000].score == got[2001].score and got[2002].score > got[2001].score
    kept = {r.doc_id for r in drop_toxic(d, lab).select("doc_id").collect()}
    assert None in kept and 1 in kept and 3 not in kept
    assert toxicity(empty(spark), lab).count() == 0 and toxicity(awkward(spark), lab.where("false")).count() == 10
    assert d.where(held_out_rows(F.col("doc_id"))).count() > 200


def test_fit_logistic_keeps_to_the_prior_without_data():
    prior = np.array([1.0, -2.0])
    assert np.allclose(fit_logistic(np.zeros((0, 2)), np.zeros(0), prior), prior)
