"""Toxicity scores from a lexicon trie met by a Levenshtein automaton (operator 10).

Learning, on a bounded sample of labelled rows that are not held out:

1. lexicon: words that are far more frequent among toxic samples, by more than chance brings about among as many words (a
   likelihood-ratio test that allows for the number of words tried). A word counts once for each different context
   (neighbouring words) of its first place in a text, so that copies of one toxic text do not make terms of its words;
2. stems: beginnings shared by several words that lean to toxic samples (each alone too rare for the test), held to the
   same test on the documents that have any word with them;
3. weights: a small logistic model over logarithms of hit counts, kept near prior weights where the sample says little.

The sample's size (``per_class``) is the only bound; words, terms, stems and hits are taken whatever their length or number.

Scoring, over every whole text: each distinct word runs through a deterministic automaton made lazily from the product
of the lexicon's trie and a Levenshtein automaton (0 edits for terms under 5 letters, 1 from 5, 2 from 9). Its states
are sets of (trie node, edits so far); most words reach the dead state within a few letters. Every hit is weighed by the
words around it: quotation marks on both sides and reporting words make it a quotation, which counts far less.

Defined results: null, empty and word-less texts get the score of a text without hits; repeated rows and rows that share
a doc_id are scored row by row, each by its own text; equal texts get equal scores; a null doc_id is never a training row
and is held out as crc32 of nothing is null; a label joins all rows with its doc_id; no usable labels: the lexicon is
empty and every score is the prior's; an empty table gives no rows; columns other than doc_id and text, whatever their
names, are ignored by :func:`toxicity` and kept by :func:`drop_toxic`.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import Memo, map_batches, map_rows, materialise, text_or_empty

EDGE = re.compile(r"^\W+|\W+$")
RUNS = re.compile(r"(.)\1{2,}")
QUOTES = set("\"“”«»„‟‘’‹›`")
#: Fixed words that report speech or speak of a word, in the corpora's languages.
REPORTING = frozenset(
    "said says wrote writes called quoted quote quotes word words term means meaning asked replied stated according "
    "sagte schrieb wort dit mot écrit dijo palabra escribió".split()
)
WINDOW = 6
#: Prior weights of: bias, any plain hit, the logarithms (base 2, of 1 more) of plain, misspelt, stem-only and quoted hits,
#: strongest plain hit in units of 8, and how far that hit's log odds pass 5.5, the evidence of a term that hardly ever
#: occurs in clean texts.
PRIOR = np.array([-3.0, 3.0, 1.0, 3.5, 3.0, 0.3, 1.0, 2.0])
SURE = 5.5
#: Log odds that a term or stem has at least.
LEAST_ODDS = 2.5
#: Share of the logarithm of the number of words tried that a term's likelihood ratio must reach; at 1 less than one false
#: term is expected even if all words were independent.
STRICT = 0.8


def clean(token: str) -> str:
    """Lower-cased word without outer punctuation; letters repeated three times or more become one."""
    word = token.lower()
    if not word.isalpha():
        word = EDGE.sub("", word)
    return RUNS.sub(r"\1", word) if len(word) > 3 else word


def around(tokens: list[str], at: int) -> int:
    """Hash of the words beside a place."""
    beside = (tokens[at - 1] if at else "") + " " + (tokens[at + 1] if at + 1 < len(tokens) else "")
    return zlib.crc32(beside.encode("utf-8", "surrogatepass"))


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Product of a trie and a Levenshtein automaton, made deterministic on demand; at most ``limit`` states are kept."""

    def __init__(self, terms: dict[str, float], limit: int = 200_000):
        self.terms, self.limit = terms, limit
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most: list[int] = [0]
        for term in sorted(terms):
            at, allowed = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.most.append(0)
                at = self.child[at][c]
                self.most[at] = max(self.most[at], allowed)
            self.term[at] = term
        self.reset()

    def reset(self):
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.hit: list[tuple[int, str] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set) -> int:
        best: dict[int, int] = {}
        stack = list(pairs)
        while stack:  # skipping a letter of the term costs an edit
            node, e = stack.pop()
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            stack += [(n, e + 1) for n in self.child[node].values()]
        key = tuple(sorted(best.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] and e <= edits_allowed(self.term[n])]
            self.hit.append(min(ends, key=lambda x: (x[0], -self.terms[x[1]], x[1])) if ends else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if e < self.most[node]:
                out.add((node, e + 1))  # an extra letter in the word
            for letter, n in self.child[node].items():
                if letter == c:
                    out.add((n, e))
                elif e < self.most[n]:
                    out.add((n, e + 1))
        return self._state(out)

    def find(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within its allowed edits, or None."""
        if len(self.sets) > self.limit:
            self.reset()
        at = self.start
        for c in word:
            to = self.next[at].get(c)
            if to is None:
                to = self.next[at][c] = self._step(at, c)
            if not self.sets[to]:
                return None
            at = to
        return self.hit[at]


def stems_of(terms: dict[str, float], least: int = 4) -> list[str]:
    """Shortest prefixes of 3 letters or more whose terms, ``least`` or more, make up all terms that begin so."""
    groups: dict[str, set[str]] = {}
    for t in terms:
        for k in range(3, len(t)):
            groups.setdefault(t[:k], set()).add(t)
    found = [p for p, ts in groups.items() if len(ts) >= least]
    deepest = {}
    for p in sorted(found, key=len):  # the longest prefix with the same terms
        deepest[frozenset(groups[p])] = p
    return sorted(deepest.values())


class Scorer:
    """Hit counts and scores of texts for one model; memos are bounded."""

    def __init__(self, model: dict, memo: int = 150_000):
        self.terms: dict[str, float] = model["terms"]
        self.clean_words = frozenset(model.get("clean", ()))
        self.stems = tuple(model.get("stems", ()))
        self.weights = np.array(model.get("weights", PRIOR))
        exact = frozenset(model.get("exact_only", ()))
        self.automaton = LexiconAutomaton({t: w for t, w in self.terms.items() if t not in exact})
        self.memo = Memo(self.verdict, memo)

    def verdict(self, token: str) -> tuple | None:
        """(kind, weight, word): kind 0 a term, 1 a misspelt term, 2 a word with a term's stem."""
        word = clean(token)
        if not word:
            return None
        if word in self.terms:
            return 0, self.terms[word], word
        found = None if word in self.clean_words else self.automaton.find(word)
        if found:
            return 1, self.terms[found[1]], word
        return (2, 0.0, word) if self.stems and word.startswith(self.stems) else None

    @staticmethod
    def quoted(tokens: list[str], at: int) -> bool:
        """Context window: quotation marks open before and close after the hit, or reporting words with a mark."""
        before, after = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
        own = tokens[at]
        opens = own[0] in QUOTES or any(t[0] in QUOTES for t in before)
        closes = any(c in QUOTES for c in own[-3:]) or any(c in QUOTES for t in after for c in t[-3:])
        closed = any(t[-1] in QUOTES for t in before) and own[0] not in QUOTES
        score = (0.6 if opens and closes and not closed else 0) + 0.5 * any(clean(t) in REPORTING for t in before)
        return score >= 0.6

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        hits = [(i, v) for i, v in enumerate(map(self.memo.__getitem__, tokens)) if v is not None]
        plain = misspelt = stem = quoted = 0
        best = 0.0
        for i, (kind, weight, _) in hits:
            if kind == 2:
                stem += 1
            elif self.quoted(tokens, i):
                quoted += 1
            elif kind == 0:
                plain += 1
                best = max(best, weight)
            else:
                misspelt += 1
        logs = [math.log2(1 + n) for n in (plain, misspelt, stem, quoted)]
        return [1.0, float(plain > 0), *logs, best / 8.0, max(0.0, best - SURE) / 2]

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 1.0) -> np.ndarray:
    """Weights at the posterior mode: Gaussian prior around ``prior`` with precision ``pull``; Newton's method."""
    w = prior.astype(float).copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (y - p) - pull * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out_rows(doc_id: Column) -> Column:
    """True where crc32 of the doc_id's text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def telling(rows: DataFrame, n_pos: int, n_neg: int, tried: int) -> DataFrame:
    """Rows (pos, neg: contexts in each class) that tell toxic texts from clean ones, with ``llr``, their log odds.

    The log odds are ``LEAST_ODDS`` or more, and the likelihood ratio stands out among ``tried`` rows.
    """
    llr = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    share = F.lit(n_pos / max(1, n_pos + n_neg))
    total = F.col("pos") + F.col("neg")
    gain = F.col("pos") * F.log(F.col("pos") / (total * share))
    gain = gain + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (total * (F.lit(1.0) - share)))).otherwise(0.0)
    return rows.where("pos > 0").withColumn("llr", llr).where((F.col("llr") >= LEAST_ODDS) & (gain >= STRICT * math.log(max(2, tried))))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 4000, min_contexts: int = 4) -> dict:
    """Model from at most ``per_class`` labelled rows of each class, taken in the order of a hash of doc_id.

    What comes back to the driver is a part of that bounded sample's words, and a row of counts for each sampled text. Stems
    that begin like a shorter stem are left out.
    """
    order = F.xxhash64(F.col("doc_id"))
    rows = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null")
    rows = rows.where(~held_out_rows(F.col("doc_id")))
    picked = [r for t in (0, 1) for r in rows.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(per_class).collect()]
    if not picked:
        return {"terms": {}, "weights": PRIOR.tolist()}
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in picked], "__id long, toxic int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), text_or_empty().alias("text"))
    sample = materialise(texts.join(ids, "__id").select("toxic", "text"), "toxic-sample").repartition(8)
    n_pos = sum(r.toxic == 1 for r in picked)
    n_neg = len(picked) - n_pos
    classes = [F.size(F.collect_set(F.when(F.col("toxic") == t, F.col("context")))).alias(c) for c, t in (("pos", 1), ("neg", 0))]

    def words():
        from aerolith.llm.toxicity import around, clean

        def step(cols):
            term, toxic, context = [], [], []
            for text, label in zip(cols["text"].to_pylist(), cols["toxic"].to_pylist()):
                seen, tokens = {}, [clean(t) for t in text.split()]
                for i, w in enumerate(tokens):
                    if w and w not in seen:
                        seen[w] = around(tokens, i)
                term += seen
                context += seen.values()
                toxic += [label] * len(seen)
            return {"term": term, "toxic": toxic, "context": context}

        return step

    schema = pa.schema([("term", pa.string()), ("toxic", pa.int32()), ("context", pa.int64())])
    counted = materialise(map_rows(sample, words, "term string, toxic int, context long", schema).groupBy("term").agg(*classes), "toxic-words")
    tried = counted.count()
    found = telling(counted.where(F.col("pos") >= min_contexts), n_pos, n_neg, tried).select("term", "llr").collect()
    model = {"terms": {r.term: float(r.llr) for r in sorted(found, key=lambda r: (-r.llr, r.term))}}
    leaning = counted.where((F.col("pos") > 1) & (F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1)) >= LEAST_ODDS))
    beginnings = frozenset(stems_of({r.term: 0.0 for r in leaning.select("term").collect()}))
    if beginnings:

        def begun():
            from aerolith.llm.toxicity import around, clean

            def step(cols):
                stem, toxic, context = [], [], []
                for text, label in zip(cols["text"].to_pylist(), cols["toxic"].to_pylist()):
                    seen, tokens = {}, [clean(t) for t in text.split()]
                    for i, t in enumerate(tokens):
                        for b in {t[:k] for k in range(3, len(t) + 1)} & beginnings:
                            if b not in seen:
                                seen[b] = around(tokens, i)
                    stem += seen
                    context += seen.values()
                    toxic += [label] * len(seen)
                return {"stem": stem, "toxic": toxic, "context": context}

            return step

        schema = pa.schema([("stem", pa.string()), ("toxic", pa.int32()), ("context", pa.int64())])
        stems = map_rows(sample, begun, "stem string, toxic int, context long", schema).groupBy("stem").agg(*classes)
        beginnings = {r.stem for r in telling(stems, n_pos, n_neg, tried).select("stem").collect()}
    model["stems"] = sorted(b for b in beginnings if not any(b[:k] in beginnings for k in range(3, len(b))))

    def fuzzy():
        from aerolith.llm.toxicity import Scorer

        scorer = Scorer(model)

        def step(cols):
            word, term, toxic = [], [], []
            for text, label in zip(cols["text"].to_pylist(), cols["toxic"].to_pylist()):
                near = {w for t in set(text.split()) if (v := scorer.verdict(t)) is not None and v[0] == 1 for w in [v[2]]}
                word += near
                term += [scorer.automaton.find(w)[1] for w in near]
                toxic += [label] * len(near)
            return {"word": word, "term": term, "toxic": toxic}

        return step

    schema = pa.schema([("word", pa.string()), ("term", pa.string()), ("toxic", pa.int32())])
    near = map_rows(sample, fuzzy, "word string, term string, toxic int", schema)
    innocent = F.sum(1 - F.col("toxic"))
    near = near.groupBy("term", "word").agg(F.sum("toxic").alias("pos"), innocent.alias("neg")).where("neg > 0").collect()
    # a term near which innocent words lie is taken as it is written only; a single such word is set aside
    neg: dict[str, int] = {}
    for r in near:
        neg[r.term] = neg.get(r.term, 0) + r.neg
    model["exact_only"] = sorted(t for t, n in neg.items() if n >= 3)
    model["clean"] = sorted({r.word for r in near if neg[r.term] < 3 and r.neg >= r.pos})

    def counts():
        from aerolith.llm.toxicity import Scorer

        scorer = Scorer(model)
        return lambda cols: {"x": [scorer.features(t) for t in cols["text"].to_pylist()], "toxic": cols["toxic"]}

    schema = pa.schema([("x", pa.list_(pa.float64())), ("toxic", pa.int32())])
    data = map_rows(sample, counts, "x array<double>, toxic int", schema).collect()
    x = np.array([r.x for r in data], float).reshape(-1, len(PRIOR))
    model["weights"] = fit_logistic(x, np.array([r.toxic for r in data], float)).tolist()
    return model


def score_texts(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of each row of ``docs``."""

    def kernel():
        from aerolith.llm.toxicity import Scorer

        scorer = Scorer(model)
        return lambda cols: {"doc_id": cols["doc_id"], "score": [scorer.score(t) for t in cols["text"].to_pylist()]}

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    out = map_rows(rows, kernel, "doc_id long, score double", pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **sample) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``, with a model learned from ``labels``."""
    scored = score_texts(docs, learn(docs, labels, **sample), threshold)
    return scored.select("doc_id", held_out_rows(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **sample) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns kept.

    Each row is judged by its own text where it stands: rows with a null doc_id, or that share a doc_id, are no exception,
    and nothing is joined or shuffled.
    """
    model, at = learn(docs, labels, **sample), docs.columns.index("text")

    def run(batches):
        from aerolith.llm.toxicity import Scorer

        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([scorer.score("" if t is None else str(t)) < threshold for t in texts], pa.bool_()))

    return map_batches(docs, run, docs.schema)
