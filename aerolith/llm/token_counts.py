"""Token counts by prefix dynamic programming (operator 2).

For the word-level BPE of ``word_bpe_49k.json``: text is composed (NFC), lower-cased, cut into words by the
tokenizer's own pattern, and each word is byte-level BPE with an end mark. Words do not influence each other, so the
count of any prefix of a text is the count of the whole words before it plus the count of the word prefix it ends in.
Both come from back-pointers of :class:`PrefixTable`, which holds one for every prefix of a word. A text's count is the
count at its last prefix; where a budget cuts it is read from the counts at the prefixes of the piece in which the budget
runs out. On demand all of a text's counts, character by character, are stored as one array, in which any truncation is
looked up (:func:`tokens_of_prefix`, :func:`longest_within`) without a tokenizer.

Defined results: a null or empty text has 0 tokens and no prefixes; special strings in a text count as one token each (the
library's default), their beginnings as plain text; repeated rows, rows that share a doc_id and rows with none are
answered row by row; an empty table gives no rows; columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.bpe_prefix import PrefixTable
from aerolith.llm.common import Memo, map_rows, text_or_empty

#: Whitespace of the tokenizer's pattern; str.split() also cuts at the four separators U+001C to U+001F.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")
#: Whether a code point is white space; all from the last entry on are not.
IS_WHITE = np.array([WHITE.fullmatch(chr(i)) is not None for i in range(0x3002)])


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + spare)
            spare += 1
    return [out[b] for b in range(256)]


class WordCounter:
    """Counts for one vocabulary file, with memos of bounded size."""

    def __init__(self, spec: str, memo: int = 100_000):
        spec = json.loads(spec)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ranks = {pair: i for i, pair in enumerate(merges)}
        final = {t[: -len(mark)] for t in model["vocab"] if t.endswith(mark)}
        inner = {t for t in model["vocab"] if not t.endswith(mark)}
        self.table = PrefixTable(inner, lambda a, b: ranks.get((a, b)), final, mark, limit=150_000)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(split)
        self.bytes = byte_alphabet()
        self.memo = Memo(self.count, memo)

    def symbols(self, word: str) -> str:
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        return "".join([self.bytes[b] for b in word.encode("utf-8", "surrogatepass")])

    def forget(self) -> None:
        self.memo.forget()
        self.table.forget()

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter (no word-final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def count(self, chunk: str) -> int:
        """Tokens of a piece of text without white space."""
        return sum(self.table.count(self.symbols(w)) for w in self.words.findall(self.normal(chunk)))

    def marks(self, chunk: str) -> bytes:
        """Tokens of each prefix of a piece of text without white space, from length 1 on, as little-endian 32-bit integers."""
        text = self.normal(chunk)
        if len(text) != len(chunk) or not (chunk.isascii() or unicodedata.is_normalized("NFC", chunk)):
            return np.array([self.count(chunk[:i]) for i in range(1, len(chunk) + 1)], "<i4").tobytes()
        out, done, at = [], 0, 0
        for m in self.words.finditer(text):
            out += [done] * (m.start() - at)
            word = m.group()
            if word[0] == "'":  # a shorter prefix may match another branch of the pattern
                own = [self.count(word[:i]) for i in range(1, len(word) + 1)]
            elif len(word.encode("utf-8", "surrogatepass")) == len(word):
                own = self.table.counts(self.symbols(word))
            else:
                own = [self.table.count(self.symbols(word[:i])) for i in range(1, len(word) + 1)]
            out += [done + c for c in own]
            done += own[-1]
            at = m.end()
        return np.array(out + [done] * (len(text) - at), "<i4").tobytes()

    def _chunks(self, text: str) -> list[str]:
        return text.split() if not ODD_SPACE.search(text) else [c for c in WHITE.split(text) if c]

    def _plain(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text without special strings."""
        chunks = self._chunks(text)
        if not chunks:
            return np.zeros(len(text), np.int32)
        inside = np.frombuffer(b"".join(map(self.marks, chunks)), "<i4")
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        whole = inside[np.cumsum(sizes) - 1]
        counts = np.concatenate([[0], inside + np.repeat(np.cumsum(whole) - whole, sizes)])
        if len(text) == sizes.sum():
            return counts[1:].astype(np.int32)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return counts[np.cumsum(~IS_WHITE[np.minimum(points, len(IS_WHITE) - 1)])].astype(np.int32)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token count of each prefix of ``text``, from length 1 on: entry i - 1 is what encoding ``text[:i]`` anew gives."""
        if "<|" not in text:
            return self._plain(text)
        out, base, before, last = [], 0, "", np.empty(0, np.int32)
        for i, part in enumerate(self.cut_special.split(text)):
            if i % 2 == 0:
                before, last = part, base + self._plain(part)
                out.append(last)
                continue
            # until it is complete, a special string reads on from the piece before it
            done = int(last[-1]) if before else base
            tail = self._chunks(before)[-1] if before and not WHITE.fullmatch(before[-1]) else ""
            start = int(last[-len(tail) - 1]) if len(before) > len(tail) else base
            inside = start + np.frombuffer(self.marks(tail + part), "<i4")[len(tail) :]
            base = done + 1
            out.append(np.concatenate([inside[:-1], [base]]))
        return np.concatenate(out).astype(np.int32)

    def total_and_cut(self, text: str, budget: int) -> tuple[int, int]:
        """The last prefix count of ``text``, and the length of its longest prefix with at most ``budget`` tokens.

        Counts at the ends of pieces are summed first; the prefixes inside are looked at for the one piece where the budget
        runs out, as later ones hold more tokens from their first character on.
        """
        if "<|" in text:
            counts = self.prefix_counts(text)
            fits = np.flatnonzero(counts <= budget)
            return int(counts[-1]), int(fits[-1]) + 1 if len(fits) else 0
        chunks = self._chunks(text)
        whole = list(map(self.memo.__getitem__, chunks))
        total = sum(whole)
        if total <= budget:
            return total, len(text)
        left, at = budget, 0
        for chunk, n in zip(chunks, whole):
            at = text.index(chunk, at)
            if n > left:
                fits = np.flatnonzero(np.frombuffer(self.marks(chunk), "<i4") <= left)
                return total, at + (int(fits[-1]) + 1 if len(fits) else 0)
            left, at = left - n, at + len(chunk)
        raise AssertionError


_COUNTERS: dict[str, WordCounter] = {}


def counter_for(spec: str) -> WordCounter:
    """One counter per vocabulary and worker process; tasks empty its memos when they end."""
    key = str(hash(spec))
    if key not in _COUNTERS:
        _COUNTERS[key] = WordCounter(spec)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, vocabulary: str, budget: int = 2048, prefixes: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, and how many characters fit ``budget`` tokens.

    With ``prefixes``, ``prefix_tokens`` holds the token count of every prefix, from one character on. ``vocabulary`` is a
    tokenizer file on the driver; its content (about 2 MB) travels with the tasks.
    """
    spec = open(vocabulary, encoding="utf-8").read()

    def kernel():
        from aerolith.llm.token_counts import counter_for

        counter = counter_for(spec)

        def step(cols):
            n, fit, marks = [], [], []
            for text in cols["text"].to_pylist():
                total, cut = counter.total_and_cut(text, budget)
                n.append(total)
                fit.append(cut)
                if prefixes:
                    marks.append(counter.prefix_counts(text))
            return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n_tokens": n, "fitting_chars": fit, "prefix_tokens": marks}

        step.release = counter.forget
        return step

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("fitting_chars", pa.int64())]
    schema = "doc_id long, n_bytes long, n_tokens long, fitting_chars long"
    if prefixes:
        fields.append(("prefix_tokens", pa.list_(pa.int32())))
        schema += ", prefix_tokens array<int>"
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = map_rows(rows, kernel, schema, pa.schema(fields))
    return out.withColumn("over_limit", F.col("n_tokens") > budget)


def tokens_of_prefix(prefix_tokens: Column, n_chars: Column | int) -> Column:
    """Tokens of a text's first ``n_chars`` characters, from its stored counts; of the whole text if it has fewer."""
    n = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(prefix_tokens))
    return F.when(n > 0, F.get(prefix_tokens, n - 1)).otherwise(0)


def longest_within(prefix_tokens: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, from a text's stored counts."""
    fits = F.transform(prefix_tokens, lambda c, i: F.when(c <= budget, i + 1))
    return F.coalesce(F.array_max(fits), F.lit(0))
