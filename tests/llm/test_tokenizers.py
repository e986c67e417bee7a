import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from aerolith.llm.sentencepiece_codec import Codec, Viterbi, decode, encode, read_model, round_trip
from aerolith.llm.token_counts import WordCounter, longest_within, token_counts, tokens_of_prefix
from tests.llm.helpers import awkward, docs, empty

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "Hello world, it's 2024!", "ΑΣ ΣΑΣ İstanbul", "a b\u0085c", "x\x1cy", "<|endoftext|>a b<|startoftext|> x", "日本語 テスト ½ ४५", "a" * 300 + " " + "xyz" * 90, "\u0000 😀😀", "don't WE'LL 'sx '",
    " lead", "trail ", "two  spaces   three", "▁ a▁▁b", "<s> <0x0A>", "line\none\r\n\ttab", "https://a.b/c?d=e&f=g" * 20,
]


@pytest.fixture(scope="module")
def counter():
    return WordCounter(open(WORDS, encoding="utf-8").read())


@pytest.fixture(scope="module")
def codec():
    return Codec(read_model(PIECES))


def noise(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeth ing.,'é\n1<|>") for _ in range(rng.randint(1, 200))) for _ in range(60)]


def test_counts_equal_the_library(counter):
    lib = Tokenizer.from_file(WORDS)
    for text in TEXTS + noise(1):
        counts = counter.prefix_counts(text)
        assert len(counts) == len(text) and (counts[-1] if text else 0) == len(lib.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_prefix_has_its_exact_count(counter):
    lib = Tokenizer.from_file(WORDS)
    texts = ["Hello world it's fine", "don't 'll stop", "éàü zz 12", "l'été 'sup", "  a  b\t\nc ", "e\u0301te\u0301 İx", "a<|endoftext|>b ..<|startoftext|> <|end", "x <|endoftext|>"]
    for t in texts + TEXTS[:8] + [n[:60] for n in noise(3)]:
        assert counter.prefix_counts(t).tolist() == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(1, len(t) + 1)], repr(t)


def test_truncations_are_looked_up(spark):
    from pyspark.sql import functions as F

    lib, text = Tokenizer.from_file(WORDS), "The counts of all prefixes are stored, so nothing is encoded again."
    rows = token_counts(docs(spark, [(1, text), (2, None)]), WORDS, prefixes=True)
    got = {r.doc_id: r for r in rows.select("doc_id", tokens_of_prefix(F.col("prefix_tokens"), 20).alias("n"), longest_within(F.col("prefix_tokens"), 9).alias("fits")).collect()}
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    assert got[1].n == size(text[:20]) and got[1].fits == max(i for i in range(len(text) + 1) if size(text[:i]) <= 9)
    assert got[2].n == got[2].fits == 0


def test_long_words_need_no_table(counter):
    word = "thequickbrown" * 20
    before = len(counter.table.table)
    counter.table._walk(word, False)
    assert counter.table.count(word) == counter.table.counts(word)[-1]
    assert len(counter.table.table) == before


def test_token_counts_table(spark):
    got = {r.doc_id: r for r in token_counts(awkward(spark), WORDS, budget=100, prefixes=True).collect()}
    assert got[2].n_tokens == got[3].n_tokens == 0 and got[2].n_bytes == 0
    assert got[5].n_tokens == 5000 and got[5].over_limit and got[5].fitting_chars == 500 and got[5].prefix_tokens[499] == 100 and got[5].prefix_tokens[500] == 101
    assert token_counts(awkward(spark), WORDS).count() == 10
    assert token_counts(empty(spark), WORDS).count() == 0


def test_ids_equal_the_library(codec):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in TEXTS + noise(2):
        ids = codec.encode(text)
        assert ids == lib.encode(text), repr(text)
        assert codec.decode(ids) == lib.decode(ids), repr(text)
        if "▁" not in text:
            assert codec.decode(ids) == text


def test_streaming_viterbi_commits_early(codec):
    text = "▁" + "thequickbrownfoxjumps" * 50
    coder, out, held = Viterbi(codec.table), [], 0
    for c in text:
        out += coder.feed(c)
        held = max(held, len(coder.begin))
    out += coder.finish()
    assert [codec.ids[t] for t in out] == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text[1:])
    assert held <= 8 * codec.table.longest + 2


def test_words_take_turns_in_one_trellis(codec):
    lib, words = sentencepiece.SentencePieceProcessor(model_file=PIECES), "under underneath underground u unders thequickbrown".split()
    words += ["thequickbrownfox" * 20, "thequickbrownfox" * 19 + "es", "the"]
    coder = Viterbi(codec.table)
    for w in words * 2:
        out = [*coder.feed(coder.rewind("▁" + w)), *coder.finish()]
        assert [codec.ids[t] for t in out] == lib.encode(w), w


def test_tables_equal_the_libraries(spark):
    """Whole tables against the tokenizers' own libraries, row by row."""
    import hashlib

    import numpy as np

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib, pieces = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts, trips = ({r.doc_id: r for r in x.collect()} for x in (token_counts(d, WORDS), round_trip(d, PIECES)))
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    assert set(counts) == set(trips) == set(texts)
    for i, text in texts.items():
        assert counts[i].n_tokens == len(lib.encode(text, add_special_tokens=False).ids) and counts[i].n_bytes == len(text.encode())
        assert trips[i].ids_sha256 == hashlib.sha256(np.array(pieces.encode(text), "<i4").tobytes()).hexdigest() and trips[i].round_trip


def test_codec_tables(spark):
    coded = encode(awkward(spark), PIECES)
    back = {r.doc_id: r.text for r in decode(coded, PIECES).collect()}
    assert back[1] == "Alpha beta gamma." and back[2] == "" and back[7] == "é ñ 日本 😀"
    assert all(r.round_trip for r in round_trip(awkward(spark), PIECES).collect())
    assert not round_trip(docs(spark, [(1, "a▁b")]), PIECES).first().round_trip
    assert encode(empty(spark), PIECES).count() == 0


def test_words_are_looked_up_once_a_batch(codec):
    lib, fresh = sentencepiece.SentencePieceProcessor(model_file=PIECES), Codec(read_model(PIECES), memo=40)
    texts = [f"word{i} of\tmany\nlines\n\nand words{i % 7}  {chr(0x2581)} x{'long' * 60} {i}" if i % 3 else f"plain words{i % 9}\nword{i} é日本😀" for i in range(90)]
    texts += ["", " ", "\n", "a", " a", "a ", "\n\n a\r"]
    asked, short = [], fresh.short
    fresh.short = lambda parts: asked.extend(parts) or short(parts)
    for at in range(0, len(texts), 20):
        got = fresh.encode_packed(texts[at : at + 20])
        assert [np.frombuffer(p, "<i4").tolist() for p in got] == [lib.encode(t) for t in texts[at : at + 20]]
        assert len(asked) == len(set(asked))
        asked.clear()
