"""SentencePiece encoding and decoding by streaming Viterbi (operator 6).

The trellis has one column per character. A column keeps one back-pointer: the piece that ends there on the best path.
For a model of type BPE the best path is the one the merges would give, so a piece may extend a path only if it and the
path's last piece encode to just these two (see ``bpe_prefix``); a path by summed scores would be a different encoding.
No piece is longer than ``longest``, so only the last ``longest`` columns can be extended. Whenever the back-pointer
paths of all these columns run through one boundary, everything before it is final: its ids are committed and its
columns dropped, so memory does not grow with the text.

White space bounds pieces (no piece has the space mark after another character), so text is fed word by word, every word
through the same trellis; the ids of words of up to 64 characters are kept in a bounded memo for when they come again. A
word that fits the trellis as a whole needs no commit: its columns hold the ids of their paths.

Defined results: null and empty texts have no ids and decode to the empty string; characters outside the vocabulary
become byte pieces; a text's own U+2581 reads as a space on decoding, as in the library, so ``round_trip`` is false for
such texts; repeated rows, rows that share a doc_id and rows with none are answered row by row; an empty table gives no
rows; columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.bpe_prefix import PrefixTable
from aerolith.llm.common import Memo, map_rows, text_or_empty

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def read_model(path: str) -> dict:
    """Vocabulary of a model file: pieces in id order, their scores, and which ids are byte pieces or no text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    return {
        "pieces": [m.id_to_piece(i) for i in ids],
        "scores": [m.get_score(i) for i in ids],
        "bytes": [i for i in ids if m.is_byte(i)],
        "other": [i for i in ids if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)],
    }


class Viterbi:
    """Streaming encoder of one segment: feed characters, take committed tokens, then finish.

    Column ``n`` stands for the first ``n`` characters since the last committed boundary: ``last[n]`` is the token that
    ends there on the best path (None until a path asks for it), ``begin[n]`` the column where it begins.
    """

    def __init__(self, table: PrefixTable):
        self.table, self.longest = table, table.longest
        self.room = 4 * table.longest  # columns that make a commit worth while
        self.tail = ""  # characters since the last committed boundary
        self.last: list[str | None] = [""]  # last[0]: the last committed token
        self.begin = [0]

    def feed(self, chars: str) -> Iterator[str]:
        step = 2 * self.longest
        for at in range(0, len(chars), step):
            self.extend(chars[at : at + step])
            if len(self.tail) >= self.room:
                yield from self.commit()

    def extend(self, chars: str) -> None:
        """Columns for ``chars``; each is worked out when a path first asks for it."""
        self.tail += chars
        self.last += [None] * len(chars)
        self.begin += [0] * len(chars)

    def column(self, n: int) -> str:
        """The token that ends at column ``n`` on the best path there."""
        table, tail, last = self.table, self.tail, self.last
        tokens, known = table.tokens, table.pairs.get
        end = tail[n - 3 if n > 3 else 0 : n]
        tries = table.sizes[end]
        for k, size in enumerate(tries):
            at = n - size
            if at < 0:
                continue
            token = tail[at:n]
            if size > 1 and token not in tokens:
                continue
            pair = (self.column(at) if last[at] is None else last[at], token)
            ok = known(pair)
            if table.fits(*pair) if ok is None else ok:
                last[n], self.begin[n] = token, at
                if k:
                    table.sizes[end] = (*tries[: k - 1], size, tries[k - 1], *tries[k + 1 :])
                return token
        raise ValueError("no encoding")

    def rewind(self, chars: str) -> str:
        """Keep the columns that the next segment, ``chars``, begins with, if nothing was committed; the rest of ``chars`` is left to feed."""
        n = 0
        if not self.last[0]:
            for a, b in zip(self.tail, chars):
                if a != b:
                    break
                n += 1
        self.tail, self.last[0] = chars[:n], ""
        del self.last[n + 1 :], self.begin[n + 1 :]
        return chars[n:]

    def path(self, column: int) -> list[int]:
        """Boundaries of the path to ``column``, ends included."""
        out, begin = [column], self.begin
        while out[-1] > 0:
            out.append(begin[out[-1]])
        return out[::-1]

    def commit(self) -> Iterator[str]:
        """Give out the tokens up to the last boundary that the paths of all live columns share."""
        live = range(len(self.last) - self.longest, len(self.last))
        for column in live:
            if self.last[column] is None:
                self.column(column)
        shared = set(self.path(live[0]))
        for column in live[1:]:
            shared &= set(self.path(column))
        at = max(shared)
        if at:
            yield from self.tokens(at)
            # columns that begin before the boundary are out of reach: no piece is as long as their distance to the end
            self.tail, self.last, self.begin = self.tail[at:], self.last[at:], [0, *[max(0, b - at) for b in self.begin[at + 1 :]]]

    def tokens(self, column: int) -> list[str]:
        return [self.last[c] for c in self.path(column)[1:]]

    def finish(self) -> list[str]:
        """Tokens from the last committed boundary to the end."""
        last, begin = self.last, self.begin
        out, at = [], len(last) - 1
        if last[at] is None:
            self.column(at)
        while at:
            out.append(last[at])
            at = begin[at]
        out.reverse()
        return out


class Codec:
    """Encoder and decoder for one vocabulary, with bounded memos."""

    def __init__(self, model: dict, memo: int = 100_000):
        skip = {*model["bytes"], *model["other"]}
        self.ids = {p: i for i, p in enumerate(model["pieces"]) if i not in skip}
        scores = model["scores"]
        ids = self.ids

        def rank(a, b):
            i = ids.get(a + b)
            return None if i is None else -scores[i]

        self.table = PrefixTable(ids, rank, limit=150_000)
        self.byte_ids = dict(zip(range(256), sorted(model["bytes"])))
        self.text = [p.replace(MARK, " ").encode() for p in model["pieces"]]
        for i in model["other"]:
            self.text[i] = b""
        for b, i in self.byte_ids.items():
            self.text[i] = bytes([b])
        self.apart = re.compile("([" + "".join(re.escape(c) for c in "\n\t\r" if c not in ids) + "]+)")
        self.packed: dict[str, bytes] = {}
        self.memo = Memo(self.key, memo)
        self.coder = Viterbi(self.table)

    def forget(self) -> None:
        self.memo.forget()
        self.table.forget()

    def pack(self, token: str) -> bytes:
        """The token's id as four bytes, or its byte pieces' ids."""
        found = self.packed.get(token)
        if found is None:
            i = self.ids.get(token)
            ids = [i] if i is not None else [self.byte_ids[b] for b in token.encode("utf-8", "surrogatepass")]
            found = np.array(ids, "<i4").tobytes()
            if i is not None or len(self.packed) < 4 * len(self.ids):
                self.packed[token] = found
        return found

    def segment(self, segment: str) -> bytes:
        """Ids of a segment; parts without vocabulary characters between them cannot merge."""
        out, coder, pack = [], self.coder, self.pack
        for part in self.apart.split(segment) if self.apart.search(segment) else (segment,):
            if len(part) < coder.room:  # fits the window as a whole: nothing is committed before its end
                coder.extend(coder.rewind(part))
            else:
                out += map(pack, coder.feed(coder.rewind(part)))
            out += map(pack, coder.finish())
        return b"".join(out)

    @staticmethod
    def shows_marks(text: str) -> bool:
        """Whether segments of the text must show their own space marks."""
        return MARK in text or "  " in text or text[0] == " " or text[-1] == " "

    def keys(self, text: str) -> list[str]:
        """Pieces of text between single spaces, or segments that show their own space marks."""
        if not text:
            return []
        if self.shows_marks(text):
            return SEGMENT.findall(MARK + text.replace(" ", MARK))
        return text.split(" ")

    def key(self, key: str) -> bytes:
        return self.segment(key if key[0] == MARK else MARK + key)

    def short(self, parts: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each part (in sorted order, without white space to split at) with its ids.

        A column holds the token that ends there on the best path and the ids of that path; columns of a beginning that a part
        shares with the part before are kept. A part that does not fit the trellis as a whole is streamed.
        """
        table, room, ids_of = self.table, self.coder.room, self.packed.get
        tokens, known, fits, sizes = table.tokens, table.pairs.get, table.fits, table.sizes
        word, last, ids = "", [""], [b""]

        def column(n: int) -> str:
            end = word[n - 3 if n > 3 else 0 : n]
            tries = sizes[end]
            for k, size in enumerate(tries):
                at = n - size
                if at < 0:
                    continue
                token = word[at:n]
                if size > 1 and token not in tokens:
                    continue
                before = last[at]
                if before is None:
                    before = column(at)
                ok = known((before, token))
                if fits(before, token) if ok is None else ok:
                    last[n], ids[n] = token, ids[at] + (ids_of(token) or self.pack(token))
                    if k:
                        sizes[end] = (*tries[: k - 1], size, tries[k - 1], *tries[k + 1 :])
                    return token
            raise ValueError("no encoding")

        for part in parts:
            n, same = len(part), 0
            if n >= room:
                yield part, self.segment(part)
                continue
            for a, b in zip(word, part):
                if a != b:
                    break
                same += 1
            word = part
            last[same + 1 :] = [None] * (n - same)
            ids[same + 1 :] = last[same + 1 :]
            if last[n] is None:
                column(n)
            yield part, ids[n]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        Each segment of all texts is looked up once. Those that are not in the memo go through the trellis in sorted order, so
        that it keeps the columns of a common beginning.
        """
        plain = [i for i, t in enumerate(texts) if t and not self.shows_marks(t)]
        rest = [i for i, t in enumerate(texts) if t and self.shows_marks(t)]
        parts = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        shown = pa.array([self.keys(texts[i]) for i in rest], pa.list_(pa.large_string()))
        every = pa.concat_arrays([parts.flatten(), shown.flatten()]).dictionary_encode()
        found = pa.array(self.segments(every.dictionary.to_pylist()), pa.large_binary()).take(every.indices)
        ends = np.cumsum(np.concatenate([[0], pc.list_value_length(parts).to_numpy(), pc.list_value_length(shown).to_numpy()]))
        at = np.frombuffer(found.buffers()[1], np.int64)[ends].tolist() if len(found) else []
        data, out = found.buffers()[2], [b""] * len(texts)
        for i, lo, hi in zip([*plain, *rest], at, at[1:]):
            out[i] = data[lo:hi].to_pybytes()
        return out

    def segments(self, keys: list[str]) -> list[bytes]:
        """Ids of each of the different ``keys``."""
        memo, split, need = self.memo, {}, {}
        known, old, search = memo.get, memo.old, self.apart.search
        ids = list(map(known, keys))
        for i, k in enumerate(keys):
            if ids[i] is None:
                if k in old:
                    ids[i] = memo.keep(k, old.pop(k))
                else:
                    own = k if k[0] == MARK else MARK + k
                    if k is own or search(k):  # a word and the same word that shows its mark are two keys
                        split[i] = self.apart.split(own)
                    else:
                        need[own] = i
        for parts in split.values():
            for part in parts:
                need.setdefault(part, -1)
        for own, packed in self.short(sorted(need)):
            i, need[own] = need[own], packed
            if i >= 0:
                ids[i] = memo.keep(keys[i], packed)
        for i, parts in split.items():
            ids[i] = b"".join([need[p] for p in parts])
            if keys[i][0] == MARK:
                memo.keep(keys[i], ids[i])
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<i4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        text = self.text
        out = b"".join([text[i] for i in ids])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


_CODECS: dict[tuple[int, int], Codec] = {}


def codec_for(model: dict, memo: int = 100_000) -> Codec:
    """One codec per vocabulary, size of memo and worker process; tasks empty its memos when they end."""
    key = hash(tuple(model["pieces"])), memo
    if key not in _CODECS:
        _CODECS[key] = Codec(model, memo)
    return _CODECS[key]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array<int>) and n_ids of each row's text."""
    model = read_model(model_path)

    def kernel():
        from aerolith.llm.sentencepiece_codec import codec_for

        codec = codec_for(model)

        def step(cols):
            packed = codec.encode_packed(cols["text"].to_pylist())
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
            return {"doc_id": cols["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), "n_ids": pa.array(sizes)}

        step.release = codec.forget
        return step

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64())])
    return map_rows(rows, kernel, "doc_id long, ids array<int>, n_ids long", schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids decode to the empty string."""
    model = read_model(model_path)

    def kernel():
        from aerolith.llm.sentencepiece_codec import codec_for

        codec = codec_for(model)
        return lambda cols: {"doc_id": cols["doc_id"], "text": [codec.decode(i or []) for i in cols["ids"].to_pylist()]}

    rows = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return map_rows(rows, kernel, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian int32), decoded_sha256, round_trip; ids stay in the task."""
    model = read_model(model_path)

    def kernel():
        from aerolith.llm.sentencepiece_codec import codec_for

        codec = codec_for(model, 200_000)

        def step(cols):
            n, digest, back, same = [], [], [], []
            texts = cols["text"].to_pylist()
            for text, packed in zip(texts, codec.encode_packed(texts)):
                decoded = codec.decode(np.frombuffer(packed, "<i4").tolist())
                n.append(len(packed) // 4)
                digest.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(decoded == text)
            return {"doc_id": cols["doc_id"], "n_ids": n, "ids_sha256": digest, "decoded_sha256": back, "round_trip": same}

        step.release = codec.forget
        return step

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    names = [("doc_id", "long", pa.int64()), ("n_ids", "long", pa.int64()), ("ids_sha256", "string", pa.string()),
             ("decoded_sha256", "string", pa.string()), ("round_trip", "boolean", pa.bool_())]
    return map_rows(rows, kernel, ", ".join(f"{n} {t}" for n, t, _ in names), pa.schema([(n, a) for n, _, a in names]))
