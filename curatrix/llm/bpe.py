"""BPE encoding and decoding as the tokenizers library does it for a BPE with word ends.

A short word is a contiguous array of parts and the ranks of adjacent pairs: the least rank is sought by scanning, its
boundary deleted, and the two neighbouring ranks refreshed. Words of over LONG symbols, for which repeated scans would
take quadratic time, use a heap over the same ranks with the same result.

Between white space a text's pieces are independent of each other, so pieces are memoised, in at most MEMO entries.
Nulls: a null text counts as an empty one, a null doc_id stays null. Very long texts are encoded whole. Repeated rows stay;
of equal ranks the leftmost pair merges first. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LONG = 128
MEMO = 400_000
#: Longer pieces are not memoised.
MEMO_CHARS = 64
#: What a tokenizer's regex takes for white space; str.split takes four more.
SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
MORE = regex.compile("[\x1c-\x1f]")
# Letters and numbers of Unicode 16, and lower cases of 16 and 17, which this Python's tables (15.1) lack.
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139),
    (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
LATER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
#: Marks that make a word of their own after letters, unless more follow.
SINGLE = frozenset(".,!?;:-)\"")
NONE, LOW = 1 << 60, (1 << 20) - 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(more)) for b in range(256)]


def unassigned(c: str) -> bool:
    return unicodedata.category(c) == "Cn"


class Known(dict):
    """Pieces' ids; what is missing is made, and kept if it is short."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids


class WordBpe:
    """encode(text) gives ids as little-endian unsigned 32-bit integers; decode(ids) the text of the ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (i << 20) | self.vocab[a + b] for i, (a, b) in enumerate(pairs)}
        size = 1 + max([*self.vocab.values(), *(x["id"] for x in spec["added_tokens"])])
        self.tokens = [""] * size
        for token, i in self.vocab.items():
            self.tokens[i] = token
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.at_special = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        chars = byte_chars()
        self.byte_id = [self.vocab[c] for c in chars]
        self.start = {chr(b): self.byte_id[b] for b in range(128)}
        self.at_end = {self.vocab[c]: self.vocab[c + self.end] for c in chars}
        self.known = Known(self.piece)
        self.words: dict[str, bytes] = {}

    def merged(self, word: str) -> bytes:
        try:
            ids = [*map(self.start.__getitem__, word)]
        except KeyError:  # beyond ASCII
            ids = [*map(self.byte_id.__getitem__, word.encode("utf-8", "surrogatepass"))]
        ids[-1] = self.at_end[ids[-1]]
        return array("I", self._by_scan(ids) if len(ids) <= LONG else self._by_heap(ids)).tobytes()

    def _by_scan(self, ids: list[int]) -> list[int]:
        rank = self.rank
        near = [rank.get(p, NONE) for p in zip(ids, ids[1:])]  # at i the rank of parts i and i + 1, joined with their merged id
        while near:
            least = min(near)
            if least == NONE:
                break
            i = near.index(least)
            ids[i] = least & LOW
            del ids[i + 1], near[i]
            if i:
                near[i - 1] = rank.get((ids[i - 1], ids[i]), NONE)
            if i < len(near):
                near[i] = rank.get((ids[i], ids[i + 1]), NONE)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before, heap = [*range(1, n + 1)], [*range(-1, n - 1)], []
        for i in range(n - 1):
            if (r := rank.get((ids[i], ids[i + 1]))) is not None:
                heap.append((r, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            new = r & LOW
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], new))) is not None:
                heapq.heappush(heap, (r, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def piece(self, raw: str) -> bytes:
        """Of a piece without white space."""
        text = raw if raw.isascii() else unicodedata.normalize("NFC", raw)
        text = text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()  # no final sigma
        words = self.words
        if text.isalpha():
            return words.get(text) or self._word(text)
        if text[-1] in SINGLE and (w := text[:-1]).isalpha():
            return (words.get(w) or self._word(w)) + (words.get(text[-1]) or self._word(text[-1]))
        if text.isascii() or not any(map(unassigned, text)):
            found = self.word.findall(text)
        else:  # the pattern's own tables are of a later version than those of the tokenizer
            text = text.translate(LATER_LOWER)
            shown = "".join("\uffff" if unassigned(c) and not any(a <= ord(c) <= z for a, z in LATER_LETTERS) else c for c in text)
            found = [text[m.start() : m.end()] for m in self.word.finditer(shown)]
        return b"".join([words.get(w) or self._word(w) for w in found])

    def _word(self, word: str) -> bytes:
        ids = self.merged(word)
        if len(word) <= MEMO_CHARS:
            if len(self.words) > MEMO:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _span(self, text: str) -> bytes:
        if len(self.known) > MEMO:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, text.split() if not MORE.search(text) else [x for x in SPACE.split(text) if x]))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.at_special is None or "<|" not in text:
            return self._span(text)
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._span(x) for x in self.at_special.split(text))

    def encode_ordinary(self, text: str | None) -> bytes:
        """Special tokens' strings are ordinary text."""
        return self._span(text) if text else b""

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, tokens joined by a space."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; one pass over the texts, no shuffle. Repeated rows stay, a null id stays null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = load(path)
        for b in batches:
            n, hashed, back = [], [], []
            for text in b.column(1):
                ids = bpe.encode(text.as_py())
                n.append(len(ids) // 4)
                hashed.append(sha256(ids).hexdigest())
                back.append(sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"), default_path())
