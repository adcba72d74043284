"""BPE encoding and decoding in batched numpy merge rounds (operator 8).

The distinct words of a batch lie in one flat symbol array.  A round looks up every adjacent pair by binary
search in the sorted pair keys, takes the lowest rank of each word and merges all its occurrences from the left;
rounds go on until no word has a pair left.  Words of over LONG_WORD bytes are merged by a queue of pairs.  Words already seen by the worker come from a bounded memo.

Texts are treated as the tokenizer file says: special strings are cut out of the raw text first, the rest
is put into NFC and lower case, white space is dropped and the pattern's matches are the words.

Scale: a map over documents, no shuffle, memory bounded by the memo and one portion of text.

Defined cases: null text counts as empty and gives no ids; the digests of nothing are those of the empty
string; very long texts and words are encoded whole; repeated rows are encoded each; columns beside identifier and text are not read.  Code points without
a character in Unicode 16 may be classed otherwise than by the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import portions

MEMO_WORDS = 400_000
LONG_WORD = 512  # bytes; rounds take time in the square of a word's length
SPACE = r"\t-\r \x85\xa0  -     　"
SCHEMA = "doc_id bigint, ids array<int>, decoded string"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """Printable stand-in of every byte: itself where it is visible, else the next free code point from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """Vocabulary and merges of a word-end BPE file, ready for batched rounds."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = np.empty(max([*vocab.values(), *self.special.values()]) + 1, object)
        for table in (vocab, self.special):
            for token, i in table.items():
                self.tokens[i] = token
        merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64)
        keys = merges[:, 0] << 32 | merges[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), merges[order, 2]
        alphabet = byte_alphabet()
        self.inner = np.array([vocab.get(c, -1) for c in alphabet], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in alphabet], np.int64)
        pattern = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.find = regex.compile(pattern.replace(r"\s", SPACE)).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.ranked: dict | None = None

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word: batched rounds for words of up to LONG_WORD bytes, a queue of pairs for each longer one."""
        long = [i for i, w in enumerate(words) if len(w.encode()) > LONG_WORD]
        if not long:
            return self.merge_rounds(words)
        out: list[np.ndarray | None] = [None] * len(words)
        for i in long:
            out[i] = self.merge_queue(words[i].encode())
        short = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(short, self.merge_rounds([words[i] for i in short]) if short else (), strict=True):
            out[i] = ids
        return out

    def merge_queue(self, word: bytes) -> np.ndarray:
        """Ids of one word: pairs leave a queue by (rank, place); each merge puts its two new pairs in, so a word of n bytes takes n log n steps."""
        rank = self._pair_ranks()
        symbol = self.inner[np.frombuffer(word, np.uint8)].tolist()
        symbol[-1] = int(self.final[word[-1]])
        after = [*range(1, len(symbol)), -1]
        before = list(range(-1, len(symbol) - 1))
        queue = [(*rank[pair], i, pair[0], pair[1]) for i, pair in enumerate(zip(symbol[:-1], symbol[1:])) if pair in rank]
        heapq.heapify(queue)
        while queue:
            _, made, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of the two was merged meanwhile
            symbol[i], symbol[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (symbol[left], symbol[right]) in rank:
                    heapq.heappush(queue, (*rank[symbol[left], symbol[right]], left, symbol[left], symbol[right]))
        return np.array([s for s in symbol if s != -1], np.int64)

    def _pair_ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) -> (rank, id of the merged pair)."""
        if self.ranked is None:
            self.ranked = {(k >> 32, k & 0xFFFFFFFF): (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made.tolist(), strict=True)}
        return self.ranked

    def merge_rounds(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; a round merges the lowest pair of every word."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(raw)), lengths)
        symbol = self.inner[data]
        last = np.cumsum(lengths) - 1
        symbol[last] = self.final[data[last]]
        done_owner, done_symbol = [], []
        high = len(self.keys)
        while len(symbol):
            pair = symbol[:-1] << 32 | symbol[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == high] = 0
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], high)
            rank = np.append(rank, high)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(rank, starts)
            live = np.repeat(lowest < high, sizes)
            if not live.all():
                done_owner.append(owner[~live])
                done_symbol.append(symbol[~live])
            hit = live & (rank == np.repeat(lowest, sizes))
            # Of touching hits (a a a) every second one counts, from the left.
            position = np.flatnonzero(hit)
            run = np.cumsum(np.append(True, np.diff(position) != 1)) - 1 if len(position) else position
            first = np.zeros(run[-1] + 1 if len(run) else 0, np.int64)
            first[run[::-1]] = position[::-1]
            position = position[(position - first[run]) % 2 == 0]
            symbol[position] = self.made[at[position]]
            live[position + 1] = False
            symbol, owner = symbol[live], owner[live]
        owner, symbol = np.concatenate(done_owner), np.concatenate(done_symbol)
        symbol = symbol[np.argsort(owner, kind="stable")]
        return np.split(symbol, np.cumsum(np.bincount(owner, minlength=len(raw)))[:-1])

    def pieces(self, text: str) -> list[str]:
        """Words and special strings of a text in order; special ones start with a NUL."""
        if not any(s in text for s in self.special):
            return self.find(self.normal(text))
        out: list[str] = []
        for i, part in enumerate(self.cut(text)):
            out += ["\0" + part] if i % 2 else self.find(self.normal(part))
        return out

    @staticmethod
    def normal(text: str) -> str:
        # A capital sigma becomes the plain small one wherever it stands.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, texts: list[str]) -> Iterator[list[tuple[int, str, str]]]:
        """For each text its words as (number of ids, ids in decimal, tokens), joined by spaces."""
        split = [self.pieces(t) for t in texts]
        wanted = set().union(*split) if split else set()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = [w for w in wanted if w not in self.memo]
        memo = {w: self.memo[w] for w in wanted if w in self.memo} if len(new) > MEMO_WORDS else self.memo
        plain = [w for w in new if w[0] != "\0" or w[1:] not in self.special]
        for word, ids in zip(plain, self.merge(plain) if plain else [], strict=True):
            memo[word] = (len(ids), " ".join(map(str, ids.tolist())), " ".join(self.tokens[ids]))
        for word in set(new).difference(plain):
            memo[word] = (1, str(self.special[word[1:]]), word[1:])
        for words in split:
            yield [memo[w] for w in words]


@cache
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for part in portions(batch, batch.schema.names[1]):
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def encode_decode(docs: DataFrame, vocabulary: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded: the ids of every text and the text they decode to."""
    def run(batches):
        bpe = load(vocabulary)
        for ids, texts in _texts(batches):
            rows = list(bpe.encode(texts))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([[int(i) for w in row for i in w[1].split()] for row in rows], pa.list_(pa.int32())),
                pa.array([" ".join(w[2] for w in row) for row in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, SCHEMA)


def encoding_digests(docs: DataFrame, vocabulary: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the digest form of `encode_decode`, made in the same pass."""
    def run(batches):
        bpe = load(vocabulary)
        for ids, texts in _texts(batches):
            counts, first, second = [], [], []
            for row in bpe.encode(texts):
                counts.append(sum(w[0] for w in row))
                first.append(hashlib.sha256(" ".join([w[1] for w in row]).encode()).hexdigest())
                second.append(hashlib.sha256(" ".join([w[2] for w in row]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(first, pa.string()),
                                              pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, DIGESTS)
