"""Exact token counts of every prefix (operator 3).

Byte-level BPE encodes each match of the splitting pattern by itself.  Inside a match the encoding of a prefix ends in one
certain token: the only vocabulary token that ends there and stands well beside the last token of what
precedes it, where two tokens stand well if encoding their joined bytes gives just these two.  So a dynamic program
over the prefixes stores the last token and the count at each, and the count of a whole match, of any of its
prefixes and of a budget's cut are read off that array; for the match a cut lies in it is kept and goes on where the last question ended.

Scale: a map over documents; memory holds one portion of text and a bounded memo of matches already counted.

Defined cases: null text counts as empty and has no tokens; special strings of the vocabulary inside a text are one
token each, as the library has it by default; repeated rows are counted each; columns beside identifier and text
are not read.  Very long texts and words are read whole.  A prefix is counted as the library counts that prefix alone: one that ends in
white space has its trailing run as one match, one that ends inside a special string or a contraction is split anew from two matches before.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import portions
from tidemark.llm.bpe import SPACE, byte_alphabet

MEMO = 1_200_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


class PrefixCounter:
    """Token counts by dynamic programming over the prefixes of each match."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        raw = {token: bytes(byte_of[c] for c in token) for token in data["model"]["vocab"]}
        self.rank = {(raw[a], raw[b]): i for i, (a, b) in enumerate(data["model"]["merges"])}
        self.made_of = {a + b: ((a, b), i) for (a, b), i in self.rank.items()}
        self.special = [t["content"] for t in data["added_tokens"]]
        self.vocabulary = {t for t in raw.values() if self._stands(t)}
        self.reach = [0] * 256  # longest token that ends in a byte
        for token in self.vocabulary:
            self.reach[token[-1]] = max(self.reach[token[-1]], len(token))
        space = rf"[{SPACE}]"
        pattern = PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", space)
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.memo: dict[str, int] = dict.fromkeys(self.special, 1)
        self.blank = regex.compile(rf"{space}+").fullmatch
        self.kept: tuple | None = None

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The pieces at one edge of a token while it is merged, each with the rank of the merge that makes it."""
        out = []
        while token in self.made_of:
            parts, rank = self.made_of[token]
            out.append((token, rank))
            token = parts[side]
        return [(token, -1), *reversed(out)]

    def _apart(self, left: list[tuple[bytes, int]], right: list[tuple[bytes, int]], final: bool = True) -> bool:
        """True if no merge joins the two edges while both grow.

        Merges come in the order of rank and a piece is always used at a higher rank than it was made, so the two edges
        advance by rank; of equal merges the left one comes first.  Without `final` the meeting of both whole edges is allowed.
        """
        i = j = 0
        while True:
            up = left[i + 1][1] if i + 1 < len(left) else NEVER
            right_up = right[j + 1][1] if j + 1 < len(right) else NEVER
            if up == right_up == NEVER:
                return not final or (left[i][0], right[j][0]) not in self.rank
            joined = self.rank.get((left[i][0], right[j][0]), NEVER)
            if joined < up and joined <= right_up:
                return False
            if up <= right_up:
                i += 1
            else:
                j += 1

    def _stands(self, token: bytes) -> bool:
        """True if a token's bytes are encoded as that token."""
        if token not in self.made_of:
            return True
        (a, b), _ = self.made_of[token]
        return self._apart(self._edge(a, 1), self._edge(b, 0), final=False) and self._stands(a) and self._stands(b)

    def _well(self, before: bytes, token: bytes) -> bool:
        pair = (before, token)
        if (known := self.beside.get(pair)) is None:
            if len(self.beside) > MEMO:
                self.beside.clear()
            known = self.beside[pair] = not before or self._apart(self._edge(before, 1), self._edge(token, 0))
        return known

    def prefixes(self, word: bytes, count: list[int] | None = None, last: list[bytes] | None = None) -> list[int]:
        """Number of tokens of word[:i], for every i from 0 on; goes on from given counts and last tokens, in place."""
        count, last = (count, last) if count else ([0], [b""])
        vocabulary, reach, well = self.vocabulary, self.reach, self._well
        for end in range(len(count), len(word) + 1):
            for start in range(max(0, end - reach[word[end - 1]]), end):
                token = word[start:end]
                if token in vocabulary and well(last[start], token):
                    count.append(count[start] + 1)
                    last.append(token)
                    break
        return count

    def learn(self, matches: Iterable[str]) -> None:
        """Count new matches in sorted order, so each goes on from the prefix it shares with the one before."""
        before, count, last = b"", [0], [b""]
        for word, match in sorted((m.encode(), m) for m in set(matches).difference(self.memo)):
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del count[same + 1:], last[same + 1:]
            self.memo[match] = self.prefixes(word, count, last)[-1]
            before = word

    def matches(self, text: str) -> list[str]:
        """Pattern matches and special strings in order; together they are the text."""
        if not any(s in text for s in self.special):
            return self.split(text)
        return [m for i, part in enumerate(self.cut(text)) for m in ([part] if i % 2 else self.split(part))]

    def count(self, text: str) -> int:
        """Tokens of a text."""
        matches = self.matches(text)
        self.learn(matches)
        return sum(map(self.memo.__getitem__, matches))

    def split_all(self, texts: list[str]) -> list[list[str]]:
        """Matches of every text, all of them counted.  Only here is the memo emptied: what is returned stays in it."""
        if len(self.memo) > MEMO:
            self.memo = dict.fromkeys(self.special, 1)
        split = [self.matches(t) for t in texts]
        self.learn(chain.from_iterable(split))
        return split

    def table(self, matches: list[str]) -> tuple[list[int], list[int]]:
        """Where each match ends, and the tokens up to there."""
        return list(accumulate(map(len, matches))), list(accumulate(map(self.memo.__getitem__, matches)))

    def tables(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        return map(self.table, self.split_all(texts))

    def _kept_count(self, text: str, start: int, size: int) -> int:
        """Tokens of text[start:size], all in one match: read off the kept array, which grows with what is asked."""
        if self.kept is None or self.kept[0] is not text or self.kept[1] != start:
            self.kept = (text, start, start, [0], [0], [b""], b"")
        _, _, upto, at, count, last, word = self.kept
        if size > upto:
            more = [c.encode() for c in text[upto:size]]
            word += b"".join(more)
            at += list(accumulate(map(len, more), initial=at[-1]))[1:]
            self.prefixes(word, count, last)
            self.kept = (text, start, size, at, count, last, word)
        return count[at[size - start]]

    def at_prefix(self, text: str, size: int, ends: list[int], sums: list[int]) -> int:
        """Tokens of text[:size], given where matches end and the tokens up to there."""
        if size <= 0 or not ends:
            return 0
        i = int(np.searchsorted(ends, size, "left"))
        begin = lambda k: ends[k - 1] if k > 0 else 0
        start, final = begin(i), text[size - 1]
        if self.blank(final):
            # At its end a text's white space is one match, wherever the whole text splits it.
            while i > 0 and self.blank(text[start - 1]) and self.blank(text[begin(i - 1):start]):
                i, start = i - 1, begin(i - 1)
            if self.blank(text[start:size]):
                return (sums[i - 1] if i else 0) + self._kept_count(text, start, size)
        if size == ends[i]:
            return sums[i]
        match = text[start:ends[i]]
        if match in self.special or match[0] == "'" and match[1:2].isalpha():
            i = max(0, i - 2)
            return (sums[i - 1] if i else 0) + sum(map(self._alone, self.matches(text[begin(i):size])))
        return (sums[i - 1] if i else 0) + self._kept_count(text, start, size)

    def _alone(self, match: str) -> int:
        return self.memo[match] if match in self.memo else self.prefixes(match.encode())[-1]

    def longest_within(self, text: str, budget: int, ends: list[int], sums: list[int]) -> int:
        """Characters of the longest prefix such that it and all prefixes a few matches shorter have at most `budget` tokens."""
        if not sums or sums[-1] <= budget:
            return len(text)
        i = int(np.searchsorted(sums, budget, "right")) - 3
        size = ends[i] if i >= 0 else 0
        while self.at_prefix(text, size + 1, ends, sums) <= budget:
            size += 1
        return size


@cache
def load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_chars.

    `limit_chars` answers the truncation question: up to how many characters every prefix keeps within `limit` tokens.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary)
        for batch in batches:
            for part in portions(batch, batch.schema.names[1]):
                size, total, fits = [], [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for value, matches in zip(texts, counter.split_all(texts), strict=True):
                    size.append(len(value) if value.isascii() else len(value.encode()))
                    ends, sums = counter.table(matches)
                    total.append(sums[-1] if sums else 0)
                    fits.append(counter.longest_within(value, limit, ends, sums))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()),
                    pa.array([t > limit for t in total], pa.bool_()), pa.array(fits, pa.int64()),
                ], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_chars bigint")


def prefix_table(docs: DataFrame, vocabulary: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ends, tokens: where each match ends (characters) and the exact token count up to there in the whole text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary)
        for batch in batches:
            for part in portions(batch, batch.schema.names[1]):
                tables = list(counter.tables([t or "" for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([e for e, _ in tables], pa.list_(pa.int32())),
                    pa.array([n for _, n in tables], pa.list_(pa.int32()))], names=["doc_id", "ends", "tokens"])

    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id bigint, ends array<int>, tokens array<int>")
