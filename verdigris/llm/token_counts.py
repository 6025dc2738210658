"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of byte-level vocabularies, and the byte ranges shown as themselves.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]

#: Two blanks in a row.
BLANK_PAIR = re.compile(r"\s\s")

#: Words kept with their counts in a worker, and the longest word that is kept; both only bound memory.
CACHE_WORDS = 600_000
CACHE_LENGTH = 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary file."""
    shown = {b for lo, hi in SHOWN for b in range(lo, hi + 1)}
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(b, chr(b)) for b in range(256)]


class MergeCounter(dict):
    """Number of symbols that are left of a word after all merges; remembers short words.

    A heap holds the adjacent pairs by rank, then place; symbols form a doubly linked list. Each merge
    takes one symbol away, so the count is the number of bytes minus the number of merges."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = {tuple(m): r for r, m in enumerate(spec["model"]["merges"])}
        self.symbols = byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(SPLIT)
        self.spaced = Spaced(self)

    def __missing__(self, word: str) -> int:
        left = self.merged(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = left
        return left

    def merged(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        n = count = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or rank((symbols[i], symbols[j])) != r:
                continue  # an earlier merge changed this pair
            symbols[i] += symbols[j]
            symbols[j] = None
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (p := before[i]) >= 0 and (s := rank((symbols[p], symbols[i]))) is not None:
                heapq.heappush(heap, (s, p))
        return count

    def tokens(self, text: str) -> int:
        """Tokens of a whole text; special strings inside it count as one token each."""
        total = 0
        parts = [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        return total + sum(map(self.plain, parts))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        Where every blank stands alone, a line break is a token and the split pattern always cuts before
        a space, so that lines and spaced words can be counted one by one."""
        if BLANK_PAIR.search(text):
            return sum(self[m.group()] for m in self.split.finditer(text))
        total = text.count("\n")
        for line in text.split("\n"):
            words = line.split(" ")
            if words[0]:
                total += sum(map(self.__getitem__, self.split.findall(words[0])))
            total += sum(map(self.spaced.__getitem__, words[1:]))
        return total


class Spaced(dict):
    """Tokens of a space with the characters up to the next one; remembers short words."""

    def __init__(self, counter: MergeCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = sum(map(self.counter.__getitem__, self.counter.split.findall(" " + word)))
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=4)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a column `out`: tokens of the whole text under the byte-level vocabulary file at `path`.

    A null or empty text has 0 tokens. Texts, words and runs of any length are counted whole: a word of
    n bytes takes n log n steps. Rows keep their order, number and other columns; repeated rows, null
    ids and an empty table need no care, as rows are independent. A column already named `out` is
    replaced. No shuffle; the vocabulary is loaded once per worker from `path`, which every executor
    must have."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = merge_counter(path)
        for batch in batches:
            yield pd.Series([counter.tokens(t) if t else 0 for t in batch], dtype="int64")

    return docs.withColumn(out, tokens(F.col(text)))
