"""Encoding of texts with a public byte-level BPE vocabulary.

Merging uses a hierarchical-bitmap rank queue: each merge rank has a bucket of positions in a linked list of symbols, three
levels of bitmaps say which buckets hold anything, find-first-set gives the lowest rank, and entries whose symbols have
changed meanwhile are skipped. A pre-token of n bytes takes O(n) queue operations, however long it is. As a token's rank is
above those of its parts, the queue never has to go back.

Texts are cut in front of white space behind other characters and between numerals and others, where no pre-token can reach
across; the ids of such pieces are kept in a cache of bounded size. One pass over the documents, no shuffle.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> rank, which is also the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _uncommon() -> str:
    """Numerals and white space but those that the usual way of cutting knows, as a character class."""
    has = lambda c: (c.isspace() or unicodedata.category(c)[0] == "N") and c not in " \t\n\r0123456789"
    ks = [k for k in range(0x110000) if has(chr(k))]
    ends = [k for k in ks if not has(chr(k + 1))]
    starts = [k for k in ks if not has(chr(k - 1))]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]"


class Encoder:
    """Token ids of texts. pieces: how many pieces the cache may hold, each of at most 40 characters."""

    def __init__(self, ranks: dict[bytes, int], pieces: int = 400_000):
        import regex

        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        # two ids as one number -> the rank, and id, of what they merge to
        self.pairs = {ranks[t[:i]] << 20 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.low = [0] * (len(ranks) // 64 + 2)
        self.mid = [0] * (len(ranks) // 4096 + 2)
        self.pretokens = regex.compile(PATTERN).findall
        self.common = re.compile(r"[ \n\r\t]*(?:[0-9]+|[^ \n\r\t0-9]+)|[ \n\r\t]+").findall
        self.uncommon = re.compile(_uncommon()).search
        outer = self

        class Cache(dict):
            def __missing__(self, piece: str) -> list[int]:
                ids = list(outer.split(piece))
                if len(piece) <= 40:
                    if len(self) >= pieces:
                        self.clear()
                    self[piece] = ids
                return ids

        class Words(dict):
            def __missing__(self, word: str) -> list[int]:
                ids = outer.merge(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 40:
                    if len(self) >= pieces:
                        self.clear()
                    self[word] = ids
                return ids

        self.cache, self.words = Cache(), Words()

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token.

        Bit i of top says that mid[i] isn't 0, bit i of mid[t] that low[64 t + i] isn't 0, bit i of low[m] that the bucket of
        rank 64 m + i holds positions. All are 0 again at the end."""
        whole = self.ranks.get(token)
        if whole is not None:
            return [whole]
        sym = [self.bytes[b] for b in token]
        n = len(sym)
        pair, low, mid, top = self.pairs.get, self.low, self.mid, 0
        buckets: dict[int, list[int]] = {}
        for i in range(n - 1):
            r = pair(sym[i] << 20 | sym[i + 1])
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    low[r >> 6] |= 1 << (r & 63)
                    mid[r >> 12] |= 1 << (r >> 6 & 63)
                    top |= 1 << (r >> 12)
        if not top:
            return sym
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while top:
            t = (top & -top).bit_length() - 1
            m = t << 6 | (mid[t] & -mid[t]).bit_length() - 1
            rank = m << 6 | (low[m] & -low[m]).bit_length() - 1
            low[m] &= low[m] - 1
            if not low[m]:
                mid[t] &= mid[t] - 1
                if not mid[t]:
                    top &= top - 1
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                j = after[i]
                if j >= n or sym[i] < 0 or pair(sym[i] << 20 | sym[j]) != rank:
                    continue  # stale
                sym[i], sym[j] = rank, -1
                k = after[i] = after[j]
                h = before[i]
                if k < n:
                    before[k] = i
                for at, other in ((i, k), (h, i)):
                    if at >= 0 and other < n:
                        r = pair(sym[at] << 20 | sym[other])
                        if r is not None:
                            if r in buckets:
                                buckets[r].append(at)
                            else:
                                buckets[r] = [at]
                                low[r >> 6] |= 1 << (r & 63)
                                mid[r >> 12] |= 1 << (r >> 6 & 63)
                                top |= 1 << (r >> 12)
        return [x for x in sym if x >= 0]

    def split(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.words.__getitem__, self.pretokens(text)))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids as int32; none for a null or empty text."""
        if not text:
            return np.empty(0, np.int32)
        if self.uncommon(text):
            return np.fromiter(self.split(text), np.int32)
        return np.fromiter(chain.from_iterable(map(self.cache.__getitem__, self.common(text))), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "surrogatepass")


_encoders: dict[int, Encoder] = {}


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`key` and `ids`, the list of token ids of `text`, for each row. Null and empty texts give an empty list; repeated rows
    come out repeatedly. The vocabulary, of fixed size, is read on the driver and broadcast."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if id(shared.value) not in _encoders:
            _encoders.clear()
            _encoders[id(shared.value)] = Encoder(shared.value)
        encoder = _encoders[id(shared.value)]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                ids = [encoder.encode(x.as_py()) for x in b.column(1)]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], names=[key, "ids"])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
