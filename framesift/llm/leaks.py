"""Evaluation items that leaked into documents, whole or in part.

Each item is cut into windows as long as a leak must be (`least` words, or the whole item if it is shorter). A window's
SimHash is the sign of a sum of word vectors, weighted by how rare the words are among all documents. Document windows of the same
lengths slide by one word. Fingerprints are compared by a multi-index over four blocks of 16 bits, each with all values one
bit away, so every pair of fingerprints within a Hamming distance of 7 is met. As a word that can't be read adds nothing, item windows
are also kept with any one or two words left out, where that leads beyond this distance. Pairs met that share enough weight of words are
verified by weighted shingles: along their diagonal the document is read as the item wherever a word may be the damaged form of the item's, and
a window is a case if its shingles of five words, weighted by their words, all agree. (A damaged word spoils five shingles, so fingerprints
are of words: those of shingles would lie far apart.) Very long documents are worked off in slices.

All document windows are fingerprinted but those whose words can't reach the similarity with any item window, which the
verification would turn down. The items are few by nature (`eval_items` has 400 rows at every scale); more are worked off in blocks of `block` items.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.subtitles import dialogue, fold, lossy
from framesift.session import spread

RADIUS = 7
UNREAD = 2
BITS = 64
SHINGLE = 5  # words
SLICE = 50_000  # words whose fingerprints are held together


class Vocabulary:
    """Ids of the items' words by key. 0: any other word; -1: no word at all."""

    def __init__(self, words: list[str]):
        self.keys = sorted({fold(w) for w in words} - {""})
        self.ids = {k: i for i, k in enumerate(self.keys, 1)}
        known: dict[str, int] = {}
        for w in words:
            for k in lossy(w):
                if k and fold(w) in self.ids:
                    known[k] = 0 if known.get(k, self.ids[fold(w)]) != self.ids[fold(w)] else self.ids[fold(w)]
        self.ids = {k: i for k, i in known.items() if i} | self.ids


class Reader(dict):
    """Words as they stand -> ids; of bounded size."""

    def __init__(self, ids: dict[str, int], size: int = 300_000):
        super().__init__()
        self.known, self.size = ids, size

    def __missing__(self, word: str) -> int:
        key = fold(word)
        i = self.known.get(key, 0) if key else -1
        if not i and key[-1] == "�":  # a question mark at the end, or a lost character
            i = self.known.get(key[:-1], 0)
        if len(self) >= self.size:
            self.clear()
        self[word] = i
        return i

    def read(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words of the dialogue and their ids."""
        words = dialogue(text).split()
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if (ids < 0).any():
            keep = np.flatnonzero(ids >= 0)
            words, ids = [words[k] for k in keep.tolist()], ids[keep]
        return words, ids


def signs(keys: list[str]) -> np.ndarray:
    """A row of 1 and -1 for each word."""
    raw = b"".join(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=BITS // 8).digest() for k in keys)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(keys), BITS)
    return bits.astype(np.int16) * 2 - 1


def sums(vectors: np.ndarray) -> np.ndarray:
    """Running sums of the words' weighted vectors."""
    total = np.zeros((len(vectors) + 1, BITS), np.int32)
    np.cumsum(vectors, axis=0, out=total[1:])
    return total


def fingerprints(total: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """SimHashes of the windows of w words at the starts, from the running sums."""
    return np.packbits(total[starts + w] > total[starts], axis=1).view(np.uint64).ravel()


class Index:
    """Fingerprints of item windows of one length."""

    def __init__(self, prints: np.ndarray, item: np.ndarray, at: np.ndarray):
        self.prints, self.item, self.at = prints, item, at
        flips = np.concatenate([[0], 1 << np.arange(16)]).astype(np.uint16)
        self.blocks = []
        for b in range(4):
            values = (self.block(prints, b)[:, None] ^ flips).ravel()
            order = np.argsort(values, kind="stable")
            rows = (order // len(flips)).astype(np.int32)
            self.blocks.append((np.searchsorted(values[order], np.arange(65537)).astype(np.int64), rows))

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.uint16)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): all pairs of given and indexed fingerprints within RADIUS."""
        found_i, found_j = [], []
        for lo in range(0, len(prints), 4096):
            p = prints[lo : lo + 4096]
            for b, (starts, rows) in enumerate(self.blocks):
                v = self.block(p, b).astype(np.int64)
                n = starts[v + 1] - starts[v]
                i = np.repeat(np.arange(len(p)), n)
                j = rows[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[v], n)]
                ok = np.bitwise_count(p[i] ^ self.prints[j]) <= RADIUS
                found_i.append(i[ok] + lo)
                found_j.append(j[ok])
        return np.concatenate(found_i or [np.zeros(0, int)]), np.concatenate(found_j or [np.zeros(0, int)])


class Gaps:
    """Fingerprints of item windows (rows of words) with up to UNREAD words left out, if beyond RADIUS of the whole window's."""

    def __init__(self, words: np.ndarray, whole: np.ndarray, vectors: np.ndarray):
        total = vectors[words].sum(1, dtype=np.int32)
        prints, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for k in range(1, UNREAD + 1):
            for gone in combinations(range(words.shape[1]), k):
                p = np.packbits(total > vectors[words[:, gone]].sum(1, dtype=np.int32), axis=1).view(np.uint64).ravel()
                far = np.flatnonzero(np.bitwise_count(p ^ whole) > RADIUS)
                prints.append(p[far])
                rows.append(far.astype(np.int32))
        p, r = np.concatenate(prints), np.concatenate(rows)
        order = np.lexsort((r, p))
        p, r = p[order], r[order]
        fresh = np.ones(len(p), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
        self.prints, self.rows = p[fresh], r[fresh]
        self.some = np.zeros(1 << 22, bool)
        self.some[self.prints >> np.uint64(42)] = True

    def same(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): all pairs of given fingerprints and windows that have it with words left out."""
        i = np.flatnonzero(self.some[prints >> np.uint64(42)])
        lo = np.searchsorted(self.prints, prints[i])
        n = np.searchsorted(self.prints, prints[i], "right") - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.repeat(i, n), self.rows[at]


def within(a: str, b: str, most: int) -> bool:
    """Whether a and b differ by at most `most` insertions, deletions and replacements; U+FFFD stands for any character."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y and x != "�")))
        if min(row) > most:
            return False
    return row[-1] <= most


def same_word(a: str, b: str) -> bool:
    """Whether the key a of a document's word may be the damaged key b of an item's word."""
    if a == b:
        return True
    if b.isdigit() or a.isdigit() and len(a) > 1:
        return False
    most = max(a.count("�") and 1, len(b) // 4 if len(b) > 3 else 0)
    return most > 0 and within(a, b, most)


def shingle_similarity(doc: list[str], item: list[str], weight: list[int], i: int, j: int, w: int) -> float:
    """Of the windows of w words on the diagonal through doc[i], item[j] the highest share of weighted shingles that agree."""
    back = min(i, j)
    i, j = i - back, j - back
    agree = [same_word(x, y) for x, y in zip(doc[i : i + len(item) - j], item[j:], strict=False)]
    size = min(SHINGLE, w)
    whole = [sum(weight[j + k : j + k + size]) for k in range(len(agree) - size + 1)]
    ok = [x if all(agree[k : k + size]) else 0 for k, x in enumerate(whole)]
    n = w - size + 1  # shingles of a window
    return max((sum(ok[k : k + n]) / sum(whole[k : k + n]) for k in range(len(whole) - n + 1)), default=0.0)


def reach(words: np.ndarray, weight: np.ndarray, similarity: float) -> tuple[np.ndarray, float]:
    """What a document word can add at most to the weight shared with a window (a row of words), by id; the least weight that is enough for a window."""
    often = np.zeros(len(weight), np.int64)
    for y in words:
        np.maximum.at(often, *np.unique(y, return_counts=True))
    return often * weight, similarity * weight[words].sum(1).min() - 1e-9


def similar(ids: np.ndarray, starts: np.ndarray, words: np.ndarray, j: np.ndarray, weight: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the windows of ids at the starts hold enough of the weight of the item windows words[j]."""
    ok = np.zeros(len(j), bool)
    for lo in range(0, len(j), 50_000):
        y = words[j[lo : lo + 50_000]]
        x = ids[starts[lo : lo + 50_000, None] + np.arange(y.shape[1])]
        common = (y[:, :, None] == x[:, None, :]).any(2)
        ok[lo : lo + 50_000] = (weight[y] * common).sum(1) >= similarity * weight[y].sum(1)
    return ok


def _words(passage: str) -> list[str]:
    return [w for w in passage.split() if fold(w)]


def word_counts(documents: DataFrame, text: str, vocabulary: Vocabulary) -> np.ndarray:
    """In how many documents each word of the vocabulary occurs, by id; at 0 the number of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary.ids)
    size = len(vocabulary.keys) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(shared.value), np.zeros(size, np.int64)
        for b in batches:
            for t in b.column(0):
                if t := t.as_py():
                    ids = np.unique(reader.read(t)[1])
                    total[ids[ids > 0]] += 1
                    total[0] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in documents.select(text).mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most a row per word
        counts[r["id"]] = r["n"]
    return counts


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", least: int = 12, similarity: float = 0.6, shingles: float = 1.0, block: int = 4000) -> DataFrame:
    """`doc_id`, `item_id`: documents whose dialogue holds at least `least` consecutive words of an item, or all of a shorter one.

    similarity: the least weighted share of words that two windows have in common, to be aligned. shingles: the least weighted share of
    shingles that agree in a window then; 1 means that all words do, as a case demands. Rows with null key or text and items without words
    give no case; repeated documents and items give one row. Empty tables give no rows.
    """
    spark = documents.sparkSession
    docs = spread(documents.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(item_id, passage).distinct().orderBy(item_id).collect()
    rows = [(r[0], ws) for r in rows if (ws := _words(r[1]))]
    if not rows:
        return spark.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}")
    vocabulary = Vocabulary([w for _, ws in rows for w in ws])
    counts = word_counts(docs, "text", vocabulary)
    found = [_block(spark, docs, rows[lo : lo + block], vocabulary, counts, least, similarity, shingles, kinds) for lo in range(0, len(rows), block)]
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out.distinct()


def _block(spark: SparkSession, docs: DataFrame, rows: list, vocabulary: Vocabulary, counts: np.ndarray, least: int, similarity: float, shingles: float, kinds: tuple[str, str]) -> DataFrame:
    idf = np.log((counts[0] + 1) / (counts + 1))
    weight = np.clip(np.round(idf), 1, 12).astype(np.int16)
    vectors = np.zeros((len(weight), BITS), np.int16)  # other words add nothing
    vectors[1:] = signs(vocabulary.keys) * weight[1:, None]
    keys = [[fold(w) for w in ws] for _, ws in rows]
    ids = [np.array([vocabulary.ids[k] for k in ks]) for ks in keys]
    parts: dict[int, list] = {}
    for n, x in enumerate(ids):
        w = min(least, len(x))
        starts = np.arange(len(x) - w + 1)
        parts.setdefault(w, []).append((fingerprints(sums(vectors[x]), starts, w), np.full(len(starts), n), starts, x[starts[:, None] + np.arange(w)]))
    index = {}
    for w, ps in parts.items():
        *prints, words = map(np.concatenate, zip(*ps, strict=True))
        index[w] = Index(*prints), Gaps(words, prints[0], vectors), words, *reach(words, weight, similarity)
    kind = pa.int64() if kinds[1] in ("bigint", "int") else pa.string()
    heavy = [weight[x].tolist() for x in ids]
    shared = spark.sparkContext.broadcast((vocabulary.ids, vectors, weight, index, keys, heavy, [i for i, _ in rows]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vectors, weight, index, keys, heavy, names = shared.value
        reader = Reader(known)
        shortest, longest = min(index), max(index)

        def verified(group: list) -> Iterator[tuple]:
            """(document, item) of the documents (key, words, ids)."""
            size = [len(ids) for _, _, ids in group]
            at, doc, ids = np.cumsum([0, *size]), np.repeat(np.arange(len(group)), size), np.concatenate([ids for _, _, ids in group])
            pairs: list[np.ndarray] = []
            for lo in range(0, len(ids), SLICE):
                here, of = ids[lo : lo + SLICE + longest - 1], doc[lo : lo + SLICE + longest - 1]
                total = sums(vectors[here])
                for w, (ix, gaps, words, most, need) in index.items():
                    starts = np.arange(max(0, min(SLICE, len(here) - w + 1)))
                    most = np.concatenate([[0], np.cumsum(most[here])])
                    starts = starts[(of[starts] == of[starts + w - 1]) & (most[starts + w] - most[starts] >= need)]
                    prints = fingerprints(total, starts, w)
                    i, j = (np.concatenate(x) for x in zip(ix.near(prints), gaps.same(prints), strict=True))
                    s = starts[i]
                    ok = similar(here, s, words, j, weight, similarity)
                    d, s, j = of[s[ok]], s[ok] + lo, j[ok]
                    pairs.append(np.stack([d, ix.item[j], s - at[d] - ix.at[j], s - at[d], np.full(len(s), w)], 1))
            found: set[tuple[int, int]] = set()
            tried: set[tuple[int, int, int]] = set()
            folded: dict[int, list[str]] = {}
            for d, n, off, s, w in np.unique(np.concatenate(pairs), axis=0).tolist():
                if (d, n) in found or (d, n, off) in tried:
                    continue
                tried.add((d, n, off))
                if d not in folded:
                    folded[d] = [fold(x) for x in group[d][1]]
                if shingle_similarity(folded[d], keys[n], heavy[n], s, s - off, w) >= shingles:
                    found.add((d, n))
            yield from ((group[d][0], names[n]) for d, n in sorted(found))

        for b in batches:
            out: list[tuple] = []
            group: list = []
            held = 0
            for d, t in zip(b.column(0), b.column(1), strict=True):
                words, ids = reader.read(t.as_py())
                if len(ids) >= shortest:
                    group.append((d.as_py(), words, ids))
                    held += len(ids)
                    if held > SLICE:
                        out += verified(group)
                        group, held = [], 0
            if group:
                out += verified(group)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], b.schema.field(0).type), pa.array([n for _, n in out], kind)], names=["doc_id", "item_id"])

    return docs.mapInArrow(search, f"doc_id {kinds[0]}, item_id {kinds[1]}")
