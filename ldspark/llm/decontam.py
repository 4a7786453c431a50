"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A window of as many words as an item is compared with the items of that size. Its fingerprint is the
SimHash of its shingles of SHINGLE words, each weighted by its letters. Fingerprints are cut into BLOCKS
blocks; two that differ in at most RADIUS bits have a block that differs in at most RADIUS // BLOCKS, so
probing each block's neighbourhood finds all of them. Those found are verified by weighted Jaccard
similarity of shingles, multiplicity included, of at least SIMILARITY.

A window with any similarity holds a shingle of the item, so only windows around such shingles get
fingerprints; that loses nothing. (At similarity 0.8 fingerprints differ by about 10 of 64 bits with a
deviation of 3, so RADIUS 23 loses about one window in 100,000.)

The items are a stated query set: they are sent to every task in blocks of at most BLOCK_CHARS
characters, and each document passes every block, so no documents are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import map_batches
from .words import shingle_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 8, 23
BLOCK_CHARS = 16_000_000
#: Window starts that get fingerprints at once.
WINDOWS = 4096

#: Words as in words.py, so that both count alike.
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    """All shingles in order; fewer words than a shingle has are one shingle."""
    n = min(SHINGLE, len(words))
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] if words else []


def weight(shingle: tuple[str, ...]) -> int:
    return sum(map(len, shingle))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: weights times the smaller over the larger multiplicity."""
    common = sum(weight(s) * n for s, n in (a & b).items())
    whole = sum(weight(s) * n for s, n in (a | b).items())
    return common / whole if whole else 0.0


def signed(shingle: tuple[str, ...]) -> np.ndarray:
    """The shingle's weight with the sign of each bit of its hash."""
    h = np.array([xxhash.xxh64_intdigest("\0".join(shingle).encode())], "<u8")
    return (np.unpackbits(h.view(np.uint8)).astype(np.int64) * 2 - 1) * weight(shingle)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1)


#: All changes of at most RADIUS // BLOCKS bits of a block.
_NEAR = np.array([sum(1 << k for k in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(BITS // BLOCKS), n)], np.uint8)


class HammingIndex:
    """Fingerprints of BLOCKS bytes, each block with its own index."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.by_block = [defaultdict(list) for _ in range(BLOCKS)]
        for k, p in enumerate(prints):
            for block, value in zip(self.by_block, p, strict=True):
                block[int(value)].append(k)

    def within(self, p: np.ndarray) -> dict[int, int]:
        """Every stored print within RADIUS of p, with its distance."""
        found: set[int] = set()
        for block, value in zip(self.by_block, p, strict=True):
            for v in (_NEAR ^ value).tolist():
                found.update(block.get(v, ()))
        if not found:
            return {}
        at = np.fromiter(found, int, len(found))
        far = np.bitwise_count(self.prints[at] ^ p).sum(axis=1)
        return {int(k): int(d) for k, d in zip(at, far, strict=True) if d <= RADIUS}


class Matcher:
    """Items, grouped by their number of words, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]):
        by_size = defaultdict(list)
        for item, text in items:
            if words := words_of(text):
                by_size[len(words)].append((item, words))
        self.sizes: dict[int, tuple[list, list[Counter], HammingIndex]] = {}
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for size, group in by_size.items():
            counts = [Counter(shingles(w)) for _, w in group]
            prints = np.array([fingerprints(sum(signed(s) * n for s, n in c.items())) for c in counts])
            self.sizes[size] = ([i for i, _ in group], counts, HammingIndex(prints))
            width = min(size, SHINGLE)
            for _, w in group:
                for h in shingle_hashes(word_hashes(" ".join(w)), width).tolist():
                    seeds[width][h].add(size)
        #: For each width of shingles the items' hashes in order, the sizes of their items, and which first
        #: 16 bits occur, which spares most look-ups.
        self.seeds = {}
        for width, found in seeds.items():
            codes = np.array(sorted(found), np.uint64)
            first = np.zeros(1 << 16, bool)
            first[codes >> np.uint64(48)] = True
            self.seeds[width] = codes, [found[c] for c in codes.tolist()], first

    def _seeded(self, hashes: np.ndarray) -> dict[int, list[int]]:
        """For each item size the places among the words' hashes where a shingle of such an item begins."""
        out: dict[int, list[int]] = defaultdict(list)
        for width, (codes, sizes, first) in self.seeds.items():
            if len(hashes) < width:
                continue
            h = shingle_hashes(hashes, width)
            places = np.flatnonzero(first[h >> np.uint64(48)])
            if len(places):
                at = np.minimum(np.searchsorted(codes, h[places]), len(codes) - 1)
                hit = codes[at] == h[places]
                for place, k in zip(places[hit].tolist(), at[hit].tolist(), strict=True):
                    for size in sizes[k]:
                        out[size].append(place)
        return out

    def matches(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, distance) of each item's best window, by item; ties go to
        the first window. Empty for null or empty text."""
        best: dict[int, tuple[float, int, int, int]] = {}
        found = self._seeded(word_hashes(text))
        words = words_of(text) if found else []
        for size, places in found.items():
            items, counts, index = self.sizes[size]
            last = max(0, len(words) - size)
            # windows that hold a place begin up to size - 1 words before it; of any number of places one array a text
            at, step = np.unique(places), np.zeros(last + 2, np.int64)
            np.add.at(step, np.clip(at - size + 1, 0, last), 1)
            np.add.at(step, np.clip(at, 0, last) + 1, -1)
            starts = np.flatnonzero(step.cumsum() > 0)
            for part in np.split(starts, range(WINDOWS, len(starts), WINDOWS)):
                self._search(words, size, part, items, counts, index, best)
        return [(i, s, a, n, d) for i, (s, a, n, d) in sorted(best.items())]

    def _search(self, words, size, starts, items, counts, index, best) -> None:
        lo, hi = int(starts[0]), min(len(words), int(starts[-1]) + size)
        here = shingles(words[lo:hi])
        width = len(words[lo:hi]) - len(here) + 1  # words of a shingle
        width = min(width, size)
        if len(here) and len(here[0]) > width:
            here = [tuple(words[k : k + width]) for k in range(lo, hi - width + 1)]
        known: dict = {}
        rows = np.array([known[s] if s in known else known.setdefault(s, signed(s)) for s in here])
        sums = np.vstack([np.zeros((1, BITS), np.int64), rows.cumsum(axis=0)])
        a = starts - lo
        b = np.minimum(a + max(1, size - width + 1), len(here))
        for start, x, y, p in zip(starts.tolist(), a.tolist(), b.tolist(), fingerprints(sums[b] - sums[a]), strict=True):
            for k, far in index.within(p).items():
                s = similarity(Counter(here[x:y]), counts[k])
                if s >= SIMILARITY and (items[k] not in best or s > best[items[k]][0]):
                    best[items[k]] = (s, start, min(size, len(words) - start), far)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """The items in blocks that fit in a task. Items without words can't be found and are left out."""
    blocks, size = [[]], 0
    rows = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        if blocks[-1] and size + len(text) > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((item, text))
        size += len(text)
    return blocks


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, similarity (6 decimals),
    first_word, n_words, distance. Repeated documents give repeated rows; documents without any, or with null or
    empty text, give none; an empty table on either side gives none. Ties go to the first window. Texts are read
    whole; memory is in proportion to the longest one, also where it repeats an item's words throughout."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long, distance long"
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent):
            matcher = Matcher(sent.value)

            def one(batch):
                rows = [(doc, i, round(s, 6), a, n, d) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                        for i, s, a, n, d in matcher.matches(text)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

            return one

        found = map_batches(picked, make, schema)
        out = out.unionByName(found) if out else found
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text contains no item."""
    spark, schema = docs.sparkSession, T.StructType([*docs.schema.fields])
    at = docs.columns.index("text")
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent):
            matcher = Matcher(sent.value)

            def one(batch):
                yield batch.filter(pa.array([not matcher.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

            return one

        docs = map_batches(docs, make, schema)
    return docs
