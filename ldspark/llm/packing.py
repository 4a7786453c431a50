"""Best-fit-decreasing packing of tokenised documents into sequences of CAPACITY tokens.

Best fit only looks at lengths, and there are at most CAPACITY of them, so the packing of any number of
pieces follows from their histogram. `plan` runs best-fit decreasing on it: open bins with the same room
are interchangeable and kept as runs of consecutive numbers, a segment tree over remaining capacities
finds the tightest room that still fits in logarithmic time, and one step places a whole run of equal
pieces. The plan says, for each length, which ranks of its pieces go where; its size depends on
CAPACITY, not on the corpus. The pieces then get their ranks in parallel (salted where a length is
frequent) and look their places up. The result is that of one sequential best-fit-decreasing pass.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import map_batches, written

CAPACITY, END = 2048, 0
#: Groups that get ranks one after another; a group has about N / GROUPS rows, or GROUP_ROWS if more.
GROUPS, GROUP_ROWS = 1 << 16, 256


def _byte_of() -> dict[str, int]:
    """A byte-level vocabulary's letters: printable bytes stand for themselves, the others for the code points from
    256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def encoder(json_file: str, pattern: str):
    """The byte-level BPE of a tokenizers file. It gives the ids that the tokenizers library gives with that file,
    its added tokens included (held against it in the tests), several times faster."""
    import tiktoken

    with open(json_file, encoding="utf-8") as f:
        found = json.load(f)
    letters = _byte_of()
    ranks = {bytes(letters[c] for c in token): rank for token, rank in found["model"]["vocab"].items()}
    added = {t["content"]: t["id"] for t in found["added_tokens"]}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def default_encoder():
    import public_tokenizers

    return encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def token_ids(text: str | None, enc) -> np.ndarray:
    """Ids of the text (null: empty) and the end id, as unsigned 32-bit integers."""
    ids = enc.encode_to_numpy(text, allowed_special="all") if text else []
    return np.append(np.asarray(ids, "<u4"), np.uint32(END)).astype("<u4")


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of n ids: all have `capacity` ids but perhaps the first."""
    return [0, *range(n % capacity or capacity, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, with_ids: bool = False, capacity: int = CAPACITY, make_encoder=default_encoder) -> DataFrame:
    """The pieces of each document's ids; with_ids adds the ids themselves, 32 bits each.

    Null text is as empty: one piece, the end id. Repeated rows have pieces each; other columns are left out."""

    def make():
        enc = make_encoder()

        def one(batch):
            rows, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = token_ids(text, enc)
                starts = cuts(len(mine), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(mine)], strict=True)):
                    rows.append((doc, k, a, b - a, zlib.crc32(mine[a:b].tobytes())))
                if with_ids:
                    ids.append(mine)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.cumsum([0, *(r[3] for r in rows)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

        return one

    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return map_batches(picked, make, PIECES + (", ids array<int>" if with_ids else ""))


class Room:
    """Segment tree over remaining capacities: which have an open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        k = self.size + room
        while k:
            self.tree[k] += by
            k >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` with an open bin."""
        k = self.size + least
        if self.tree[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.tree[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k + (not self.tree[2 * k])
                return k - self.size
            k >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing: rows (length, first rank, how many, first bin, how many in each bin, offset
    of the first in its bin). Rank t of a row goes to bin first + t // each, at offset + t % each * length."""
    room, runs, rows, bins = Room(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            runs.setdefault(left, []).append((first, n))
            room.add(left, 1)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens")
        n, rank = histogram[length], 0
        while n:
            if (left := room.tightest(length)) is None:
                left, each = capacity, capacity // length
                first, have = bins, -(-n // each)
                bins += have
            else:
                first, have = runs[left].pop()
                room.add(left, -1)
                each = left // length
            # equal pieces fill the tightest bin until it has no room, then the next one like it
            full = min(have, n // each)
            if full:
                rows.append((length, rank, full * each, first, each, capacity - left))
                put(left - each * length, first, full)
                n, rank, first, have = n - full * each, rank + full * each, first + full, have - full
            if n and have and n < each:
                rows.append((length, rank, n, first, n, capacity - left))
                put(left - n * length, first, 1)
                n, rank, first, have = 0, rank + n, first + 1, have - 1
            put(left, first, have)
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    Equal lengths go in order of a salted hash, then doc_id, piece, start; ties are repeated rows, any of
    which may take either place. No pieces give no rows. More columns are kept; columns of no fixed size (ids) stay
    out of the ranking and join its result by a row number."""
    wide = [f.name for f in pieces.schema.fields if not isinstance(f.dataType, T.NumericType)]
    stored = written(pieces.withColumn("__row", F.monotonically_increasing_id()) if wide else pieces, "pieces")
    placed = _placed(stored.drop(*wide), capacity)
    if not wide:
        return placed
    placed = written(placed, "places")
    return stored.select("__row", *wide).join(placed, "__row").select(*pieces.columns, "sequence_id", "offset")


def _placed(pieces: DataFrame, capacity: int) -> DataFrame:
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(histogram, capacity)
    most = max(GROUP_ROWS, sum(histogram.values()) // GROUPS)
    salts = F.array(*[F.lit(-(-histogram.get(k, 0) // most) or 1) for k in range(capacity + 1)])
    salted = pieces.withColumn("__salt", F.expr("pmod(xxhash64(doc_id, piece, start), 2147483647)") % F.get(salts, F.col("length").cast("int")))
    counts = sorted((r["length"], r["__salt"], r["n"]) for r in salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).collect())
    before, offsets = {}, {}
    for length, salt, n in counts:  # at most GROUPS + capacity rows
        offsets[length, salt] = before.get(length, 0)
        before[length] = before.get(length, 0) + n
    key = lambda length, x: (length << 48) | x
    sent = spark.sparkContext.broadcast((
        np.array([key(r[0], r[1]) for r in rows], np.int64), np.array(rows, np.int64).reshape(-1, 6),
        np.array([key(*k) for k in offsets], np.int64), np.array([*offsets.values()], np.int64),
    ))
    names = [*pieces.columns]
    at = names.index("length")

    def make():
        keys, table, salt_keys, salt_offsets = sent.value
        order = np.argsort(keys)
        keys, table = keys[order], table[order]

        def one(batch):
            length, salt, nth = (batch.column(i).to_numpy() for i in (at, len(names), len(names) + 1))
            rank = salt_offsets[np.searchsorted(salt_keys, (length << 48) | salt)] + nth - 1
            _, first_rank, _, first, each, offset = table[np.searchsorted(keys, (length << 48) | rank, side="right") - 1].T
            t = rank - first_rank
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))] + [pa.array(first + t // each), pa.array(offset + t % each * length)],
                [*names, "sequence_id", "offset"],
            )

        return one

    ranked = salted.withColumn("__nth", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start")).cast("long"))
    ranked = ranked.select(*names, F.col("__salt").cast("long").alias("__salt"), "__nth")
    return map_batches(ranked, make, T.StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long"))
