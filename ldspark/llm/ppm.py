"""Language-model scores by prediction by partial matching over a byte-context trie.

Text is lower-cased (A-Z), split at ASCII white space, joined by single spaces and closed by a line
feed, which no token can hold; so the model predicts the same events as a unigram over those tokens.
A symbol is predicted in the longest context of at most ORDER bytes in which it was seen; each longer
context that is known gives up its escape probability, and its symbols are excluded below it.

The trie holds every gram of up to ORDER + 1 bytes of all training texts, so it grows with them, and no
task holds it whole. A symbol's score depends on its (ORDER + 1)-byte gram alone; so a block of texts sends
its different grams, with their counts in training texts, to buckets by the three bytes before the symbol.
All contexts of three bytes or more that matter to a gram end in these, so a bucket's part of the trie is
complete; counts of shorter grams (at most 2^24 of three bytes) go to every bucket. Its answers go back to
the blocks. Words for the unigram base go the same way. With T occurrences, symbols of total M and D in number, of which X and E are excluded by the
longer context (M is T here; a trie with entries left out gives what a context lost to its escape):

    P(s) = n(s) / (T - X + D - E)        P(escape) = (T - M + D - E) / (T - X + D - E)

and below the empty context all bytes not yet excluded are equally likely.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import id_crc, written
from .words import mix

ORDER = 5
#: Bytes of the grams whose counts every bucket has.
SHORT = 3
#: Bytes scored or counted at once.
PART = 1 << 20
#: A block ends with so many bytes; there is a bucket for so many characters.
BLOCK, BUCKET_CHARS = 6 << 20, 12_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def stream_of(tokens: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\n" * ORDER + b" ".join(tokens) + b"\n", np.uint8)


def grams(stream: np.ndarray) -> np.ndarray:
    """For each position after the first ORDER the code of its byte and the ORDER bytes before, the
    oldest in the highest place."""
    n = len(stream) - ORDER
    out = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        out <<= np.uint64(8)
        out |= stream[k : k + n]
    return out


class Table:
    """Open addressing over 64-bit keys: find() gives places in the arrays that came with the keys."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.keys = np.full(1 << bits, -1, np.int32), keys
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask
        self.slot_keys = np.zeros(len(self.slots), np.uint64)
        self.slot_keys[self.slots >= 0] = keys[self.slots[self.slots >= 0]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where there is none."""
        at = self._home(keys)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.slot_keys[at] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found = self.slots[at]
            out[left] = found
            more = (found >= 0) & (self.slot_keys[at] != keys[left])
            left, at = left[more], at[more]
        return out


class Trie:
    """entries: for each order k the kept (gram of k + 1 bytes, count); contexts: (context of k bytes, T)."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(entries) - 1
        self.entry, self.node, self.value, self.give_up = [], [], [], []
        below: dict = {}
        for k in range(self.order + 1):
            (codes, counts), (ctx, total) = entries[k], contexts[k]
            entry, node = Table(codes), Table(ctx)
            parent = node.find(codes >> np.uint64(8))
            size = len(ctx) + 1  # the last place is for contexts that are not there
            kept = np.bincount(parent, counts, size)
            kinds = np.bincount(parent, minlength=size).astype(float)
            here = {"T": np.append(total, 0).astype(float), "M": kept, "D": kinds, "n": np.append(counts, 0).astype(float), "entry": entry, "X": np.zeros(size)}
            if k:  # what this context's symbols take away from the next shorter one
                low = codes & np.uint64((1 << 8 * k) - 1)
                here["X"] = np.bincount(parent, below["n"][below["entry"].find(low)], size)
            self.entry.append(entry)
            self.node.append(node)
            self.value.append(here)
            below = here
        # of the entries in the longest context; the last place is for those that are not there
        self.longest = np.append(np.log10(counts / (here["T"] + here["D"])[parent]), 0.0)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the bytes before it."""
        hit = self.entry[-1].find(codes)
        out = self.longest[hit]  # most are in the longest context
        left = np.flatnonzero(hit < 0)
        out[left] = 0.0
        codes, taken, kinds = codes[left], 0.0, 0.0  # X and E from the longer context
        for k in range(self.order, -1, -1):
            if not len(left):
                return out
            v, code = self.value[k], codes & np.uint64((1 << 8 * (k + 1)) - 1)
            node = self.node[k].find(code >> np.uint64(8))
            known = node >= 0
            whole = np.where(known, v["T"][node] - taken + v["D"][node] - kinds, 1.0)
            found = np.zeros(len(left), bool)
            if k < self.order:
                hit = self.entry[k].find(code)
                found = hit >= 0
                out[left[found]] += np.log10(v["n"][hit[found]] / whole[found])
            gone = np.where(known, v["T"][node] - v["M"][node] + v["D"][node] - kinds, 1.0)
            escaped = ~found
            some = escaped & (whole > 0) & (gone > 0)
            out[left[some]] += np.log10(gone[some] / whole[some])
            left, codes, node, known = left[escaped], codes[escaped], node[escaped], known[escaped]
            taken, kinds = np.where(known, v["X"][node], 0.0), np.where(known, v["D"][node], 0.0)
        out[left] -= np.log10(256 - kinds)
        return out

    def text_scores(self, streams: list[np.ndarray]) -> list[float]:
        """The sum for each stream; short streams go through together."""
        out, held, size = [], [], 0
        for stream in streams:
            if len(stream) > PART:
                parts = range(0, len(stream) - ORDER, PART)
                out.append(float(sum(self.score(grams(stream[a : a + PART + ORDER])).sum() for a in parts)))
                continue
            out.append(None)
            held.append((len(out) - 1, grams(stream)))
            size += len(stream)
            if size > PART:
                self._sums(held, out)
                held, size = [], 0
        self._sums(held, out)
        return out

    def _sums(self, held: list[tuple[int, np.ndarray]], out: list) -> None:
        if held:
            starts = np.cumsum([0, *(len(g) for _, g in held[:-1])])
            for (at, _), v in zip(held, np.add.reduceat(self.score(np.concatenate([g for _, g in held])), starts), strict=True):
                out[at] = float(v)


class Answers(Trie):
    """The scores of given grams, in the trie's place for texts that have no others."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.table, self.logs = Table(codes), logs

    def score(self, codes: np.ndarray) -> np.ndarray:
        return self.logs[self.table.find(codes)]


def train_of(col: str = "doc_id"):
    """Rows that the models learn from."""
    return F.coalesce(id_crc(col) % 7 != 2, F.lit(True))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sum of n for each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def levels(codes: np.ndarray, n: np.ndarray, bytes_: int, down_to: int) -> tuple[list, list]:
    """Entries and contexts, shortest first, from the counts of grams of bytes_ bytes; down_to is the shortest gram."""
    entries, contexts = [], []
    for k in range(bytes_, down_to - 1, -1):
        if k < bytes_:
            codes, n = summed(codes & np.uint64((1 << 8 * k) - 1), n)
        entries.insert(0, (codes, n))
        contexts.insert(0, summed(codes >> np.uint64(8), n))
    return entries, contexts


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Whole numbers of width bytes, first all their lowest bytes, then all the next."""
    return _squeezed(np.ascontiguousarray(values.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T).tobytes())


def _numbers(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(_opened(raw), "u1").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), "u1")
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


#: A row of a block has texts (a line each), or the grams and words (parted by spaces) of a bucket with their counts in
#: training texts, or (bucket -1) the short grams and the numbers of training tokens and texts.
_BLOCKS = "block long, bucket long, codes binary, n binary, words binary, n_words binary, doc_id array<long>, held_out array<boolean>, tokens long, ends long"
_ANSWERS = "block long, bucket long, logs binary, n_words binary, different long"


def _batch(cols: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _bucket_order(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted grams, and the order in which a block's answers come."""
    bucket = mix((codes >> np.uint64(8)) & np.uint64((1 << 8 * SHORT) - 1)) % np.uint64(buckets)
    return bucket, np.argsort(bucket, kind="stable")


def _dealt_words(words: set[bytes], buckets: int) -> dict[int, list[bytes]]:
    """Words by bucket, sorted."""
    out: dict[int, list[bytes]] = defaultdict(list)
    for w in sorted(words):
        out[zlib.crc32(w) % buckets].append(w)
    return out


class Block:
    """Texts whose grams and words are dealt together."""

    def __init__(self):
        self.parts, self.held, self.size, self.pending = [], [], 0, 0
        self.counts, self.others, self.tokens, self.ends = Counter(), set(), 0, 0

    def add(self, tokens: list[bytes], held_out: bool) -> None:
        if held_out:
            self.others.update(tokens)
        else:
            self.counts.update(tokens)
            self.tokens += len(tokens) + 1
            self.ends += 1
        stream = stream_of(tokens)
        for a in range(0, len(stream) - ORDER, PART):
            self.parts.append((grams(stream[a : a + PART + ORDER]) << np.uint64(1)) | np.uint64(held_out))
            self.pending += len(self.parts[-1])
            if self.pending > BLOCK:  # a long text
                self._merge()
        self.size += len(stream) - ORDER

    def _merge(self) -> None:
        if self.parts:
            self.held.append(np.unique(np.concatenate(self.parts), return_counts=True))
            self.held = [summed(*map(np.concatenate, zip(*self.held, strict=True)))]
            self.parts, self.pending = [], 0

    def rows(self, block: int, buckets: int) -> pa.RecordBatch:
        self._merge()
        keys, counts = self.held[0]
        codes, n = summed(keys >> np.uint64(1), np.where(keys & np.uint64(1), 0, counts))
        short, times = summed(codes[n > 0] & np.uint64((1 << 8 * SHORT) - 1), n[n > 0])
        rows = [(block, -1, _planes(short, 6), _planes(times, 4), None, None, None, None, self.tokens, self.ends)]
        bucket, order = _bucket_order(codes, buckets)
        codes, n = codes[order], n[order]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        words = _dealt_words(self.counts.keys() | self.others, buckets)
        for k in range(buckets):
            a, b, own = cut[k], cut[k + 1], words.get(k, [])
            if b > a or own:
                n_words = _planes(np.array([self.counts[w] for w in own], np.int64), 4)
                rows.append((block, k, _planes(codes[a:b], 6), _planes(n[a:b], 4), _squeezed(b" ".join(own)), n_words, None, None, None, None))
        return _batch([*zip(*rows, strict=True)], _BLOCKS)


def _deal(buckets: int):
    def run(batches):
        number, block = TaskContext.get().partitionId() << 40, Block()
        held: list[tuple] = []

        def texts():
            doc, held_out, words = zip(*held, strict=True)
            held.clear()
            return _batch([[number], [None], [None], [None], [_squeezed(b"\n".join(words))], [None], [doc], [held_out], [None], [None]], _BLOCKS)

        for batch in batches:
            for doc, text, held_out in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tokens = tokens_of(text)
                held.append((doc, held_out, b" ".join(tokens)))
                block.add(tokens, held_out)
                if block.size >= BLOCK:
                    yield texts()
                    yield block.rows(number, buckets)
                    number, block = number + 1, Block()
            if held:
                yield texts()
        if block.size:
            yield block.rows(number, buckets)

    return run


def _answer(sent):
    """One bucket: the scores of its grams and the counts of its words, an answer to each block."""

    def run(table: pa.Table) -> pa.Table:
        short_entries, short_contexts = sent.value
        asked = [_numbers(x, 6) for x in table.column("codes").to_pylist()]
        own, place = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.bincount(place, np.concatenate([_numbers(x, 4) for x in table.column("n").to_pylist()]), len(own)).astype(np.int64)
        if len(short_entries[0][0]):
            trie = Trie(*map(list.__add__, (short_entries, short_contexts), levels(own[n > 0], n[n > 0], ORDER + 1, SHORT + 1)))
            logs = np.concatenate([own[:0].astype(float), *(trie.score(own[a : a + PART]) for a in range(0, len(own), PART))])
        else:
            logs = np.full(len(own), -np.log10(256))
        each = logs.astype("<f4")[place]
        cut = np.cumsum([0, *map(len, asked)])
        answers = [_squeezed(each[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        words, counts = [_opened(x) for x in table.column("words").to_pylist()], Counter()
        for some, times in zip(words, table.column("n_words").to_pylist(), strict=True):
            for w, c in zip(some.split(), _numbers(times, 4).tolist(), strict=True):
                counts[w] += c
        n_words = [_planes(np.array([counts[w] for w in some.split()], np.int64), 8) for some in words]
        different = [sum(c > 0 for c in counts.values()), *[0] * (len(asked) - 1)]
        return pa.Table.from_batches([_batch([table.column("block").to_pylist(), table.column("bucket").to_pylist(), answers, n_words, different], _ANSWERS)])

    return run


def _unpacked(batches):
    for batch in batches:
        for codes, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(_numbers(codes, 6).astype(np.int64)), pa.array(_numbers(n, 4).astype(np.int64))], ["key", "n"])


def score(docs: DataFrame) -> DataFrame:
    """Every document's base and model score, learning from the rows of train_of.

    docs needs doc_id and text; other columns are left out. Null text is as empty: one token, the end.
    Repeated rows are scored each. With no training row every count is 0 and a byte has probability
    1 / 256; an empty table gives an empty one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~train_of()).alias("held_out"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0][0]
    buckets = max(1, -(-chars // BUCKET_CHARS))
    blocks = written(docs.mapInArrow(_deal(buckets), _BLOCKS), "lm-blocks")
    n_all, ends = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).collect()[0]
    short = blocks.filter("bucket = -1").select("codes", "n").mapInArrow(_unpacked, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = short.column("key").to_numpy().astype(np.uint64), short.column("n").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(levels(*summed(key, n), SHORT, 1))
    asked = blocks.filter("bucket >= 0").select("block", "bucket", "codes", "n", "words", "n_words")
    answers = written(asked.groupBy("bucket").applyInArrow(_answer(sent), _ANSWERS), "lm-answers")
    distinct = answers.agg(F.coalesce(F.sum("different"), F.lit(0))).collect()[0][0] + (ends > 0)
    whole = float(np.log10(n_all + distinct + 1))

    def run(answers: pa.Table, texts: pa.Table) -> pa.Table:
        found = sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "logs", "n_words")), strict=True))
        docs = [line.split() for x in texts.column("words").to_pylist() for line in _opened(x).split(b"\n")]
        own, words = _dealt_words(set().union(*docs), buckets), {}
        for k, _, times in found:
            words.update(zip(own.get(k, []), np.log10(_numbers(times, 8) + 1.0).tolist(), strict=True))
        streams = [stream_of(x) for x in docs]
        codes = np.empty(0, np.uint64)
        parts, size = [codes], 0
        for stream in streams:
            for a in range(0, len(stream) - ORDER, PART):
                parts.append(grams(stream[a : a + PART + ORDER]))
                size += len(parts[-1])
                if size > BLOCK:
                    parts, size = [np.unique(np.concatenate(parts))], 0
        codes = np.unique(np.concatenate(parts))
        logs = np.concatenate([np.frombuffer(_opened(x), "<f4") for _, x, _ in found]).astype(float)
        scores = Answers(codes[_bucket_order(codes, buckets)[1]], logs).text_scores(streams)
        rows = []
        last = float(np.log10(ends + 1))
        for doc, held_out, tokens, value in zip(sum(texts.column("doc_id").to_pylist(), []), sum(texts.column("held_out").to_pylist(), []), docs, scores, strict=True):
            base, known = last, int(ends > 0)
            for w in tokens:
                if v := words[w]:  # 0 for a word of no training text
                    base += v
                    known += 1
            rows.append((doc, held_out, len(tokens) + 1, known, n_all, base - (len(tokens) + 1) * whole, value))
        return pa.Table.from_batches([_batch([*zip(*rows, strict=True)], SCHEMA)])

    texts = blocks.filter("bucket IS NULL").select("block", "doc_id", "held_out", "words")
    return answers.drop("different").groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(run, SCHEMA)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
