"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, banded and verified.

1. Blocks. Each task hashes its documents' shingles of SHINGLE words and deals (hash, document, count)
   to buckets by hash, packed and sorted, in about 12 bytes an entry before compression. A shingle that SEVERAL documents of
   a block have goes as one entry with their number, so a shingle that every document has costs an entry
   a block. A bucket's task adds up exact document frequencies over the corpus and answers each block
   with its shingles that other documents have too.
2. Vectors. A document's weights are count * ln(1 + N / df). Shingles that no other document has only add
   to its total weight. Where shared shingles make up less than SIMILARITY of the total, no document can
   be as similar, and the document is done: this exact bound leaves copies, near copies and little else.
3. Improved consistent weighted sampling gives BANDS * ROWS samples that agree between two documents with
   probability equal to their weighted Jaccard similarity. In each band's bucket (and in finer buckets of
   two bands) members are paired with pivots: the member with the largest shared part, which in a family
   of edited copies is the source, one at random and the first. That is linear in the bucket's size, and
   leaves few components; members of a bucket that are then in different ones are all paired.
4. Pairs are verified by the exact weighted Jaccard similarity of their vectors, and classes are the
   connected components. Documents with the same words are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .tables import map_batches, tidy, written
from .words import mix, shingle_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: A block ends with so many shingles or documents; a bucket has about so many entries.
BLOCK_SHINGLES, BLOCK_DOCS, BUCKET_ENTRIES = 1_200_000, 60_000, 1_200_000
SEVERAL = 4
#: Characters that a shingle takes on average, to choose the number of buckets.
CHARS = 5
MANY = np.uint16(0xFFFF)
#: Classes of over LARGE rows and one in LARGE_CLASSES of all are at most LARGE_CLASSES in number, so these are broadcast.
LARGE, LARGE_CLASSES = 1000, 10_000

_PACKED = "bucket long, block long, hi binary, lo binary, doc binary, tf binary, n binary"
_ANSWER = "block long, id binary, doc binary, tf binary, df binary, head binary"


def _bytes(*arrays) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


class Block:
    """Documents whose shingles are dealt together."""

    def __init__(self):
        self.docs, self.keys, self.totals = [], [], []
        self.hashes, self.counts, self.size = [], [], 0

    def add(self, doc: int | None, text: str | None) -> None:
        words = word_hashes(text)
        h, tf = np.unique(shingle_hashes(words, SHINGLE), return_counts=True)
        self.docs.append(doc)
        self.keys.append(xxhash.xxh3_128_digest(words.tobytes()))
        self.totals.append(int(tf.sum()))
        self.hashes.append(h)
        self.counts.append(tf.astype(np.uint32))
        self.size += len(h)

    def full(self) -> bool:
        return self.size >= BLOCK_SHINGLES or len(self.docs) >= BLOCK_DOCS

    def rows(self, block: int, buckets: int) -> list[tuple]:
        """Packed entries by bucket, and the block's own row in a bucket below 0."""
        h = np.concatenate(self.hashes)
        doc = np.repeat(np.arange(len(self.hashes), dtype=np.uint16), [len(x) for x in self.hashes])
        tf = np.concatenate(self.counts)
        order = np.argsort(h, kind="stable")
        h, doc, tf = h[order], doc[order], tf[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        runs = np.diff(np.append(first, len(h)))
        common = np.repeat(runs >= SEVERAL, runs)
        shared_first = first[runs >= SEVERAL]
        # who has the common ones stays with the block
        head = _head(self.docs, self.keys, self.totals, _ids(h[shared_first], buckets), runs[runs >= SEVERAL], doc[common], tf[common])
        h2 = np.concatenate([h[~common], h[shared_first]])
        doc2 = np.concatenate([doc[~common], np.full(len(shared_first), MANY)])
        tf2 = np.concatenate([tf[~common], np.zeros(len(shared_first), np.uint32)])
        n2 = np.concatenate([np.ones(np.count_nonzero(~common), np.uint16), runs[runs >= SEVERAL].astype(np.uint16)])
        bucket = (h2 & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        order = np.lexsort((h2, bucket))
        h2, doc2, tf2, n2, bucket = h2[order], doc2[order], tf2[order], n2[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        out = []
        for k in range(buckets):
            a, b = cut[k], cut[k + 1]
            if b > a:
                part = h2[a:b] >> np.uint64(16)
                out.append((k, block, *_bytes((part >> np.uint64(32)).astype("<u2"), part.astype("<u4"), doc2[a:b], tf2[a:b], n2[a:b])))
        out.append((-1 - block, block, head, None, None, None, None))
        return out


def _ids(h: np.ndarray, buckets: int) -> np.ndarray:
    """What an entry's packed form says of its hash: 48 bits, and the bucket."""
    bucket = (h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
    return ((h >> np.uint64(16)) << np.uint64(16)) | (bucket & np.uint64(0xFFFF))


def _head(docs, keys, totals, ids, runs, doc, tf) -> bytes:
    order = np.argsort(ids)
    starts = np.cumsum(runs) - runs
    known = np.array([d is not None for d in docs], np.uint8)
    parts = _bytes(np.array([d or 0 for d in docs], "<i8"), known, np.frombuffer(b"".join(keys), np.uint8), np.array(totals, "<i8"),
                   ids[order], starts[order].astype("<i8"), runs[order].astype("<i8"), doc, tf)
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unhead(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for kind in ("<i8", "u1", "u1", "<i8", "<u8", "<i8", "<i8", "<u2", "<u4"):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _deal(buckets: int):
    def run(batches):
        block, part, n = Block(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc, text)
                if block.full():
                    for row in block.rows((part << 24) + n, buckets):
                        yield _batch([row], _PACKED)
                    block, n = Block(), n + 1
        if block.docs:
            for row in block.rows((part << 24) + n, buckets):
                yield _batch([row], _PACKED)
        del block
        tidy()

    return run


def _count(table: pa.Table) -> pa.Table:
    """One bucket: document frequencies, and an answer to each block."""
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("block").to_pylist()
    if bucket < 0:
        return pa.Table.from_batches([_batch([(blocks[0], None, None, None, None, table.column("hi")[0].as_py())], _ANSWER)])
    col = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    los = col("lo", "<u4")
    sizes = [len(x) for x in los]
    h = (np.concatenate(col("hi", "<u2")).astype(np.uint64) << np.uint64(32)) | np.concatenate(los)
    doc, tf, n = (np.concatenate(col(c, k)) for c, k in (("doc", "<u2"), ("tf", "<u4"), ("n", "<u2")))
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])[: len(h)])
    df = np.add.reduceat(n[order].astype(np.int64), first)
    each = np.empty(len(h), np.int64)
    each[order] = np.repeat(df, np.diff(np.append(first, len(h))))
    rows, at = [], 0
    for block, size in zip(blocks, sizes, strict=True):
        k = at + np.flatnonzero(each[at : at + size] >= 2)
        at += size
        if len(k):
            ids = (h[k] << np.uint64(16)) | np.uint64(bucket & 0xFFFF)
            rows.append((block, *_bytes(ids, doc[k], tf[k], np.minimum(each[k], 2**32 - 1).astype("<u4")), None))
    return pa.Table.from_batches([_batch(rows, _ANSWER)])


_VECTOR = "doc_id long, k1 long, k2 long, total double, rest long, ids binary, weights binary"


def _assemble(n_docs: int):
    """One block's answers to vectors: ids and weights of the shared shingles, the total weight and the
    number of shingles that nothing else has; none where the shared part is too small."""

    def run(table: pa.Table) -> pa.Table:
        heads = [x.as_py() for x in table.column("head") if x.is_valid]
        docs, known, keys, totals, many, starts, runs, many_doc, many_tf = _unhead(heads[0])
        keys = keys.view("<i8").reshape(-1, 2)
        col = lambda name, kind: np.concatenate([np.empty(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in table.column(name) if x.is_valid]])
        ids, doc, tf, df = col("id", "<u8"), col("doc", "<u2"), col("tf", "<u4"), col("df", "<u4")
        whole = doc == MANY
        place = np.searchsorted(many, ids[whole])
        times = runs[place]
        take = np.repeat(starts[place] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        doc = np.concatenate([doc[~whole], many_doc[take]])
        tf = np.concatenate([tf[~whole], many_tf[take]]).astype(np.int64)
        ids = np.concatenate([ids[~whole], np.repeat(ids[whole], times)])
        df = np.concatenate([df[~whole], np.repeat(df[whole], times)])
        order = np.lexsort((ids, doc))
        doc, tf, ids = doc[order], tf[order], ids[order]
        w = tf * np.log1p(n_docs / df[order])
        cut = np.searchsorted(doc, np.arange(len(docs) + 1))
        seen, rows = set(), []
        for k in range(len(docs)):
            a, b = cut[k], cut[k + 1]
            shared, rest = float(w[a:b].sum()), int(totals[k] - tf[a:b].sum())
            total = shared + max(0, rest) * float(np.log1p(n_docs))
            key = (int(keys[k, 0]), int(keys[k, 1]))
            use = b > a and key not in seen and shared >= SIMILARITY * total * (1 - 1e-9)
            seen.add(key)
            rows.append((int(docs[k]) if known[k] else None, *key, total, rest, *(_bytes(ids[a:b], w[a:b].astype("<f4")) if use else (None, None))))
        return pa.Table.from_batches([_batch(rows, _VECTOR)])

    return run


# Tables of random (r, ln c, beta): r and c are Gamma(2, 1), beta uniform. An element's place in them is a
# hash of the element and the sample's number.
_TABLE_BITS = 16
_rng = np.random.default_rng(20)
_R = _rng.gamma(2.0, 1.0, 1 << _TABLE_BITS).astype(np.float32)
_LN_C = np.log(_rng.gamma(2.0, 1.0, 1 << _TABLE_BITS)).astype(np.float32)
_BETA = _rng.random(1 << _TABLE_BITS, np.float32)
_ODD = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Matrix elements at once.
_AT_ONCE = 1 << 20


def samples(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples: with t = floor(ln w / r + beta) and ln a = ln c - r (t - beta) - r,
    a sample is the element of least a with its t."""
    ln_w = np.log(weights.astype(np.float32))
    best = np.full(len(_ODD), np.inf, np.float32)
    out = np.zeros(len(_ODD), np.uint64)
    step = max(1, _AT_ONCE // len(_ODD))
    rows = np.arange(len(_ODD))
    for at in range(0, len(ids), step):
        part = ids[at : at + step]
        place = ((mix(part)[None, :] * _ODD[:, None]) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        r, beta = _R[place], _BETA[place]
        t = np.floor(ln_w[None, at : at + step] / r + beta)
        ln_a = _LN_C[place] - r * (t - beta) - r
        k = ln_a.argmin(axis=1)
        least = ln_a[rows, k]
        won = least < best
        best[won] = least[won]
        out[won] = mix(part[k] + t[rows, k].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[won]
    return out


def band_hashes(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(BANDS, 2): each band's hash, and that of it and the next band."""
    s = samples(ids, weights).reshape(BANDS, ROWS)
    h = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        h = mix(h ^ s[:, k]) + np.uint64(k)
    return np.stack([h, mix(h ^ mix(np.roll(h, -1)))], axis=1)


def weighted_jaccard(a_ids, a_w, a_total, b_ids, b_w, b_total) -> float:
    _, x, y = np.intersect1d(a_ids, b_ids, assume_unique=True, return_indices=True)
    common = float(np.minimum(a_w[x], b_w[y]).sum())
    return common / (a_total + b_total - common)


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, key (k1, k2) of the words, total and rest of every row of docs, and ids and weights for the
    first of a key in its block if it may have a partner."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0]
    buckets = max(1, -(-chars // (CHARS * BUCKET_ENTRIES)))
    packed = docs.mapInArrow(_deal(buckets), _PACKED)
    answers = packed.groupBy("bucket").applyInArrow(_count, _ANSWER)
    return written(answers.groupBy("block").applyInArrow(_assemble(max(1, n_docs)), _VECTOR), "near-vectors")


def classes(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (the least doc_id of its class; copies and, directly or
    through others, near copies), class_size (rows of docs), n_links (verified near copies of its text; copies
    don't count) and representative (one row of each class).

    Rows without words (null, empty, signs only) are each a class of their own. Repeated rows and ties are
    copies of each other; an empty table gives an empty one. Rows with a null doc_id get a null class_id
    unless their class has others."""
    rows = vectors(docs)
    node = written(
        rows.filter("ids IS NOT NULL").dropDuplicates(["k1", "k2"]).select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "total", "rest", "ids", "weights"),
        "near-nodes",
    )
    bands = written(_bands(node), "near-bands")
    pairs = written(_pairs(bands), "near-pairs")
    side = lambda x: node.select(*[F.col(c).alias(f"{x}_{c}") for c in ("node", "total", "ids", "weights")])
    with_both = lambda x: x.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node")).drop("a_node", "b_node")
    verified = lambda x: map_batches(with_both(x), _verify, "a long, b long, similarity double")
    links = written(verified(pairs), "near-links")
    rest = written(_rest(bands, components(links), pairs), "near-rest")
    links = written(links.union(verified(rest)), "near-links")
    roots = components(links)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = node.select("node", "k1", "k2").join(roots, F.col("node") == F.col("id"), "left").join(degree, "node", "left")
    named = named.select("k1", "k2", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # the class is the root if the words have one, else the words; without words, the row itself
    alone = F.col("total") == 0
    rows = rows.select("doc_id", "k1", "k2", "total", F.when(alone, F.monotonically_increasing_id()).alias("own")).join(named, ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    group = (
        F.when(alone, F.struct(F.lit(0).alias("kind"), F.col("own").alias("a"), zero.alias("b")))
        .when(F.col("root").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("root").alias("a"), zero.alias("b")))
        .otherwise(F.struct(F.lit(2).alias("kind"), F.col("k1").alias("a"), F.col("k2").alias("b")))
    )
    keyed = written(rows.select("doc_id", group.alias("g"), F.coalesce("n_links", F.lit(0)).alias("n_links")).select("doc_id", "g.*", "n_links"), "near-rows")
    sizes = keyed.groupBy("kind", "a", "b").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    sizes = written(sizes.filter("class_size > 1"), "near-sizes")
    bar = max(LARGE, keyed.count() // LARGE_CLASSES)
    large, few = sizes.filter(F.col("class_size") > bar), sizes.filter(F.col("class_size") <= bar)
    same = ["kind", "a", "b"]
    rest = keyed.join(F.broadcast(large), same, "left_anti").join(few, same, "left")
    whole = keyed.join(F.broadcast(large), same).unionByName(rest)
    class_id = F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return whole.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "n_links").withColumn(
        "representative", F.col("doc_id").eqNullSafe(F.col("class_id"))
    )


def _bands(node: DataFrame) -> DataFrame:
    def make():
        def one(batch):
            names, kinds = ["node", "shared", "band", "h1", "h2"], [pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            out = [[], [], [], [], []]
            for n, k1, total, rest, ids, w in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ids, w = np.frombuffer(ids, "<u8"), np.frombuffer(w, "<f4")
                shared = float(w.sum())
                if rest > 0:  # shingles of its own: nothing else can have the same samples of them
                    own = mix(np.arange(rest, dtype=np.uint64) + np.array([k1], np.int64).view(np.uint64))
                    ids, w = np.concatenate([ids, own]), np.concatenate([w, np.full(rest, (total - shared) / rest, np.float32)])
                h = band_hashes(ids, np.maximum(w, np.float32(1e-30))).view(np.int64)
                for c, v in zip(out, ([n] * BANDS, [shared / total] * BANDS, range(BANDS), h[:, 0].tolist(), h[:, 1].tolist()), strict=True):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

        return one

    return map_batches(node.select("node", "k1", "total", "rest", "ids", "weights"), make, "node long, shared double, band int, h1 long, h2 long")


def _pairs(bands: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's pivots, each pair once."""
    out = None
    for by in ("h1", "h2"):
        members = bands.select("node", "shared", "band", F.col(by).alias("h"))
        pivots = members.groupBy("band", "h").agg(
            F.count("*").alias("n"), F.max_by("node", F.struct("shared", "node")).alias("p1"), F.min_by("node", F.xxhash64("node", "band")).alias("p2"), F.min("node").alias("p3")
        )
        found = members.join(pivots.filter("n > 1"), ["band", "h"]).select("node", F.explode(F.array_distinct(F.array("p1", "p2", "p3"))).alias("p"))
        found = found.filter("node != p").select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        out = out.union(found) if out else found
    return out.distinct()


def _rest(bands: DataFrame, roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each pair of a bucket that the pivots left in different components and that was not compared yet. A pair that
    meets in several bands is made in the first of them only."""
    members = bands.select("node", "band", F.xxhash64("band", "h1").alias("h")).join(roots, F.col("node") == F.col("id"), "left")
    members = members.select("node", "band", "h", F.coalesce("root", "node").alias("root"))
    mixed = members.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("h")
    members = written(members.join(mixed, "h"), "near-mixed")
    every = members.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("band", "h")))["h"].alias("all"))  # at most BANDS
    members = members.join(every, "node")
    side = lambda x: members.select("h", F.col("node").alias(x), F.col("root").alias(f"{x}_root"), F.col("all").alias(f"{x}_all"))
    meet = F.get(F.array_intersect("a_all", "b_all"), F.lit(0))
    found = side("a").join(side("b"), "h").filter((F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & (meet == F.col("h"))).select("a", "b")
    return found.join(pairs, ["a", "b"], "left_anti")


def _verify():
    def one(batch):
        a, b, kept = [], [], []
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            s = weighted_jaccard(np.frombuffer(cols["a_ids"][k], "<u8"), np.frombuffer(cols["a_weights"][k], "<f4"), cols["a_total"][k],
                                 np.frombuffer(cols["b_ids"][k], "<u8"), np.frombuffer(cols["b_weights"][k], "<f4"), cols["b_total"][k])
            if s >= SIMILARITY:
                a.append(cols["a"][k])
                b.append(cols["b"][k])
                kept.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kept, pa.float64())], ["a", "b", "similarity"])

    return one


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, one document of each class: that of the least doc_id. Rows alike in doc_id stay
    together, and so do rows with a null doc_id, which can't be told apart."""
    gone = classes(docs).filter(~F.col("representative")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
