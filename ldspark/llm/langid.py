"""Language identification by bit-sliced Bloom filters over n-grams.

One filter holds all languages: each slot is a bit mask with one bit a language, an n-gram sets its
language's bit at HASHES slots, and the AND of an n-gram's slots names every language that has it in
one look-up. A text's n-grams are counted per language bit; a filter of fill f answers falsely with
probability f**HASHES, so the count c of n look-ups is corrected to (c - n p) / (1 - p).

A language's filter holds its most frequent n-grams up to COVER of their occurrences, learned from the whole
texts of a bounded sample of labelled rows (SAMPLE_DOCS a language, the least hashes of the text), which
tasks count; the driver gets a language's n-grams with their counts. The filter's 2**SLOT_BITS slots and at
most 64 languages bound what is sent to a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import id_crc, map_batches, written

ORDERS = (3, 5)
SLOT_BITS, HASHES = 22, 3
COVER = 0.9
SAMPLE_DOCS = 2000
MAX_LANGS = 64
UNKNOWN = "und"
#: Characters of text that go through numpy at once.
PART = 1 << 21

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: np.ndarray | None = None


def letters_of(text: str) -> np.ndarray:
    """Letters in lower case; every run of anything else becomes one space, also at both ends."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _letters()
    points = _TABLE[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, cut between words (a word of more than PART letters is cut)."""
    at = 0
    while at < len(text) or not at:
        end = min(at + PART, len(text))
        while end < min(at + 2 * PART, len(text)) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = max(end, 1)


def ngram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each n-gram; those that would cross a space inside are left out."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, order, np.uint64)
    inner = np.ones(n, bool)
    for k in range(order):
        part = points[k : k + n]
        h = (h ^ part) * _MULT
        if 0 < k < order - 1:
            inner &= part != 32
    h ^= h >> np.uint64(29)
    h *= _MIX
    return (h ^ (h >> np.uint64(32)))[inner]


def slots_of(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(k * (63 - SLOT_BITS) // (HASHES - 1))) & mask).astype(np.int64) for k in range(HASHES)]


class Model:
    """The filter, its languages in order, and each language's false-positive rate."""

    def __init__(self, langs: list[str], slices: np.ndarray):
        self.langs, self.slices = langs, slices
        bits = np.arange(len(langs), dtype=np.uint64)
        fill = np.array([np.count_nonzero(slices >> b.astype(slices.dtype) & 1) for b in bits]) / len(slices)
        self.false = fill**HASHES

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of the languages that (perhaps falsely) contain it."""
        first, *rest = slots_of(h)
        out = self.slices[first]
        for s in rest:
            out &= self.slices[s]
        return out

    def shares(self, text: str) -> np.ndarray | None:
        """Per language the corrected share of the text's n-grams; None without letters."""
        total, counts = 0, np.zeros(len(self.langs))
        for part in parts_of(text):
            points = letters_of(part)
            for order in ORDERS:
                h = ngram_hashes(points, order)
                if len(h):
                    found = self.masks(h)
                    total += len(h)
                    if self.slices.dtype == np.uint8:
                        spread = np.bincount(found, minlength=256)
                        counts += [spread[(np.arange(256) >> k) & 1 == 1].sum() for k in range(len(self.langs))]
                    else:
                        counts += [np.count_nonzero(found >> found.dtype.type(k) & 1) for k in range(len(self.langs))]
        if not total:
            return None
        return np.clip((counts - total * self.false) / (total * np.maximum(1 - self.false, 1e-9)), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score. The score is the best corrected share, so text that has few n-grams of
        any language scores low. Ties go to the language first in order. A text whose only letters are
        too few for any n-gram gets the first language and score 0."""
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        shares = self.shares(text) if self.langs else None
        if not self.langs:
            return UNKNOWN, 0.0
        if shares is None:
            return self.langs[0], 0.0
        best = int(shares.argmax())
        return self.langs[best], float(shares[best])


_COUNTS = "lang string, ngram_order int, h long, n long"


def _ngram_counts():
    def one(batch):
        for lang in sorted(set(batch.column(0).to_pylist())):
            texts = [t for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if g == lang]
            for order in ORDERS:
                found = [ngram_hashes(letters_of(p), order) for t in texts for p in parts_of(t)]
                h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
                cols = [pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), order, np.int32)), pa.array(h.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _COUNTS.split(", ")])

    return one


def _profile(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The most frequent n-grams that make up COVER of all occurrences; ties go to the least hash."""
    rank = np.lexsort((h, -n))
    return h[rank[: np.searchsorted(np.cumsum(n[rank]), COVER * n.sum()) + 1]]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with text and label. The sample is the SAMPLE_DOCS rows a language whose text has
    the least hash, so it does not depend on order or partitioning; their texts are read whole. Rows without text or
    label teach nothing, repeated rows count each; no rows give a model of no language."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(counts)
    dtype = next(d for d in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(d).bits >= len(langs))
    slices = np.zeros(1 << SLOT_BITS, dtype)
    if not langs:
        return Model(langs, slices)
    # the hash up to which a language has about half as many rows again as are taken, from its count alone
    cuts = {lang: int(-(2**63) + 2**64 * min(1.0, 1.5 * SAMPLE_DOCS / n)) - 1 for lang, n in counts.items()}
    cut = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(c)) for lang, c in cuts.items()], F.lit(-(2**63)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = rows.filter(F.col("h") <= cut).withColumn("nth", nth).filter(F.col("nth") <= SAMPLE_DOCS).select("lang", "text")
    spread = sample.repartition("lang", F.xxhash64("text") % 16)
    ngrams = written(map_batches(spread, _ngram_counts, _COUNTS).groupBy("lang", "ngram_order", "h").agg(F.sum("n").alias("n")), "ngrams")
    for lang in langs:  # one after another, so that the driver holds the n-grams of one
        for order in ORDERS:
            own = ngrams.filter((F.col("lang") == lang) & (F.col("ngram_order") == order)).select("h", "n").toArrow()
            h, n = own.column("h").to_numpy().view(np.uint64), own.column("n").to_numpy()
            for s in slots_of(_profile(h, n)) if len(h) else ():
                slices[s] |= dtype(1 << langs.index(lang))
    return Model(langs, slices)


def identify(df: DataFrame, model: Model, keep: list[str] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df's columns `keep` with language and score, under `names`, for its column text. Null or letterless text gives
    ('und', 0). Rows are independent; an empty table gives an empty one. The model, at most 32 MB by
    its parameters, is broadcast."""
    sent = df.sparkSession.sparkContext.broadcast((model.langs, model.slices))
    kept = df.select(*keep).schema
    # the text goes along once, kept or not
    sent_along = [*keep] if "text" in keep else [*keep, "text"]
    at, n = sent_along.index("text"), len(keep)

    def make() -> Callable:
        here = Model(*sent.value)

        def one(batch):
            found = [here.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names[:n], *names],
            )

        return one

    schema = T.StructType([*kept.fields]).add(names[0], "string").add(names[1], "double")
    return map_batches(df.select(*sent_along), make, schema)


def held_out(col: str = "doc_id"):
    return F.coalesce(id_crc(col) % 4 == 2, F.lit(False))
