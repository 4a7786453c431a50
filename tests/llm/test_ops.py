"""Each operator against a plain version, and on odd inputs: nulls, empty and long texts, ties, repeated
rows, empty tables, more columns."""

import hashlib
import io
import itertools
import math
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ldspark.llm import chat, decontam, graph, langid, linededup, media, neardup, packing, passages, pii, ppm, queries, tables, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lines string, node long, bucket int"


def frame(spark, texts, lang=None):
    """documents with more columns, whose names the operators use themselves."""
    tables.prepare(spark)
    rows = [(i, t, lang, None, None, 0.5, "x", 7, 3) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    return spark.createDataFrame(rows, SCHEMA)


R = random.Random(2)
VOCABULARY = ["".join(R.choices("abcdefghilmnoprstu", k=R.randint(2, 8))) for _ in range(900)]


def prose(n, r=R, per_line=12):
    w = r.choices(VOCABULARY, k=n)
    return "\n".join(" ".join(w[k : k + per_line]) for k in range(0, n, per_line))


LONG = prose(30_000, random.Random(9))
ODD = [(1, None), (2, ""), (3, "..."), (4, "One."), (5, "one"), (6, "One."), (6, "One."), (None, "One."), (None, None), (7, LONG), (8, LONG + " end"), (9, "a\n\nb\n"), (10, "é 中文 \U0001f600\0")]


# --- words ---------------------------------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_place():
    text = " ".join(VOCABULARY)
    h = words.word_hashes(text)
    assert len(h) == len(VOCABULARY) and len(set(h.tolist())) == len(set(VOCABULARY))
    assert (words.word_hashes("... " + text)[5:9] == h[5:9]).all() and (words.word_hashes("AbC É") == words.word_hashes("abc-é")).all()
    big = "x " * (words.PART // 2) + text + " " + "y" * (3 * words.PART)
    got = words.word_hashes(big)
    assert (got[words.PART // 2 : words.PART // 2 + len(h)] == h).all()
    assert len(words.word_hashes(None)) == len(words.word_hashes("?!")) == 0


# --- 1 line dedup --------------------------------------------------------------------------------------


def line_set(line):
    return frozenset(re.findall("[0-9a-z\x80-\U0010ffff]+", line.lower()))


def brute_lines(docs):
    """doc: numbers of removed lines, by comparing every line with every earlier one."""
    seen, out = [], defaultdict(set)
    for d, text in sorted(docs):
        for k, line in enumerate((text or "").split("\n")):
            s = line_set(line)
            if s:
                if any(line == other or 5 * len(s & o) >= 4 * len(s | o) for other, o in seen):
                    out[d].add(k)
                seen.append((line, s))
    return out


def edited(text, r, n=1):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


def test_line_dedup(spark):
    r = random.Random(4)
    lines = [" ".join(r.choices(VOCABULARY, k=r.choice([1, 2, 4, 6, 20, 40]))) for _ in range(60)]
    docs = []
    for d in range(60):
        own = [edited(x, r, r.choice([0, 0, 1, 2])) for x in r.choices(lines, k=r.randint(1, 8))]
        docs.append((d, "\n".join(own + ["", "!"])))
    want = brute_lines(docs)
    got = {x["doc_id"]: x for x in linededup.line_counts(frame(spark, docs)).collect()}
    assert {d: set(got[d]["removed"]) for d, _ in docs} == {d: want[d] for d, _ in docs}
    assert sum(x["n_links"] for x in got.values()) > 0
    clean = {x["doc_id"]: x["text"] for x in linededup.without_repeated_lines(frame(spark, docs)).collect()}
    for d, text in docs:
        all_lines = text.split("\n")
        rest = [x for k, x in enumerate(all_lines) if k not in want[d]]
        if any(line_set(x) for x in rest):
            assert clean[d] == "\n".join(rest)
        else:
            assert d not in clean


def test_line_dedup_odd(spark):
    df = frame(spark, ODD)
    got = {(x["doc_id"], x["n_lines"]): x["n_removed"] for x in linededup.line_counts(df).collect()}
    assert got[1, 0] == got[2, 1] == got[3, 1] == 0 and got[4, 1] == got[6, 1] == 1 and got[None, 1] == 0  # the null id comes first
    out = linededup.without_repeated_lines(df)
    assert out.columns == df.columns and {x["doc_id"] for x in out.collect()} == {None, 1, 2, 3, 5, 7, 9, 10} - {5}
    assert linededup.without_repeated_lines(df.filter("false")).count() == linededup.line_counts(df.filter("false")).count() == 0


def test_line_family(spark):
    """A source line and its edited copies, most of which are like the source only."""
    r = random.Random(6)
    source = " ".join(r.choices(VOCABULARY, k=60))
    docs = [(0, edited(source, r)), *((d, source) for d in range(1, 5)), *((d, edited(source, r, 2)) for d in range(5, 60))]
    want = brute_lines(docs)
    assert {x["doc_id"]: set(x["removed"]) for x in linededup.line_counts(frame(spark, docs)).collect()} == {d: want[d] for d, _ in docs}


def test_line_links_are_all_counted(spark, monkeypatch):
    """A family by the hundred, whose lines match many others: every link counts, not only that with the earliest line."""
    monkeypatch.setattr(linededup, "HEAVY", 32)
    r = random.Random(16)
    source = " ".join(r.choices(VOCABULARY, k=60))
    docs = [(d, edited(source, r, r.choice([1, 2, 3]))) for d in range(150)] + [(150, prose(8, r) + "\n" + source), (151, source)]
    want, seen = Counter(), []
    for d, text in docs:
        for line in text.split("\n"):
            if all(line != other for other, _, _ in seen):
                s = line_set(line)
                for _, o, e in seen:
                    if 5 * len(s & o) >= 4 * len(s | o):
                        want.update([d, e])
                seen.append((line, s, d))
    assert {x["doc_id"]: x["n_links"] for x in linededup.line_counts(frame(spark, docs)).collect()} == {d: want[d] for d, _ in docs}
    assert sum(want.values()) > 10 * len(docs)


def test_line_pairs_are_checked_in_rounds(spark, monkeypatch):
    """Where sets are too many for one broadcast, no set is sent with a pair, and each link comes once, the earlier line first."""
    monkeypatch.setattr(linededup, "BROADCAST_TOKENS", 500)
    r = random.Random(17)
    sources = [" ".join(r.choices(VOCABULARY, k=40)) for _ in range(2)]
    docs = [(d, edited(r.choice(sources), r, r.choice([1, 2]))) for d in range(60)]
    found, sets = linededup.LineJoin(frame(spark, docs), every=True), [line_set(text) for _, text in docs]
    place = {x["id"]: x["d"] for x in found.classes.collect()}
    want = {(i, j) for j in range(60) for i in range(j) if docs[i][1] != docs[j][1] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    got = [(place[x["i"]], place[x["j"]]) for x in found.links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    plan = []
    similar = linededup.LineJoin._similar
    monkeypatch.setattr(linededup.LineJoin, "_similar", lambda *a: plan.append(similar(*a)) or plan[-1])
    linededup.LineJoin(frame(spark, docs), every=True)
    assert len(plan) > 2 and all("BroadcastHashJoin" in str(p._jdf.queryExecution().executedPlan()) for p in plan)


# --- 2 decontamination ---------------------------------------------------------------------------------


def brute_leaks(text, items):
    w, out = decontam.words_of(text), {}
    for i, t in items:
        iw = decontam.words_of(t)
        ic = Counter(decontam.shingles(iw))
        for s in range(max(0, len(w) - len(iw)) + 1):
            win = w[s : s + len(iw)]
            v = decontam.similarity(Counter(decontam.shingles(win)), ic) if win and iw else 0
            if v >= 0.8 and v > out.get(i, (0,))[0]:
                out[i] = (round(v, 6), s)
    return out


def test_decontamination(spark):
    r = random.Random(3)
    items = [(i, " ".join(r.choices(VOCABULARY, k=r.choice([3, 5, 12, 30, 40])))) for i in range(30)] + [(30, None), (31, "?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = list(ODD)
    for d in range(20, 90):
        w = r.choices(VOCABULARY, k=r.choice([0, 4, 20, 80]))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = edited(items[r.randrange(30)][1], r, r.choice([0, 0, 1])).split(" ")
        docs.append((d, " ".join(w)))
    df = frame(spark, docs)
    got = defaultdict(dict)
    for x in decontam.find_leaks(df, bench).collect():
        got[x["doc_id"]][x["item_id"]] = (x["similarity"], x["first_word"])
    known = [(i, t) for i, t in items if t]
    want = {d: b for d, t in docs if t and len(t) < 5000 and (b := brute_leaks(t, known))}
    assert {d: v for d, v in got.items() if d not in (7, 8)} == want and len(want) > 20
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(x["doc_id"] or 0 for x in kept.collect()) == sorted(d or 0 for d, _ in docs if d not in got)
    assert decontam.find_leaks(df.filter("false"), bench).count() == decontam.find_leaks(df, bench.filter("false")).count() == 0
    assert len(decontam.item_blocks(bench, 400)) > 1


def test_decontamination_of_a_text_that_repeats_an_item():
    item = " ".join(VOCABULARY[:30])
    got = decontam.Matcher([(1, item)]).matches((item + " ") * 1500)
    assert [(i, s, a, n) for i, s, a, n, _ in got] == [(1, 1.0, 0, 30)]


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 256, (300, decontam.BLOCKS), np.uint8)
    index = decontam.HammingIndex(prints)
    for _ in range(50):
        p = prints[rng.integers(300)].copy()
        for b in rng.choice(64, rng.integers(0, 24), replace=False):
            p[b // 8] ^= 1 << (b % 8)
        far = np.bitwise_count(prints ^ p).sum(axis=1)
        assert index.within(p) == {int(k): int(far[k]) for k in np.flatnonzero(far <= decontam.RADIUS)}


# --- 3 substring dedup ---------------------------------------------------------------------------------


def test_passages(spark):
    r = random.Random(8)
    shared = [prose(70, r, 1000) for _ in range(4)]
    noisy = edited(shared[0], r, 4)
    docs = {d: prose(100, r) for d in range(40)}
    for d, s in ((3, shared[0]), (9, noisy), (12, shared[1]), (20, shared[1]), (21, shared[1]), (30, shared[2] + " " + shared[3]), (33, shared[3] + " " + shared[2])):
        docs[d] = prose(40, r) + "\n" + s + "\n" + prose(40, r)
    rows = passages.repeated_passages(frame(spark, docs)).collect()
    # every later one is linked with an earlier one, here each block's first
    assert {(9, 3), (20, 12), (33, 30)} <= {(x["doc_id"], x["src_doc_id"]) for x in rows} <= {(9, 3), (20, 12), (21, 12), (21, 20), (33, 30)}
    assert {x["doc_id"] for x in rows} == {9, 20, 21, 33}
    for x in rows:
        assert x["start"] <= 42 and x["end"] - x["start"] >= 64 and x["similarity"] >= 0.8 or x["doc_id"] == 33
    assert sum(x["end"] - x["start"] for x in rows if x["doc_id"] == 33) >= 135
    clean = {x["doc_id"]: x["text"] for x in passages.without_passages(frame(spark, docs)).collect()}
    assert len(clean) == 40 and clean[5] == docs[5] and len(clean[20].split()) < 90 < len(clean[12].split())


def test_passages_twice_in_one_document(spark):
    r = random.Random(31)
    p = prose(80, r, 1000)
    docs = {1: p, 2: f"{prose(90, r)} {p} {prose(90, r)} {p} {prose(30, r)}"}
    covered = {k for x in passages.repeated_passages(frame(spark, docs)).collect() if (x["doc_id"], x["src_doc_id"]) == (2, 1) for k in range(x["start"], x["end"])}
    assert {*range(90, 170), *range(260, 340)} <= covered and len(covered) < 200
    clean = {x["doc_id"]: x["text"] for x in passages.without_passages(frame(spark, docs)).collect()}
    assert 190 < len(clean[2].split()) <= 210


def test_passages_odd(spark):
    df = frame(spark, [*ODD, (11, LONG[50_000:90_000])])
    rows = passages.repeated_passages(df).collect()
    assert {(x["doc_id"], x["src_doc_id"]) for x in rows} == {(8, 7), (11, 7)}
    assert passages.repeated_passages(df.filter("false")).count() == 0
    same = "la " * 400
    hot = passages.repeated_passages(frame(spark, {1: same, 2: same})).collect()
    assert {(x["doc_id"], x["src_doc_id"]) for x in hot} == {(2, 1)}


def test_passages_whose_seeds_others_had_first(spark):
    """Two earlier documents hold parts of a passage, each too short; a third one holds it whole."""
    r, docs = random.Random(21), {}
    for k in range(40):
        p = [f"w{k}x{n}" for n in range(60)]
        for n, part in enumerate((p[:45], p[15:], p, p)):
            docs[100 * n + k] = f"{prose(40, r, 1000)} {' '.join(part)} {prose(40, r, 1000)}"
    found = {(x["doc_id"], x["src_doc_id"]) for x in passages.repeated_passages(frame(spark, docs)).collect()}
    assert {(300 + k, 200 + k) for k in range(40)} <= found


def test_documents_meet_once_for_a_key():
    """However often lines repeat, a document has one row for each of its keys, and rows give all pairs of places."""
    r = random.Random(3)
    lines = [[f"l{k}x{n}" for n in range(r.randint(12, 30))] for k in range(3)]
    seeds, want = [], {}
    for doc in (1, 2):
        h, at = passages._thinned(words.word_hashes(" ".join(" ".join(r.choice(lines)) for _ in range(60))), passages.K, passages.WINDOW)
        seeds += [(doc, int(p), int(x)) for p, x in zip(at, h.view(np.int64), strict=True)]
        here = [(int(p), int(x)) for p, x in zip(at, h, strict=True)]
        for p, x in here:
            q, y = next(((q, y) for q, y in here if q >= p + passages.APART), (None, None))
            if q is not None:
                want.setdefault((x, y), {1: [], 2: []})[doc].append((p, q))
    cols = [pa.array([x[0] for x in seeds]), pa.array([x[1] for x in seeds], pa.int32()), pa.array([x[2] for x in seeds]), pa.array([x[0] - 1 for x in seeds])]
    rows = [x for b in passages._key_rows([pa.RecordBatch.from_arrays(cols, ["doc", "place", "seed", "open"])]) for x in b.to_pylist()]
    assert len(rows) == len({(x["doc"], x["key"]) for x in rows}) == sum(bool(p) for w in want.values() for p in w.values())
    of = {d: {x["key"]: np.array([x["place"], x["other"]]).T for x in rows if x["doc"] == d} for d in (1, 2)}
    assert all(x["open_place"] == (x["place"] if x["doc"] == 2 else []) for x in rows)
    x, y = passages.all_pairs([(of[2][k], of[1][k]) for k in of[2].keys() & of[1].keys()])
    assert {*zip(x.tolist(), y.tolist(), strict=True)} == {(p[i], q[i]) for w in want.values() for p in w[2] for q in w[1] for i in (0, 1)}


def test_hopeless_stretches_have_no_passage():
    r, found = random.Random(12), 0
    for _ in range(300):
        p = [r.randrange(1 << 60) for _ in range(r.randint(24, 70))]
        q = [r.randrange(1 << 60) if r.random() < 0.14 else w for w in p]
        a, b = (np.array([r.randrange(1 << 60) for _ in range(30)] + x + [r.randrange(1 << 60) for _ in range(30)], np.uint64) for x in (p, q))
        same = [k for k in range(len(a) - 4) if (a[k : k + 5] == b[k : k + 5]).all()]
        if same and passages.align(a, b, same[:1] + same[-1:], same[:1] + same[-1:]):
            found += 1
            assert not passages.hopeless(a, b)
    assert found > 20
    assert passages.hopeless(*(np.array([r.randrange(1 << 60) for _ in range(90)], np.uint64) for _ in "ab"))


def best_local(a: list, b: list) -> tuple[int, int, int, int]:
    """By brute force: the best local alignment's score, words of a, words of b and matches."""
    best, above = (0, 0, 0, 0), [(0, 0, 0, 0)] * (len(b) + 1)
    for x in a:
        row = [(0, 0, 0, 0)]
        for j, y in enumerate(b):
            s, m, n, e = above[j]
            across = (s + 1, m + 1, n + 1, e + 1) if x == y else (s - passages.ERROR, m + 1, n + 1, e)
            down, right = above[j + 1], row[j]
            row.append(max(
                across, (down[0] - passages.ERROR, down[1] + 1, down[2], down[3]), (right[0] - passages.ERROR, right[1], right[2] + 1, right[3]), (0, 0, 0, 0),
                key=lambda c: c[0],
            ))
        best = max([best, *row], key=lambda c: c[0])
        above = row
    return best


def reworded(text: str, r: random.Random, edits: int) -> str:
    """text with so many of its words changed, left out or followed by another."""
    out = text.split()
    for k in sorted(r.sample(range(len(out)), edits), reverse=True):
        out[k : k + 1] = r.choice([[f"new{r.randrange(10**6)}"], [], [out[k], f"new{r.randrange(10**6)}"]])
    return " ".join(out)


def test_extensions_are_the_best():
    r = random.Random(3)
    for n in range(120):
        a = [r.randrange(6 if n % 3 else 500) for _ in range(r.randint(0, 40))]
        b = [w for w in a if r.random() > 0.1] if n % 2 else [r.randrange(6) for _ in range(r.randint(0, 40))]
        pieces = passages.extension(np.array(a, np.uint64), np.array(b, np.uint64))
        got, top, i, j = 0, 0, 0, 0
        for p, q, same, wrong in pieces:
            assert same + wrong == max(p, q) and (not same or a[i : i + p] == b[j : j + q])
            i, j, got = i + p, j + q, got + same - passages.ERROR * wrong
            top = max(top, got)
        score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            ways = [0] if not i and not j else []
            ways += [score[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -passages.ERROR)] if i and j else []
            ways += [score[i - 1][j] - passages.ERROR] if i else []
            ways += [score[i][j - 1] - passages.ERROR] if j else []
            score[i][j] = max(ways)
        assert top == max(map(max, score))


def test_reworded_passages(spark):
    """Against local alignments of whole documents: rows hold, and passages with a tenth of the words edited are found."""
    r = random.Random(12)
    docs = {}
    for k in range(60):
        p = prose(r.randint(56, 90), r, 3000)
        docs[k] = f"{prose(30, r, 3000)} {p} {prose(30, r, 3000)}"
        docs[100 + k] = f"{prose(30, r, 3000)} {reworded(p, r, len(p.split()) * (k % 3 + 4) // 60)} {prose(30, r, 3000)}"
    rows = passages.repeated_passages(frame(spark, docs)).collect()
    assert all(x["doc_id"] == x["src_doc_id"] + 100 for x in rows)
    found, there = {x["src_doc_id"] for x in rows}, set()
    for x in rows:
        a, b = docs[x["doc_id"]].split()[x["start"] : x["end"]], docs[x["src_doc_id"]].split()[x["src_start"] : x["src_end"]]
        common = [0] * (len(b) + 1)
        for w in a:
            row = [0]
            for j, v in enumerate(b):
                row.append(common[j] + 1 if w == v else max(common[j + 1], row[j]))
            common = row
        assert x["matches"] <= common[-1] and x["similarity"] == round(x["matches"] / max(len(a), len(b)), 6)
        assert min(len(a), len(b)) >= passages.MIN_WORDS and x["similarity"] >= passages.SIMILARITY
    for k in range(60):
        _, m, n, e = best_local(docs[100 + k].split(), docs[k].split())
        if min(m, n) >= passages.MIN_WORDS and e >= passages.SIMILARITY * max(m, n):
            there.add(k)
    assert len(there) >= 45 and len(found & there) >= 0.95 * len(there)


def test_chains_are_the_best():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 12)
        x, y, size = (np.array([r.randint(0, top) for _ in range(n)]) for top in (30, 30, 4))
        run = np.stack([x, y, x + size, y + size, size + 1], axis=1)
        cost = lambda j, i: passages.GAP * (run[i, 0] - run[j, 2] + run[i, 1] - run[j, 3])
        follows = lambda j, i: run[j, 2] < run[i, 0] and run[j, 3] < run[i, 1]
        top = {}
        for i in np.argsort(x, kind="stable").tolist():
            top[i] = passages.K * (size[i] + 1) + max([0] + [top[j] - cost(j, i) for j in top if follows(j, i)])
        chain = passages.chains(run)[0]
        value = passages.K * sum(size[i] + 1 for i in chain)
        for j, i in zip(chain, chain[1:], strict=False):
            assert follows(j, i)
            value -= cost(j, i)
        assert value == pytest.approx(max(top.values()))
    got = passages.runs(np.array([5, 1, 2, 40, 7]), np.array([15, 11, 12, 50, 3]))
    assert sorted(map(tuple, got.tolist())) == [(1, 11, 5, 15, 3), (7, 3, 7, 3, 1), (40, 50, 40, 50, 1)]


# --- 4 language ID -------------------------------------------------------------------------------------


def test_language_id(spark):
    r = random.Random(5)
    of = {"aa": "abcdefg", "bb": "hijklmn", "cc": "aehkoru"}
    rows = [(d, " ".join("".join(r.choices(of[g], k=r.randint(2, 6))) for _ in range(40)), g) for d, g in enumerate(["aa", "bb", "cc"] * 30)]
    df = spark.createDataFrame([*rows, (99, "Abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(df.filter(~langid.held_out()))
    got = {x["doc_id"]: x for x in langid.identify(df.withColumn("held_out", langid.held_out()), model, ["doc_id", "held_out"]).collect()}
    assert all(got[d]["lang_pred"] == g for d, _, g in rows) and all(0 <= x["score"] <= 1 for x in got.values())
    assert got[2]["held_out"] == (zlib.crc32(b"2") % 4 == 2)
    odd = {x["text"]: x for x in langid.identify(frame(spark, ODD), model, ["doc_id", "text", "score"], ("p", "s")).collect()}
    assert odd[None]["p"] == odd[""]["p"] == odd["..."]["p"] == langid.UNKNOWN and odd[""]["s"] == 0 and odd["one"]["p"] in of
    assert langid.identify(df.filter("false"), model, ["doc_id"]).count() == 0
    none = langid.fit(df.filter("false"))
    assert {x["lang_pred"] for x in langid.identify(df, none, ["doc_id"]).collect()} == {langid.UNKNOWN}


def test_language_equals_exact_sets(spark):
    """The filter's corrected shares against sets of the same n-grams; long texts, cut in parts."""
    r = random.Random(7)
    of = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "klmnoabc"}
    prose_of = lambda g, n: " ".join("".join(r.choices(of[g], k=r.randint(2, 7))) for _ in range(n))
    rows = [(d, prose_of(g, r.randint(5, 300)), g) for d, g in enumerate(["aa", "bb", "cc"] * 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def ngrams(text, k):
        t = " " + re.sub(r"[^a-z]+", " ", text.lower()).strip() + " "
        return [t[i : i + k] for i in range(len(t) - k + 1) if " " not in t[i + 1 : i + k - 1]]

    sure, maybe = {g: set() for g in of}, {g: set() for g in of}  # n-grams as rare as the last one that is taken may be left out
    for g in of:
        for k in langid.ORDERS:
            c = Counter(x for _, t, h in rows if h == g for x in ngrams(t, k))
            total, seen, last = sum(c.values()), 0, 0
            for _, last in c.most_common():
                seen += last
                if seen >= langid.COVER * total:
                    break
            sure[g] |= {x for x, n in c.items() if n > last}
            maybe[g] |= {x for x, n in c.items() if n >= last}
    for text in [t for _, t, _ in rows[:30]] + [prose_of("aa", 50) + " " + prose_of("bb", 20), "x", "ab, cd"]:
        all_ = [x for k in langid.ORDERS for x in ngrams(text, k)]
        lang, score = model.predict(text)
        if all_:
            low, high = ({g: sum(x in known[g] for x in all_) / len(all_) for g in of} for known in (sure, maybe))
            assert max(low.values()) - 0.02 <= score <= high[lang] + 0.02
    long = prose_of("bb", 600_000)
    assert len(long) > langid.PART and "".join(langid.parts_of(long)) == long and model.predict(long)[0] == "bb"
    assert all(" " in p[-1] + q[0] for p, q in zip([*langid.parts_of(long)], [*langid.parts_of(long)][1:], strict=False))


def test_bloom_slices_name_all_languages():
    langs = [f"l{k}" for k in range(11)]
    slices = np.zeros(1 << langid.SLOT_BITS, np.uint16)
    h = np.random.default_rng(2).integers(0, 2**63, 400, np.uint64)
    for k in range(11):
        for s in langid.slots_of(h[k * 30 : k * 30 + 60]):
            slices[s] |= np.uint16(1 << k)
    masks = langid.Model(langs, slices).masks(h)
    for i, m in enumerate(masks):
        assert all(m >> k & 1 for k in range(11) if k * 30 <= i < k * 30 + 60)


# --- 5 chat formatting ---------------------------------------------------------------------------------

TURNS = [("user", "</turn> \\### <turn>x <\\</turn> <\\\\turn>"), ("assistant", "a<"), ("we\n\\ird", "</turn>\n<turn>assistant\nhi"), ("assistant", ""), ("", "b\\n")]


def test_chat_round_trip(spark):
    tables.prepare(spark)
    rows = [(1, k, role, text) for k, (role, text) in enumerate(TURNS)] + [(2, None, None, None), (3, 1, "user", "same"), (3, 1, "user", "same"), (None, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"record": F.lit(1), "formatted": F.lit(2)})
    out = chat.format_chats(chat.records_of_rows(df), "conv_id", "record")
    got = {x["conv_id"]: x for x in chat.chat_digests(out).collect()}
    text = {x["conv_id"]: x["formatted"] for x in out.collect()}
    whole = "".join(f"{a}\n{b}\n" for a, b in TURNS)
    loss = "".join(b for a, b in TURNS if a == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[1]["n_turns"] == 5
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1]["formatted_chars"] == len(text[1]) and text[1].count("</turn>") == text[1].count("<turn>") == 5
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[3]["n_turns"] == 2 and got[None]["loss_chars"] == 100_000
    assert chat.format_chats(chat.records_of_rows(df.filter("false")), "conv_id", "record").count() == 0


def test_chat_layouts(spark):
    tables.prepare(spark)
    rows = [('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', ["user:a", "assistant:b"]), ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', ["user:a", "assistant:b"]),
            ('{"instruction":"i","input":"j","output":"o"}', ["user:i", "user:j", "assistant:o"]), ('{"prompt":"p","completion":"c"}', ["user:p", "assistant:c"]), ('{"response":"r","system":"s","prompt":null}', ["system:s", "assistant:r"]),
            ('{"answer":"a","question":"q"}', ["user:q", "assistant:a"]), ('{"messages":[{"content":"a"},{"role":"human","content":null}]}', [":a", "user:"]),
            ('{"prompt": "[{\\"x\\": 1}] \\\\" , "response" :"{\\"a\\":\\"b\\"}"}', ['user:[{"x": 1}] \\', 'assistant:{"a":"b"}']), ('{"messages":[{"role":"user","content":["a"]}]}', None),
            ('{"rows":[{"turn":1,"role":"human","text":"x"}]}', ["human:x"]), ('{"other":1}', None), ("no json", None), (None, None), ("", None)]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "id long, record string")
    found = {x["id"]: x["t"] for x in df.select("id", chat.json_turns(F.col("record")).alias("t")).collect()}
    assert [found[k] and [f"{t['role']}:{t['text']}" for t in found[k]] for k in range(len(rows))] == [r[1] for r in rows]
    assert chat.format_chats(df, "id", "record").filter("formatted IS NULL").count() == 5
    typed = spark.createDataFrame([(1, (("x", "y")))], "id long, record struct<completion: string, prompt: string>")
    assert chat.format_chats(typed, "id", "record").collect()[0]["formatted"] == "<turn>user\ny</turn>\n<turn>assistant\nx</turn>\n"
    with pytest.raises(ValueError):
        chat.format_chats(typed.select("id", F.struct(F.lit(1).alias("z")).alias("record")), "id", "record")


# --- 6 packing -----------------------------------------------------------------------------------------


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [*ODD, *((d, prose(random.Random(d).randint(1, 900))) for d in range(20, 80)), (90, "<|endoftext|> 's\u0085    x\t\t\n\n y \x1c z ½²")]
    out = packing.pack(packing.cut_pieces(frame(spark, docs), with_ids=True))
    rows = out.collect()
    by_doc = defaultdict(list)
    for x in rows:
        by_doc[x["doc_id"]].append(x)
    for d, text in docs:
        if d in (6, None):
            continue
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[d], key=lambda x: x["piece"])
        assert [i for x in mine for i in x["ids"]] == ids and [x["piece"] for x in mine] == list(range(len(mine)))
        assert [x["start"] for x in mine] == packing.cuts(len(ids)) and all(x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes()) for x in mine)
        assert all(x["length"] == 2048 for x in mine[1:])
    assert len(by_doc[6]) == 2
    bins = defaultdict(list)
    for x in rows:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == len(brute_pack([x["length"] for x in rows], 2048))
    assert packing.pack(packing.cut_pieces(frame(spark, [])[["doc_id", "text"]])).count() == 0


def brute_pack(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return left


def test_plan_is_best_fit_decreasing():
    for seed in range(150):
        r = random.Random(seed)
        cap = r.choice([7, 20, 64, 2048])
        lengths = [r.randint(1, cap) if r.random() < 0.7 else r.randint(1, max(1, cap // 5)) for _ in range(r.randint(0, 250))]
        left, ranks = {}, defaultdict(int)
        for length, rank, n, first, each, offset in packing.plan(Counter(lengths), cap):
            assert rank == ranks[length]
            ranks[length] += n
            for k in range(n):
                b = first + k // each
                assert left.get(b, cap) == cap - offset - k % each * length
                left[b] = left.get(b, cap) - length
        assert ranks == Counter(lengths) and sorted(left.values()) == sorted(brute_pack(lengths, cap))


# --- 7 LM scoring --------------------------------------------------------------------------------------


def test_lm_base(spark):
    docs = [*ODD[:7], *((d, prose(random.Random(d).randint(1, 300))) for d in range(20, 60)), (61, "The THE the\x0bthe x")]
    got = {x["doc_id"]: x for x in ppm.score(frame(spark, docs)).collect()}
    tok = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [b" "]
    count = Counter()
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(tok(t))
    n, v = sum(count.values()), len(count)
    for d, t in docs:
        x = got[d]
        assert x["n_tokens"] == len(tok(t)) and x["n_known"] == sum(w in count for w in tok(t)) and x["train_tokens"] == n
        assert x["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tok(t)))
        assert x["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2) and x["score"] < 0
    assert len(ppm.score(frame(spark, ODD)).collect()) == len(ODD)
    assert ppm.score(frame(spark, [])).count() == 0
    assert ppm.score(frame(spark, {14: "ab"})).collect()[0]["train_tokens"] >= 0


def test_lm_keeps_every_gram(spark, monkeypatch):
    """Rare grams of a corpus of over 2^20 bytes count; blocks and buckets do not matter."""
    monkeypatch.setattr(ppm, "BLOCK", 150_000, raising=False)
    monkeypatch.setattr(ppm, "BUCKET_CHARS", 300_000, raising=False)
    docs = {k: prose(40_000, random.Random(k)) for k in range(12)} | {k: " ".join(f"q{k}z{j}x" for j in range(k)) for k in range(20, 60)} | {60: "\u4e2d\u6587 \x01\x02 \U0001f600", 61: None}
    train = [ppm.stream_of(ppm.tokens_of(t)) for d, t in docs.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    assert sum(map(len, train)) > 2 << 20
    codes, n = np.unique(np.concatenate([ppm.grams(s) for s in train]), return_counts=True)
    entries, contexts = [], []
    for k in range(ppm.ORDER, -1, -1):
        low, at = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        times = np.bincount(at, n).astype(int)
        ctx, at = np.unique(low >> np.uint64(8), return_inverse=True)
        entries.insert(0, (low, times))
        contexts.insert(0, (ctx, np.bincount(at, times)))
    trie = ppm.Trie(entries, contexts)
    got = {x["doc_id"]: x["score"] for x in ppm.score(frame(spark, docs).repartition(3)).collect()}
    assert len(got) == len(docs)
    for (d, t), want in zip(docs.items(), trie.text_scores([ppm.stream_of(ppm.tokens_of(t)) for t in docs.values()]), strict=True):
        assert got[d] == pytest.approx(want), d


def test_trie_is_a_distribution_and_excludes():
    text = [ppm.stream_of(ppm.tokens_of(prose(400, random.Random(k)))) for k in range(5)]
    codes, n = np.unique(np.concatenate([ppm.grams(s) for s in text]), return_counts=True)
    entries, contexts = [], []
    for k in range(ppm.ORDER, -1, -1):
        if k < ppm.ORDER:
            codes, at = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, n).astype(int)
        keep = n >= 2
        ctx, at = np.unique(codes >> np.uint64(8), return_inverse=True)
        some = np.bincount(at, keep) > 0
        entries.insert(0, (codes[keep], n[keep]))
        contexts.insert(0, (ctx[some], np.bincount(at, n)[some]))
    trie = ppm.Trie(entries, contexts)
    for at in range(6, 60, 7):
        total = sum(10 ** trie.score(ppm.grams(np.append(text[0][: at + 1], np.uint8(b))))[-1] for b in range(256))
        assert total == pytest.approx(1)
    assert trie.text_scores([text[1]])[0] == pytest.approx(float(trie.score(ppm.grams(text[1])).sum()))
    assert trie.text_scores(text)[3] / len(text[3]) > -math.log10(256) / 2


# --- 8 near-dedup --------------------------------------------------------------------------------------


def brute_classes(docs):
    toks = {d: tuple(re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) for d, t in docs}
    sh = {d: Counter(w[k : k + min(5, len(w))] for k in range(max(1, len(w) - 4))) if w else Counter() for d, w in toks.items()}
    df = Counter(s for c in sh.values() for s in c)
    vec = {d: {s: n * math.log1p(len(docs) / df[s]) for s, n in c.items()} for d, c in sh.items()}
    root = {d: d for d in vec}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(vec)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if vec[a] and vec[b]:
                common = sum(min(w, vec[b].get(s, 0)) for s, w in vec[a].items())
                if common >= 0.8 * (sum(vec[a].values()) + sum(vec[b].values()) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_dedup(spark):
    r = random.Random(12)
    docs = [(d, prose(r.randint(3, 200), r)) for d in range(60)]
    for d in range(60, 140):
        source = docs[r.randrange(60)][1]
        docs.append((d, edited(source, r, r.choice([0, 0, 1, 2, 5]))))
    docs += [(140, None), (141, ""), (142, "!"), (143, docs[3][1].upper())]
    df = frame(spark, docs)
    got = {x["doc_id"]: x for x in neardup.classes(df).collect()}
    assert {d: x["class_id"] for d, x in got.items()} == brute_classes(docs)
    out = neardup.without_near_copies(df)
    assert out.columns == df.columns and {x["doc_id"] for x in out.collect()} == set(brute_classes(docs).values())


def test_near_dedup_odd(spark):
    rows = neardup.classes(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    ids = {x["doc_id"]: x["class_id"] for x in rows if x["doc_id"]}
    assert ids[8] == 7 and ids[5] == ids[6] == 4 and ids[1] == 1 and ids[2] == 2 and ids[3] == 3
    assert neardup.classes(frame(spark, [])).count() == 0


def test_near_dedup_pairs_without_a_pivot(spark, monkeypatch):
    """A bucket of many pairs, whose members are like each other and not like the pivots."""
    monkeypatch.setattr(neardup, "_bands", lambda node: node.selectExpr("node", "1D AS shared", "0 AS band", "1L AS h1", "1L AS h2"))
    r = random.Random(5)
    docs = {}
    for k in range(0, 24, 2):
        docs[k] = prose(100, r, 1000)
        docs[k + 1] = docs[k] + " end"
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(frame(spark, docs)).collect()}
    assert got == {d: d - d % 2 for d in docs} == brute_classes(list(docs.items()))


def test_near_dedup_counts_beyond_16_bits(spark):
    many = "one two three four five six seven eight " * 100_000
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(frame(spark, {1: many, 2: many + "nine", 3: "a b c d e f"})).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_near_dedup_common_shingles_and_blocks(spark, monkeypatch):
    """Copies by the hundred, spread over blocks, with one passage in every text."""
    r = random.Random(3)
    common = " ".join(VOCABULARY[:12])
    docs = [(d, common + " " + (prose(60, random.Random(d % 40)) if d < 240 else prose(60, r))) for d in range(300)]
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(frame(spark, docs).repartition(6)).collect()}
    assert got == brute_classes(docs)


def test_weighted_samples_estimate_the_similarity():
    rng = np.random.default_rng(4)
    ids = rng.integers(1, 2**63, 600, np.uint64)
    wa, wb = rng.random(600).astype(np.float32) + 0.1, rng.random(600).astype(np.float32) + 0.1
    wa[:60] = 0
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    hits = [(neardup.samples(ids[wa > 0] + np.uint64(k), wa[wa > 0]) == neardup.samples(ids + np.uint64(k), wb)).mean() for k in range(40)]
    assert abs(np.mean(hits) - true) < 0.03


def test_components(spark):
    r = random.Random(7)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {x["id"]: x["root"] for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9 personal data -----------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = {k: [m.span() for m in re.finditer(p, text)] for k, p in PLAIN.items()}
    digits = lambda s: re.sub("[^0-9]", "", text[slice(*s)])
    out["ip"] = [s for s in out["ip"] if all(int(x) <= 255 for x in text[slice(*s)].split("."))]
    out["card"] = [s for s in out["card"] if 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s))]
    out["phone"] = [s for s in out["phone"] if 9 <= len(digits(s)) <= 15]
    return out


def test_fixed_spans_match_the_plain_patterns():
    r = random.Random(1)
    parts = ["a@b.co", "x.y+z@h-1.example.com", "@", "a@@b.c", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "0001.02.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (269) 555-3296",
             "+12", "+1  ", "--", " ", "é", "12", ".", "4485275742308327", "\n", "a.b", "+", "007", "- 5"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(0, 9)))
        assert pii.base_spans(text) == plain_spans(text), text
    for long in ("a" * 200_000, "1" * 200_000, "@" * 50_000, "+1" + " " * 100_000, "1." * 50_000, "a@" * 50_000):
        pii.base_spans(long)


def test_personal_data(spark):
    texts = [*ODD, (20, 'mail ab.12@mail.org key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" on (269) 555-3296 at 10.0.0.1.')]
    model = pii.train()
    rows = {x["doc_id"]: x for x in pii.span_digests(frame(spark, texts), model).collect()}
    text = texts[-1][1]
    base = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in plain_spans(text)[k])
    assert rows[20]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and rows[20]["n_email"] == rows[20]["n_ip"] == 1
    assert set(base.split(",")) < set(rows[20]["spans"].split(",")) and f"secret:{text.index('04db')}:{text.index('04db') + 40}" in rows[20]["spans"]
    assert rows[1]["spans"] == rows[2]["spans"] == "" and len(rows) == len({d for d, _ in texts})
    assert rows[20]["n_spans"] == len(rows[20]["spans"].split(",")) == rows[20]["n_added"] + len(base.split(",")) and rows[20]["n_phone"] == 0
    assert pii.span_digests(frame(spark, []), model).count() == 0


def test_the_model_finds_held_out_entities():
    model, r, hit, wrong, all_ = pii.train(), random.Random(99), 0, 0, 0
    for _ in range(150):
        text, gold = pii._sentence(r)
        got = set(model.decode(text, pii.zones(text)))
        hit, wrong, all_ = hit + len(got & set(gold)), wrong + len(got - set(gold)), all_ + len(gold)
    assert hit / all_ > 0.95 and wrong / all_ < 0.03


#: Written by hand, not by the generator of the training sentences: text, entities.
WRITTEN = [
    ("My number is 020 7946 0958, ask for Jo.", ["phone 020 7946 0958"]), ("Fax: (020) 7946-0958", ["phone (020) 7946-0958"]), ("Reach us: 555.014.2278!", ["phone 555.014.2278"]),
    ("export AWS_SECRET_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", ["secret wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"]), ("password: correcthorse99", ["secret correcthorse99"]),
    ("jane.roe[at]mail.example.org wrote", ["email jane.roe[at]mail.example.org"]), ("write to max at beispiel dot de today", ["email max at beispiel dot de"]), ("SSN 078-05-1120 on file", ["account 078-05-1120"]),
    ("IBAN GB82 WEST 1234 5698 7654 32", []), ("pay to DE02120300000000202051 now", ["account DE02120300000000202051"]), ("api_key = 'a8f5f167f44f4964e6c998dee827110c'", ["secret a8f5f167f44f4964e6c998dee827110c"]),
    ("commit 9fceb02d0ae598e95dc970b74767f19372d61af8", ["secret 9fceb02d0ae598e95dc970b74767f19372d61af8"]), ("In 1987, 3,214 of 10,000 (32%) left at 10:45.", []), ("Version 2.14.3 of 2023-11-05", []), ("pages 12-19, ISBN 978-3-16-148410-0", []),
    ("The key points are: be brief. Token economy.", []), ("www.example.org/a/b?id=3", []), ("Room 12B, floor 3, 8.30 to 17.45", []),
]


def test_the_model_finds_written_entities():
    model, hit, wrong, all_ = pii.train(), 0, 0, 0
    for text, want in WRITTEN:
        got = {f"{k} {text[a:b]}" for k, a, b in model.decode(text, pii.zones(text))}
        hit, wrong, all_ = hit + len(got & set(want)), wrong + len(got - set(want)), all_ + len(want)
    assert hit / all_ >= 0.9 and wrong <= 1, (hit, wrong, all_)


def segmentations(n, spans):
    """Every labelled segmentation of n tokens: lists of (label, first, tokens, span or None)."""
    if not n:
        yield []
        return
    for k, (first, many) in [(None, (n - 1, 1)), *enumerate(spans)]:
        if first + many == n:
            for rest in segmentations(first, spans):
                for label in [0] if k is None else range(1, pii.K):
                    yield [*rest, (label, first, many, k)]


def test_segmentations_equal_brute_force():
    rng, r = np.random.default_rng(5), random.Random(5)
    for _ in range(8):
        model = pii.Model(rng.normal(0, 0.6, (pii.K - 1, pii.N_FEATURES)), rng.normal(0, 1, (pii.K, pii.K)))
        text = "".join(r.choice(["1", "22", "ab", "-", " ", "@", "x9"]) for _ in range(6)) + "7"
        t = pii.Tokens(text, [(0, len(text))])
        first, many, feats = t.spans()
        score, n = model.scores(feats), len(t.start)
        spans = list(zip(first.tolist(), many.tolist(), strict=True))
        value, chance, steps = {}, np.zeros((len(spans), pii.K - 1)), np.zeros((pii.K, pii.K))
        every = list(segmentations(n, spans))
        for i, way in enumerate(every):
            labels = [0, *(x[0] for x in way), 0]
            value[i] = sum(score[x[3], x[0] - 1] for x in way if x[0]) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))
        log_z = math.log(sum(math.exp(v) for v in value.values()))
        for i, way in enumerate(every):
            p, labels = math.exp(value[i] - log_z), [0, *(x[0] for x in way), 0]
            for x in way:
                if x[0]:
                    chance[x[3], x[0] - 1] += p
            for a, b in zip(labels, labels[1:], strict=False):
                steps[a, b] += p
        z, span, moved = pii.expected(np.array([n]), np.zeros(len(first), int), first, many, score, model.moves)
        assert z[0] == pytest.approx(log_z) and np.allclose(span, chance) and np.allclose(moved, steps)
        best = every[max(value, key=value.get)]
        want = [(pii.ADDED[x[0] - 1], int(t.start[x[1]]), int(t.end[x[1] + x[2] - 1])) for x in best if x[0]]
        assert model.decode(text, [(0, len(text))]) == want


def test_personal_data_in_long_texts():
    model = pii.train()
    for text in ("1-" * 20_000, "a1" * 100_000, "1 " * 20_000, "@" * 20_000, "x@y." * 5_000, "key=" * 5_000):
        pii.added_spans(text, model, pii.base_spans(text))
    key = "0123456789abcdef" * 8
    assert pii.added_spans(f"token = '{key}'", model, pii.base_spans(key)) == [("secret", 9, 9 + 128)]


# --- 10 media ------------------------------------------------------------------------------------------


def brute_pairs(raw):
    """Fingerprint by plain loops over frames, bands and peaks."""
    signal = [b - 128.0 for b in raw]
    signal += [0.0] * (max(0, media.FRAME - len(signal)) or -(len(signal) - media.FRAME) % media.HOP)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (media.FRAME - 1)) for k in range(media.FRAME)]
    best = []
    for at in range(0, len(signal) - media.FRAME + 1, media.HOP):
        power = np.abs(np.fft.rfft([s * w for s, w in zip(signal[at : at + media.FRAME], window, strict=True)])) ** 2
        best.append([max((power[k], -k) for k in range(lo, hi)) for lo, hi in media.BANDS])
    peaks = []
    for t in range(len(best)):
        for band in range(len(media.BANDS)):
            p = best[t][band][0]
            if p > (best[t - 1][band][0] if t else 0) and p >= (best[t + 1][band][0] if t + 1 < len(best) else 0) and p > 1e-3:
                peaks.append((t, -best[t][band][1]))
    return sorted((t << 32) | (f << 20) | (g << 8) | (u - t) for k, (t, f) in enumerate(peaks) for u, g in peaks[k + 1 : k + 1 + media.FAN_OUT] if u - t <= media.MAX_GAP)


def test_fingerprints_equal_plain_loops():
    rng = np.random.default_rng(3)
    for n in (64, 256, 320, 1000, 6400):
        raw = rng.integers(0, 256, n, np.uint8)
        assert media.fingerprint(raw).tolist() == brute_pairs(raw.tolist())


def test_media(spark):
    rows = media.media_digests(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(set)
    for x in rows:
        by[x["doc_id"]].add((x["payload_sha256"], x["feature"]))
    for d, text in ODD:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = next(x for x in rows if x["doc_id"] == d and x["n_bytes"] == len(raw))
        assert x["payload_bytes"] == len(payload) and x["payload_sha256"] == hashlib.sha256(payload).hexdigest() and x["tail_crc32"] == zlib.crc32(payload[-64:])
    assert by[1] == by[2] and len({x["feature"] for x in rows if x["doc_id"] in (4, 6)}) == 1
    full = {x["doc_id"]: x for x in media.media_columns(frame(spark, {7: LONG, 1: None})).collect()}
    with wave.open(io.BytesIO(bytes(full[7]["media"]))) as w:
        assert w.readframes(w.getnframes()).startswith(LONG.encode())
    assert rows[0].__fields__[7:] == ["feature", "n_pairs"]
    for x in rows:
        codes = [int(x["feature"][k : k + 16], 16) for k in range(0, len(x["feature"]), 16)]
        assert len(codes) == x["n_pairs"] and (x["doc_id"] not in full or codes == full[x["doc_id"]]["fingerprint"])
    assert len(full[7]["fingerprint"]) > 100 and len(full[1]["media"]) == 108 and full[7]["fingerprint"] == sorted(full[7]["fingerprint"])
    assert media.media_columns(frame(spark, [])).count() == 0


def test_fingerprints_find_a_tone():
    assert len(media.fingerprint(np.full(5000, 128, np.uint8))) == 0
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / media.RATE) * (t // 800 % 2)).astype(np.uint8)
    bins, mags = media.band_peaks(tone)
    loud = mags[:, 1].argmax()
    assert abs(int(bins[loud, 2]) - 32) <= 0 or abs(int(bins[mags[:, 2].argmax(), 2]) - 32) <= 1
    shifted = media.fingerprint(np.concatenate([np.full(media.HOP * 8, 128, np.uint8), tone]))
    same = {c & 0xFFFFFFFF for c in media.fingerprint(tone).tolist()} & {c & 0xFFFFFFFF for c in shifted.tolist()}
    assert len(same) > 0


# --- the contract's queries ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, sf)
    with duckdb.connect() as con:
        for table in ("documents", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        want = con.execute(queries.oracle_sql()[name])
        assert sorted(got.columns) == sorted(c[0] for c in want.description)
        by_name = [c[0] for c in want.description]
        assert sorted(tuple(x) for x in got.select(by_name).collect()) == sorted(want.fetchall())


def test_one_query_for_each_operator(spark):
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 11))
