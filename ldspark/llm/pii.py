"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The fixed patterns always stand. Around what personal data needs (digits, '@', a word such as `password` with a
sign of assignment), the text is cut into zones of tokens: runs of letters and digits, or single other
characters. Within a zone every segment of at most MAX_TOKENS tokens is a candidate entity with features of the
whole span: its digits and their groups, shape, signs, check digit, and the tokens and words beside it. A
labelled segmentation scores the sum of its segments' weights and of the transitions between neighbouring
labels; tokens outside of entities are segments of one token. Dynamic programming over segment ends and types
finds the best one, so boundaries and types are chosen jointly. Segments that overlap a fixed match are not
candidates, so fixed matches stay as they are.

Weights maximize the conditional likelihood (less a quadratic penalty) of generated sentences: `train` runs
forward and backward sums over all segmentations, takes a few seconds on the driver, is deterministic and needs
no labelled corpus. The bound MAX_TOKENS belongs to the model; characters are not bounded, so a key of any
length is one token. Cost is linear in the text.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_batches

#: The order of kinds; the others are only added by the model (account: IBAN and social security numbers).
KINDS = ("email", "ip", "card", "phone")
ADDED = (*KINDS, "secret", "account")
MAX_TOKENS = 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain. Each match holds one '@', with the longest local part before
    it, so going from '@' to '@' is exact and linear where the plain pattern is quadratic."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The fixed patterns' spans by kind, in code points with exclusive ends."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


_SECRET_WORDS = "token key apikey secret password passwd passphrase pass pwd auth bearer credential".split()
_TRIGGER = re.compile(rf"[0-9]+|@|[\[(]at[\])]|\x20[\[(]?at[\])]?\x20[A-Za-z0-9-]+\x20[\[(]?dot[\])]?\x20(?=[a-z])|(?i:{'|'.join(sorted(_SECRET_WORDS, key=len, reverse=True))})[\"']?[\x20]?[:=]")
_TOKEN = re.compile(r"[A-Za-z0-9]+|.", re.S)
_GAP = re.compile(r"\s")
_VALUE = re.compile(r"[\x20]?[:=]?[\x20]?\S*")


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold an entity: triggers, widened to white space, joined over one character. One after a
    word for secrets goes on over the value that is assigned."""
    out: list[list[int]] = []
    end = 0
    for m in _TRIGGER.finditer(text):
        if m.end() <= end:
            continue
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        if m[0][-1] in ":=":
            end = _VALUE.match(text, m.end() - 1).end()
        else:
            gap = _GAP.search(text, m.end())
            end = gap.start() if gap else len(text)
        if out and a <= out[-1][1] + 1:
            out[-1][1] = end
        else:
            out.append([a, end])
    return [(a, b) for a, b in out]


#: Words to the left of a span that say what it is, by group.
_BESIDE = {w: k for k, words in enumerate((
    _SECRET_WORDS, "tel telephone phone call fax mobile cell dial ring".split(), "card visa mastercard amex credit debit".split(), "ip host server address addr".split(),
    "email mail contact write".split(), "ssn iban account acct social security bank".split(), "version v page isbn order no date on in since id section chapter".split()), 1) for w in words}
_LAST_WORD = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,4}\Z")
_SIGNS = " .-()+@/:=_,\"'[]#%\n\t"
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+(?:@|\[at\]|\(at\)|\x20[\[(]?at[\])]?\x20)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\.|\x20[\[(]?dot[\])]?\x20)[A-Za-z]{2,}")
_LENGTHS = np.digitize(np.arange(65), [1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 32, 40, 64])  # classes 0 to 14
_KIND_LENGTHS = 15

#: Sizes of the feature groups, one value of each for a span: tokens, tokens to the left and right, first and last
#: token, digits, groups of digits, signs, checks, word to the left, longest token, lengths of the digit groups, letters.
GROUPS = (MAX_TOKENS + 1, 64, 64, 64, 64, 24, 10, 256, 12, 8, 64, 1024, 16)
_STARTS = np.cumsum((0, *GROUPS))
N_FEATURES = int(_STARTS[-1])


class Tokens:
    """The tokens of a text's zones, one zone after another, as arrays."""

    def __init__(self, text: str, stretches: list[tuple[int, int]]):
        self.text = text
        start, end, zone = [], [], []
        for z, (a, b) in enumerate(stretches):
            for m in _TOKEN.finditer(text, a, b):
                start.append(m.start())
                end.append(m.end())
                zone.append(z)
        self.start, self.end, self.zone = (np.array(x, np.int64) for x in (start, end, zone))
        n = len(start)
        self.kind, self.digits, self.letters = (np.zeros(n, np.int64) for _ in range(3))
        self.beside = np.zeros(n, np.int64)
        for k, (a, b) in enumerate(zip(start, end, strict=True)):
            c = text[a]
            if b - a > 1 or c.isascii() and c.isalnum():
                s = text[a:b]
                d = sum(map(s.count, "0123456789"))
                size = int(_LENGTHS[min(b - a, 64)])
                self.digits[k], self.letters[k] = d, b - a - d
                self.kind[k] = 19 + (size if d == b - a else _KIND_LENGTHS + size if not d else 2 * _KIND_LENGTHS + size)
            else:
                at = _SIGNS.find(c)
                self.kind[k] = at if at >= 0 else 18
            if m := _LAST_WORD.search(text, max(0, a - 24), a):
                self.beside[k] = _BESIDE.get(m[1].lower(), 0)
        self.left, self.right = (self._outside(text, x) for x in (self.start - 1, self.end))

    @staticmethod
    def _outside(text: str, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        for k, p in enumerate(at.tolist()):
            c = text[p] if 0 <= p < len(text) else ""
            found = _SIGNS.find(c) if c else 62
            out[k] = found if found >= 0 else 60 if c.isdigit() else 61 if c.isalpha() else 63
        return out

    def spans(self):
        """(first token, number of tokens, features) of all candidates: a span begins and ends with no white space and
        holds a letter or digit. features has a row for each span and a column for each group."""
        n = len(self.start)
        kind, alnum = self.kind, self.kind >= 19
        space = (kind == 0) | (kind == 16) | (kind == 17)
        sign = np.where(alnum, 0, np.select([kind == 0, kind == 1, kind == 2, (kind == 3) | (kind == 4), kind == 5, kind == 6, (kind == 7) | (kind == 8)], [1, 2, 4, 8, 16, 32, 64], 128))
        size = self.digits + self.letters
        only = alnum & (self.letters == 0)
        first, many, feats = [], [], []
        at = np.flatnonzero(~space)
        digits, letters, groups, longest, mixed, signs, code = (np.zeros(n, np.int64) for _ in range(7))
        for length in range(1, MAX_TOKENS + 1):
            at = at[at + length <= n]
            last = at + length - 1
            at = at[self.zone[last] == self.zone[at]]
            if not len(at):
                break
            last = at + length - 1
            digits[at] += self.digits[last]
            letters[at] += self.letters[last]
            groups[at] += only[last]
            longest[at] = np.maximum(longest[at], size[last])
            mixed[at] |= (self.digits[last] > 0) & (self.letters[last] > 0)
            signs[at] |= sign[last]
            code[at] = np.where(only[last], (code[at] * 21 + np.minimum(size[last], 20)) & 0xFFFFFFFF, code[at])
            use = at[~space[last] & (digits[at] + letters[at] > 0)]
            if not len(use):
                continue
            end = use + length - 1
            d = digits[use]
            checks = np.zeros(len(use), np.int64)
            plain = letters[use] == 0
            s = signs[use]
            for test, look in (
                (plain & (d >= 13) & (d <= 19) & ((s & ~5) == 0), self._luhn), (plain & (groups[use] == 4) & (s == 2) & (length == 7), self._bytes),
                ((s & 32 > 0) | (letters[use] > 4) & ((s & 136 > 0) & (s & 2 > 0) | (s & 1 > 0) & (length >= 7)), self._address),
            ):
                for k in np.flatnonzero(test).tolist():
                    checks[k] = checks[k] or look(self.text[self.start[use[k]] : self.end[end[k]]])
            dial = (checks == 0) & plain & (d >= 9) & (d <= 15) & ((s & ~31) == 0)
            checks[dial] = np.where(s[dial] & 24 > 0, 7, 8)
            one = np.where(groups[use] > 0, (code[use] * 2654435761 >> 7) & 1023, 0)
            spread = np.minimum(letters[use] * 3 // np.maximum(d, 1), 14) + (d > 0)
            feats.append(np.stack([
                np.full(len(use), length), self.left[use], self.right[end], np.minimum(kind[use], 63), np.minimum(kind[end], 63), np.minimum(d, 23), np.minimum(groups[use], 9), s, checks,
                self.beside[use], _LENGTHS[np.minimum(longest[use], 64)] * 2 + mixed[use], one, np.where(d == 0, 15, spread) ], axis=1))
            first.append(use)
            many.append(np.full(len(use), length))
        if not first:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(GROUPS)), np.int64)
        return np.concatenate(first), np.concatenate(many), np.concatenate(feats) + _STARTS[:-1]

    @staticmethod
    def _luhn(s: str) -> int:
        return 1 if luhn(re.sub("[^0-9]", "", s)) else 2

    @staticmethod
    def _bytes(s: str) -> int:
        return 3 if all(map(_byte, s.split("."))) else 4

    @staticmethod
    def _address(s: str) -> int:
        return 5 if _ADDRESS.fullmatch(s) else 6 if "@" in s else 0


K = len(ADDED) + 1  # labels: 0 is outside


class Model:
    """weights: (K - 1, N_FEATURES) of each kind's spans. moves: (K, K), of a label after another, 0 first and last."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        #: What an entity in place of outside tokens can gain by its transitions at most.
        self.gain = 2 * float(moves.max() - moves.min()) + MAX_TOKENS * max(0.0, float(-moves[0, 0]))

    def scores(self, feats: np.ndarray) -> np.ndarray:
        return self.weights[:, feats].sum(axis=2).T

    def decode(self, text: str, stretches: list[tuple[int, int]], fixed: list[tuple[int, int]] = ()) -> list[tuple[str, int, int]]:
        """Entities of the best labelled segmentation of each stretch. Ties go to the label that is first in order and
        the shorter segment."""
        t = Tokens(text, stretches)
        first, many, feats = t.spans()
        score = self.scores(feats)
        hopeful = (score + self.gain > 0).any(axis=1)
        first, many, score = first[hopeful], many[hopeful], score[hopeful]
        if fixed and len(first):
            a, b = t.start[first], t.end[first + many - 1]
            free = np.ones(len(first), bool)
            for x, y in fixed:
                free &= (b <= x) | (y <= a)
            first, many, score = first[free], many[free], score[free]
        out: list[tuple[str, int, int]] = []
        for z in np.unique(t.zone[first]).tolist():
            lo, hi = np.searchsorted(t.zone, [z, z + 1]).tolist()
            mine = t.zone[first] == z
            out += [(ADDED[k - 1], int(t.start[lo + i]), int(t.end[lo + j - 1])) for k, i, j in self.best(hi - lo, first[mine] - lo, many[mine], score[mine])]
        return out

    def best(self, n: int, first: np.ndarray, many: np.ndarray, score: np.ndarray) -> list[tuple[int, int, int]]:
        """(label, first token, end) of the entities of the best segmentation of n tokens."""
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, e in enumerate((first + many).tolist()):
            ending[e].append(k)
        begin, moves, rows = first.tolist(), self.moves, score.tolist()
        low = float("-inf")
        value = [[0.0] + [low] * (K - 1)]
        back: list[list] = [[None] * K]
        enter = []  # of each place the best (value, label before) by label
        for j in range(n + 1):
            if j:
                here, from_ = [low] * K, [None] * K
                here[0], from_[0] = enter[j - 1][0][0], (j - 1, enter[j - 1][0][1])
                for k in sorted(ending[j], key=lambda k: -begin[k]):
                    at = enter[begin[k]]
                    for label in range(1, K):
                        v = at[label][0] + rows[k][label - 1]
                        if v > here[label]:
                            here[label], from_[label] = v, (begin[k], at[label][1])
                value.append(here)
                back.append(from_)
            enter.append([max(((value[j][p] + moves[p, label], -p) for p in range(K) if value[j][p] > low), default=(low, 0)) for label in range(K)])
            enter[j] = [(v, -p) for v, p in enter[j]]
        label = enter[n][0][1]  # the end is as an outside token
        out, j = [], n
        while j:
            i, before = back[j][label]
            if label:
                out.append((label, i, j))
            j, label = i, before
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def expected(n: np.ndarray, sentence: np.ndarray, first: np.ndarray, many: np.ndarray, score: np.ndarray, moves: np.ndarray):
    """Forward and backward sums over all labelled segmentations of sentences of n tokens: log Z of each, the
    probability of each span (rows) with each kind, and the expected number of each transition."""
    count, top, longest = len(n), int(n.max()), int(many.max())
    grid = np.full((count, top + 1, longest + 1, K), -np.inf)  # by end and length
    grid[sentence, first + many, many, 1:] = score
    grid[:, 1:, 1, 0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.full((count, top + 1, K), -np.inf)
        alpha[:, 0, 0] = 0.0
        enter = np.full((count, top + 1, K), -np.inf)
        enter[:, 0] = moves[0]
        for j in range(1, top + 1):
            size = min(j, longest)
            alpha[:, j] = _logsum(enter[:, j - size : j][:, ::-1] + grid[:, j, 1 : size + 1], 1)
            enter[:, j] = _logsum(alpha[:, j, :, None] + moves[None], 1)
        log_z = enter[np.arange(count), n, 0]
        # what follows a place, by the label before it
        beta = np.full((count, top + 1, K), -np.inf)
        begin = np.full((count, top + 1, K), -np.inf)  # and by the label that begins there
        for j in range(top, -1, -1):
            rows = [grid[:, j + s, s] + beta[:, j + s] for s in range(1, min(longest, top - j) + 1)]
            if rows:
                begin[:, j] = _logsum(np.stack(rows, axis=1), 1)
                beta[:, j] = _logsum(begin[:, j, None, :] + moves[None], 2)
            done = n == j
            beta[done, j] = moves[:, 0]
        last = np.arange(top + 1)[None] >= n[:, None]
        span = np.exp(enter[sentence, first, 1:] + score + beta[sentence, first + many, 1:] - log_z[sentence][:, None])
        pair = alpha[:, :, :, None] + moves + begin[:, :, None, :] - log_z[:, None, None, None]
        steps = np.where(last[:, :, None, None], 0.0, np.exp(pair)).sum(axis=(0, 1))
        ends = alpha[np.arange(count), n] + moves[:, 0] - log_z[:, None]
        steps[:, 0] += np.exp(ends).sum(axis=0)
    return log_z, span, steps


def _sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated sentence with its entities."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghilmnoprstuvwyz") for _ in range(r.randint(2, 9)))
    any_ = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    low = "abcdefghijklmnopqrstuvwxyz"
    all_ = low + low.upper() + "0123456789"

    def card(sep, size=16):
        s = r.choice("3456") + d(size - 2)
        s += next(c for c in "0123456789" if luhn(s + c))
        return sep.join(s[k : k + 4] for k in range(0, size, 4))

    def email():
        at, dot = r.choice([("@", "."), ("@", "."), ("[at]", "."), ("(at)", "."), (" at ", " dot "), (" [at] ", " [dot] ")])
        name = r.choice([w(), f"{w()}.{w()}", f"{w()}{d(2)}", f"{w()}_{w()}", f"{w()}.{d(2)}", f"{w()}+{w()}"])
        return f"{name}{at}{w()}{r.choice(['', d(1), '-' + w()])}{dot}{r.choice(['com', 'org', 'net', 'de', 'io', 'example'])}"

    makers = {
        "email": email,
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: card(r.choice(["", " ", "-", "."]), r.choice([16, 16, 16, 15, 14])),
        "phone": lambda: r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(6)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
                                   f"1-{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"+{d(2)}-{d(2)}-{d(3)}-{d(4)}"]),
        "secret": lambda: r.choice([any_(r.choice([32, 40, 40, 64, 128]), "0123456789abcdef"), any_(r.randint(20, 44), all_), "AKIA" + any_(16, low.upper() + "0123456789"),
                                    r.choice(["sk-", "ghp_", "sk_live_", "xoxb-"]) + any_(r.randint(20, 40), all_)]),
        "assigned": lambda: r.choice([any_(r.randint(8, 24), all_), w() + w().capitalize() + w().capitalize(), w() + d(r.randint(2, 5)), w() + d(3) + "!"]),
        "account": lambda: r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{any_(2, 'DEFRGBITNLAT')}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"{any_(2, 'DEFRGBITNLAT')}{d(20)}"]),
    }
    noise = [lambda: d(r.randint(1, 6)), lambda: f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(2)}.{d(2)}", lambda: d(8), lambda: d(10),
             lambda: d(12), lambda: f"{d(3)},{d(3)},{d(3)}", lambda: f"{d(1)}.{d(1)}.{d(1)}.{3}{d(3)}", lambda: w() + d(2), lambda: f"@{w()}", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)}",
             lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: "a" * r.randint(16, 40), lambda: "9" + card("")[1:], lambda: d(20), lambda: f"({d(4)})", lambda: f"{w()}_{d(3)}", lambda: f"https://{w()}.{w()}.org/{w()}/{d(5)}",
             lambda: f"{d(4)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(1)}.{d(5)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(2)}%", lambda: f"#{d(4)}", lambda: " ".join(d(r.randint(1, 3)) for _ in range(r.randint(2, 8))),
             lambda: f"{w()}: {w()}", lambda: f"the {r.choice(_SECRET_WORDS)} {w()}", lambda: f"{w()} = {d(r.randint(1, 4))}", lambda: f"{w()}-{d(2)}", lambda: f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
             lambda: " ".join(d(4) for _ in range(r.randint(2, 6))), lambda: any_(r.randint(2, 8), "0123456789abcdef"), lambda: w().upper() + d(3), lambda: f"{w()}{w()}{w()}{w()}"]
    text, spans = "", []
    for _ in range(r.randint(2, 6)):
        pick = r.random()
        if pick < 0.4:
            kind = r.choice(list(makers))
            before, after = r.choice([("", ""), ("", ""), ("(", ")"), ('"', '"'), ("", "."), ("", ","), (": ", "")])
            if kind == "assigned" or kind == "secret" and r.random() < 0.5:
                before = r.choice(_SECRET_WORDS) + r.choice([" = ", ": ", "=", ' = "', ':"', ": '"])
                before, after = (before.upper() if r.random() < 0.2 else before), before[-1] if before[-1] in "\"'" else after if after in ".," else ""
            elif r.random() < 0.4:
                before = r.choice({"email": ["mail ", "contact: "], "ip": ["host ", "server "], "card": ["card ", "visa: "], "phone": ["call ", "tel. ", "phone: "], "account": ["ssn ", "iban: ", "account "]}.get(kind, [""])) + before
            s = makers[kind]()
            spans.append(("secret" if kind == "assigned" else kind, len(text) + len(before), len(text) + len(before) + len(s)))
            text += before + s + after
        else:
            text += (r.choice(noise)() if pick < 0.8 else w()) + r.choice(["", "", ".", ","])
        text += " "
    return text.rstrip(), spans


@cache
def train(sentences: int = 700, rounds: int = 60, seed: int = 11, penalty: float = 0.3) -> Model:
    """Maximum likelihood of generated sentences by adaptive gradient steps."""
    r = random.Random(seed)
    sizes, parts, gold, want = [], [], [], np.zeros((K, K))
    for _ in range(sentences):
        text, spans = _sentence(r)
        for z in zones(text):
            t = Tokens(text, [z])
            first, many, feats = t.spans()
            if not len(first):
                continue
            known = {(int(t.start[i]), int(t.end[i + m - 1])): k for k, (i, m) in enumerate(zip(first.tolist(), many.tolist(), strict=True))}
            label, covered, marks = np.zeros(len(first), np.int64), 0, [0] * len(t.start)
            for kind, a, b in spans:
                if (k := known.get((a, b))) is not None:
                    label[k] = ADDED.index(kind) + 1
                    marks[first[k] : first[k] + many[k]] = [-1] * int(many[k])
                    marks[first[k]] = int(label[k])
            before = 0
            for m in [m for m in marks if m >= 0] + [0]:
                want[before, m] += 1
                before = m
            parts.append((np.full(len(first), len(sizes)), first, many, feats))
            gold.append(label)
            sizes.append(len(t.start))
    sentence, first, many, feats = (np.concatenate(x) for x in zip(*parts, strict=True))
    label, n = np.concatenate(gold), np.array(sizes)
    # sentences of about a length go together
    order = np.argsort(n, kind="stable")
    groups = [g for g in np.array_split(order, 8) if len(g)]
    member = [np.flatnonzero(np.isin(sentence, g)) for g in groups]
    place = np.zeros(len(n), np.int64)
    for g in groups:
        place[g] = np.arange(len(g))
    weights, moves = np.zeros((K - 1, N_FEATURES)), np.zeros((K, K))
    real = np.zeros_like(weights)
    for k in range(1, K):
        np.add.at(real[k - 1], feats[label == k].ravel(), 1.0)
    sums = [np.zeros_like(weights), np.zeros_like(moves)]
    for _ in range(rounds):
        grad, steps = real - penalty * weights, want - penalty * moves
        model = Model(weights, moves)
        for g, m in zip(groups, member, strict=True):
            f = feats[m]
            _, span, taken = expected(n[g], place[sentence[m]], first[m], many[m], model.scores(f), moves)
            steps = steps - taken
            for k in range(K - 1):
                likely = span[:, k] > 1e-6
                grad[k] -= np.bincount(f[likely].ravel(), np.repeat(span[likely, k], f.shape[1]), N_FEATURES)
        for x, s, by in ((weights, sums[0], grad), (moves, sums[1], steps)):
            s += by**2
            x += 0.5 * by / np.sqrt(s + 1e-9)
    return Model(weights, moves)


def added_spans(text: str, model: Model, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    stretches = zones(text)
    if not stretches:
        return []
    return model.decode(text, stretches, sorted(s for spans in base.values() for s in spans))


def find_spans(df: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and all spans (kind, start, end, fixed) of column text, as an array of structs.

    Null text is as empty and gives an empty array. Texts are read whole, at a cost linear in their zones; rows are
    independent, so repeated rows give repeated results and an empty table an empty one. Other columns are left out."""
    model = model or train()
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.moves))

    def make():
        here = Model(*sent.value)

        def one(batch):
            found = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                found.append([{"kind": k, "start": a, "end": b, "fixed": True} for k in KINDS for a, b in base[k]]
                             + [{"kind": k, "start": a, "end": b, "fixed": False} for k, a, b in added_spans(text or "", here, base)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("fixed", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

        return one

    picked = df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"))
    return map_batches(picked, make, "doc_id long, spans array<struct<kind: string, start: long, end: long, fixed: boolean>>")


def span_digests(df: DataFrame, model: Model | None = None) -> DataFrame:
    """The contract's columns from find_spans. Counts are those of the fixed patterns."""
    found = find_spans(df, model)
    fixed = F.filter("spans", lambda s: s["fixed"])
    named = lambda spans: F.array_join(
        F.transform(
            F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, ADDED)), s["kind"]).alias("k"), s["start"], s["end"], s["kind"]))),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )

    def count(kind: str):
        return F.size(F.filter(fixed, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(named(fixed), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["fixed"])).cast("long").alias("n_added"),
        F.size("spans").cast("long").alias("n_spans"),
    )
