"""Operator 12: personal data in texts, by rules and by a linear-chain conditional random field over word shapes.

The base rules find what has the usual form. The random field finds what is written another way: addresses with
"(at)" and "dot", numbers without a country code or with other separators. Words become classes of shape (case,
length, sign, glued to the word before); the scores of a label are sums over the classes around a word, those of a
sequence add the steps from label to label. It is trained by its likelihood on a small labelled table, with gradients
from forward and backward passes, and decoded by Viterbi's rule, many chains at once in numpy.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, by_text, worker_store

# The kinds in order, and what the base rules look for. Quantifiers that can't give back keep each rule
# linear in the text; a run of digits or letters is tried once, from where it starts.
KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_NO_DIGIT = re.compile(r"[^0-9]")

#: Rows of the labelled table that are used at most, rounds of training, its pace and how strongly weights are held small.
MOST_LABELLED, STEPS, PACE, HOLD = 5_000, 60, 0.3, 0.02
#: Classes of words before and after a word that count for its label.
AROUND = 3
#: Characters around a cue that belong to its chain, and how far a chain may reach to end at white space.
REACH, STRETCH = 48, 24
#: Words (with padding) decoded together.
TOGETHER = 100_000

LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
#: Chains stand around these: a digit, a sign or word for "at".
CUE = re.compile(r"[0-9]+|@|[\[({<]\s?(?:at|AT)\s?[\])}>]|(?<=\s)(?:at|AT)(?=\s[^\n]{1,60}?\s(?:dot|DOT)\s)")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
#: Words with a class of their own.
NAMED = frozenset("at dot com org net edu de fr es io mail email tel phone call fax mobile card visa pay ip host server version page isbn date no nr".split())


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return _NO_DIGIT.sub("", s)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Leftmost matches: the local part is the run of its characters before an @, from where the last match ended."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done:  # back in steps, to the last character that can't be in a local part
            step = max(done, start - 64)
            stop = None
            for stop in _NO_LOCAL.finditer(text, step, start):
                pass
            if stop:
                start = stop.end()
                break
            start = step
        domain = DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            yield start, domain.end(), "email"
        done = domain.end() if domain else sign + 1
        sign = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules in code points, by start and then kind."""
    out = list(_emails(text))
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and _is_card(_digits(m[0])):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def chains(text: str) -> list[tuple[int, int]]:
    """The stretches of text around cues, joined where they touch."""
    out: list[list[int]] = []
    for m in CUE.finditer(text):
        if out and m.end() + REACH <= out[-1][1]:
            continue
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if lo:
            at = [k for k in range(max(0, lo - STRETCH), lo + 1) if text[k].isspace()]
            lo = at[-1] if at else max(0, lo - STRETCH)
        if hi < len(text):
            at = next((k for k in range(hi, min(len(text), hi + STRETCH)) if text[k].isspace()), None)
            hi = min(len(text), hi + STRETCH) if at is None else at
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _length(n: int) -> str:
    return str(n) if n <= 3 else "4" if n <= 7 else "8"


def shape(word: str, glued: bool) -> str:
    """The class of a word: sort of characters, length, and ``~`` if no space stands before it."""
    if "0" <= word[0] <= "9":
        n = len(word)
        kind = f"d{n if n <= 7 else 8 if n <= 11 else 12 if n <= 15 else n if n <= 17 else 18 if n <= 19 else 20}"
    elif word.isalpha():
        low = word.lower()
        if low in NAMED:
            kind = f"w:{low}"
        else:
            kind = ("x" if word == low else "Xx" if word[0] != low[0] and word[1:] == low[1:] else "X" if word == word.upper() else "xX") + _length(len(word))
    else:
        kind = f"p:{word}" if word < "\x7f" else "p:"
    return kind + ("~" if glued else "")


def words(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, start, end)]


def shapes(text: str, spans: list[tuple[int, int]], kept: dict | None = None) -> list[str]:
    out, before = [], -1
    kept = {} if kept is None else kept
    for a, b in spans:
        key = (text[a:b] if b - a <= 20 else text[a : a + 20], b - a, a == before)
        s = kept.get(key)
        if s is None:
            if len(kept) > 50_000:
                kept.clear()
            s = kept[key] = shape(text[a:b], a == before)
        out.append(s)
        before = b
    return out


class Field:
    """The random field: ``near[offset]`` scores labels by the class at an offset, ``pair`` by two classes side by side, ``step`` from label to label."""

    PAIRS = 4096

    def __init__(self, names: list[str]):
        self.number = {s: i + 2 for i, s in enumerate(sorted(set(names)))}  # 0: outside the chain, 1: unknown
        k = len(LABELS)
        self.near = np.zeros((2 * AROUND + 1, len(self.number) + 2, k))
        self.pair = np.zeros((self.PAIRS, k))
        self.step = np.zeros((k + 1, k))  # the last row: at the start of a chain
        self.barred = np.array([[b.startswith("I") and (a == "start" or a[2:] != b[2:]) for b in LABELS] for a in (*LABELS, "start")])

    def classes(self, names: list[str]) -> np.ndarray:
        return np.array([self.number.get(s, 1) for s in names], np.int64)

    def _features(self, x: np.ndarray) -> list[np.ndarray]:
        wide = np.pad(x, ((0, 0), (AROUND, AROUND)))
        near = [wide[:, o : o + x.shape[1]] for o in range(2 * AROUND + 1)]
        left = near[AROUND - 1]
        return [*near, (left * 8191 + x * 131) % self.PAIRS]

    def scores(self, x: np.ndarray) -> np.ndarray:
        *near, pair = self._features(x)
        out = self.pair[pair]
        for weights, at in zip(self.near, near, strict=True):
            out += weights[at]
        return out

    def _steps(self) -> np.ndarray:
        return np.where(self.barred, -1e9, self.step)

    def likelihood(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The log likelihood of the labels ``y`` of padded chains of ``n`` words, and its gradient."""
        rows, length = x.shape
        k, e, step = len(LABELS), self.scores(x), self._steps()
        real = np.arange(length)[None] < n[:, None]
        ahead = np.zeros((rows, length, k))
        ahead[:, 0] = step[k] + e[:, 0]
        for t in range(1, length):
            new = _logsum(ahead[:, t - 1, :, None] + step[None, :k], 1) + e[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        total = _logsum(ahead[:, -1], 1)
        back, both = np.zeros((rows, length, k)), np.zeros((k + 1, k))
        for t in range(length - 2, -1, -1):
            after = (e[:, t + 1] + back[:, t + 1])[:, None, :] + step[None, :k]
            back[:, t] = np.where(real[:, t + 1, None], _logsum(after, 2), 0)
            both[:k] += (np.exp(ahead[:, t, :, None] + after - total[:, None, None]) * real[:, t + 1, None, None]).sum(0)
        expected = np.exp(ahead + back - total[:, None, None]) * real[..., None]
        both[k] = expected[:, 0].sum(0)
        truth = np.eye(k)[y] * real[..., None]
        seen = np.zeros((k + 1, k))
        np.add.at(seen, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
        np.add.at(seen, (np.full(rows, k), y[:, 0]), 1)
        value = (e * truth).sum() + (np.where(self.barred, 0, self.step) * seen).sum() - total.sum()
        *near, pair = self._features(x)
        differ = (truth - expected)[real]
        near_sums = np.stack([_summed(at[real], differ, self.near.shape[1]) for at in near])
        return float(value), {"near": near_sums, "pair": _summed(pair[real], differ, self.PAIRS), "step": np.where(self.barred, 0, seen - both)}

    def train(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[float]:
        """Climbs the held likelihood by AdaGrad; its value a step."""
        values, past = [], {w: np.full_like(getattr(self, w), 1e-6) for w in ("near", "pair", "step")}
        like = [(x[rows, : n[rows].max()], y[rows, : n[rows].max()], n[rows]) for rows in np.array_split(np.argsort(n, kind="stable"), 8) if len(rows)]
        for _ in range(STEPS):
            found = [self.likelihood(*part) for part in like]
            value = sum(v for v, _ in found)
            for w in past:
                g = sum(part[w] for _, part in found)
                weight = getattr(self, w)
                value -= HOLD / 2 * float((weight * weight).sum())
                g = g - HOLD * weight
                past[w] += g * g
                setattr(self, w, weight + PACE * g / np.sqrt(past[w]))
            values.append(value)
        return values

    def decode(self, chains_: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each chain (Viterbi; of equal paths that of smaller labels), in batches of chains of like length."""
        out: list = [None] * len(chains_)
        order = sorted(range(len(chains_)), key=lambda i: len(chains_[i]))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and len(chains_[order[stop]]) * (stop + 1 - start) <= TOGETHER:
                stop += 1
            for i, found in zip(order[start:stop], self._best([chains_[i] for i in order[start:stop]]), strict=True):
                out[i] = found
            start = stop
        return out

    def _best(self, chains_: list[np.ndarray]) -> list[np.ndarray]:
        n = np.array([len(c) for c in chains_])
        length = int(n.max(initial=0))
        if not length:
            return [np.zeros(0, np.int64) for _ in chains_]
        x = np.zeros((len(n), length), np.int64)
        for i, c in enumerate(chains_):
            x[i, : len(c)] = c
        e, step, k = self.scores(x), self._steps(), len(LABELS)
        came = np.zeros((length, len(n), k), np.uint8)
        now = step[k] + e[:, 0]
        same = np.arange(k, dtype=np.uint8)
        for t in range(1, length):
            paths = now[:, :, None] + step[None, :k]
            going = (t < n)[:, None]
            came[t] = np.where(going, paths.argmax(1), same)
            now = np.where(going, paths.max(1) + e[:, t], now)
        label = np.zeros((len(n), length), np.int64)
        label[:, -1] = now.argmax(1)
        rows = np.arange(len(n))
        for t in range(length - 1, 0, -1):
            label[:, t - 1] = came[t][rows, label[:, t]]
        return [row[:m] for row, m in zip(label, n, strict=True)]


def _summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sums of ``rows`` by number."""
    k = rows.shape[1]
    return np.bincount((at[:, None] * k + np.arange(k)).ravel(), rows.ravel(), size * k).reshape(size, k)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def labelled_spans(labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(first word, word after the last, kind) of a label sequence."""
    out: list[list] = []
    for i, j in enumerate(labels):
        name = LABELS[j]
        if name[0] == "B":
            out.append([i, i + 1, name[2:]])
        elif name[0] == "I":
            out[-1][1] = i + 1
    return [(a, b, k) for a, b, k in out]


def fit(labelled: DataFrame) -> Field:
    """A field trained on a small table (text, spans as ``kind:start:end`` comma-joined); at most ``MOST_LABELLED`` rows, of the least digests.

    An empty table gives a field that labels nothing.
    """
    rows = labelled.select("text", "spans").where("text is not null").orderBy(F.xxhash64("text"), "text", "spans").limit(MOST_LABELLED).collect()
    return fit_rows([(r.text, r.spans or "") for r in rows])


def fit_rows(rows: list[tuple[str, str]]) -> Field:
    names, labels = [], []
    for text, spans in rows:
        own = words(text, 0, len(text))
        if not own:
            continue
        marked = np.zeros(len(own), np.int64)
        for span in filter(None, spans.split(",")):
            kind, start, end = span.split(":")
            inside = [i for i, (a, b) in enumerate(own) if a >= int(start) and b <= int(end)]
            marked[inside] = LABELS.index(f"I-{kind}")
            marked[inside[:1]] = LABELS.index(f"B-{kind}")
        names.append(shapes(text, own))
        labels.append(marked)
    field = Field([s for row in names for s in row])
    if names:
        length = max(map(len, names))
        x, y = np.zeros((len(names), length), np.int64), np.zeros((len(names), length), np.int64)
        for i, (s, m) in enumerate(zip(names, labels, strict=True)):
            x[i, : len(s)], y[i, : len(m)] = field.classes(s), m
        field.train(x, y, np.array(list(map(len, names))))
    return field


def _sound(kind: str, s: str) -> bool:
    """Whether a found span can be what its label says."""
    if kind == "email":
        return len(s) <= 200 and bool(re.search(r"(?i)[a-z0-9]\W*(?:@|\bat\b)\W*[a-z0-9].*?(?:\.|\bdot\b)\W*[a-z]", s, re.S))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(_byte(p) for p in parts) and re.search(r"[A-CE-NP-SU-Za-ce-np-su-z]", s) is None
    return _is_card(_digits(s)) if kind == "card" else 9 <= len(_digits(s)) <= 15


def _covered(start: int, end: int, spans: list[tuple[int, int, str]], at: int) -> tuple[bool, int]:
    """Whether one of the spans (by start) holds the stretch; ``at`` is moved past those that end before it."""
    while at < len(spans) and spans[at][1] <= start:
        at += 1
    k = at
    while k < len(spans) and spans[k][0] <= start:
        if spans[k][1] >= end:
            return True, at
        k += 1
    return False, at


def find_personal(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """Base spans and all spans of each text: what the field finds stands beside the base spans unless one holds it."""
    kept = worker_store("shapes")
    base = [base_spans(t) for t in texts]
    where = [(i, words(t, a, b)) for i, t in enumerate(texts) for a, b in chains(t)]
    decoded = field.decode([field.classes(shapes(texts[i], own, kept)) for i, own in where])
    more: list[list] = [[] for _ in texts]
    at = [0] * len(texts)
    for (i, own), labels in zip(where, decoded, strict=True):
        if not labels.any():
            continue
        for first, last, kind in labelled_spans(labels):
            start, end = own[first][0], own[last - 1][1]
            held, at[i] = _covered(start, end, base[i], at[i])
            if not held and _sound(kind, texts[i][start:end]):
                more[i].append((start, end, kind))
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return [(b, sorted(b + m, key=order) if m else b) for b, m in zip(base, more, strict=True)]


def named(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def personal_spans(docs: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Personal data in every whole text: base counts by kind, ``base`` and ``spans`` (``kind:start:end``, comma-joined).

    Base rules find e-mail and IP addresses, card numbers that pass Luhn's test and international phone numbers. The
    field adds spans of the same kinds in other forms, checked for what must hold (parts up to 255, Luhn's test, 9 to
    15 digits); one that a base span holds isn't repeated. A null text counts as empty: no spans, counts 0. Repeated
    rows give repeated results; only ``keep`` and the text column are read, so other columns of whatever name don't
    matter. The cost is linear in a text, whatever it holds; chains reach as far as cues go on.
    """
    sent = Sent(docs.sparkSession, field)

    def work(texts: list[str], model: Field) -> dict:
        found = find_personal(texts, model)
        counts = {f"n_{k}": [sum(x[2] == k for x in base) for base, _ in found] for k in KINDS}
        return counts | {"base": [named(base) for base, _ in found], "spans": [named(all_) for _, all_ in found]}

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(n, T.StringType()) for n in ("base", "spans")]
    return by_text(docs, work, fields, text, keep, state=lambda: sent.value)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's rows."""
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


# The labelled table: sentences made by rule from a few patterns of each form, and from numbers that are no personal data.
_FORMS = {
    "email": ("{u}@{h}.{t}", "{u}@{h}.{h}.{t}", "{u} (at) {h}.{t}", "{u} [at] {h} [dot] {t}", "{u} at {h} dot {t}", "{u} at {h} dot {h} dot {t}", "{u} @ {h} . {t}", "{u}(at){h}.{t}", "{u}[at]{h}[dot]{t}", "{u} (at) {h} (dot) {t}", "{u}@{h} dot {t}", "{u} at {h}.{h} dot {t}"),
    "phone": ("+{1} ({3}) {3}-{4}", "+{2} {3} {7}", "({3}) {3}-{4}", "{3}-{3}-{4}", "{3}.{3}.{4}", "({3}) {3} {4}", "({3}){3}-{4}", "+{2}/{3}/{7}", "00{2} {3} {7}", "({3}) {3}.{4}", "{1}-{3}-{3}-{4}", "tel {3} {3} {4}"),
    "ip": ("{b}.{b}.{b}.{b}", "{b}[.]{b}[.]{b}[.]{b}", "{b} . {b} . {b} . {b}", "{b}(.){b}(.){b}(.){b}", "{b}.{b}.{b}[.]{b}", "{b}[dot]{b}[dot]{b}[dot]{b}"),
    "card": ("{4}{4}{4}{4}", "{4} {4} {4} {4}", "{4}-{4}-{4}-{4}", "{4}.{4}.{4}.{4}", "{4}/{4}/{4}/{4}", "{4}_{4}_{4}_{4}", "{4}  {4}  {4}  {4}", "{4} - {4} - {4} - {4}"),
}
_NONE = (
    "20{2}-0{d}-1{d}", "1{d}.0{d}.20{2}", "1{d}:{2}:{2}", "{3},{3}.{2}", "{1}.{2}.{1}", "version {1}.{1}", "BY-NC {1}.0.", "{2}", "{3}", "{4}", "{5}", "{6}", "{8}", "{13}", "{2}%", "isbn 978-{1}-{2}-{6}-{1}", "page {3}-{3}", "no {5}",
    "token = \"{x}\"", "{x}", "${3}.{2}", "{3} {3}", "{2} {2} {2}", "{4} {4}", "{d}/{d}", "{2}/{2}/20{2}", "({1})", "({3})", "[{2}]", "{3}-{2}", "at {2}", "{l} at {l} {l}", "{l} (at) {l}", "at {4} {l}", "@{l}", "{l}@", "{20}", "{24}", "{1},{2},{3},{2}", "{1} {1} {1} {1}", "{1}. {1}. {1}.", "{5}-{4}", "{2}:{2}", "{l}{2}", "{l}{4}", "{3} x {3}",
)


def _filled(form: str, r: random.Random) -> str:
    letters = lambda lo, hi: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(lo, hi)))

    def one(m: re.Match) -> str:
        key = m[1]
        if key.isdigit():
            return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(int(key) - 1))
        if key == "u":
            return r.choice((letters(3, 8), f"{letters(2, 7)}.{letters(3, 8)}", f"{letters(3, 7)}{r.randint(1, 99)}", f"{letters(2, 9)}.{r.randint(10, 99)}", f"{letters(2, 5)}_{letters(3, 6)}", letters(3, 6).title()))
        if key == "h":
            return r.choice((letters(3, 9), f"{letters(3, 5)}{r.randint(1, 9)}", f"{letters(3, 6)}-{letters(3, 6)}"))
        return {"t": lambda: r.choice(("com", "org", "net", "de", "fr", "es", "io")), "b": lambda: str(r.randint(0, 255)), "d": lambda: str(r.randint(1, 9)), "x": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 32, 40)))), "l": lambda: letters(1, 9)}[key]()

    return re.sub(r"\{(\w+)\}", one, form)


def labelled_rows(each: int = 10, seed: int = 1) -> list[tuple[str, str]]:
    """A small labelled table by rule: ``each`` sentences of every form of personal data and of every form of other numbers."""
    r = random.Random(seed)
    cue = {"email": ("mail", "email"), "phone": ("tel", "phone", "call"), "ip": ("ip", "host"), "card": ("card", "visa", "pay")}

    def filler(n: int) -> list[str]:
        out = []
        for _ in range(n):
            w = _filled("{l}", r)
            w = r.choice((w, w, w, w, w.title(), w.upper(), w + "ä"))
            out.append(w + r.choice(("", "", "", "", "", ",", ".", "!!", "%%%", "&&&", "***", "$$$", "###", " |", ":")))
        return out

    rows = []
    forms = [(k, f) for k, fs in _FORMS.items() for f in fs] + [("", f) for f in _NONE]
    for kind, form in forms:
        for _ in range(each):
            left, right = filler(r.randint(0, 6)), filler(r.randint(0, 6))
            if kind and r.random() < 0.25:
                left.append(r.choice(cue[kind]) + r.choice(("", ":", ".")))
            if r.random() < 0.15:
                (left if r.random() < 0.5 else right).append(_filled(r.choice(_NONE), r))
            core = _filled(form, r)
            start = len(" ".join([*left, ""]))
            skip = 4 if core.startswith("tel ") else 0
            text = " ".join([*left, core + r.choice(("", "", ".", ",", "!!", "&&&", "###", ")")), *right])
            rows.append((text, f"{kind}:{start + skip}:{start + len(core)}" if kind else ""))
    return rows


def labelled_table(spark: SparkSession, each: int = 10, seed: int = 1) -> DataFrame:
    return spark.createDataFrame(labelled_rows(each, seed), "text string, spans string")
