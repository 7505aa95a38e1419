"""Operator 4: toxicity by class-conditional Kneser-Ney models over shared backoff counts.

Texts are read as strings over 32 symbols: white space, the 26 letters (accents off; letters of other scripts are
dealt to them by a hash of the character), digits and marks. So there are at most 2**25 five-grams, whatever the
corpus. Beside them stand whole words of any script, by their true characters, in 2**19 buckets. The counts, gathered
by Spark over every labelled row to learn from, have a proven bound and may be sent to all executors.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE, Sent, by_text, slices, worker_store
from .labelled import Logistic, fit_logistic, held_out, sample, training_labels, with_labels
from .words import mixed, run_hashes

ORDER, BITS = 5, 5
SYMBOLS, GRAMS, CONTEXTS = 1 << BITS, 1 << ORDER * BITS, 1 << (ORDER - 1) * BITS
SPACE, DIGIT, MARK = 0, 27, 28
#: Buckets of whole words; in the table of counts they follow the five-grams.
WORDS = 1 << 19
#: What each word's count in a class gives up to the shared model: words seen less often say nothing of the class.
WORD_DISCOUNT = 2.0
#: The bound of the calibration's fit: labelled rows of each class.
CURVE_ROWS, ASIDE = 6000, 5
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
FEATURES = 8


def _dealt(code):
    """A letter for a letter of another script."""
    return (code * 2654435761 & 0xFFFFFFFF) // 65536 % 26 + 1


def _symbol(c: str) -> int:
    if c.isspace():
        return SPACE
    base = unicodedata.normalize("NFKD", c.lower())[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    return DIGIT if c.isdigit() else _dealt(ord(c)) if c.isalpha() else MARK


class Reader:
    """Texts as five-gram numbers, and as buckets of words (runs of letters)."""

    def __init__(self):
        self.low = np.array([_symbol(chr(i)) if not 0xD800 <= i < 0xE000 else MARK for i in range(0x10000)], np.uint32)

    def symbols(self, code: np.ndarray) -> np.ndarray:
        beyond = np.where((code >= 0x1F000) & (code < 0x20000), MARK, _dealt(code.astype(np.int64)))  # pictures, else letters
        return np.where(code < 0x10000, self.low[np.minimum(code, 0xFFFF)], beyond).astype(np.uint32)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all words, and how many each text has."""
        codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        found, counts = [], np.zeros(len(texts), np.int64)
        start = 0
        while start < len(texts):  # a few texts at a time: positions within one run of sums stay small
            stop, size = start + 1, len(codes[start])
            while stop < len(texts) and size + len(codes[stop]) < PIECE // 4:
                size, stop = size + len(codes[stop]) + 1, stop + 1
            gap = np.zeros(1, np.uint32)
            code = np.concatenate([x for c in codes[start:stop] for x in (c, gap)])
            symbol = self.symbols(code)
            letter = np.concatenate([[False], (symbol >= 1) & (symbol <= 26) & (code > 0), [False]])
            edge = np.flatnonzero(letter[1:] != letter[:-1])
            first, last = edge[::2], edge[1::2]
            found.append(run_hashes(mixed(code.astype(np.uint64)), first, last) % np.uint64(WORDS))
            ends = np.cumsum([len(c) + 1 for c in codes[start:stop]])
            counts[start:stop] = np.diff(np.concatenate([[0], np.searchsorted(first, ends)]))
            start = stop
        return (np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)), counts

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The five-grams that end in each symbol of each text and in the space after it; last symbols; text starts."""
        pad, parts, ends = np.zeros(ORDER - 1, np.uint32), [], []
        for t in texts:
            s = self.symbols(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"))
            parts += [pad, s, pad[:1]]
            ends.append(len(s) + 1)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        s = np.concatenate(parts)
        gram = s[ORDER - 1 :].copy()
        for k in range(1, ORDER):
            gram |= s[ORDER - 1 - k : len(s) - k] << np.uint32(BITS * k)
        n = np.array(ends)
        start = np.concatenate([[0], np.cumsum(n + ORDER - 1)[:-1]])
        own = np.ones(len(gram), bool)
        for k in range(ORDER - 1):  # grams that end in the padding before the next text
            own[(start[1:] - 1 - k)] = False
        return gram[own], s[ORDER - 1 :][own], np.concatenate([[0], np.cumsum(n)[:-1]])


def gram_counts(learn: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary, toxic_rest, ordinary_rest): how often each five-gram stands in the texts of either class,
    and each bucket of words (numbers from ``GRAMS`` on).

    Over all of ``learn`` (text, y, aside), and over its rows that aren't put aside for the curve.
    """
    names = ["gram", "toxic", "ordinary", "toxic_rest", "ordinary_rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            for part in slices(batch, 0, 8 << 20):
                texts, y, aside = (c.to_pylist() for c in part.columns)
                counts = []
                for label, rest in ((1, False), (0, False), (1, True), (0, True)):
                    own = [t for t, k, a in zip(texts, y, aside, strict=True) if t and k == label and not (rest and a)]
                    counts.append(np.unique(np.concatenate([read(own)[0].astype(np.int64), read.words(own)[0] + GRAMS]), return_counts=True))
                seen = np.unique(np.concatenate([g for g, _ in counts]))
                columns = []
                for grams, n in counts:
                    column = np.zeros(len(seen), np.int64)
                    column[np.searchsorted(seen, grams)] = n
                    columns.append(column)
                yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), *map(pa.array, columns)], names=names)

    found = learn.select("text", "y", "aside").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    # Narrow, as the driver takes them: four bytes a number.
    return found.groupBy("gram").agg(*[F.sum(n).cast("float").alias(n) for n in names[1:]]).withColumn("gram", F.col("gram").cast("int"))


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(one / (one + 2 * two), 0.1, 0.95)) if one else 0.5


def _smoothed(counts: np.ndarray, lower: np.ndarray, d: float | None = None) -> np.ndarray:
    """Kneser-Ney probabilities of (contexts, symbols) counts over a lower distribution of the same shape.

    Each count gives up ``d`` (as estimated from rare counts if none is given), all of it if it is less.
    """
    d, total = _discount(counts) if d is None else d, counts.sum(1, keepdims=True)
    safe = np.maximum(total, 1)
    return np.where(total > 0, np.maximum(counts - d, 0) / safe + np.minimum(counts, d).sum(1, keepdims=True) / safe * lower, lower)


@dataclass(frozen=True)
class ToxicityModel:
    """Counts by five-gram, sorted, and the calibration curve."""

    grams: np.ndarray
    toxic: np.ndarray
    ordinary: np.ndarray
    curve: Logistic | None = None

    def ratios(self) -> np.ndarray:
        """log P(symbol | context, toxic) - log P(symbol | context, ordinary) by five-gram; 0 where neither class knows the context.

        Both classes back off to one shared model: five-grams of either class, and below them the number of
        different symbols that stand before each shorter gram.
        """
        lower = np.full((1, SYMBOLS), 1 / SYMBOLS)
        end = np.searchsorted(self.grams, GRAMS)
        grams, toxic, ordinary = self.grams[:end].astype(np.int64), self.toxic[:end], self.ordinary[:end]
        kinds, levels = grams, []
        for k in range(ORDER - 1, 0, -1):  # distinct grams of k symbols after any symbol
            ends = kinds & ((1 << BITS * k) - 1)
            levels.append(np.bincount(ends, minlength=1 << BITS * k).astype(float).reshape(-1, SYMBOLS))
            kinds = np.unique(ends)
        for counts in reversed(levels):  # contexts of k symbols extend those of k - 1 to the left
            lower = _smoothed(counts, np.tile(lower, (counts.shape[0] // lower.shape[0], 1)))
        context = np.unique(grams >> BITS)
        at = np.searchsorted(context, grams >> BITS) * SYMBOLS + (grams & (SYMBOLS - 1))
        table = np.zeros(GRAMS, np.float16)
        for block in range(0, len(context), 1 << 15):
            here = context[block : block + (1 << 15)]
            low, high = np.searchsorted(at, [block * SYMBOLS, (block + len(here)) * SYMBOLS])
            both = []
            for c in (toxic, ordinary):
                counts = np.zeros(len(here) * SYMBOLS)
                counts[at[low:high] - block * SYMBOLS] = c[low:high]
                both.append(counts.reshape(-1, SYMBOLS))
            shared = _smoothed(both[0] + both[1], lower[here & ((1 << BITS * (ORDER - 2)) - 1)])
            ratio = np.log(_smoothed(both[0], shared)) - np.log(_smoothed(both[1], shared))
            table[(here[:, None] << BITS) + np.arange(SYMBOLS)] = ratio
        return table


    def word_ratios(self) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) by bucket; both classes back off to the words of either class."""
        at = np.searchsorted(self.grams, GRAMS)
        both = np.zeros((2, 1, WORDS))
        for counts, c in zip(both, (self.toxic, self.ordinary), strict=True):
            counts[0, self.grams[at:] - GRAMS] = c[at:]
        shared = _smoothed(both.sum(0), np.full((1, WORDS), 1 / WORDS))
        toxic, ordinary = (np.log(_smoothed(c, shared, WORD_DISCOUNT))[0] for c in both)
        return (toxic - ordinary).astype(np.float32)


class Ratios:
    """Features of texts from the log-likelihood ratios of their symbols and words."""

    def __init__(self, model: ToxicityModel):
        self.table, self.word_table, self.read = model.ratios(), model.word_ratios(), Reader()

    def of_words(self, texts: list[str]) -> np.ndarray:
        """For each text: the greatest ratio of a word; the sum of positive parts beyond that of a rare word; the mean ratio."""
        bucket, n = self.read.words(texts)
        ratio = self.word_table[bucket]
        some = np.flatnonzero(n)
        out = np.zeros((len(texts), 3))
        if len(some):
            start = (np.cumsum(n) - n)[some]
            out[some, 0] = np.maximum.reduceat(ratio, start)
            out[some, 1] = np.log1p(np.add.reduceat(np.maximum(ratio - 2, 0), start))
            out[some, 2] = np.add.reduceat(ratio, start) / n[some]
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        """For each text: mean ratio a symbol; the greatest of a word; that of all words, positive parts only, by length and in all; length; and those of whole words."""
        if not texts:
            return np.zeros((0, FEATURES))
        grams, last, start = self.read(texts)
        ratio = self.table[grams].astype(np.float32)
        total = np.add.reduceat(ratio, start)
        n = np.diff(np.append(start, len(grams)))
        begins = np.concatenate([[True], last[:-1] == SPACE])
        begins[start] = True
        first = np.flatnonzero(begins)
        word = np.add.reduceat(ratio, first)
        of = np.searchsorted(first, start)
        high = np.maximum(word - 3, 0)
        over = np.add.reduceat(high, of)
        words = np.diff(np.append(of, len(word)))
        return np.c_[total / n, np.maximum.reduceat(word, of), over / words, np.log1p(over), np.log(n), self.of_words(texts)].astype(float)


def _worker_ratios(shared) -> Ratios:
    kept = worker_store("toxicity")
    if shared.name not in kept:
        kept.clear()
        kept[shared.name] = Ratios(shared.value)
    return kept[shared.name]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> ToxicityModel:
    """The model: counts over all labelled rows outside the held-out fold, and a curve from a sample of them.

    The curve is fitted on rows put aside (one in ``ASIDE``, by hash), at most ``CURVE_ROWS`` a class, scored by
    counts without them; after that the model takes the counts of all rows. Reruns agree.
    """
    learn = training_labels(labels, "toxic", FOLDS, HELD_OUT).withColumn("aside", F.xxhash64("doc_id", F.lit("part")) % ASIDE == 0)
    counts = gram_counts(with_labels(docs, learn, text)).toArrow()
    order = np.argsort(counts.column("gram").to_numpy())
    grams, *by = (c.to_numpy()[order] for c in counts.columns)
    del counts, order
    known = by[2] + by[3] > 0
    rest = Sent(docs.sparkSession, ToxicityModel(grams[known], by[2][known], by[3][known]))
    some = sample(learn.where("aside"), 0, CURVE_ROWS, "curve").unionAll(sample(learn.where("aside"), 1, CURVE_ROWS, "curve"))
    found = by_text(with_labels(docs, some, text), _features, [T.StructField("x", T.ArrayType(T.DoubleType()))], "text", ("doc_id", "y"), lambda: _worker_ratios(rest)).orderBy("doc_id").collect()
    x = np.array([r.x for r in found]).reshape(len(found), FEATURES)
    return ToxicityModel(grams, by[0], by[1], fit_logistic(x, np.array([r.y for r in found])))


def _features(texts: list[str], ratios: Ratios) -> dict:
    return {"x": ratios(texts).tolist()}


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``toxicity`` (0 to 1) of every whole text; a null text counts as empty and gets what an empty one gets.

    Repeated rows get equal scores; only ``keep`` and the text column are read.
    """
    shared, curve = Sent(docs.sparkSession, model), model.curve

    def work(texts: list[str], ratios: Ratios) -> dict:
        return {"toxicity": curve(ratios(texts)).tolist()}

    return by_text(docs, work, [T.StructField("toxicity", T.DoubleType())], text, keep, lambda: _worker_ratios(shared))


def scored(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, whether it is held out, its score and its predicted label. Empty tables give no rows or a score of 0.5."""
    found = score(docs, fit(docs, labels, text), text)
    return found.select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
