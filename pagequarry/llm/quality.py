"""Operator 3: quality by compression against dictionaries of good and of bad text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, by_text, lean, slices
from .labelled import Logistic, fit_logistic, held_out, sample, training_labels, with_labels

#: Texts are compressed in blocks of so many bytes, each against the dictionary, so that long texts count as short ones do.
BLOCK = 1024
DICTIONARY, LEVEL = 32_768, 3
#: The bounds of the fit: rows of each class for the dictionaries and for the curve, and blocks from each row of the former.
DICTIONARY_ROWS, CURVE_ROWS, ROW_BLOCKS = 1500, 4000, 8
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
FEATURES = 4


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, max(len(data), 1), BLOCK)]


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    curve: Logistic | None = None
    #: Whether the curve had rows of both classes to learn from; else it is a constant.
    learnt: bool = True

    def sizes(self) -> Sizes:
        return Sizes(self.good, self.bad)


class Sizes:
    """Compressed sizes of a text as features."""

    def __init__(self, good: bytes, bad: bytes):
        self.against = [_compressor(good), _compressor(bad)]

    def __call__(self, text: str) -> tuple[float, ...]:
        """Log ratio of the sizes against bad and good; both sizes by length; how short the text is. Of a whole text."""
        data = text.encode()
        good, bad = (sum(len(c.compress(b)) for b in _blocks(data)) for c in self.against)
        plain = zstandard.ZstdCompressor(level=1).compress
        whole = sum(len(plain(data[i : i + (1 << 20)])) for i in range(0, max(len(data), 1), 1 << 20))
        n = max(len(data), 1)
        return (float(np.log(bad / good)), min(good / n, 2.0), min(whole / n, 2.0), max(0.0, 1 - len(data) / 200))


def _compressor(dictionary: bytes):
    made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if made:
        made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary; few blocks serve as they are, none give none."""
    size = sum(map(len, blocks))
    if len(blocks) >= 16 and size > 8 * DICTIONARY:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    raw = b"\n".join(blocks)[-DICTIONARY:]
    return b"\n" + raw if len(raw) >= 8 else b""


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> QualityModel:
    """The model: two dictionaries and a curve over compressed sizes.

    Learns from labelled rows outside the held-out fold only: at most ``DICTIONARY_ROWS`` rows a class give at
    most ``ROW_BLOCKS`` blocks each, spread over the whole row, to the dictionaries, and at most ``CURVE_ROWS``
    other rows a class give the curve. Both samples are those of the least hashes, so reruns agree.
    """
    learn = training_labels(labels, "quality", FOLDS, HELD_OUT)
    apart = F.xxhash64(F.col("doc_id"), F.lit("part")) % 2 == 0
    spark = docs.sparkSession

    def rows(some: DataFrame, n: int, salt: str) -> DataFrame:
        return with_labels(docs, sample(some, 0, n, salt).unionAll(sample(some, 1, n, salt)), text)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            y, block = [], []
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                some = _blocks((t or "").encode())
                some = some[:: max(1, -(-len(some) // ROW_BLOCKS))]
                y += [label] * len(some)
                block += some
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(block, pa.binary())], names=["y", "block"])

    blocks = rows(learn.where(apart), DICTIONARY_ROWS, "dictionary").select("text", "y").mapInArrow(cut, "y int, block binary").collect()
    made = [_dictionary(sorted(bytes(b.block) for b in blocks if b.y == y and len(b.block))) for y in (1, 0)]
    model = QualityModel(*made)
    shared = Sent(spark, model)
    found = by_text(rows(learn.where(~apart), CURVE_ROWS, "curve"), _features, [T.StructField("x", T.ArrayType(T.DoubleType()))], "text", ("doc_id", "y"), lambda: shared.value.sizes()).orderBy("doc_id").collect()
    x = np.array([r.x for r in found]).reshape(len(found), FEATURES)
    return QualityModel(*made, fit_logistic(x, np.array([r.y for r in found])), len({r.y for r in found}) == 2)


def _state(model: QualityModel) -> tuple[Sizes, Logistic]:
    return model.sizes(), model.curve


def _features(texts: list[str], sizes: Sizes) -> dict:
    return {"x": [sizes(t) for t in texts]}


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``quality`` (0 to 1) of every whole text; a null text counts as empty and gets what an empty one gets.

    Repeated rows get equal scores; only ``keep`` and the text column are read.
    """
    shared = Sent(docs.sparkSession, model)

    def work(texts: list[str], state: tuple[Sizes, Logistic]) -> dict:
        sizes, curve = state
        return {"quality": curve(np.array([sizes(t) for t in texts])).tolist() if texts else []}

    return by_text(docs, work, [T.StructField("quality", T.DoubleType())], text, keep, lambda: _state(shared.value))


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text scores at least ``threshold``; the columns stay as they are.

    All rows if the model's curve had no rows of both classes to learn from, as its constant tells nothing.
    """
    if not model.learnt:
        return docs
    shared, at = Sent(docs.sparkSession, model), docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        sizes, curve = _state(shared.value)
        for batch in batches:
            for part in slices(batch, at):
                x = np.array([sizes(t or "") for t in part.column(at).to_pylist()]).reshape(-1, FEATURES)
                yield part.filter(pa.array(curve(x) >= threshold, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def scored(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, whether it is held out, its score and its predicted label. Empty tables give no rows or a score of 0.5."""
    found = score(docs, fit(docs, labels, text), text)
    return found.select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), F.col("quality").alias("score"),
        (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"),
    )
