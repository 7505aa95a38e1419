"""Scores of masks, images and settings, and fitting the detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import quantiles_by_index

#: Settings of a sweep packed into one row, and how many may be broadcast.
SETTINGS_A_ROW, MOST_BROADCAST = 1000, 100_000


def _share(part, whole):
    """Mask scores divide by at least 1, so that an empty class scores 0."""
    return part / F.greatest(whole, F.lit(1))


def mask_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Recall, share of false positives and intersection over union of boolean ``pred`` and ``truth``."""
    p, t = F.col("pred"), F.col("truth")
    return rows.groupBy(*keys).agg(
        F.bround(_share(F.count_if(p & t), F.count_if(t)), 4).alias("recall"),
        F.bround(_share(F.count_if(p & ~t), F.count_if(~t)), 4).alias("false_positive_share"),
        F.bround(_share(F.count_if(p & t), F.count_if(p | t)), 4).alias("iou"),
    )


def pooled_rates(rows: DataFrame, key: str) -> DataFrame:
    """Recall, false alarms and glare share per ``key`` and pooled (null key), over ``pred`` and ``label`` (1, 0, null)."""
    p, g, c = F.col("pred"), F.col("label") == 1, F.col("label") == 0
    ng, nc = F.count_if(g), F.count_if(c)
    return rows.rollup(key).agg(_share(F.count_if(p & g), ng).alias("recall"), _share(F.count_if(p & c), nc).alias("false_alarms"), _share(ng, ng + nc).alias("glare_share"))


def split_samples(samples: DataFrame, split: DataFrame, key: str = "page", default: str = "train") -> DataFrame:
    """``samples`` with the ``split`` of their page; a page that ``split`` (key, split) doesn't name goes to ``default``.

    Whole pages are split, never single shots, so no page is on both sides.
    """
    return samples.join(split.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit(default)))


def residual_detection(cells: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Detected share of truly glared cells and false share of clean ones; ``truth`` is the share of glare in a cell."""
    det = F.col("residual") >= threshold
    t, c = F.col("truth") > 0.5, F.col("truth") < 0.01
    return cells.groupBy(*keys).agg(_share(F.count_if(det & t), F.count_if(t)).alias("recall"), _share(F.count_if(det & c), F.count_if(c)).alias("false_share"))


def setting_report(cases: DataFrame, keys: list[str], deep: float = 0.35) -> DataFrame:
    """Per setting, group and shot count: mean, least and worst scores, and how many deep shadows were found."""
    is_deep = F.col("depth") >= deep
    return cases.groupBy(*keys).agg(
        F.avg("recall").alias("recall"), F.min("recall").alias("least_recall"), F.max("false").alias("worst_false"), F.avg("error").alias("error"), F.max("error").alias("worst_error"),
        F.count_if(is_deep & (F.col("found") >= 0.5)).alias("deep_found"), F.count_if(is_deep).alias("deep"), F.count_if(F.col("changed")).alias("changed"), F.count_if(F.col("reported")).alias("reported"),
    )


def sweep(cases: DataFrame, settings: DataFrame, score, keys: list[str]) -> DataFrame:
    """Every case under every setting, scored by ``score`` (DataFrame to DataFrame) in one pass and reported.

    Settings are packed into rows of about ``SETTINGS_A_ROW``. A case meets each of those rows once and is repeated
    for its settings in place. The rows are broadcast while there are few settings; any number works.
    """
    names = settings.columns
    n = settings.count()
    blocks = max(1, -(-n // SETTINGS_A_ROW))
    packed = settings.withColumn("_block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")).groupBy("_block").agg(F.collect_list(F.struct(*names)).alias("_settings"))
    sent = cases.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tried = sent.join(F.broadcast(packed) if n <= MOST_BROADCAST else packed, "_block").withColumn("_s", F.explode("_settings"))
    return setting_report(score(tried.select(*cases.columns, *[F.col(f"_s.{c}").alias(c) for c in names])), [*names, *keys])


def image_error(cells: DataFrame, keys: list[str], strip=None) -> DataFrame:
    """Error of an image against its truth after one gain per channel.

    ``cells`` has a_b, a_g, a_r (image) and t_b, t_g, t_r (truth); ``strip``,
    a condition, splits the error into the strip and the rest.
    """
    c3 = ("b", "g", "r")
    gains = cells.groupBy(*keys).agg(*[(F.sum(F.col(f"a_{c}") * F.col(f"t_{c}")) / F.greatest(F.sum(F.col(f"a_{c}") * F.col(f"a_{c}")), F.lit(1))).alias(f"gain_{c}") for c in c3])
    j = cells.join(gains, keys)
    for c in c3:
        j = j.withColumn(f"m_{c}", F.col(f"a_{c}") * F.col(f"gain_{c}"))
    err = sum((F.abs(F.col(f"m_{c}") - F.col(f"t_{c}")) for c in c3[1:]), F.abs(F.col("m_b") - F.col("t_b"))) / 3
    brighter = (F.col("m_b") + F.col("m_g") + F.col("m_r") - F.col("t_b") - F.col("t_g") - F.col("t_r")) / 3
    cond = F.lit(False) if strip is None else strip
    return j.groupBy(*keys).agg(F.avg(err).alias("mae"), F.avg((brighter > 35).cast("int")).alias("glare_share"), F.avg(F.when(cond, err)).alias("strip_mae"), F.avg(F.when(~cond, err)).alias("rest_mae"))


def residual_truth(cells: DataFrame, keys: list[str], levels: float = 20) -> DataFrame:
    """Cells at least ``levels`` brighter than the truth after a robust gain: the median ratio per channel."""
    c3 = ("b", "g", "r")
    ok = cells.filter((F.least(*[F.col(f"a_{c}") for c in c3]) > 5) & (F.least(*[F.col(f"t_{c}") for c in c3]) > 5))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.round(F.col(f"t_{c}") / F.col(f"a_{c}"), 9).alias("ratio")) for c in c3]))
    ratios = ok.select(*keys, each.alias("e")).select(*keys, "e.ch", "e.ratio")
    # Halfway between the two middle values, each found by rank, so one large page does not fill one task.
    census = cells.select(*keys, F.explode(F.array(*[F.lit(c) for c in c3])).alias("ch"))
    middle = {"lo": F.floor((F.col("_n") - 1) / 2), "hi": F.floor(F.col("_n") / 2)}
    gain = quantiles_by_index(ratios, [*keys, "ch"], "ratio", middle, census=census).groupBy(*keys).agg(*[F.max(F.when(F.col("ch") == c, (F.col("lo") + F.col("hi")) / 2)).alias(f"gain_{c}") for c in c3])
    j = cells.join(gain, keys)
    diff = sum((F.col(f"a_{c}") * F.col(f"gain_{c}") - F.col(f"t_{c}") for c in c3[1:]), F.col("a_b") * F.col("gain_b") - F.col("t_b")) / 3
    return j.filter(diff >= levels).select(*keys, "y", "x")


def fit_logistic(samples: DataFrame, features: list[str], clean_weight: float = 30.0, l2: float = 1e-3) -> dict[str, float]:
    """Class-weighted logistic fit with weights held at 0 or above: the intercept and one weight per feature.

    Each class weighs the same in total, the clean one ``clean_weight`` times
    as much, and all weights add up to the number of rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices

    n1, n = samples.agg(F.sum(F.col("label").cast("double")), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("no samples to fit")
    pos, neg = 1 / max(n1 or 0.0, 1.0), clean_weight / max(n - (n1 or 0.0), 1.0)
    scale = n / ((n1 or 0.0) * pos + (n - (n1 or 0.0)) * neg)
    weighted = samples.select(F.col("label").cast("double").alias("label"), *features, F.when(F.col("label") == 1, pos * scale).otherwise(neg * scale).alias("w"))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(weighted)
    lr = LogisticRegression(
        weightCol="w", regParam=l2 / n, standardization=False, maxIter=200, tol=1e-9, lowerBoundsOnCoefficients=Matrices.dense(1, len(features), [0.0] * len(features))
    )
    model = lr.fit(rows)
    return {"bias": float(model.intercept), **{f: float(w) for f, w in zip(features, model.coefficients)}}
