"""Quality classifier: regularised quadratic discriminant analysis of document statistics (operator 8)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_texts
from .quality_rules import dup_lines, repeat_words

FEATURES = ("log_words", "log_word_length", "symbols", "upper", "digits", "shouts", "stops", "variety", "repeats", "dup_lines",
            "log_ratio", "bare_words", "short_words", "log_line_length")
#: Shares of the pooled covariance and of its diagonal in each class's covariance, the shares that make the fewest errors on the rows learnt from.
POOL, RIDGE = 0.6, 0.1
#: Bound of the log-density difference, so that scores stay inside (0, 1).
MOST_LOGIT = 30.0

_UPPER, _DIGITS, _SYMBOLS = bytes(range(65, 91)), b"0123456789", b"#*$%&|<>"
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


def document_statistics(text: bytes | None, zstd: zstandard.ZstdCompressor) -> tuple[float, ...]:
    """The transformed statistics of one text, in the order of ``FEATURES``; all zero for an empty or null text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    size = sum(map(len, words))
    share = lambda chars: math.sqrt((len(text) - len(text.translate(None, chars))) / size)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        math.log1p(n), math.log(size / n), share(_SYMBOLS), share(_UPPER), share(_DIGITS), share(b"!?"), share(b".,;:"),
        math.log1p(len(set(words))) / math.log1p(n), math.sqrt(repeat_words(words) / n), math.sqrt(dup_lines(text) / max(1, len(lines))),
        math.log(len(text) / len(zstd.compress(text))), math.sqrt(sum(not w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in words) / n),
        sum(len(w) <= 3 for w in words) / n, math.log1p(size / len(lines)),
    )


def _factory():
    zstd = zstandard.ZstdCompressor(level=1)
    return lambda texts: dict(zip(FEATURES, map(list, zip(*(document_statistics(t, zstd) for t in texts), strict=True)), strict=True))


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return map_texts(docs, _factory, keep, ", ".join(f"{f} double" for f in FEATURES), text=text)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the ids whose labels are never learnt from; a null id is not held out, but has no label either."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


@dataclass(frozen=True)
class Gaussian:
    """A class: log prior less half the log determinant, mean, and the inverse of the covariance's Cholesky factor."""

    offset: float
    mean: np.ndarray
    whiten: np.ndarray

    def log_density(self) -> Column:
        x = [F.col(f) - F.lit(float(m)) for f, m in zip(FEATURES, self.mean, strict=True)]
        total = F.lit(float(self.offset))
        for row in range(len(x)):
            z = sum((x[k] * F.lit(float(self.whiten[row, k])) for k in range(1, row + 1)), x[0] * F.lit(float(self.whiten[row, 0])))
            total = total - F.lit(0.5) * z * z
        return total


def fit(stats: DataFrame, labels: DataFrame) -> tuple[float, Gaussian | None, Gaussian | None]:
    """Prior of label 1 and the two classes, from all labelled rows that are not held out.

    One aggregation gathers the counts, sums and products of both classes (two rows reach the driver, whatever the input);
    the Cholesky factors are made once from them. Repeated labels of a document count once, by majority; ids or labels that
    are null count not at all. With a class of fewer than two rows there are no densities, and the prior alone is the score.
    """
    d = len(FEATURES)
    one = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
           .agg((F.avg(F.col("quality").cast("double")) >= 0.5).alias("good")).where(~held_out()))
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = {r["good"]: r for r in stats.where(F.col("doc_id").isNotNull()).join(one, "doc_id").groupBy("good").agg(*sums).collect()}
    n = {g: rows[g]["n"] if g in rows else 0 for g in (False, True)}
    prior = n[True] / sum(n.values()) if sum(n.values()) else 0.5
    if min(n.values()) < 2:
        return prior, None, None
    mean, cov = {}, {}
    for g, r in rows.items():
        mean[g] = np.array([r[f"s{i}"] for i in range(d)]) / n[g]
        second = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / n[g]
        cov[g] = second - np.outer(mean[g], mean[g])
    pooled = sum(n[g] * cov[g] for g in rows) / sum(n.values())
    spread = np.diag(np.diag(pooled) + 1e-4)
    made = []
    for g in (True, False):
        c = (1 - RIDGE) * ((1 - POOL) * cov[g] + POOL * pooled) + RIDGE * spread
        low = np.linalg.cholesky(c)
        made.append(Gaussian(math.log(n[g] / sum(n.values())) - float(np.log(np.diag(low)).sum()), mean[g], np.linalg.inv(low)))
    return prior, *made


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Each document's ``held_out``, ``score`` (0 to 1, higher where label 1 is likelier) and ``predicted`` (score at least 0.5).

    ``docs`` needs ``doc_id`` and ``text``; ``keep`` names more of its columns to return. Labels train the model and nothing else;
    ids, language and source are no inputs. Empty, null, repeated and very long texts are scored like any other; an empty
    table gives an empty result. Texts are never shuffled: the narrow statistics are written to the shared folder, joined to the labels for
    training and scored there. With ``keep`` they are computed again next to the kept columns, so that no text is stored a second time.
    """
    stats = materialize(statistics(docs, ["doc_id"], text))
    prior, good, bad = fit(stats, labels)
    if keep:
        stats = statistics(docs, ["doc_id", *keep], text)
    if good is None:
        score = F.lit(prior)
    else:
        z = F.greatest(F.lit(-MOST_LOGIT), F.least(F.lit(MOST_LOGIT), good.log_density() - bad.log_density()))
        score = 1 / (1 + F.exp(-z))
    return (stats.select("doc_id", *(keep or []), held_out().alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
