"""Quality classifier by positive-unlabelled learning (non-negative unbiased risk).

Trusted positives are the documents that ``labels`` marks as good in the training fold; everything else the
fit sees is unlabelled text of the same fold.  The class prior of the unlabelled text is estimated, then an
additive model over shape features of the whole text (each feature in quantile bins) minimises

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))        (logistic loss)

where a negative part below zero is walked back instead of followed, as in non-negative PU learning.

The fit runs on two hash-chosen samples of about ``max_rows`` documents each (the documented bound); scoring
goes over every text in Arrow batches.  Labels, language, source and id are never inputs of a score.

Defined cases: null and empty texts have the features of an empty text and a score like any other; conflicting
labels of one id count as not trusted; without positives or without texts nothing can be learnt and every score
is the prior 0.5; a null id is never learnt from; a long text is read in slices; an input column that has a
result's name is replaced.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadtrace.llm.common import pieces, text_key, training_fold, with_columns

SLICE = 4 << 20
BINS = 16
MAX_ROWS = 20_000
ROUNDS = 800
#: Step of the descent.
STEP = 0.2
L2 = 1e-6
_RUNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH = (np.array([b in s for b in range(256)]) for s in (
    range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32), range(128, 256)))


def _slices(raw: bytes):
    """The text in slices of about SLICE bytes, cut at white space where there is any."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            cut = max(raw.rfind(b" ", at + SLICE // 2, end), raw.rfind(b"\n", at + SLICE // 2, end))
            end = cut if cut > at else end
        yield raw[at:end]
        at = end


def features(text: bytes | None) -> list[float]:
    """Shape of a whole text: length, case, symbols, repetition, lines.  None of it depends on the language's words."""
    hist, count, lines = np.zeros(256, np.int64), Counter(), Counter()
    n_words = repeats = runs = short = packed = longest = 0
    deflate = zlib.compressobj(1)
    for raw in _slices(text or b""):
        hist += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        ws = raw.split()
        n_words += len(ws)
        repeats += sum(map(operator.eq, ws, ws[1:]))
        sizes = list(map(len, ws))
        longest = max([longest, *sizes])
        short += sum(x <= 3 for x in sizes)
        count.update(ws)
        lines.update(raw.split(b"\n"))
        runs += len(_RUNS.findall(raw))
        packed += len(deflate.compress(raw))
    packed += len(deflate.flush())
    n, w = max(1, int(hist.sum())), max(1, n_words)
    letters = max(1, int(hist[_UPPER | _LOWER | _HIGH].sum()))
    n_lines = max(1, sum(lines.values()))
    symbols = hist[~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)].sum()
    stops = hist[[46, 33, 63]].sum()
    return [
        np.log1p(n_words), letters / w, hist[_UPPER].sum() / letters, hist[_DIGIT].sum() / n, symbols / n,
        (symbols - hist[[44, 46]].sum()) / w, hist[[44, 46]].sum() / w, runs / w, repeats / w, len(count) / w,
        len(count) / w ** 0.5, max(count.values(), default=0) / w, packed / n, hist[124] / w, hist[33] / w, n_lines / w,
        1 - len(lines) / n_lines, n_words / (1 + stops), hist[_HIGH].sum() / n, np.log1p(longest), short / w,
        hist[_SPACE].sum() / n]


def featured(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """(row, x) with the features of each document's text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).alias("text"))
    result = T.StructType([rows.schema["row"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(result)

    def run(batches):
        for b in pieces(batches):
            x = [features(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), pa.array(x, arrow.field(1).type)],
                                             schema=arrow)

    return rows.mapInArrow(run, result)


@dataclass
class Model:
    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # features x BINS
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = self.bias + self.weights[np.arange(len(self.weights)), b].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def _sigmoid(f):
    return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def _descend(model: Model, step, rounds: int) -> None:
    """Adam over the weights and the bias; ``step`` gives the rows' bins and the derivative of the risk by their f."""
    n_feat = len(model.weights)
    theta = np.zeros(n_feat * BINS + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        grad = L2 * theta
        for flat, slope in step(theta):
            grad[:-1] += np.bincount(flat.ravel(), np.repeat(slope, n_feat), minlength=len(theta) - 1)
            grad[-1] += slope.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta - STEP * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    model.weights, model.bias = theta[:-1].reshape(n_feat, BINS), float(theta[-1])


def estimate_prior(p_scores: np.ndarray, u_scores: np.ndarray) -> float:
    """Share of positives in the unlabelled text: the least ratio, over thresholds, of the unlabelled share above a
    threshold to the positive share above it, each widened by its sampling error."""
    cuts = np.quantile(p_scores, np.linspace(0, 0.9, 91))
    q_p = np.array([(p_scores >= c).mean() for c in cuts])
    q_u = np.array([(u_scores >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(p_scores)) + 1 / np.sqrt(len(u_scores)))
    at = int(np.argmin((q_u + slack) / q_p))
    return float(np.clip(q_u[at] / q_p[at], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Non-negative PU fit from the feature rows of trusted positives and of unlabelled texts."""
    n_feat = unlabelled.shape[1]
    both = np.concatenate((positive, unlabelled))
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    model = Model(edges, np.zeros((n_feat, BINS)), 0.0, 0.5)
    offset = np.arange(n_feat) * BINS
    bp, bu = model.bins(positive) + offset, model.bins(unlabelled) + offset

    def f_of(theta, flat):
        return theta[-1] + theta[flat].sum(axis=1)

    # the prior: tell positives from unlabelled text on one half of the rows, compare the other halves' scores
    half_p, half_u = np.arange(len(bp)) % 2 == 0, np.arange(len(bu)) % 2 == 0

    def contrast(theta):
        yield bp[half_p], -(1 - _sigmoid(f_of(theta, bp[half_p]))) / (2 * half_p.sum())
        yield bu[half_u], _sigmoid(f_of(theta, bu[half_u])) / (2 * half_u.sum())

    if len(bp) > 3 and len(bu) > 3:
        _descend(model, contrast, ROUNDS // 2)
        model.prior = estimate_prior(model.score(positive[~half_p]), model.score(unlabelled[~half_u]))
    prior = model.prior

    def risk(theta):
        fp, fu = f_of(theta, bp), f_of(theta, bu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        sp, su = _sigmoid(fp), _sigmoid(fu)
        if negative >= 0:
            yield bp, -prior * (1 - sp) / len(bp) - prior * sp / len(bp)
            yield bu, su / len(bu)
        else:  # walk the negative part back up
            yield bp, prior * sp / len(bp)
            yield bu, -su / len(bu)

    _descend(model, risk, ROUNDS)
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model | None:
    """Fit on about ``max_rows`` trusted positives and ``max_rows`` unlabelled texts of the training fold; rows that
    repeat id and text count once."""
    trusted = (labels.where(training_fold(F.col(id_col))).groupBy(F.col(id_col).alias("id"))
               .agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = 1 AND hi = 1").select("id"))

    def thinned(df, salt: str, n: int, *by: str):
        u = F.shiftrightunsigned(F.xxhash64(F.lit(salt), *by), 11) / F.lit(2.0**53)
        return df.where(u < min(1.0, max_rows / max(1, n)))

    def sampled(df, salt: str):
        """About ``max_rows`` pairs of id and text; copies are combined before the shuffle."""
        n = df.select("id", "key").distinct().count()
        return thinned(df, salt, n, "id", "key").groupBy("id", "key").agg(F.first("text").alias("text"))

    fold = docs.where(training_fold(F.col(id_col))).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    # few trusted ids, so that they can be broadcast; their texts are thinned again, as an id may have many
    of_trusted = fold.join(F.broadcast(thinned(trusted, "positive", trusted.count(), "id")), "id")
    positive = sampled(of_trusted, "positive text")
    unlabelled = sampled(fold, "unlabelled")

    def rows(df) -> np.ndarray:
        # the samples' features (a few MB at the default bound) in an order that doesn't depend on the partitioning
        return np.array([r.x for r in featured(df, ["id"], "text").orderBy("row.id", "x").collect()])

    p, u = rows(positive), rows(unlabelled)
    return fit(p, u) if len(p) and len(u) else None


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of every document with ``score``, the probability of the good class."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).alias("text"))
    result = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(result)

    def run(batches):
        for b in pieces(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            p = np.full(len(texts), 0.5) if model is None or not texts else model.score(np.array([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), pa.array(p)], schema=arrow)

    out = rows.mapInArrow(run, result)
    return out.select(*with_columns(out, {"score": F.col("score")}))
