"""Language ID: multinomial naive Bayes over hashed character n-grams.

Fit: the labelled rows of the training fold give, per language, a hash-chosen sample of about ``max_docs``
documents (the documented bound of the fit); tasks count their hashed n-grams in numpy and Spark adds up the
partial counts in blocks of buckets.  The model is a matrix of log-probabilities (buckets x languages) in parts of
at most ``MODEL_BYTES`` (one language at least), fitted one after the other; the buckets are the same for any number
of languages.

Score: each part is broadcast; a text's best language and sum of posteriors are merged over the parts.  Every whole text is scored in numpy batches that gather only the rows of the
buckets a text holds; a long text goes in pieces whose sums add up, so memory is bounded by the piece.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could
be learnt; ties go to the language first in code point order; a null id is never learnt from; null languages
are no label.  The score is the posterior probability of the language given.  An input column that has a result's
name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadtrace.llm.common import pieces, stored, training_fold

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MODEL_BYTES = 64 << 20
#: Characters of one numpy batch.
PIECE = 1 << 19
#: Rows of one block of partial counts.
BLOCK = 1 << 12
SMOOTHING = 0.5
UNKNOWN = "und"


#: Log-probabilities gathered at a time.
GATHERED = 16 * PIECE


@dataclass
class Part:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages
    prior: np.ndarray


@dataclass
class Model:
    languages: list[str]
    parts: list  # broadcast (languages, log_p, prior) of parts


def _loaded(part, only: bool) -> Part:
    """The part of a broadcast; one of several isn't kept in memory."""
    out = Part(*part.value)
    if not only:
        vars(part).pop("_value", None)
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters, lower-cased, and the text that each belongs to."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), doc


def gram_buckets(texts: list[str], buckets: int):
    """Yields (text of each n-gram, its bucket); n-grams come in the order of their texts."""
    codes, doc = _codes(texts)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for n in ORDERS:
        for lo in range(0, len(codes) - n + 1, PIECE):
            c = codes[lo: lo + PIECE + n - 1].astype(np.uint64)
            d = doc[lo: lo + PIECE + n - 1]
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ c[k: len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            one = d[: len(h)]
            inside = one == d[n - 1:]
            yield one[inside], (h >> shift)[inside].astype(np.int64)


def _batches(texts):
    """Runs of texts of about PIECE characters: (first index, texts)."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= PIECE:
            yield at, run
            at, run, size = i + 1, [], 0
    if run:
        yield at, run


def posteriors(texts: list[str], model: Model | Part) -> np.ndarray:
    """Log posterior (up to a constant) of every language for every text."""
    if isinstance(model, Model):
        return np.concatenate([posteriors(texts, _loaded(p, len(model.parts) == 1)) for p in model.parts], axis=1)
    out = np.tile(model.prior, (len(texts), 1))
    step = max(1, GATHERED // len(model.prior))
    for first, run in _batches(texts):
        for docs, buckets in gram_buckets(run, len(model.log_p)):
            for lo in range(0, len(docs), step):
                doc, bucket = docs[lo: lo + step], buckets[lo: lo + step]
                starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                out[first + doc[starts]] += np.add.reduceat(model.log_p[bucket], starts, axis=0)
    return out


def train(docs: DataFrame, max_docs: int = 5000, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """Fit on the training fold: at most about ``max_docs`` documents of each language, chosen by a hash of id and text."""
    labelled = docs.where(training_fold(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.lit("sample"), F.col(id_col), F.length(F.col(text_col))).alias("u"))
    n_of = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(n_of, key=lambda x: x.encode())
    spark = docs.sparkSession
    if not languages:
        return Model([], [])
    known = spark.createDataFrame([(x, i, min(1.0, max_docs / n_of[x])) for i, x in enumerate(languages)],
                                  "lang string, code int, share double")
    sample = labelled.join(F.broadcast(known), "lang").where(
        F.shiftrightunsigned("u", 11) / F.lit(2.0**53) < F.col("share")).select("code", "text")
    width = max(1, MODEL_BYTES // (BUCKETS * 8))
    if len(languages) > width:
        sample = stored(sample, "language-sample")
    prior = np.log(np.array([n_of[x] for x in languages]) / sum(n_of.values()))
    parts = []
    for lo in range(0, len(languages), width):
        hi = min(lo + width, len(languages))
        of_part = sample if len(languages) <= width else sample.where(F.col("code").between(lo, hi - 1))
        log_p = _log_probabilities(of_part.select((F.col("code") - lo).alias("code"), "text"), hi - lo)
        parts.append(spark.sparkContext.broadcast((languages[lo:hi], log_p, prior[lo:hi])))
    return Model(languages, parts)


def _log_probabilities(sample: DataFrame, n_lang: int) -> np.ndarray:
    """Buckets x languages, from rows (code below ``n_lang``, text)."""
    buckets = BUCKETS
    partial = T.StructType.fromDDL("code int, block int, counts binary")
    arrow = to_arrow_schema(partial)

    def count(batches):
        held = np.zeros((n_lang, buckets), np.int64)
        for b in pieces(batches):
            code = np.asarray(b.column(0))
            for first, run in _batches(b.column(1).to_pylist()):
                for doc, bucket in gram_buckets(run, buckets):
                    at = code[first + doc].astype(np.int64) * buckets + bucket
                    held += np.bincount(at, minlength=held.size).reshape(held.shape)
        for c in np.flatnonzero(held.any(axis=1)).tolist():
            blocks = held[c].reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([
                pa.array([c] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()),
                pa.array([x.tobytes() for x in blocks], pa.binary())], schema=arrow)

    def add(key, data):
        total = np.zeros(BLOCK, np.int64)
        for x in data.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [total.tobytes()]], schema=arrow)

    counts = np.zeros((n_lang, buckets), np.float64)
    for r in sample.mapInArrow(count, partial).groupBy("code", "block").applyInArrow(add, partial).collect():
        counts[r.code, r.block * BLOCK: (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    log_p = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * buckets))
    return np.ascontiguousarray(log_p.T)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of every document with ``lang_pred`` and ``score``; only the text is looked at."""
    keep = docs.columns if keep is None else keep
    has_letter: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    # a text that is kept goes along once, beside the other columns
    kept = [c for c in keep if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), has_letter.alias("ok"), F.col(text_col).alias("text"))
    with_text = [rows.schema["text"]] if text_col in keep else []
    result = T.StructType([rows.schema["row"], *with_text, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(result)
    parts = model.parts

    def score(batches):
        for b in pieces(batches):
            ok = np.asarray(b.column(1)) & bool(parts)
            lang, p = np.full(len(ok), UNKNOWN, object), np.zeros(len(ok))
            if ok.any():
                at = np.flatnonzero(ok)
                texts = b.column(2).take(pa.array(at)).to_pylist()
                top, total = np.full(len(at), -np.inf), np.zeros(len(at))
                for part in parts:
                    m = _loaded(part, len(parts) == 1)
                    post = posteriors(texts, m)
                    here = post.max(axis=1)
                    better = here > top  # ties stay with the earlier language
                    lang[at[better]] = np.array(m.languages, object)[post.argmax(axis=1)[better]]
                    above = np.maximum(top, here)
                    total = total * np.exp(top - above) + np.exp(post - above[:, None]).sum(axis=1)
                    top = above
                p[at] = 1 / total
            text = [b.column(2)] if with_text else []
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), *text, pa.array(lang, pa.string()), pa.array(p)],
                                             schema=arrow)

    out = rows.mapInArrow(score, result)
    cols = {"lang_pred": F.col("lang_pred"), "score": F.col("score")}
    names = [c for c in keep if c.lower() not in cols]
    return out.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in names],
                      *[c.alias(n) for n, c in cols.items()])
