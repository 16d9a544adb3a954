"""Substring de-duplication with Rabin-Karp hashes of every fixed-length word window.

1. Documents are dealt to groups of about ``GROUP_BYTES`` by a hash of (id, text).  Each group computes
   the rolling hash of every window of ``window`` words in numpy: a prefix polynomial over the bytes of
   the white-space-normalised text, so a window's hash is a difference of two prefix values scaled to a
   common power of the base.  Words are places in one buffer, never Python objects.
2. Windows that repeat inside a group are settled there (the map-side combine); one representative per
   distinct window goes to the bucket that a second, independent hash names.  A passage shared by a third
   of the corpus therefore sends one entry per group, not one per document.
3. Each bucket counts its hashes and marks every entry whose hash also starts earlier: in a smaller id,
   or in the same document at an earlier start.  Back goes one bit per entry.
4. Each group hashes its texts again (cheap, and it needs no stored windows), reads its bits, and merges
   the covered words into maximal removal intervals.

Rows that repeat both id and text meet in one group.  Where they hold more than ``GROUP_BYTES``, one row stands for
them in the groups and its result is joined back to the rows, dealt by row numbers.

The 64-bit hash and the bucket of the second hash must both agree, so two different windows are confused
with probability 2**-64 / buckets per pair.

Defined cases: a null text has no words; a document of fewer words than the window keeps all; a null id
ranks after every other id (as does the largest 64-bit integer); rows that repeat an id with other text
do not start earlier than each other; rows that repeat id and text get the same result each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadtrace.llm.common import bytes_of, stored, text_key, with_columns

#: Text bytes of one group, the unit held in a task's memory.
GROUP_BYTES = 6 << 20
#: What a row weighs besides its text.
ROW_BYTES = 64
#: Windows of one bucket.
BUCKET_WINDOWS = 1 << 20
#: Repeated pairs of id and text that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1 << 20
#: Bytes hashed at a time inside a group.
PIECE_BYTES = 1 << 18

_RNG = np.random.Generator(np.random.PCG64(20240917))
_TABLES = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = [int(x) | 1 for x in _RNG.integers(2**62, 2**63, 2, dtype=np.uint64)]
_POWERS: dict[int, np.ndarray] = {}
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


def _powers(lane: int, n: int) -> np.ndarray:
    """The first n powers of the lane's base, modulo 2**64."""
    if lane not in _POWERS or len(_POWERS[lane]) < n:
        out = np.full(max(n, PIECE_BYTES + 1), _BASES[lane], np.uint64)
        out[0] = 1
        _POWERS[lane] = np.multiply.accumulate(out)
    return _POWERS[lane]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of several texts as places in one buffer, in which every word is followed by one space."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        """``raw`` holds the texts' bytes one after the other, text i at ``offsets[i]`` to ``offsets[i + 1]``."""
        word = ~_WHITE[raw]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = offsets[:-1] < offsets[1:]
        at, end = offsets[:-1][full], offsets[1:][full] - 1
        first[at], last[end] = word[at], word[end]
        starts = np.flatnonzero(first)
        size = np.flatnonzero(last) + 1 - starts
        self.bounds = np.searchsorted(starts, offsets)          # each text's first word
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.buffer = np.full(len(starts) + int(size.sum()), 32, np.uint8)
        letters = np.ones(len(self.buffer), bool)
        letters[self.end] = False
        self.buffer[letters] = raw[word]

    def joined(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last`` (not included), joined by one space."""
        return self.buffer[self.start[first]: self.end[last - 1]].tobytes() if last > first else b""


def _hashed(words: Words, window: int):
    """(text, hash, second hash) of every window, in text and start order."""
    per_text = np.maximum(np.diff(words.bounds) - window + 1, 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    at = np.repeat(words.bounds[:-1] - (np.cumsum(per_text) - per_text), per_text) + np.arange(len(text))
    s, e = words.start[at], words.end[at + window - 1]
    out = np.empty((2, len(at)), np.uint64)
    lo = 0
    while lo < len(at):
        # as many windows as lie within a piece, or one longer than it
        hi = max(lo + 1, int(np.searchsorted(e, s[lo] + PIECE_BYTES, "right")))
        base = s[lo]
        piece = words.buffer[base: e[hi - 1]]
        for lane in (0, 1):
            power = _powers(lane, len(piece) + 1)
            prefix = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_TABLES[lane][piece] * power[: len(piece)], out=prefix[1:])
            out[lane, lo:hi] = _mixed((prefix[e[lo:hi] - base] - prefix[s[lo:hi] - base]) * power[PIECE_BYTES - (s[lo:hi] - base)])
        lo = hi
    return text, out[0], out[1]


def window_hashes(texts: list[list[bytes]], window: int):
    """(text index, hash, second hash) of every window of texts given as lists of words."""
    whole = [b" ".join(ws) for ws in texts]
    raw = np.frombuffer(b"".join(whole), np.uint8)
    return _hashed(Words(raw, np.concatenate(([0], np.cumsum([len(x) for x in whole])))), window)


def packed(x: np.ndarray) -> bytes:
    """64-bit integers as byte planes of their differences: ascending ids leave mostly zero planes to compress."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel())


def later(h: np.ndarray, ids: np.ndarray, row: np.ndarray):
    """Which entries start earlier elsewhere.

    Entries are in (row, start) order; returns (removed, representative): an entry is removed if its hash
    has a smaller id or stands earlier in its row; else the representative (the first entry of its hash
    and id) shares its fate in a wider comparison.
    """
    n = len(h)
    removed, rep = np.zeros(n, bool), np.arange(n)
    order = np.argsort(h, kind="stable")
    sh = h[order]
    same = sh[1:] == sh[:-1]
    tied = np.zeros(n, bool)
    tied[1:] |= same
    tied[:-1] |= same
    at = order[tied]
    if not len(at):
        return removed, rep
    at = at[np.lexsort((at, row[at], ids[at], h[at]))]
    hh, ii, rr = h[at], ids[at], row[at]
    new_h = np.concatenate(([True], hh[1:] != hh[:-1]))
    new_row = new_h | np.concatenate(([True], rr[1:] != rr[:-1]))
    first = np.maximum.accumulate(np.where(new_h, np.arange(len(at)), 0))
    removed[at] = (ii != ii[first]) | ~new_row
    rep[at] = at[first]
    return removed, rep


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; nothing is copied to Python objects."""
    column = column.fill_null("").combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _read(data: pa.Table, window: int):
    """A group's rows in (id, text key) order with their words and windows."""
    data = data.sort_by([("id", "ascending"), ("key", "ascending")])
    ids = np.asarray(data.column("id").fill_null(2**63 - 1))
    words = Words(*_bytes_of(data.column("text")))
    doc, h, h2 = _hashed(words, window)
    removed, rep = later(h, ids[doc], doc) if len(h) else (np.zeros(0, bool), np.zeros(0, np.int64))
    return data, ids, words, doc, h, h2, removed, rep


def _by_bucket(removed, rep, h2, buckets):
    """Representatives in bucket order and each bucket's bounds."""
    mine = np.flatnonzero(~removed & (rep == np.arange(len(rep))))
    b = (h2[mine] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    return mine[order], b[order]


def cut_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                leave_clean: bool = False) -> DataFrame:
    """Documents with their text cut, ``n_words`` (before) and ``spans`` (maximal removed word intervals, [start, end)).

    The cut text joins the kept words by one space; with ``leave_clean`` a text that loses nothing stays as
    it is (null stays null).  All input columns stay; one that has a result's name is replaced.
    """
    total = bytes_of(docs, text_col)
    groups = max(1, -(-total // GROUP_BYTES))
    buckets = max(1, -(-total // (6 * BUCKET_WINDOWS)))
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"),
        F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
    )
    weight = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)
    heavy = stored(base.groupBy("id", "key").agg(weight.alias("weight"), F.count("*").alias("n"))
                   .where((F.col("n") > 1) & (F.col("weight") > GROUP_BYTES))
                   .select(F.col("id").alias("_id"), F.col("key").alias("_key"),
                           F.ceil(F.col("weight") / GROUP_BYTES).cast("long").alias("shares")), "repeated-rows")
    alike = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    copies = None
    if n_heavy := heavy.count():
        near = F.broadcast(heavy) if n_heavy <= MAX_BROADCAST_ROWS else heavy
        copies = base.join(near, alike)
        # one row stands for each pair; combined before the shuffle
        pairs = copies.groupBy("id", "key").agg(F.first("text").alias("text"), F.first("row").alias("row"))
        base = base.join(near, alike, "left_anti").withColumn("stands", F.lit(False)).unionByName(
            pairs.withColumn("stands", F.lit(True)))
    else:
        base = base.withColumn("stands", F.lit(False))
    base = base.withColumn("g", F.pmod(F.xxhash64("id", "key"), F.lit(groups)))

    def hashed(key, data):
        _, ids, _, doc, h, h2, removed, rep = _read(data, window)
        mine, b = _by_bucket(removed, rep, h2, buckets)
        which, first = np.unique(b, return_index=True)
        out = {"g": [], "b": which.tolist(), "hashes": [], "ids": [], "counts": []}
        for lo, hi in zip(first, [*first[1:], len(mine)]):
            at = mine[lo:hi]
            d, n = np.unique(doc[at], return_counts=True)
            out["g"].append(key[0].as_py())
            out["hashes"].append(h[at].tobytes())
            out["ids"].append(packed(ids[d]))
            out["counts"].append(packed(np.cumsum(n)))
        return pa.table(out, schema=to_arrow_schema(blocks))

    blocks = T.StructType.fromDDL("g long, b long, hashes binary, ids binary, counts binary")
    # the same exchange as the cut's, so texts are shuffled once; what else a row has is small beside its text
    sent = base.groupBy("g").applyInArrow(hashed, blocks)

    def judged(key, data):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in data.column("hashes").to_pylist()])
        per_doc = [np.diff(unpacked(x), prepend=0) for x in data.column("counts").to_pylist()]
        ids = np.concatenate([unpacked(x) for x in data.column("ids").to_pylist()])
        counts = np.concatenate(per_doc)
        row = np.repeat(np.arange(len(ids)), counts)
        removed, _ = later(h, ids[row], row)
        out, lo = {"g": [], "b": [], "bits": []}, 0
        for g, c in zip(data.column("g").to_pylist(), per_doc):
            hi = lo + int(c.sum())
            if removed[lo:hi].any():
                out["g"].append(g)
                out["b"].append(key[0].as_py())
                out["bits"].append(np.packbits(removed[lo:hi]).tobytes())
            lo = hi
        return pa.table(out, schema=to_arrow_schema(marks))

    marks = T.StructType.fromDDL("g long, b long, bits binary")
    verdicts = sent.groupBy("b").applyInArrow(judged, marks)

    def cut(key, left, right):
        if not left.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in arrow_out}, schema=arrow_out)
        data, _, words, doc, h, h2, removed, rep = _read(left, window)
        mine, b = _by_bucket(removed, rep, h2, buckets)
        for bucket, bits in zip(right.column("b").to_pylist(), right.column("bits").to_pylist()):
            lo, hi = np.searchsorted(b, [bucket, bucket + 1])
            removed[mine[lo:hi]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        removed |= removed[rep]
        n_words = np.diff(words.bounds)
        at = np.searchsorted(doc, np.arange(len(n_words) + 1))
        spans, kept = [], []
        text = data.column("text").cast(pa.binary()) if leave_clean else None
        for d, first in enumerate(words.bounds[:-1].tolist()):
            gone = np.flatnonzero(removed[at[d]: at[d + 1]])
            mine_spans = []
            if len(gone):
                new = np.flatnonzero(np.concatenate(([True], gone[1:] > gone[:-1] + window)))
                ends = np.concatenate((gone[new[1:] - 1], gone[-1:])) + window
                mine_spans = list(zip(gone[new].tolist(), ends.tolist()))
            spans.append([{"start": s, "end": e} for s, e in mine_spans])
            if leave_clean and not mine_spans:
                kept.append(text[d].as_py())
                continue
            stay = zip([0, *[e for _, e in mine_spans]], [*[s for s, _ in mine_spans], int(n_words[d])])
            kept.append(b" ".join(words.joined(first + s, first + e) for s, e in stay if s < e))
        return pa.table({
            "row": data.column("row"), "id": data.column("id"), "key": data.column("key"),
            "stands": data.column("stands"), "n_words": pa.array(n_words, pa.int64()),
            "spans": pa.array(spans, arrow_out.field("spans").type), "text": pa.array(kept, pa.binary()),
        }).cast(arrow_out)

    result = T.StructType([
        T.StructField("row", base.schema["row"].dataType), T.StructField("id", T.LongType()),
        T.StructField("key", T.LongType()), T.StructField("stands", T.BooleanType()), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType.fromDDL("start long, end long"))),
        T.StructField("text", T.BinaryType())])
    arrow_out = to_arrow_schema(result)
    out = base.groupBy("g").cogroup(verdicts.groupBy("g")).applyInArrow(cut, result)
    if copies is not None:
        out = stored(out, "cut-texts")
        dealt = copies.select("id", "key", "row", F.pmod(F.monotonically_increasing_id(), F.col("shares")).alias("share"))
        theirs = out.where("stands").drop("row").join(near, alike).select(
            F.col("id").alias("its_id"), F.col("key").alias("its_key"), "n_words", "spans", "text",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("its_share"))
        same = (F.col("id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key"))
                & (F.col("share") == F.col("its_share")))
        out = out.where("NOT stands").select("row", "n_words", "spans", "text").unionByName(
            dealt.join(theirs.hint("shuffle_hash"), same).select("row", "n_words", "spans", "text"))
    return out.select(*with_columns(out, {
        text_col: F.col("text").cast("string"), "n_words": F.col("n_words"), "spans": F.col("spans")}))
