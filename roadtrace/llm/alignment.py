"""Cross-tokenizer alignment by an associative monoid of fragments.

Tokenizer A (byte-level BPE) reads space + text, tokenizer B (sentencepiece, which adds the space itself) the text.
Byte offsets where tokens of both end cut the tokens into groups, and link the two tokens that end there.

A stretch of a document is a fragment: an open prefix (the tokens up to its first common end, whose group may have
begun earlier), closed groups, and an open suffix (the tokens after its last common end).  ``compose`` joins
neighbouring fragments and is associative, so any bracketing gives the document's groups.

1. Encoding, once.  No token of either tokenizer crosses a single space between two visible characters (the vocabulary
   is checked for it; otherwise the whole text is one unit), so a document is the concatenation of its units; a task
   encodes a unit once and looks it up after that.  The ids are written as a table in the checkpoint folder, in two bytes
   each where the vocabularies allow, and everything after that is array work on them.
2. Very long documents (over ``LONG_BYTES``) are cut into chunks of ``CHUNK`` characters' byte range wherever that
   falls, also inside a unit or a token.  A chunk is a row of its own with the units its borders cross whole; a token
   belongs to the chunk in which it ends.  Chunks are dealt over the cluster, each gives a fragment, and rounds of
   ``FAN`` neighbours per group compose them.  A border inside a unit of over ``UNIT`` characters moves to its end.
3. Link counts.  Tasks add up the links of each pair of ids, Spark the partial sums.  The most frequent pairs, at most
   ``MAX_BROADCAST_PAIRS``, are broadcast; links of rarer pairs meet their counts in a shuffle join, in which no key
   is hot, as the frequent ones are not in it.
4. Another pass over the ids scores every document with these counts and renders its groups.

Defined cases: null and empty texts, and texts whose tokens' bytes differ from space + text (such as texts that hold
U+2581 themselves), have no tokens: all numbers are 0 and ``groups`` is ''; they add nothing to the counts.  A pair's
count ties for its B id's highest with equal counts.  Rows that repeat an id or a text are documents of their own.
Input columns that have a result's name are replaced.  The tokenizers' folder has to be there on every executor.
"""

from __future__ import annotations

import os
import re
import sys
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadtrace.llm.common import pieces, stored, with_columns

FOLDER = "/opt/tokenizers"
#: Texts above this are cut into chunks of about CHUNK characters.
LONG_BYTES, CHUNK = 1 << 16, 1 << 15
#: A chunk's border may lie in a unit of up to so many characters.
UNIT = 1 << 12
#: Neighbouring fragments composed in one step of the tree.
FAN = 16
MAX_BROADCAST_PAIRS = 1 << 22
#: Characters of units kept in a task before the store is emptied.
HELD = 1 << 24
#: Units that are encoded and aligned at a time, and of one run.
CALL, RUN = 16_384, 256

#: Where a text may be cut: single spaces between visible characters (ASCII, or letters and digits of any script).
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_VISIBLE_ENDS = re.compile(r"[!-~\w](?:.*[!-~\w])?\Z", re.S)
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's characters: printable bytes stand for themselves, the others for 256, 257 ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, folder: str, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{a_file}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
        byte_of = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()
                        for i, x in enumerate(names)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: what ids are kept in
        self.kind = np.uint16 if max(len(self.a_len), len(self.b_len)) <= 1 << 16 else np.uint32
        with open(f"{folder}/{a_file}", encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.cuts = (spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                     and not any("▁" in x.lstrip("▁") for x in names))

    def units(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of A for space + text."""
        return [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def b_ids(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def valid(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return (b"".join(map(self.a_bytes.__getitem__, a)) == raw
                and b"".join(map(self.b_bytes.__getitem__, b)) == raw)

    def a_ids_of_units(self, units: list[str]) -> list[int]:
        """Ids of A for all units, one after the other.  Units that begin and end with a visible character are units
        of their run joined by spaces as well, so the tokenizer is called for a run of them."""
        runs, at = [], 0
        while at < len(units):
            end = at + 1
            if self.cuts and _VISIBLE_ENDS.match(units[at]):
                while end < len(units) and end - at < RUN and _VISIBLE_ENDS.match(units[end]):
                    end += 1
            runs.append(" ".join(units[at:end]))
            at = end
        return [i for ids in self.a_ids(runs) for i in ids]


def loaded(*files: str) -> Tokenizers:
    """The tokenizers, read once per Python worker: tasks get this module by value, so it is kept beside it."""
    held = sys.__dict__.setdefault("_loaded_tokenizers", {})
    if files not in held:
        held[files] = Tokenizers(*files)
    return held[files]


def pair_of(a, b):
    """One 64-bit key of an id pair."""
    return (a << 32) | b


# ------------------------------------------------------------------ monoid
@dataclass
class Fragment:
    """A stretch of a document.  Without a common end (not ``closed``) all its tokens are in the prefix."""
    closed: bool = False
    pre_a: list = field(default_factory=list)
    pre_b: list = field(default_factory=list)
    body: bytes = b""          # rendered groups between the first and the last common end
    suf_a: list = field(default_factory=list)
    suf_b: list = field(default_factory=list)


def rendered(a, b) -> bytes:
    return (",".join(map(str, a)) + "|" + ",".join(map(str, b))).encode()


def compose(x: Fragment, y: Fragment) -> Fragment:
    if not x.closed:
        return Fragment(y.closed, x.pre_a + y.pre_a, x.pre_b + y.pre_b, y.body, y.suf_a, y.suf_b)
    if not y.closed:
        return Fragment(True, x.pre_a, x.pre_b, x.body, x.suf_a + y.pre_a, x.suf_b + y.pre_b)
    middle = rendered(x.suf_a + y.pre_a, x.suf_b + y.pre_b)
    return Fragment(True, x.pre_a, x.pre_b, b";".join(p for p in (x.body, middle, y.body) if p), y.suf_a, y.suf_b)


def leaf(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> tuple[Fragment, np.ndarray]:
    """The fragment of tokens with their byte ends, and the pairs it links."""
    ends, ia, ib = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
    if not len(ends):
        return Fragment(False, a.tolist(), b.tolist()), np.zeros(0, np.int64)
    ca, cb = np.append(0, ia + 1), np.append(0, ib + 1)
    groups = [(a[ca[i]: ca[i + 1]].tolist(), b[cb[i]: cb[i + 1]].tolist()) for i in range(len(ends))]
    body = b";".join(rendered(*g) for g in groups[1:])
    return (Fragment(True, *groups[0], body, a[ca[-1]:].tolist(), b[cb[-1]:].tolist()),
            pair_of(a[ia].astype(np.int64), b[ib].astype(np.int64)))


def whole(f: Fragment) -> bytes:
    """The groups of a whole document; b'' if it doesn't end with a common end."""
    if not f.closed or f.suf_a or f.suf_b:
        return b""
    return b";".join(p for p in (rendered(f.pre_a, f.pre_b), f.body) if p)


# ------------------------------------------------------------------- units
class Counts:
    """Link counts of pairs: (sorted pairs, counts, whether they are their B id's highest)."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, best: np.ndarray):
        self.pairs, self.n, self.best = pairs, n, best

    def of(self, pairs: np.ndarray):
        """(count, best, known) of pairs; unknown ones give 0."""
        if not len(self.pairs):
            none = np.zeros(len(pairs), np.int64)
            return none, none, none.astype(bool)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        known = self.pairs[at] == pairs
        return np.where(known, self.n[at], 0), np.where(known, self.best[at], 0).astype(np.int64), known


def decimals(ids: np.ndarray, after: np.ndarray) -> np.ndarray:
    """ASCII digits of the ids, each row ended by its byte of ``after``; leading zeros are 0 bytes."""
    width = len(str(int(ids.max(initial=0))))
    out = np.empty((len(ids), width + 1), np.uint8)
    rest = ids.astype(np.uint32)
    for i in range(width - 1, -1, -1):
        out[:, i] = np.where((rest > 0) | (i == width - 1), 48 + rest % 10, 0)
        rest //= 10
    out[:, width] = after
    return out


class Units:
    """The ids of every unit a task has met."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.held = 0
        self.valid = np.zeros(0, bool)
        #: all ids of A and of B, and each unit's bounds in them
        self.ids = [np.zeros(0, self.tok.kind)] * 2
        self.bounds = [np.zeros(1, np.int64)] * 2

    def add(self, units: set[str]):
        new = list(units.difference(self.index))
        for lo in range(0, len(new), CALL):
            self._add(new[lo: lo + CALL])
        self.held += sum(map(len, new)) + 64 * len(new)

    def _add(self, units: list[str]):
        tok = self.tok
        self.index.update(zip(units, range(len(self.valid), len(self.valid) + len(units))))
        raw = [b" " + u.encode() for u in units]
        ok = np.ones(len(units), bool)
        a, b_lists = tok.a_ids_of_units(units), tok.b_ids(units)
        b = [i for ids in b_lists for i in ids]
        if not tok.valid(b"".join(raw), a, b):
            a_lists = tok.a_ids(units)
            ok = np.array([tok.valid(*x) for x in zip(raw, a_lists, b_lists)])
            raw = [x if good else b"" for x, good in zip(raw, ok)]
            a, b = ([i for ids, good in zip(x, ok) if good for i in ids] for x in (a_lists, b_lists))
        self.valid = np.append(self.valid, ok)
        # every unit ends with a token's end in both
        ends = np.cumsum([len(x) for x in raw])
        for side, (ids, size) in enumerate(((a, tok.a_len), (b, tok.b_len))):
            ids = np.array(ids, tok.kind)
            upto = np.searchsorted(np.cumsum(size[ids]), ends, "right")
            self.bounds[side] = np.append(self.bounds[side], len(self.ids[side]) + upto)
            self.ids[side] = np.append(self.ids[side], ids)

    def at(self, units: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def ids_of(self, side: int, which: np.ndarray) -> np.ndarray:
        """The ids of the units ``which``, one after the other."""
        bounds = self.bounds[side]
        n = bounds[which + 1] - bounds[which]
        return self.ids[side][np.repeat(bounds[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Aligned:
    """Common ends of the tokens of several stretches, each with its ids and the byte where its first token starts."""

    def __init__(self, tok: Tokenizers, a: list[np.ndarray], b: list[np.ndarray], a_from: np.ndarray, b_from: np.ndarray):
        self.n = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
        self.ids = [np.concatenate([np.zeros(0, tok.kind), *side]).astype(np.int64) for side in (a, b)]
        ends = [self._ends(ids, size, n, start) for ids, size, n, start in zip(
            self.ids, (tok.a_len, tok.b_len), self.n, (a_from, b_from))]
        # the stretches side by side, so that ends of two of them never meet
        last = np.zeros(len(a), np.int64)
        for n, e in zip(self.n, ends):
            at = np.cumsum(n)[n > 0] - 1
            last[n > 0] = np.maximum(last[n > 0], e[at])
        base = np.cumsum(last + 1) - last
        self.ends = [e + np.repeat(base, n) for e, n in zip(ends, self.n)]
        common, ia, ib = np.intersect1d(*self.ends, assume_unique=True, return_indices=True)
        #: the tokens that end groups, and the stretches' bounds in them
        self.closing = ia, ib
        self.bounds = np.concatenate(([0], np.searchsorted(common, base + last, "right")))
        self.pairs = pair_of(self.ids[0][ia], self.ids[1][ib])

    @staticmethod
    def _ends(ids, size, n, start):
        upto = np.cumsum(size[ids])
        first = np.concatenate(([0], upto))[np.cumsum(n) - n]
        return upto + np.repeat(start - first, n)

    def per_stretch(self, x: np.ndarray) -> np.ndarray:
        """Sums over each stretch's links."""
        return np.diff(np.concatenate(([0], np.cumsum(x)))[self.bounds])

    def rendered(self) -> list[bytes]:
        """Each stretch's groups as text, for stretches that are whole documents."""
        group = [np.searchsorted(i, np.arange(len(x))) for i, x in zip(self.closing, self.ids)]
        after = [np.full(len(x), 44) for x in self.ids]
        for x, i, mark in zip(after, self.closing, (124, 59)):
            x[i] = mark
        order = np.argsort(np.concatenate((2 * group[0], 2 * group[1] + 1)), kind="stable")
        text = decimals(np.concatenate(self.ids), np.concatenate(after))[order]
        seen = text != 0
        upto = np.concatenate(([0], np.cumsum(seen.sum(axis=1))))
        flat = text[seen].tobytes()
        # where each document's groups end in the flat text; the last ';' goes
        stop = upto[np.cumsum(self.n[0] + self.n[1])].tolist()
        return [flat[s:max(s, e - 1)] for s, e in zip([0, *stop], stop)]


# ------------------------------------------------------------------ chunks
def borders(text: str, cuts: bool) -> list[tuple[int, int, int]]:
    """Where a text is cut: (last cut before or at the border, border, first cut at or after it), as indexes of
    characters; a cut is the index of its space.  A border in a unit of over ``UNIT`` characters is moved to its end."""
    out, at = [], 0
    while at + CHUNK < len(text):
        at += CHUNK
        after = CUT.search(text, at) if cuts else None
        if after is None:
            break
        hi = after.start()
        lo = hi if hi == at else max((m.start() for m in CUT.finditer(text, max(0, at - UNIT)) if m.start() <= at), default=None) \
            if hi - at <= UNIT else None
        if lo is None or hi - lo > UNIT:
            lo, at = hi, hi
        out.append((lo, at, hi))
    return out


def chunks_of(text: str, cuts: bool):
    """(chunk's text, byte range (lo, hi] of the chunk in space + that text) along a text."""
    cut_at = borders(text, cuts)
    for k in range(len(cut_at) + 1):
        lo, at, _ = cut_at[k - 1] if k else (-1, -1, -1)
        _, stop, end = cut_at[k] if k < len(cut_at) else (0, len(text), len(text))
        start = lo + 1
        yield (text[start:end], 0 if at <= lo else 1 + len(text[start:at].encode()), 1 + len(text[start:stop].encode()))


def chunk_ids(units: Units, piece: str, lo: int, hi: int):
    """(valid, ids of A and of B, where their first tokens start) of the tokens that end in a chunk's bytes."""
    tok = units.tok
    parts = tok.units(piece)
    units.add(set(parts))
    which = units.at(parts)
    out: list = [bool(units.valid[which].all())]
    starts = []
    for side, size in enumerate((tok.a_len, tok.b_len)):
        ids = units.ids_of(side, which) if out[0] else np.zeros(0, tok.kind)
        end = np.cumsum(size[ids])
        mine = (end > lo) & (end <= hi)
        out.append(ids[mine])
        starts.append(int(end[mine][0] - size[ids[mine][0]]) if mine.any() else 0)
    return (*out, *starts)


# --------------------------------------------------------------- operator
PAIRS = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
RARE = T.ArrayType(PAIRS)


def _strings(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _arrays(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _of_stretches(tok: Tokenizers, b: pa.RecordBatch) -> Aligned:
    return Aligned(tok, *(_arrays(b.column(c), tok.kind) for c in "ab"), *(np.asarray(b.column(c)) for c in ("a_from", "b_from")))


def _rare_lists(aligned: Aligned, known: np.ndarray) -> list[list[dict]]:
    """Per stretch the links whose counts aren't known: {pair, n}."""
    out = []
    for lo, hi in zip(aligned.bounds, aligned.bounds[1:]):
        pairs, n = np.unique(aligned.pairs[lo:hi][~known[lo:hi]], return_counts=True) if not known[lo:hi].all() else ((), ())
        out.append([{"pair": int(p), "n": int(c)} for p, c in zip(pairs, n)])
    return out


def align(docs: DataFrame, folder: str = FOLDER, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model",
          text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of every document with ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and
    ``groups``: ``a1,a2|b1;a3|b2,b3`` with the ids of A and B in order.

    A pair's count is the number of links corpus-wide that hold it; ``n_best`` counts the links whose count is the
    highest of their B id, ``count_sum`` adds up the links' counts.
    """
    files = folder, a_file, b_file
    keep = docs.columns if keep is None else keep
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    base = docs.select(kept.alias("row"), F.col(text_col).alias("text"))
    long_text = F.coalesce(F.octet_length("text") > LONG_BYTES, F.lit(False))
    short = stored(_encoded(base.where(~long_text), *files), "token-ids")
    long = stored(base.where(long_text).withColumn("doc", F.monotonically_increasing_id()), "long-texts")
    chunks = _chunks(long, *files) if long.take(1) else None

    links = _links(short.select(*IDS), *files)
    if chunks is not None:
        bad = chunks.where("NOT valid").select("doc").distinct()
        links = links.unionByName(_links(chunks.join(bad, "doc", "left_anti").select(*IDS), *files))
    near, far = _near_and_far(_pair_counts(links))

    out = _score(short, near, *files)
    if chunks is not None:
        out = out.unionByName(_score_long(chunks, near, *files))
    if far is not None:
        out = _with_rare(out, far)
    return out.select(*with_columns(out, {c: F.col(c) for c in (*NUMBERS, "groups")}) if keep else [*NUMBERS, "groups"])


#: Ids of a stretch: bytes of both id arrays, and where their first tokens start.
IDS = ("a", "b", "a_from", "b_from")


def _encoded(docs: DataFrame, *files: str) -> DataFrame:
    """(row, ids) of whole texts; none for those whose tokens don't give back their bytes."""
    schema = T.StructType([docs.schema["row"], *T.StructType.fromDDL("a binary, b binary, a_from long, b_from long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        units = Units(loaded(*files))
        for b in pieces(batches):
            parts = [units.tok.units(t) if t else [] for t in _strings(b.column("text"))]
            units.add(set().union(*parts))
            ids = [], []
            for p in parts:
                which = units.at(p)
                if not units.valid[which].all():
                    which = which[:0]
                for side in (0, 1):
                    ids[side].append(units.ids_of(side, which).tobytes())
            none = pa.array(np.zeros(len(parts), np.int64))
            yield pa.RecordBatch.from_arrays([b.column("row").cast(arrow.field("row").type), *[pa.array(x, pa.binary()) for x in ids],
                                              none, none], schema=arrow)
            if units.held > HELD:
                units.clear()

    return docs.mapInArrow(run, schema)


def _chunks(long: DataFrame, *files: str) -> DataFrame:
    """(doc, chunk, row, valid, ids): the chunks of long documents; the first one carries the document's row."""
    places = T.StructType([T.StructField("doc", T.LongType()), T.StructField("chunk", T.LongType()),
                           T.StructField("row", long.schema["row"].dataType)])
    texts = T.StructType([*places, *T.StructType.fromDDL("text string, lo long, hi long").fields])
    ids = T.StructType([*places, *T.StructType.fromDDL("valid boolean, a binary, b binary, a_from long, b_from long").fields])
    texts_arrow, ids_arrow = to_arrow_schema(texts), to_arrow_schema(ids)

    def cut(batches):
        cuts = loaded(*files).cuts
        for b in pieces(batches, 1):
            row, text, doc = b.column("row"), b.column("text")[0].as_py(), b.column("doc")[0].as_py()
            for k, (piece, lo, hi) in enumerate(chunks_of(text, cuts)):
                mine = (row if k == 0 else pa.nulls(1, row.type)).cast(texts_arrow.field("row").type)
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([k]), mine, pa.array([piece]), pa.array([lo]),
                                                  pa.array([hi])], schema=texts_arrow)

    def encode(batches):
        units = Units(loaded(*files))
        for b in pieces(batches, 16):
            valid, *found = zip(*(chunk_ids(units, *x) for x in zip(*(b.column(c).to_pylist() for c in ("text", "lo", "hi")))))
            a, c = ([x.tobytes() for x in side] for side in found[:2])
            yield pa.RecordBatch.from_arrays([
                b.column("doc"), b.column("chunk"), b.column("row").cast(ids_arrow.field("row").type), pa.array(valid),
                pa.array(a, pa.binary()), pa.array(c, pa.binary()), *[pa.array(x, pa.int64()) for x in found[2:]]], schema=ids_arrow)
            if units.held > HELD:
                units.clear()

    # dealt by chunk, so the chunks of a document are encoded all over the cluster
    return stored(long.mapInArrow(cut, texts).repartition("doc", "chunk").mapInArrow(encode, ids), "chunk-ids")


def _links(stretches: DataFrame, *files: str) -> DataFrame:
    """(pair, n): partial link counts."""
    arrow = to_arrow_schema(PAIRS)

    def run(batches):
        tok = loaded(*files)
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in pieces(batches):
            mine, times = np.unique(_of_stretches(tok, b).pairs, return_counts=True)
            pairs, of = np.unique(np.concatenate((pairs, mine)), return_inverse=True)
            n = np.bincount(of, np.concatenate((n, times)), len(pairs)).astype(np.int64)
            if len(pairs) > MAX_BROADCAST_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], schema=arrow)
                pairs, n = pairs[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], schema=arrow)

    return stretches.mapInArrow(run, PAIRS)


def _pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of every linked pair."""
    counts = stored(links.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # one row per B id: at most the vocabulary's size
    top = F.broadcast(counts.groupBy(b.alias("b")).agg(F.max("n").alias("top")))
    return stored(counts.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")


def _near_and_far(counts: DataFrame):
    """(broadcast of the frequent pairs, the other pairs or None): all with at least 2**j links, for the least j that
    keeps them within ``MAX_BROADCAST_PAIRS``."""
    by_size = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("j")).agg(F.count("*").alias("pairs")).orderBy(F.desc("j")).collect()
    held, least = 0, None
    for r in by_size:
        if held + r.pairs > MAX_BROADCAST_PAIRS:
            break
        held, least = held + r.pairs, r.j
    fits = len(by_size) == 0 or (least is not None and least == by_size[-1].j)
    chosen = counts if fits else counts.where(F.lit(False)) if least is None else counts.where(F.col("n") >= F.lit(1 << least))
    table = chosen.toArrow().combine_chunks()
    pair = np.asarray(table["pair"].to_numpy())
    order = np.argsort(pair)
    found = tuple(np.asarray(table[c].to_numpy())[order] for c in ("pair", "n", "best"))
    near = counts.sparkSession.sparkContext.broadcast(found)
    rest = counts if least is None else counts.where(F.col("n") < F.lit(1 << least))
    return near, None if fits else rest


def _numbers(aligned: Aligned, counts: Counts):
    """(the stretches' NUMBERS, whether each link's count is known)."""
    n, best, known = counts.of(aligned.pairs)
    links = np.diff(aligned.bounds)
    return np.stack([*aligned.n, links, links, aligned.per_stretch(best), aligned.per_stretch(n)], axis=1), known


def _score(short: DataFrame, near, *files: str) -> DataFrame:
    """(row, numbers, groups, rare) of whole texts."""
    schema = T.StructType([short.schema["row"], *[T.StructField(c, T.LongType()) for c in NUMBERS],
                           T.StructField("groups", T.StringType()), T.StructField("rare", RARE)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        tok, counts = loaded(*files), Counts(*near.value)
        for b in pieces(batches, 128):
            aligned = _of_stretches(tok, b)
            numbers, known = _numbers(aligned, counts)
            yield pa.RecordBatch.from_arrays([
                b.column("row").cast(arrow.field("row").type), *[pa.array(x) for x in numbers.T],
                pa.array(aligned.rendered(), pa.binary()).cast(pa.string()),
                pa.array(_rare_lists(aligned, known), arrow.field("rare").type)], schema=arrow)

    return short.mapInArrow(run, schema)


def _score_long(chunks: DataFrame, near, *files: str) -> DataFrame:
    """(row, numbers, groups, rare) of documents in chunks: fragments, composed in rounds."""
    places = [T.StructField("doc", T.LongType()), T.StructField("chunk", T.LongType()), chunks.schema["row"]]
    schema = T.StructType([*places, *T.StructType.fromDDL("valid boolean, closed boolean, pre_a array<int>, pre_b array<int>, "
                                                          "body binary, suf_a array<int>, suf_b array<int>, numbers array<long>").fields,
                           T.StructField("rare", RARE)])
    arrow = to_arrow_schema(schema)
    parts = ("closed", "pre_a", "pre_b", "body", "suf_a", "suf_b")

    def rows(doc, chunk, row, valid, frags, numbers, rare):
        cols = [valid, *[[getattr(f, n) for f in frags] for n in parts], numbers, rare]
        return [doc, chunk, row.cast(arrow.field("row").type), *[pa.array(c, f.type) for c, f in zip(cols, list(arrow)[3:])]]

    def first(batches):
        tok, counts = loaded(*files), Counts(*near.value)
        for b in pieces(batches, 16):
            aligned = _of_stretches(tok, b)
            numbers, known = _numbers(aligned, counts)
            sides = [np.split(x, np.cumsum(n)[:-1]) for x, n in ((aligned.ids[0], aligned.n[0]), (aligned.ends[0], aligned.n[0]),
                                                                 (aligned.ids[1], aligned.n[1]), (aligned.ends[1], aligned.n[1]))]
            frags = [leaf(*x)[0] for x in zip(*sides)]
            yield pa.RecordBatch.from_arrays(rows(b.column("doc"), b.column("chunk"), b.column("row"), b.column("valid").to_pylist(),
                                                  frags, numbers.tolist(), _rare_lists(aligned, known)), schema=arrow)

    def joined(key, data):
        data = data.sort_by("chunk").combine_chunks()
        items = data.drop_columns(["doc", "chunk", "row"]).to_pylist()
        rare: dict[int, int] = {}
        for x in items:
            for r in x["rare"]:
                rare[r["pair"]] = rare.get(r["pair"], 0) + r["n"]
        return pa.table(rows(pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), data.column("row").combine_chunks()[:1],
                             [all(x["valid"] for x in items)], [reduce(compose, [Fragment(*[x[n] for n in parts]) for x in items])],
                             [np.sum([x["numbers"] for x in items], axis=0).tolist()],
                             [[{"pair": p, "n": n} for p, n in rare.items()]]), schema=arrow)

    out = chunks.mapInArrow(first, schema)
    left = 1 + (chunks.agg(F.max("chunk")).first()[0] or 0)
    while True:
        out = out.groupBy("doc", F.floor(F.col("chunk") / FAN).cast("long").alias("of")).applyInArrow(joined, schema)
        left = -(-left // FAN)
        if left <= 1:
            break

    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    body = F.col("body").cast("string")
    head = F.concat(ids("pre_a"), F.lit("|"), ids("pre_b"))
    ok = F.col("valid") & F.col("closed") & (F.size("suf_a") == 0) & (F.size("suf_b") == 0)
    return out.select(
        "row", *[F.when(ok, F.col("numbers")[i]).otherwise(0).cast("long").alias(c) for i, c in enumerate(NUMBERS)],
        F.when(ok, F.when(body == "", head).otherwise(F.concat(head, F.lit(";"), body))).otherwise("").alias("groups"),
        F.when(ok, F.col("rare")).otherwise(F.array().cast(RARE)).alias("rare"))


def _with_rare(out: DataFrame, far: DataFrame) -> DataFrame:
    """Adds the counts of pairs that weren't broadcast: a shuffle join on pairs of few links each."""
    out = stored(out.withColumn("_doc", F.monotonically_increasing_id()), "scored-texts")
    asked = out.select("_doc", F.explode("rare").alias("r")).select("_doc", F.col("r.pair").alias("pair"), F.col("r.n").alias("times"))
    more = (asked.join(far, "pair").groupBy("_doc")
            .agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")))
    return (out.join(more, "_doc", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
        .drop("_doc", "_best", "_sum"))
