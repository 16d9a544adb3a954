"""License scans with a positional rare-token index, in DataFrame operations only.

1. The templates' words are the licence vocabulary.  One pass over the whole corpus counts the documents that
   hold each of them (its IDF; one row per vocabulary word reaches the driver).
2. The index maps words to postings (template, place in its key phrase).  Every key phrase is posted under its two
   highest-IDF words, so a file's highest-IDF licence words find every template that can stand in it.
3. A file that holds none of these words is done.  Else each place of such a word is looked up once; a posting less
   its place in the phrase is a start, and only starts that both words of a template name, so at the right relative
   position, are left.  The work grows with a file's hits, not with the number of templates.
4. Each start is verified: the whole mandatory key phrase must stand there.  The score of a place is the share of the
   template's words that stand at their places around the phrase.

Nothing is shuffled but the vocabulary counts; a very long text is one row's arrays, whatever it holds.

Defined cases: a null or empty text has no words and no place; a text may hold a phrase many times and
overlapping phrases of several templates, each counts; rows that repeat an id are scanned each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.common import with_columns, words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: The mandatory phrase, a part of the text.
    key: str
    base: bool = False

    @property
    def key_at(self) -> int:
        ws, key = self.text.split(), self.key.split()
        return next(i for i in range(len(ws)) if ws[i: i + len(key)] == key)


# The base phrases and labels of the query contract, then well-known sentences of public licences.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("apache-2", "you may not use this file except in compliance with the license",
             "except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("gpl", "it under the terms of the gnu general public license as published by the free software foundation",
             "gnu general public license"),
    Template("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation",
             "gnu lesser general public license"),
    Template("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation",
             "gnu affero general public license"),
    Template("mpl-2", "is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
             "for any purpose with or without fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
    Template("cc0", "creative commons cc0 1 0 universal", "cc0 1 0"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    Template("proprietary", "copyright all rights reserved", "all rights reserved"),
)


def _strings(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, int]:
    """Documents that hold each vocabulary word; absent words are missing."""
    held = docs.select(F.explode_outer(F.array_intersect(words(F.col(text_col)), _strings(vocabulary))).alias("word"))
    return {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect() if r.word is not None}


def _index(templates: tuple[Template, ...], df: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """Word -> postings (template, place in its key phrase, 1 or 2 for the rarest and the next) of the key phrases'
    two highest-IDF words; a phrase of one word is posted twice."""
    out: dict[str, list[tuple[int, int, int]]] = {}
    for t, template in enumerate(templates):
        key = template.key.split()
        rare = sorted(set(key), key=lambda w: (df.get(w, 0), w))
        for which, w in ((1, rare[0]), (2, rare[min(1, len(rare) - 1)])):
            out.setdefault(w, []).append((t, key.index(w), which))
    return out


def _literal(index: dict[str, list[tuple[int, int, int]]]) -> Column:
    """The index as a literal map."""
    postings = {w: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(o).alias("o"), F.lit(n).alias("which")) for t, o, n in ps])
                for w, ps in index.items()}
    return F.create_map(*[x for w, p in postings.items() for x in (F.lit(w), p)])


def license_places(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> DataFrame:
    """Documents with ``n_words`` and ``places``: (label, base, start, score) of every verified key phrase, by start.

    ``start`` is the phrase's first word, from 0.  All input columns stay; one that has a result's name is replaced.
    """
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    index = _index(templates, document_frequencies(docs, vocabulary, text_col))
    looked_up, postings = sorted(index), _literal(index)
    template = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _strings(t.text.split()).alias("text"),
                                  _strings(t.key.split()).alias("key"), F.lit(t.key_at).alias("key_at")) for t in templates])
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), words(F.col(text_col)).alias("ws"))
    spots = F.filter(F.transform("ws", lambda w, i: F.when(w.isin(looked_up), F.struct(w.alias("w"), i.alias("i")))),
                     lambda p: p.isNotNull())
    out = out.withColumn("spots", F.when(F.arrays_overlap("ws", _strings(looked_up)), spots))

    def starts(which):
        """(template, start) that the postings of one of the two words name."""
        return F.flatten(F.transform("spots", lambda p: F.transform(
            F.filter(postings[p.w], lambda q: q.which == which), lambda q: F.struct(q.t.alias("t"), (p.i - q.o).alias("start")))))

    def stands(c):
        key = template[c.t]["key"]
        return (c.start >= 0) & (F.slice("ws", F.greatest(c.start, F.lit(0)) + 1, F.size(key)) == key)

    def place(c):
        t = template[c.t]
        same = F.filter(F.sequence(F.lit(0), F.size(t["text"]) - 1),
                        lambda j: F.get("ws", c.start - t["key_at"] + j).eqNullSafe(F.get(t["text"], j)))
        return F.struct(c.start.alias("start"), t["label"].alias("label"), t["base"].alias("base"),
                        (F.size(same) / F.size(t["text"])).alias("score"))

    found = F.filter(F.array_intersect(starts(1), starts(2)), stands)
    out = out.withColumn("places", F.when(F.col("spots").isNotNull(), F.array_sort(F.transform(found, place))).otherwise(
        F.array().cast("array<struct<start:int,label:string,base:boolean,score:double>>")))
    return out.select(*with_columns(out, {"n_words": F.size("ws").cast("long"), "places": F.col("places")}))
