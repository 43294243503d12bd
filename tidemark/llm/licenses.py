"""Licence scan by a positional rare-token index, with DataFrame functions only.

Every template is a run of words with mandatory key phrases.  Document frequencies of all template words
are counted over the whole corpus; a template is indexed under its rarest words (highest IDF) with
their positions.  A file's words are looked up in that index; each hit proposes a start, the template's
other indexed words must stand at the same relative positions, then its key phrases are verified word
for word.  A start scores the share of template words at their places.

Everything after the frequency count is one projection over the texts: no shuffle, no join.

Defined cases: null and empty text have no words, no places, empty labels and score 0; places may overlap
and all count; a word that occurs nowhere in the corpus has the highest IDF; equal IDF goes by
alphabetical order; null ``doc_id``, repeated rows and very long texts are scanned like any other; columns of the
input pass through ``scan``, but for those named ``words``, ``n_words`` or ``places``.

Texts are split into words twice, once for the frequencies and once for the scan: keeping the words between
the two would write more than it saves to read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()  # mandatory phrases; none: the whole text
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_places(self) -> list[tuple[int, list[str]]]:
        out = []
        for key in self.keys or (self.text,):
            k = key.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k)
            out.append((at, k))
        return out


# Phrases and labels of the scan.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
TEMPLATES = (
    *BASE,
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl-3", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("required by applicable law",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered",)),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal"),
    Template("wtfpl", "do what the fuck you want to public license"),
)


def words(text: Column) -> Column:
    """The words of a text, A to Z as small letters."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower()), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each template word occurs: one count per word of the templates."""
    vocabulary = sorted({w for t in templates for w in t.words})
    present = docs.select(F.explode(F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    found = {r["word"]: r["count"] for r in present.groupBy("word").count().collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def scan(docs: DataFrame, frequencies: dict[str, int] | None = None, templates: tuple[Template, ...] = TEMPLATES, anchors: int = 3, least: float = 0.75) -> DataFrame:
    """``docs`` with ``n_words`` and ``places``: an array of ``(template, start, score)`` of all verified places."""
    frequencies = frequencies or document_frequencies(docs, templates)
    postings: dict[str, list[tuple[int, int]]] = {}
    rare: list[list[tuple[int, str]]] = []
    for t, template in enumerate(templates):
        order = sorted(set(template.words), key=lambda w: (frequencies.get(w, 0), w))[:anchors]
        rare.append([(i, w) for i, w in enumerate(template.words) if w in order])
        lead = order[:1] if not template.keys else order
        for i, w in rare[-1]:
            if w in lead:
                postings.setdefault(w, []).append((t, i))
    entry = lambda p: F.struct(F.lit(p[0]).alias("t"), F.lit(p[1]).alias("at"))
    index = F.map_from_arrays(F.array(*map(F.lit, postings)), F.array(*(F.array(*map(entry, p)) for p in postings.values())))
    indexed = F.array(*map(F.lit, postings))
    placed = lambda pairs: F.array(*(F.struct(F.lit(i).alias("at"), F.lit(w).alias("word")) for i, w in pairs))
    shapes = F.array(*(
        F.struct(
            F.lit(len(t.words)).alias("size"), F.array(*map(F.lit, t.words)).alias("words"), placed(rare[k]).alias("rare"),
            F.lit(len(rare[k]) if not t.keys else max(1, len(rare[k]) - 1)).alias("need"), F.lit(least if t.keys else 1.0).alias("least"),
            F.array(*(F.struct(F.lit(i).alias("at"), F.array(*map(F.lit, p)).alias("phrase")) for i, p in t.key_places())).alias("keys"),
        )
        for k, t in enumerate(templates)
    ))
    w = F.col("words")
    hits = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("pos"), F.when(F.array_contains(indexed, x), F.element_at(index, x)).alias("posts"))), lambda x: x["posts"].isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.transform(x["posts"], lambda p: F.struct(p["t"].alias("template"), (x["pos"] - p["at"]).alias("start"))))))
    word_at = lambda start, at: F.get(w, start + at)
    shape = lambda c: F.element_at(shapes, c["template"] + 1)
    meet = F.filter(starts, lambda c: (c["start"] >= 0) & (F.size(F.filter(shape(c)["rare"], lambda a: word_at(c["start"], a["at"]).eqNullSafe(a["word"]))) >= shape(c)["need"]))
    verified = F.filter(meet, lambda c: F.forall(shape(c)["keys"], lambda k: F.slice(w, c["start"] + k["at"] + 1, F.size(k["phrase"])) == k["phrase"]))
    share = lambda c: F.aggregate(F.zip_with(F.slice(w, c["start"] + 1, shape(c)["size"]), shape(c)["words"], lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / shape(c)["size"]
    scored = F.transform(verified, lambda c: F.struct(c["template"].alias("template"), c["start"].alias("start"), share(c).alias("score"), shape(c)["least"].alias("least")))
    kept = F.filter(scored, lambda c: c["score"] >= c["least"])
    nothing = F.array().cast("array<struct<template:int,start:int,score:double,least:double>>")
    found = docs.drop("words", "n_words", "places").withColumn("words", words(F.col("text")))
    found = found.withColumn("places", F.when(F.arrays_overlap(w, indexed), kept).otherwise(nothing))
    return found.withColumn("n_words", F.size("words").cast("long")).drop("words")


def summary(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document of ``scan``: all base places, the first and the last, labels and the best score."""
    base = [i for i, t in enumerate(templates) if t.base]
    is_base = lambda c: c["template"].isin(base)
    labels = F.array(*(F.lit(t.label) for t in templates))
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda c: F.element_at(labels, c["template"] + 1)))), ",")
    places = F.col("places")
    ours = F.filter(places, is_base)
    starts = F.transform(ours, lambda c: c["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(ours).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(ours).alias("base_labels"), names(places).alias("labels"), F.coalesce(F.array_max(F.transform(places, lambda c: c["score"])), F.lit(0.0)).alias("score"),
    )
