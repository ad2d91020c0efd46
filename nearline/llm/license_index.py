"""Licence scan by a positional index of rare words.

Licence notices are templates: word sequences with the phrases that a notice
must hold.  Their words form a positional index (word -> template, place).  The
words' document frequencies are counted over the whole corpus.  Of a file, for
each template, the present template words of highest IDF are looked up (``anchors``
of them, so that one licence can't hide another); every occurrence votes for
the place in the file at which the template would start, so the postings are intersected by
relative position.  Places with enough votes are verified: each mandatory phrase
within ``slack`` words of where the template has it, and a share of the
template's words in place.

The base labels come from places of fixed phrases.  Both passes work on slices
of a record batch with array arithmetic; nothing is exchanged but one count for
each licence word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearline.llm.arrowwords import coded, slices, split_words

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Notices of common licences in lower case, without punctuation, and their mandatory phrases.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
             "the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify", "with or without fee")),
    Template("lgpl-3.0", "licensed under the gnu lesser general public license version 3",
             ("gnu lesser general public license version 3",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction",
             ("permission is hereby granted", "without restriction")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


@dataclass(frozen=True)
class LicenseModel:
    """Templates, document frequency of each of their words, and the parameters of a match."""

    frequency: dict[str, int]
    templates: tuple[Template, ...] = TEMPLATES
    anchors: int = 6
    votes: int = 2
    share: float = 0.7
    slack: int = 3
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "names", tuple(sorted(vocabulary(self.templates))))


def vocabulary(templates) -> set[str]:
    """Words of the templates and of the base phrases."""
    return {w for t in templates for w in t.words} | {w for t in templates for m in t.mandatory for w in m.split()} | {
        w for phrase, _ in BASE for w in phrase.split()}


def _codes(texts: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, number of each word in ``names``, -1 for others)."""
    sizes, words = split_words(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())), SEPARATORS, pattern=True)
    code, distinct = coded(words)
    known = pc.fill_null(pc.index_in(distinct, pa.array(names, distinct.type)), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    return sizes, known[code] if len(code) else np.zeros(0, np.int32)


def train(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, **params) -> LicenseModel:
    """Document frequencies of the licence words over all documents (one row for each word reaches the driver)."""
    names = sorted(vocabulary(templates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, code = _codes(part.column("text"), names)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                at = np.flatnonzero(code >= 0)
                pairs = np.unique(doc[at] * len(names) + code[at])
                total += np.bincount(pairs % len(names), minlength=len(names))
        yield pa.RecordBatch.from_pydict({"word": names, "df": total})

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "word string, df long")
    got = rows.groupBy("word").agg(F.sum("df").alias("df")).collect()
    return LicenseModel({w: 0 for w in names} | {r["word"]: r["df"] for r in got}, tuple(templates), **params)


def _phrase_starts(code: np.ndarray, doc: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Places where the phrase stands inside one document."""
    n = len(code) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(code[:n] == phrase[0])
    for j, c in enumerate(phrase[1:], 1):
        at = at[code[at + j] == c]
    return at[doc[at] == doc[at + len(phrase) - 1]]


def _near(sorted_places: np.ndarray, wanted: np.ndarray, slack: int) -> np.ndarray:
    """Whether a place lies within ``slack`` of each wanted one."""
    return np.searchsorted(sorted_places, wanted - slack, side="left") < np.searchsorted(sorted_places, wanted + slack, side="right")


def match(code: np.ndarray, sizes: np.ndarray, model: LicenseModel):
    """Verified templates of one slice: (document, template number, start word, words in place) and base places (document, start, label number)."""
    number = {w: i for i, w in enumerate(model.names)}
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    some = np.flatnonzero(code >= 0)
    present = np.zeros((len(sizes), len(model.names)), bool)
    present[doc[some], code[some]] = True
    base = []
    for label, (phrase, _) in enumerate(BASE):
        at = _phrase_starts(code, doc, [number[w] for w in phrase.split()])
        base.append((doc[at], at - first[doc[at]], np.full(len(at), label)))
    found = []
    for t, template in enumerate(model.templates):
        words = [number[w] for w in template.words]
        distinct = sorted(set(words), key=lambda c: (model.frequency[model.names[c]], model.names[c]))
        needed = sorted({number[w] for m in template.mandatory for w in m.split()})
        maybe = present[:, needed].all(axis=1)
        if not maybe.any():
            continue
        here = present[:, distinct] & maybe[:, None]
        anchor = np.zeros_like(present)
        anchor[:, distinct] = here & (np.cumsum(here, axis=1) <= model.anchors)
        hits = some[anchor[doc[some], code[some]]]
        places = {c: [q for q, w in enumerate(words) if w == c] for c in distinct}
        votes = [np.zeros(0, np.int64)]
        for c in distinct:
            mine = hits[code[hits] == c]
            votes += [mine - q for q in places[c]]
        # A start may lie before its document's first word; shift keeps documents apart.
        flat = np.concatenate(votes)
        owner = np.concatenate([np.zeros(0, np.int64)] + [np.repeat(doc[hits[code[hits] == c]][None, :], len(places[c]), 0).ravel() for c in distinct])
        width = int(sizes.max(initial=0)) + 2 * len(words) + 2
        key, count = np.unique(owner * width + (flat - first[owner] + len(words)), return_counts=True)
        key = key[count >= model.votes]
        who, start = key // width, key % width - len(words)
        ok = np.ones(len(key), bool)
        for phrase in template.mandatory:
            p = phrase.split()
            at_template = next(i for i in range(len(words)) if template.words[i:i + len(p)] == p)
            at = _phrase_starts(code, doc, [number[w] for w in p])
            ok &= _near(doc[at] * width + at - first[doc[at]], who * width + start + at_template, model.slack)
        who, start = who[ok], start[ok]
        inside = np.zeros(len(who), np.int64)
        for q, c in enumerate(words):
            at = start + q
            real = np.flatnonzero((at >= 0) & (at < sizes[who]))
            inside[real] += code[first[who[real]] + at[real]] == c
        ok = inside >= model.share * len(words)
        found.append((who[ok], np.full(int(ok.sum()), t), start[ok], inside[ok]))
    join = lambda rows, n: tuple(np.concatenate([np.zeros(0, np.int64)] + [r[i] for r in rows]).astype(np.int64) for i in range(n))
    return join(found, 4), join(base, 3)


SCAN = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("base", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())]))),
    T.StructField("notices", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
        T.StructField("in_place", T.LongType()), T.StructField("size", T.LongType())])))])


def _lists(owner: np.ndarray, order: np.ndarray, rows: int, columns: dict) -> pa.Array:
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))]
    struct = pa.StructArray.from_arrays([pa.array(c).take(pa.array(order)) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


def scan(docs: DataFrame, model: LicenseModel, text_col: str = "text") -> DataFrame:
    """Every input column and struct ``license_scan``: n_words, base (start, label), notices (label, start, in_place, size).

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond
    ASCII of the whole text; starts count words from 0 (a notice's may be negative if the
    text begins inside it).  A null or empty text has no words and empty lists.  Rows are independent:
    ids may be null or repeated, repeated rows give equal results.  An input
    column named license_scan is replaced; other names are free.  Empty tables give no rows.
    """
    names = [c for c in docs.columns if c != "license_scan"]
    text_at = names.index(text_col)
    # Columns travel under their positions, so clashing names can't meet.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = T.StructType([*rows.schema.fields, T.StructField("license_scan", SCAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{text_at}"):
                sizes, code = _codes(part.column(text_at), list(model.names))
                (who, t, start, inside), (b_who, b_start, b_label) = match(code, sizes, model)
                n = part.num_rows
                order, b_order = np.lexsort((t, start, who)), np.lexsort((b_label, b_start, b_who))
                labels = np.array([x.label for x in model.templates], object)
                lengths = np.array([len(x.words) for x in model.templates], np.int64)
                scan_ = pa.StructArray.from_arrays([
                    pa.array(sizes.astype(np.int64)),
                    _lists(b_who, b_order, n, {"start": b_start, "label": pa.array([BASE[i][1] for i in b_label], pa.string())}),
                    _lists(who, order, n, {"label": pa.array(labels[t].tolist(), pa.string()), "start": start, "in_place": inside,
                                           "size": lengths[t]})], ["n_words", "base", "notices"])
                yield pa.RecordBatch.from_arrays([*part.columns, scan_], names=[*part.schema.names, "license_scan"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "license_scan")
