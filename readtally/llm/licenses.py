"""License scan by a positional index of rare words.

Templates are licence notices with mandatory key phrases. Document frequencies of all template words are counted over the corpus; of a
template's mandatory words the ``ANCHORS`` with the highest IDF have postings: word -> (template, position). A file's licence
words with postings, its rarest ones, are looked up together; each posting gives a place where a template would begin, and places
on which all anchors of the template agree are kept (the postings are intersected by relative position). There the text is
compared word by word: all mandatory words must stand where the template has them, and ``AGREE`` of its words must agree. Since anchors are
mandatory, no such place is missed, whatever the frequencies are.

The base phrases are templates too; all their words are mandatory.

Edge cases: null and empty texts have no words, no labels and score 0; overlapping places of a phrase all count; each row
gives a row, repeated or not; an empty table gives an empty table. A very long text is a slice of its own in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtally.llm import vectors as V
from readtally.llm.shared import SQL_WORDS

ANCHORS, AGREE = 3, 0.8

# The base phrases and their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
# Notices of public licences as (label, text, mandatory key phrases).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["www apache org licenses"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or "
        "in connection with the software or the use or other dealings in the software",
        ["permission is hereby granted free of charge", "the software is provided as is"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all "
        "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
        "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
        ["permission to use copy modify", "the author disclaims all warranties"],
    ),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0-1.0", "released under cc0 1 0 universal", ["cc0 1 0"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
]


@dataclass
class Template:
    label: str
    words: list[str]
    mandatory: np.ndarray  # of the words
    base: bool
    ids: np.ndarray = field(default=None)  # vocabulary numbers


def _templates(base=BASE, templates=TEMPLATES) -> list[Template]:
    out = [Template(label, p.split(), np.ones(len(p.split()), bool), True) for label, p in base]
    for label, text, keys in templates:
        w = text.split()
        must = np.zeros(len(w), bool)
        for k in keys:
            k = k.split()
            at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
            must[at : at + len(k)] = True
        out.append(Template(label, w, must, False))
    return out


def _vocabulary(templates: list[Template]) -> tuple[list[str], np.ndarray]:
    """Words in the order of their hashes, and these."""
    names = sorted({x for t in templates for x in t.words})
    h = np.concatenate([w.hash for w in V.words(pa.array([" ".join(names)]))])
    order = np.argsort(h)
    return [names[i] for i in order], h[order]


def _frequency(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(hashes), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for w in V.words(batch.column("text")):
                v = V.in_sorted(w.hash, hashes)
                pairs = np.unique(w.row[v >= 0] * len(hashes) + v[v >= 0])
                df += np.bincount(pairs % len(hashes), minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(hashes))), pa.array(np.concatenate([[n], df]))], names=["v", "df"])

    return run


@dataclass
class Postings:
    """For each vocabulary number a range of (template, position), rare words only; and the anchors of each template."""

    bounds: np.ndarray
    template: np.ndarray
    position: np.ndarray
    anchors: np.ndarray

    @classmethod
    def of(cls, templates: list[Template], idf: np.ndarray) -> Postings:
        rows = []
        for i, t in enumerate(templates):
            must = sorted(np.flatnonzero(t.mandatory), key=lambda q: (-idf[t.ids[q]], q))[:ANCHORS]
            rows += [(t.ids[q], i, q) for q in must]
        word, template, position = np.array(sorted(rows)).T
        return cls(np.searchsorted(word, np.arange(len(idf) + 1)), template, position, np.bincount(template, minlength=len(templates)))

    def places(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Templates and the words at which they would begin, where all anchors agree. ``v``: vocabulary numbers, -1 for others."""
        at = np.flatnonzero(v >= 0)
        lo, n = self.bounds[v[at]], self.bounds[v[at] + 1] - self.bounds[v[at]]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        begin = np.repeat(at, n) - self.position[entry]
        key, votes = np.unique((self.template[entry] * len(v) + begin)[begin >= 0], return_counts=True)
        template = key // max(len(v), 1)
        full = votes == self.anchors[template]
        return template[full], key[full] % max(len(v), 1)


def _places(w: V.Words, v: np.ndarray, t: Template, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``begins`` at which the template stands, and the share of words that agree."""
    length = len(t.ids)
    begins = begins[begins + length <= len(v)]
    begins = begins[w.row[begins] == w.row[begins + length - 1]]
    if not len(begins):
        return begins, np.empty(0)
    same = v[begins[:, None] + np.arange(length)] == t.ids
    share = same.mean(axis=1)
    good = same[:, t.mandatory].all(axis=1) & (share >= AGREE)
    return begins[good], share[good]


def _scan(templates: list[Template], hashes: np.ndarray, postings: Postings, with_places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n_words, n_base, score = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
            first, last = np.full(m, np.iinfo(np.int64).max), np.full(m, -1, np.int64)
            base: dict[int, set] = {}
            every: dict[int, set] = {}
            spans: dict[int, list] = {}
            for w in V.words(batch.column("text")):
                n_words[w.first : w.first + w.n_rows] = np.diff(w.word_bounds)
                v = V.in_sorted(w.hash, hashes)
                if (v < 0).all():
                    continue
                template, place = postings.places(v)
                for i in np.unique(template):
                    t = templates[i]
                    begins, share = _places(w, v, t, place[template == i])
                    row, at = w.first + w.row[begins], begins - w.word_bounds[w.row[begins]]
                    np.maximum.at(score, row, share)
                    if t.base:
                        np.add.at(n_base, row, 1)
                        np.minimum.at(first, row, at)
                        np.maximum.at(last, row, at)
                    for r in np.unique(row).tolist():
                        every.setdefault(r, set()).add(t.label)
                        if t.base:
                            base.setdefault(r, set()).add(t.label)
                    for r, a in zip(row.tolist(), at.tolist(), strict=True) if with_places else ():
                        spans.setdefault(r, []).append({"label": t.label, "begin": a, "end": a + len(t.ids)})
            none = n_base == 0
            join = lambda d: pa.array([",".join(sorted(d[r])) if r in d else "" for r in range(m)], pa.string())
            cols = [batch.column("doc_id"), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), join(base), join(every), pa.array(score)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            if with_places:
                cols.append(pa.array([spans.get(r, []) for r in range(m)], pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))))
                names.append("places")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def scan(docs: DataFrame, with_places: bool = True) -> DataFrame:
    """For each row of ``docs`` what was found; places, if asked for: label and range of words of each."""
    templates = _templates()
    names, hashes = _vocabulary(templates)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = dict(texts.select("text").mapInArrow(_frequency(hashes), "v long, df long").groupBy("v").agg(F.sum("df")).collect())  # a row for each template word
    total = counted.get(-1, 0)
    idf = np.array([np.log((total + 1) / (counted.get(i, 0) + 1)) for i in range(len(names))])
    number = {x: i for i, x in enumerate(names)}
    for t in templates:
        t.ids = np.array([number[x] for x in t.words])
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    if with_places:
        schema += ", places array<struct<label:string,begin:long,end:long>>"
    return texts.mapInArrow(_scan(templates, hashes, Postings.of(templates, idf), with_places), schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_places=False)


def _oracle() -> str:
    rows = [(i, t.label, t.base, len(t.words), int(t.mandatory.sum()), q, w, bool(t.mandatory[q])) for i, t in enumerate(_templates()) for q, w in enumerate(t.words)]
    values = ", ".join(f"({i}, '{label}', {base}, {n}, {must}, {q}, '{w}', {m})" for i, label, base, n, must, q, w, m in rows)
    return f"""
WITH t(tid, label, base, len, n_must, q, word, must) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
p AS (
  SELECT rid, tid, any_value(label) AS label, any_value(base) AS base, pos - q AS begin_, count(*) / any_value(len) AS share
  FROM w JOIN t USING (word) WHERE pos >= q GROUP BY rid, tid, pos - q
  HAVING count(*) FILTER (must) = any_value(n_must) AND count(*) >= {AGREE} * any_value(len)
), s AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(begin_) FILTER (base) AS first_word, max(begin_) FILTER (base) AS last_word, max(share) AS score,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM p GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN s USING (rid)
"""


ORACLE = _oracle()
