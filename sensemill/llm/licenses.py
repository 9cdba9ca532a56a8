"""License scans by a positional index of rare words.

Templates are licence texts and notices, cut in passages where holders, years or lists vary. The corpus
gives each of their words its document frequency. A passage is posted (word, passage, place) under its
rarest words only, so many of them that a text which matches it must hold some in their places. A text
looks up those of its own words that are posted, its licence words of highest IDF; each posting proposes
that the passage stands so many words before. Proposals that agree within a few words intersect, and each that
has enough agreement is verified: its words in order, with the template's mandatory key phrase among them. Of
templates that lie one inside the other, the one with most words in place names the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import map_arrow

#: Phrases and the label that each gives wherever its words stand in a row.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label, the phrase that must stand in its place, and the passages, in lower case without marks.
TEMPLATES = [
    ("mit", "free of charge", ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"]),
    ("bsd", "source and binary forms", ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"]),
    ("apache", "in compliance with the license", ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"]),
    ("gpl", "free software", ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"]),
    ("lgpl", "lesser general public license", ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"]),
    ("agpl", "affero general public license", ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"]),
    ("mpl", "mozilla public license", ["this source code form is subject to the terms of the mozilla public license v 2 0"]),
    ("cc-by", "creative commons attribution", ["this work is licensed under a creative commons attribution 4 0 international license"]),
    ("cc0", "public domain", ["the person who associated a work with this deed has dedicated the work to the public domain"]),
    ("isc", "with or without fee", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("unlicense", "unencumbered software", ["this is free and unencumbered software released into the public domain"]),
    ("zlib", "altered source versions", [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        "this notice may not be removed or altered from any source distribution"]),
    ("mit", "free of charge", [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"]),
    ("bsd-2-clause", "source and binary forms", [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"]),
    ("bsd-3-clause", "endorse or promote products", [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"]),
    ("isc", "with or without fee", [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"]),
    ("unlicense", "unencumbered software", [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"]),
    ("apache", "derivative works", [
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work",
        "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions"]),
    ("gpl-2", "general public license", [
        "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"]),
    ("gpl-3", "general public license", [
        "the licenses for most software and other practical works are designed to take away your freedom to share and change the works by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users"]),
    ("lgpl", "lesser general public license", [
        "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licenses are intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
        "this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it"]),
    ("mpl", "covered software", [
        "each individual or legal entity that creates contributes to the creation of or owns covered software"]),
]
#: A passage is found where MATCHED of its words stand in their order and each at most SLIP words later than the first one's place
#: says, which allows for words put in or left out; a template where its found passages' words are MATCHED of all. So many of a
#: passage's rarest words are posted that AGREE of them at least are among those words wherever it is found, however long it is.
MATCHED, AGREE, SLIP = 0.8, 3, 8

#: Words are digits, letters and everything beyond ASCII; A-Z count as a-z.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = K.byte_table(_SEPARATORS, lower=True)


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return K.split(raw, np.array([0, len(raw)]), _TABLE).hash


class Index:
    """The passages' distinct words in order of their hash, and numbers in place of words; equal passages are one."""

    def __init__(self) -> None:
        texts = sorted({p for _, _, passages in TEMPLATES for p in passages})
        passages, phrases = [_hashes(t) for t in texts], [_hashes(p) for p in PHRASES]
        self.words = np.unique(np.concatenate([*passages, *phrases]))
        self.passages, self.phrases = ([self.number(h) for h in x] for x in (passages, phrases))
        self.bits = []  # of each passage, the places of a word as bits
        for words in self.passages:
            bits: dict[int, int] = {}
            for i, w in enumerate(words.tolist()):
                bits[w] = bits.get(w, 0) | 1 << i
            self.bits.append(bits)
        self.templates = []  # label, its passages, the one with its key phrase, and this phrase's words
        for label, key, own in TEMPLATES:
            held = next(p for p in own if f" {key} " in f" {p} ")
            self.templates.append((label, [texts.index(p) for p in own], texts.index(held), self.number(_hashes(key))))

    def number(self, h: np.ndarray) -> np.ndarray:
        """-1 for words of no template."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def post(self, df: np.ndarray) -> None:
        """Postings of the rarest words: word w's are passage[first[w]:first[w + 1]] and place of the same."""
        posted = []
        for p, words in enumerate(self.passages):
            rare = sorted(range(len(words)), key=lambda i: (df[words[i]], i))[: len(words) - int(np.ceil(MATCHED * len(words))) + AGREE]
            posted += [(int(words[i]), p, i) for i in rare]
        word, self.passage, self.place = np.array(sorted(posted)).T
        self.first = np.searchsorted(word, np.arange(len(self.words) + 1))

    def in_order(self, p: int, words: np.ndarray) -> int:
        """How many of passage p's words stand in words in their order (longest common subsequence, a bit for each place)."""
        bits, full = self.bits[p], (1 << len(self.passages[p])) - 1
        open_ = full
        for w in words.tolist():
            new = open_ & bits.get(w, 0)
            if new:
                open_ = ((open_ + new) | (open_ - new)) & full
        return (full & ~open_).bit_count()

    def proposed(self, no: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, passage, and the stretch of words that should hold the passage: where AGREE postings start within SLIP words."""
        at = np.flatnonzero(no >= 0)
        n = np.diff(self.first)[no[at]]
        at, n = at[n > 0], n[n > 0]
        row = np.repeat(self.first[no[at]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        pos, passage = np.repeat(at, n), self.passage[row]
        text = np.searchsorted(first, pos, "right") - 1
        vote, votes = np.unique(np.column_stack([text * len(self.passages) + passage, pos - self.place[row]]), axis=0, return_counts=True)
        of, start = vote[:, 0], vote[:, 1]
        line = (of << 40) + start + (1 << 20)  # ascends, and starts of other texts or passages lie far apart
        total = np.r_[0, np.cumsum(votes)]
        enough = total[np.searchsorted(line, line + SLIP, "right")] - total[:-1] >= AGREE
        group: tuple[int, int, int] | None = None
        for g, s in [*zip(of[enough].tolist(), start[enough].tolist()), (-1, 0)]:
            if group and (group[0] != g or s - group[1] > SLIP):
                t, p = divmod(group[0], len(self.passages))
                yield t, p, max(group[1], int(first[t])), min(group[2] + SLIP + len(self.passages[p]), int(first[t + 1]))
                group = None
            group = (g, group[1], s) if group else (g, s, s)

    def found(self, no: np.ndarray, first: np.ndarray) -> list[tuple[int, str, float]]:
        """Texts no[first[t]:first[t + 1]] of word numbers: text, label and share of each template in it that none found larger holds."""
        places: dict[int, dict[int, list[tuple[int, int, int]]]] = {}  # text, passage: stretches and their words in order
        for t, p, a, b in self.proposed(no, first):
            words = self.in_order(p, no[a:b])
            if words >= MATCHED * len(self.passages[p]) - 1e-9:
                known = places.setdefault(t, {}).setdefault(p, [])
                if known and a < known[-1][0] + len(self.passages[p]) // 2:  # the same place once more
                    known[-1] = max(known[-1], (a, b, words), key=lambda x: x[2])
                else:
                    known.append((a, b, words))
        out = []
        for t, got in places.items():
            whole = []  # label, share, words in order, stretches with the key phrase, all stretches
            for label, own, held, key in self.templates:
                keyed = [x for x in got.get(held, []) if _holds(no[x[0] : x[1]], key)]
                words = sum(max(x[2] for x in (keyed if p == held else got[p])) for p in own if p in got and (keyed or p != held))
                share = words / sum(len(self.passages[p]) for p in own)
                if keyed and share >= MATCHED - 1e-9:
                    whole.append((label, share, words, keyed, [x for p in own for x in got.get(p, [])]))
            out += [(t, x[0], x[1]) for x in whole if not any(_inside(x, y) for y in whole)]
        return out


def _holds(words: np.ndarray, phrase: np.ndarray) -> bool:
    size = len(words) - len(phrase) + 1
    return size > 0 and bool(np.logical_and.reduce([words[i : i + size] == w for i, w in enumerate(phrase)]).any())


def _inside(x: tuple, y: tuple) -> bool:
    """Template x, found, is a part of template y: y has more words in order, stands as often, and wherever x does."""
    if y[2] <= x[2] or len(y[3]) < len(x[3]):
        return False
    return all(any(a >= c - 2 * SLIP and b <= d + 2 * SLIP for c, d, _ in y[4]) for a, b, _ in x[3])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = Index()
    df = np.zeros(len(index.words), np.int64)
    for batch in batches:
        for _, data, offsets in K.pieces(batch.column("text")):
            words = K.split(data, offsets, _TABLE)
            no = index.number(words.hash)
            seen = np.unique(words.text_of_word()[no >= 0] * len(df) + no[no >= 0])
            df += np.bincount(seen % len(df), minlength=len(df))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df), dtype=np.int32)), pa.array(df)], ["word", "df"])


def frequencies(docs: DataFrame) -> np.ndarray:
    """Document frequencies of the templates' words over all of docs: one row for each (some 300) comes to the driver."""
    rows = map_arrow(docs.select(F.col("text").cast("string").alias("text")), _frequencies, "word int, df long").groupBy("word").agg(F.sum("df").alias("df"))
    df = np.zeros(len(Index().words), np.int64)
    for r in rows.collect():
        df[r["word"]] = r["df"]
    return df


def _scanner(df: np.ndarray):
    labels = list(PHRASES.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index()
        index.post(df)
        for batch in batches:
            out: list[tuple] = []
            for part, data, offsets in K.pieces(batch.column("text")):
                words = K.split(data, offsets, _TABLE)
                no, of = index.number(words.hash), words.text_of_word()
                texts = len(offsets) - 1
                n, first, last = np.zeros(texts, np.int64), np.full(texts, np.iinfo(np.int64).max), np.full(texts, -1)
                has: list[set[str]] = [set() for _ in range(texts)]
                for phrase, label in zip(index.phrases, labels):
                    size = len(no) - len(phrase) + 1
                    if size <= 0:
                        continue
                    hit = of[:size] == of[len(phrase) - 1 :]
                    for i, w in enumerate(phrase):
                        hit &= no[i : i + size] == w
                    at = np.flatnonzero(hit)
                    text = of[at]
                    place = at - words.first[text]
                    n += np.bincount(text, minlength=texts)
                    np.minimum.at(first, text, place)
                    np.maximum.at(last, text, place)
                    for x in np.unique(text):
                        has[x].add(label)
                more = [set(h) for h in has]
                score = np.where(n > 0, 1.0, 0.0)
                for x, label, share in index.found(no, words.first):
                    more[x].add(label)
                    score[x] = max(score[x], share)
                for x in range(texts):
                    some = n[x] > 0
                    out.append((int(words.counts[x]), int(n[x]), int(first[x]) if some else None, int(last[x]) if some else None, ",".join(sorted(has[x])), ",".join(sorted(more[x])), float(score[x])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    return run


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License text in docs (doc_id, text): a row for each row of docs with

    doc_id, n_words, n_base (places of the fixed phrases), first_word and last_word (their smallest and
    largest start, null without), base_labels, labels (with those of matched templates), score (1 with
    a phrase, else the largest share of a matched template's words that stand in order, else 0). A notice, a whole
    text and a short form of one licence share its label; a template inside a larger one that is found as often names nothing.

    A null or empty text has no words and no labels. Rows that repeat a doc_id are scanned each by its
    own text. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = rows.select("doc_id").schema
    for name, kind in (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")):
        schema = schema.add(name, kind)
    return map_arrow(rows, _scanner(frequencies(rows)), schema)
