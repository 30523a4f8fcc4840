"""License scans: exact phrases, and fuzzy search for short notices.

Fuzzy search. A notice of n characters may differ in k edits. Cut into k + 1 pieces, at least one piece of any match is
unchanged (pigeonhole), so an automaton over all pieces of all notices finds every place where a match can be, in one
pass over the text. The regex library's bounded-error matching then verifies the edits there and gives the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillet.llm.common import keyed

#: Phrases whose words must stand one after the other, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices by label, as words; well-known first sentences and names of public licenses.
NOTICES = {
    "apache": ["licensed under the apache license version 2 0"],
    "boost": ["distributed under the boost software license version 1 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd 3 clause license", "released under the bsd 2 clause license"],
    "cc-by": ["creative commons attribution 4 0 international", "licensed under cc by 4 0"],
    "cc-by-nc": ["creative commons attribution noncommercial 4 0 international", "licensed under cc by nc 4 0"],
    "cc0": ["creative commons zero v1 0 universal", "no rights reserved cc0 1 0 universal public domain dedication"],
    "cc-by-sa": ["creative commons attribution sharealike 4 0 international", "licensed under cc by sa 4 0"],
    "epl": ["made available under the terms of the eclipse public license"],
    "gpl": ["licensed under the gnu general public license version", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the gnu lesser general public license version"],
    "agpl": ["licensed under the gnu affero general public license version"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software", "released under the mit license", "licensed under the mit license"],
    "mpl": ["subject to the terms of the mozilla public license v 2 0"],
    "wtfpl": ["do what the fuck you want to public license"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
RESULT = "rid bigint, doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,start:bigint,stop:bigint,errors:int>>"
#: What isn't a word byte becomes a space; A to Z become small; UTF-8 bytes above ASCII stay.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def errors_allowed(notice: str, rate: float = 0.08) -> int:
    """At least one edit; 0.08: one for each dozen of characters, which keeps a piece long enough to be rare."""
    return max(1, int(len(notice) * rate))


def pieces_of(notice: str, errors: int) -> list[tuple[str, int]]:
    """errors + 1 pieces of about the same length that make up the notice, with their offsets."""
    n, k = len(notice), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    """All notices' pieces in one automaton, and a bounded-error pattern for each notice."""

    def __init__(self, notices: dict[str, list[str]], rate: float):
        import ahocorasick
        import regex

        self.notices = [(label, x, errors_allowed(x, rate)) for label, xs in notices.items() for x in xs]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(x)}){{e<={k}}}") for _, x, k in self.notices]
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (_, x, k) in enumerate(self.notices):
            for piece, at in pieces_of(x, k):
                seeds.setdefault(piece, []).append((i, at))
        for piece, where in seeds.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, i: int, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of notice i between a and b: the best match, and then what is left of it and right of it."""
        _, notice, allowed = self.notices[i]
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            if b - a < len(notice) - allowed or not (m := self.patterns[i].search(text, a, b)):
                continue
            out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            todo += [(a, m.start()), (m.end(), b)]
        return out

    def search(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, score) of each match, in order; of overlapping matches of two labels the better one."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, at in where:
                k, n = self.notices[i][2], len(self.notices[i][1])
                a = max(0, end + 1 - size - at - k)
                b = a + n + 2 * k
                mine = windows.setdefault(i, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][:] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
                else:
                    mine.append([a, b])
        found = []
        for i, spans in windows.items():
            label, notice, _ = self.notices[i]
            for a, b in spans:
                found += [(label, start, end, edits, 1 - edits / len(notice)) for start, end, edits in self.matches(i, text, a, min(b, len(text)))]
        best: list[tuple] = []  # where notices of two labels match one place, the one with fewer edits, then the longer
        for x in sorted(found, key=lambda x: (x[3], x[1] - x[2], x[0])):
            if all(x[0] == y[0] or x[2] <= y[1] or y[2] <= x[1] for y in best):
                best.append(x)
        return sorted(best, key=lambda x: x[1:3])


def places(words: bytes, phrase: str) -> list[int]:
    """Word numbers where the phrase starts; words: all of a text, with one space before, between and after."""
    sought, out, at, n, last = f" {phrase} ".encode(), [], -1, 0, 0
    while (at := words.find(sought, at + 1)) >= 0:
        n += words.count(b" ", last, at)
        last = at
        out.append(n)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES, rate: float = 0.08) -> DataFrame:
    """One row per row of docs: the columns of RESULT.

    Whole texts are read, A to Z in lower case; words are runs of 0-9, a-z and characters beyond ASCII. Null and empty
    texts have no words and no labels. spans: the fuzzy matches, as words (first and last) and as characters of the
    text (start, stop). score: the best match's share of unchanged characters, 1 for a phrase, 0 without any.
    labels: those of phrases and of notices, distinct, sorted, comma-joined. Equal rows give equal rows.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col).selectExpr("rid", "cast(doc_id as bigint) doc_id", "cast(text as string) text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(notices, rate)
        struct = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("errors", pa.int32())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(struct)]
        names = [x.split()[0] for x in RESULT.split(", ")][2:10]
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                out = [one(searcher, t or "") for t in batch.column("text").to_pylist()]
                cols = {n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
                yield pa.RecordBatch.from_pydict({"rid": batch.column("rid"), "doc_id": batch.column("doc_id")} | cols)

    def one(searcher: Searcher, text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
        words = [w for w in words if w]
        joined = b" ".join(words)
        padded = b" " + joined + b" "
        starts, base = [], set()
        for phrase, label in phrases.items():
            if at := places(padded, phrase):
                starts += at
                base.add(label)
        found, spans = searcher.search(plain := joined.decode("utf-8", "surrogatepass")), []
        if found:
            where = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
            for label, a, b, edits, _ in found:
                first = plain.count(" ", 0, a) + (plain[a] == " ")
                last = plain.count(" ", 0, b) - (plain[b - 1] == " ")
                spans.append({"label": label, "first_word": first, "last_word": last, "start": where[first][0], "stop": where[last][1], "errors": edits})
        score = 1.0 if base else max((x[4] for x in found), default=0.0)
        labels = ",".join(sorted(base | {x[0] for x in found}))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), labels, score, spans

    return rows.mapInArrow(look, RESULT)


_LOWER = {c: c + 32 for c in range(65, 91)}
