"""License notices in texts: exact seeds locate candidates, bounded-error matching verifies them.

A notice of m characters may differ by k edits. Cut into k + 1 pieces, at least one
piece of every true match is unchanged (pigeonhole), so one Aho-Corasick pass over
the pieces of all notices finds every candidate place. Only there does the regex
library look for the notice with at most k errors, between word ends.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from evenhand.llm.common import Batches, lower_words, texts


class Notice(NamedTuple):
    label: str
    words: str
    base: bool = False


#: Short notices as lower-case words, and the label that each stands for.
NOTICES = (
    Notice("mit", "mit license", True),
    Notice("apache", "apache license", True),
    Notice("gpl", "general public license", True),
    Notice("mit", "mit licence"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Notice("apache", "licensed under the apache license version 2 0"),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("agpl", "gnu affero general public license"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("mpl", "mozilla public license"),
    Notice("cc", "licensed under cc by"),
    Notice("cc", "creative commons attribution"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
    Notice("boost", "boost software license"),
    Notice("reserved", "all rights reserved"),
)
#: One edit is allowed for so many characters of a notice.
CHARACTERS_PER_EDIT = 12
#: Words of a text before A-Z are folded.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = "label string, base boolean, start bigint, end bigint, first_word bigint, last_word bigint, errors int, fit double"


class Found(NamedTuple):
    notice: int
    start: int
    end: int
    errors: int


class Searcher:
    """All notices, ready to search texts of single-spaced lower-case words with a space at both ends."""

    def __init__(self, notices: tuple[Notice, ...], characters_per_edit: int):
        import ahocorasick
        import regex

        self.notices = notices
        self.edits = [len(notice.words) // characters_per_edit for notice in notices]
        self.patterns: list[Any] = [
            regex.compile(rf"(?e)(?<= )(?:{re.escape(notice.words)}){{e<={k}}}(?= )") if k else None
            for notice, k in zip(notices, self.edits)
        ]
        seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (notice, k) in enumerate(zip(notices, self.edits)):
            cuts = [len(notice.words) * i // (k + 1) for i in range(k + 2)]
            for start, end in zip(cuts, cuts[1:]):
                seeds[notice.words[start:end]].append((at, start))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[Found]:
        """Exact places of each notice, and elsewhere its closest places with few errors."""
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (length, places) in self.automaton.iter(text):
            for at, offset in places:
                starts[at].add(last + 1 - length - offset)
        found = []
        for at, places in starts.items():
            words, k = self.notices[at].words, self.edits[at]
            exact = [s for s in places if s > 0 and text.startswith(f" {words} ", s - 1)]
            found += [Found(at, s, s + len(words), 0) for s in exact]
            if k:
                found += self.close(at, text, sorted(places), sorted(exact), len(words), k)
        return found

    def close(self, at: int, text: str, places: list[int], exact: list[int], length: int, k: int) -> Iterator[Found]:
        """Matches with 1 to k errors around the places, outside the exact matches."""
        windows: list[list[int]] = []
        for place in places:
            nearest = bisect_right(exact, place + length - 1)
            if nearest and exact[nearest - 1] > place - length:
                continue
            low, high = max(0, place - k - 1), place + length + k + 1
            if windows and low <= windows[-1][1]:
                windows[-1][1] = high
            else:
                windows.append([low, high])
        for low, high in windows:
            for match in self.patterns[at].finditer(text, low, high):
                if match.end() > match.start():
                    yield Found(at, match.start(), match.end(), sum(match.fuzzy_counts))


def license_spans(
    docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, characters_per_edit: int = CHARACTERS_PER_EDIT
) -> DataFrame:
    """``(doc_id, n_words, spans)`` for every row of ``docs(doc_id, text)``, from the whole text.

    A span has its label, whether its notice is a base phrase, its characters (code points of
    the original text, end exclusive), its first and last word (from 0), the number of edits,
    and ``fit``, one less the share of edited characters. Spans are ordered by place. A null text counts as
    empty, an empty text has no words and no spans, a null doc_id stays null, repeated
    rows give repeated rows, an empty table gives no rows, and other columns are not read. A text is
    searched whole, however long, in one task. Of overlapping near matches of a notice the one with the fewest
    edits counts, then the first; matches of different notices may overlap.
    """

    def scan(batches: Batches) -> Batches:
        searcher = Searcher(notices, characters_per_edit)
        for batch in batches:
            counts, spans = [], []
            for whole in texts(batch.column("text")):
                words = lower_words(whole)
                counts.append(len(words))
                joined = f" {b' '.join(words).decode()} "
                found = searcher.find(joined)
                spans.append(described(found, whole.decode(), joined) if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, SPANS)],
                ["doc_id", "n_words", "spans"],
            )

    def described(found: list[Found], whole: str, joined: str) -> list[dict]:
        begins = [at for at, c in enumerate(joined[:-1]) if c == " "]
        places = [match.span() for match in WORD.finditer(whole)]
        rows = []
        for hit in found:
            first, last = bisect_right(begins, hit.start - 1) - 1, bisect_right(begins, hit.end - 1) - 1
            notice = notices[hit.notice]
            rows.append(
                {
                    "label": notice.label,
                    "base": notice.base,
                    "start": places[first][0],
                    "end": places[last][1],
                    "first_word": first,
                    "last_word": last,
                    "errors": hit.errors,
                    "fit": max(0.0, 1 - hit.errors / len(notice.words)),
                }
            )
        return sorted(rows, key=lambda row: (row["first_word"], row["last_word"], row["label"], row["errors"]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


SPANS = pa.list_(
    pa.struct(
        [
            ("label", pa.string()),
            ("base", pa.bool_()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("errors", pa.int32()),
            ("fit", pa.float64()),
        ]
    )
)
