r"""License notices: exact phrases, and short notices found with a bounded number of edits.

Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z; a text is searched as its words
joined by single spaces. A notice with room for k edits is cut into k + 1 pieces: one of them must occur
unchanged wherever the notice occurs with at most k edits (pigeonhole), so an automaton over all pieces finds
every candidate place, and the regex library's bounded-error match around it decides. Words that tell one
notice from another (versions, ``nc``) must stand unchanged. Of overlapping notice matches the one with the
lowest share of edits stays.

Whole texts, null as empty; an empty text has no words and no hits. Ties and repeated rows are scanned
alike. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, whole_text

#: Exact phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    #: words that must stand unchanged
    keys: tuple[str, ...] = ()
    #: one edit per so many characters
    chars_per_edit: int = 18

    @property
    def edits(self) -> int:
        return max(1, len(self.text) // self.chars_per_edit)

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): one more than there may be edits."""
        n, k = len(self.text), self.edits + 1
        cuts = [round(i * n / k) for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


NOTICES = (
    Notice("gpl-2.0", "gnu general public license version 2", ("2",)),
    Notice("gpl-3.0", "gnu general public license version 3", ("3",)),
    Notice("lgpl", "gnu lesser general public license", ("lesser",)),
    Notice("agpl-3.0", "gnu affero general public license", ("affero",)),
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("2", "0")),
    Notice("mit", "released under the mit license", ("mit",)),
    Notice("mit", "licensed under the mit license", ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("mpl-2.0", "subject to the terms of the mozilla public license", ("mozilla",)),
    Notice("cc-by-4.0", "licensed under cc by 4 0", ("by", "4", "0")),
    Notice("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("by", "nc", "4", "0")),
    Notice("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("by", "sa", "4", "0")),
    Notice("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("by", "nd", "4", "0")),
    Notice("all-rights-reserved", "all rights reserved"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
)

HIT = "struct<label:string,method:string,start:int,end:int,word:int,n_words:int,edits:int,score:double>"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Scanner:
    """Finds phrases and notices in one text; one per Python worker."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        import ahocorasick
        import regex

        self.phrases, self.notices = phrases, notices
        self.word = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        self.exact = [(regex.compile(rf"(?<![^ ]){regex.escape(p)}(?![^ ])"), label, p.count(" ") + 1) for p, label in phrases]
        self.fuzzy = [regex.compile(rf"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in notices]
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, piece in notice.pieces():
                places.setdefault(piece, []).append((k, offset))
        for phrase, _ in phrases:
            places.setdefault(phrase, [])
        for piece, at in places.items():
            self.seeds.add_word(piece, (len(piece), at))
        self.seeds.make_automaton()

    def candidates(self, line: str) -> tuple[bool, set[tuple[int, int]]]:
        """Whether any seed occurs, and (notice, where it would begin)."""
        found, places = False, set()
        for end, (length, at) in self.seeds.iter(line):
            found = True
            places.update((k, end + 1 - length - offset) for k, offset in at)
        return found, places

    def notice_matches(self, line: str, places: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in the joined words, best of overlapping ones."""
        found: dict[tuple[int, int, int], int] = {}
        for k, begin in sorted(places):
            notice = self.notices[k]
            room = 2 * notice.edits
            lo = max(0, begin - room)
            hi = begin + len(notice.text) + room
            start = line.find(notice.text, lo, hi)
            if start >= 0:  # no edit: nothing to verify
                end, edits = start + len(notice.text), 0
            else:
                m = self.fuzzy[k].search(line, lo, hi)
                if m is None:
                    continue
                (start, end), edits = m.span(), sum(m.fuzzy_counts)
            got = line[line.rfind(" ", 0, start + 1) + 1 : (line.find(" ", end) if line.find(" ", end) >= 0 else len(line))].split(" ")
            if all(got.count(key) >= notice.keys.count(key) for key in notice.keys):
                found[k, start, end] = edits
        ranked = sorted((edits / len(self.notices[k].text), start, k, end, edits) for (k, start, end), edits in found.items())
        kept: list[tuple[int, int, int, int]] = []  # by start, none overlapping
        for _, start, k, end, edits in ranked:
            at = bisect_left(kept, (start, end), key=lambda h: h[1:3])
            if (at == 0 or kept[at - 1][2] <= start) and (at == len(kept) or end <= kept[at][1]):
                kept.insert(at, (k, start, end, edits))
        return kept

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of words; hits with code-point spans in the text."""
        split = text.encode().translate(_LOWER).split()
        line = b" ".join(split).decode()
        any_seed, places = self.candidates(line)
        if not any_seed:
            return len(split), []
        raw = [(label, "phrase", m.start(), m.end(), 0, 1.0) for pattern, label, _ in self.exact for m in pattern.finditer(line)]
        for k, start, end, edits in self.notice_matches(line, places):
            notice = self.notices[k]
            raw.append((notice.label, "notice", start, end, edits, 1 - edits / len(notice.text)))
        if not raw:
            return len(split), []
        spans = [m.span() for m in self.word.finditer(text)]
        begins = [0, *accumulate(len(w.decode()) + 1 for w in split)]  # of each word in the joined line
        hits = []
        for label, method, start, end, edits, score in sorted(raw, key=lambda r: (r[2], r[3], r[1], r[0])):
            first = bisect_right(begins, start) - 1
            if line[start] == " ":
                first += 1
            last = max(first, bisect_left(begins, end) - 1)
            hits.append({"label": label, "method": method, "start": spans[first][0], "end": spans[last][1], "word": first, "n_words": last - first + 1, "edits": edits, "score": score})
        return len(split), hits


_SCANNERS: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, hits (label, method, code-point span, first word, words, edits, score); a narrow stage."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _SCANNERS.setdefault((phrases, notices), None) or Scanner(phrases, notices)
        _SCANNERS[phrases, notices] = scanner
        kind = pa.list_(pa.struct([("label", pa.string()), ("method", pa.string()), *((n, pa.int32()) for n in ("start", "end", "word", "n_words", "edits")), ("score", pa.float64())]))
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], kind)],
                names=["doc_id", "n_words", "hits"],
            )

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return frame.mapInArrow(run, f"doc_id long, n_words long, hits array<{HIT}>")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts and labels per document."""
    base = F.filter("hits", lambda h: h["method"] == "phrase")
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["word"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["word"])).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["label"], h["start"], h["end"])), ",").alias("spans"),
    )
