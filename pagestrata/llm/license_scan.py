"""License notices in whole texts: exact phrases, and fuzzy short notices.

The base counts places where a phrase's words stand consecutively. The fuzzy search splits a notice
with at most ``e`` errors into e + 1 pieces, one of which any such match holds unchanged; an
Aho-Corasick pass over all pieces finds them, and only around those the regex library matches the
whole notice within e edits, checks them and gives the span. Notices too short to bear an edit match
exactly. Nothing depends on other rows, so the plan is one scan.

Null, empty and wordless texts have no places: counts 0, positions null, labels '', score 0. The
score is 1 for a base phrase, else the best notice's share of unchanged characters.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagestrata.llm.common import documents, map_batches, pieces

#: Fixed by the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: Characters of a notice for each edit it may bear.
PER_EDIT, MOST_EDITS = 12, 3

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_line(text: str | None) -> tuple[str, int]:
    """The words of a text between single spaces, one at either end, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass"), len(words)


@lru_cache(maxsize=8)
def _compiled(notices: tuple[tuple[str, str], ...]):
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    rules = []
    for n, (notice, label) in enumerate(notices):
        edits = min(MOST_EDITS, len(notice) // PER_EDIT)
        rules.append((notice, label, edits, regex.compile(f"(?be)(?<= )(?:{regex.escape(notice)}){{e<={edits}}}(?= )")))
        for i in range(edits + 1):
            a, b = len(notice) * i // (edits + 1), len(notice) * (i + 1) // (edits + 1)
            seeds.setdefault(notice[a:b], []).append((n, a))
    machine = ahocorasick.Automaton()
    for seed, where in seeds.items():
        machine.add_word(seed, (len(seed), where))
    machine.make_automaton()
    return machine, rules


def fuzzy_spans(line: str, notices: dict[str, str] = NOTICES) -> list[tuple[int, int, str, int, float]]:
    """(start, end, label, edits, share unchanged) of the notices in a word line, by start; time grows with the line and the seeds in it."""
    machine, rules = _compiled(tuple(notices.items()))
    near: dict[int, list[list[int]]] = {}
    for end, (size, where) in machine.iter(line):
        for n, offset in where:
            notice, _, edits, _ = rules[n]
            at = end + 1 - size - offset  # where the notice would start without edits before the seed
            held = near.setdefault(n, [])
            if held and abs(at - held[-1][0]) <= 2 * edits:
                held[-1][1] = max(held[-1][1], at)
            else:
                held.append([at, at])
    found = set()
    for n, places in near.items():
        notice, label, edits, rule = rules[n]
        for a, b in places:
            for m in rule.finditer(line, max(0, a - 3 * edits - 1), min(len(line), b + len(notice) + edits + 1)):
                made = sum(m.fuzzy_counts)
                found.add((m.start(), m.end(), label, made, 1 - made / len(notice)))
    return _fewest(sorted(found))


def _fewest(spans: list) -> list:
    """Of places that overlap, the ones with the fewest edits: a place goes if one with fewer edits overlaps it."""
    out = [s for s in spans if s[3] == 0]
    for edits in range(1, MOST_EDITS + 1):
        better = sorted((s[0], s[1]) for s in spans if s[3] < edits)
        starts = [a for a, _ in better]
        ends = list(accumulate((b for _, b in better), max))  # the furthest end of all that start as early
        for s in spans:
            i = bisect_left(starts, s[1])
            if s[3] == edits and not (i and ends[i - 1] > s[0]):
                out.append(s)
    return sorted(out)


def word_numbers(line: str, places: list[int]) -> dict[int, int]:
    """The blanks before each place, in one walk along the line."""
    out, at, n = {}, 0, 0
    for place in sorted(set(places)):
        n += line.count(" ", at, place)
        out[place], at = n, place
    return out


def scan(text: str | None, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> dict:
    line, n = word_line(text)
    places, base = [], set()
    for phrase, label in phrases.items():
        at = line.find(padded := f" {phrase} ")
        if at >= 0:
            base.add(label)
        while at >= 0:
            places.append(at)
            at = line.find(padded, at + 1)
    spans = fuzzy_spans(line, notices) if n else []
    number = word_numbers(line, places + [p for s in spans for p in s[:2]])
    starts = [number[p] for p in places]
    score = 1.0 if starts else max((s[4] for s in spans), default=0.0)
    return {
        "n_words": n, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s[2] for s in spans})), "score": score,
        "spans": [{"label": s[2], "first_word": number[s[0]] - 1, "n_words": number[s[1]] - number[s[0]] + 1, "edits": s[3]} for s in spans],
    }


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,edits:long>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())]))
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPANS}


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each of ``docs``: the key and what scan() finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, 4 << 20):
                rows = [scan(x.as_py(), phrases, notices) for x in part.column(text)]
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array([r[c] for r in rows], t) for c, t in _TYPES.items())], [key, *_TYPES])

    return map_batches(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, {_SCHEMA}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


QUERIES = {"op3_license_scan": op3_license_scan}
SQL: dict[str, str] = {}
