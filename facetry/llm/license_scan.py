"""Fuzzy search for short licence notices.

A text is scanned as its words (A-Z lower-cased, runs of letters, digits and non-ASCII
characters), joined by single blanks. A place of a notice is a run of whole words that
differs from it in up to ``errors_of`` edits (characters changed, added or lost). The words
that tell licences apart (``TELLING``: names, versions, "sa", "nc" ...) admit no edit, or one
if they are long; each stretch between them admits one edit for every
``CHARACTERS_PER_EDIT_OF_PART`` of its characters.

Cut into one piece more than its edits, at least one piece of a notice occurs unchanged
(pigeonhole): an automaton finds all pieces of all notices in one pass, and around each
find the regex library's bounded-error matching decides, counts the edits and gives the
span. Overlapping finds of one notice count once; a notice that is part of a longer one
counts only where the longer one isn't found; of overlapping places of several notices
those that agree best stay. All passes take time in proportion to the text and its finds.

Base places, where a base phrase's words stand exactly, are found by exact search and
always reported.

Edge cases: null and empty texts have no words and no labels; a notice may touch the
text's ends; repeated rows are each returned; a null id is returned as null; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, map_batches, text_bytes

#: Fixed by the contract: phrases whose exact places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices to find with errors, in normal form, and their labels.
NOTICES = {
    "all rights reserved": "reserved",
    "general public license": "gpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "mozilla public license v 2 0": "mpl-2.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under the bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "free and unencumbered software released into the public domain": "unlicense",
    "no rights reserved": "cc0",
    "confidential and proprietary": "proprietary",
    "unauthorized copying of this file": "proprietary",
}
#: Words that tell licences apart: up to four characters admit no edit, longer ones admit one.
TELLING = {
    "all", "no", "gnu", "mit", "bsd", "isc", "sil", "cc", "by", "sa", "nc", "zero", "v", "0", "1", "2", "3", "4",
    "apache", "mozilla", "eclipse", "boost", "lesser", "library", "affero", "free",
}
#: A notice may have an edit for each so many characters, and so may each stretch between telling words.
CHARACTERS_PER_EDIT = 9
CHARACTERS_PER_EDIT_OF_PART = 5

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPAN = "struct<label:string,start:int,stop:int,first_word:int,end_word:int,errors:int>"


@cache
def wider_notices() -> dict[str, set[str]]:
    """Of each notice, the notices that hold it."""
    return {n: {w for w in NOTICES if n != w and n in w} for n in NOTICES}


def errors_of(notice: str) -> int:
    return max(1, len(notice) // CHARACTERS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice cut into errors + 1 parts: (offset, part)."""
    n = errors_of(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def parts_of(notice: str) -> list[tuple[str, int]]:
    """The notice as stretches of words: (stretch, edits it admits)."""
    parts: list[tuple[list[str], bool]] = []
    for word in notice.split():
        if parts and not parts[-1][1] and word not in TELLING:
            parts[-1][0].append(word)
        else:
            parts.append(([word], word in TELLING))
    joined = [(" ".join(words), telling) for words, telling in parts]
    free = lambda part: min(errors_of(notice), max(1, len(part) // CHARACTERS_PER_EDIT_OF_PART))
    return [(part, int(len(part) > 4) if telling else free(part)) for part, telling in joined]


def pattern_of(notice: str) -> regex.Pattern:
    """Matches whole words: the stretches with their edits, single blanks between."""
    inner = " ".join(f"(?:{regex.escape(part)}){{e<={k}}}" if k else regex.escape(part) for part, k in parts_of(notice))
    return regex.compile(f"(?b)(?<= ){inner}(?= )")


@cache
def scanner() -> tuple[ahocorasick.Automaton, list[tuple[str, str, regex.Pattern, int]]]:
    """The automaton over all pieces, and for each notice its label, pattern and edits."""
    rules, found = [], {}
    for notice, label in NOTICES.items():
        for offset, part in pieces(notice):
            found.setdefault(part, []).append((len(rules), offset))
        rules.append((notice, label, pattern_of(notice), errors_of(notice)))
    automaton = ahocorasick.Automaton()
    for part, places in found.items():
        automaton.add_word(part, (len(part), places))
    automaton.make_automaton()
    return automaton, rules


def normal(text: bytes) -> tuple[int, bytes]:
    """(number of words, words between single blanks with a blank at both ends)."""
    words = text.translate(_WORD_TABLE).split()
    return len(words), b" " + b" ".join(words) + b" "


def base_places(flat: bytes) -> list[tuple[int, str]]:
    """(word, label) of every exact place of a base phrase, by word."""
    found = []
    for phrase, label in BASE.items():
        sought = f" {phrase} ".encode()
        at, word, counted = flat.find(sought), 0, 0
        while at >= 0:
            word += flat.count(b" ", counted, at)
            counted = at
            found.append((word, label))
            at = flat.find(sought, at + 1)
    return sorted(found)


def notice_places(flat: str) -> list[tuple[int, int, str, int]]:
    """(start, end, notice, edits) of each notice's places, which don't overlap each other."""
    automaton, rules = scanner()
    starts: dict[int, set[int]] = {}
    for last, (length, places) in automaton.iter(flat):
        for rule, offset in places:
            starts.setdefault(rule, set()).add(last - length + 1 - offset)
    found = []
    for rule, own in starts.items():
        notice, _, pattern, k = rules[rule]
        done = 0
        for start in sorted(own):
            low, high = max(done, start - k), min(len(flat), start + len(notice) + k + 1)
            if high - low < len(notice) - k:
                continue
            match = pattern.search(flat, low, high)
            if match and sum(match.fuzzy_counts) <= k:
                found.append((*match.span(), notice, sum(match.fuzzy_counts)))
                done = match.end()
    return sorted(found)


def fuzzy_places(flat: str) -> list[tuple[int, int, str, int, float]]:
    """(start, end, label, edits, share of the notice that agrees) in the flat text, by
    place. Of overlapping places those of wider notices, and then those that agree best, stay."""
    wider = wider_notices()
    found = notice_places(flat)

    def near(places: list) -> list[list]:
        """Of each place, those that it overlaps: only starts at most one longest place away can."""
        longest = max((x[1] - x[0] for x in places), default=0)
        starts = [x[0] for x in places]
        return [
            [y for y in places[bisect_left(starts, x[0] - longest) : bisect_left(starts, x[1])] if y is not x and y[0] < x[1] and x[0] < y[1]] for x in places
        ]

    found = [x for x, others in zip(found, near(found)) if not any(y[2] in wider[x[2]] for y in others)]
    scored = [(a, b, NOTICES[notice], edits, 1 - edits / len(notice)) for a, b, notice, edits in found]
    return [x for x, others in zip(scored, near(scored)) if not any(y[4] > x[4] for y in others)]


def scan(text: bytes) -> dict:
    """All that a text shows: counts, base places and fuzzy spans."""
    n_words, flat = normal(text)
    base = base_places(flat)
    decoded = flat.decode()
    fuzzy = fuzzy_places(decoded)
    spans = []
    if fuzzy:
        places = [m.span() for m in WORD.finditer(text.translate(ASCII_LOWER).decode())]
        word, counted = -1, 0  # blanks up to a place are the words before it, and one
        for start, end, label, edits, _ in fuzzy:
            inside = decoded[start:end]
            start += len(inside) - len(inside.lstrip(" "))
            end -= len(inside) - len(inside.rstrip(" "))
            word += decoded.count(" ", counted, start)
            counted = start
            last = word + decoded.count(" ", start, end)
            spans.append({"label": label, "start": places[word][0], "stop": places[last][1], "first_word": word, "end_word": last + 1, "errors": edits})
    score = 1.0 if base else max((x[4] for x in fuzzy), default=0.0)
    return {"n_words": n_words, "base": base, "spans": spans, "score": score}


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each of ``docs``: counts of base places, labels, score and fuzzy ``spans``
    (code points of the text, words, edits)."""
    schema = f"{key} bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<{SPAN}>"

    def run(batch: pa.RecordBatch) -> dict:
        found = [scan(t) for t in text_bytes(batch.column(1))]
        base = [sorted({label for _, label in x["base"]}) for x in found]
        return {
            key: batch.column(0),
            "n_words": [x["n_words"] for x in found],
            "n_base": [len(x["base"]) for x in found],
            "first_word": [x["base"][0][0] if x["base"] else None for x in found],
            "last_word": [x["base"][-1][0] if x["base"] else None for x in found],
            "base_labels": [",".join(x) for x in base],
            "labels": [",".join(sorted({*b, *(s["label"] for s in x["spans"])})) for b, x in zip(base, found)],
            "score": [x["score"] for x in found],
            "spans": [x["spans"] for x in found],
        }

    return map_batches(docs.select(F.col(key).cast("long").alias(key), text), schema, run)


def license_digest(docs: DataFrame) -> DataFrame:
    """Contract of op2."""
    shown = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s.label, s.start.cast("string"), s.stop.cast("string"), s.errors.cast("string"))))
    return license_scan(docs).withColumn("spans", shown)
