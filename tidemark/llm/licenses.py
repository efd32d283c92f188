"""License scan by ordered signature rules over the words of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pieces_of, raw_texts

#: Phrases whose places are counted unless others are given, and their labels.
BASE = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Bytes of words stay (A-Z in lower case), all others become spaces.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)

# label stem | keywords, one of which must occur | how the name is written in words | versions
_FAMILIES = """
apache | apache | apache(?: software)? | 1.0 1.1 2.0
gpl | general public/gpl | (?:gnu )?(?:general public|gpl) | 1.0 2.0 3.0
lgpl | lesser general/library general/lgpl | (?:gnu )?(?:(?:lesser|library) general public|lgpl) | 2.0 2.1 3.0
agpl | affero/agpl | (?:gnu )?(?:affero general public|agpl) | 1.0 3.0
gfdl | free documentation/fdl | (?:gnu )?(?:free documentation|gfdl|fdl) | 1.1 1.2 1.3
mpl | mozilla/mpl | (?:mozilla public|mpl) | 1.0 1.1 2.0
epl | eclipse/epl | (?:eclipse public|epl) | 1.0 2.0
cpl | common public | common public | 1.0
cddl | common development/cddl | (?:common development and distribution|cddl) | 1.0 1.1
eupl | european union/eupl | (?:european union public|eupl) | 1.0 1.1 1.2
bsl | boost | boost(?: software)? | 1.0
artistic | artistic | artistic | 1.0 2.0
ofl | open font/ofl | (?:sil )?(?:open font|ofl) | 1.0 1.1
osl | open software | open software | 1.0 2.0 2.1 3.0
afl | academic free | academic free | 1.1 1.2 2.0 2.1 3.0
php | php | php | 3.0 3.01
zpl | zope | zope public | 1.1 2.0 2.1
lppl | latex | latex project public | 1.0 1.1 1.2 1.3
odbl | open database/odbl | (?:open database|odbl) | 1.0
odc-by | open data commons | open data commons attribution | 1.0
cc-by | creative commons/cc by | (?:creative commons attribution|cc by) | 1.0 2.0 2.5 3.0 4.0
cc-by-sa | creative commons/cc by | (?:creative commons attribution share ?alike|cc by sa) | 1.0 2.0 2.5 3.0 4.0
cc-by-nd | creative commons/cc by | (?:creative commons attribution no ?deriv\\w*|cc by nd) | 1.0 2.0 2.5 3.0 4.0
cc-by-nc | creative commons/cc by | (?:creative commons attribution non ?commercial|cc by nc) | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-sa | creative commons/cc by | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa) | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-nd | creative commons/cc by | (?:creative commons attribution non ?commercial no ?deriv\\w*|cc by nc nd) | 1.0 2.0 2.5 3.0 4.0
cc0 | creative commons zero/cc0 | (?:creative commons zero|cc0) | 1.0
mit | mit/expat | (?:mit|expat) |
x11 | x11 | x11 |
isc | isc | isc |
bsd | bsd | bsd |
bsd-2-clause | bsd/freebsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) |
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) |
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|original bsd) |
zlib | zlib | (?:zlib|zlib libpng) |
libpng | libpng | libpng |
unlicense | unlicense | unlicense |
wtfpl | wtf | (?:wtfpl|do what the fuck you want to public) |
psf | python/psf | (?:python software foundation|psf) |
postgresql | postgresql | postgresql |
openssl | openssl | openssl |
ms-pl | microsoft | microsoft public |
ms-rl | microsoft | microsoft reciprocal |
ncsa | ncsa/illinois | (?:ncsa|university of illinois open source) |
upl | universal permissive/upl | (?:universal permissive|upl) |
vim | vim | vim |
w3c | w3c | w3c(?: software)? |
ruby | ruby | ruby |
json | json | json |
curl | curl | curl |
qpl | q public/qpl | (?:q public|qpl) |
beerware | beerware | beerware |
"""

# form | priority (lower is better) | confidence | wording around the name; {n} is the name, {v} the version
_FORMS = """
tag | 0 | 1.0 | spdx license identifier {n}{v}
grant | 1 | 0.95 | (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{n}(?: public)?(?: licen[sc]e)?{v}
title | 2 | 0.85 | {n}(?: international| unported)? licen[sc]e{v}
bare | 3 | 0.7 | (?<=under ){n}{v}
"""

_BSD = "redistribution and use in source and binary forms"
# hand-written: label | priority | confidence | keyword | words of a licence's body or notice that need not name it
_SIGNATURES = rf"""
mit | 1 | 0.95 | hereby granted | permission is hereby granted free of charge to any person obtaining a copy
bsl-1.0 | 1 | 0.95 | hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy
isc | 1 | 0.95 | hereby granted | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
postgresql | 1 | 0.95 | hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
bsd-4-clause | 0 | 0.95 | advertising materials | {_BSD} (?:\S+ ){{0,140}}?all advertising materials mentioning features
bsd-3-clause | 1 | 0.95 | neither the name/may not be used to endorse | {_BSD} (?:\S+ ){{0,140}}?(?:neither the name|may not be used to endorse)
bsd | 2 | 0.9 | redistribution and use | {_BSD}(?: with or without modification)?
zlib | 1 | 0.95 | in no event will | provided as is without any express or implied warranty in no event will the authors be held liable
unlicense | 1 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
"""

# the notice of the GNU licences, which gives the version behind the publisher: label stem | name | versions
_NOTICES = """
gpl | general public | 1.0 2.0 3.0
lgpl | (?:lesser|library) general public | 2.0 2.1 3.0
agpl | affero general public | 1.0 3.0
"""
_NOTICE = (
    "(?:(?:licensed|released|distributed|published|available|provided) )?(?:under (?:the )?(?:terms of )?(?:the )?)?(?:gnu )?"
    "{n} licen[sc]e(?: v?[0-9])? as published by the free software foundation (?:either )?version {v}(?: of the licen[sc]e)?"
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern


def _rows(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in (x.rstrip(" |") for x in table.strip().splitlines())]


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """Every family, in each of its versions and without one, in each form, and the signatures; a version beats none."""
    made = []

    def add(label: str, priority: str, confidence: str, keywords: str, pattern: str) -> None:
        gates = tuple(k.encode() for k in keywords.split("/"))
        made.append(Rule(label, 2 * int(priority), float(confidence), gates, re.compile(rf"(?<= ){pattern}(?= )".encode())))

    for signature in _rows(_SIGNATURES):
        add(*signature)
    for stem, name, versions in _rows(_NOTICES):
        for version in versions.split():
            major, _, minor = version.partition(".")
            number = f"{major}(?: 0)?(?! [0-9])" if minor == "0" else f"{major} {minor}"
            add(f"{stem}-{version}", "0", "0.98", "as published by", _NOTICE.format(n=name, v=number))
    for stem, names, name, *versions in _rows(_FAMILIES):
        plain = tuple(k.encode() for k in names.split("/"))
        # a tag names the label itself
        label_words = (stem.replace("-", " ").encode(),)
        for version in [*(versions[0].split() if versions else ()), ""]:
            major, _, minor = version.partition(".")
            number = f" (?:version |v|v )?{major}" + (f"(?: {minor})?" if minor == "0" else f" {minor}") if version else ""
            for form, priority, confidence, wording in _rows(_FORMS):
                if form == "bare" and not version:
                    continue  # a bare name without a version says too little
                pattern, keywords = wording.format(n=name, v=number), plain
                if form == "tag":
                    keywords = label_words
                    words = "spdx license identifier " + stem.replace("-", " ")
                    pattern = words + (f" {major}(?: {minor})?(?: only| or later)?" if version else "")
                made.append(
                    Rule(
                        f"{stem}-{version}" if version else stem,
                        2 * int(priority) + (not version),
                        float(confidence),
                        keywords,
                        re.compile(rf"(?<= ){pattern}(?= )".encode()),
                    )
                )
    return tuple(sorted(made, key=lambda r: (r.priority, r.label)))


#: A text without any of these has no detection, since every rule needs one.
_GATE = re.compile(rb" licen[sc]e | under | hereby granted | redistribution and use | in no event will | unencumbered ")


@dataclass
class Detection:
    label: str
    first: int  # word
    last: int
    priority: int
    confidence: float


class _Words:
    """Word numbers of positions that come in ascending order, in one pass over the line."""

    def __init__(self, line: bytes) -> None:
        self._line, self._at, self._spaces = line, 0, 0

    def before(self, position: int) -> int:
        """Spaces ahead of ``position``."""
        self._spaces += self._line.count(b" ", self._at, position)
        self._at = position
        return self._spaces


def detect(line: bytes) -> list[Detection]:
    """Detections in a line of words between single spaces, overlaps resolved.

    In order of priority, then length, then place, a detection is kept unless a kept one contains its interval.
    """
    if not _GATE.search(line):
        return []
    gates: dict[tuple[bytes, ...], bool] = {}
    found = []
    for rule in rules():
        open_ = gates.get(rule.keywords)
        if open_ is None:
            open_ = gates[rule.keywords] = any(k in line for k in rule.keywords)
        if not open_:
            continue
        words = _Words(line)
        for match in rule.pattern.finditer(line):
            first = words.before(match.start()) - 1
            found.append(Detection(rule.label, first, first + match[0].count(b" "), rule.priority, rule.confidence))
    found.sort(key=lambda d: (d.priority, d.first - d.last, d.first, d.label))
    kept: list[Detection] = []
    reach: dict[int, int] = {}  # word to the last word of the kept intervals over it
    for one in found:
        if reach.get(one.first, -1) < one.last:
            kept.append(one)
            for word in range(one.first, one.last + 1):
                reach[word] = max(reach.get(word, -1), one.last)
    return sorted(kept, key=lambda d: (d.first, d.last, d.label))


def base_places(line: bytes, phrases: Mapping[str, str] = BASE) -> list[tuple[int, str]]:
    """Word numbers at which a base phrase starts, with its label."""
    places = []
    for phrase, label in phrases.items():
        wanted, words = f" {phrase} ".encode(), _Words(line)
        at = line.find(wanted)
        while at >= 0:
            places.append((words.before(at), label))
            at = line.find(wanted, at + 1)
    return places


def scan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", phrases: Mapping[str, str] = BASE
) -> DataFrame:
    """One row per document: word count, base places and labels, all labels, score, detections.

    ``phrases`` are the base phrases, words between single spaces in lower case, with their labels.

    Words are what is left of the whole text, A-Z in lower case, when ASCII other than letters and digits
    separates; a null text has none. ``labels`` adds what the rules find; ``score`` is the best
    confidence, 0.7 at least where a base phrase stands and 0 where nothing is found. ``detections`` lists
    label, first and last word of what the rules keep. Rows are independent: nothing is shuffled, and repeated
    rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            out = []
            for raw in raw_texts(batch["text"]):
                words = raw.translate(_WORDS).split(b" ") if raw else []
                line = b" " + b" ".join(filter(None, words)) + b" "
                n_words = line.count(b" ") - 1 if len(line) > 2 else 0
                places = base_places(line, phrases)
                found = detect(line) if n_words else []
                base = {label for _, label in places}
                score = max([d.confidence for d in found] + [0.7] * bool(places), default=0.0)
                out.append(
                    (
                        n_words, len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
                        ",".join(sorted(base)), ",".join(sorted(base | {d.label for d in found})), score,
                        [{"label": d.label, "first": d.first, "last": d.last} for d in found],
                    )
                )
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *names])

    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, detections array<struct<label: string, first: long, last: long>>",
    )
