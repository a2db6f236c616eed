"""License scans: ordered signature rules behind a keyword prefilter; priority and containment settle overlaps."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, word_list

# Phrases of the base and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Families: label, how a text names it (a regular expression over words), and the keywords of which one must stand in the text, by bars.
FAMILIES = (
    ("mit", "mit", "mit"), ("apache-2", "apache(?: software)? license version 2(?: 0)?|apache 2(?: 0)?", "apache"), ("apache-1.1", "apache(?: software)? license version 1 1", "apache"),
    ("gpl-3", "(?:gnu )?(?:general public license|gpl) ?(?:version |v)?3(?: 0)?|gnu gplv3", "general public|gpl"), ("gpl-2", "(?:gnu )?(?:general public license|gpl) ?(?:version |v)?2(?: 0)?|gnu gplv2", "general public|gpl"), ("gpl", "gnu general public license|gnu gpl", "gnu"),
    ("lgpl-3", "(?:gnu )?(?:lesser|library) general public license ?(?:version |v)?3|lgpl ?v?3", "lesser|library general|lgpl"), ("lgpl-2.1", "(?:gnu )?(?:lesser|library) general public license ?(?:version |v)?2 1|lgpl ?v?2 1", "lesser|library general|lgpl"), ("agpl-3", "(?:gnu )?affero general public license ?(?:version |v)?3|agpl ?v?3", "affero|agpl"),
    ("bsd-2", "(?:2|two) clause bsd|simplified bsd|bsd 2 clause", "bsd"), ("bsd-3", "(?:3|three) clause bsd|(?:new|modified) bsd|bsd 3 clause", "bsd"), ("bsd", "bsd", "bsd"), ("isc", "isc", "isc"), ("mpl-2", "mozilla public license ?(?:version |v)?2(?: 0)?|mpl 2 0", "mozilla|mpl 2"), ("mpl-1.1", "mozilla public license ?(?:version |v)?1 1", "mozilla"),
    ("epl-2", "eclipse public license ?(?:version |v)?2(?: 0)?|epl 2 0", "eclipse|epl 2"), ("epl-1", "eclipse public license ?(?:version |v)?1(?: 0)?|epl 1 0", "eclipse|epl 1"), ("cc0", "cc0|creative commons zero|cc zero", "cc0|cc|creative commons"), ("cc-by", "cc by|creative commons attribution", " cc|creative commons"), ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", " cc|creative commons"),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?derivatives", " cc|creative commons"), ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", " cc|creative commons"), ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", " cc|creative commons"), ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?derivatives", " cc|creative commons"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl|do what the fuck you want to public license", "wtfpl|do what the"), ("zlib", "zlib", "zlib"), ("boost", "boost software license(?: version)? 1 0|bsl 1 0", "boost|bsl"), ("artistic-2", "artistic license ?(?:version )?2(?: 0)?", "artistic"), ("ofl", "sil open font license|ofl 1 1", "sil open|ofl 1"),
    ("python-2", "python software foundation license|psf license", "python|psf"), ("postgresql", "postgresql license", "postgresql"), ("openssl", "openssl license", "openssl"), ("ms-pl", "microsoft public license|ms pl", "microsoft|ms pl"), ("eupl-1.2", "european union public licence|eupl", "european|eupl"), ("odbl", "open database license|odbl", "open database|odbl"), ("proprietary", "all rights reserved", "all rights"),
)

#: Rules written licence by licence: label, priority, a text's keyword, and a regular expression over words. Headers and clauses (95)
#: are the licence's own text, addresses (85) point at it, titles (65) name it in full.
SIGNATURES = (
    ("mit", 95, "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 85, "opensource", "opensource org licenses mit(?: license(?: php| html)?)?"), ("mit", 85, "mit license", "mit license org"), ("mit", 65, "mit license", "the mit license mit"), ("mit", 65, "expat", "expat license"), ("mit", 65, "x11", "x11 license"), ("mit", 65, "mit", "dual licensed under the mit"),
    ("apache-2", 95, "you may not use this file", "you may not use this file except in compliance with the license you may obtain a copy of the license at"), ("apache-2", 85, "apache", "(?:www )?apache org licenses license 2 0(?: txt| html)?"), ("apache-2", 85, "opensource", "opensource org licenses apache 2 0"), ("apache-2", 65, "asl", "asl 2 0"), ("apache-2", 65, "apache", "apache license v2(?: 0)?"),
    ("apache-1.1", 95, "apache software foundation", "this product includes software developed by the apache software foundation"), ("apache-1.1", 85, "apache", "apache org licenses license 1 1"),
    ("gpl-3", 95, "general public license", "gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"), ("gpl-3", 85, "gnu", "gnu org licenses gpl 3 0(?: en)?(?: html| txt)?"), ("gpl-3", 65, "gplv3", "gplv3"), ("gpl-3", 85, "opensource", "opensource org licenses gpl 3 0"),
    ("gpl-2", 95, "general public license", "gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version"), ("gpl-2", 85, "gnu", "gnu org licenses(?: old licenses)? gpl 2 0(?: en)?(?: html| txt)?"), ("gpl-2", 65, "gplv2", "gplv2"), ("gpl-2", 95, "general public license", "terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl", 95, "general public license", "you should have received a copy of the gnu general public license along with this program"), ("gpl", 85, "gnu", "gnu org licenses gpl(?: html| txt)?"), ("gpl", 85, "gnu", "gnu org copyleft gpl(?: html)?"),
    ("lgpl-3", 85, "gnu", "gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?"), ("lgpl-3", 65, "lgplv3", "lgplv3"), ("lgpl-2.1", 95, "lesser general public license", "terms of the gnu lesser general public license as published by the free software foundation either version 2 1"), ("lgpl-2.1", 85, "gnu", "gnu org licenses(?: old licenses)? lgpl 2 1(?: en)?(?: html| txt)?"), ("lgpl-2.1", 65, "lgplv2", "lgplv2(?: 1)?"),
    ("agpl-3", 95, "affero", "terms of the gnu affero general public license as published by the free software foundation either version 3"), ("agpl-3", 85, "gnu", "gnu org licenses agpl 3 0(?: en)?(?: html| txt)?"), ("agpl-3", 65, "agplv3", "agplv3"),
    ("bsd-2", 85, "opensource", "opensource org licenses bsd 2 clause"), ("bsd-2", 65, "freebsd license", "freebsd license"), ("bsd-3", 95, "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission"), ("bsd-3", 85, "opensource", "opensource org licenses bsd 3 clause"), ("bsd", 95, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"), ("bsd", 85, "opensource", "opensource org licenses bsd license(?: php)?"), ("bsd-4", 95, "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", 95, "permission to use copy modify", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"), ("isc", 85, "opensource", "opensource org licenses isc(?: license)?(?: txt)?"), ("0bsd", 85, "opensource", "opensource org licenses 0bsd"), ("0bsd", 65, "0bsd", "0bsd"),
    ("mpl-2", 95, "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"), ("mpl-2", 85, "mozilla", "mozilla org mpl 2 0"), ("mpl-2", 85, "mozilla", "mozilla org en us mpl 2 0"), ("mpl-1.1", 95, "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1"), ("mpl-1.1", 85, "mozilla", "mozilla org mpl mpl 1 1(?: html| txt)?"),
    ("epl-2", 85, "eclipse", "eclipse org legal epl 2 0"), ("epl-2", 85, "eclipse", "eclipse org org documents epl 2 0"), ("epl-1", 85, "eclipse", "eclipse org legal epl v10(?: html)?"), ("cddl-1", 65, "cddl", "cddl(?: version)? 1(?: 0| 1)?"), ("cddl-1", 65, "common development and distribution", "common development and distribution license"), ("cddl-1", 95, "common development and distribution", "the contents of this file are subject to the terms of the common development and distribution license"), ("cpl-1", 65, "common public license", "common public license(?: version)?(?: 1 0)?"),
    ("cc0", 85, "creativecommons", "creativecommons org publicdomain zero 1 0"), ("cc0", 95, "waived all copyright", "has waived all copyright and related or neighbou?ring rights"), ("cc0", 65, "cc0", "cc0 1 0 universal"), ("public-domain", 85, "creativecommons", "creativecommons org (?:publicdomain mark 1 0|licenses publicdomain)"), ("public-domain", 65, "public domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain"), ("public-domain", 65, "public domain", "this work is in the public domain"),
    ("cc-by", 85, "creativecommons", "creativecommons org licenses by [1-4] [05]"), ("cc-by-sa", 85, "creativecommons", "creativecommons org licenses by sa [1-4] [05]"), ("cc-by-nd", 85, "creativecommons", "creativecommons org licenses by nd [1-4] [05]"), ("cc-by-nc", 85, "creativecommons", "creativecommons org licenses by nc [1-4] [05]"), ("cc-by-nc-sa", 85, "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]"), ("cc-by-nc-nd", 85, "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by", 65, "attribution 4 0 international", "attribution 4 0 international"), ("cc-by-sa", 65, "attribution share", "attribution share ?alike [1-4] [05](?: international| unported| generic)?"), ("cc-by-nc", 65, "attribution non", "attribution non ?commercial [1-4] [05](?: international| unported| generic)?"), ("cc-by-nd", 65, "attribution no", "attribution no ?deriv(?:ative)?s [1-4] [05](?: international| unported| generic)?"),
    ("unlicense", 95, "free and unencumbered", "this is free and unencumbered software released into the public domain"), ("unlicense", 85, "unlicense", "unlicense org"), ("wtfpl", 85, "wtfpl", "wtfpl net"), ("wtfpl", 95, "you just do what the fuck", "you just do what the fuck you want to"), ("zlib", 95, "this software is provided as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"), ("zlib", 85, "zlib", "zlib net zlib license(?: html)?"), ("zlib", 65, "zlib", "zlib libpng license"),
    ("boost", 85, "boost", "boost org license 1 0(?: txt)?"), ("boost", 95, "boost software license", "distributed under the boost software license version 1 0"), ("artistic-2", 85, "opensource", "opensource org licenses artistic license 2 0"), ("artistic-2", 85, "perlfoundation", "perlfoundation org artistic license 2 0"), ("artistic-1", 65, "artistic license", "(?:perl )?artistic license 1(?: 0)?"), ("perl", 65, "same terms as perl", "(?:under|on) the same terms as perl(?: itself)?"),
    ("ofl", 85, "scripts sil org", "scripts sil org ofl"), ("ofl", 95, "reserved font name", "with reserved font names?"), ("ofl", 65, "open font license", "open font license version 1 1"), ("python-2", 65, "psf", "psf license agreement"), ("python-2", 85, "docs python org", "docs python org (?:3 |2 )?license(?: html)?"), ("postgresql", 85, "opensource", "opensource org licenses postgresql"), ("openssl", 95, "openssl project", "this product includes software developed by the openssl project"), ("ms-pl", 65, "ms pl", "ms pl"), ("ms-rl", 65, "microsoft reciprocal", "microsoft reciprocal license"),
    ("eupl-1.2", 85, "joinup", "joinup ec europa eu (?:software page|collection eupl)"), ("eupl-1.2", 65, "eupl", "eupl 1 2"), ("odbl", 85, "opendatacommons", "opendatacommons org licenses odbl(?: 1 0)?"), ("odc-by", 85, "opendatacommons", "opendatacommons org licenses by(?: 1 0)?"), ("odc-by", 65, "open data commons attribution", "open data commons attribution license"), ("pddl", 65, "public domain dedication and license", "public domain dedication and license"), ("pddl", 85, "opendatacommons", "opendatacommons org licenses pddl"),
    ("gfdl", 65, "free documentation license", "gnu free documentation license"), ("gfdl", 95, "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"), ("gfdl", 85, "gnu", "gnu org (?:licenses|copyleft) fdl(?: html)?"), ("bsl-1.1", 65, "business source license", "business source license(?: 1 1)?"), ("sspl-1", 65, "server side public license", "server side public license"), ("elastic-2", 65, "elastic license", "elastic license(?: 2 0| v2)"), ("polyform-nc", 65, "polyform", "polyform non ?commercial license"),
    ("openrail", 65, "openrail", "(?:creativeml |bigscience |bigcode )?open ?rail(?: ?m| s)?(?: license)?"), ("llama", 65, "llama", "llama [234](?: [0-9])? community license(?: agreement)?"), ("proprietary", 95, "proprietary", "(?:confidential and proprietary|proprietary and confidential)"), ("proprietary", 65, "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"), ("proprietary", 65, "no part of this", "no part of this (?:publication|work|book|document) may be reproduced"),
    ("non-commercial", 65, "commercial|noncommercial", "for non ?commercial use only"), ("non-commercial", 65, "commercial|noncommercial", "not for commercial use"), ("personal-use", 65, "personal use", "for (?:your )?personal use only"), ("ogl-uk", 85, "nationalarchives", "nationalarchives gov uk doc open government licence"), ("ogl-uk", 65, "open government licence", "open government licence(?: v(?:ersion )?3(?: 0)?)?"), ("etalab-2", 65, "licence ouverte", "licence ouverte(?: open licence)?(?: 2 0)?"), ("datenlizenz-de", 65, "datenlizenz deutschland", "datenlizenz deutschland(?: namensnennung)?(?: 2 0)?"),
)

#: How a text says that a family applies: priority, a cue that stands in all such texts (one of those between bars), and the words around the name.
PHRASES = (
    (90, "spdx", r"spdx license identifier %s"),
    (80, "under", r"(?:is |are )?(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:%s)(?: license)?"),
    (75, "under", r"(?:licensed|released|distributed) under (?:a|an) (?:%s)(?: license)?"),
    (70, "subject to", r"subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:%s)(?: license)?"),
    (60, "license", r"(?:the )?(?:%s) license"),
    (55, "license", r"license (?:is )?(?:the )?(?:%s)"),
    (50, "license|for details", r"(?:see|read) (?:the )?(?:%s) (?:license|for details)"),
    (40, "under", r"under (?:the )?(?:%s)"),
)
#: Families whose bare name says enough.
BARE = {"proprietary", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "cc0"}


#: Keywords that other words begin with.
WHOLE = {"mit", "isc", "cc"}


def _words(keys: str) -> tuple[bytes, ...]:
    """Keywords as they stand in words joined by blanks: from a word's beginning on, and some to its end."""
    return tuple(f" {k.strip()}{' ' if k.strip() in WHOLE else ''}".encode() for k in keys.split("|"))


@cache
def rules() -> tuple[tuple[int, str, tuple[bytes, ...], tuple[bytes, ...], re.Pattern], ...]:
    """(priority, label, keywords, cues, pattern), in order. A rule is tried where the text has one of its keywords and one of its cues."""
    whole = lambda p: re.compile(rf"(?<![^ ])(?:{p})(?![^ ])")
    out = [(priority, label, _words(key), _words(key), whole(pattern)) for label, priority, key, pattern in SIGNATURES]
    for label, name, key in FAMILIES:
        for priority, cue, phrase in PHRASES:
            out.append((priority, label, _words(key), _words(cue), whole(phrase.replace("%s", f"(?:{name})"))))
        if label in BARE:
            out.append((30, label, _words(key), _words(key), whole(name)))
    return tuple(sorted(out, key=lambda r: -r[0]))


@cache
def _gates() -> tuple[tuple[bytes, ...], tuple[bytes, ...]]:
    """All cues and all keywords of the rules, each once."""
    return tuple(sorted({c for r in rules() for c in r[3]})), tuple(sorted({k for r in rules() for k in r[2]}))


def base_places(line: bytes) -> list[tuple[int, str]]:
    """(offset in bytes, label) of every place of a base phrase in words joined by blanks, with a blank at each end."""
    out = []
    for phrase, label in BASE:
        needle = b" " + phrase.encode() + b" "
        at = line.find(needle)
        while at >= 0:
            out.append((at, label))
            at = line.find(needle, at + 1)
    return out


def detect(line: bytes) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label) of the detections that stay.

    A detection goes where one of higher priority, or of equal priority and longer, contains it; of two equal
    ones the first rule's stays. Detections that only overlap both stay.
    """
    cues, keys = _gates()
    said = {c for c in cues if c in line}
    if not said:
        return []
    named = {k for k in keys if k in line}
    if not named:
        return []
    text = line.decode("utf-8", "replace")
    found = {}
    for priority, label, keys, cues, pattern in rules():
        if not named.isdisjoint(keys) and not said.isdisjoint(cues):
            for m in pattern.finditer(text):
                found.setdefault((m.start(), m.end(), priority), (m.start(), m.end(), priority, label))
    return suppress(list(found.values()))


def suppress(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """By rank (priority, then length): a detection goes where one of higher rank contains it. A Fenwick tree over starts holds
    the furthest end of what stays, so the time is that of sorting."""
    starts = sorted({s[0] for s in found})
    reach = [-1] * (len(starts) + 1)
    stay = []
    for s in sorted(found, key=lambda s: (-s[2], s[0] - s[1], s[0])):
        at = i = bisect_right(starts, s[0])
        top = -1
        while i > 0:
            top = max(top, reach[i])
            i -= i & -i
        if top < s[1]:
            stay.append(s)
            while at < len(reach):
                reach[at] = max(reach[at], s[1])
                at += at & -at
    return sorted(stay)


def scan(text: str | None) -> tuple[int, int, int | None, int | None, set[str], set[str], float]:
    """n_words, n_base, first_word, last_word, base labels, all labels, score."""
    words = word_list(text)
    line = b" " + b" ".join(words) + b" "
    base = base_places(line) if b"license" in line or b" cc " in line else []
    starts = [line.count(b" ", 0, at) for at, _ in (min(base), max(base))] if base else [None, None]
    labels = {b for _, b in base}
    found = detect(line)
    score = max([90 if base else 0, *(p for _, _, p, _ in found)]) / 100
    return len(words), len(base), starts[0], starts[1], labels, labels | {s[3] for s in found}, score


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row; ``score`` is the highest priority of a detection over 100, base phrases counting 0.9.

    Null and empty texts have no words, no labels and score 0.
    """

    def run(c: dict[str, list]) -> dict[str, list]:
        got = [scan(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "n_words": [g[0] for g in got], "n_base": [g[1] for g in got], "first_word": [g[2] for g in got], "last_word": [g[3] for g in got], "base_labels": [",".join(sorted(g[4])) for g in got], "labels": [",".join(sorted(g[5])) for g in got], "score": [g[6] for g in got]}

    return map_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
