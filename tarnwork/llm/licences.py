r"""Licence scans by ordered signature rules.

A rule is a pattern with a label, a priority and keywords. A pattern is only tried on texts that hold
all of its keywords. Detections are taken by priority, then length, then place; a detection that lies
within one already taken is suppressed. Rules of the base (phrases of consecutive words) are never
suppressed, so their labels and places stay.

Whole texts are scanned, lower-cased in A-Z. Words are runs of ASCII digits, letters and all
characters beyond ASCII. Null counts as empty: no words, no labels, score 0. Repeated rows are scanned alike; other
columns don't matter; an empty table gives an empty result.

The score is 1 minus the product of (1 - confidence) over the distinct labels that stay.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP, _IN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_word = re.compile(WORD)

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Versioned licence families: label, names, short names, versions.
FAMILIES = (
    ("gpl", ("gnu general public licen[cs]e", "gnu gpl"), ("gpl",), ("1.0", "2.0", "3.0")),
    ("lgpl", ("gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "gnu lgpl"), ("lgpl",), ("2.0", "2.1", "3.0")),
    ("agpl", ("gnu affero general public licen[cs]e", "affero general public licen[cs]e"), ("agpl",), ("1.0", "3.0")),
    ("gfdl", ("gnu free documentation licen[cs]e",), ("gfdl", "gnu fdl"), ("1.1", "1.2", "1.3")),
    ("apache", ("apache software licen[cs]e", "apache licen[cs]e"), ("apache", "asl"), ("1.0", "1.1", "2.0")),
    ("mpl", ("mozilla public licen[cs]e",), ("mpl",), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public licen[cs]e",), ("epl",), ("1.0", "2.0")),
    ("cddl", ("common development and distribution licen[cs]e",), ("cddl",), ("1.0", "1.1")),
    ("cpl", ("common public licen[cs]e",), ("cpl",), ("1.0",)),
    ("eupl", ("european union public licen[cs]e",), ("eupl",), ("1.0", "1.1", "1.2")),
    ("artistic", ("artistic licen[cs]e",), ("artistic",), ("1.0", "2.0")),
    ("osl", ("open software licen[cs]e",), ("osl",), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", ("academic free licen[cs]e",), ("afl",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("bsl", ("boost software licen[cs]e",), ("bsl",), ("1.0",)),
    ("odbl", ("open data commons open database licen[cs]e", "open database licen[cs]e"), ("odbl",), ("1.0",)),
    ("ofl", ("sil open font licen[cs]e",), ("ofl",), ("1.0", "1.1")),
    ("cc-by", ("creative commons attribution",), ("cc by",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", ("creative commons attribution share ?alike",), ("cc by sa",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", ("creative commons attribution no ?derivs", "creative commons attribution no ?derivatives"), ("cc by nd",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", ("creative commons attribution non ?commercial",), ("cc by nc",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", ("creative commons attribution non ?commercial share ?alike",), ("cc by nc sa",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", ("creative commons attribution non ?commercial no ?derivs", "creative commons attribution non ?commercial no ?derivatives"), ("cc by nc nd",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("python", ("python software foundation licen[cs]e", "psf licen[cs]e"), ("psf",), ("2.0",)),
)
#: Unversioned licences and notices: label, phrase, priority, confidence.
PHRASES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 80, 0.95),
    ("mit", "(?:the )?mit licen[cs]e", 60, 0.9),
    ("mit", "(?:under|terms of) (?:the )?mit(?: x11)? licen[cs]e", 70, 0.95),
    ("x11", "x11 licen[cs]e", 60, 0.85),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 80, 0.95),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", 70, 0.9, "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?", 70, 0.9, "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?", 70, 0.9, "bsd"),
    ("bsd", "bsd(?: style)? licen[cs]e", 50, 0.8),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 80, 0.95),
    ("isc", "isc licen[cs]e", 60, 0.85),
    ("zlib", "this software is provided as is without any express or implied warranty", 70, 0.8),
    ("zlib", "zlib(?: libpng)? licen[cs]e", 60, 0.85),
    ("unlicense", "this is free and unencumbered software released into the public domain", 80, 0.95),
    ("unlicense", "(?:the )?unlicense", 50, 0.7),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", 60, 0.85),
    ("cc0", "creative commons (?:zero|cc0)", 70, 0.9),
    ("wtfpl", "do what the (?:fuck|f) you want to public licen[cs]e", 80, 0.95),
    ("wtfpl", "wtfpl", 50, 0.8),
    ("public-domain", "(?:in|into|to) the public domain", 40, 0.6),
    ("public-domain", "public domain(?: dedication| work| mark)?", 30, 0.5),
    ("proprietary", "proprietary and confidential", 50, 0.7),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|use)(?: or distribution)?(?: of this (?:file|software|work|material))?(?: via any medium)? is (?:strictly )?prohibited", 60, 0.8),
    ("proprietary", "may not be (?:reproduced|copied|redistributed|used)(?: or (?:reproduced|transmitted|distributed))?(?: in any form)? without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 60, 0.8),
    ("proprietary", "end user licen[cs]e agreement", 50, 0.7),
    ("reserved", "no part of this (?:publication|book|document|work) may be reproduced", 60, 0.8),
    ("reserved", "alle rechte vorbehalten", 60, 0.8),
    ("reserved", "tous droits r[ée]serv[ée]s", 60, 0.8),
    ("reserved", "todos los derechos reservados", 60, 0.8),
    ("copyright", "copyright(?: c)?(?: \\d{4})+", 30, 0.4),
    ("copyright", "(?:copyright|copr)(?: c)? by", 30, 0.4, "cop"),
    ("creative-commons", "creative commons", 20, 0.4),
    ("licensed", "licen[cs]ed under (?:the )?(?:terms of (?:the )?)?", 10, 0.3),
    ("licensed", "released under (?:the )?(?:terms of (?:the )?)?", 10, 0.2),
)

#: Sentences and notices, written out: label, priority, confidence, phrase.
NOTICES = """
mit 80 0.9 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 70 0.8 the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0 75 0.9 mit no attribution
mit 65 0.85 (?:expat|mit expat) licen[cs]e
bsd 75 0.9 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 75 0.9 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause 80 0.95 neither the name of (?s:.{0,80}?) nor the names of its contributors may be used to endorse or promote products
bsd-4-clause 80 0.95 all advertising materials mentioning features or use of this software must display the following acknowledgement
0bsd 75 0.9 zero clause bsd(?: licen[cs]e)?
0bsd 75 0.9 bsd zero clause(?: licen[cs]e)?
0bsd 70 0.85 0bsd(?: licen[cs]e)?
apache-2.0 80 0.95 you may not use this file except in compliance with the licen[cs]e
apache-2.0 80 0.9 unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
apache-1.1 80 0.9 this product includes software developed by the apache software foundation
gpl 80 0.95 this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl 75 0.8 you should have received a copy of the gnu general public licen[cs]e along with this program
gpl 75 0.8 but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e
gpl 70 0.85 either version [0-9] of the licen[cs]e or at your option any later version
lgpl 80 0.95 this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e
lgpl 75 0.8 you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
agpl 80 0.95 under the terms of the gnu affero general public licen[cs]e
gpl-exception 70 0.8 as a special exception (?:the copyright holders? (?:give|gives) you|you may) permission to link
classpath-exception 75 0.9 classpath exception
gfdl 80 0.95 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl 70 0.7 with no invariant sections no front cover texts and no back cover texts
mpl-2.0 80 0.95 this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1.1 80 0.9 the contents of this file are subject to the mozilla public licen[cs]e version
epl 80 0.9 this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
cddl 80 0.9 the contents of this file are subject to the terms of the common development and distribution licen[cs]e
artistic 75 0.85 the clarified artistic licen[cs]e
perl 70 0.85 (?:you can redistribute it and or modify it )?under the same terms as perl itself
bsl-1.0 80 0.95 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
busl-1.1 75 0.9 business source licen[cs]e(?: 1 1)?
sspl 75 0.9 server side public licen[cs]e
elastic 70 0.9 elastic licen[cs]e(?: 2 0)?
commons-clause 75 0.9 commons clause(?: licen[cs]e condition)?
postgresql 65 0.9 postgresql licen[cs]e
php 65 0.85 php licen[cs]e(?: version [0-9] [0-9]+)?
ruby 65 0.85 ruby licen[cs]e
vim 65 0.85 vim licen[cs]e
openssl 65 0.85 openssl licen[cs]e
openssl 75 0.9 this product includes software developed by the openssl project
ncsa 70 0.9 (?:university of illinois )?ncsa open source licen[cs]e
ecl 70 0.9 educational community licen[cs]e
cpal 70 0.9 common public attribution licen[cs]e
ms-pl 70 0.9 microsoft public licen[cs]e
ms-rl 70 0.9 microsoft reciprocal licen[cs]e
ipl 70 0.9 ibm public licen[cs]e
qpl 65 0.85 q public licen[cs]e
sleepycat 65 0.85 sleepycat licen[cs]e
w3c 70 0.9 w3c (?:software|document)(?: notice and)? licen[cs]e
unicode 70 0.9 unicode (?:inc )?licen[cs]e agreement
blue-oak 70 0.9 blue oak model licen[cs]e
mulan 70 0.9 mulan (?:psl|permissive software licen[cs]e)
upl 70 0.9 universal permissive licen[cs]e
json 75 0.9 the software shall be used for good not evil
beerware 75 0.9 beer ?ware licen[cs]e
beerware 80 0.95 as long as you retain this notice you can do whatever you want with this stuff
hippocratic 70 0.9 hippocratic licen[cs]e
etalab 70 0.9 licence ouverte(?: etalab)?
ogl 70 0.9 open government licen[cs]e
ogl 75 0.9 contains public sector information licen[cs]ed under the open government licen[cs]e
dl-de 70 0.9 datenlizenz deutschland
odc-by 70 0.9 open data commons attribution licen[cs]e
pddl 70 0.9 public domain dedication and licen[cs]e
cdla 70 0.9 community data licen[cs]e agreement
fal 65 0.85 free art licen[cs]e
cc-by-sa 70 0.85 (?:available|licen[cs]ed|released) under (?:a |the )?creative commons attribution share ?alike
cc-by 70 0.85 (?:available|licen[cs]ed|released) under (?:a |the )?creative commons attribution
cc-by-nc 75 0.85 creative commons attribution non ?commercial licen[cs]e
cc0 75 0.9 to the extent possible under law (?s:.{0,80}?) has waived all copyright and related or neighboring rights
public-domain 60 0.8 this work is (?:in the public domain|dedicated to the public domain)
public-domain 60 0.7 no rights reserved
public-domain 60 0.8 not subject to copyright protection in the united states
ofl-1.1 80 0.95 this font software is licen[cs]ed under the sil open font licen[cs]e
bigscience 70 0.9 (?:bigscience )?(?:open)?rail(?: m)? licen[cs]e
llama 70 0.9 llama (?:[0-9] )?community licen[cs]e
gemma 70 0.8 gemma terms of use
research-only 65 0.8 for (?:non ?commercial )?research (?:purposes|use) only
non-commercial 60 0.7 for non ?commercial (?:use|purposes) only
non-commercial 55 0.6 not for commercial use
evaluation 60 0.7 for evaluation purposes only
confidential 60 0.7 this (?:document|message|email|e mail) (?:is|contains) (?:strictly )?confidential
confidential 50 0.5 confidential information
trade-secret 60 0.7 contains trade secrets? (?:and|or) proprietary information
proprietary 60 0.8 this software is the (?:confidential and )?proprietary (?:information|property) of
proprietary 60 0.7 you may not (?:copy|modify|distribute|reverse engineer)
proprietary 55 0.6 unpublished (?:work|proprietary source code)
proprietary 55 0.6 licen[cs]ed not sold
proprietary 50 0.6 subject to (?:the )?terms (?:and conditions )?of (?:the |your )?licen[cs]e agreement
reserved 60 0.8 some rights reserved
reserved 60 0.8 todos os direitos reservados
reserved 60 0.8 tutti i diritti riservati
reserved 60 0.8 alle rechten voorbehouden
reserved 60 0.7 reproduction (?:in whole or in part )?(?:without (?:written )?permission )?is prohibited
reserved 60 0.7 reproduction interdite(?: sans autorisation)?
reserved 60 0.7 nachdruck(?: auch auszugsweise)? verboten
reserved 60 0.7 prohibida (?:su|la) reproducci[óo]n(?: total o parcial)?
permission 50 0.5 (?:reprinted|reproduced|used) (?:with|by) (?:the )?(?:kind )?permission(?: of)?
permission 50 0.5 permission (?:to (?:use|copy|reprint)|is granted)
attribution 40 0.4 (?:please )?(?:cite|credit|attribute) (?:this work|the author|the source) as
warranty 30 0.3 without warrant(?:y|ies) (?:of any kind|or conditions)
warranty 30 0.3 in no event shall the (?:authors?|copyright holders?|contributors?) (?:or (?s:.{0,40}?) )?be liable
export 30 0.3 subject to (?:u s |united states )?export (?:control|administration)
trademark 30 0.4 (?:is|are) (?:a )?(?:registered )?trademarks? of
patent 30 0.4 (?:patents?|patent) pending
dmca 40 0.5 digital millennium copyright act
"""


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    base: bool = False


def phrase_pattern(phrase: str) -> re.Pattern:
    """A phrase's words stand consecutively: blanks are any run of characters outside words."""
    return re.compile(f"(?<!{_IN})(?:{phrase.replace(' ?', f'(?:{_GAP})?').replace(' ', _GAP)})(?!{_IN})")


def _keywords(phrase: str) -> tuple[str, ...]:
    """The plain runs of letters of a phrase that every match has to hold, longest first."""
    plain = re.sub(r"\[[^]]*\]|\((?:[^()]|\([^()]*\))*\)[?+]?|.\?", " ", phrase)
    return tuple(sorted(set(re.findall(r"[a-z0-9]+", plain)), key=lambda w: (-len(w), w)))


def _rules() -> tuple[Rule, ...]:
    out = [Rule(label, phrase_pattern(p), _keywords(p), 1000, 0.6, True) for p, label in BASE.items()]

    def add(label, phrase, priority, confidence, keywords=()):
        out.append(Rule(label, phrase_pattern(phrase), keywords or _keywords(phrase), priority, confidence))

    for family, names, shorts, versions in FAMILIES:
        for name in names:
            add(family, name, 60 + len(name) // 10, 0.85)
            for version in versions:
                digits = version.replace(".", " ")
                major = f"(?:{digits}|{version[0]})" if version.endswith(".0") else digits
                add(f"{family}-{version}", f"{name}(?: international| unported)?(?: licen[cs]e)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?{major}", 90, 0.95)
        for short in shorts:
            for version in versions:
                digits = version.replace(".", " ")
                major = f"(?:{digits}|{version[0]})" if version.endswith(".0") else digits
                add(f"{family}-{version}", f"{short}(?: v| version)? ?v?{major}(?: only| or later)?", 85, 0.9)
            for lead in ("licen[cs]ed under", "under the", "released under the", "spdx licen[cs]e identifier"):
                add(family, f"{lead} {short}", 70, 0.85)
    for label, phrase, priority, confidence, *keywords in PHRASES:
        add(label, phrase, priority, confidence, tuple(keywords))
    for notice in NOTICES.strip().splitlines():
        label, priority, confidence, phrase = notice.split(" ", 3)
        add(label, phrase, int(priority), float(confidence))
    return tuple(out)


RULES = _rules()
#: Rules in the order of the list, under the keyword that gates them.
BY_KEYWORD = {k: tuple(rules) for k, rules in ((k, list(g)) for k, g in groupby(sorted(RULES, key=lambda r: r.keywords[0]), key=lambda r: r.keywords[0]))}


def detections(lower: str, by_keyword=None) -> list[tuple[int, int, Rule]]:
    """Start, end and rule of every match in a lower-cased text."""
    found: list[tuple[int, int, Rule]] = []
    for keyword, rules in (by_keyword or BY_KEYWORD).items():
        if keyword in lower:
            for rule in rules:
                if all(k in lower for k in rule.keywords):
                    found.extend((m.start(), m.end(), rule) for m in rule.pattern.finditer(lower))
    return found


def resolved(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Base detections, and those others that don't lie within one taken before, by priority, length and place.

    A detection lies within one taken if some taken one starts no later and ends no earlier. Taken ones are held
    as a staircase: starts ascending with the greatest end so far.
    """
    order = sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    starts, ends, taken = [], [], []
    for start, end, rule in order:
        at = bisect.bisect_right(starts, start)
        inside = at > 0 and ends[at - 1] >= end
        if inside and not rule.base:
            continue
        taken.append((start, end, rule))
        if not inside:
            low = bisect.bisect_left(starts, start)
            high = low
            while high < len(starts) and ends[high] <= end:
                high += 1
            starts[low:high], ends[low:high] = [start], [end]
    return taken


def scan(text: str | None) -> dict:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and spans (start, end, label) of a text."""
    lower = common.ascii_lower_text(text or "")
    words = len(_word.findall(lower))
    kept = resolved(detections(lower)) if words else []
    places = sorted(start for start, _, rule in kept if rule.base)
    first = last = None
    if places:
        first = len(_word.findall(lower, 0, places[0]))
        last = first + len(_word.findall(lower, places[0], places[-1]))
    confidence: dict[str, float] = {}
    for _, _, rule in kept:
        confidence[rule.label] = max(confidence.get(rule.label, 0.0), rule.confidence)
    miss = 1.0
    for label in sorted(confidence):
        miss *= 1 - confidence[label]
    return {
        "n_words": words, "n_base": len(places), "first_word": first, "last_word": last,
        "base_labels": ",".join(sorted({r.label for _, _, r in kept if r.base})),
        "labels": ",".join(sorted(confidence)), "score": 1 - miss if confidence else 0.0,
        "spans": sorted((s, e, r.label) for s, e, r in kept),
    }


_OUT = (("n_words", pa.int64(), "bigint"), ("n_base", pa.int64(), "bigint"), ("first_word", pa.int64(), "bigint"), ("last_word", pa.int64(), "bigint"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"))


def scanned(docs: DataFrame) -> DataFrame:
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[name] for r in rows], kind) for name, kind, _ in _OUT]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(name for name, _, _ in _OUT)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, " + ", ".join(f"{name} {sql}" for name, _, sql in _OUT))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.table(spark, sf_dir, "documents"))
