"""License scan by ordered signature rules.

A text is reduced to its words, lower-cased. A rule is a regular expression over words joined by single spaces,
with a label, a priority, a confidence and keywords; it runs only on texts that have one of its keywords, which is
tested for all texts of a slab at once by word hashes. Where detections overlap, the one of higher priority
stays (then the longer, then the earlier, then the first rule), and everything that it contains or crosses
is suppressed, unless it is of the same label. Base phrases have the highest priority and are never suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shardloom.llm.tables import load, map_arrow
from shardloom.llm.words import ALNUM, slabs, split_words

#: Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: License families: label, a word that every form of the name has, and the name as a regex over words. Each gives three
#: rules: an SPDX tag, a grant ("licensed under the ..."), and the bare name followed or preceded by "license".
FAMILIES = r"""
mit | mit | mit(?: expat)?
mit-0 | mit | mit (?:0|no attribution)
apache-1.1 | apache | apache(?: software)?(?: license)?(?: version)? 1 1
apache-2 | apache | apache(?: software)?(?: license)?(?: version)? 2(?: 0)?
bsd-2 | bsd | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)
bsd-3 | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)
bsd-4 | bsd | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)
bsd-0 | 0bsd | (?:0bsd|zero clause bsd)
isc | isc | isc
zlib | zlib | zlib(?: libpng)?
gpl-1 | gpl | gpl(?: version)? v?1(?: 0)?(?: only| or later)?
gpl-2 | gpl | gpl(?: version)? v?2(?: 0)?(?: only| or later)?
gpl-3 | gpl | gpl(?: version)? v?3(?: 0)?(?: only| or later)?
lgpl-2 | lgpl | lgpl(?: version)? v?2(?: 0)?(?: only| or later)?
lgpl-2.1 | lgpl | lgpl(?: version)? v?2 1(?: only| or later)?
lgpl-3 | lgpl | lgpl(?: version)? v?3(?: 0)?(?: only| or later)?
agpl-3 | agpl | agpl(?: version)? v?3(?: 0)?(?: only| or later)?
mpl-1.1 | mpl | mpl(?: version)? v?1 1
mpl-2 | mpl | mpl(?: version)? v?2(?: 0)?
epl-1 | epl | epl(?: version)? v?1(?: 0)?
epl-2 | epl | epl(?: version)? v?2(?: 0)?
cddl-1 | cddl | cddl(?: version)? v?1(?: 0)?
cpl-1 | cpl | cpl(?: version)? v?1(?: 0)?
eupl | eupl | eupl(?: version)?(?: v?1 [012])?
bsl-1 | bsl | (?:boost software|bsl 1 0)
unlicense | unlicense | unlicense
wtfpl | wtfpl | wtfpl(?: version 2)?
artistic-1 | artistic | artistic(?: license)? 1(?: 0)?
artistic-2 | artistic | artistic(?: license)? 2(?: 0)?
ofl-1.1 | ofl | ofl(?: 1 1)?
postgresql | postgresql | postgresql
python-2 | psf | (?:psf|python software foundation)(?: license)? 2(?: 0)?
openssl | openssl | openssl
php-3 | php | php(?: license)? 3(?: 01)?
ruby | ruby | ruby
vim | vim | vim
ncsa | ncsa | (?:ncsa|university of illinois ncsa)
x11 | x11 | x11
upl-1 | upl | upl(?: 1 0)?
afl-3 | afl | afl 3(?: 0)?
osl-3 | osl | osl 3(?: 0)?
ms-pl | microsoft | microsoft public
ms-rl | microsoft | microsoft reciprocal
bsl-1.1 | business | business source(?: license)?(?: version)? 1 1
sspl-1 | sspl | sspl(?: version)?(?: v?1)?(?: 0)?
elastic-2 | elastic | elastic(?: license)? 2(?: 0)?
odbl-1 | odbl | odbl(?: 1 0)?
pddl-1 | pddl | pddl(?: 1 0)?
gfdl-1.3 | gfdl | gfdl(?: version)?(?: 1 [123])?
cc0-1 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by | cc | cc by(?: [1234] [05])?(?! (?:sa|nc|nd)\b)
cc-by-sa | cc | cc by sa(?: [1234] [05])?
cc-by-nd | cc | cc by nd(?: [1234] [05])?
cc-by-nc | cc | cc by nc(?: [1234] [05])?(?! (?:sa|nd)\b)
cc-by-nc-sa | cc | cc by nc sa(?: [1234] [05])?
cc-by-nc-nd | cc | cc by nc nd(?: [1234] [05])?
openrail | openrail | (?:bigscience )?(?:open ?rail|openrail m)
llama-2 | llama | llama 2 community
"""

#: Signatures of their own: label, priority, confidence in percent, keywords (any), regex over words.
SIGNATURES = r"""
mit | 70 | 95 | granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 60 | 80 | sublicense | to use copy modify merge publish distribute sublicense and or sell
mit | 55 | 90 | mit | (?:released|distributed|available|licensed) under (?:the )?mit(?: license| licence)?
mit | 40 | 60 | mit | mit licen[sc]ed
isc | 70 | 95 | granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
apache-2 | 70 | 95 | apache | licensed under the apache license version 2 0
apache-2 | 60 | 90 | apache | www apache org licenses license 2 0
apache-2 | 55 | 85 | apache | you may not use this file except in compliance with the (?:apache )?license
apache | 30 | 50 | apache | apache(?: software)? licen[sc]e
bsd-3 | 70 | 90 | endorse | neither the name of (?:the )?(?:\w+ ){1,8}nor the names of its contributors may be used to endorse
bsd-2 | 60 | 80 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-4 | 70 | 90 | advertising | all advertising materials mentioning features or use of this software must display
bsd | 30 | 50 | bsd | bsd(?: style)? licen[sc]e
zlib | 70 | 95 | misrepresented | the origin of this software must not be misrepresented
gpl-3 | 70 | 95 | gnu | gnu general public license(?: as published by the free software foundation)?(?: either)? version 3
gpl-2 | 70 | 95 | gnu | gnu general public license(?: as published by the free software foundation)?(?: either)? version 2
gpl-1 | 70 | 95 | gnu | gnu general public license(?: as published by the free software foundation)?(?: either)? version 1
gpl | 30 | 60 | gnu | gnu general public licen[sc]e
lgpl-2.1 | 75 | 95 | gnu | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1
lgpl-3 | 75 | 95 | gnu | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3
lgpl-2 | 75 | 95 | gnu | gnu library general public license(?: either)? version 2
lgpl | 35 | 60 | gnu | gnu (?:lesser|library) general public licen[sc]e
agpl-3 | 75 | 95 | affero | gnu affero general public license(?: as published by the free software foundation)?(?: either)? version 3
agpl | 35 | 60 | affero | (?:gnu )?affero general public licen[sc]e
gfdl-1.3 | 75 | 90 | gnu | gnu free documentation license(?: version 1 [123])?
gpl-classpath | 80 | 90 | classpath | classpath exception
mpl-2 | 70 | 95 | mozilla | (?:terms of the )?mozilla public license(?: v)?(?: version)? 2 0
mpl-1.1 | 70 | 95 | mozilla | mozilla public license(?: version)? 1 1
mpl | 30 | 60 | mozilla | mozilla public licen[sc]e
epl-1 | 70 | 90 | eclipse | eclipse public license(?: v)?(?: version)? 1 0
epl-2 | 70 | 90 | eclipse | eclipse public license(?: v)?(?: version)? 2 0
edl-1 | 70 | 90 | eclipse | eclipse distribution license(?: v)? 1 0
cddl-1 | 70 | 90 | distribution | common development and distribution license(?: version)?(?: 1 [01])?
cpl-1 | 70 | 90 | common | common public license(?: version)?(?: 1 0)?
eupl | 70 | 90 | european | european union public licen[sc]e
bsl-1 | 70 | 95 | boost | boost software license(?: version)?(?: 1 0)?
unlicense | 70 | 95 | unencumbered | this is free and unencumbered software released into the public domain
public-domain | 50 | 70 | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
wtfpl | 70 | 95 | what | do what the f\w+ you want to public license
artistic-2 | 70 | 90 | artistic | the artistic license(?: version)? 2 0
ofl-1.1 | 70 | 95 | sil | sil open font license(?: version)?(?: 1 1)?
ncsa | 70 | 90 | ncsa | university of illinois ncsa open source license
python-2 | 70 | 90 | python | python software foundation license(?: version 2)?
upl-1 | 70 | 90 | universal | universal permissive license(?: v)?(?: 1 0)?
sspl-1 | 70 | 90 | server | server side public license
bsl-1.1 | 70 | 90 | business | business source license(?: 1 1)?
elastic-2 | 70 | 90 | elastic | elastic license(?: 2 0)?
commons-clause | 80 | 90 | commons | commons clause(?: license)? condition
odbl-1 | 70 | 90 | database | open (?:data commons open )?database license
cc0-1 | 70 | 90 | creative | creative commons (?:cc0|zero)(?: 1 0)?
cc-by-nc-nd | 78 | 95 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | 78 | 95 | creative | creative commons attribution non ?commercial share ?alike
cc-by-nc | 74 | 95 | creative | creative commons attribution non ?commercial
cc-by-nd | 74 | 95 | creative | creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa | 74 | 95 | creative | creative commons attribution share ?alike
cc-by | 70 | 90 | creative | creative commons attribution
cc | 30 | 50 | creative | creative commons licen[sc]e
cc-by-nc-nd | 78 | 95 | creativecommons | creativecommons org licenses by nc nd
cc-by-nc-sa | 78 | 95 | creativecommons | creativecommons org licenses by nc sa
cc-by-nc | 74 | 95 | creativecommons | creativecommons org licenses by nc
cc-by-nd | 74 | 95 | creativecommons | creativecommons org licenses by nd
cc-by-sa | 74 | 95 | creativecommons | creativecommons org licenses by sa
cc-by | 70 | 90 | creativecommons | creativecommons org licenses by
cc0-1 | 74 | 95 | creativecommons | creativecommons org publicdomain zero
proprietary | 50 | 80 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 40 | 60 | unauthorized | unauthorized (?:copying|use|distribution)(?: or \w+)? (?:of this file )?(?:via any medium )?is (?:strictly )?prohibited
all-rights-reserved | 20 | 50 | reserved | all rights reserved
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: str


def _lines(table: str) -> list[list[str]]:
    return [[part.strip() for part in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules, base phrases first; the place in the list is the last tie-break."""
    out = [Rule(label, 1000, 1.0, (phrase.split()[-2],), phrase) for phrase, label in BASE.items()]
    out += [Rule(label, int(p), int(c) / 100, tuple(k.split()), pattern) for label, p, c, k, pattern in _lines(SIGNATURES)]
    for label, keyword, name in _lines(FAMILIES):
        out.append(Rule(label, 90, 1.0, (keyword,), rf"spdx license identifier {name}"))
        out.append(Rule(label, 65, 0.9, (keyword,), rf"(?:under|licen[sc]ed|by) (?:the )?(?:terms of )?(?:the )?{name}(?: licen[sc]e)?"))
        out.append(Rule(label, 45, 0.7, (keyword,), rf"(?:{name} licen[sc]e|licen[sc]e {name})"))
    return out


@cache
def _compiled() -> tuple[list[Rule], list[re.Pattern], list[str], np.ndarray, list[list[int]]]:
    listed = rules()
    # Words are joined by spaces; other blanks of Unicode are letters of words.
    patterns = [re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in listed]
    keywords = sorted({k for r in listed for k in r.keywords})
    slab = split_words([k.encode() for k in keywords], ALNUM, lower=True)
    gates = [[i for i, r in enumerate(listed) if k in r.keywords] for k in keywords]
    return listed, patterns, keywords, slab.hashes, gates


def settle(found: list[tuple[int, int, int]], listed: list[Rule]) -> list[tuple[int, int, int]]:
    """Detections ``(start, end, rule)`` that stay, in order of place."""
    ranked = sorted(found, key=lambda f: (-listed[f[2]].priority, f[0] - f[1], f[0], f[2]))
    kept: list[tuple[int, int, int]] = []
    for start, end, rule in ranked:
        label, base = listed[rule].label, listed[rule].priority >= 1000
        # Kept detections overlap only if of one label, so neighbours are few.
        clash = [k for k in kept if k[0] < end and start < k[1]]
        if base or not clash or (all(listed[k[2]].label == label for k in clash) and not any(k[0] <= start and end <= k[1] for k in clash)):
            kept.append((start, end, rule))
    return sorted(kept)


def scan_text(text: str, candidates: list[int]) -> list[tuple[int, int, int]]:
    """Detections in words joined by spaces, as character spans."""
    listed, patterns, *_ = _compiled()
    found = [(m.start(), m.end(), i) for i in candidates for m in patterns[i].finditer(text)]
    if not found:
        return []
    # Only detections that hang together can suppress each other: settle one cluster at a time.
    found.sort()
    out, cluster, end = [], [], -1
    for f in found:
        if f[0] >= end and cluster:
            out += settle(cluster, listed)
            cluster = []
        cluster.append(f)
        end = max(end, f[1])
    return out + settle(cluster, listed)


_DETECTION = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("rule", pa.int32()), ("confidence", pa.float64()), ("base", pa.bool_())])


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``n_words`` and ``detections`` (first and last word, label, rule number, confidence, whether a base phrase).

    Words are letters, digits and all beyond ASCII. Null and empty texts have no words and no detections. Rows are judged
    one by one, so repeated rows are alike; other columns are not read.
    """

    def task(batches):
        listed, _, _, hashes, gates = _compiled()
        order = np.argsort(hashes)
        for rest, texts in slabs(batches, text):
            slab = split_words(texts, ALNUM, lower=True)
            at = np.minimum(np.searchsorted(hashes[order], slab.hashes), len(order) - 1)
            hit = np.flatnonzero(hashes[order][at] == slab.hashes)
            pairs = np.unique(slab.doc[hit] * len(order) + order[at[hit]])
            gated: dict[int, set[int]] = {}
            for doc, keyword in zip((pairs // len(order)).tolist(), (pairs % len(order)).tolist(), strict=True):
                gated.setdefault(doc, set()).update(gates[keyword])
            detections: list[list[dict]] = [[] for _ in texts]
            raw = slab.data.tobytes() if gated else b""
            for doc, candidates in gated.items():
                a, b = slab.first[doc], slab.first[doc + 1]
                words = [raw[s:e].decode() for s, e in zip(slab.start[a:b].tolist(), slab.end[a:b].tolist(), strict=True)]
                found = scan_text(" ".join(words), sorted(candidates))
                if found:
                    starts = np.cumsum([0] + [len(w) + 1 for w in words])
                    for s, e, rule in found:
                        first, last = np.searchsorted(starts, [s, e], side="right") - 1
                        r = listed[rule]
                        detections[doc].append({"first_word": int(first), "last_word": int(last), "label": r.label, "rule": rule, "confidence": r.confidence, "base": r.priority >= 1000})
            yield from pa.table({"key": rest.column(0), "n_words": slab.counts.astype(np.int64), "detections": pa.array(detections, pa.list_(_DETECTION))}).to_batches()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words bigint, detections array<struct<first_word: bigint, last_word: bigint, label: string, rule: int, confidence: double, base: boolean>>"
    return map_arrow(docs.select(docs[key].alias("key"), text), task, schema).withColumnRenamed("key", key)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(load(spark, sf_dir, "documents", "doc_id", "text"))
    return found.selectExpr(
        "doc_id", "n_words", "cast(size(filter(detections, d -> d.base)) as bigint) AS n_base",
        "array_min(transform(filter(detections, d -> d.base), d -> d.first_word)) AS first_word",
        "array_max(transform(filter(detections, d -> d.base), d -> d.first_word)) AS last_word",
        "array_join(array_sort(array_distinct(transform(filter(detections, d -> d.base), d -> d.label))), ',') AS base_labels",
        "array_join(array_sort(array_distinct(transform(detections, d -> d.label))), ',') AS labels",
        "coalesce(array_max(transform(detections, d -> d.confidence)), 0D) AS score",
    )
