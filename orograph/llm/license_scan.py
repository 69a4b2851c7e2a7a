"""Operator 1, licence scans.

Ordered signature rules: every rule is a regex written for one form of one
licence (grant sentence, title, SPDX tag, short name, address). A keyword
automaton reads the lower-cased text once, with runs of white space, ``_`` and
``-`` as one space; only rules one of whose keywords
occurs are run. Detections are taken by priority, then start; one that overlaps
an accepted detection of a higher priority, or lies within one of its own, is
suppressed. Partial overlaps of one priority both stay, as they can be two
licences side by side.

Defined results: a null or empty text has no words and no detection; texts are
scanned whole, however long, in memory of one text; ties of one priority and
start go to the longer detection; repeated rows give equal rows; an empty table
gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from orograph.llm.common import map_rows, table

#: The contract's words and phrases.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: (SPDX ids, names as regexes, keywords of the names, address as regex). Text is lower case.
LICENSES: dict[str, tuple[list[str], list[str], list[str], str]] = {
    "mit": (["mit", "mit-0", "x11"], [r"mit", r"mit/x11", r"expat"], ["mit", "expat"], r"opensource\.org/licenses/mit"),
    "apache": (["apache-2.0", "apache-1.1", "apache-1.0"], [r"apache", r"asl"], ["apache", "asl"], r"apache\.org/licenses"),
    "gpl": (["gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"], [r"(?:gnu )?general public", r"gnu gpl", r"gpl"], ["general public", "gpl"], r"gnu\.org/licenses/gpl"),
    "lgpl": (["lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"], [r"(?:gnu )?(?:lesser|library) general public", r"lgpl"], ["general public", "lgpl"], r"gnu\.org/licenses/lgpl"),
    "agpl": (["agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"], [r"(?:gnu )?affero general public", r"agpl"], ["affero", "agpl"], r"gnu\.org/licenses/agpl"),
    "gfdl": (["gfdl-1.2", "gfdl-1.3"], [r"(?:gnu )?free documentation", r"gfdl"], ["free documentation", "gfdl"], r"gnu\.org/licenses/fdl"),
    "bsd-2-clause": (["bsd-2-clause"], [r"(?:bsd )?2-clause(?: bsd)?", r"simplified bsd", r"freebsd"], ["2-clause", "simplified bsd", "freebsd"], r"opensource\.org/licenses/bsd-2-clause"),
    "bsd-3-clause": (["bsd-3-clause"], [r"(?:bsd )?3-clause(?: bsd)?", r"(?:new|modified|revised) bsd"], ["3-clause", "new bsd", "modified bsd", "revised bsd"], r"opensource\.org/licenses/bsd-3-clause"),
    "bsd": (["0bsd", "bsd-4-clause"], [r"bsd"], ["bsd"], r"opensource\.org/licenses/bsd"),
    "isc": (["isc"], [r"isc"], ["isc"], r"opensource\.org/licenses/isc"),
    "mpl": (["mpl-1.1", "mpl-2.0"], [r"mozilla public", r"mpl"], ["mozilla", "mpl"], r"mozilla\.org/(?:mpl|en-us/mpl)"),
    "epl": (["epl-1.0", "epl-2.0"], [r"eclipse public", r"epl"], ["eclipse", "epl"], r"eclipse\.org/legal/epl"),
    "edl": (["edl-1.0"], [r"eclipse distribution"], ["eclipse"], r"eclipse\.org/org/documents/edl"),
    "cddl": (["cddl-1.0", "cddl-1.1"], [r"common development and distribution", r"cddl"], ["common development", "cddl"], r"opensource\.org/licenses/cddl"),
    "cpl": (["cpl-1.0"], [r"common public"], ["common public"], r"opensource\.org/licenses/cpl"),
    "eupl": (["eupl-1.1", "eupl-1.2"], [r"european union public", r"eupl"], ["european union public", "eupl"], r"eupl\.eu"),
    "artistic": (["artistic-1.0", "artistic-2.0"], [r"(?:perl )?artistic"], ["artistic"], r"opensource\.org/licenses/artistic"),
    "boost": (["bsl-1.0"], [r"boost(?: software)?"], ["boost"], r"boost\.org/license"),
    "zlib": (["zlib"], [r"zlib(?:/libpng)?"], ["zlib"], r"zlib\.net/zlib_license"),
    "libpng": (["libpng", "libpng-2.0"], [r"libpng"], ["libpng"], r"libpng\.org"),
    "unlicense": (["unlicense"], [r"the unlicense"], ["unlicense"], r"unlicense\.org"),
    "wtfpl": (["wtfpl"], [r"wtfpl", r"do what the fuck you want to public"], ["wtfpl", "do what the"], r"wtfpl\.net"),
    "python": (["psf-2.0", "python-2.0"], [r"python software foundation", r"psf"], ["python software", "psf"], r"python\.org/psf"),
    "php": (["php-3.0", "php-3.01"], [r"php"], ["php"], r"php\.net/license"),
    "ruby": (["ruby"], [r"ruby"], ["ruby"], r"ruby-lang\.org/en/about/license"),
    "openssl": (["openssl"], [r"openssl"], ["openssl"], r"openssl\.org/source/license"),
    "ofl": (["ofl-1.0", "ofl-1.1"], [r"(?:sil )?open font", r"ofl"], ["open font", "ofl"], r"scripts\.sil\.org/ofl"),
    "ms-pl": (["ms-pl"], [r"microsoft public"], ["microsoft public", "ms-pl"], r"opensource\.org/licenses/ms-pl"),
    "ms-rl": (["ms-rl"], [r"microsoft reciprocal"], ["microsoft reciprocal", "ms-rl"], r"opensource\.org/licenses/ms-rl"),
    "odbl": (["odbl-1.0"], [r"open database", r"odbl"], ["open database", "odbl"], r"opendatacommons\.org/licenses/odbl"),
    "odc-by": (["odc-by-1.0"], [r"open data commons attribution"], ["open data commons", "odc-by"], r"opendatacommons\.org/licenses/by"),
    "pddl": (["pddl-1.0"], [r"public domain dedication"], ["public domain dedication", "pddl"], r"opendatacommons\.org/licenses/pddl"),
    "sspl": (["sspl-1.0"], [r"server side public", r"sspl"], ["server side", "sspl"], r"mongodb\.com/licensing/server-side"),
    "busl": (["busl-1.1"], [r"business source"], ["business source", "busl"], r"mariadb\.com/bsl"),
    "elastic": (["elastic-2.0"], [r"elastic"], ["elastic"], r"elastic\.co/licensing/elastic-license"),
    "upl": (["upl-1.0"], [r"universal permissive"], ["universal permissive", "upl"], r"opensource\.org/licenses/upl"),
    "ncsa": (["ncsa"], [r"university of illinois(?:/ncsa)?(?: open source)?", r"ncsa"], ["university of illinois", "ncsa"], r"opensource\.org/licenses/ncsa"),
    "postgresql": (["postgresql"], [r"postgresql"], ["postgresql"], r"postgresql\.org/about/licence"),
    "afl": (["afl-3.0"], [r"academic free", r"afl"], ["academic free", "afl"], r"opensource\.org/licenses/afl"),
    "osl": (["osl-3.0"], [r"open software", r"osl"], ["open software", "osl"], r"opensource\.org/licenses/osl"),
    "qpl": (["qpl-1.0"], [r"q public", r"qpl"], ["q public", "qpl"], r"opensource\.org/licenses/qpl"),
    "w3c": (["w3c"], [r"w3c(?: software(?: notice)?)?"], ["w3c"], r"w3\.org/consortium/legal"),
    "mulan": (["mulanpsl-2.0"], [r"mulan permissive software"], ["mulan"], r"license\.coscl\.org\.cn"),
    "cecill": (["cecill-2.1", "cecill-b", "cecill-c"], [r"cecill(?:-[bc])?"], ["cecill"], r"cecill\.info"),
}
#: Creative Commons: label: (short element, long name).
COMMONS = {
    "cc-by": ("by", "attribution"),
    "cc-by-sa": ("by-sa", "attribution share-?alike"),
    "cc-by-nc": ("by-nc", "attribution non-?commercial"),
    "cc-by-nd": ("by-nd", "attribution no-?deriv(?:ative)?s?"),
    "cc-by-nc-sa": ("by-nc-sa", "attribution non-?commercial share-?alike"),
    "cc-by-nc-nd": ("by-nc-nd", "attribution non-?commercial no-?deriv(?:ative)?s?"),
}
#: Sentences of licence bodies, by hand, a line each: label, regex (a space stands for any white space), keyword.
BODIES = [tuple(line.split(" | ")) for line in r'''
mit | permission is hereby granted, free of charge, to any person obtaining a copy | permission is hereby granted
mit | the software is provided "as is", without warranty of any kind | the software is provided
mit | the above copyright notice and this permission notice shall be included in all copies | this permission notice
mit | in no event shall the authors or copyright holders be liable for any claim | authors or copyright holders
mit | to deal in the software without restriction | without restriction
isc | permission to use, copy, modify, and/?(?:or )?distribute this software for any purpose | permission to use, copy
isc | the author disclaims all warranties with regard to this software | disclaims all warranties
bsd | redistribution and use in source and binary forms, with or without modification | redistribution and use
bsd | redistributions of source code must retain the above copyright notice | redistributions of source
bsd | redistributions in binary form must reproduce the above copyright notice | redistributions in binary
bsd | this software is provided by the (?:copyright holders|regents|author)[^.]{0,60}? "?as is"? and any express or implied | express or implied
bsd-3-clause | neither the name of [\s\S]{1,120}? may be used to endorse or promote products | endorse or promote
bsd-4-clause | all advertising materials mentioning features or use of this software must display | advertising materials
bsd-2-clause-patent | subject to the terms and conditions of this license, each copyright holder and contributor hereby grants | each copyright holder
apache | you may not use this file except in compliance with the license | except in compliance
apache | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable | each contributor hereby
apache | unless required by applicable law or agreed to in writing, software distributed under the license | agreed to in writing
apache | this product includes software developed (?:by|at) the apache software foundation | apache software foundation
gpl | this program is free software[:;,] you can redistribute it | this program is free software
gpl | everyone is permitted to copy and distribute verbatim copies of this license document | verbatim copies
gpl | either version [23] of the license, or \(?at your option\)? any later version | any later version
gpl | you should have received a copy of the gnu general public license | you should have received
gpl | the licenses for most software are designed to take away your freedom | take away your freedom
gpl | this program comes with absolutely no warranty | absolutely no warranty
gpl | as a special exception, (?:the copyright holders|you may create|the free software foundation) | as a special exception
lgpl | this library is free software[:;,] you can redistribute it | this library is free software
lgpl | a program that contains no derivative of any portion of the library | no derivative of any
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license | you should have received
lgpl | this version of the gnu lesser general public license incorporates the terms | lesser general public
agpl | if you modify the program, your modified version must prominently offer all users interacting with it remotely | interacting with it remotely
agpl | you should have received a copy of the gnu affero general public license | you should have received
gfdl | permission is granted to copy, distribute and/or modify this document under the terms | modify this document
gfdl | with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts | invariant sections
mpl | this source code form is subject to the terms of the mozilla public | source code form
mpl | if a copy of the mpl was not distributed with this file | mpl was not distributed
mpl | the contents of this file are subject to the mozilla public license | contents of this file
cddl | the contents of this file are subject to the terms of the common development and distribution | contents of this file
cddl | when distributing covered code, include this cddl header | distributing covered code
epl | this program and the accompanying materials are made available under the terms of the eclipse | accompanying materials
epl | the accompanying materials are provided under the terms of this eclipse public | accompanying materials
cpl | the accompanying program is provided under the terms of this common public | accompanying program
eupl | licensed under the eupl, version 1\.[12] or - as soon they will be approved | as soon they will be approved
unlicense | this is free and unencumbered software released into the public domain | free and unencumbered
unlicense | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software | anyone is free to copy
boost | permission is hereby granted, free of charge, to any person or organization obtaining | person or organization
boost | must be included in all copies of the software, in whole or in part, and all derivative works | all derivative works
zlib | this software is provided 'as-is', without any express or implied warranty | provided 'as-is'
zlib | the origin of this software must not be misrepresented | must not be misrepresented
zlib | altered source versions must be plainly marked as such | plainly marked
libpng | the png reference library is supplied "?as is"? | png reference library
artistic | the "?artistic license"? which comes with this kit | comes with this kit
artistic | the copyright holder maintains some semblance of artistic control | artistic control
wtfpl | you just do what the fuck you want to | do what the fuck
python | psf hereby grants licensee a nonexclusive, royalty-free, world-wide license | psf hereby grants
python | beopen python open source license agreement | beopen
python | cnri grants licensee a nonexclusive, royalty-free | cnri grants
php | this product includes php software, freely available from | includes php software
ruby | you may make and give away verbatim copies of the source form of the software | give away verbatim
openssl | this product includes software developed by the openssl project | the openssl project
openssl | this product includes cryptographic software written by eric young | cryptographic software written
ofl | this license is made available with a faq | available with a faq
ofl | the font software may be sold as part of a larger software package | the font software
ofl | with reserved font name | reserved font name
ms-pl | if you use the software, you accept this license\. if you do not accept the license, do not use | you accept this license
ms-rl | for any file you distribute that contains code from the software \(in source code or binary format\) | contains code from the software
odbl | this database is made available under the open database license | this database is made
odbl | any rights in individual contents of the database are licensed under | individual contents
sspl | if you make the functionality of the program or a modified version available to third parties as a service | third parties as a service
busl | the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use | non-production use
busl | effective on the change date, or the fourth anniversary of the first publicly available distribution | the change date
elastic | you may not provide the software to third parties as a hosted or managed service | hosted or managed service
elastic | you may not move, change, disable, or circumvent the license key functionality | license key functionality
upl | the above copyright notice and either this complete permission notice or at a minimum a reference to the upl | reference to the upl
ncsa | permission to deal with the software without restriction | without restriction
ncsa | to deal with the software without restriction, including without limitation the rights | without restriction
postgresql | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee | without fee
afl | licensed under the academic free license version | academic free
osl | licensed under the open software license version | open software
qpl | this license applies to any software containing a notice placed by the copyright holder saying | notice placed by
w3c | by obtaining,? (?:using and/or copying )?this work, (?:you|the licensee) .{0,40}?agree | this work
mulan | subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, royalty-free, non-exclusive, irrevocable copyright | each contributor hereby
cecill | this software is governed by the cecill(?:-[bc])? license under french law | governed by the cecill
hpnd | permission to use, copy, modify and distribute this software and its documentation for any purpose (?:is hereby granted|and without fee) | its documentation
ijg | this software is based in part on the work of the independent jpeg group | independent jpeg group
freetype | portions of this software are copyright .{0,40}? the freetype project | the freetype project
icu | copyright .{0,60}?international business machines corporation and others\. all rights reserved | international business machines
unicode | permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files | unicode data files
curl | permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies | with or without fee
tcl | the authors hereby grant permission to use, copy, modify, distribute, and license this software | the authors hereby grant
vim | if you distribute a modified version of vim | modified version of vim
latex | this work may be distributed and/or modified under the conditions of the latex project public license | latex project public
latex | this work has the lppl maintenance status | lppl maintenance
json | the software shall be used for good, not evil | good, not evil
beerware | as long as you retain this notice you can do whatever you want with this stuff | whatever you want with this stuff
zpl | this software is subject to the provisions of the zope public license | zope public
sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code | complete source code
nasa | this open source software agreement .{0,40}?is a license agreement|the nasa open source agreement | open source
openldap | the openldap public license | openldap public
apsl | the contents of this file constitute original code as defined in and are subject to the apple public source | apple public source
intel | intel grants you|intel corporation[^.]{0,80}? grants | intel
nvidia | nvidia corporation and its licensors retain all intellectual property | nvidia corporation
oracle-bcl | oracle binary code license agreement | oracle binary code
cc-by | this work is licensed under (?:a|the) creative commons attribution(?! ?-?(?:non|share|no)) | creative commons attribution
cc0 | to the extent possible under law, .{0,120}? (?:has|have) waived all copyright | possible under law
cc0 | affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives | affirmer hereby
community-data | community data license agreement | community data license
responsible-ai | (?:bigscience|creativeml|openrail)[^.]{0,20}? (?:open )?rail(?:-m|\+\+-m)? license | rail
llama-community | llama [0-9.]* ?community license agreement | community license
public-domain | (?:released|dedicated|placed) (?:in|in?to) the public domain | public domain
public-domain | (?:this (?:work|file|software)|it) is in the public domain | public domain
public-domain | no rights reserved | no rights reserved
all-rights-reserved | all rights reserved | all rights reserved
proprietary | (?:proprietary and confidential|confidential and proprietary) | confidential
proprietary | unauthori[sz]ed (?:copying|distribution|use) of (?:this|the) \w+ | unauthori
proprietary | no part of this (?:work|publication|document|book) may be reproduced | may be reproduced
proprietary | may not be (?:copied|reproduced|redistributed)[^.]{0,60}? without (?:the )?(?:prior|express)? ?(?:written )?permission | permission
proprietary | for personal(?:,| and) non-?commercial use only | personal
proprietary | evaluation (?:copy|license)[^.]{0,30}? only | evaluation
end-user | end[ -]user licen[cs]e agreement | end user
end-user | by (?:installing|downloading|clicking)[^.]{0,60}? you (?:agree|accept) | you
dual | (?:dual|multi)[ -]licensed | licensed
dual | licensed under either of | licensed under either
'''.strip().splitlines()]
#: A licence that is something else: a plate, a holder, a fee.
LICENCE, GAP = r"licen[cs]es?(?!\s+(?:plates?|holders?|keys?|fees?|servers?|managers?|plans?|numbers?|costs?|revenues?|exams?|renewals?|tests?)\b)", r"[\s,;:()\"'_-]+"
VERSION = rf"(?:{GAP}(?:version|v\.?)?\s*\d+(?:\.\d+)*)?"


BASE_PRIORITY = 30


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    context: tuple[str, ...]  # one of these must occur as well; empty: none is needed
    priority: int  # larger wins
    confidence: float


def _spaced(name: str) -> str:
    return name.replace(" ", r"[\s_-]+")


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """The ordered rules, by falling priority: sentences of bodies, grants, SPDX tags, titles, addresses, bare names."""
    out = [Rule(label, re.compile(p.replace(" ", r"\s+")), (k,), (), 100, 0.95) for label, p, k in BODIES]
    granted = "licensed released distributed available published covered provided"

    def family(label: str, ids: list[str], names: list[str], keywords: list[str], address: str, noun: str) -> None:
        keys, context = tuple(keywords), () if "\\d" in noun else ("licen",)
        for name in names:
            n = _spaced(name)
            out.append(Rule(label, re.compile(rf"\b(?:{granted.replace(' ', '|')})\s+(?:\w+\s+){{0,3}}?(?:under|by)\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?)?(?:gnu\s+)?{n}\b(?:[\s_-]+{noun})?{VERSION}"), keys, tuple(granted.split()), 90, 0.95))
            out.append(Rule(label, re.compile(rf"\bsubject\s+to\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{n}\b[\s_-]+{noun}{VERSION}"), keys, ("subject",), 85, 0.9))
            out.append(Rule(label, re.compile(rf"\b(?:the\s+)?{n}[\s_-]+{noun}\b{VERSION}"), keys, context, 60, 0.8))
            out.append(Rule(label, re.compile(rf"\blicen[cs]e\s*[:=]\s*[\"']?{n}\b{VERSION}"), keys, ("licen",), 70, 0.85))
        for spdx in ids:
            out.append(Rule(label, re.compile(rf"\bspdx-license-identifier:\s*{re.escape(spdx)}(?![\w.-])"), ("spdx-license-identifier",), (), 95, 1.0))
            if "-" in spdx:
                out.append(Rule(label, re.compile(rf"(?<![\w.-]){re.escape(spdx)}(?![\w-])"), (spdx,), (), 40, 0.6))
        out.append(Rule(label, re.compile(rf"https?://(?:www\.)?{address}"), (re.sub(r"\\|\(.*", "", address)[:12],), ("://",), 50, 0.75))

    for label, (ids, names, keywords, address) in LICENSES.items():
        family(label, ids, names, keywords, address, LICENCE)
    for label, (short, long) in COMMONS.items():
        family(label, [f"cc-{short}-{v}" for v in ("2.0", "3.0", "4.0")], [rf"cc {short}(?!-)", rf"creative commons {long}"], ["cc by", "cc-by", "creative commons"], rf"creativecommons\.org/licenses/{short}/", rf"(?:{LICENCE}|\d\.\d)")
    family("cc0", ["cc0-1.0"], [r"cc0", r"creative commons zero"], ["cc0", "creative commons"], r"creativecommons\.org/publicdomain/zero", rf"(?:{LICENCE}|1\.0)")
    # The contract's phrases: their words one after the other, whatever stands between.
    edge, between = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F]){}(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out += [Rule(label, re.compile(edge.format(between.join(phrase.split()))), (phrase.split()[0],), ("license",), BASE_PRIORITY, 0.7) for phrase, label in BASE.items()]
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(1)
def automaton():
    """Aho-Corasick automaton: keyword -> (numbers of the rules that it gates, numbers of those that it is a context of)."""
    import ahocorasick

    by: dict[str, tuple[list[int], list[int]]] = {}
    for i, rule in enumerate(rules()):
        for k in rule.keywords:
            by.setdefault(squeezed(k), ([], []))[0].append(i)
        for k in rule.context:
            by.setdefault(squeezed(k), ([], []))[1].append(i)
    a = ahocorasick.Automaton()
    for k, v in by.items():
        a.add_word(k, (k, *map(frozenset, v)))
    a.make_automaton()
    return a


def lower(text: str) -> str:
    """A-Z to a-z, other letters as they are."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def squeezed(text: str) -> str:
    """Runs of white space, ``_`` and ``-`` as one space, as the rules take any of them between words."""
    return " ".join(text.replace("_", " ").replace("-", " ").split())


def merged(intervals: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of sorted intervals, with those that overlap as one."""
    starts, ends = [], []
    for s, e in intervals:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def detections(text: str) -> tuple[list[tuple[int, int, str, int, float]], list[tuple[int, int, str]]]:
    """Accepted detections (start, end, label, priority, confidence) of a lower-cased text, and every match of a base phrase (start, end, phrase)."""
    table_ = rules()
    seen = {x[0]: x for _, x in automaton().iter(squeezed(text))}
    gated: set[int] = set().union(*(x[1] for x in seen.values()))
    near: set[int] = set().union(*(x[2] for x in seen.values()))
    wanted = [i for i in gated if i in near or not table_[i].context]
    base: list[tuple[int, int, str]] = []
    found: dict[int, list[tuple[int, int, int]]] = {}  # by priority: start, -end, rule
    for i in wanted:
        rule = table_[i]
        for m in rule.pattern.finditer(text):
            s, e = m.span()
            if rule.priority == BASE_PRIORITY:
                base.append((s, e, rule.label))
            found.setdefault(rule.priority, []).append((s, -e, i))
    accepted: list[tuple[int, int, str, int, float]] = []
    starts: list[int] = []  # of what higher priorities hold, as disjoint intervals
    ends: list[int] = []
    for priority in sorted(found, reverse=True):
        reach, kept = -1, []
        for s, e, i in sorted(found[priority]):
            at = bisect_left(starts, -e)
            if -e <= reach or at and ends[at - 1] > s:
                continue
            reach = -e
            kept.append((s, -e))
            accepted.append((s, -e, table_[i].label, priority, table_[i].confidence))
        starts, ends = merged(sorted([*zip(starts, ends, strict=True), *kept]))
    return sorted(accepted), base


def scan(texts: list[str | None]) -> list[tuple]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each text."""
    out = []
    for raw in texts:
        text = lower(raw or "")
        found, base = detections(text)
        n = len(WORD.findall(text))
        first = last = None
        if base:
            starts = [s for s, _, _ in base]
            lo, hi = min(starts), max(starts)
            first = len(WORD.findall(text, 0, lo))
            last = first + len(WORD.findall(text, lo, hi))
        labels = sorted({x[2] for x in found} | {x[2] for x in base})
        miss = 1.0
        for x in found:
            miss *= 1 - x[4]
        score = 1 - miss if found else (0.7 if base else 0.0)
        out.append((n, len(base), first, last, ",".join(sorted({x[2] for x in base})), ",".join(labels), score, ",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in found)))
    return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


def license_scan(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Licence detections of each row: a map without a shuffle."""
    return map_rows(df, scan, keys, text, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), ["doc_id"])


def base_license_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can express."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {"op1_license_scan": op1_license_scan, "base_license_words": base_license_words}
ORACLE_SQL = {
    "base_license_words": r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
hit AS (SELECT doc_id, i, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label FROM places)
SELECT w.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(label) AS n_base, min(i) FILTER (label IS NOT NULL) - 1 AS first_word, max(i) FILTER (label IS NOT NULL) - 1 AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id AND label IS NOT NULL GROUP BY w.doc_id"""
}
