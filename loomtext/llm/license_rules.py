"""The signatures of the license scan: ordered rules, each a regular expression over words.

Texts are matched as lower-case words with one space between them, so "GPL-2.0", "gpl 2.0" and "GPL, 2.0" all read "gpl 2 0". Expressions
are written in that form. V stands for "version", "v" or nothing before a number, and a rule begins and ends at word boundaries.
"""
from __future__ import annotations

import functools
import re
from dataclasses import dataclass

#: Priorities: what names a license beyond doubt comes first. VOID rules bear no label; they only take away what they overlap.
VOID, IDENTIFIER, NOTICE, BODY, NAME, HINT = range(6)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str  # "" for a rule that only suppresses
    priority: int
    strength: float
    keywords: tuple[str, ...]  # words of which a text must hold one for the expression to be tried
    pattern: str
    base: bool = False


#: Phrases whose every place is reported, whatever other rules say: words, keyword, label, strength.
BASE = [("cc by", "cc", "cc-by", 0.7), ("general public license", "general", "gpl", 0.8), ("all rights reserved", "reserved", "reserved", 0.4)]

#: Families of licenses: label, keywords, name, short name, versions as words; a name without its version is a rule too.
FAMILIES = [
    ("apache", "apache asl apache2", r"apache (?:software )?licen[sc]e", r"apache|asl|apache2", ("1 0", "1 1", "2 0")),
    ("gpl", "gpl gnu", r"gnu (?:gpl|general public licen[sc]e)", r"gpl", ("1 0", "2 0", "3 0")),
    ("lgpl", "lgpl lesser library", r"(?:gnu )?(?:lesser|library) (?:gpl|general public licen[sc]e)", r"lgpl", ("2 0", "2 1", "3 0")),
    ("agpl", "agpl affero", r"(?:gnu )?affero (?:gpl|general public licen[sc]e)", r"agpl", ("1 0", "3 0")),
    ("gfdl", "gfdl fdl documentation", r"gnu free documentation licen[sc]e", r"gfdl|gnu fdl", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla mpl", r"mozilla public licen[sc]e", r"mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse epl", r"eclipse public licen[sc]e", r"epl", ("1 0", "2 0")),
    ("cddl", "cddl distribution", r"common development and distribution licen[sc]e", r"cddl", ("1 0", "1 1")),
    ("cpl", "cpl common", r"common public licen[sc]e", r"cpl", ("1 0",)),
    ("eupl", "eupl european", r"european union public licen[sc]e", r"eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", r"artistic licen[sc]e", r"artistic", ("1 0", "2 0")),
    ("bsl", "boost bsl", r"boost software licen[sc]e", r"bsl|boost", ("1 0",)),
    ("osl", "osl open", r"open software licen[sc]e", r"osl", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "afl academic", r"academic free licen[sc]e", r"afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ofl", "ofl sil font", r"(?:sil )?open font licen[sc]e", r"ofl", ("1 0", "1 1")),
    ("ecl", "ecl educational", r"educational community licen[sc]e", r"ecl", ("1 0", "2 0")),
    ("lppl", "lppl latex", r"latex project public licen[sc]e", r"lppl", ("1 0", "1 1", "1 2", "1 3")),
    ("cecill", "cecill", r"cecill (?:free software )?licen[sc]e", r"cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("ms-pl", "microsoft ms", r"microsoft public licen[sc]e", r"ms pl", ()),
    ("ms-rl", "microsoft ms", r"microsoft reciprocal licen[sc]e", r"ms rl", ()),
    ("apsl", "apsl apple", r"apple public source licen[sc]e", r"apsl", ("1 0", "1 1", "1 2", "2 0")),
    ("npl", "netscape npl", r"netscape public licen[sc]e", r"npl", ("1 0", "1 1")),
    ("qpl", "qpl q", r"q public licen[sc]e", r"qpl", ("1 0",)),
    ("zpl", "zope zpl", r"zope public licen[sc]e", r"zpl", ("1 1", "2 0", "2 1")),
    ("php", "php", r"php licen[sc]e", r"php", ("3 0", "3 01")),
    ("python", "python psf", r"(?:python software foundation|psf|python) licen[sc]e", r"psf", ("2 0",)),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e", r"w3c", ()),
    ("zlib", "zlib libpng", r"zlib(?: libpng)? licen[sc]e", r"zlib", ()),
    ("isc", "isc", r"isc licen[sc]e", r"isc", ()),
    ("mit", "mit expat x11", r"(?:mit(?: expat| x11)?|expat|x11) licen[sc]e", r"mit", ()),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[sc]e", r"ncsa", ()),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"postgresql", ()),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense", ()),
    ("wtfpl", "wtfpl fuck", r"do what the fuck you want to public licen[sc]e", r"wtfpl", ()),
    ("odbl", "odbl database", r"open database licen[sc]e", r"odbl", ("1 0",)),
    ("odc-by", "odc attribution", r"open data commons attribution licen[sc]e", r"odc by", ("1 0",)),
    ("pddl", "pddl dedication", r"public domain dedication and licen[sc]e", r"pddl", ("1 0",)),
    ("etalab", "etalab ouverte open", r"licence ouverte|open licence", r"etalab", ("1 0", "2 0")),
    ("ogl", "ogl government", r"open government licen[sc]e", r"ogl", ("1 0", "2 0", "3 0")),
    ("openrail", "openrail rail", r"(?:creativeml |bigscience )?open ?rail(?: m)? licen[sc]e", r"openrail", ()),
    ("sspl", "sspl side", r"server side public licen[sc]e", r"sspl", ("1 0",)),
    ("busl", "busl bsl business", r"business source licen[sc]e", r"busl|bsl", ("1 0", "1 1")),
]

#: Creative Commons: the elements beside attribution, and their long names.
COMMONS = {
    "by": r"attribution", "by-sa": r"attribution share ?alike", "by-nd": r"attribution no ?deriv(?:s|atives|ative works)", "by-nc": r"attribution non ?commercial",
    "by-nc-sa": r"attribution non ?commercial share ?alike", "by-nc-nd": r"attribution non ?commercial no ?deriv(?:s|atives|ative works)",
}
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Sentences that stand in the licenses themselves or in notices: label, keyword, priority, strength, expression.
SENTENCES = [
    ("mit", "hereby", BODY, 0.98, r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
    ("mit", "substantial", BODY, 0.9, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "fee", BODY, 0.98, r"permission to use copy modify and(?: or)? distribute this software(?: and its documentation)? for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", BODY, 0.97, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", BODY, 0.9, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", BODY, 0.9, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", BODY, 0.95, r"neither the name of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", BODY, 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "bsd freebsd", NAME, 0.85, r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", NAME, 0.85, r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", NAME, 0.85, r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[sc]e)?"),
    ("bsd", "bsd", NAME, 0.7, r"bsd (?:style )?licen[sc]e"),
    ("bsd", "bsd", NOTICE, 0.85, r"(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of (?:the |a )?)?bsd(?: style)? licen[sc]e"),
    ("0bsd", "bsd zero 0bsd", NAME, 0.85, r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)?"),
    ("apache-2.0", "apache", BODY, 0.97, r"you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at http www apache org licenses license 2 0"),
    ("apache-2.0", "apache", NOTICE, 0.95, r"(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache", "apache asl apache2", BODY, 0.85, r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("asl-notice", "compliance", HINT, 0.6, r"you may not use this file except in compliance with the licen[sc]e"),
    ("as-is", "basis", HINT, 0.4, r"distributed on an as is basis without warranties or conditions of any kind"),
    ("as-is", "warranty", HINT, 0.4, r"the software is provided as is without warranty of any kind"),
    ("as-is", "implied", HINT, 0.35, r"without any express or implied warrant(?:y|ies)"),
    ("gpl", "redistribute", BODY, 0.9, r"this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-1.0-or-later", "redistribute", BODY, 0.95, r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 1 (?:of the licen[sc]e )?or at your option any later version"),
    ("gpl-2.0-or-later", "redistribute", BODY, 0.98, r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 (?:of the licen[sc]e )?or at your option any later version"),
    ("gpl-3.0-or-later", "redistribute", BODY, 0.98, r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 (?:of the licen[sc]e )?or at your option any later version"),
    ("lgpl-2.1-or-later", "redistribute", BODY, 0.98, r"free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 (?:of the licen[sc]e )?or at your option any later version"),
    ("lgpl-3.0-or-later", "redistribute", BODY, 0.98, r"free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3 (?:of the licen[sc]e )?or at your option any later version"),
    ("agpl-3.0-or-later", "affero", BODY, 0.98, r"free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3 (?:of the licen[sc]e )?or at your option any later version"),
    ("gpl", "foundation", HINT, 0.5, r"as published by the free software foundation"),
    ("gpl-3.0", "gnu", NOTICE, 0.9, r"gnu org licenses gpl 3 0(?: en)?(?: html| txt)?"),
    ("gpl-2.0", "gnu", NOTICE, 0.9, r"gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?"),
    ("lgpl-3.0", "gnu", NOTICE, 0.9, r"gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?"),
    ("lgpl-2.1", "gnu", NOTICE, 0.9, r"gnu org licenses (?:old licenses )?lgpl 2 1(?: en)?(?: html| txt)?"),
    ("agpl-3.0", "gnu", NOTICE, 0.9, r"gnu org licenses agpl 3 0(?: en)?(?: html| txt)?"),
    ("gfdl", "gnu", NOTICE, 0.8, r"gnu org (?:copyleft|licenses) fdl(?: 1 [123])?(?: html| txt)?"),
    ("gpl-classpath", "classpath", BODY, 0.9, r"(?:gnu classpath|classpath) exception"),
    ("mpl-2.0", "mozilla", BODY, 0.98, r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0"),
    ("mpl-2.0", "mozilla", NOTICE, 0.9, r"mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", BODY, 0.95, r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("epl-1.0", "eclipse", NOTICE, 0.95, r"eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", "eclipse", NOTICE, 0.95, r"eclipse org legal epl (?:v20|2 0)(?: html)?"),
    ("bsl-1.0", "boost", NOTICE, 0.95, r"boost org license 1 0(?: txt)?"),
    ("zlib", "misrepresented", BODY, 0.95, r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", BODY, 0.9, r"altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", BODY, 0.97, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", NOTICE, 0.9, r"unlicense org"),
    ("public-domain", "domain", NOTICE, 0.8, r"(?:released|placed|dedicated|put)(?: (?:in|into|to))? the public domain"),
    ("public-domain", "domain", NAME, 0.6, r"(?:is|are) (?:in )?(?:the )?public domain"),
    ("public-domain", "domain", HINT, 0.3, r"public domain"),
    ("cc0-1.0", "cc0", NAME, 0.9, r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0-1.0", "zero", NAME, 0.85, r"creative commons zero(?: v?1 0)?"),
    ("cc0-1.0", "creativecommons", NOTICE, 0.95, r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "creativecommons", NOTICE, 0.9, r"creativecommons org publicdomain mark 1 0"),
    ("cc", "creative", HINT, 0.5, r"creative commons(?: licen[sc]e)?"),
    ("cc", "commons", NOTICE, 0.75, r"(?:licensed|released|available|published|distributed) under (?:a |the )?creative commons(?: licen[sc]e)?"),
    ("ofl-1.1", "ofl", NOTICE, 0.9, r"scripts sil org ofl"),
    ("reserved", "reserved", HINT, 0.4, r"(?:some|no) rights reserved"),
    ("copyright", "copyright", HINT, 0.3, r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("copyright", "copyright", HINT, 0.3, r"copyright (?:by|of|held by) [^ ]+"),
    ("copyright", "copyrighted", HINT, 0.3, r"(?:is|are) copyrighted(?: by)?"),
    ("proprietary", "proprietary", NOTICE, 0.7, r"proprietary and confidential"),
    ("proprietary", "prohibited", BODY, 0.8, r"unauthori[sz]ed (?:copying|reproduction|use) of this (?:file|document|software)(?: [^ ]+){0,8} is strictly prohibited"),
    ("proprietary", "permission consent", HINT, 0.5, r"may not be (?:reproduced|copied|redistributed)(?: or (?:reproduced|copied|redistributed|transmitted))?(?: [^ ]+){0,8} without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)"),
    ("proprietary", "eula agreement", NAME, 0.6, r"end user licen[sc]e agreement|eula"),
    ("non-commercial", "commercial noncommercial", HINT, 0.4, r"(?:for )?(?:non commercial|noncommercial) (?:use|purposes)(?: only)?"),
    ("json", "evil", BODY, 0.95, r"the software shall be used for good not evil"),
    ("beerware", "beer", BODY, 0.9, r"you can buy me a beer in return"),
    ("wtfpl", "fuck", BODY, 0.95, r"you just do what the fuck you want to"),
    ("ijg", "jpeg", BODY, 0.8, r"this software is based in part on the work of the independent jpeg group"),
    ("openssl", "openssl", BODY, 0.9, r"this product includes software developed by the openssl project"),
    ("curl", "curl", NAME, 0.7, r"curl licen[sc]e"),
    ("llama", "llama", NAME, 0.8, r"llama [0-9](?: [0-9])? community licen[sc]e(?: agreement)?"),
    ("", "plate plates", VOID, 0.0, r"(?:mit|isc|w3c|php|python|apache) licen[sc]e plates?"),
    ("", "not", VOID, 0.0, r"(?:is|are|was|were) not (?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of (?:the |a )?)?(?:[^ ]+ ){0,5}licen[sc]e(?: (?:version |v)?[0-9](?: [0-9])?)?"),
    ("", "not", VOID, 0.0, r"(?:is|are) not (?:in )?(?:the )?public domain"),
    ("", "apache", VOID, 0.0, r"apache (?:helicopters?|tribe|nation|county|junction) licen[sc]es?"),
    ("", "driver drivers driving fishing hunting marriage", VOID, 0.0, r"(?:drivers?|driver s|driving|fishing|hunting|marriage) licen[sc]es?"),
]

#: Ways to name a family, with a version (V) or without: rule, priority, strength, expression. N: the name, S: the short name.
_UNDER = r"(?:licensed|released|distributed|available|published|provided|made available|governed|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?"
VERSIONED = [
    ("identifier", IDENTIFIER, 1.0, r"spdx licen[sc]e identifier (?:S) V(?: only)?"),
    ("identifier-later", IDENTIFIER, 1.0, r"spdx licen[sc]e identifier (?:S) V or later"),
    ("notice", NOTICE, 0.95, _UNDER + r"(?:N|S)(?: licen[sc]e)? V"),
    ("notice-later", NOTICE, 0.97, _UNDER + r"(?:N|S)(?: licen[sc]e)? V(?: of the licen[sc]e)? or (?:at your option )?(?:any )?(?:later|newer|above)(?: version)?"),
    ("name", NAME, 0.85, r"(?:N) V"),
    ("short", NAME, 0.6, r"(?:S)(?: licen[sc]e)? V(?: only| or later)?"),
]
PLAIN = [
    ("identifier", IDENTIFIER, 1.0, r"spdx licen[sc]e identifier (?:S)"),
    ("notice", NOTICE, 0.85, _UNDER + r"(?:N)"),
    ("short-notice", NOTICE, 0.7, _UNDER + r"(?:S)(?: licen[sc]e)?"),
    ("name", HINT, 0.6, r"(?:N)"),
]


def _version(words: str) -> str:
    major, minor = words.split()
    last = "(?: 0)?" if minor == "0" else f" {minor}"
    return rf"(?:version |ver |v )?v?{major}{last}"


def _family(label: str, keywords: str, name: str, short: str, versions: tuple[str, ...]) -> list[Rule]:
    out, keys = [], tuple(keywords.split())
    put = lambda text, v="": text.replace("N", name).replace("S", short).replace(" V", f" {v}")
    for words in versions:
        of = f"{label}-{words.replace(' ', '.')}"
        for form, priority, strength, text in VERSIONED:
            later = "-or-later" if form.endswith("-later") else ""
            out.append(Rule(f"{of}:{form}", of + later, priority, strength, keys, put(text, _version(words))))
        # "gplv3", "lgplv2 1": the number stands in the short name's word
        major, minor = words.split()
        fused = rf"(?:{short})v{major}" + ("(?: 0)?" if minor == "0" else f" {minor}") + "(?: only| or later)?"
        out.append(Rule(f"{of}:fused", of, NAME, 0.7, tuple(f"{s.split()[-1]}v{major}" for s in short.split("|")), fused))
    for form, priority, strength, text in PLAIN:
        out.append(Rule(f"{label}:{form}", label, priority, strength, keys, put(text)))
    return out


def _commons() -> list[Rule]:
    out = []
    for kind, long in COMMONS.items():
        short = "cc " + kind.replace("-", " ")
        for words in COMMONS_VERSIONS:
            of = f"cc-{kind}-{words.replace(' ', '.')}"
            v = _version(words)
            out.append(Rule(f"{of}:short", of, NOTICE, 0.9, ("cc",), rf"{short} {v}(?: international| unported)?"))
            out.append(Rule(f"{of}:long", of, NOTICE, 0.95, ("commons",), rf"creative commons {long} {v}(?: international| unported)?"))
            out.append(Rule(f"{of}:address", of, IDENTIFIER, 1.0, ("creativecommons",), rf"creativecommons org licenses {kind.replace('-', ' ')} {words}"))
        out.append(Rule(f"cc-{kind}:short", f"cc-{kind}", NAME, 0.75, ("cc",), short))
        out.append(Rule(f"cc-{kind}:long", f"cc-{kind}", NAME, 0.85, ("commons",), rf"creative commons {long}"))
    return out


def rules() -> list[Rule]:
    """All rules in order: of equal priority and span the first one stays."""
    base = [Rule(f"base:{label}", label, HINT, strength, (key,), words, True) for words, key, label, strength in BASE]
    body = [Rule(f"{label or 'void'}:sentence-{i}", label, priority, strength, tuple(keys.split()), text) for i, (label, keys, priority, strength, text) in enumerate(SENTENCES)]
    return base + body + [r for f in FAMILIES for r in _family(*f)] + _commons()


@functools.cache
def compiled(pattern: str) -> re.Pattern:
    """Over bytes: words with a space before and after each."""
    return re.compile(rf" (?:{pattern})(?= )".encode())
