"""License scans by ordered signature rules, in DataFrame expressions only.

A text becomes its lower-case words. Hundreds of regular expressions, each with a keyword
that any of its matches holds, look for license names, notices and identifiers; a rule runs
only where its keyword stands. Where detections overlap, one that lies inside another of the
same or a higher priority is dropped, and of equal ones the first rule's stays. Texts are
scanned in blocks of words that overlap by more than the longest signature, so work grows
with the text and a detection is judged with everything that can contain it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that always count: words and label.
BASE_PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# License families as label, keyword, regular expression of the name in words, versions.
FAMILIES = [
    ("gpl", "gpl", r"(?:gnu )?gpl", ["1", "2", "3"]),
    ("gpl", "general", r"(?:gnu )?general public licen[sc]e", ["1", "2", "3"]),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ["2", "2 1", "3"]),
    ("lgpl", "general", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ["2", "2 1", "3"]),
    ("agpl", "agpl", r"(?:gnu )?agpl", ["1", "3"]),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", ["1", "3"]),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", ["1 1", "1 2", "1 3"]),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", ["1 1", "1 2", "1 3"]),
    ("apache", "apache", r"apache(?: software)?(?: licen[sc]e)?", ["1", "1 1", "2"]),
    ("mpl", "mpl", r"mpl", ["1", "1 1", "2"]),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ["1", "1 1", "2"]),
    ("epl", "epl", r"epl", ["1", "2"]),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ["1", "2"]),
    ("cddl", "cddl", r"cddl", ["1", "1 1"]),
    ("cddl", "common", r"common development and distribution licen[sc]e", ["1", "1 1"]),
    ("cpl", "common", r"common public licen[sc]e", ["1"]),
    ("eupl", "eupl", r"eupl", ["1", "1 1", "1 2"]),
    ("eupl", "union", r"european union public licen[sc]e", ["1", "1 1", "1 2"]),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e", ["1", "2"]),
    ("ofl", "ofl", r"(?:sil )?ofl", ["1", "1 1"]),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e", ["1", "1 1"]),
    ("osl", "osl", r"osl", ["1", "2", "2 1", "3"]),
    ("osl", "software", r"open software licen[sc]e", ["1", "2", "2 1", "3"]),
    ("afl", "academic", r"academic free licen[sc]e", ["1 1", "2", "2 1", "3"]),
    ("bsl", "boost", r"boost software licen[sc]e", ["1"]),
    ("busl", "business", r"business source licen[sc]e", ["1 1"]),
    ("sspl", "server", r"server side public licen[sc]e", ["1"]),
    ("psf", "python", r"python (?:software foundation )?licen[sc]e", ["2"]),
    ("php", "php", r"php licen[sc]e", ["3", "3 1"]),
    ("zpl", "zope", r"zope public licen[sc]e", ["1 1", "2", "2 1"]),
    ("cecill", "cecill", r"cecill", ["1", "2", "2 1"]),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", []),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", []),
    ("mit", "mit", r"(?:the )?mit licen[sc]e", []),
    ("mit", "expat", r"expat licen[sc]e", []),
    ("isc", "isc", r"isc licen[sc]e", []),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", []),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?", []),
    ("bsd-2", "freebsd", r"freebsd(?: licen[sc]e)?", []),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?", []),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?", []),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", []),
    ("unlicense", "unlicense", r"(?:the )?unlicense", []),
    ("wtfpl", "wtfpl", r"wtfpl", []),
    ("cc0", "cc0", r"cc0", ["1"]),
    ("cc0", "zero", r"creative commons zero", ["1"]),
    ("pddl", "dedication", r"public domain dedication(?: and)? licen[sc]e", ["1"]),
    ("odbl", "odbl", r"odbl", ["1"]),
    ("odbl", "database", r"open database licen[sc]e", ["1"]),
    ("odc-by", "attribution", r"open data commons attribution licen[sc]e", ["1"]),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?", []),
]
# Families whose headers name a publisher or the license's own text between name and version, as label, keyword, expression, publisher.
HEADERS = [
    ("gpl", "general", r"(?:gnu )?general public licen[sc]e", r"(?:the )?free software foundation(?: inc)?"),
    ("lgpl", "general", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", r"(?:the )?free software foundation(?: inc)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", r"(?:the )?free software foundation(?: inc)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", r"(?:the )?free software foundation(?: inc)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", r"(?:the )?mozilla foundation"),
    ("eupl", "union", r"european union public licen[sc]e", r"(?:the )?european commission"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", r"(?:the )?eclipse foundation(?: inc)?"),
    ("osl", "software", r"open software licen[sc]e", r"(?:the )?open source initiative"),
]
#: What follows a bare name of a thing that is no license.
_THINGS = r"(?! (?:plates?|numbers?|holders?|fees?)(?= ))"
#: Families whose name alone, without a version or notice, says too little.
NEEDS_MORE = {"apache"}
# The parts of Creative Commons names, in words.
CC_PARTS = [("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"), ("by-nc", "by nc", "attribution non ?commercial"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s")]
CC_VERSIONS = ["1", "2", "2 5", "3", "4"]
# Notices that name no license, as label, keyword, expression.
NOTICES = [
    ("public-domain", "domain", r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("no-redistribution", "redistribution", r"redistribution (?:is |are )?(?:strictly )?(?:prohibited|forbidden)"),
    ("bsd-text", "redistribution", r"redistribution and use in source and binary forms"),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?(?: and associated documentation files)?"),
    ("isc-text", "permission", r"permission to use copy modify and or distribute this software(?: for any purpose)?"),
    ("commercial-license", "commercial", r"commercial licen[sc]e (?:is )?required"),
    ("copyright-notice", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
]

# Sentences of license texts, as label, keyword, expression over words. A text without its title is known by them.
TEXTS = [
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", r"(?:copyright|permission) notice (?:and this permission notice )?shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"merchantability fitness for a particular purpose and noninfringement"),
    ("x11", "advertising", r"shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("bsd", "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd-3", "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("bsd", "consequential", r"direct indirect incidental special exemplary or consequential damages"),
    ("isc", "negligence", r"action of contract negligence or other tortious action arising out of"),
    ("0bsd", "0bsd", r"0bsd(?: licen[sc]e)?"),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2", "worldwide", r"perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e"),
    ("apache-2", "contribution", r"contribution shall mean any work of authorship including the original version"),
    ("apache-1.1", "foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "freedom", r"guarantee your freedom to share and change"),
    ("gpl-2", "temple", r"free software foundation inc 59 temple place"),
    ("gpl-2", "franklin", r"free software foundation inc 51 franklin"),
    ("gpl", "notices", r"you must cause the modified files to carry prominent notices"),
    ("gpl-3", "propagate", r"to propagate a work means to do anything with it"),
    ("gpl-3", "covered", r"conveying a covered work"),
    ("lgpl", "lesser", r"redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("lgpl", "combined", r"convey a combined work under terms of your choice"),
    ("agpl-3", "interacting", r"all users interacting with it remotely through a computer network"),
    ("agpl", "affero", r"redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-2", "incompatible", r"incompatible with secondary licen[sc]es"),
    ("mpl-1.1", "initial", r"the initial developer of the original code is"),
    ("epl", "agreement", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", "cddl", r"use is subject to licen[sc]e terms of the cddl"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("bsl-1", "machine", r"machine executable object code generated by a source language processor"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "detriment", r"to the detriment of our heirs and successors"),
    ("wtfpl", "fuck", r"do what the fuck you want to"),
    ("cc0-1", "waives", r"(?:affirmer|owner) (?:hereby )?(?:overtly )?(?:fully )?(?:permanently )?(?:irrevocably )?(?:and unconditionally )?waives"),
    ("cc0-1", "dedicated", r"has dedicated the work to the public domain by waiving all of (?:his or her|their) rights"),
    ("cc-by", "adapted", r"share adapted material you produce under the licen[sc]e"),
    ("cc-by", "redistribute", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", "remix", r"adapt remix transform and build upon the material"),
    ("cc-by-nc", "noncommercial", r"you may not use the material for (?:any )?noncommercial purposes|primarily intended for or directed towards commercial advantage noncommercial|for noncommercial purposes only"),
    ("cc-by-nd", "derivatives", r"you may not distribute the modified material no derivatives|no derivatives or adaptations"),
    ("cc-by-sa", "contributions", r"you must distribute your contributions under the same licen[sc]e"),
    ("ofl-1.1", "reserved", r"no modified version of the font software may use the reserved font name"),
    ("ofl-1.1", "bundled", r"may be bundled redistributed and or sold with any software"),
    ("psf-2", "psf", r"psf is making python available to licensee on an as is basis"),
    ("artistic", "freely", r"the package may be freely (?:copied|redistributed)"),
    ("artistic-2", "standard", r"you are permitted to use the standard version and create and use modified versions"),
    ("ms-pl", "contributor", r"each contributor grants you a non exclusive worldwide royalty free"),
    ("eupl", "licensor", r"the licensor hereby grants you a worldwide royalty free non exclusive sublicensable"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("php", "php", r"this product includes php software"),
    ("ncsa", "ncsa", r"(?:university of illinois )?(?:open source licen[sc]e )?ncsa(?: open source)?(?: licen[sc]e)?"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("sqlite", "blessing", r"in place of a legal notice here is a blessing"),
    ("ijg", "independent", r"based in part on the work of the independent jpeg group"),
    ("w3c", "w3c", r"w3c (?:software|document)(?: and document)?(?: notice and)? licen[sc]e"),
    ("sspl-1", "functionality", r"make(?:s)? the functionality of the program(?: or a modified version)? available to third parties as a service"),
    ("busl-1.1", "change", r"(?:on|effective on) the change date"),
    ("busl-1.1", "production", r"make non production use of the licensed work"),
    ("elastic-2", "managed", r"provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "clause", r"commons clause(?: licen[sc]e)?(?: condition)?"),
    ("llama", "llama", r"llama (?:2 |3 |3 1 |3 2 )?(?:community )?licen[sc]e(?: agreement)?"),
    ("openrail", "restrictions", r"use based restrictions(?: as referenced in paragraph 5)?"),
    ("odbl-1", "database", r"made available under the open database licen[sc]e"),
    ("gpl", "copyleft", r"copyleft licen[sc]e"),
    ("no-warranty", "merchantability", r"without even the implied warranty of merchantability"),
    ("no-warranty", "implied", r"without warranty of any kind (?:either )?express(?:ed)? (?:or )?implied"),
    ("no-warranty", "warranty", r"(?:provided|distributed) as is without (?:any )?(?:express or implied )?warranty"),
    ("no-warranty", "absolutely", r"absolutely no warranty"),
    ("all-rights-reserved", "consent", r"without (?:the )?(?:prior )?(?:express )?written (?:consent|permission and consent)(?: of the (?:publisher|author|copyright holder|copyright owner))?"),
    ("all-rights-reserved", "reproduced", r"no part of this (?:publication|book|document|work|website) may be reproduced"),
    ("proprietary", "confidential", r"(?:confidential and proprietary|trade secret and confidential)(?: information)?"),
    ("proprietary", "engineer", r"you may not (?:decompile )?(?:disassemble )?(?:or )?reverse engineer"),
    ("no-mining", "mining", r"(?:text and data|data) mining (?:is |are )?(?:not permitted|prohibited|forbidden|reserved)"),
    ("no-mining", "training", r"may not be used (?:for|in) (?:the )?training (?:of )?(?:artificial intelligence|machine learning|ai)(?: models| systems| technologies)?"),
    ("personal-use", "personal", r"for personal (?:and )?non ?commercial use only|for personal use only"),
    ("education-use", "educational", r"for (?:non profit |research and )?educational (?:use|purposes) only"),
    ("evaluation-use", "evaluation", r"for evaluation (?:use|purposes) only"),
    ("crown", "crown", r"crown copyright(?: and database right)?"),
    ("ogl-uk", "government", r"(?:uk )?open government licen[sc]e(?: v(?:ersion )?[123]|v[123])?"),
    ("etalab", "etalab", r"licence ouverte etalab|etalab(?: open licen[sc]e)?"),
]
# Identifiers of the SPDX license list that families don't make, as words, with their labels.
SPDX = [
    ("mit", "mit"), ("mit 0", "mit-0"), ("x11", "x11"), ("isc", "isc"), ("zlib", "zlib"), ("libpng 2 0", "libpng-2"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("0bsd", "0bsd"), ("bsl 1 0", "bsl-1"), ("ncsa", "ncsa"), ("json", "json"),
    ("bsd 1 clause", "bsd-1"), ("bsd 2 clause", "bsd-2"), ("bsd 2 clause patent", "bsd-2"), ("bsd 3 clause", "bsd-3"), ("bsd 3 clause clear", "bsd-3"), ("bsd 4 clause", "bsd-4"), ("bsd source code", "bsd"),
    ("artistic 1 0", "artistic-1"), ("artistic 2 0", "artistic-2"), ("psf 2 0", "psf-2"), ("python 2 0", "psf-2"), ("php 3 0", "php-3"), ("php 3 01", "php-3"), ("openssl", "openssl"), ("ruby", "ruby"), ("vim", "vim"), ("tcl", "tcl"), ("curl", "curl"), ("ftl", "ftl"), ("ijg", "ijg"), ("postgresql", "postgresql"), ("blessing", "sqlite"), ("beerware", "beerware"), ("afl 2 1", "afl-2.1"), ("afl 3 0", "afl-3"), ("ms pl", "ms-pl"), ("ms rl", "ms-rl"), ("busl 1 1", "busl-1.1"), ("sspl 1 0", "sspl-1"), ("elastic 2 0", "elastic-2"), ("odbl 1 0", "odbl-1"), ("odc by 1 0", "odc-by-1"), ("pddl 1 0", "pddl-1"), ("cc pddc", "public-domain"), ("ecl 2 0", "ecl-2"), ("upl 1 0", "upl-1"), ("mulanpsl 2 0", "mulan-2"), ("w3c", "w3c"), ("ofl 1 0", "ofl-1"), ("zpl 2 1", "zpl-2.1"), ("unicode 3 0", "unicode-3"), ("unicode dfs 2016", "unicode"), ("icu", "icu"), ("hpnd", "hpnd"), ("nist pd", "public-domain"),
]
#: Of these an identifier standing alone, without "SPDX", is a name too; others are words of everyday use.
ALONE = {"mit 0", "0bsd", "bsl 1 0", "bsd 1 clause", "bsd 2 clause patent", "bsd 3 clause clear", "artistic 1 0", "artistic 2 0", "psf 2 0", "php 3 01", "busl 1 1", "sspl 1 0", "odbl 1 0", "pddl 1 0", "ecl 2 0", "upl 1 0", "zpl 2 1", "ms pl", "ms rl", "afl 2 1", "afl 3 0"}
#: Names that are written together with their version (GPLv3, BSD3): word and label.
GLUED = [("gpl", "gpl", ["1", "2", "3"]), ("lgpl", "lgpl", ["2", "2 1", "3"]), ("agpl", "agpl", ["1", "3"]), ("gfdl", "gfdl", ["1 1", "1 2", "1 3"]), ("apache", "apache", ["1", "1 1", "2"]), ("mpl", "mpl", ["1", "1 1", "2"]), ("epl", "epl", ["1", "2"]), ("eupl", "eupl", ["1", "1 1", "1 2"]), ("osl", "osl", ["1", "2", "2 1", "3"]), ("afl", "afl", ["2", "2 1", "3"]), ("ofl", "ofl", ["1", "1 1"]), ("cecill", "cecill", ["1", "2", "2 1"]), ("bsd", "bsd", ["2", "3", "4"]), ("artistic", "artistic", ["1", "2"]), ("sspl", "sspl", ["1"]), ("ccby", "cc-by", ["2", "3", "4"]), ("ccbysa", "cc-by-sa", ["2", "3", "4"]), ("ccbync", "cc-by-nc", ["2", "3", "4"])]
#: Names short of "license" that count where a license is spoken of: word, label.
SPOKEN = [("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("bsd", "bsd"), ("expat", "mit"), ("x11", "x11"), ("boost", "bsl"), ("cc0", "cc0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("apache", "apache"), ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mpl", "mpl"), ("epl", "epl"), ("cddl", "cddl"), ("eupl", "eupl"), ("artistic", "artistic"), ("ncsa", "ncsa"), ("ofl", "ofl")]

_UNDER = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed) (?:under|by) (?:the )?(?:terms of (?:the )?)?(?:a |an )?"
#: Words that a match has at most (no expression repeats without end); blocks overlap by as many on both sides.
REACH = 20
#: Words of a block without what it overlaps.
STRIDE = 48
#: What a detection of each priority (0 first) is worth in the score.
WORTH = [1.0, 0.9, 0.6]


def rules() -> list[dict]:
    """All signature rules in their order: priority 0 identifiers and versions, 1 notices and sentences of license texts, 2 bare names."""
    exact, named, bare = [], [], []
    later = r"(?: (?:or|and) (?:any )?later(?: version)?| only)?"

    def version(v: str) -> str:
        return rf"(?:version |v ?)?{v}(?: 0)?"

    def add(to: list, level: int, keyword: str, expression: str, label: str) -> None:
        to.append({"kw": f" {keyword} ", "re": rf"(?<= )({expression})(?= )", "label": label, "level": level})

    families = FAMILIES + [(f"cc-{label}", "cc", f"cc {short}", CC_VERSIONS) for label, short, _ in CC_PARTS] + [(f"cc-{label}", "creative", f"creative commons {long}", CC_VERSIONS) for label, _, long in CC_PARTS]
    for label, keyword, name, versions in families:
        for v in sorted(versions, key=len, reverse=True):
            own = f"{label}-{v.replace(' ', '.')}"
            add(exact, 0, keyword, f"{name} {version(v)}{later}", own)
            add(exact, 0, "spdx", f"spdx licen[sc]e identifier {name} {version(v)}{later}", own)
            add(named, 1, keyword, f"{_UNDER}{name} {version(v)}{later}", own)
        add(exact, 0, "spdx", f"spdx licen[sc]e identifier {name}", label)
        add(named, 1, keyword, f"{_UNDER}{name}(?: licen[sc]e)?", label)
        if label not in NEEDS_MORE:
            add(bare, 2, keyword, f"{name}(?: international| unported)?(?: licen[sc]e)?{_THINGS}", label)
    versions_of = {label: versions for label, _, _, versions in FAMILIES}
    for label, keyword, name, publisher in HEADERS:
        for v in sorted(versions_of[label], key=len, reverse=True):
            own, number = f"{label}-{v.replace(' ', '.')}", v if " " in v else f"{v}(?: 0)?"
            # "either version 3 of the License", after who published it, and "version 3 of the ..."
            add(exact, 0, keyword, f"{name} as published by {publisher} (?:either )?(?:version |v ?)?{number}(?: of the licen[sc]e)?", own)
            add(exact, 0, keyword, f"{name} (?:as published|published) (?:either )?(?:version |v ?){number}(?: of the licen[sc]e)?", own)
            add(exact, 0, keyword, f"(?:version |v ?){number} (?:or (?:any )?later |only )?of (?:the )?{name}", own)
            add(exact, 0, keyword, f"{name} (?:l?a?gpl |mpl |fdl |gfdl |epl |eupl |osl )?(?:either |under |in )?(?:its |the )?(?:version |v ?|versions ){number}{later}", own)
    for words, label in SPDX:
        add(exact, 0, "spdx", f"spdx licen[sc]e identifier {words}{later}", label)
        if words in ALONE:
            add(exact, 0, words if " " not in words else max(words.split(), key=len), f"{words}(?: licen[sc]e)?", label)
    for word, label, versions in GLUED:
        for v in sorted(versions, key=len, reverse=True):
            major, *minor = v.split()
            rest = "".join(f" {m}" for m in minor)
            for glued in (f"{word}v{major}", f"{word}{major}"):
                add(exact, 0, glued, f"(?:gnu )?{glued}{rest}(?: 0)?(?: licen[sc]e)?{later}", f"{label}-{v.replace(' ', '.')}")
    for word, label in SPOKEN:
        add(named, 1, word, f"{word} licen[sc]ed", label)
        add(named, 1, word, f"{_UNDER}{word}(?: style)?(?: licen[sc]e)?", label)
        add(named, 1, word, f"licen[sc]e (?:type )?{word}", label)
        add(named, 1, word, f"licen[sc]e is (?:the )?{word}", label)
    for label, keyword, expression in [*NOTICES, *TEXTS]:
        add(named, 1, keyword, expression, label)
    return [r | {"k": k} for k, r in enumerate(exact + named + bare)]


def _words_sql(x: str) -> str:
    """Words of a string in which every word stands between two blanks of its own."""
    return f"((length({x}) - length(replace({x}, ' ', ''))) div 2)"


def _blanks_sql(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def joined_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one blank between them; empty without words."""
    # two letters whose lower case would turn into ASCII stand for themselves
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    return F.trim(F.regexp_replace(F.lower(kept), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", signature_rules: list[dict] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    Words are runs of letters, digits and non-ASCII characters. n_base counts all places of the
    base phrases, first_word and last_word are the smallest and largest of their starts (words
    from 0; null without one), base_labels their labels; labels adds those of the signature
    rules that nothing suppresses (both distinct, sorted, joined by commas; empty if none).
    score is the worth of the best detection, 1 for a base phrase, 0 without any. A null text
    counts as empty; one row per input row; an empty table gives an empty result; other columns
    are ignored. Narrow: no shuffle, no Python.
    """
    signature_rules = rules() if signature_rules is None else signature_rules
    rows = df.select(F.col(id_col).alias("doc_id"), joined_words(F.col(text_col)).alias("joined"))
    rows = rows.selectExpr("doc_id", "concat(' ', joined, ' ') as line", "if(joined = '', array(), split(joined, ' ')) as words")
    rows = rows.selectExpr("doc_id", "line", "words", "cast(size(words) as bigint) as n_words")

    base = []
    for phrase, label in BASE_PHRASES:
        wide = "".join(f" {w} " for w in phrase.split())  # between two blanks of its own each, so that places don't share any
        base.append(
            f"if(contains(line, ' {phrase} '), transform(array(concat(' ', replace(trim(line), ' ', '  '), ' ')), norm -> named_struct("
            f"'n', cast((length(norm) - length(replace(norm, '{wide}', ''))) div {len(wide)} as bigint), "
            f"'first', cast({_words_sql(f"""substring(norm, 1, instr(norm, '{wide}') - 1)""")} as bigint), "
            f"'last', cast(n_words - {_words_sql(f"""substring_index(norm, '{wide}', -1)""")} - {len(phrase.split())} as bigint), 'label', '{label}'))[0], null)"
        )
    rows = rows.withColumn("base", F.expr(f"filter(array({', '.join(base)}), x -> x is not null)"))

    keywords = sorted({r["kw"] for r in signature_rules})
    listed = ", ".join(f"'{k.strip()}'" for k in keywords)
    gate = f"arrays_overlap(words, array({listed}))" if keywords else "false"
    by_keyword = {k.strip(): [r for r in signature_rules if r["kw"] == k] for k in keywords}
    table = json.dumps(by_keyword).replace("\\", "\\\\").replace("'", "\\'")
    rules_of = f"from_json('{table}', 'map<string,array<struct<re:string,label:string,level:int,k:int>>>')"
    span = STRIDE + 2 * REACH
    first, count = f"greatest(b * {STRIDE} - {REACH}, 0) + 1", f"{span} + least(b * {STRIDE} - {REACH}, 0)"
    blocks = (
        f"transform(transform(sequence(0, (size(words) - 1) div {STRIDE}), b -> named_struct('lo', b * {STRIDE}, 'from', {first} - 1, 'w', slice(words, {first}, {count}))), "
        f"b -> named_struct('lo', b.lo, 'from', b.from, 'ks', array_intersect(b.w, array({listed})), 'w', b.w))"
    )
    found = (
        f"flatten(transform(flatten(transform(b.ks, k -> {rules_of}[k])), r -> "
        "flatten(transform(array(split(regexp_replace(b.t, r.re, '\\u0001$1\\u0002'), '\\u0001')), p -> "
        "transform(slice(sequence(1, size(p)), 2, size(p)), i -> named_struct("
        f"'s', b.from + {_blanks_sql('array_join(slice(p, 1, i - 1), chr(0))')} - 1, "
        f"'n', {_blanks_sql("""substring_index(p[i - 1], '\\u0002', 1)""")} + 1, 'level', r.level, 'k', r.k, 'label', r.label))))))"
    )
    text = "transform(array(b), b -> named_struct('lo', b.lo, 'from', b.from, 'ks', b.ks, 't', concat(' ', array_join(b.w, ' '), ' ')))"
    standing = (
        f"filter(d, x -> x.s >= b.lo and x.s < b.lo + {STRIDE} and not exists(d, y -> y.s <= x.s and y.s + y.n >= x.s + x.n and "
        "((y.n > x.n and y.level <= x.level) or (y.n = x.n and (y.level < x.level or (y.level = x.level and y.k < x.k))))))"
    )
    detections = "cast(null as array<struct<s:int,n:int,level:int,k:int,label:string>>)" if not keywords else f"if({gate}, flatten(transform(flatten(transform(filter({blocks}, b -> size(b.ks) > 0), b -> {text})), b -> transform(array({found}), d -> {standing})[0])), null)"
    rows = rows.withColumn("own", F.expr(detections))
    worth = "case x.level " + " ".join(f"when {k} then {w}D" for k, w in enumerate(WORTH)) + " else 0D end"
    return rows.selectExpr(
        "doc_id",
        "n_words",
        "aggregate(base, 0L, (a, x) -> a + x.n) as n_base",
        "array_min(transform(base, x -> x.first)) as first_word",
        "array_max(transform(base, x -> x.last)) as last_word",
        "array_join(array_sort(array_distinct(transform(base, x -> x.label))), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(transform(base, x -> x.label), coalesce(transform(own, x -> x.label), array())))), ',') as labels",
        f"if(size(base) > 0, 1D, coalesce(array_max(transform(own, x -> {worth})), 0D)) as score",
    )


def scan_text(text: str | None, signature_rules: list[dict] | None = None) -> list[tuple[int, int, int, str]]:
    """What stands after suppression in one text, found without blocks: (start word, words, priority, label)."""
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line, found = " " + " ".join(words) + " ", []
    for r in rules() if signature_rules is None else signature_rules:
        for m in re.finditer(r["re"], line):
            found.append((line[: m.start()].count(" ") - 1, m[0].count(" ") + 1, r["level"], r["k"], r["label"]))
    return sorted({(s, n, level, label) for s, n, level, k, label in found if not any(a <= s and a + b >= s + n and ((b > n and c <= level) or (b == n and (c, e) < (level, k))) for a, b, c, e, _ in found)})
