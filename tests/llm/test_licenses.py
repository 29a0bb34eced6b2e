import random
import re
from re import _parser

from waymark.llm import licenses, queries


def brute(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, names = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        if at:
            names.add(label)
    own = licenses.scan_text(text)
    labels = names | {x[3] for x in own}
    score = 1.0 if names else max((licenses.WORTH[x[2]] for x in own), default=0.0)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(labels)), score


def check(rows, got):
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_rules():
    made = licenses.rules()
    assert len(made) > 300 and len({r["k"] for r in made}) == len(made)
    one = lambda t: {x[3] for x in licenses.scan_text(t)}
    assert one("Licensed under the GNU General Public License, version 3.0 or later.") == {"gpl-3"}
    assert one("SPDX-License-Identifier: Apache-2.0") == {"apache-2"}
    assert one("(CC BY-NC-SA 4.0)") == {"cc-by-nc-sa-4"}
    assert one("nothing here") == set()


def test_edge_rows(spark):
    bits = ["under the MIT license", "Apache License, Version 2.0", "cc-by-nc", "CC BY-NC-SA 4.0", "GNU Lesser General Public License v2.1 or any later version", "licensed under the terms of the gnu lesser general public license version 2.1 or any later version", "all rights reserved", "copyright (c) 2019", "word", "é中", "K İ", "\n", "license", "the", "mit"]
    rng = random.Random(2)
    rows = [(1, None), (None, ""), (2, "  ..."), (3, "under the mit license under the mit license"), (3, "under the mit license under the mit license"), (4, "cc by ncx"), (5, "word " * 5000 + "cc by nc")]
    rows += [(10 + k, " ".join(rng.choice(bits) for _ in range(rng.choice([3, 30, 200])))) for k in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, norm string")
    check(rows, licenses.scan_documents(df).collect())
    assert licenses.scan_documents(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op8_license_scan(spark, sf)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    check(rows, got.collect())


def matches(parsed):
    """Texts that a parsed expression matches: the shortest, and it with each part's other forms in turn."""
    parts = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            parts.append([chr(v) if str(o) == "LITERAL" else "7" for o, v in value])
        elif name == "BRANCH":
            parts.append([m for branch in value[1] for m in matches(branch)])
        elif name == "SUBPATTERN":
            parts.append(matches(value[3]))
        elif name == "MAX_REPEAT":
            parts.append([m * value[0] for m in matches(value[2])][: None if value[0] else 1] + (matches(value[2]) if value[0] == 0 else []))
        else:
            assert name in ("ASSERT", "ASSERT_NOT")
    least = [p[0] for p in parts]
    return ["".join(least)] + ["".join([*least[:k], other, *least[k + 1 :]]) for k, p in enumerate(parts) for other in p[1:]]


def test_every_match_holds_its_keyword_and_is_found(spark):
    made, found = licenses.rules(), set()
    for r in made:
        some = set(matches(_parser.parse(r["re"])))
        assert all(re.fullmatch(".*" + r["re"] + ".*", f" {m} ") for m in some)
        assert [m for m in some if r["kw"] not in f" {m} "] == []
        found |= {min(some), max(some)}
    rows = list(enumerate(sorted(found))) + [(-1, "released under the FreeBSD license"), (-2, "Permission to use, copy, modify, and/or distribute this software for any purpose")]
    got = {r.doc_id: r.labels for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[-1] == "bsd-2" and got[-2] == "isc-text"
    assert [t for i, t in rows if not got[i]] == []


#: Written by hand from the texts, not from the rules.
EXPECTED = {
    "GPLv3": "gpl-3", "GPLv2 or later": "gpl-2", "LGPLv2.1": "lgpl-2.1", "AGPLv3": "agpl-3", "Apache2": "apache-2", "BSD3": "bsd-3", "GPL-3.0-or-later": "gpl-3", "Apache-2.0": "apache-2",
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: ISC": "isc", "SPDX-License-Identifier: Zlib": "zlib", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3", "SPDX-License-Identifier: CC0-1.0": "cc0-1", "SPDX-License-Identifier: MPL-2.0": "mpl-2",
    "MIT licensed": "mit", "licensed under MIT": "mit", "License: MIT": "mit", "Artistic-2.0": "artistic-2", "BSL-1.0": "bsl-1", "0BSD": "0bsd", "CC BY-SA 4.0": "cc-by-sa-4", "released under the Creative Commons Attribution-NonCommercial 3.0 Unported License": "cc-by-nc-3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "the MIT license plate was green": "", "his BSD license number": "",
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software": "mit",
    "Redistributions of source code must retain the above copyright notice": "bsd",
    "You may not use this file except in compliance with the License.": "apache-2",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file": "mpl-2",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "The Software shall be used for Good, not Evil.": "json", "The origin of this software must not be misrepresented": "zlib",
    "No part of this book may be reproduced": "all-rights-reserved", "text and data mining is prohibited": "no-mining", "may not be used for the training of AI models": "no-mining",
    "the mit of the day": "", "a common house and a free font of software": "", "he is an isc officer": "", "music licensed to him": "", "3 clauses": "",
}


_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {} of the License, or (at your option) any later version."
#: Headers as they stand in files: what they must be labelled with, besides what their other sentences say.
HEADERS = {
    _GNU.format("General Public License", "either version 3"): "gpl-3", _GNU.format("General Public License", "either version 2"): "gpl-2",
    _GNU.format("Lesser General Public License", "either version 2.1"): "lgpl-2.1", _GNU.format("Lesser General Public License", "either version 3"): "lgpl-3",
    _GNU.format("Library General Public License", "either version 2"): "lgpl-2", _GNU.format("Affero General Public License", "either version 3"): "agpl-3",
    _GNU.format("General Public License", "version 3"): "gpl-3", _GNU.format("Affero General Public License", "version 3"): "agpl-3",
    "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl-2",
    "under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation": "gpl-2",
    "modify it under the terms of version 2.1 of the GNU Lesser General Public License": "lgpl-2.1",
    "GNU General Public License as published by the Free Software Foundation, Inc., either version 3 of the License": "gpl-3",
    "GNU General Public License (GPL) version 3": "gpl-3", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007": "gpl-3", "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991": "gpl-2",
    "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999": "lgpl-2.1", "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007": "agpl-3",
    "SPDX-License-Identifier: GPL-2.0-only": "gpl-2", "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": "gpl-2", "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1",
    "Dual licensed under the MIT (http://example.org/mit) and GPL Version 2 licenses.": "gpl-2",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache-2",
    "Apache License\n Version 2.0, January 2004": "apache-2", "licensed to the Foundation under the Apache License, Version 2.0": "apache-2",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2", "The contents of this file are subject to the Mozilla Public License Version 1.1": "mpl-1.1",
    "Mozilla Public License as published by the Mozilla Foundation, version 2.0": "mpl-2",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "The MIT License (MIT)\n\nCopyright (c) 2019": "mit", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.": "mit",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "bsd",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd-text",
    "BSD 3-Clause License": "bsd-3", "BSD 2-Clause \"Simplified\" License": "bsd-2", "All rights reserved. The 3-Clause BSD License": "bsd-3",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-1", "This file is distributed under the Eclipse Public License v2.0": "epl-2",
    "made available under the terms of the Eclipse Public License 2.0": "epl-2", "Licensed under the EUPL, Version 1.2": "eupl-1.2", "European Union Public Licence (EUPL) version 1.1": "eupl-1.1",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3": "gfdl-1.3",
    "This is free and unencumbered software released into the public domain.": "unlicense", "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "ofl-1.1",
}


def test_headers_as_they_are_written(spark):
    rows = list(enumerate(HEADERS))
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows) > 40
    assert [(t, got[i]) for i, t in rows if HEADERS[t] not in got[i]] == []
    # a version stands for its family, and no other version of it is there
    for i, t in rows:
        family = HEADERS[t].rsplit("-", 1)[0]
        if HEADERS[t][-1].isdigit() and not family.startswith(("bsd", "cc")):
            assert [x for x in got[i] if x.startswith(f"{family}-") and x != HEADERS[t]] == [], t


def test_labels_by_hand(spark):
    rows = list(enumerate(EXPECTED))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_documents(df).collect()}
    assert {t: got[i] for i, t in rows} == EXPECTED
    # the same inside long texts, at any place of a block
    padded = [(i, " ".join(["word"] * (37 * i % 101 + 40)) + f" {t}. " + "end " * 60) for i, t in rows]
    got = {r.doc_id: r.labels for r in licenses.scan_documents(spark.createDataFrame(padded, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == EXPECTED


def test_no_match_is_longer_than_the_overlap():
    for r in licenses.rules():
        assert all(m.count(" ") < licenses.REACH for m in matches(_parser.parse(r["re"])))
        assert not re.search(r"\)[*+]|\{\d+,\}", r["re"])
