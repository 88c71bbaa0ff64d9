"""Licences, secrets, personal data, media, quality: against brute force, round trips and held-out labels."""

import collections
import hashlib
import itertools
import os
import random
import re

import numpy as np

from kgspark.llm import licenses, matroska, pii, quality, secret_scan

DOCS = "doc_id long, text string"
EDGE = [(900, None), (901, ""), (902, " \n\t"), (903, "x" * 200_000), (904, "same"), (904, "same"), (905, "é\U0001f600 ﬁn")]


def test_licenses(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\n associated documentation files (the "Software"), to deal in the Software without restriction, x.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
    rows = [(1, mit), (2, "Text.\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "no licence to kill"), *EDGE]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' as licenses", "1 as n_matches")
    got = collections.Counter((r.doc_id, r.licenses, r.n_matches) for r in licenses.scan_licenses(df).collect())
    exp = [(1, "MIT", 1), (2, "Apache-2.0,CC-BY-NC", 2), (3, "GPL-3.0", 1), (4, "", 0), *[(i, "", 0) for i, _ in EDGE]]
    assert got == collections.Counter(exp)
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_known_sentences_hold_a_critical_word():
    for _, pattern in licenses.SENTENCES:
        assert re.search(licenses.CRITICAL, pattern.replace("(c)", "copyright")), pattern


def shortest(parsed):
    """Sentences that a parsed pattern fits with its optional parts left out, one for each choice of branches."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            part = ["x" if str(arg[2][0][0]) == "ANY" else ""] if arg[0] == 0 else ["".join(x) for x in itertools.product(shortest(arg[2]), repeat=arg[0])]
        else:
            part = {"LITERAL": lambda: [chr(arg)], "ANY": lambda: ["x"], "SUBPATTERN": lambda: shortest(arg[-1]), "BRANCH": lambda: [x for b in arg[1] for x in shortest(b)], "IN": lambda: [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]}[name]()
        out = [a + b for a in out for b in part]
    return out


def test_shortest_known_sentences_are_looked_up(spark):
    known = [s for _, pattern in licenses.SENTENCES for s in shortest(re._parser.parse(pattern))]
    assert len(known) > 100 and all(re.search(licenses.CRITICAL, s) for s in known)
    rows = list(enumerate([f"{s.capitalize()}." for s in known]))
    got = {r.doc_id: r.sequence for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert [known[i] for i in got if not got[i]] == []


def test_licenses_of_short_statements(spark):
    exp = {"All rights reserved.": "LicenseRef-all-rights-reserved", "Copyright 2020 Foo. All rights reserved.": "LicenseRef-all-rights-reserved", "Released under GPL v3.": "GPL-3.0", "Released under the GPL v3.0 or later.": "GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "Released under CC BY 4.0.": "CC-BY", "Dedicated under CC0 1.0.": "CC0-1.0"}
    rows = list(enumerate(exp))
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i] for i, _ in rows] == list(exp.values())


APACHE = """Copyright 2020 The Foo Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)."""
MIT = """MIT License

Copyright (c) 2020 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY."""
HEADERS = [
    (APACHE, "Apache-2.0", ";copyright;apache2;apache2Not;apache2Copy;apache2Basis;apache2See"),
    (GPL.format(":", ",", 3), "GPL-3.0-or-later", ";gplFree3;gplHope;gplSee;gplCopy"),
    (GPL.format(";", ";", 2), "GPL-2.0-or-later", ";gplFree2;gplHope;gplSee;gplCopy"),
    (BSD2 + BSD3 + BSD_END, "BSD-3-Clause", ";bsdPre;bsdSource;bsdBinary;bsdEndorse;bsdAsIs;bsdLiab"),
    (BSD2 + BSD_END, "BSD-2-Clause", ";bsdPre;bsdSource;bsdBinary;bsdAsIs;bsdLiab"),
    (MIT, "MIT", ";copyright;mitGrant;mitNotice;mitAsIs;mitLiab"),
    (ISC, "ISC", ";iscGrant;iscAsIs"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0", ";mpl2"),
    ("Licensed under the GNU Affero General Public\nLicense, Version 3", "AGPL-3.0", ";agplAny"),
    ("Licensed under the GNU Lesser General Public\nLicense v2.1 or later", "LGPL", ";lgplAny"),
    ("Licensed under the GNU General Public\nLicense, Version 3", "GPL-3.0", ";gpl3Any"),
    ("Licensed under the GNU General Public License\nVersion 2", "GPL-2.0", ";gpl2Any"),
    ("Licensed under the GNU General Public\nLicense", "GPL", ";gplNoVersion"),
    *[(f"This work is licensed under a Creative\nCommons {n} 4.0\nInternational License.", s, f";{i}") for n, s, i in (("Attribution-NonCommercial-NoDerivatives", "CC-BY-NC-ND", "ccByNcNd"), ("Attribution-NonCommercial-ShareAlike", "CC-BY-NC-SA", "ccByNcSa"), ("Attribution-NonCommercial", "CC-BY-NC", "ccByNc"), ("Attribution-ShareAlike", "CC-BY-SA", "ccBySa"), ("Attribution-NoDerivatives", "CC-BY-ND", "ccByNd"), ("Attribution", "CC-BY", "ccBy"))],
    ("Dedicated under Creative Commons\nZero 1.0\nUniversal", "CC0-1.0", ";cc0"),
    ("Licensed under the 3-clause\nBSD License", "BSD", ";bsdAny"),
    ("This is free and unencumbered software released into the\nPublic Domain.", "Unlicense", ";unlicense"),
    ("Placed in the Public\nDomain", "LicenseRef-public-domain", ";publicDomain"),
    ("Some Title\nCopyright 2020 Foo Inc. Licensed under the MIT License\nMore Text", "MIT", ";copyright;mit"),
    ("Copyright 2020 Foo\nAll Rights\nReserved", "LicenseRef-all-rights-reserved", ";copyright;reserved"),
    ("The other library is\nlicensed under the MIT License", "", ""),
    *[(f"SPDX-License-Identifier: {i}\nImport x", n, f";{s}") for i, n, s in (("Apache-2.0", "Apache-2.0", "spdxApache2"), ("MIT", "MIT", "spdxMit"), ("GPL-3.0-only", "GPL-3.0", "spdxGpl3"), ("GPL-2.0+", "GPL-2.0-or-later", "spdxGpl2Later"), ("BSD-3-Clause", "BSD-3-Clause", "spdxBsd3"), ("BSD-2-Clause", "BSD-2-Clause", "spdxBsd2"), ("MPL-2.0", "MPL-2.0", "spdxMpl2"), ("Zlib", "LicenseRef-other", "spdxOther"))],
]


def test_licenses_of_stock_headers(spark):
    for lead in ("", " * ", "// ", "# "):
        rows = [(i, "".join(f"{lead}{x}".rstrip() + "\n" for x in h.split("\n"))) for i, (h, _, _) in enumerate(HEADERS)]
        got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
        assert [(got[i].licenses, got[i].sequence) for i, _ in rows] == [(n, s) for _, n, s in HEADERS], lead


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secrets(spark, tmp_path):
    rng = random.Random(5)
    bits = ["password", "Token", "api_key", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGH12345678", "deadbeef0123456789abcdef", "é", "\U0001f600", "\n", "x/y+z", "ghp_" + "a1" * 18]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(400)] + EDGE
    df = spark.createDataFrame(rows, DOCS)
    got = collections.Counter((r.doc_id, r.base_sha256) for r in secret_scan.digest(secret_scan.scan_documents(df)).collect())
    assert got == collections.Counter((i, hashlib.sha256(brute_secrets(t or "").encode()).hexdigest()) for i, t in rows)
    red = {r.doc_id: r.text for r in secret_scan.redact_documents(df).collect()}
    assert all(not brute_secrets((red[i] or "").replace("[SECRET]", "\n")) for i, _ in rows) and red[900] is None and red[903] == "x" * 200_000


def test_ledger_scans_only_unseen_blobs(spark, tmp_path):
    at = str(tmp_path / "ledger")
    old = spark.createDataFrame([("a", "token = abcdef1"), ("b", "token = abcdef1"), ("c", "clean")], "path string, text string")
    assert secret_scan.scan_new(old, at, first_run=True).count() == 2
    new = old.union(spark.createDataFrame([("d", "clean"), ("e", "password=hunter22")], "path string, text string"))
    ledger = secret_scan.scan_new(new, at)
    assert ledger.count() == 3
    found = {r.path: len(r.spans) for r in secret_scan.findings(new, ledger).collect()}
    assert found == {"a": 1, "b": 1, "c": 0, "d": 0, "e": 1}
    assert secret_scan.scan_new(new, at, version="rules-2").count() == 6


def test_secrets_under_null_ids(spark, tmp_path):
    rows = [(None, "token = abcdef1"), (None, "token = abcdef1"), (1, "password=hunter22"), (None, "password=hunter22"), (None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = collections.Counter((r.doc_id, r.base_sha256) for r in secret_scan.digest(secret_scan.scan_documents(df)).collect())
    assert got == collections.Counter((i, hashlib.sha256(brute_secrets(t or "").encode()).hexdigest()) for i, t in rows)
    assert all("[SECRET]" in r.text for r in secret_scan.redact_documents(df).collect() if r.text)
    assert secret_scan.scan_new(df.selectExpr("doc_id as path", "text"), str(tmp_path / "l"), first_run=True).count() == 3  # one copy of a text


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_pii_base():
    rng = random.Random(2)
    bits = ["a", "9", "4111111111111111", "12", ".", "..", "@", "x.com", "foo@bar.co", "+1 (555) 123-4567", "+", "-", " ", "1.2.3.4", "255.300.1.1", "é", "\n", "_", "٣"]
    for _ in range(8000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 18)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_pii_bootstrap_finds_unseen_forms(spark):
    rows = [(k, f"Some text. Reach me on phone: +1 (555) 123-{k:04d} today") for k in range(8)]
    rows += [(100, "Other words. Reach me on phone: 555-1200-99 today"), (200, "order number: 99887766 x"), *EDGE]
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, DOCS))).collect()}
    assert got[100].spans.startswith("like_phone:") and got[0].n_phone == 1 and got[200].spans == "" and got[900].spans == ""


def test_matroska_lacing_and_round_trip():
    rng = random.Random(1)
    for _ in range(60):
        frames = [os.urandom(rng.randint(0, 700)) for _ in range(rng.randint(2, 9))]
        for kind in (matroska.XIPH, matroska.EBML_LACING):
            raw = matroska.lace(frames, kind)
            at, sizes = matroska.laced(raw, 0, len(raw), kind)
            assert sizes == [len(f) for f in frames] and raw[at:] == b"".join(frames)
        payload = os.urandom(192 * rng.randint(1, 400))
        media = matroska.mux(payload)
        m = matroska.demux(media)
        assert m.complete and matroska.read_back(media, m) == payload
        assert all(media[c[2] : c[2] + 4] == b"\x1f\x43\xb6\x75" for c in m.cues) and len(m.cues) == m.clusters
        assert not matroska.demux(media[: rng.randint(0, len(media) - 1)]).complete


def test_matroska_query(spark):
    rows = {r.doc_id: r for r in matroska.text_media(spark.createDataFrame(EDGE, DOCS), emit_media=True).collect()}
    assert rows[900].n_bytes == 0 and rows[900].payload_bytes == 192 and rows[903].payload_bytes % 192 == 0
    assert rows[901].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest()
    assert rows[905].n_bytes == len(EDGE[-1][1].encode())
    files = matroska.text_media(spark.createDataFrame(EDGE, DOCS), emit_media=True)
    assert matroska.packet_table(files).groupBy("doc_id").sum("byte_length").where("doc_id = 903").first()[1] == rows[903].payload_bytes


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame(EDGE, DOCS).selectExpr("*", "'s' as score")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(docs, model).count() == len(EDGE)
    assert quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int")).columns == docs.columns
