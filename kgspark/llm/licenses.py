"""License scans by sentence rules, in DataFrame expressions only.

A text is cut into sentences, each is normalised and looked up among known
licence sentences, and the sequence of identifiers is matched against licence
rules in their order: a match is reported and taken out before the next rule.
Everything happens within a row, so there is no shuffle and no skew.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Every sentence that a pattern below fits holds one of these, with its optional parts left out too, so sentences without any need no look-up.
CRITICAL = r"licen[cs]|spdx|released|distribut|dedicated|placed|permission|copyright|\(c\)|©|warrant|liable|endorse|provided|reserved"

#: Licence sentences after normalisation (lower case, no quotes, single spaces, no full stop), as
#: (identifier, pattern of the whole sentence). The first that fits names the sentence.
SENTENCES = (
    ("spdxApache2", r"spdx-license-identifier: apache-2\.0"),
    ("spdxMit", r"spdx-license-identifier: mit"),
    ("spdxGpl3Later", r"spdx-license-identifier: gpl-3\.0(-or-later|\+)"),
    ("spdxGpl2Later", r"spdx-license-identifier: gpl-2\.0(-or-later|\+)"),
    ("spdxGpl3", r"spdx-license-identifier: gpl-3\.0(-only)?"),
    ("spdxGpl2", r"spdx-license-identifier: gpl-2\.0(-only)?"),
    ("spdxBsd3", r"spdx-license-identifier: bsd-3-clause"),
    ("spdxBsd2", r"spdx-license-identifier: bsd-2-clause"),
    ("spdxMpl2", r"spdx-license-identifier: mpl-2\.0"),
    ("spdxOther", r"spdx-license-identifier: .+"),
    ("apache2", r"(this (file|work|software|project|code) is )?(licensed|released|distributed) under (the terms of )?the apache( software)? license,? \(?(version|v)? ?2(\.0)?\)?( \(the license\))?"),
    ("apache2Not", r"you may not use this file except in compliance with the license"),
    ("apache2Copy", r"you may obtain a copy of the license at:? https?://www\.apache\.org/licenses/license-2\.0( unless required .*)?"),
    ("apache2Basis", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("apache2See", r"see the license for the specific language governing permissions and limitations under the license"),
    ("gpl3Later", r"(this (file|work|software|program|project|code) is )?(licensed|released|distributed) under (the terms of )?(the )?(gnu general public license|gpl),? ?(version|v) ?3(\.0)?,? or (any )?later( version)?"),
    ("gpl3Any", r"(this (file|work|software|program|project|code) is )?(licensed|released|distributed) under (the terms of )?(the )?(gnu general public license|gpl),? ?(version|v) ?3(\.0)?"),
    ("gpl2Later", r"(this (file|work|software|program|project|code) is )?(licensed|released|distributed) under (the terms of )?(the )?(gnu general public license|gpl),? ?(version|v) ?2(\.0)?,? or (any )?later( version)?"),
    ("gpl2Any", r"(this (file|work|software|program|project|code) is )?(licensed|released|distributed) under (the terms of )?(the )?(gnu general public license|gpl),? ?(version|v) ?2(\.0)?"),
    ("gplNoVersion", r"(this (file|work|software|program|project|code) is )?(licensed|released|distributed) under (the terms of )?(the )?(gnu general public license|gpl)"),
    ("lgplAny", r"(this (file|work|software|library|project|code) is )?(licensed|released|distributed) under (the terms of )?(the )?(gnu (lesser|library) general public license|lgpl),? ?(version|v) ?(2|2\.1|3)(\.0)?( or (any )?later)?"),
    ("agplAny", r"(this (file|work|software|program|project|code) is )?(licensed|released|distributed) under (the terms of )?(the )?(gnu affero general public license|agpl),? ?(version|v) ?3(\.0)?( or (any )?later)?"),
    ("gplFree2", r"this (program|library|file) is free software;? you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or \(at your option\) any later version"),
    ("gplFree3", r"this (program|library|file) is free software:? you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or \(at your option\) any later version"),
    ("gplHope", r"this (program|library|file) is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gplSee", r"see the gnu (lesser |affero )?general public license for more details"),
    ("gplCopy", r"you should have received a copy of the gnu (lesser |affero )?general public license along with this (program|library|file).*"),
    ("ccByNcNd", r"(this work is )?(licensed|released|distributed) under (a |the )?(cc[ -]by[ -]nc[ -]nd|creative commons attribution-noncommercial-noderivatives)( [1-4]\.[0-9])?( international)?( license)?"),
    ("ccByNcSa", r"(this work is )?(licensed|released|distributed) under (a |the )?(cc[ -]by[ -]nc[ -]sa|creative commons attribution-noncommercial-sharealike)( [1-4]\.[0-9])?( international)?( license)?"),
    ("ccByNc", r"(this work is )?(licensed|released|distributed) under (a |the )?(cc[ -]by[ -]nc|creative commons attribution-noncommercial)( [1-4]\.[0-9])?( international)?( license)?"),
    ("ccBySa", r"(this work is )?(licensed|released|distributed) under (a |the )?(cc[ -]by[ -]sa|creative commons attribution-sharealike)( [1-4]\.[0-9])?( international)?( license)?"),
    ("ccByNd", r"(this work is )?(licensed|released|distributed) under (a |the )?(cc[ -]by[ -]nd|creative commons attribution-noderivatives)( [1-4]\.[0-9])?( international)?( license)?"),
    ("ccBy", r"(this work is )?(licensed|released|distributed) under (a |the )?(cc[ -]by|creative commons attribution)( [1-4]\.[0-9])?( international)?( license)?"),
    ("cc0", r"(this work is )?(licensed|released|distributed|dedicated) under (the )?(cc0|creative commons zero)( 1\.0)?( universal)?( license)?"),
    ("mit", r"(this (file|work|software|project|code) is )?(licensed|released|distributed) under (the terms of )?the (mit|expat) licen[cs]e"),
    ("mitGrant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the software\), to deal in the software without restriction.*"),
    ("mitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mitAsIs", r"the software is provided as is, without warranty of any kind, express or implied.*"),
    ("mitLiab", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability.*"),
    ("bsdAny", r"(this (file|work|software|project|code) is )?(licensed|released|distributed) under (the terms of )?(the|a) (2|3|4|two|three|four)-clause bsd licen[cs]e"),
    ("bsdPlain", r"(this (file|work|software|project|code) is )?(licensed|released|distributed) under (the terms of )?(the|a) bsd(-style)? licen[cs]e"),
    ("bsdPre", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:?( 1)?"),
    ("bsdSource", r"(1\.? )?redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer( 2)?"),
    ("bsdBinary", r"(2\.? )?redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution( 3)?"),
    ("bsdEndorse", r"(3\.? )?neither the name of .* nor the names of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsdAsIs", r"this software is provided by .* as is and any express or implied warranties.*are disclaimed"),
    ("bsdLiab", r"in no event shall .* be liable for any direct, indirect, incidental, special, exemplary, or consequential damages.*"),
    ("iscGrant", r"permission to use, copy, modify, and(/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("iscAsIs", r"the software is provided as is and the author disclaims all warranties with regard to this software.*"),
    ("mpl2", r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("mpl2Any", r"(this (file|work|software|project|code) is )?(licensed|released|distributed) under (the terms of )?the mozilla public licen[cs]e,? ?(version|v\.?) ?2(\.0)?"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("publicDomain", r"(this (file|work|software) is )?(released|placed|dedicated) (in|in ?to|to) the public domain"),
    ("reserved", r"(copyright .*)?all rights reserved"),
    ("copyright", r"(copyright|\(c\)|©).*[0-9]{4}.*"),
)

#: Licence rules in their order, as (licence, pattern over ";id;id;..."): `;` starts each identifier.
RULES = (
    ("Apache-2.0", r"(?:;apache2)?;apache2Not(?:;apache2Copy)?(?:;apache2Basis)?(?:;apache2See)?"),
    ("Apache-2.0", r";spdxApache2|;apache2"),
    ("GPL-3.0-or-later", r";gplFree3(?:;gplHope)?(?:;gplSee)?(?:;gplCopy)?"),
    ("GPL-2.0-or-later", r";gplFree2(?:;gplHope)?(?:;gplSee)?(?:;gplCopy)?"),
    ("BSD-3-Clause", r";bsdPre;bsdSource;bsdBinary;bsdEndorse(?:;bsdAsIs)?(?:;bsdLiab)?"),
    ("BSD-2-Clause", r";bsdPre;bsdSource;bsdBinary(?:;bsdAsIs)?(?:;bsdLiab)?"),
    ("MIT", r"(?:;mit)?;mitGrant(?:;mitNotice)?(?:;mitAsIs)?(?:;mitLiab)?"),
    ("ISC", r";iscGrant(?:;iscAsIs)?(?:;bsdLiab)?"),
    ("MIT", r";spdxMit|;mit"),
    ("GPL-3.0-or-later", r";spdxGpl3Later|;gpl3Later"),
    ("GPL-2.0-or-later", r";spdxGpl2Later|;gpl2Later"),
    ("GPL-3.0", r";spdxGpl3"),
    ("GPL-2.0", r";spdxGpl2"),
    ("BSD-3-Clause", r";spdxBsd3"),
    ("BSD-2-Clause", r";spdxBsd2"),
    ("MPL-2.0", r";spdxMpl2|;mpl2Any|;mpl2"),
    ("AGPL-3.0", r";agplAny"),
    ("LGPL", r";lgplAny"),
    ("GPL-3.0", r";gpl3Any"),
    ("GPL-2.0", r";gpl2Any"),
    ("GPL", r";gplNoVersion"),
    ("CC-BY-NC-ND", r";ccByNcNd"),
    ("CC-BY-NC-SA", r";ccByNcSa"),
    ("CC-BY-NC", r";ccByNc"),
    ("CC-BY-SA", r";ccBySa"),
    ("CC-BY-ND", r";ccByNd"),
    ("CC-BY", r";ccBy"),
    ("CC0-1.0", r";cc0"),
    ("BSD", r";bsdAny|;bsdPlain"),
    ("Unlicense", r";unlicense"),
    ("LicenseRef-public-domain", r";publicDomain"),
    ("LicenseRef-other", r";spdxOther"),
    ("LicenseRef-all-rights-reserved", r";reserved"),
)
#: Ends each pattern, so that ;ccBy doesn't match the start of ;ccByNc.
END = r"(?=;|$)"


#: In a cut text: ends a sentence for sure; may end one or stand inside it (a wrapped line, `;`, an abbreviation); a found identifier stands between two of these.
HARD, SOFT, MARK = "\n", "\x02", "\x01"
QUOTES = "\"'`“”‘’"
#: A stop after one of these, or after a single letter, need not end a sentence.
ABBREVIATIONS = r"(?<![\p{L}0-9_.])((?:[vV]er|[vV]s|[nN]o|[iI]nc|[lL]td|[cC]o|[cC]orp|[eE]\.g|[iI]\.e|[cC]f|\p{L})\.)"
#: Identifiers whose open parts (`.*`) stay within a line.
ONE_LINE = ("spdxOther", "reserved", "copyright")


def cut(text: Column) -> Column:
    """Normalised sentences (lower case, no quotes or comment marks, single spaces), with HARD and SOFT between them.

    A line feed before a lower-case letter or `(` goes on with its sentence. One before anything else may end it or not,
    so it is SOFT, and patterns may begin, end or go on there.
    """
    s = F.translate(text, QUOTES + MARK + SOFT, "")
    s = F.regexp_replace(s, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"[ \t]+", " ")
    s = F.regexp_replace(s, r"(?<![^\n])[ */#;>-]++", "")
    s = F.regexp_replace(s, r"(?<![ */])[ */]++(?=\n|\z)", "")
    s = F.regexp_replace(s, r"\n++(?=https?://)", SOFT)
    s = F.regexp_replace(s, rf"{ABBREVIATIONS}(?: |\n(?!\n))", f"$1{SOFT}")
    s = F.regexp_replace(s, r"(?<![.!?:;\n])\n(?=[a-z(])", " ")
    s = F.regexp_replace(s, r"(?<![.!?:\n])\n(?!\n)|(?<=;) ", SOFT)
    s = F.regexp_replace(s, r"(?<![.!?])[.!?]++ ", HARD)
    return F.lower(F.regexp_replace(s, r"(?<=[\n\x02])[ */#;>-]++", ""))


def within(name: str, pattern: str) -> str:
    """A sentence's pattern over a cut text: from a sentence's possible start to its possible end."""
    p = pattern.replace("[ -]", rf"[ {SOFT}-]")
    p = re.sub(r" (?!\x02)", f"[ {SOFT}]", p)
    p = re.sub(r"(?<!\\)\.(?=[*+])", f"[^{HARD}{MARK}{SOFT if name in ONE_LINE else ''}]", p)
    return rf"(?<![^{HARD}{SOFT}])(?:{p})[ .,;:!?]*+(?=[{HARD}{SOFT}]|\z)"


def known(sentences: Column) -> Column:
    """The cut sentences with each known one replaced by its identifier between marks: fixed ones before those with open parts."""
    for name, pattern in sorted(SENTENCES, key=lambda x: bool(re.search(r"(?<!\\)\.[*+]", x[1]))):
        sentences = F.regexp_replace(sentences, within(name, pattern), f"{MARK}{name}{MARK}")
    return sentences


def needs_look_up(text: Column) -> Column:
    return F.translate(F.lower(text), QUOTES, "").rlike(CRITICAL)


def licenses(text: Column) -> Column:
    """struct(sequence, licenses): known identifiers in their order, and licences found, in the rules' order."""
    one = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731 (the value is worked out once)
    candidates = F.array_join(F.filter(F.split(cut(text), HARD), lambda s: s.rlike(CRITICAL)), HARD)
    ids = one(candidates, lambda s: F.regexp_extract_all(known(s), F.lit(f"{MARK}([^{MARK}]+){MARK}"), F.lit(1)))
    return one(F.array_join(F.transform(ids, lambda s: F.concat(F.lit(";"), s)), ""), matched)


def matched(sequence: Column) -> Column:
    rules = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(f"(?:{p}){END}").alias("pattern")) for n, p in RULES])
    zero = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.struct(
        F.regexp_replace(acc["left"], r["pattern"], ";-").alias("left"),
        F.concat(acc["found"], F.array_repeat(r["license"], F.regexp_count(acc["left"], r["pattern"]))).alias("found"),
    )
    empty = F.array().cast("array<string>")
    found = F.when(sequence == "", empty).otherwise(F.aggregate(rules, zero, step, lambda acc: acc["found"]))
    return F.struct(sequence.alias("sequence"), found.alias("found"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sequence (";id;id"), licenses (comma-joined, a licence once), n_matches.

    Null, empty and unlicensed texts give empty strings and 0; repeated rows stay; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hit = F.when(needs_look_up(text), licenses(text))
    return docs.select("doc_id", hit.alias("hit")).select(
        "doc_id",
        F.coalesce("hit.sequence", F.lit("")).alias("sequence"),
        F.coalesce(F.array_join(F.array_distinct("hit.found"), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.size("hit.found"), F.lit(0)).cast("bigint").alias("n_matches"),
    )
