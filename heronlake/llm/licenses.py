"""License scans by ordered signature rules (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower
from .quality import let
from .spans import hits

#: Phrases of the base count: words that stand one after the other, and their label.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_V = "(?:[ ,;(-]{0,3}(?:version|ver\\.?|v\\.?)?[ -]{0,2}%s(?:\\.0)?(?![0-9.][0-9]))"
_OR = "(?:[ ,(]{0,2}or[ ](?:\\(at your option\\)[ ]?)?(?:any[ ])?later(?:[ ]version)?\\)?)?"
#: label, name as written (a regex), SPDX ids, keywords of which a text must hold one. Names that are part of others have the shorter match.
NAMES = [
    ("mit", "MIT(?:/X11|/Expat)?", "MIT|MIT-0", "mit"),
    ("apache-2.0", "Apache(?: Software)?(?: License)?" + _V % "2", "Apache-2\\.0", "apache"),
    ("apache-1.1", "Apache(?: Software)?(?: License)?" + _V % "1\\.1", "Apache-1\\.1", "apache"),
    ("apache", "Apache(?: Software)?", "Apache-1\\.0", "apache"),
    ("gpl-2.0", "(?:GNU )?(?:General Public License|GPL)" + _V % "2" + _OR, "GPL-2\\.0(?:-only|-or-later|\\+)?", "general public|gpl"),
    ("gpl-3.0", "(?:GNU )?(?:General Public License|GPL)" + _V % "3" + _OR, "GPL-3\\.0(?:-only|-or-later|\\+)?", "general public|gpl"),
    ("gpl", "(?:GNU )?(?:General Public|GPL)", "GPL-1\\.0(?:-only|-or-later|\\+)?", "general public|gpl"),
    ("lgpl-2.1", "(?:GNU )?(?:Lesser General Public License|LGPL)" + _V % "2\\.1" + _OR, "LGPL-2\\.1(?:-only|-or-later|\\+)?", "lesser general|lgpl"),
    ("lgpl-3.0", "(?:GNU )?(?:Lesser General Public License|LGPL)" + _V % "3" + _OR, "LGPL-3\\.0(?:-only|-or-later|\\+)?", "lesser general|lgpl"),
    ("lgpl", "(?:GNU )?(?:Lesser General Public|Library General Public|LGPL)", "LGPL-2\\.0(?:-only|-or-later|\\+)?", "lesser general|library general|lgpl"),
    ("agpl-3.0", "(?:GNU )?(?:Affero General Public License|AGPL)" + _V % "3" + _OR, "AGPL-3\\.0(?:-only|-or-later|\\+)?", "affero|agpl"),
    ("agpl", "(?:GNU )?(?:Affero General Public|AGPL)", "AGPL-1\\.0(?:-only|-or-later)?", "affero|agpl"),
    ("fdl", "GNU Free Documentation", "GFDL-1\\.[123](?:-only|-or-later)?", "free documentation"),
    ("bsd-2-clause", "(?:2-Clause|Simplified|FreeBSD)(?: BSD)?", "BSD-2-Clause", "2-clause|simplified|freebsd"),
    ("bsd-3-clause", "(?:3-Clause|New|Modified|Revised) BSD", "BSD-3-Clause", "bsd"),
    ("bsd", "BSD", "BSD-4-Clause|0BSD", "bsd"),
    ("isc", "ISC", "ISC", "isc"),
    ("mpl-1.1", "(?:Mozilla Public License|MPL)" + _V % "1\\.1", "MPL-1\\.1", "mozilla|mpl"),
    ("mpl-2.0", "(?:Mozilla Public License|MPL)" + _V % "2", "MPL-2\\.0", "mozilla|mpl"),
    ("mpl", "Mozilla Public", "MPL-1\\.0", "mozilla"),
    ("epl-1.0", "(?:Eclipse Public License|EPL)" + _V % "1", "EPL-1\\.0", "eclipse|epl"),
    ("epl-2.0", "(?:Eclipse Public License|EPL)" + _V % "2", "EPL-2\\.0", "eclipse|epl"),
    ("epl", "Eclipse Public", "EPL", "eclipse"),
    ("cddl", "(?:Common Development and Distribution|CDDL)", "CDDL-1\\.[01]", "common development|cddl"),
    ("eupl", "(?:European Union Public|EUPL)", "EUPL-1\\.[012]", "european union|eupl"),
    ("artistic", "Artistic", "Artistic-[12]\\.0", "artistic"),
    ("zlib", "zlib(?:/libpng)?", "Zlib", "zlib"),
    ("unlicense", "Unlicense", "Unlicense", "unlicense"),
    ("wtfpl", "(?:WTFPL|Do What The F[u*]ck You Want To Public)", "WTFPL", "wtfpl|do what the"),
    ("boost", "Boost Software", "BSL-1\\.0", "boost"),
    ("python", "Python Software Foundation|PSF", "PSF-2\\.0|Python-2\\.0", "python software|psf"),
    ("ruby", "Ruby", "Ruby", "ruby"),
    ("php", "PHP", "PHP-3\\.0[1]?", "php"),
    ("postgresql", "PostgreSQL", "PostgreSQL", "postgresql"),
    ("openssl", "OpenSSL", "OpenSSL", "openssl"),
    ("ofl", "(?:SIL )?Open Font", "OFL-1\\.[01]", "open font"),
    ("cc0", "(?:CC0|Creative Commons Zero)(?: 1\\.0)?", "CC0-1\\.0", "cc0|creative commons zero"),
    ("cc-by", "(?:CC[ -]BY|Creative Commons Attribution)(?: [1234]\\.[05])?", "CC-BY-[1234]\\.[05]", "cc-by|cc by|creative commons attribution"),
    ("cc-by-sa", "(?:CC[ -]BY-SA|Creative Commons Attribution-ShareAlike)(?: [1234]\\.[05])?", "CC-BY-SA-[1234]\\.[05]", "by-sa|sharealike"),
    ("cc-by-nd", "(?:CC[ -]BY-ND|Creative Commons Attribution-NoDerivatives)(?: [1234]\\.[05])?", "CC-BY-ND-[1234]\\.[05]", "by-nd|noderivatives"),
    ("cc-by-nc", "(?:CC[ -]BY-NC|Creative Commons Attribution-NonCommercial)(?: [1234]\\.[05])?", "CC-BY-NC-[1234]\\.[05]", "by-nc|noncommercial"),
    ("cc-by-nc-sa", "(?:CC[ -]BY-NC-SA|Creative Commons Attribution-NonCommercial-ShareAlike)(?: [1234]\\.[05])?", "CC-BY-NC-SA-[1234]\\.[05]", "nc-sa|noncommercial"),
    ("cc-by-nc-nd", "(?:CC[ -]BY-NC-ND|Creative Commons Attribution-NonCommercial-NoDerivatives)(?: [1234]\\.[05])?", "CC-BY-NC-ND-[1234]\\.[05]", "nc-nd|noncommercial"),
    ("odbl", "(?:Open Database|ODbL)", "ODbL-1\\.0", "open database|odbl"),
    ("ogl", "Open Government", "OGL-UK-[123]\\.0", "open government"),
    ("proprietary", "(?:proprietary|commercial)(?: software)?", "LicenseRef-[A-Za-z0-9.-]{1,60}", "proprietary|commercial"),
]
#: Statement forms around a name: (regex with %s for the name, a word that it can't match without, priority, confidence). Priority 6 is the highest.
_SP = "[ \\t]{0,3}\\r?\\n?[ \\t*#/]{0,4}"
FORMS = [
    ("SPDX-License-Identifier:[ \\t]{0,4}(?:%s)(?![A-Za-z0-9-])", "spdx-license-identifier", 6, 1.0),
    ("(?:is|are|be|being)" + _SP + "(?:dual-)?(?:licensed|released|distributed|published|available|provided)" + _SP + "under" + _SP + "(?:the" + _SP + ")?(?:terms" + _SP + "of" + _SP + "(?:the" + _SP + ")?)?(?:%s)(?![A-Za-z0-9])(?:" + _SP + "licen[sc]e)?", "under", 5, 0.95),
    ("(?:licensed|released|distributed|published|available|provided)" + _SP + "under" + _SP + "(?:an?" + _SP + "|the" + _SP + ")?(?:terms" + _SP + "of" + _SP + "(?:the" + _SP + ")?)?(?:%s)(?![A-Za-z0-9])(?:" + _SP + "licen[sc]e)?", "under", 4, 0.9),
    ("under" + _SP + "the" + _SP + "terms" + _SP + "of" + _SP + "(?:an?" + _SP + "|the" + _SP + ")?(?:%s)(?![A-Za-z0-9])(?:" + _SP + "licen[sc]e)?", "under", 4, 0.85),
    ("licen[sc]e[ds]?[ \\t]{0,4}[:=][ \\t]{0,4}[\"']?(?:%s)(?![A-Za-z0-9-])", "licen", 3, 0.8),
    ("(?<![A-Za-z0-9-])(?:%s)" + _SP + "licen[sc]e(?![A-Za-z])", "licen", 2, 0.7),
    ("(?:see|read|accept|follow|subject" + _SP + "to)" + _SP + "(?:the" + _SP + ")?(?:%s)" + _SP + "licen[sc]e(?![A-Za-z])", "licen", 3, 0.75),
]
#: Statements that name no license, with words that each regex can't match without.
OTHERS = [
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 3, 0.6),
    ("all-rights-reserved", "copyright[ \\t]{0,3}(?:\\(c\\)|\u00a9)?[ \\t]{0,3}(?:19|20)[0-9]{2}", "copyright", 1, 0.3),
    ("public-domain", "(?:released|placed|dedicated)" + _SP + "(?:in|in?to)" + _SP + "the" + _SP + "public domain", "public domain", 4, 0.9),
    ("public-domain", "(?:is|are)" + _SP + "in" + _SP + "the" + _SP + "public domain", "public domain", 3, 0.7),
    ("copyleft", "copyleft", "copyleft", 1, 0.3),
    ("mit", "permission is hereby granted, free of charge", "permission is hereby granted", 4, 0.8),
    ("isc", "permission to use, copy, modify, and(?:/or)? distribute this software", "permission to use", 4, 0.7),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use", 4, 0.8),
    ("license-file", "see" + _SP + "(?:the" + _SP + ")?licen[sc]e" + _SP + "(?:file|for details)", "licen", 1, 0.2),
]
_WHO = "[A-Za-z0-9\\x20,.&'-]{1,80}"
#: Sentences of whole license texts, notices and addresses, each with two words that it can't match without. A space stands for white space and comment marks.
SIGNATURES = [
    ("apache-2.0", "licensed under the apache license, version 2\\.0 \\(the [\"'\u201c]license[\"'\u201d]\\); you may not use this file except in compliance with the license", "licen", "apache", 5, 1.0),
    ("apache-2.0", "apache license version 2\\.0, january 2004", "licen", "apache", 5, 1.0),
    ("apache-2.0", "terms and conditions for use, reproduction, and distribution", "distribution", "reproduction", 4, 0.6),
    ("apache-2.0", "apache\\.org/licenses/license-2\\.0", "licen", "apache", 5, 0.95),
    ("apache-2.0", "opensource\\.org/licenses?/apache-2\\.0", "licen", "opensource", 5, 0.95),
    ("gpl-3.0", "either version 3 of the license, or \\(at your option\\) any later version", "licen", "option", 3, 0.6),
    ("gpl-2.0", "either version 2 of the license, or \\(at your option\\) any later version", "licen", "option", 3, 0.6),
    ("gpl", "this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license", "licen", "redistribute", 5, 0.95),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|file|software)", "licen", "received", 5, 0.9),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", "licen", "verbatim", 4, 0.8),
    ("gpl", "gnu\\.org/(?:licenses|copyleft)/gpl", "gnu", "gpl", 4, 0.9),
    ("gpl-2.0", "gnu\\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl-2\\.0", "gnu", "gpl-2", 5, 0.95),
    ("gpl-3.0", "gnu\\.org/(?:licenses|copyleft)/gpl-3\\.0", "gnu", "gpl-3", 5, 0.95),
    ("gpl-2.0", "gnu general public license version 2, june 1991", "licen", "1991", 5, 1.0),
    ("gpl-3.0", "gnu general public license version 3, 29 june 2007", "licen", "2007", 5, 1.0),
    ("lgpl", "this library is free software[:;] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license", "licen", "redistribute", 5, 0.95),
    ("lgpl", "gnu\\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl", "gnu", "lgpl", 5, 0.9),
    ("lgpl-2.1", "gnu lesser general public license version 2\\.1, february 1999", "licen", "1999", 5, 1.0),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation, either version 3", "licen", "affero", 5, 1.0),
    ("agpl", "gnu\\.org/licenses/agpl", "gnu", "agpl", 5, 0.9),
    ("fdl", "permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", "licen", "document", 5, 1.0),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license, v\\.\\x20?2\\.0", "licen", "mozilla", 5, 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1\\.1", "licen", "mozilla", 5, 1.0),
    ("mpl-2.0", "mozilla\\.org/(?:en-us/)?mpl/2\\.0", "mozilla", "mpl", 5, 0.95),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "licen", "eclipse", 5, 0.95),
    ("epl-2.0", "eclipse\\.org/legal/epl-(?:2\\.0|v20)", "eclipse", "epl", 5, 0.95),
    ("epl-1.0", "eclipse\\.org/legal/epl-v10", "eclipse", "epl", 5, 0.95),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "licen", "development", 5, 1.0),
    ("mit", "to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge", "software", "restriction", 5, 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "software", "substantial", 4, 0.9),
    ("mit", "opensource\\.org/licenses?/mit(?![a-z])", "licen", "opensource", 5, 0.95),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistribution", "retain", 4, 0.8),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistribution", "reproduce", 4, 0.8),
    ("bsd-3-clause", "neither the names? of " + _WHO + " nor the names of (?:its|any|the|other) contributors may be used to endorse or promote products derived from this software", "software", "endorse", 5, 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "software", "advertising", 5, 1.0),
    ("bsd-2-clause", "opensource\\.org/licenses?/bsd-2-clause", "licen", "opensource", 5, 0.95),
    ("bsd-3-clause", "opensource\\.org/licenses?/bsd-3-clause", "licen", "opensource", 5, 0.95),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", "permission", "appear", 3, 0.6),
    ("zlib", "this software is provided [\"'\u2018\u201c]as-is[\"'\u2019\u201d], without any express or implied warranty", "software", "as-is", 4, 0.8),
    ("zlib", "altered source versions must be plainly marked as such", "source", "plainly", 5, 0.95),
    ("zlib", "the origin of this software must not be misrepresented", "software", "misrepresented", 5, 0.95),
    ("boost", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", "permission", "organization", 5, 1.0),
    ("boost", "boost\\.org/license_1_0\\.txt", "licen", "boost", 5, 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", "software", "unencumbered", 5, 1.0),
    ("unlicense", "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "software", "compile", 5, 0.95),
    ("unlicense", "unlicense\\.org", "licen", "unlicense", 4, 0.9),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "licen", "verbatim", 5, 1.0),
    ("python", "psf license agreement for python", "licen", "python", 5, 1.0),
    ("ruby", "you (?:can|may) redistribute it and/or modify it under either the terms of the (?:gpl|2-clause bsdl)", "redistribute", "either", 5, 0.95),
    ("php", "redistributions of any form whatsoever must retain the following acknowledgment", "redistribution", "whatsoever", 5, 0.8),
    ("openssl", "this product includes software developed by the openssl project", "software", "openssl", 5, 0.95),
    ("postgresql", "permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee", "permission", "documentation", 5, 0.9),
    ("ofl", "this font software is licensed under the sil open font license", "licen", "font", 5, 1.0),
    ("ofl", "scripts\\.sil\\.org/ofl", "ofl", "scripts", 5, 0.95),
    ("artistic", "you may make and give away verbatim copies of the source form of the standard version", "source", "verbatim", 5, 0.9),
    ("cc0", "to the extent possible under law, " + _WHO + " has waived all copyright and related or neighboring rights", "copyright", "waived", 5, 1.0),
    ("cc0", "creativecommons\\.org/publicdomain/zero/1\\.0", "creativecommons", "zero", 5, 0.95),
    ("cc-by", "creativecommons\\.org/licenses/by/[1-4]\\.[05]", "creativecommons", "/by/", 5, 0.95),
    ("cc-by-sa", "creativecommons\\.org/licenses/by-sa/[1-4]\\.[05]", "creativecommons", "/by-sa/", 5, 0.95),
    ("cc-by-nd", "creativecommons\\.org/licenses/by-nd/[1-4]\\.[05]", "creativecommons", "/by-nd/", 5, 0.95),
    ("cc-by-nc", "creativecommons\\.org/licenses/by-nc/[1-4]\\.[05]", "creativecommons", "/by-nc/", 5, 0.95),
    ("cc-by-nc-sa", "creativecommons\\.org/licenses/by-nc-sa/[1-4]\\.[05]", "creativecommons", "/by-nc-sa/", 5, 0.95),
    ("cc-by-nc-nd", "creativecommons\\.org/licenses/by-nc-nd/[1-4]\\.[05]", "creativecommons", "/by-nc-nd/", 5, 0.95),
    ("odbl", "opendatacommons\\.org/licenses/odbl", "licen", "odbl", 5, 0.95),
    ("ogl", "nationalarchives\\.gov\\.uk/doc/open-government-licence", "licen", "nationalarchives", 5, 0.95),
    ("proprietary", "this (?:software|document|file) is (?:the )?confidential and proprietary information of", "proprietary", "confidential", 5, 0.9),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|document)", "unauthori", "unauthori", 4, 0.8),
]
LEVELS = 6


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(label, regex, word, keywords, priority, confidence): every form for every name, the others, and the signatures.

    The regex matches only texts that hold, in any case, the word and one of the keywords.
    """
    out = []
    for label, name, spdx, keyword in NAMES:
        for form, word, priority, confidence in FORMS:
            out.append((label, "(?i)" + form % (spdx if priority == LEVELS else name), word, word if priority == LEVELS else keyword, priority, confidence))
    out += [(label, "(?i)" + regex, keyword, keyword, priority, confidence) for label, regex, keyword, priority, confidence in OTHERS]
    return out + [(label, "(?i)" + regex.replace(" ", _SP), *rest) for label, regex, *rest in SIGNATURES]


def _to_run(text):
    """Array of struct(r, p): number and regex of the rules whose word and one of whose keywords a text holds. Each is looked for once a word."""
    words: dict[str, dict[str, list]] = {}
    for r, (_, p, word, keywords, _, _) in enumerate(rules()):
        words.setdefault(word, {}).setdefault(keywords, []).append(F.struct(F.lit(r).alias("r"), F.lit(p).alias("p")))
    listed = F.array(*[
        F.struct(F.lit(w).alias("w"), F.array(*[F.struct(F.array(*[F.lit(x) for x in k.split("|")]).alias("k"), F.array(*m).alias("m")) for k, m in of.items()]).alias("of"))
        for w, of in words.items()
    ])

    def of(low):
        held = F.flatten(F.transform(F.filter(listed, lambda x: low.contains(x.w)), lambda x: x.of))
        return F.flatten(F.transform(F.filter(held, lambda x: F.exists(x.k, lambda k: low.contains(k))), lambda x: x.m))

    return let(F.lower(text), of)


def _base(found):
    """Array of struct(i, label): places of the base phrases in a list of words."""

    def at(w):
        def of(x, i):
            case = F.lit(None).cast("string")
            for phrase, label in PHRASES.items():
                hit = x == phrase[0]
                for k, p in enumerate(phrase[1:], 1):
                    hit = hit & (F.get(w, i + k) == p)
                case = F.when(hit, label).otherwise(case)
            return F.struct(i.alias("i"), case.alias("label"))

        return F.filter(F.transform(w, of), lambda s: s.label.isNotNull())

    return let(found, at)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    A rule runs over the texts that hold its word and a keyword, without which it can't match. Of detections in one text, those that lie
    within one of higher priority are dropped, as are those within an equal or longer one of the same priority (of equal
    ones the first label stays). detections: array of struct(start, end, label, confidence) in code points, in order.
    score: the highest confidence, 0.5 where only base phrases were found, else 0. Null text counts as empty; rows are
    independent of each other, repeated ones included. The rules' table is fixed, so it goes along with the plan.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), text.alias("_t"))

    def count(s):
        return F.size(s) - F.when(F.get(s, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(s) > 1) & (F.element_at(s, -1) == ""), 1).otherwise(0)

    rows = rows.withColumn("n_words", let(F.split("_t", NOT_WORD), count).cast("long"))
    none = F.array().cast("array<struct<i:int,label:string>>")
    lower_words = F.filter(F.split(ascii_lower(F.col("_t")), NOT_WORD), lambda x: x != "")
    rows = rows.withColumn("_b", F.when(F.col("_t").contains("icense") | F.lower("_t").contains("license"), _base(lower_words)).otherwise(none))
    rows = rows.select("doc_id", "_row", "n_words", "_b", "_t", F.explode_outer(_to_run(F.col("_t"))).alias("_m"))
    found = rows.select("doc_id", "_row", "n_words", "_b", F.col("_m.r").alias("_r"), F.explode_outer(F.when(F.col("_m").isNotNull() & F.regexp_like("_t", F.col("_m.p")), hits(F.col("_t"), F.col("_m.p")))).alias("_x"))
    before = Window.partitionBy("_row", "_r").orderBy("_x.k").rowsBetween(Window.unboundedPreceding, 0)
    labels, levels, sure = ([F.lit(x[k]) for x in rules()] for k in (0, 4, 5))
    of = lambda values: F.element_at(F.array(*values), F.col("_r") + 1)
    placed = found.withColumn("end", F.sum(F.col("_x.gap") + F.length("_x.hit")).over(before)).withColumn("start", F.col("end") - F.length("_x.hit"))
    placed = placed.select("doc_id", "_row", "n_words", "_b", "start", "end", of(labels).alias("label"), of(levels).alias("level"), of(sure).alias("sure"))
    order = Window.partitionBy("_row").orderBy(F.col("start"), F.col("end").desc(), F.col("level").desc(), F.col("label"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for level in range(1, LEVELS + 1):
        covered = covered | ((F.col("level") == level) & (F.max(F.when(F.col("level") >= level, F.col("end"))).over(earlier) >= F.col("end")))
    kept = placed.withColumn("_keep", F.col("start").isNotNull() & ~F.coalesce(covered, F.lit(False)))
    item = F.when(F.col("_keep"), F.struct("start", "end", "label", F.col("sure").alias("confidence")))
    out = kept.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("_b").alias("_b"), F.array_sort(F.collect_list(item)).alias("detections"))
    base = F.array_distinct(F.transform("_b", lambda x: x.label))
    both = F.array_distinct(F.concat(base, F.transform("detections", lambda x: x.label)))
    return out.select(
        "doc_id", "n_words", F.size("_b").cast("long").alias("n_base"),
        F.element_at(F.when(F.size("_b") > 0, F.col("_b")), 1).i.cast("long").alias("first_word"),
        F.element_at(F.when(F.size("_b") > 0, F.col("_b")), -1).i.cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(both), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x.confidence)), F.when(F.size("_b") > 0, 0.5), F.lit(0.0)).alias("score"),
        "detections",
    )
