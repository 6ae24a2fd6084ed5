"""License rules against a plain version that runs every rule on every text."""

from __future__ import annotations

import random
import re
from re import _parser

import brute

from heronlake.llm import licenses

NO_LICENSE_WORD = ["This library is released under the GPL version 3 or later.", "available under CC BY-SA 4.0", "distributed under the terms of the MIT/X11 terms"]

DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF\nMERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
MIT = f"""Copyright (c) 2019 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{DISCLAIMER}
"""
BSD = """Copyright (c) 2019, Jo Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
ISC = """Copyright (c) 2019, Jo Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.
"""


def written(tree, rng):
    """A random string that a parsed regex matches, look-arounds aside."""
    out = ""
    for op, x in tree:
        match str(op):
            case "LITERAL":
                out += chr(x)
            case "IN":
                kind, y = rng.choice(x)
                out += chr(rng.randint(*y)) if str(kind) == "RANGE" else chr(y)
            case "BRANCH":
                out += written(rng.choice(x[1]), rng)
            case "SUBPATTERN":
                out += written(x[-1], rng)
            case "MAX_REPEAT":
                out += "".join(written(x[2], rng) for _ in range(rng.randint(x[0], min(x[1], 5))))
            case "ASSERT_NOT":
                pass
            case _:
                raise AssertionError(op)
    return out


def samples(rule, n, rng):
    """Texts that the rule's regex matches."""
    tree = _parser.parse(rule[1], re.ASCII)
    drawn = (written(tree, rng) for _ in range(n))
    return [x for x in drawn if re.search(rule[1], x, re.ASCII)]


def checked(spark, texts):
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(texts)
    out = {}
    for r in got:
        text = texts[r.doc_id]
        want = brute.license_rules(text, [(x[0], x[1], *x[-2:]) for x in licenses.rules()])
        assert [(d.start, d.end, d.label, d.confidence) for d in r.detections] == want, text
        assert set(filter(None, r.labels.split(","))) == {x[2] for x in want} | set(filter(None, r.base_labels.split(","))), text
        assert r.score == max([x[3] for x in want], default=0.5 if r.n_base else 0.0), text
        out[text] = r.labels
    return out


def test_names_without_the_word_license(spark):
    got = checked(spark, NO_LICENSE_WORD)
    assert [got[t] for t in NO_LICENSE_WORD] == ["gpl-3.0", "cc-by-sa", "mit"] and "licen" not in "".join(NO_LICENSE_WORD).lower()


def test_forms_and_names(spark):
    rng = random.Random(7)
    texts = [f"é中 {x}; {y}" for r in licenses.rules() for x, y in [rng.choices(samples(r, 8, rng) or [""], k=2)]]
    checked(spark, [None, "", "under the weather", *texts])


def test_whole_notices(spark):
    short = MIT[: MIT.index("to any person")]
    texts = [MIT, BSD, ISC, short, "All rights reserved.", "available under the 2-Clause license"]
    got = checked(spark, texts)
    assert [got[t] for t in texts] == ["all-rights-reserved,mit", "all-rights-reserved,bsd", "all-rights-reserved,isc", "all-rights-reserved,mit", "all-rights-reserved", "bsd-2-clause"]
    assert not any("license" in t.lower() for t in (BSD, ISC, short))


def test_texts_in_full(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License."
    gpl = "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    boost = "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation"
    free = "This is free and unencumbered software released into the public domain."
    texts = [apache, gpl, boost, free, "https://creativecommons.org/licenses/by-sa/4.0/"]
    got = checked(spark, texts)
    assert [got[t] for t in texts] == ["apache,apache-2.0", "gpl,gpl-3.0", "boost", "unlicense", "cc-by-sa"]


def test_words_are_implied_by_each_regex():
    rng = random.Random(3)
    for rule in licenses.rules():
        drawn = samples(rule, 200, rng)
        assert len(drawn) > 20, rule
        for x in drawn:
            assert rule[2] in x.lower() and any(k in x.lower() for k in rule[3].split("|")), (rule, x)
