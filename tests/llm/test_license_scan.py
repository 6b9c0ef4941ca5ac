import random
import re

import pytest
from pyspark.sql import functions as F

from tallyrank.llm import license_scan as ls

# Notices as they stand in files, written out here; the operator's own templates aren't read by these tests.
WRAPPED = {
    "mit": "Copyright (c) 2024 A. Author\n\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software without\nrestriction, including without limitation the rights to use, copy, modify,\nmerge, publish, distribute, sublicense, and/or sell copies of the Software,\nand to permit persons to whom the Software is furnished to do so, subject to\nthe following conditions:",
    "bsd": "# Redistribution and use in source and binary forms, with or\r\n# without modification, are permitted provided that the\r\n# following conditions are met:\r\n# 1. Redistributions of source code must retain the above copyright\r\n#    notice, this list of conditions and the following disclaimer.",
    "gpl": "/*\n * This program is free software; you can redistribute it\n * and/or modify it under the terms of the GNU General Public\n * License.\n */",
    "gpl-2": " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.",
    "gpl-3": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU General Public License for more details.",
    "agpl-3": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU Affero General Public License as published\n    by the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "cc-by": "This work is licensed under a\nCreative Commons Attribution 4.0 International\nLicense.",
    "cc-by-sa": "This work is licensed under a Creative\nCommons Attribution-ShareAlike 4.0\nInternational License.",
    "cc-by-nc": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 3.0 Unported License.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "zlib": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    "mpl-2": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software",
}
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at"


def scanned(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(ls.scan(docs, **options).collect(), key=lambda r: r.doc_id)]


def test_wrapped_notices_give_exactly_their_label(spark):
    got = scanned(spark, WRAPPED.values())
    assert [(r.labels, r.base_labels, r.n_base) for r in got] == [(label, "", 0) for label in WRAPPED]
    assert all(r.score >= 0.95 for r in got)
    (apache,) = scanned(spark, [APACHE])
    assert (apache.labels, apache.base_labels, apache.score) == ("apache-2", "apache-2", 1.0) and any(b.label == "apache-2" for b in apache.blocks)


def test_several_notices_in_one_text(spark):
    both = WRAPPED["gpl-3"] + "\n" + WRAPPED["agpl-3"] + " filler words here" * 40 + WRAPPED["cc-by-sa"] + " " + WRAPPED["cc-by"]
    (r,) = scanned(spark, [both])
    assert r.labels == "agpl-3,cc-by,cc-by-sa,gpl-3"
    spans = [(b.first_word, b.end_word) for b in r.blocks]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    (many,) = scanned(spark, [(WRAPPED["mit"] + "\n") * 400])
    assert many.labels == "mit" and len(many.blocks) == 800


def test_distinguishing_words_decide(spark):
    cut = {
        WRAPPED["agpl-3"].replace("Affero ", ""): "gpl-3", WRAPPED["gpl-3"].replace("redistribute", "share"): "gpl-3", WRAPPED["agpl-3"].replace("redistribute", "share"): "agpl-3",
        WRAPPED["cc-by-sa"].replace("-ShareAlike", ""): "cc-by", "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "a program that is free and under a license of the public": "",
    }
    assert [r.labels for r in scanned(spark, cut)] == list(cut.values())


SIBLINGS = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl-3",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.": "gpl-3",
    "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, as published by the Free Software Foundation, either version 3 of the License or any later version.": "agpl-3",
    "This software is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl-2",
    "This file is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.": "lgpl",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.": "cc-by-nc-nd",
    "This work is licensed under the Creative Commons Attribution-NoDerivs 2.5 Generic License.": "cc-by-nd",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd",
    "This document is licensed under a Creative Commons Attribution 2.0 License.": "cc-by",
    "Except where noted, this work is licensed under a Creative Commons Attribution-Share Alike 3.0 United States License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-Non-Commercial-Share Alike 2.0 License.": "cc-by-nc-sa",
    "This work is licensed under a Creative Commons Attribution-No Derivative Works 3.0 License": "cc-by-nd",
    "Licensed under the GNU Lesser General Public License, version 2.1": "lgpl-2.1",
    "The code is licensed under the terms of the GNU Affero General Public License version 3.": "agpl-3",
    "Licensed under the GNU General Public License (GPL), version 2 or 3": "",
}


def test_siblings_worded_unlike_the_templates(spark):
    assert [(r.labels, r.score >= 0.8) for r in scanned(spark, SIBLINGS)] == [(x, bool(x)) for x in SIBLINGS.values()]
    # Below one another in one text, with something between, each keeps its label.
    both = list(SIBLINGS)[:2] + list(SIBLINGS)[5:9]
    (r,) = scanned(spark, ["\nSome words of their own stand between.\n".join(both)])
    assert r.labels == ",".join(sorted({SIBLINGS[x] for x in both}))


def test_spread_notices(spark):
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()
    apart = lambda pads: " ".join(w + " pad" * pads for w in notice)
    # Its template has 20 words, so a block 40: with a pad after each word it spans 39, with two pads 40 words hold 14 of its 19.
    texts = ["\n".join(notice), "pad " * 17 + apart(1), "pad " * 17 + apart(2), " ".join(notice[:9]) + "\npad" * 50 + " ".join(notice[9:]), "pad " * 500 + " ".join(notice) + " more" * 500, " ".join(w for w in notice if w not in ("charge", "person")), " ".join(notice[::2])]
    assert [(r.labels, round(r.score, 3)) for r in scanned(spark, texts)] == [("mit", 1.0), ("mit", 1.0), ("", 0.0), ("", 0.0), ("mit", 1.0), ("mit", 0.895), ("", 0.0)]


SMALL = [("x", "a b c d e"), ("xy", "a b c d e f"), ("z", "p q r"), ("z2", "p q s t"), ("x", "e f g h a")]


def slow_blocks(words, threshold, factor):
    """Every stretch against every template, best first, none that shares a word with one taken before."""
    every = []
    for k, (label, text) in enumerate(SMALL):
        own = set(text.split())
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + factor * len(text.split())) + 1):
                share = len(own & set(words[a:b])) / len(own)
                if share >= threshold - 1e-9:
                    every.append((-share, -len(own), b - a, k, a, label))
    out = []
    for share, _, n, _, a, label in sorted(every):
        if all(a + n <= c or d <= a for _, _, c, d in out):
            out.append((label, -share, a, a + n))
    return sorted(out, key=lambda x: x[2])


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_blocks_against_brute_force(spark, threshold):
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefghpqrst" + "uvw" * 4) for _ in range(r.randrange(0, 60))) for _ in range(300)]
    got = scanned(spark, texts, templates=SMALL, phrases={}, threshold=threshold)
    assert [[tuple(b) for b in x.blocks] for x in got] == [slow_blocks(t.split(), threshold, 2) for t in texts]
    assert [x.labels for x in got] == [",".join(sorted({b[0] for b in slow_blocks(t.split(), threshold, 2)})) for t in texts]
    assert sum(len(x.blocks) for x in got) > 100


TEXTS = [
    "x Released under the MIT License. Under the mit license!", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "under the mit licenses", "under the mit licensé", "cc by nc by nc cc by nc", None, "", "...", "the the the",
    "under\nthe\tMIT--license", "under the mit license under the mit license", "cc by\x00nc", "CC\x1fBY\x7fNC",
]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_base(text):
    w, places, base = words(text), [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)))


def test_base_columns(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash")).withColumn("n_words", F.lit(1))
    got = ls.scan(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((d, *slow_base(t)) for d, t in rows), key=str)
    assert all(r.labels == r.base_labels and r.score == float(bool(r.base_labels)) for r in got)


def test_empty(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
