"""Decontamination, licences, sharding and URL rules on small rows with every odd case."""

import random
import re

from pyspark.sql import functions as F

from tessera.llm import decontamination as dc
from tessera.llm import license_scan, sharding, url_filter
from tessera.llm.words import NON_WORD, SPACE, plain_words

LOWER = {k: k + 32 for k in range(65, 91)}


def test_words_are_those_of_the_patterns():
    texts = ["", " ", "A b\tC", "é É ÀB", "x\x0by\x1cz", "a--b!!", "\x7fq", "日本 語", "a" * 5000 + " b", None]
    for t in texts:
        low = (t or "").translate(LOWER)
        assert plain_words(t, SPACE) == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)]
        assert plain_words(t, NON_WORD) == [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    items = {k: " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 10, 14]))) for k in range(8)}
    items |= {8: "", 9: None, 10: "w1", 100: items[0]}
    docs = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([0, 1, 8, 40]))]
        if k % 3 == 0 and body:
            at = rng.randrange(len(body))
            body[at:at] = (items[rng.randrange(8)] or "").upper().split()
        docs.append((k, " ".join(body)))
    return items, docs + [(60, None), (61, ""), (3, docs[3][1]), (None, items[1])]


def test_phrases_like_brute_force(spark):
    items, docs = corpus()
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (dc.BLOCK_WINDOWS, 5):
        got = sorted(dc.decontaminate(d, b, block=block).select("doc_id", "n_words", "n_hit", "items").collect(), key=str)
        want = sorted([(i, *dc.reference_matches(t, items)) for i, t in docs], key=lambda r: str(r))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_inputs_have_defined_results(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.digest_columns(dc.decontaminate(none, items)).count() == 0
    row = dc.digest_columns(dc.decontaminate(spark.createDataFrame([(1, "a b")], none.schema), items)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    assert row.items_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_proximity_needs_all_words_nearby(spark):
    d = spark.createDataFrame([(1, "c x b y a"), (2, "c x x x x b a"), (3, "a b c"), (4, "a b a")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    kinds = {r.doc_id: {(s.start, s.end, s.kind) for s in r.spans} for r in dc.decontaminate(d, b, slop=2).collect()}
    assert kinds == {1: {(0, 5, "near")}, 2: set(), 3: {(0, 3, "exact")}, 4: set()}


def test_licence_sequences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of it. The above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, express."
    texts = {1: mit, 2: "Licensed under the Apache License, Version 2.0.", 3: None, 4: "", 5: "no rights at all. Software is nice.", 6: "Released under the MIT License.\nAll rights reserved.", 7: "Licensed under CC BY-NC 4.0.\n" * 3}
    got = {r.doc_id: (r.identifiers, r.licenses) for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1] == (["mit-grant", "mit-notice", "mit-asis"], ["MIT"])
    assert got[2][1] == ["Apache-2.0"] and got[3] == got[4] == ([], []) and got[5] == ([], [])
    assert got[6][1] == ["MIT", "AllRightsReserved"] and got[7] == (["cc-by-nc-short"] * 3, ["CC-BY-NC-4.0"])


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products."""


def test_wrapped_licences_keep_their_sentences(spark):
    wrapped = {"gpl": GPL, "mit": MIT, "bsd": BSD}
    for mark in ("# ", " * ", ";; ", "// "):
        wrapped |= {k + mark: "".join(f"{mark}{line}\r\n" for line in wrapped[k].split("\n")) for k in ("gpl", "mit", "bsd")}
    texts = wrapped | {
        "lead": "This project is licensed under the Apache License, Version 2.0.",
        "over": "It is released under the MIT\nLicense, see the file.",
        "not": "It is not licensed under CC BY 4.0.",
        "end": "no mark at the end\nLicensed under CC BY 4.0\nnor here\nAll rights reserved\nend",
        "dashes": "-" * 200_000 + "\n" + " ." * 100_000 + " licence",
    }
    got = {r.doc_id: (r.identifiers, r.licenses) for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert {got[k][1][0] for k in wrapped if k.startswith("gpl")} == {"GPL-3.0"} and got["gpl"][0] == ["gpl-free", "gpl-warranty"]
    assert got["mit"] == (["copyright", "mit-grant", "mit-notice", "mit-asis"], ["MIT"])
    assert got["bsd"] == (["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], ["BSD-3-Clause"])
    assert all(got[k] == got[k[:3]] for k in wrapped)
    assert got["lead"] == (["apache-grant"], ["Apache-2.0"]) and got["over"] == (["mit-name"], ["MIT"]) and got["not"] == ([], [])
    assert got["end"] == (["cc-by-short", "reserved"], ["CC-BY-4.0", "AllRightsReserved"]) and got["dashes"] == ([], [])


def brute_table(shards, slots):
    orders = []
    for s in shards:
        offset, skip = sharding._draw(s, "offset") % slots, sharding._draw(s, "skip") % (slots - 1) + 1
        orders.append([(offset + k * skip) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            if len(owner) < slots:
                owner[next(p for p in order if p not in owner)] = i
    return [owner[k] for k in range(slots)]


def test_lookup_table_and_placement(spark):
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 101)
    assert table == brute_table(names, 101)
    share = [table.count(k) for k in range(7)]
    assert max(share) - min(share) <= 1
    fewer = sharding.lookup_table(names[:-1], 101)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 101 // 3
    d = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (9, None)], "doc_id long, slot string")
    rows = sharding.place(d, names, 101).collect()
    assert len(rows) == 4 and all(r.shard == names[table[r.slot]] for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.place(d.limit(0), names, 101).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0] if rest else ""
    host = host.translate(LOWER)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_more_path_lengths_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_DEPTHS", 2)
    urls = ["http://example.com/en/x", "http://b.net/es/", "http://a.com/", None]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(d, url_filter.rule_table(spark, RULES + [("block", "x.org", "/longer/path/")])).collect()}
    assert got == {k: brute_judge(u) for k, u in enumerate(urls)}


def test_url_rules_like_brute_force(spark):
    urls = [None, "", "x", "http://", "http://a.com", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/en", "http://m.example.com/en/a", "http://notexample.com/en/a", "ftp://b.net/es/?q", "http://b.net?/es/", "http://b.net#/es/", "http://com/", "http://a.com//en/", "a://b://c.com/"]
    d = spark.createDataFrame([(k % 9 if k else None, u, "h") for k, u in enumerate(urls * 2)], "page_id long, url string, host string")
    rows = url_filter.judge(d, url_filter.rule_table(spark, RULES))
    got = sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows.collect())))
    assert got == sorted(str((k % 9 if k else None, *brute_judge(u))) for k, u in enumerate(urls * 2))
    assert url_filter.judge(d.limit(0), url_filter.rule_table(spark, RULES)).count() == 0


def test_bloom_filter_passes_every_key_and_few_others(spark):
    rules = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = url_filter.bloom_blocks(rules)
    table = F.split(F.lit(",".join(map(str, blocks))), ",").cast("array<bigint>")
    passes = lambda df: df.where(url_filter._passes(F.xxhash64("key"), table, len(blocks))).count()
    assert passes(rules) == 4000
    assert passes(spark.range(4000).select(F.concat(F.lit("other"), "id").alias("key"))) < 400


KNOWN = {
    "GPL-2.0": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary.",
    "CC0-1.0": "To the extent possible under law, Ann Person has waived all copyright and related or neighboring rights to this work.",
    "BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "Zlib": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it.",
}


def test_other_licences_and_odd_rows(spark):
    rows = [(k, t, "x") for k, t in KNOWN.items()] + [(None, KNOWN["ISC"], None), ("ISC", KNOWN["ISC"], "y"), ("none", "word " * 300_000, "z")]
    d = spark.createDataFrame(rows, "doc_id string, text string, identifiers string")
    got = [(r.doc_id, tuple(r.licenses)) for r in license_scan.scan(d).collect()]
    assert sorted(got, key=str) == sorted([*[(k, (k,)) for k in KNOWN], (None, ("ISC",)), ("ISC", ("ISC",)), ("none", ())], key=str)
    assert license_scan.scan(d.limit(0)).count() == 0
    own = [("pd", "this work is in the public domain")]
    found = license_scan.scan(spark.createDataFrame([(1, "This work is in the public domain.")], "doc_id long, text string"), own, [(1, "PD", ["pd"])])
    assert found.first().licenses == ["PD"]
