"""Sentence-rule licence recognition, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, normalised, with our identifier for each. '*' stands for any words.
SENTENCES = [
    ("spdx-apache-2.0", "spdx license identifier apache 2 0"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-bsd-3", "spdx license identifier bsd 3 clause"),
    ("spdx-gpl-3", "spdx license identifier gpl 3 0 *"),
    ("spdx-cc-by-4", "spdx license identifier cc by 4 0"),
    ("apache-grant", "licensed under the apache license version 2 0 *"),
    ("apache-copy", "you may obtain a copy of the license at *"),
    ("apache-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis *"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy *"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies *"),
    ("mit-asis", "the software is provided as is without warranty of any kind *"),
    ("mit-name", "released under the mit license"),
    ("mit-name", "licensed under the mit license"),
    ("mit-name", "distributed under the mit license"),
    ("bsd-grant", "redistribution and use in source and binary forms *"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice *"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice *"),
    ("bsd-endorse", "neither the name of * may be used to endorse *"),
    ("gpl-2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license *"),
    ("gpl-2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 *"),
    ("gpl-2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license *"),
    ("gpl-1-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1 *"),
    ("gpl-1-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 1 of the license *"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license *"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license *"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 *"),
    ("lgpl-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license *"),
    ("lgpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license *"),
    ("agpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license *"),
    ("lgpl-warranty", "this library is distributed in the hope that it will be useful *"),
    ("gpl-any-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license *"),
    ("gpl-version", "* gnu general public license version 3 *"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful *"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license *"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file you can obtain one at *"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted *"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted *"),
    ("isc-asis", "the software is provided as is and the author disclaims all warranties *"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "anyone is free to copy modify publish use compile sell or distribute this software *"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications *"),
    ("boost-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license *"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license *"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement *"),
    ("cc0", "to the extent possible under law * has waived all copyright and related or neighboring rights to *"),
    ("spdx-bsd-2", "spdx license identifier bsd 2 clause"),
    ("spdx-gpl-2", "spdx license identifier gpl 2 0 *"),
    ("spdx-lgpl", "spdx license identifier lgpl *"),
    ("spdx-agpl-3", "spdx license identifier agpl 3 0 *"),
    ("spdx-mpl-2", "spdx license identifier mpl 2 0"),
    ("spdx-isc", "spdx license identifier isc"),
    ("spdx-unlicense", "spdx license identifier unlicense"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-short", "licensed under cc by 4 0"),
    ("cc-by-nc-short", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa-short", "licensed under cc by sa 4 0"),
    ("spdx-bsl-1", "spdx license identifier bsl 1 0"),
    ("reserved", "all rights reserved"),
    ("reserved", "* all rights reserved"),
    ("copyright", "copyright *"),
]

# Ordered rules; the identifiers must follow each other in this order, others of the same licence text between.
RULES = [
    (0, "BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    (1, "Apache-2.0", ["apache-grant", "apache-copy", "apache-asis"]),
    (2, "MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    (3, "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    (4, "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    (5, "GPL-3.0", ["gpl-free", "gpl-warranty"]),
    (6, "Apache-2.0", ["apache-grant"]),
    (7, "MIT", ["mit-grant"]),
    (8, "BSD", ["bsd-grant"]),
    (9, "GPL-3.0", ["gpl-free"]),
    (10, "GPL-3.0", ["gpl-version"]),
    (11, "CC-BY-4.0", ["cc-by"]),
    (12, "CC-BY-4.0", ["cc-by-short"]),
    (13, "MIT", ["mit-name"]),
    (14, "Apache-2.0", ["spdx-apache-2.0"]),
    (15, "MIT", ["spdx-mit"]),
    (16, "BSD-3-Clause", ["spdx-bsd-3"]),
    (17, "GPL-3.0", ["spdx-gpl-3"]),
    (18, "CC-BY-4.0", ["spdx-cc-by-4"]),
    (19, "CC-BY-NC-4.0", ["cc-by-nc-short"]),
    (20, "AllRightsReserved", ["reserved"]),
    (21, "GPL-2.0", ["gpl-2-free", "gpl-warranty"]),
    (22, "GPL-2.0", ["gpl-2-free"]),
    (23, "LGPL", ["lgpl-free", "lgpl-warranty"]),
    (24, "LGPL", ["lgpl-free"]),
    (25, "AGPL-3.0", ["agpl-free"]),
    (26, "MPL-2.0", ["mpl-2", "mpl-copy"]),
    (27, "MPL-2.0", ["mpl-2"]),
    (28, "ISC", ["isc-grant", "isc-asis"]),
    (29, "ISC", ["isc-grant"]),
    (30, "Unlicense", ["unlicense-free"]),
    (31, "Zlib", ["zlib-grant"]),
    (32, "BSL-1.0", ["boost-grant"]),
    (33, "EPL", ["epl-2"]),
    (34, "CC0-1.0", ["cc0"]),
    (35, "BSD-2-Clause", ["spdx-bsd-2"]),
    (36, "GPL-2.0", ["spdx-gpl-2"]),
    (37, "LGPL", ["spdx-lgpl"]),
    (38, "AGPL-3.0", ["spdx-agpl-3"]),
    (39, "MPL-2.0", ["spdx-mpl-2"]),
    (40, "ISC", ["spdx-isc"]),
    (41, "Unlicense", ["spdx-unlicense"]),
    (42, "GPL-1.0", ["gpl-1-free", "gpl-warranty"]),
    (43, "GPL-1.0", ["gpl-1-free"]),
    (44, "GPL", ["gpl-any-free", "gpl-warranty"]),
    (45, "GPL", ["gpl-any-free"]),
    (46, "CC-BY-SA-4.0", ["cc-by-sa"]),
    (47, "CC-BY-SA-4.0", ["cc-by-sa-short"]),
    (48, "BSL-1.0", ["spdx-bsl-1"]),
]

# Grants of one sentence, which may have other words before and after them, but no "not" before.
GRANTS = {"apache-grant", "mit-name", "cc-by", "cc-by-short", "cc-by-nc-short", "cc-by-sa", "cc-by-sa-short"}

#: Of the SQL, which knows a licence sentence only where it has a line to itself: what ends its lines and sentences.
BREAK = r"[\n\r]+|[.!?][ \t\n\r]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between sentences of a normalised text; its words have a blank between them, or a line break.
END = "\x01"


def hint(sentences: list[tuple[str, str]]) -> str:
    """Matches every text that has one of the sentences: the longest word of each."""
    return "|".join(sorted({max(text.split(), key=len) for _, text in sentences}))


def normalised(text: F.Column) -> F.Column:
    """A-Z lower-cased, anything but letters, digits and non-ASCII made one mark between words.

    It is END after a mark [.!?] before white space and at blank lines, else a line break where there was one, else a
    blank. What stands before a line's first word, such as a comment's marker, counts as white space.
    """
    out = F.regexp_replace(F.translate(text, UPPER + END, LOWER + " "), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(^|\n)[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", "$1")
    out = F.regexp_replace(out, r"[.!?](?=[ \t\n])|\n{2,}", END)
    out = F.regexp_replace(out, r"[\x00\x02-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \n]*\x01[ \n\x01]*", END), r" ?\n ?", "\n"))


def core(known: str) -> str:
    """A known sentence without the wild cards at its ends."""
    return known.removeprefix("* ").removesuffix(" *")


def sentence_pattern(known: str) -> str:
    """Regular expression of a known sentence with wild cards, of the SQL."""
    return "^" + known.replace("* ", "(.* )?").replace(" *", "( .*)?") + "$"


def place_pattern(name: str, known: str) -> str:
    """Matches the core of a known sentence in a normalised text, over single line breaks.

    It begins and ends where a line or a sentence does, or at any word on the side that has a wild card.
    """
    start = r"(?<!(?<![^ \n\x01])not[ \n])" if name in GRANTS else "" if known.startswith("* ") else r"(?<![^\n\x01])"
    end = r"(?![^ \n\x01])" if name in GRANTS or known.endswith(" *") else r"(?![^\n\x01])"
    return start + core(known).replace(" * ", r" (?:[^\x01]*?[ \n])?").replace(" ", r"[ \n]").replace(r"[[ \n]\n]", r"[ \n]") + end


def identify(text: F.Column, sentences: list[tuple[str, str]] = SENTENCES) -> F.Column:
    """Identifiers of the known sentences in a normalised text, in the text's order; where several begin, the exact ones are tried first."""
    ordered = sorted(sentences, key=lambda x: "*" in x[1])
    places = F.regexp_extract_all(text, F.lit(r"(?<![^ \n\x01])(?:" + "|".join(place_pattern(n, t) for n, t in ordered) + ")"), F.lit(0))
    names: dict[str, str] = {}
    for name, known in ordered:
        if "*" not in core(known):
            names.setdefault(core(known), name)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None

    def named(place: F.Column) -> F.Column:
        plain = F.translate(place, "\n", " ")
        found = F.try_element_at(table, plain) if names else F.lit(None).cast("string")
        for name, known in ordered:
            if "*" in core(known):
                found = F.coalesce(found, F.when(plain.rlike("^" + core(known).replace("* ", "(.* )?") + "$"), name))
        return found

    return F.transform(places, named)


def rule_pattern(identifiers: list[str]) -> str:
    """Matches ',a,b,c,' lists in which the identifiers follow each other, others between."""
    return "," + ",((?:[^,]+,)*?)".join(i.replace(".", r"\.") for i in identifiers) + ","


def rule_rest(identifiers: list[str]) -> str:
    return "," + "".join(f"${k}" for k in range(1, len(identifiers)))


def scan(docs: DataFrame, sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[int, str, list[str]]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, identifiers (of its licence sentences, in order) and licenses (distinct, in the rules' order).

    A sentence may be wrapped over lines, and stand in a comment; blank lines and sentence marks end it, and where a line
    begins or ends a known sentence may too. Several in a row are several identifiers.

    Rules are tried in order; a rule whose identifiers occur in its order uses them up and names its licence. The tables
    of sentences and rules are parameters of fixed size and part of the plan; no row leaves its task, so nothing is
    shuffled and no licence line that many rows share makes a hot group. Null and empty texts have empty lists; ids may be
    null or repeat; other columns are not read; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Most texts have none of the words; others are read whole.
    found = F.when(text.rlike("(?i)" + hint(sentences)), identify(normalised(text), sentences)).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col(id_col).alias("doc_id"), found.alias("identifiers"))
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(rule_pattern(ids)).alias("pattern"), F.lit(rule_rest(ids)).alias("rest")) for _, name, ids in sorted(rules)])
    start = F.struct(F.concat(F.lit(","), F.array_join("identifiers", ","), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("names"))
    step = lambda a, r: F.when(F.regexp_like(a.left, r.pattern), F.struct(F.regexp_replace(a.left, r.pattern, r.rest).alias("left"), F.array_append(a.names, r.license).alias("names"))).otherwise(a)
    # Most rows have no licence sentence and do not walk the rules.
    licenses = F.when(F.size("identifiers") > 0, F.array_distinct(F.aggregate(table, start, step, lambda a: a.names))).otherwise(F.array().cast("array<string>"))
    return out.select("doc_id", "identifiers", licenses.alias("licenses"))


def oracle_sql() -> str:
    """The query op2_license_scan in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {'s = ' + quote(t) if '*' not in t else f'regexp_matches(s, {quote(sentence_pattern(t))})'} THEN {quote(n)}" for n, t in sorted(SENTENCES, key=lambda x: "*" in x[1]))
    norm = r"trim(regexp_replace(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ')"
    sql = f"""WITH parts AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), {quote(BREAK)}), lambda p: regexp_matches(p, '(?i){hint(SENTENCES)}'))) AS p,
      generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), {quote(BREAK)}), lambda p: regexp_matches(p, '(?i){hint(SENTENCES)}')), 1) AS k FROM documents),
    named AS (SELECT doc_id, k, CASE {cases} END AS i FROM (SELECT doc_id, k, {norm} AS s FROM parts) WHERE regexp_matches(s, '{hint(SENTENCES)}')),
    lists AS (SELECT doc_id, string_agg(i, ',' ORDER BY k) AS ids FROM named WHERE i IS NOT NULL GROUP BY doc_id),
    s0 AS (SELECT doc_id, ids, ',' || ids || ',' AS l, []::VARCHAR[] AS n FROM lists)"""
    for k, (_, name, ids) in enumerate(sorted(RULES)):
        rest = rule_rest(ids).replace("$", "\\")
        sql += f", s{k + 1} AS (SELECT doc_id, ids, CASE WHEN regexp_matches(l, {quote(rule_pattern(ids))}) THEN regexp_replace(l, {quote(rule_pattern(ids))}, {quote(rest)}, 'g') ELSE l END AS l, CASE WHEN regexp_matches(l, {quote(rule_pattern(ids))}) AND NOT list_contains(n, {quote(name)}) THEN list_append(n, {quote(name)}) ELSE n END AS n FROM s{k})"
    return sql + f" SELECT d.doc_id, coalesce(ids, '') AS identifiers, coalesce(array_to_string(n, ','), '') AS licenses FROM documents d LEFT JOIN s{len(RULES)} USING (doc_id)"
