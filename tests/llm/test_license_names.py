"""Versions are those of the sentence's own words."""

from tessera.llm import license_scan

HEAD = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
WARRANTY = "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."
TEXTS = {
    f"{HEAD} as published by the Free Software Foundation; version 2 of the License.{WARRANTY}": ["GPL-2.0"],
    f"{HEAD} as published by the Free Software Foundation; either version 2 of the License, or later.{WARRANTY}": ["GPL-2.0"],
    f"{HEAD} as published by the Free Software Foundation; either version 1, or (at your option) any later version.{WARRANTY}": ["GPL-1.0"],
    f"{HEAD} as published by the Free Software Foundation, either version 3 of the License.{WARRANTY}": ["GPL-3.0"],
    f"{HEAD} version 3 only.": ["GPL-3.0"],
    f"{HEAD} as published by the Free Software Foundation.{WARRANTY}": ["GPL"],
    f"{HEAD}.": ["GPL"],
    "Licensed under the MIT License.": ["MIT"],
    "// SPDX-License-Identifier: BSL-1.0": ["BSL-1.0"],
    "Text is licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
    "It is not licensed under the MIT license.": [],
}


def test_names(spark):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r.licenses for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[k] for k, t in rows} == TEXTS
