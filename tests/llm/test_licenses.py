"""Licence scans: whole licence texts, notices, wrapped lines, and odd rows; a plain version over the same tables of rules."""

import collections
import re

from structlake.llm import licenses

from .conftest import SCHEMA

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software. The above copyright notice and this permission notice
shall be included in all copies. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD2 = """Redistribution and use in source and binary forms are permitted provided that: Redistributions of source
code must retain the notice. Redistributions in binary form must reproduce the notice."""
CASES = {
    "one\nLicensed under the Apache License, Version 2.0.\ntwo": "Apache-2.0",
    "Licensed under CC BY-NC 4.0. Released under the MIT License.": "MIT,CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "under the terms of the GNU General Public License as published; either version 3 of the License, or (at your option) any later version.": "GPL-3.0-or-later",
    MIT: "MIT", BSD2: "BSD-2-Clause", BSD2 + " Neither the name of X may be used to endorse or promote products.": "BSD-3-Clause",
    "// SPDX-License-Identifier: ISC\nint x;": "isc", "no stop here\nReleased under the MIT License\nnor here": "MIT",
    "A driving license is a permission, without warranty. It was submitted under protest.": "", "": "",
}


def plain(text):
    """The same rules in straight Python."""
    ids = []
    for part in re.split(licenses.BOUNDARY, text or ""):
        low = re.sub(r"[^a-z0-9.+-]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), part)).strip(" .-")
        for name, pattern in licenses.SENTENCES.items():
            if m := re.search(pattern, low):
                ids.append(f"spdx-{m[1]}" if name == "spdx" else f"cc-{m[1]}-{m[2]}" if name == "cc" else name)
                break
    rest, found = list(ids), []
    for licence, names in licenses.RULES:
        k = 0
        while k + len(names) <= len(rest):
            if rest[k:k + len(names)] == names:
                rest[k:k + len(names)] = ["#"]
                found += [licence] * (licence not in found)
            k += 1
    found += [x[5:] for x in rest if x.startswith("spdx-")]
    return ",".join(found), ",".join(ids)


def test_licences(spark, odd_rows, empty_docs):
    rows = odd_rows + [(500 + k, t, None, None, None) for k, t in enumerate(CASES)] + [(600, "\n\n".join([MIT, BSD2] * 300), None, None, None)]
    got = licenses.license_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.licenses, r.sentences) for r in got) == collections.Counter((r[0], *plain(r[1])) for r in rows)
    named = {r.doc_id: r.licenses for r in got}
    assert {t: named[500 + k] for k, t in enumerate(CASES)} == CASES
    assert named[600] == "MIT,BSD-2-Clause"
    assert licenses.license_report(empty_docs).count() == 0
