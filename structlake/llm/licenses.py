"""Licences in texts, recognised sentence by sentence.

A text is cut into sentences (line breaks inside one do not count), sentences
are normalised to small letters, digits and single blanks, and known ones get
an identifier.  The identifiers of a text, in order, are held against ordered
rules, each a licence and a sequence of identifiers; a rule that matches takes
its sentences away, so the fuller text of a licence wins over its short notice
and later rules see only what is left.

All of it is column expressions over one row; nothing is shuffled.

Defined cases: null text is the empty text and has no licence; known sentences
that no rule takes are kept in ``unmatched``; repeated rows get equal results;
an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, lower_ascii, whole_text

#: A text without one of these words has no known sentence.
SIGN = r"(?i)licen[cs]e|permission|redistribut|warrant|public domain|creative commons|\bCC[ -]?(0|BY)"
BOUNDARY = r"(?<=[.!?;:])(?<![Ii]dentifier:)\s+|\n\s*\n"

# Known sentences, as patterns over the normalised sentence, in the order they are tried.
SENTENCES = {
    "spdx": r"spdx[ -]license[ -]identifier ([a-z0-9.+-]+)",
    "apache2-basis": r"basis without warranties or conditions of any kind",
    "apache2-copy": r"you may not use this file except in compliance with the license",
    "apache2-obtain": r"you may obtain a copy of the license at",
    "apache2": r"\bapache (software )?license (v|version )?2(\.0)?\b",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy",
    "mit-notice": r"above copyright notice and this permission notice .*shall be included",
    "as-is": r"the software is provided as is without warranty of any kind",
    "mit": r"\b(mit|expat) (style )?licen[cs]e\b",
    "bsd-grant": r"redistribution and use in source and binary forms",
    "bsd-source": r"redistributions of source code must retain",
    "bsd-binary": r"redistributions in binary form must reproduce",
    "bsd-endorse": r"neither the name .* (to endorse or promote|may be used)",
    "bsd-3": r"\b(3-clause|new|modified|revised) bsd licen[cs]e|\bbsd 3-clause",
    "bsd-2": r"\b(2-clause|simplified) bsd licen[cs]e|\bbsd 2-clause",
    "agpl-3": r"\bgnu affero general public license.*\b(v|version )3",
    "lgpl-3": r"\blesser general public license.*\b(v|version )3",
    "lgpl-2.1": r"\blesser general public license.*\b(v|version )2\.1",
    "gpl-3-later": r"\bgeneral public license.*\b(v|version )3.*any later version",
    "gpl-2-later": r"\bgeneral public license.*\b(v|version )2.*any later version",
    "gpl-3": r"\bgeneral public license.*\b(v|version )3",
    "gpl-2": r"\bgeneral public license.*\b(v|version )2",
    "gpl-terms": r"under the terms of the gnu general public license",
    "either-3-later": r"version 3 of the license or at your option any later version",
    "either-2-later": r"version 2 of the license or at your option any later version",
    "mpl-2": r"\bmozilla public license (v|v\. |version )?2(\.0)?",
    "unlicense": r"free and unencumbered software released into the public domain",
    "cc0": r"\bcc[ -]?0\b|\bcreative commons zero",
    "cc": r"\bcc[ -](by(?:-nc)?(?:-sa|-nd)?)[ -]([1-4]\.[0-9])",
}
# Licences and the identifiers that make them, in the order they are tried.
RULES = [
    ("Apache-2.0", ["apache2", "apache2-copy", "apache2-obtain", "apache2-basis"]), ("Apache-2.0", ["apache2"]),
    ("MIT", ["mit", "mit-grant", "mit-notice", "as-is"]), ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]), ("MIT", ["mit"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-3"]), ("BSD-2-Clause", ["bsd-2"]),
    ("GPL-3.0-or-later", ["gpl-terms", "either-3-later"]), ("GPL-2.0-or-later", ["gpl-terms", "either-2-later"]),
    ("GPL-3.0-or-later", ["gpl-3-later"]), ("GPL-2.0-or-later", ["gpl-2-later"]),
    ("AGPL-3.0", ["agpl-3"]), ("LGPL-3.0", ["lgpl-3"]), ("LGPL-2.1", ["lgpl-2.1"]), ("GPL-3.0", ["gpl-3"]), ("GPL-2.0", ["gpl-2"]),
    ("MPL-2.0", ["mpl-2"]), ("Unlicense", ["unlicense"]), ("CC0-1.0", ["cc0"]),
    *((f"CC-{kind.upper()}-{version}", [f"cc-{kind}-{version}"])
      for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for version in ("1.0", "2.0", "2.5", "3.0", "4.0")),
]


def normalised(sentence: Column) -> Column:
    """Small letters, digits, ``.+-`` inside words, single blanks."""
    bare = F.regexp_replace(lower_ascii(sentence), r"[^a-z0-9.+-]+", " ")
    return F.btrim(bare, F.lit(" .-"))


def identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence, null if it is not known."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES.items()):
        value = F.lit(name)
        if name == "spdx":
            value = F.concat(F.lit("spdx-"), F.regexp_extract(sentence, pattern, 1))
        elif name == "cc":
            value = F.concat_ws("-", F.lit("cc"), F.regexp_extract(sentence, pattern, 1), F.regexp_extract(sentence, pattern, 2))
        found = F.when(sentence.rlike(pattern), value).otherwise(found)
    return found


def known_sentences(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    text = whole_text(text)
    found = F.filter(F.transform(F.split(text, BOUNDARY), lambda s: let(normalised(s), identifier)),
                     lambda x: x.isNotNull())
    return F.when(text.rlike(SIGN), found).otherwise(F.array().cast("array<string>"))


def matched(ids: Column) -> Column:
    """(licenses, unmatched) of a sequence of identifiers, by the ordered rules.

    The sequence is one string of identifiers between bars, so that a rule is a
    search for its own string.  A bar stands on either side of each identifier.
    """
    def joined(names: list[str]) -> str:
        return "".join(f"|{n}|" for n in names)

    rules = F.array(*(F.struct(F.lit(licence).alias("licence"), F.lit(joined(names)).alias("names")) for licence, names in RULES))
    start = F.struct(
        F.array_join(F.transform(ids, lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "").alias("rest"),
        F.array().cast("array<string>").alias("licenses"))

    def take(acc: Column, rule: Column) -> Column:
        return F.when(F.contains(acc["rest"], rule["names"]), F.struct(
            F.replace(acc["rest"], rule["names"], F.lit("#")).alias("rest"),
            F.array_union(acc["licenses"], F.array(rule["licence"])).alias("licenses"))).otherwise(acc)

    def finish(acc: Column) -> Column:
        left = F.regexp_extract_all(acc["rest"], F.lit(r"\|([^|]+)\|"), F.lit(1))
        spdx = F.transform(F.filter(left, lambda x: F.startswith(x, F.lit("spdx-"))), lambda x: F.substring(x, 6, 200))
        return F.struct(F.array_union(acc["licenses"], spdx).alias("licenses"),
                        F.filter(left, lambda x: ~F.startswith(x, F.lit("spdx-"))).alias("unmatched"))

    empty = F.struct(F.array().cast("array<string>").alias("licenses"), F.array().cast("array<string>").alias("unmatched"))
    return F.when(F.size(ids) == 0, empty).otherwise(F.aggregate(rules, start, take, finish))


def find_licenses(docs: DataFrame, into: str = "licences") -> DataFrame:
    """``docs`` with a struct column: ``sentences``, ``licenses``, ``unmatched``."""
    def whole(ids: Column) -> Column:
        return let(matched(ids), lambda m: F.struct(
            ids.alias("sentences"), m["licenses"].alias("licenses"), m["unmatched"].alias("unmatched")))
    return docs.select("*", let(known_sentences(F.col("text")), whole).alias(into))


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: its licences by rule, and the known sentences, comma-joined."""
    found = find_licenses(docs.select("doc_id", "text"), "f")
    return found.select(
        "doc_id", F.size("f.licenses").cast("bigint").alias("n_licenses"), F.array_join("f.licenses", ",").alias("licenses"),
        F.array_join("f.sentences", ",").alias("sentences"), F.array_join("f.unmatched", ",").alias("unmatched"))
