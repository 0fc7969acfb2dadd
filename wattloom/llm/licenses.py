"""Licence scan: canonical texts are looked up by digest among known licences.

The canonical form follows the public matching guidelines for licence lists: case, punctuation, white
space, comment marks, copyright lines and equivalent spellings don't count. A whole text is hash-joined by the
SHA-256 of its canonical form without replaceable names, list marks and title; known are the short licences below and
the long ones in ``licence_texts``. For notices inside other texts, lines that mention a licence, their
sentences and sentences over several lines are looked up: as a known notice, as an SPDX expression, as the usual head of
a source file under a GNU licence, as a title, or as a name of a licence after words like "released under". All steps are column expressions.

Defined results: a null or empty text, or one without any word, has the canonical form "" and no licence;
repeated rows are judged alike; a text that matches several licences has all their names, in order; a long text is scanned in
whole; other columns, of whatever name, are ignored; an empty table gives no rows.
"""

from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wording of public licences and notices, in their usual form.
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software.\n\n")
_MIT_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
    "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
    "THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
    "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
    "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.\n\n")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.")
LICENCES = {
    "MIT": "MIT License\n\n" + _PERMISSION + _MIT_END,
    "MIT (without title)": _PERMISSION + _MIT_END,
    "ISC": ("ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies.\n\n" + _ISC_END),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
             "fee is hereby granted.\n\n" + _ISC_END),
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_THIRD + _BSD_END,
}
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause"],
}
#: Names of licences as notices give them, in canonical form.
NAMES = {
    "MIT": ["mit license", "mit", "expat license"],
    "ISC": ["isc license", "isc"],
    "0BSD": ["0bsd", "zero clause bsd license", "bsd zero clause license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "bsd 3 clause"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0",
                   "apache license v2 0", "apache license version 2 0 the license"],
    "GPL-1.0": ["gnu general public license version 1", "gpl 1 0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2",
                "gnu gpl v2", "gplv2", "gpl version 2", "gpl 2 0", "gpl v2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3",
                "gnu gpl v3", "gplv3", "gpl version 3", "gpl 3 0", "gpl v3", "gnu general public license v3 0"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license v3", "agpl version 3",
                 "agplv3", "agpl 3 0"],
    "LGPL-2.0": ["gnu library general public license version 2", "lgpl 2 0"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1",
                 "lgpl version 2 1", "lgplv2 1", "lgpl 2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license v3",
                 "lgpl version 3", "lgplv3", "lgpl 3 0"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0",
                "mpl 2 0"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "GFDL-1.2": ["gnu free documentation license version 1 2", "gfdl 1 2"],
    "GFDL-1.3": ["gnu free documentation license version 1 3", "gfdl 1 3"],
    "Artistic-1.0-Perl": ["artistic license", "artistic 1 0 perl"],
}
#: What stands before the name in a notice, in canonical form.
_NAMING = (
    r"^(?:(?:this|the|all|our|these) (?:\S+ ){0,3}?(?:is|are) )?(?:(?:hereby|also|free software) )?"
    r"(?:(?:made )?available|released|licensed|distributed|published|provided|covered) (?:under|by|subject to) "
    r"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?(.+?)(?: or \S+ (?:your|its) option.*| or (?:any )?later.*)?$")
_SPDX_EXPRESSION = r"^spdx license identifier (.+)$"
#: The usual head of a source file under one of the GNU licences, in canonical form.
_HEADER = (r"redistribute it and or modify it under the terms of (?:version (\d+(?: \d)?) of )?the "
           r"(gnu (?:lesser |library |affero )?general public license)"
           r"(?: as published by the free software foundation)?(?: either)?(?: version (\d+(?: \d)?))?\b")
#: Semicolons inside that head, which end no sentence.
_HEADER_STOP = r"(?i)\b(software|foundation);"
#: What joins the names of an SPDX expression, in canonical form.
_SPDX_JOINS = r" (?:or|and|with) "
#: What differs between copies of one licence: titles, list marks and names, over canonical words.
REPLACEABLE = [
    (r"^(?:the )?(?:mit|isc|(?:new |simplified )?bsd(?: [23] clause)?|[23] clause bsd) license(?: mit)? ", ""),
    (r"\b(?:[123abc]|i{1,3}) (redistributions (?:of|in)|neither the name)", "$1"),
    (r"\bneither the names? of (?:\S+ ){1,24}?nor the names? of (?:\S+ ){1,6}?may be used",
     "neither the name of holder nor the names of its contributors may be used"),
    (r"\bprovided by (?:\S+ ){1,24}?as is and any express", "provided by holder as is and any express"),
    (r"\bprovided as is and (?:\S+ ){1,24}?disclaims? all", "provided as is and holder disclaims all"),
    (r"\bin no event shall (?:\S+ ){1,24}?be liable", "in no event shall holder be liable"),
]
#: Where sentences end, lines or not.
SENTENCE_END = r"(?<=[.!?;])\s+|\n[ \t\r]*\n"
#: Spellings that count as equal, as (pattern over lower-case words, what stands for them).
EQUIVALENT = [
    (r"\bsub[ -]licen[cs]e", "sublicense"),
    (r"licence", "license"),
    (r"\backnowledgment", "acknowledgement"),
    (r"\bfulfil\b", "fulfill"),
    (r"\bnon[ -]commercial", "noncommercial"),
    (r"\bnon[ -]infringement", "noninfringement"),
    (r"\bpercent\b", "per cent"),
    (r"\bwhile\b", "whilst"),
    (r"\bhttps?:", "http:"),
    (r"©|\(c\)", "copyright"),
    (r" & ", " and "),
]
#: A line that only says whose the copyright is, also behind comment marks.
COPYRIGHT_LINE = r"(?md)^[ \t]*(?:(?://|/\*|\*|#|--|;)[ \t]*)?(?:copyright|©|\(c\)|all rights reserved)(?: .*)?$"
#: What a line must mention to be looked up as a notice.
MENTIONS = r"licen[cs]e"


def canonical(text: Column) -> Column:
    """Lower-case words with single blanks between, without what licence matching ignores."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    for pattern, same in EQUIVALENT:
        out = F.regexp_replace(out, pattern, same)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def canonical_digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def without_names(words: Column) -> Column:
    """Canonical words without titles, list marks and names that differ between copies of a licence."""
    out = words
    for pattern, same in REPLACEABLE:
        out = F.regexp_replace(out, pattern, same)
    return F.when(words.contains("as is"), out).otherwise(words)


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the long licences, also without what follows their terms."""
    rows = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, after = text.partition("END OF TERMS AND CONDITIONS")
        rows += [(path.stem, text)] + ([(path.stem, terms), (path.stem, terms + end)] if after else [])
    return rows


def named_licenses(words: Column, names: Column) -> Column:
    """The licences that a canonical sentence names, as an array: by the words around a name, as an SPDX expression, in
    the usual head of a source file, or as a title that is nothing but the name."""
    one = lambda pattern, group: F.regexp_extract(words, pattern, group)
    version = F.concat(one(_HEADER, 1), one(_HEADER, 3))
    header = F.concat_ws(" version ", one(_HEADER, 2), F.regexp_replace(version, " 0$", ""))
    given = F.concat(F.array(one(_NAMING, 1), F.regexp_replace(words, "^the ", ""), header),
                     F.split(one(_SPDX_EXPRESSION, 1), _SPDX_JOINS))
    found = F.transform(given, lambda x: F.try_element_at(names, F.regexp_replace(x, " (?:only|or later)$", "")))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def known_digests(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    """(digest, license_id) of known texts; ids of one digest are joined in order."""
    rows = [(name.split(" (")[0], text) for name, all_of in texts.items() for text in all_of]
    named = spark.createDataFrame(rows, "license_id string, text string")
    return named.groupBy(canonical_digest(F.col("text")).alias("digest")).agg(
        F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("license_id"))


def scan_licenses(documents: DataFrame, doc: str = "doc_id", text: str = "text",
                  licences: dict[str, list[str]] | None = None,
                  notices: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, canonical_digest, license_id (of the whole text, else null), notices, n_notice_lines.

    ``notices`` has the sorted distinct licences that lines of the text name, joined by commas. The two
    dictionaries are parameters of fixed size, in place of all that is known here, so the whole-text join is
    broadcast when Spark's own size limit allows, and line lookups use a literal map. A sentence over several
    lines counts as one line, unless one of them was found by itself.
    """
    spark = documents.sparkSession
    texts = [(n.split(" (")[0], t) for n, ts in (licences or {k: [v] for k, v in LICENCES.items()}).items() for t in ts]
    whole = spark.createDataFrame(texts + ([] if licences else full_texts()), "license_id string, text string").groupBy(
        F.sha2(without_names(canonical(F.col("text"))), 256).alias("digest")).agg(
        F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("license_id"))
    lines_of = known_digests(spark, notices or NOTICES).collect()
    by_line = F.create_map(*[F.lit(x) for x in chain.from_iterable((r.digest, r.license_id) for r in lines_of)])
    known = {} if notices else {words: name for name, all_of in NAMES.items() for words in all_of}
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable({"": None, **known}.items())]).cast("map<string,string>")
    lean = documents.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    mentions = lambda x: F.lower(x).rlike(MENTIONS)

    def licences_of(passage: Column, parts: Column) -> Column:
        """What a passage or one of its parts names, as a sorted set."""
        known = lambda x: F.try_element_at(by_line, canonical_digest(x))
        each = F.transform(F.array_distinct(F.concat(F.array(passage), parts)), lambda x: F.when(
            known(x).isNotNull(), F.array(known(x))).otherwise(named_licenses(canonical(x), names)))
        return F.array_sort(F.array_distinct(F.flatten(each)))

    lines = F.filter(F.split("body", "\n"), mentions)
    joined = F.regexp_replace("body", _HEADER_STOP, "$1,")
    wrapped = F.filter(F.split(joined, SENTENCE_END), lambda x: x.contains("\n") & mentions(x))
    nothing = F.array().cast("array<array<string>>")
    alone = F.array().cast("array<string>")

    def of_wrapped(passage: Column) -> Column:
        """What a passage over several lines names, if none of its lines was found by itself."""
        by_line = F.exists(F.filter(F.split(passage, "\n"), mentions), lambda x: F.size(licences_of(x, alone)) > 0)
        return F.when(by_line, alone).otherwise(licences_of(passage, alone))

    found = F.when(mentions(F.col("body")), F.concat(
        F.transform(lines, lambda x: licences_of(x, F.split(x, SENTENCE_END))),
        F.transform(wrapped, of_wrapped))).otherwise(nothing)
    scanned = lean.select(
        "doc_id", canonical(F.col("body")).alias("words"),
        F.filter(found, lambda x: F.size(x) > 0).alias("found"))
    digests = scanned.select("doc_id", "found", F.sha2("words", 256).alias("canonical_digest"),
                             F.sha2(without_names(F.col("words")), 256).alias("digest"))
    joined = digests.join(whole, "digest", "left")
    return joined.select(
        "doc_id", "canonical_digest", "license_id",
        F.array_join(F.array_sort(F.array_distinct(F.flatten("found"))), ",").alias("notices"),
        F.size("found").cast("long").alias("n_notice_lines"))
