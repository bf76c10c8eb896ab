"""Licence recognition by sentence rules.

Known licence sentences are looked for between the cuts of a normalised text.
What remains of a text is a row of sentence identifiers; licence rules are
ordered rows of identifiers that must follow each other in it.

Only built-in functions, row by row: nothing is shuffled, and a text of any
number of sentences stays one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licences and notices, by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-details": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-no-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.",
    "as-is-full": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "no-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}

# Rules in order of preference. Identifiers must follow each other
# among the recognised sentences of a text.
RULES = [
    ("MIT-full", "MIT", ["mit-title", "mit-grant", "mit-keep"]),
    ("MIT-text", "MIT", ["mit-grant", "mit-keep"]),
    ("MIT-notice", "MIT", ["mit-notice"]),
    ("Apache-header", "Apache-2.0", ["apache-header", "apache-use"]),
    ("Apache-notice", "Apache-2.0", ["apache-notice"]),
    ("GPL-header", "GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-notice", "GPL-3.0-only", ["gpl3-notice"]),
    ("BSD-3-text", "BSD-3-Clause", ["bsd-redistribution", "bsd-no-endorse"]),
    ("BSD-2-text", "BSD-2-Clause", ["bsd-redistribution"]),
    ("CC-BY-NC-notice", "CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-notice", "CC-BY-4.0", ["cc-by-notice"]),
]


# A sentence begins and ends at cuts. It has no cut inside, but may have places where
# another sentence could begin: whether a line was wrapped there only the sentence tells.
_CUT, _MAYBE = "\x01", "\x02"


def marked(text: Column) -> Column:
    """The normalised text between cuts: lower case, each run of characters other than
    letters and digits one space. Cuts are behind ``.``, ``!`` or ``?`` and a blank and at
    an empty line; possible ones behind ``;`` and a blank, and at a line end before a
    capital or what marks a comment. Other line ends are blanks."""
    cut = F.translate(text, _MAYBE, " ")
    cut = F.regexp_replace(cut, r"([.!?])[ \t\r\n]+", f"$1{_CUT}")
    cut = F.regexp_replace(cut, r"\n[ \t\r]*\n", _CUT)
    cut = F.regexp_replace(cut, r"\n(?=[ \t]*(?:[#*/;%-]+[ \t]*)?\p{Lu})|;[ \t\r\n]+", _MAYBE)
    cut = F.concat(F.lit(_CUT), cut, F.lit(_CUT))
    return F.regexp_replace(F.lower(cut), rf"[^\p{{L}}\p{{N}}{_CUT}{_MAYBE}]+", " ")


def known_sentences(text: Column, known: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in its order."""
    name_of = {normal_form(sentence): name for name, sentence in known.items()}
    # of sentences that begin alike the longest is looked for first
    forms = sorted(name_of, key=lambda x: (-len(x), x))
    any_of = "|".join(x.replace(" ", f"[ {_MAYBE}]+") for x in forms)
    edge = f"[{_CUT}{_MAYBE}]"
    found = F.regexp_extract_all(marked(text), F.lit(f"(?<={edge}) ?({any_of}) ?(?={edge})"), 1)
    names = F.create_map(*(F.lit(x) for pair in name_of.items() for x in pair))
    return F.transform(found, lambda s: F.try_element_at(names, F.regexp_replace(s, f"[ {_MAYBE}]+", " ")))


def normal_form(sentence: str) -> str:
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip()


def scan_licenses(
    docs: DataFrame,
    known: dict[str, str] | None = None,
    rules: list[tuple[str, str, list[str]]] | None = None,
) -> DataFrame:
    """``doc_id, sentence_ids, rules, licenses`` for each row of ``docs(doc_id, text)``
    that holds a known sentence.

    ``sentence_ids`` are the recognised identifiers in text order. ``rules`` are
    the names of the rules whose identifiers follow each other in it, without
    those that are part of a preferred matching rule; ``licenses`` are their
    licences without doubles. All are joined by commas and may be empty.

    A null text holds nothing. Rows with equal or null ids stay rows of their
    own. Other columns are ignored; an empty table gives an empty table.
    """
    known, rules = known or SENTENCES, rules or RULES
    found = docs.select(F.col("doc_id").cast("long"), known_sentences(F.col("text"), known).alias("ids"))
    # the arrays are small from here on
    found = found.where(F.size("ids") > 0)
    row = F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))
    offered = F.array(
        *(
            F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("licence"), F.lit(f"|{'|'.join(steps)}|").alias("steps"))
            for name, licence, steps in rules
        )
    )
    found = found.withColumn("matched", F.filter(offered, lambda r: F.contains(row, r["steps"])))
    inside = lambda r, i: F.exists(
        F.slice("matched", 1, i), lambda earlier: F.contains(earlier["steps"], r["steps"])
    )
    found = found.withColumn("matched", F.filter("matched", lambda r, i: ~inside(r, i)))
    return found.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.transform("matched", lambda r: r["rule"]), ",").alias("rules"),
        F.array_join(F.array_distinct(F.transform("matched", lambda r: r["licence"])), ",").alias("licenses"),
    )
