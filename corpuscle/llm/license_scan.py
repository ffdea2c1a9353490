"""Licence scans by sentence rules.

Texts are cut into units at line ends and sentence ends, and normalised (case, spaces,
punctuation). A known licence sentence is one unit or several that follow each other
without an empty line between, so that it is found however a notice is wrapped or
commented out; years and holders within it may be any. Where several known sentences
start, the longest counts. What remains of a text is a sequence of sentence
identifiers, and a licence is recognised where the ordered identifiers of one of its
rules occur in that sequence in order.

Known sentences and rules grow with the rules, not with the texts: they are literal
maps of the plan, so texts are scanned where they are read, without an exchange. Only
built-in column functions are used.

Defined cases: a null or empty text matches nothing; equal rows each get a row; an
empty table gives an empty result; of the rules that match, all are reported, and the
longest, then the first by name, is the text's licence.
"""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = string.ascii_uppercase

#: Sentences of public licences as they stand in notices and headers.
SENTENCES: dict[str, str] = {
    "apache-2-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-2-use": "you may not use this file except in compliance with the License",
    "apache-2-as-is": "distributed under the License is distributed on an \"AS IS\" BASIS",
    "mit-name": "The MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-released": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd-source": "Redistributions of source code must retain the above copyright notice",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": "may be used to endorse or promote products derived from this software",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl-3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-or-later": "either version 3 of the License, or (at your option) any later version",
    "gpl-2-or-later": "either version 2 of the License, or (at your option) any later version",
    "lgpl-free": "under the terms of the GNU Lesser General Public License",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "CC0 1.0 Universal",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights": "All rights reserved",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
}
#: Whole sentences of the usual notices, with the identifiers of what they hold. "*" is a holder or a
#: name, "~" one that ends on its line, "#" a year; a sentence that starts with "*" may follow any words.
WHOLE: tuple[tuple[str, str], ...] = (
    ("apache-2-licensed apache-2-use", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache-2-licensed apache-2-use", "* licenses this file to you under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache-2-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit-name", "MIT License"),
    ("mit-name", "The MIT License (MIT)"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-notice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    ("as-is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-free gpl-or-later", "* is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-free gpl-2-or-later", "* is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl-free", "* is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-free", "* is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("all-rights", "Copyright ~ All rights reserved"),
    ("all-rights", "(c) # ~ All rights reserved"),
)
#: Licences by the sentences that must follow each other, others between them allowed.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-2-licensed",)), ("Apache-2.0", ("apache-2-licensed", "apache-2-use", "apache-2-as-is")), ("Apache-2.0", ("spdx-apache-2",)),
    ("MIT", ("mit-name",)), ("MIT", ("mit-licensed",)), ("MIT", ("mit-released",)), ("MIT", ("mit-grant", "mit-notice", "as-is")), ("MIT", ("mit-grant",)), ("MIT", ("spdx-mit",)),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD", ("bsd-redistribution",)), ("BSD-3-Clause", ("spdx-bsd-3",)),
    ("GPL", ("gpl-free",)), ("GPL-3.0-only", ("gpl-3-work",)), ("GPL-3.0-or-later", ("gpl-free", "gpl-or-later")), ("GPL-2.0-or-later", ("gpl-free", "gpl-2-or-later")), ("GPL-3.0-or-later", ("spdx-gpl-3",)),
    ("LGPL", ("lgpl-free",)), ("MPL-2.0", ("mpl-2",)), ("CC-BY-4.0", ("cc-by",)), ("CC-BY-NC-4.0", ("cc-by-nc",)), ("CC-BY-SA-4.0", ("cc-by-sa",)), ("CC0-1.0", ("cc0",)), ("Unlicense", ("unlicense",)), ("Proprietary", ("all-rights",)),
)


def normalise(sentence: str) -> str:
    """The form in which sentences are compared; ``units`` does the same to a column."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def units(text: Column) -> Column:
    """The normalised units of a text, each between line ends: cut at line ends and after ``.``, ``!`` or ``?`` before white space.

    An empty line is marked by ``;``.
    """
    cut = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), r"([.!?])[ \t\r]+", "$1\n")
    out = F.concat(F.lit("\n"), F.regexp_replace(cut, r"[^a-z0-9\n]+", " "), F.lit("\n"))
    for old, new in ((" \n", "\n"), ("\n ", "\n"), ("\n\n", "\n;\n")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


_GAPS = {"*": r"[a-z0-9 \n]+?", "~": "[a-z0-9 ]+?", "#": "[0-9]{4}"}


def _parts(sentence: str) -> list[str]:
    """Normalised words, and gaps between them."""
    return [w for part in re.split(r"([*~#])", sentence) for w in ([part] if part in _GAPS else normalise(part).split())]


def sentence_pattern(sentences: Sequence[str]) -> str:
    """Over units: any of these sentences, the longest first."""
    lines, inner = [], []
    for parts in sorted((_parts(s) for s in sentences), key=lambda p: (-len(p), p)):
        named = parts[0] == "*"
        body = r"[ \n]".join(_GAPS.get(w, w) for w in parts[named:])
        # A sentence with a name before it also starts where a shorter known sentence spells the name out.
        lines.append(rf"(?:this[ \n][a-z0-9]+[ \n])?{body}" if named else body)
        inner += [body] if named else []
    pattern = rf"(?<=\n)(?:{'|'.join(lines)})(?=\n)"
    return pattern + (rf"|(?<=[ \n])(?:{'|'.join(inner)})(?=\n)" if inner else "")


def sentence_form(found: Column, sentences: Sequence[str]) -> Column:
    """What ``sentence_pattern`` has found, on one line and with gaps for years, holders and names."""
    out = F.replace(found, F.lit("\n"), F.lit(" "))
    for parts in map(_parts, sentences):
        if any(w in _GAPS for w in parts):
            named = parts[0] == "*"
            body = " ".join(_GAPS.get(w, w) for w in parts[named:])
            out = F.regexp_replace(out, rf"^(?:this [a-z0-9]+ )?{body}$" if named else f"^{body}$", " ".join(parts))
    return out


def rule_pattern(ids: Sequence[str]) -> str:
    """Over identifiers each followed by a space: these, in order, with any others between them."""
    return "(^| )" + " ([^ ]+ )*".join(ids) + " "


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", known: Mapping[str, str] | None = None, rules: Sequence[tuple[str, Sequence[str]]] | None = None, whole: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``keep`` plus n_known (known sentences), sentence_ids and licenses (joined by spaces), license.

    ``licenses`` names each recognised licence once, in order of name. ``whole`` are
    sentences that hold one or more of the known ones (by default those of the usual
    notices, unless other sentences are given).
    """
    whole = (WHOLE if known is None else ()) if whole is None else whole
    known = SENTENCES if known is None else known
    rules = RULES if rules is None else rules
    by_form = {normalise(s): i for i, s in known.items()} | {" ".join(_parts(s)): ids for ids, s in whole}
    lookup = F.create_map(*[F.lit(x) for pair in sorted(by_form.items()) for x in pair])
    texts = [*(normalise(s) for s in known.values()), *(s for _, s in whole)]
    found = F.regexp_extract_all(units(F.col(text)), F.lit(sentence_pattern(texts)), F.lit(0))
    first = docs.select(*keep, found.alias("_found"))
    second = first.select(*keep, F.transform("_found", lambda s: F.element_at(lookup, sentence_form(s, texts))).alias("_ids"))
    # The identifiers, each followed by a space, are matched as one string.
    third = second.select(*keep, F.array_join("_ids", " ").alias("sentence_ids"))
    third = third.select(*keep, F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", " "))).cast("long").alias("n_known"), "sentence_ids")
    line = F.concat("sentence_ids", F.lit(" "))
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0]))
    names = sorted({n for n, _ in rules})
    holds = lambda n: F.expr("false") if not (of := [r for r in rules if r[0] == n]) else _any(line, of)
    # Most texts hold no known sentence; they skip the rules.
    some = F.col("n_known") > 0
    best = F.coalesce(*[F.when(F.rlike(line, F.lit(rule_pattern(ids))), F.lit(name)) for name, ids in ordered])
    listed = F.concat_ws(" ", *[F.when(holds(n), F.lit(n)) for n in names])
    return third.select(*keep, "n_known", "sentence_ids", F.when(some, listed).otherwise("").alias("licenses"), F.when(some, best).alias("license"))


def _any(line: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    return F.rlike(line, F.lit("|".join(f"(?:{rule_pattern(ids)})" for _, ids in rules)))
