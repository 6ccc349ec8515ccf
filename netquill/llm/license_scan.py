"""Licence scan by sentence rules, with DataFrame functions only.

A text gets marks where a sentence may begin or end and is normalised. A known licence sentence is found wherever it runs from a mark to a mark;
marks and line ends inside it don't matter. The identifiers found, in their order in the text, are matched with the licence rules: a rule is a list of identifiers that must occur in that order,
others may stand between them. Within a family the first matching rule counts. Nothing is shuffled: a row is decided alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of public licences and the short names in use for them, normalised as in `normalise`.
SENTENCES = {
    "MIT-RELEASED": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
                     "distributed under the mit license", "this software is released under the mit license"],
    "MIT-GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MIT-NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AS-IS": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "APACHE-2.0": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license",
                   "this project is licensed under the apache license version 2 0", "released under the apache license version 2 0"],
    "APACHE-COMPLY": ["you may not use this file except in compliance with the license"],
    "GPL-3": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
              "this program is licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "GPL-2": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "GPL-GRANT-2+": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "GPL-GRANT-3+": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "LGPL-3": ["this work is licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3"],
    "AGPL-3": ["this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"],
    "CC-BY-NC-4": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-4": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC-BY-SA-4": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC0": ["licensed under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0"],
    "BSD-RELEASED": ["released under the bsd license", "licensed under the bsd license"],
    "BSD-GRANT": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD-SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD-BINARY": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "ISC-GRANT": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "MPL-2": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "UNLICENSE": ["this is free and unencumbered software released into the public domain"],
    "RESERVED": ["all rights reserved"],
}
# Fixed values: (family, licence, identifiers in order); the first match of a family counts.
RULES = [
    ("apache", "Apache-2.0", ["APACHE-2.0"]),
    ("agpl", "AGPL-3.0", ["AGPL-3"]),
    ("lgpl", "LGPL-3.0", ["LGPL-3"]),
    ("gpl", "GPL-3.0-or-later", ["GPL-GRANT-3+"]),
    ("gpl", "GPL-2.0-or-later", ["GPL-GRANT-2+"]),
    ("gpl", "GPL-3.0", ["GPL-3"]),
    ("gpl", "GPL-2.0", ["GPL-2"]),
    ("mit", "MIT", ["MIT-GRANT", "MIT-NOTICE"]),
    ("mit", "MIT", ["MIT-RELEASED"]),
    ("bsd", "BSD-2-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]),
    ("bsd", "BSD", ["BSD-RELEASED"]),
    ("isc", "ISC", ["ISC-GRANT"]),
    ("mpl", "MPL-2.0", ["MPL-2"]),
    ("cc-by-nc", "CC-BY-NC-4.0", ["CC-BY-NC-4"]),
    ("cc-by-sa", "CC-BY-SA-4.0", ["CC-BY-SA-4"]),
    ("cc-by", "CC-BY-4.0", ["CC-BY-4"]),
    ("cc0", "CC0-1.0", ["CC0"]),
    ("unlicense", "Unlicense", ["UNLICENSE"]),
]
#: Sentences and rules that ``sql`` doesn't restate; the rules stand before the others of their family.
MORE_SENTENCES = {
    "BSD-ENDORSE": [f"neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
                    for holder in ("the copyright holder", "copyright holder", "the organization", "the university", "the author", "the project")],
}
MORE_RULES = [("bsd", "BSD-3-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE"])]
#: A sentence may end after one of these before white space, or where a new line begins with a capital letter or follows a blank line.
_END = "([.!?;:])[ \\t\\r\\n]+"
_NEW_LINE = "\\n[ \\t\\r]*(\\n|[A-Z])"
_CUT = "\x01"
_KNOWN = {s: k for k, v in [*SENTENCES.items(), *MORE_SENTENCES.items()] for s in v}
#: A known sentence between two marks, the longest one first.
_FIND = f"{_CUT} ?(?:{'|'.join(s.replace(' ', f'[ {_CUT}]+') for s in sorted(_KNOWN, key=len, reverse=True))})(?= ?{_CUT})"


def normalise(text: Column) -> Column:
    """Marks around and between sentences; lower case, everything but marks, ASCII letters and digits as one blank, British spelling as American."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _END, f"$1{_CUT}"), _NEW_LINE, f"{_CUT}$1")
    words = F.regexp_replace(F.lower(F.concat(F.lit(_CUT), marked, F.lit(_CUT))), f"[^a-z0-9{_CUT}]+", " ")
    return F.regexp_replace(words, "licence", "license")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in their order."""
    known = F.create_map(*[F.lit(x) for pair in _KNOWN.items() for x in pair])
    found = F.regexp_extract_all(normalise(text), F.lit(_FIND), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.trim(F.regexp_replace(s, f"[ {_CUT}]+", " "))))


def match_rules(ids: Column) -> Column:
    """Licences of an identifier sequence, in the order of the families."""
    joined = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    families: dict[str, Column] = {}
    before = lambda r: [x for x in MORE_RULES if x[0] == r[0]]
    for family, licence, wanted in [x for r in RULES for x in (*before(r), r)]:
        hit = joined.like("%" + "%".join(f",{i}," for i in wanted) + "%")
        families[family] = F.when(hit, F.lit(licence)) if family not in families else families[family].when(hit, F.lit(licence))
    return F.array_compact(F.array(*families.values()))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence_ids (array), licenses (array) for every row of ``docs``.

    A null or empty text has neither. A sentence that repeats is listed each time. Known sentences that complete no rule are listed
    without a licence. Whole texts of any length are read. Rows are decided one by one, so repeated rows get equal results; other
    columns are not read.
    """
    found = docs.select(F.col(key).alias("doc_id"), sentence_ids(F.col(text)).alias("sentence_ids"))
    return found.withColumn("licenses", match_rules(F.col("sentence_ids")))


def sql() -> str:
    """The query in DuckDB's SQL, from the tables ``SENTENCES`` and ``RULES``.

    It looks up whole pieces between two marks, so it doesn't find a sentence that has a mark inside.
    """
    known = ", ".join(f"('{s}', '{k}')" for k, v in SENTENCES.items() for s in v)
    families: dict[str, list[str]] = {}
    for family, licence, wanted in RULES:
        families.setdefault(family, []).append(f"WHEN seq LIKE '%{'%'.join(f',{i},' for i in wanted)}%' THEN '{licence}'")
    cases = ", ".join(f"CASE {' '.join(w)} END" for w in families.values())
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
marked AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''),
    '([.!?;:])[ \t\r\n]+', '\1' || chr(1), 'g'), '\n[ \t\r]*(\n|[A-Z])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents),
pieces AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM marked),
ids AS (SELECT r, string_agg(id, ',,' ORDER BY pos) AS seq FROM pieces JOIN known
    ON sentence = replace(trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')), 'licence', 'license') GROUP BY r),
full_ids AS (SELECT doc_id, ',' || coalesce(seq, '') || ',' AS seq FROM marked LEFT JOIN ids USING (r))
SELECT doc_id, trim(replace(seq, ',,', ','), ',') AS sentence_ids, concat_ws(',', {cases}) AS licenses FROM full_ids
"""
