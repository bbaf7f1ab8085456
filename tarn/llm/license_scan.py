"""License scans by sentence rules.

A text is cut into sentences after full stops, and may be cut at line ends, semicolons, colons and the
"v." of a version: a known sentence starts and ends at a cut of either kind and may run on over the
latter, so that notices wrapped at any column and inside comment marks are found. Texts are normalised to
lower-case ASCII words; the sequence of identifiers found is matched against ordered rules: each that
fits names a licence, the first one the document's. All of it is one projection over the documents: no
shuffle, no Python. The DuckDB text cuts at every line end and colon and knows the short sentences only,
so it has the same rows only where notices stand on one line, as in the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import lower_ascii, table, text_of

# Known sentences by identifier, in normal form.
SENTENCES = {
    "A": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gpl version 3"),
    "B": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "C": ("you may obtain a copy of the license at",),
    "D": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "E": ("released under the mit license", "licensed under the mit license", "the mit license", "mit license"),
    "F": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",),
    "G": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "H": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "I": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "J": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "K": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "L": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "M": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "N": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "O": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "P": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "Q": ("all rights reserved",),
    "R": ("this is free and unencumbered software released into the public domain",),
}
_FREE = "this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu{} general public license "
_ANY_LATER = "as published by the free software foundation either version {} of the license or at your option any later version"
# Sentences of real notices beyond those, as patterns over normal forms.
WHOLE = {
    "B": ("spdx license identifier apache 2 0",),
    "E": ("spdx license identifier mit",),
    "F": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "N": ("neither the name of(?: [a-z0-9]+){1,12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "A": ("spdx license identifier gpl 3 0(?: only)?",),
    "O": ("spdx license identifier gpl 3 0 or later",),
    "P": ("spdx license identifier mpl 2 0",),
    "R": ("spdx license identifier unlicense",),
    "S": (_FREE.format("") + _ANY_LATER.format("2"), "spdx license identifier gpl 2 0 or later"),
    "T": (_FREE.format(" lesser") + _ANY_LATER.format("2 1"), "spdx license identifier lgpl 2 1 or later"),
    "U": (_FREE.format(" lesser") + _ANY_LATER.format("3"), "spdx license identifier lgpl 3 0 or later"),
    "V": (_FREE.format(" affero") + _ANY_LATER.format("3"), "spdx license identifier agpl 3 0 or later"),
    "W": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "spdx license identifier isc"),
    "X": ("this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0(?: which(?: [a-z0-9]+){1,16})?", "spdx license identifier epl 2 0"),
    "Y": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "spdx license identifier zlib"),
    "Z": (_FREE.format("") + "version 2 as published by the free software foundation", "(?:this work is )?licensed under the (?:gnu general public license|gpl) version 2", "spdx license identifier gpl 2 0(?: only)?"),
    "a": ("spdx license identifier bsd 3 clause",),
    "b": ("spdx license identifier bsd 2 clause",),
}
# Rules in order of precedence; a pattern over the identifiers in order of appearance.
RULES = (
    ("Apache-2.0", "BC?D?"),
    ("AGPL-3.0-or-later", "V"),
    ("GPL-3.0-or-later", "O"),
    ("GPL-3.0-only", "A"),
    ("GPL-2.0-or-later", "S"),
    ("GPL-2.0-only", "Z"),
    ("LGPL-3.0-or-later", "U"),
    ("LGPL-2.1-or-later", "T"),
    ("BSD-3-Clause", "KL+M.*N|a"),
    ("BSD-2-Clause", "KL+M|b"),
    ("MIT", "E|FG"),
    ("ISC", "W"),
    ("Zlib", "Y"),
    ("MPL-2.0", "P"),
    ("EPL-2.0", "X"),
    ("CC-BY-NC-4.0", "H"),
    ("CC-BY-SA-4.0", "J"),
    ("CC-BY-4.0", "I"),
    ("Unlicense", "R"),
    ("Proprietary", "Q"),
)
#: Rules that hold only where another, or any other, does not.
UNLESS = {"BSD-2-Clause": "BSD-3-Clause", "Proprietary": ""}
#: A list item's mark at the start of a line; where a text may be cut (~); where it is cut (|).
ITEM = r"\n[^a-z0-9\n]*[a-z0-9]{1,4}[)](?=[ \t])"
SOFT = r"\n|[;:](?=[ \t\r\n]|$)|(?<=\bv)\.(?=[ \t\r\n])"
HARD = r"[.](?=[ \t\r\n]|$)"
#: Words that stand in every known sentence.
HINT = "licen[sc]|permission|redistribution|copyright|unencumbered|neither[^a-z0-9]+the[^a-z0-9]+name|rights[^a-z0-9]+reserved|free[^a-z0-9]+software"


def sentence_form(sentence: Column) -> Column:
    """Words of a-z and 0-9 with one space between them."""
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def _patterns() -> list[tuple[str, str]]:
    """Identifiers and patterns of their sentences, the longest first."""
    both = [(i, form) for known in (SENTENCES, WHOLE) for i, forms in known.items() for form in forms]
    return sorted(both, key=lambda x: -len(x[1]))


def _identifier(form: Column) -> Column:
    found = None
    for i in SENTENCES | WHOLE:
        pattern = f"^(?:{'|'.join([*SENTENCES.get(i, ()), *WHOLE.get(i, ())])})$"
        found = F.when(form.rlike(pattern), i) if found is None else found.when(form.rlike(pattern), i)
    return found


def marked(text: Column) -> Column:
    """Words with one space, | or ~ between them and | at the ends: cuts, and places that may be cuts."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[|~]", " "), ITEM, "$0~"), SOFT, " ~ ")
    words = F.trim(F.regexp_replace(F.regexp_replace(cut, HARD, " | "), "[^a-z0-9|~]+", " "))
    return F.concat(F.lit("|"), F.regexp_replace(F.regexp_replace(words, "[ ~]*[|][ ~|]*", "|"), " ?~[ ~]*", "~"), F.lit("|"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``n_sentences`` (known ones found, repeats included), ``sentence_ids``, ``licenses`` and ``license``.

    ``sentence_ids`` has the identifiers in order of appearance; ``licenses`` names all rules that they
    match, with | between them, and ``license`` is the first of those, null if there is none. Null and
    empty texts have no sentences. Columns of those names are replaced; rows and other columns are kept.
    Texts without any word that a known sentence needs are not normalised; texts are read whole.
    """
    text = lower_ascii(text_of(docs, text_col))
    known = "|".join(p.replace(" ", "[ ~|]" if "+" in p else "[ ~]") for _, p in _patterns())
    found = F.regexp_extract_all(marked(text), F.lit(f"(?<=[|~])(?:{known})(?=[|~])"), F.lit(0))
    ids = F.when(text.rlike(HINT), F.array_compact(F.transform(found, lambda s: _identifier(F.translate(s, "~|", "  "))))).otherwise(F.array().cast("array<string>"))
    base = docs.drop("n_sentences", "sentence_ids", "licenses", "license")
    out = base.withColumn("sentence_ids", F.array_join(ids, "")).withColumn("n_sentences", F.length("sentence_ids").cast("long"))
    fits = {name: F.col("sentence_ids").rlike(pattern) for name, pattern in RULES}
    for name, other in UNLESS.items():
        for x in [other] if other else [n for n, _ in RULES if n != name]:
            fits[name] = fits[name] & ~F.col("sentence_ids").rlike(dict(RULES)[x])
    out = out.withColumn("licenses", F.when(F.col("n_sentences") == 0, "").otherwise(F.concat_ws("|", *[F.when(x, name) for name, x in fits.items()])))
    return out.withColumn("license", F.when(F.col("licenses") != "", F.substring_index("licenses", "|", 1)))


def query(spark, sf_dir: str) -> DataFrame:
    """op4_license_scan."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "sentence_ids", "licenses", "license")


def _sql() -> str:
    known = ", ".join(f"('{form}', '{i}')" for i, forms in SENTENCES.items() for form in forms)
    pattern = dict(RULES)

    def fits(name: str) -> str:
        others = [] if name not in UNLESS else [UNLESS[name]] if UNLESS[name] else [n for n, _ in RULES if n != name]
        return " AND ".join([f"regexp_matches(ids, '{pattern[name]}')", *[f"NOT regexp_matches(ids, '{pattern[x]}')" for x in others]])

    names = ", ".join(f"CASE WHEN {fits(name)} THEN '{name}' END" for name, _ in RULES)
    return f"""
WITH known(form, id) AS (VALUES {known}),
cut AS (
    SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '\\n|[.;:][ \\t\\r]|[.;:]\\n|[.;:]$')) AS s,
           generate_subscripts(string_split_regex(lower(coalesce(text, '')), '\\n|[.;:][ \\t\\r]|[.;:]\\n|[.;:]$'), 1) AS pos
    FROM documents),
forms AS (SELECT doc_id, pos, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS form FROM cut WHERE length(s) >= 10),
found AS (SELECT doc_id, string_agg(id, '' ORDER BY pos) AS ids, count(*) AS n FROM forms JOIN known USING (form) GROUP BY doc_id),
named AS (SELECT doc_id, n, ids, concat_ws('|', {names}) AS licenses FROM found)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses,
       nullif(split_part(coalesce(licenses, ''), '|', 1), '') AS license
FROM (SELECT doc_id FROM documents) d LEFT JOIN named USING (doc_id)
"""


SQL = _sql()
