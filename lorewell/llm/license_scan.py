"""Licence scans by sentence-rule recognition (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence notices and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-license",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-limits",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3-only",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-warranty",
    "see the gnu lesser general public license for more details": "lgpl-details",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "lgpl3-text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "see the gnu affero general public license for more details": "agpl-details",
    "licensed under cc by nc 4 0": "cc-by-nc4-ref",
    "licensed under cc by 4 0": "cc-by4-ref",
    "licensed under cc by sa 4 0": "cc-by-sa4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa4-ref",
    "this work is licensed under the creative commons attribution 4 0 international license": "cc-by4-ref",
    "this work is licensed under the creative commons attribution noncommercial 4 0 international license": "cc-by-nc4-ref",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": "cc-by-sa4-ref",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa4-ref",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd4-ref",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd4-ref",
    "licensed under cc0 1 0": "cc0-ref",
    "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s each and all an owner of an original work of authorship and or a database each a work": "cc0-text",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1-notice",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed": "artistic2-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "released under the bsd license": "bsd-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-library",
    "this work is licensed under a creative commons attribution 3 0 unported license": "cc-by3-ref",
    "this work is licensed under the creative commons attribution 3 0 unported license": "cc-by3-ref",
    "this work is licensed under a creative commons attribution sharealike 3 0 unported license": "cc-by-sa3-ref",
    "this work is licensed under the creative commons attribution sharealike 3 0 unported license": "cc-by-sa3-ref",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "rights-reserved",
}

# Ordered licence rules, the sentence identifiers that must follow one another among those recognised.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache2-license", "apache2-compliance", "apache2-copy", "apache2-basis", "apache2-limits")),
    ("Apache-2.0", ("apache2-ref",)),
    ("Apache-2.0", ("apache2-license", "apache2-compliance")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-warranty", "gpl-details")),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-3.0", ("gpl3-only",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-warranty", "gpl-details")),
    ("GPL-2.0", ("gpl2-ref",)),
    ("GPL-2.0", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-later", "lgpl-warranty", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-warranty", "lgpl-details")),
    ("LGPL-3.0", ("lgpl3-text",)),
    ("AGPL-3.0-or-later", ("agpl3-later", "gpl-warranty", "agpl-details")),
    ("CC-BY-NC-4.0", ("cc-by-nc4-ref",)),
    ("CC-BY-4.0", ("cc-by4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa4-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd4-ref",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd4-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CC0-1.0", ("cc0-text",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-1.0", ("epl1-notice",)),
    ("Zlib", ("zlib-warranty", "zlib-liable", "zlib-grant")),
    ("Artistic-2.0", ("artistic2-text",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-ref",)),
    ("MPL-2.0", ("mpl2-terms", "mpl2-copy")),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("rights-reserved",)),
)

RULES += (("LGPL-3.0-or-later", ("lgpl3-library", "lgpl-warranty", "lgpl-details")), ("CC-BY-3.0", ("cc-by3-ref",)), ("CC-BY-SA-3.0", ("cc-by-sa3-ref",)))

# Sentences with a gap of some words (a holder's name, a file's name) between a beginning and an end.
GAPPED = (
    ("neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    ("neither the names of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    ("neither the name of", "nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    ("this project is licensed under the mit license see the", "for details", "mit-ref"),
    ("this project is licensed under the apache license 2 0 see the", "for details", "apache2-ref"),
)
#: Words of a gap at most.
GAP = 16
# Tag lines name a licence by its identifier, alone in its sentence.
TAGGED = {"spdx license identifier " + name.lower().replace("-", " ").replace(".", " "): f"spdx-{name}" for name in dict(RULES) if name not in ("Proprietary", "BSD")}
SENTENCES |= TAGGED
RULES += tuple((name, (f"spdx-{name}",)) for name in dict(RULES) if f"spdx-{name}" in TAGGED.values())

#: Words that mark comments at the start of a line.
COMMENT = r"(?m)^[ \t]*(?:dnl|DNL|rem|REM|Rem)[ \t]+"
#: A tag line ends where its line ends, whatever follows.
TAG_LINE = r"(?im)(spdx-license-identifier:[^\r\n]*)"
#: A sentence ends after . ! ? : or ; and white space, and at a line end unless the next line goes on in lower case; END marks it (texts are lower case by then).
UNWRAP, ENDS, NOISE, END = r"\r?\n[ \t]*(?=[a-z(\"])", r"[.!?:;]\s+|[\r\n]+", r"[^a-z0-9X]+", "X"
#: A known sentence starts and ends at marks and may run over others (wrapped lines, comment marks, colons, "v. 2.0"); of those from one start the shortest.
_JOINT = f"(?: {END})* "
_SHORTEST_FIRST = sorted([(len(k), k.replace(" ", _JOINT)) for k in SENTENCES] + [(len(a) + len(b), f"{a.replace(' ', _JOINT)}{_JOINT}(?:[a-z0-9]+{_JOINT}){{1,{GAP}}}?{b.replace(' ', _JOINT)}") for a, b, _ in GAPPED])
KNOWN = f"(?<={END} )(?:" + "|".join(x for _, x in _SHORTEST_FIRST) + f")(?= {END})"


def marked(text: Column) -> Column:
    """Lower case, END between the sentences and around all, every run of other characters than a-z and 0-9 one space."""
    ended = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT, " "), TAG_LINE, "$1."), UNWRAP, " ")), ENDS, f" {END} ")
    return F.regexp_replace(F.concat(F.lit(f"{END} "), ended, F.lit(f" {END}")), NOISE, " ")


def license_scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """Licences of whole texts, by sentence identifiers matched against ordered rules.

    Each text is normalised with the ends of its sentences marked, the known licence
    sentences are sought from mark to mark, and the identifiers found, in text order,
    are matched against the ordered rules (a rule's identifiers must stand next to one
    another).  A gap of up to 16 words stands for a holder's or a file's name; a tag line
    names its licence.  A known sentence may be wrapped in any way, over comment marks (also dnl and REM) and
    blank lines too; the SQL knows only those within one of its sentences.
    Where a longer rule matches, the shorter rules it contains still count as the
    same licence; BSD-2-Clause is dropped where BSD-3-Clause matches, Proprietary where
    any other licence does (open notices reserve all other rights too).  Null and
    empty texts have no sentences and no licence, an empty table gives no rows;
    repeated sentences repeat their identifier, rules that match in the same place all
    count, repeated rows are scanned alike, further columns are ignored; a
    text of any length is scanned whole.  Returns doc_id, sentence_ids (space-joined identifiers, in order),
    licenses (distinct names, sorted, comma-joined), n_sentences (long, known ones).
    One narrow pass, no shuffle: whole rows are kept and nothing is broadcast.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    sentences = F.regexp_extract_all(marked(F.col(text)), F.lit(KNOWN), F.lit(0))

    def identifier(s: Column) -> Column:
        s = F.replace(s, F.lit(f" {END}"), F.lit(""))
        gapped = [F.when(s.startswith(a + " ") & s.endswith(" " + b), F.lit(name)) for a, b, name in GAPPED]
        return F.coalesce(F.try_element_at(known, s), *gapped)

    found = documents.select("doc_id", F.transform(sentences, identifier).alias("ids"))
    line = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    hit = [F.when(line.contains(" " + " ".join(ids) + " "), F.lit(name)) for name, ids in RULES]
    names = F.array_sort(F.array_distinct(F.filter(F.array(*hit), lambda x: x.isNotNull())))
    names = F.when(F.array_contains(names, "BSD-3-Clause"), F.array_remove(names, "BSD-2-Clause")).otherwise(names)
    names = F.when(F.size(names) > 1, F.array_remove(names, "Proprietary")).otherwise(names)
    return found.select("doc_id", F.array_join("ids", " ").alias("sentence_ids"), F.array_join(names, ",").alias("licenses"), F.size("ids").cast("long").alias("n_sentences"))


def oracle_sql() -> str:
    """The same in DuckDB: its own string functions, the same fixed values."""
    quoted = lambda s: "'" + s + "'"
    known = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in SENTENCES.items()) + "}"
    rules = ", ".join(f"CASE WHEN contains(line, '{' ' + ' '.join(ids) + ' '}') THEN '{name}' END" for name, ids in RULES)
    return f"""
WITH cut AS (
  SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '\\r?\\n[ \\t]*([a-z("])', ' \\1', 'g'), '[.!?:]\\s+|[\\r\\n]+') AS parts FROM documents
), mapped AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: ({known})[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda s: s IS NOT NULL) AS ids FROM cut
), lines AS (
  SELECT doc_id, ids, ' ' || array_to_string(ids, ' ') || ' ' AS line FROM mapped
), hits AS (
  SELECT doc_id, ids, list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))) AS names FROM lines
)
SELECT doc_id, array_to_string(ids, ' ') AS sentence_ids,
  array_to_string(list_filter(names, lambda x: NOT (x = 'BSD-2-Clause' AND list_contains(names, 'BSD-3-Clause')) AND NOT (x = 'Proprietary' AND len(names) > 1)), ',') AS licenses,
  len(ids)::BIGINT AS n_sentences
FROM hits
"""
