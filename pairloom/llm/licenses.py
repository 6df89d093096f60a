"""License scans by sentence rules: sentences are mapped to identifiers, identifier sequences to licences.

A text is normalised, with marks where sentences can end; known licence sentences are looked up from mark to mark, so that
wrapped and commented lines don't part them. What remains of a text is the sequence of the identifiers found, in order; a
rule matches where its own sequence stands in that, unbroken by other known sentences. A matched rule gives way to a matched
rule whose sequence contains its own. One pass, no shuffle.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower

#: Known sentences, in lower case and with single spaces, and their identifiers.
SENTENCES: dict[str, str] = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "licensed under the gnu lesser general public license version 3": "lgpl3-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-ref",
    "licensed under cc by 4 0": "cc-by-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "licensed under cc by nd 4 0": "cc-by-nd-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-ref",
    "this work is dedicated to the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
    "all rights reserved": "reserved",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "apache license version 2 0 january 2004": "apache2-title",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3-only",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "mozilla public license version 2 0": "mpl2-title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-ref",
    "eclipse public license v 2 0": "epl2-title",
    "this work is licensed under the creative commons cc0 1 0 universal license": "cc0-ref",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "creative commons legal code cc0 1 0 universal": "cc0-title",
    "boost software license version 1 0": "bsl-title",
    "licensed under the boost software license version 1 0": "bsl-ref",
}
#: SPDX identifiers, each known as a line "SPDX-License-Identifier: ID".
SPDX = ("MIT", "ISC", "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense")
SENTENCES |= {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', name.lower())}": f"spdx:{name}" for name in SPDX}
#: Every known sentence has one of these in it, however its words are parted, so that other texts need no
#: normalising.
CUES = "licen[sc]e|liable|permission|copyright|rights[^A-Za-z0-9]+reserved|warrant|redistribut|public[^A-Za-z0-9]+domain|free[^A-Za-z0-9]+software|you[^A-Za-z0-9]+may|can[^A-Za-z0-9]+obtain|legal[^A-Za-z0-9]+code"
#: Licences with the sequences that stand for them, in the order in which they are reported.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "mit-liability")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-ref",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-1-Clause", ("bsd-grant", "bsd-source")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-ref",)),
    ("Apache-2.0", ("apache2-title",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later")),
    ("GPL-3.0-only", ("gpl-free", "gpl3-only")),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only")),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-later")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-later")),
    ("LGPL-3.0-only", ("lgpl3-ref",)),
    ("LGPL-3.0-only", ("lgpl3-title",)),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-later")),
    ("AGPL-3.0-only", ("agpl3-title",)),
    ("MPL-2.0", ("mpl2-ref", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-ref",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("EPL-2.0", ("epl2-title",)),
    ("BSL-1.0", ("bsl-ref",)),
    ("BSL-1.0", ("bsl-title",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CC0-1.0", ("cc0-title",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    ("LicenseRef-public-domain", ("public-domain",)),
    ("Unlicense", ("unlicense-ref",)),
    ("LicenseRef-proprietary", ("reserved",)),
    *((name, (f"spdx:{name}",)) for name in SPDX),
)
#: Where a sentence can end: after its punctuation (but not in "v. 2"), at the end of a comment or of an SPDX line, at a blank line, at a line's end
#: unless the next line starts in lower case. A known sentence runs on over a RUNS_ON (line ends, with what comments put before
#: a line, and semicolons) but not over a STOPS.
STOPS, RUNS_ON = "\x01", "\x02"
ENDS = (
    (r"(?i)\bv\.[ \t]+([0-9])", "v $1"),
    (r"(?i)(SPDX-License-Identifier:[^\n]*)\n", f"$1{STOPS}"),
    (r"\*/|-->", STOPS),
    (r"([.!?])[ \t\n\f\r]+", f"$1{STOPS}"),
    (r"([;:])[ \t\n\f\r]+", f"$1{RUNS_ON}"),
    (r"\n[ \t]*([^a-z \t\n])", f"{RUNS_ON}$1"),
    (r"\n[ \t]*\n", RUNS_ON),
)


def marked(text: Column) -> Column:
    """``text`` in lower case, words parted by a space or by the marks of the ends between them, a mark at both its ends."""
    text = F.translate(text, RUNS_ON, " ")
    for pattern, put in ENDS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put))
    words = F.regexp_replace(ascii_lower(text), f"[^a-z0-9{STOPS}{RUNS_ON}]+", " ")
    return F.regexp_replace(F.concat(F.lit(STOPS), words, F.lit(STOPS)), f" ?([{STOPS}{RUNS_ON}]) ?", "$1")


def known_pattern() -> str:
    """Known sentences in a marked() text, from one mark to another, the longest first."""
    longest = sorted(SENTENCES, key=lambda s: -len(s.split()))
    return f"(?<=[{STOPS}{RUNS_ON}])(?:{'|'.join(s.replace(' ', f'(?: |{RUNS_ON}++)') for s in longest)})(?=[{STOPS}{RUNS_ON}])"


def rule_text(sequence: tuple[str, ...]) -> str:
    return "|" + "|".join(sequence) + "|"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_known, sentence_ids, licenses, n_licenses.

    sentence_ids has the known sentences in the text's order, as ``|a|b|``; licenses the licences found, each once, in
    the rules' order, joined by commas. A text without known sentences, an empty or null one has '', '' and zeros. Texts
    of any length are read whole; repeated rows and null ids stand for themselves; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cue = F.lit(f"(?i){CUES}")
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(SENTENCES.items())])
    sentences = F.regexp_extract_all(marked(text), F.lit(known_pattern()), F.lit(0))
    found = F.transform(sentences, lambda s: F.element_at(known, F.regexp_replace(s, f"{RUNS_ON}+", " ")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.regexp_like(text, cue), found).otherwise(F.array().cast("array<string>")).alias("ids"))
    joined = F.when(F.size("ids") > 0, F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))).otherwise("")
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_known"), joined.alias("sentence_ids"))
    wins = []
    for name, sequence in RULES:
        own = rule_text(sequence)
        wider = [rule_text(other) for _, other in RULES if other != sequence and own in rule_text(other)]
        won = F.col("sentence_ids").contains(own)
        for other in wider:
            won &= ~F.col("sentence_ids").contains(other)
        wins.append(F.when(won, F.lit(name)))
    licenses = F.array_distinct(F.filter(F.array(*wins), lambda x: x.isNotNull()))
    rows = rows.withColumn("all", F.when(F.col("sentence_ids") != "", licenses).otherwise(F.array().cast("array<string>")))
    return rows.select("doc_id", "n_known", "sentence_ids", F.array_join("all", ",").alias("licenses"), F.size("all").cast("long").alias("n_licenses"))
