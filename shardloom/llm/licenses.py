"""Licence scans by canonical digests: normalise whole texts, hash them, and join the digests of known licences.

Only DataFrame functions run. Normalising takes away what differs between copies of one licence: letter case,
punctuation, white space, copyright lines and spellings. A text is looked up as a whole, and so is each of its lines,
because files mostly carry a one-line notice.

Nulls: a null text is an empty one, which has no licence. Rows that repeat are answered alike. A null doc_id is kept. An
empty table of documents gives no rows; with an empty catalogue no document has a licence.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import lower_ascii

#: Spellings that mean the same, after lower-casing (fixed values).
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("fulfilment", "fulfillment"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("programme", "program"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
    ("version v", "version "),
)
#: A line that only says who holds the copyright, or that all rights are reserved.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:\(c\)|©|copyright[ \t]+(?:\(c\)|©|[0-9]|<|\[|\{)|all rights reserved)[^\n]*$"
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F ©«»‐-―‘-‟•…]+"

#: Known texts (fixed values).
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: Known one-line notices (fixed values).
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
}
#: Titles that standard files carry above the texts of TEXTS, before or after the copyright lines (fixed values).
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": (
        "BSD 3-Clause License",
        "The BSD 3-Clause License",
        "BSD 3-Clause \"New\" or \"Revised\" License",
        "New BSD License",
        "Modified BSD License",
    ),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
}
#: Where the appendix of a standard file starts, which many copies leave out.
TERMS_END = "END OF TERMS AND CONDITIONS"


def _bsd_3(bsd_2: str, holder: str) -> str:
    """The two-clause text with the third clause."""
    clause = (
        f"3. Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from\n"
        "this software without specific prior written permission.\n"
    )
    return bsd_2.replace("THIS SOFTWARE IS", clause + "THIS SOFTWARE IS", 1)


def standard() -> list[tuple[str, str]]:
    """license_id and text of common licences as standard files have them: with and without title, numbers or appendix."""
    bodies = list(TEXTS.items())
    bodies += [("BSD-3-Clause", _bsd_3(TEXTS["BSD-2-Clause"], holder)) for holder in ("the copyright holder", "the University")]
    regents = bodies[-1][1].replace("COPYRIGHT HOLDERS AND", "REGENTS AND").replace("COPYRIGHT HOLDER OR", "REGENTS OR")
    bodies += [("BSD-3-Clause", regents)]
    bodies += [("ISC", TEXTS["ISC"].replace("and/or distribute", "and distribute"))]
    bodies += [(name, text.replace("\n1. ", "\n").replace("\n2. ", "\n").replace("\n3. ", "\n")) for name, text in bodies if "BSD-" in name]
    found = bodies + [(name, f"{title}\n{text}") for name, text in bodies for title in TITLES[name]]
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        found.append((path.name.removesuffix(".txt"), text))
        terms, end, _ = text.partition(TERMS_END)
        if end:
            found += [(path.name.removesuffix(".txt"), kept) for kept in (terms, terms + end)]
    return list(dict.fromkeys(found))


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one space for any marks, one spelling; line breaks stay."""
    text = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    text = F.regexp_replace(text, MARKS, " ")
    for other, usual in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(usual))
    return text


def digest(canonical_text: Column) -> Column:
    """Of words in a row: breaks and spaces at the borders do not count. Null where there is no word."""
    joined = F.trim(F.regexp_replace(canonical_text, r"[ \n]+", " "))
    return F.when(joined != "", F.sha2(joined.cast("binary"), 256))


def catalogue(spark: SparkSession) -> DataFrame:
    """license_id and text of the built-in texts and notices: a fixed list, so its size is bounded."""
    rows = [*standard(), *((name, line) for name, lines in NOTICES.items() for line in lines)]
    entries = [F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: text_digest, license_id of the whole text (or null), n_notices and the licences of its lines.

    `known` (license_id, text; by default the built-in catalogue) is joined by digest; Spark broadcasts it if it is
    known to be small. A document's digests come together again after a partial aggregation beside the scan, so that
    one narrow row per document is all that is shuffled.
    """
    known = catalogue(docs.sparkSession) if known is None else known
    digests = known.select(digest(canonical(F.col("text"))).alias("_digest"), F.col("license_id").alias("_license"))
    digests = digests.filter("_digest is not null").groupBy("_digest").agg(F.min("_license").alias("_license"))

    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), canonical(F.col("text")).alias("_text"))
    lines = F.filter(F.transform(F.split("_text", "\n"), digest), lambda d: d.isNotNull())
    entry = lambda whole, d: F.struct(F.lit(whole).alias("_whole"), d.alias("_digest"))
    whole = F.array(entry(True, digest(F.col("_text"))))
    entries = texts.select("doc_id", "_row", F.inline(F.concat(whole, F.transform(lines, lambda d: entry(False, d)))))
    found = entries.join(digests, "_digest", "left")
    notice = F.when(~F.col("_whole"), F.col("_license"))
    rows = found.groupBy("_row", "doc_id").agg(
        F.max(F.when(F.col("_whole"), F.col("_digest"))).alias("text_digest"),
        F.max(F.when(F.col("_whole"), F.col("_license"))).alias("license_id"),
        F.count(notice).alias("n_notices"),
        F.collect_set(notice).alias("_names"),
    )
    return rows.select("doc_id", "text_digest", "license_id", "n_notices", F.array_join(F.array_sort("_names"), ",").alias("notices"))
