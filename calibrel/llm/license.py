"""Licence scans by canonical digests, in DataFrame functions throughout.

A text, each of its paragraphs and each of its lines is brought to a canonical form: lower case,
copyright lines away, equivalent spellings as one, punctuation and white space as single spaces.
The SHA-256 of the whole form is joined to the digests of known licences. Lines are brought to it
once; paragraphs and texts are put together from them. A form longer than that of any known licence
needs no digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrel.llm.batches import BROADCAST_BYTES
from calibrel.llm.native import let

# Paragraphs that two licences share.
_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:"
)
_BSD_SOURCE = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer."
)
_BSD_BINARY = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
    "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Licences and their usual notices, by SPDX name; blank lines part paragraphs.
KNOWN_LICENSES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
        "OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at\n\n"
        "http://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", f"{_BSD_OPENING}\n\n{_BSD_SOURCE}\n\n{_BSD_BINARY}\n\n{_BSD_DISCLAIMER}"),
    (
        "BSD-3-Clause",
        f"{_BSD_OPENING}\n\n{_BSD_SOURCE}\n\n{_BSD_BINARY}\n\n"
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        f"permission.\n\n{_BSD_DISCLAIMER}",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "This library is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# A line that names a holder or a year, and the line that often follows it.
COPYRIGHT = (
    r"^[^a-z0-9]*((copyright )?(\(c\)|©)|copyright:? +[0-9<\[]|copyright\b.*\b[0-9]{4}\b|all rights reserved\.? *\r?$)"
)
VERSION = r"\bv(er(sion)?)?\.? ?([0-9])"
# Nothing of a line is left, as of one that only carries on a comment.
BLANK = r"^[^A-Za-z0-9]*$"
TITLE = r"^(the )?[a-z0-9 ]{0,40}license( [a-z0-9 ]{0,20})?$"
LEAST_PARAGRAPH = 8


def canonical_line(line: Column) -> Column:
    """Lower case, nothing of a copyright line, one spelling, single spaces for all else."""
    line = F.lower(line)
    spelled = F.replace(line, F.lit("licence"), F.lit("license"))
    spelled = F.when(
        F.contains(spelled, F.lit("://")), F.regexp_replace(spelled, r"https?://(www\.)?", "")
    ).otherwise(spelled)
    spelled = F.when(
        spelled.rlike(VERSION), F.regexp_replace(spelled, VERSION, "version $3")
    ).otherwise(spelled)
    plain = F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))
    return F.when(line.rlike(COPYRIGHT), F.lit("")).otherwise(plain)


def canonical_lines(text: Column) -> Column:
    """The canonical lines in one string, line by line; a line without letters and digits is a ``#``."""
    lines = F.split(text, r"\n", -1)
    forms = F.transform(lines, lambda x: F.when(x.rlike(BLANK), "#").otherwise(canonical_line(x)))
    return F.array_join(forms, "\n")


def canonical(lines: Column) -> Column:
    """The canonical form of what ``canonical_lines`` gives for a text."""
    return F.trim(F.regexp_replace(lines, r"[#\n ]+", " "))


def paragraphs(lines: Column) -> Column:
    """The canonical paragraphs of canonical lines, without empty ones."""
    return F.filter(F.transform(F.split(lines, r"\n?#\n?", -1), canonical), lambda p: p != "")


def known_digests(known: DataFrame) -> DataFrame:
    """``digest, license, length`` of licences given as ``license, text``, without empty ones.

    A licence of several paragraphs is also known by each of them that has at least
    ``LEAST_PARAGRAPH`` words and that no other licence has.
    """
    forms = known.select("license", canonical_lines(F.col("text")).alias("lines")).select(
        "license", canonical(F.col("lines")).alias("whole"), paragraphs(F.col("lines")).alias("parts")
    )
    long = F.filter("parts", lambda p: F.size(F.split(p, " ")) >= LEAST_PARAGRAPH)
    parts = forms.select("license", F.explode(long).alias("form"))
    alone = parts.groupBy("form").agg(F.min("license").alias("license"), F.count_distinct("license").alias("n"))
    form = forms.select("license", F.col("whole").alias("form")).where("form <> ''").unionByName(
        alone.where("n = 1").select("license", "form")
    )
    return form.select(
        F.sha2("form", 256).alias("digest"), "license", F.length("form").alias("length")
    ).distinct()


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN_LICENSES), "license string, text string")


def scan_licenses(
    df: DataFrame,
    known: DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, license, whole_text, n_paragraphs, n_lines``: one row per id and licence found.

    ``whole_text`` says that the text is the licence and nothing else, but for a title before it
    and copyright lines. A paragraph ends at a line without letters and digits; a unit that is the same text, paragraph and line counts once in each column. Null and
    empty texts and those that are only punctuation or copyright lines match nothing. Rows of one
    id, null ids included, are counted together. Other columns are left behind.
    """
    digests = known_digests(known if known is not None else built_in(df.sparkSession))
    size = digests.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()
    docs = df.select(df[id_column].alias("doc_id"), F.coalesce(df[text_column], F.lit("")).alias("text"))
    longest = size.longest or 0

    def units(kind: str, forms: Column) -> Column:
        kept = F.filter(forms, lambda f: F.length(f).between(1, longest))
        return F.transform(kept, lambda f: F.struct(F.lit(kind).alias("unit"), f.alias("form")))

    def all_units(lines: Column) -> Column:
        def of(found: Column) -> Column:
            title = F.get(found, 0).rlike(TITLE) & (F.size(found) > 1)
            untitled = F.when(title, F.array_join(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), " "))
            return F.concat(
                units("text", F.array(canonical(lines), F.coalesce(untitled, F.lit("")))),
                units("paragraph", found),
                units("line", F.filter(F.split(lines, r"\n", -1), lambda f: f != "#")),
            )

        return let(paragraphs(lines), of)

    found = (
        docs.select("doc_id", F.explode(let(canonical_lines(F.col("text")), all_units)).alias("u"))
        .select("doc_id", "u.unit", F.sha2("u.form", 256).alias("digest"))
    )
    small = size.n * 128 <= BROADCAST_BYTES
    hits = found.join(F.broadcast(digests) if small else digests, "digest")
    return hits.groupBy("doc_id", "license").agg(
        F.max(F.col("unit") == "text").alias("whole_text"),
        F.count_if(F.col("unit") == "paragraph").alias("n_paragraphs"),
        F.count_if(F.col("unit") == "line").alias("n_lines"),
    )
