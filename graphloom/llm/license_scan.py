"""Licence notices in documents, in DataFrame operations only.

A text is read in overlapping windows of nine words (five shingles of five words, a new window every four shingles). Under
each of three hash functions a window keeps its smallest and its largest shingle hash; both together are a band of two rows.
Two windows of Jaccard similarity j share a band with probability 1 - (1 - j * j) ** 3: 0.83 where four of five shingles
are common (j = 4/6), and 1 where all are. Templates are indexed at every offset. A text that holds 80 % of the shingles of
a template of nine or more holds, whatever words are changed, left out or put in, eight of them in a row
(`guaranteed_run`), and a whole window of the text lies inside any eight: such a text is retrieved for certain. Shorter
templates promise no such run; their windows are single shingles. Candidates are then confirmed by exact containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

# Standard notices and texts of common public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "Apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause-full",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    ("BSD-3-Clause-third", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (
        "BSD-disclaimer",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "GPL-2.0-or-later-header",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-3.0-or-later-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see http://www.gnu.org/licenses/",
    ),
    (
        "LGPL-2.1-or-later-header",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0-or-later-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "MPL-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC-full",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
        "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    (
        "CC0-1.0-statement",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    (
        "FDL-1.3",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software "
        "Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    ),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
)

WORDS = "[a-z0-9]+"
WIDTH = 5


def guaranteed_run(shingles: int, percent: int, width: int = WIDTH) -> int:
    """Of a template of so many shingles, how many in a row stand in any text that holds percent of them: a changed,
    left out or inserted word breaks width - 1 shingles at least, so few breaks are possible."""
    least = -(-shingles * percent // 100)
    breaks = (shingles - least) // (width - 1)
    return -(-least // (breaks + 1))


def collision_probability(jaccard: float, functions: int = 3) -> float:
    """That two windows share a band: smallest and largest hash agree under one function at least."""
    return 1 - (1 - jaccard**2) ** functions


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words in order. Words are runs of a-z and 0-9 after lower-casing, so punctuation and line
    ends don't matter."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))


def shingle_at(words: str, at: Column) -> Column:
    """Hash of the shingle that starts at a place of an array of word hashes; null where it would pass the end."""
    return F.when(F.get(words, at + (WIDTH - 1)).isNotNull(), F.xxhash64(*[F.get(words, at + k) for k in range(WIDTH)]))


def shingles(words: str) -> Column:
    """Array of the hashes of all shingles in order; empty with fewer words."""
    return F.when(F.size(words) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(words) - WIDTH), lambda i: shingle_at(words, i))).otherwise(F.array().cast("array<bigint>"))


def band(values: list[str], function: int) -> Column:
    """Smallest and largest of some shingle hashes under a hash function, as one key; null values don't count."""
    each = [F.when(F.col(v).isNotNull(), F.xxhash64(v, F.lit(function))) for v in values]
    return F.when(F.col(values[0]).isNotNull(), F.xxhash64(F.lit(function), F.least(*each), F.greatest(*each)))


def windows(texts: DataFrame, keep: list[str], window: int, stride: int) -> DataFrame:
    """One row for each window of the texts (column words): keep, h0, h1 ... (its shingle hashes)."""
    starts = texts.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - WIDTH, F.lit(0)), F.lit(stride))).alias("at"))
    return starts.select(*keep, *[shingle_at("words", F.col("at") + i).alias(f"h{i}") for i in range(window)])


def scan(docs: DataFrame, templates: tuple = TEMPLATES, percent: int = 80, window: int = 5, stride: int = 4, functions: int = 3) -> DataFrame:
    """doc_id, license, n_shingles (of the template), n_found (of them in the document), for every row and template with
    100 * n_found >= percent * n_shingles.

    Whole texts are read; null and empty ones, and texts of fewer than five words, match nothing. A null doc_id is an
    identifier like others. Repeated rows give one match for each doc_id and text. templates is a parameter of some hundred
    notices at most, so its table is broadcast."""
    spark: SparkSession = docs.sparkSession
    model = spark.createDataFrame([(n, t) for n, t in templates], "license string, notice string").select("license", word_hashes(F.col("notice")).alias("words"))
    model = model.select("license", "words", F.array_distinct(shingles("words")).alias("goal")).where(F.size("goal") > 0)
    size = max(len(t) for _, t in templates)
    # Distinct shingles decide what a template must show, and fewer distinct ones than places only occur where it repeats itself.
    wide = {n for n in range(1, size) if guaranteed_run(n, percent) >= window + stride - 1}
    long = F.size("goal").isin(*sorted(wide)) & (F.size("goal") == F.size("words") - WIDTH + 1)
    names = [f"h{i}" for i in range(window)]
    whole = windows(model.where(long), ["license"], window, 1).where(F.col(names[-1]).isNotNull())
    keys = whole.select("license", F.explode(F.array(*[band(names, f) for f in range(functions)])).alias("band"))
    keys = keys.unionByName(model.where(~long).select("license", F.explode("goal").alias("band"))).groupBy("band").agg(F.collect_set("license").alias("licenses"))

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    read = windows(texts.select("doc_id", "_text", word_hashes(F.col("text")).alias("words")), ["doc_id", "_text"], window, stride)
    probes = read.select("doc_id", "_text", F.explode(F.array(*[band(names, f) for f in range(functions)], *names[:stride])).alias("band"))
    found = probes.join(F.broadcast(keys), "band").select("doc_id", "_text", F.explode("licenses").alias("license")).distinct()
    # Of known size once written, so that the join below is planned for it: by broadcast if small, else by sort and merge.
    candidates = stash(found.groupBy("doc_id", "_text").agg(F.collect_list("license").alias("licenses")), "license-candidates").withColumnsRenamed({"doc_id": "_doc", "_text": "_key"})
    rows = texts.join(candidates, texts["doc_id"].eqNullSafe(F.col("_doc")) & (texts["_text"] == F.col("_key"))).select("doc_id", word_hashes(F.col("text")).alias("words"), "licenses")
    own = rows.select("doc_id", shingles("words").alias("own"), F.explode("licenses").alias("license"))
    exact = own.join(F.broadcast(model.select("license", "goal")), "license").select("doc_id", "license", F.size("goal").cast("long").alias("n_shingles"), F.size(F.array_intersect("goal", "own")).cast("long").alias("n_found"))
    return exact.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent).distinct()
