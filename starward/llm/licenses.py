"""License notices and whole license texts in texts. DataFrame functions only.

Words are runs of letters and digits in lower case, shingles three words. A document is read in
windows of ``WINDOW`` shingles, one every ``STRIDE``; a template in windows at every place. A
window's MinHash signature are the smallest and the largest value of two hashes of its shingles,
and each of these four values is a band of its own: windows that agree in one are candidates.
Where a notice of at least WINDOW + STRIDE - 1 shingles is copied, some window lies inside it whole
and equals a window of the template, so it is found for certain; a copied notice of 3 shingles is
three quarters of some window and found with a chance of 1 - (1 / 4) ** 4, 99.6 %. Candidates are
confirmed by exact containment: the share of the template's distinct shingles that stand around
the place where the notice would be if the shingle that both windows have is the same one.

Templates are a short table given by the caller, of texts of any length. Their index has at
most four rows per word, and the shingles of a template stand in it once. A copy of a long template
agrees in thousands of windows that all point to the same place: only the first of a run of equal
windows is confirmed. Templates are looked up in blocks of about ``BLOCK`` windows, and of one template at
least; more templates take more passes over the documents. No text is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starward.sources.shared import write_shared

WINDOW, STRIDE, BLOCK = 4, 2, 50_000

# Common notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files, to deal in the Software without restriction",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MIT-notice": "Released under the MIT License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


# Whole texts of short licenses.
TEXTS = {
    "MIT-text": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC-text": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear
in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
""",
    "BSD-2-Clause-text": """
Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "Zlib-text": """
This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software.
3. This notice may not be removed or altered from any source distribution.
""",
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "license string, text string")


def license_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS.items()), "license string, text string")


def shingles(text: Column) -> Column:
    """Hashes of all shingles, in the order of the text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def of(one: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(one) - 2)
        return F.when(
            F.size(one) >= 3,
            F.transform(places, lambda k: F.xxhash64(*[F.element_at(one, k + n) for n in range(3)])),
        ).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(words), of), 1)


def hashed(text: Column) -> Column:
    """The shingles of a text under both hashes."""
    both = F.transform(
        F.array(shingles(text)),
        lambda own: F.struct(own.alias("own"), F.transform(own, lambda s: F.xxhash64(s)).alias("other")),
    )
    return F.element_at(both, 1)


def signature(found: Column, place: Column) -> Column:
    """The four band values of the window that starts at a place (from 0).

    The band is part of a value, so that values of different bands do not meet.
    """
    own, other = (F.slice(found[name], place + 1, F.lit(WINDOW)) for name in ("own", "other"))
    values = F.array_min(own), F.array_max(own), F.array_min(other), F.array_max(other)
    return F.array(*[value.bitwiseXOR(F.lit(band)) for band, value in enumerate(values)])


def shingle_place(found: Column, place: Column) -> Column:
    """Where the shingle is that gave a window the value ``value`` of band ``band``."""
    shingle = F.col("value").bitwiseXOR(F.col("band"))
    own, other = (
        F.array_position(F.slice(found[name], place + 1, F.lit(WINDOW)), shingle) for name in ("own", "other")
    )
    return (place - 1 + F.when(F.col("band") < 2, own).otherwise(other)).cast("int")


def stored_templates(templates: DataFrame) -> DataFrame:
    """The distinct templates with their shingles, numbered and dealt to blocks."""
    known = templates.select("license", F.col("text").cast("string").alias("text")).distinct()
    known = known.select("license", hashed(F.col("text")).alias("wanted")).where(F.size("wanted.own") > 0)
    known = write_shared(known.withColumn("template", F.monotonically_increasing_id()), "templates")
    # Two numbers per template go through one task.
    upto = F.sum("n").over(Window.orderBy("template").rowsBetween(Window.unboundedPreceding, -1))
    blocks = known.select("template", F.size("wanted.own").alias("n"))
    blocks = blocks.select("template", F.floor(F.coalesce(upto, F.lit(0)) / BLOCK).alias("block"))
    return known.join(blocks, "template")


def license_matches(
    documents: DataFrame,
    templates: DataFrame,
    containment: float = 0.8,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document and license found in it: key, license, containment, first_word, end_word.

    ``templates`` has columns license and text. ``containment`` is that of the best place, the
    first of equals; the words are those from its first shingle found there to its last. Templates of fewer than
    three words and null or empty texts match nothing. Rows that repeat a key or a license count
    as one; null keys and licenses are values. Other columns are not read, whatever their names.
    Texts are read whole, however long. Empty tables give an empty result. The templates are
    written to the shared folder and stay there as long as the result is in use.
    """
    rows = documents.select(F.col(key).alias("key"), hashed(F.col(text).cast("string")).alias("found"))
    size = F.size("found.own")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(STRIDE)))
    windows = rows.select("*", F.explode(places).alias("place"))
    place = F.col("place")
    windows = windows.select("*", F.posexplode(signature(F.col("found"), place)).alias("band", "value"))
    known = stored_templates(templates)
    blocks = known.agg(F.max("block")).first()[0] or 0
    parts = []
    for block in range(blocks + 1):
        # Bounded: about BLOCK windows and the texts they are from, or one template.
        own = known.where(F.col("block") == block).drop("block")
        last = F.greatest(F.size("wanted.own") - WINDOW, F.lit(0))
        index = own.select("template", "wanted", F.explode(F.sequence(F.lit(0), last)).alias("offset"))
        offset = F.col("offset")
        index = index.select("*", F.posexplode(signature(F.col("wanted"), offset)).alias("band", "value"))
        at = shingle_place(F.col("wanted"), offset).alias("at")
        index = index.select("template", "value", at).distinct()
        own = own.select("template", "license", F.col("wanted.own").alias("wanted"))
        met = windows.join(F.broadcast(index), "value")
        start = (shingle_place(F.col("found"), place) - F.col("at")).alias("start")
        met = met.select("key", "found.own", "place", "template", start)
        parts.append(met.join(F.broadcast(own), "template"))
    # Where the window before equals the template's whole, it has led to the same place already.
    start, size = F.col("start"), F.size("wanted")
    behind, before = place - STRIDE - start, place - STRIDE
    window = [
        F.slice(c, F.greatest(p, F.lit(0)) + 1, F.lit(WINDOW)) for c, p in (("own", before), ("wanted", behind))
    ]
    led = (before >= 0) & (behind >= 0) & (behind + WINDOW <= size) & (window[0] == window[1])
    found = reduce(DataFrame.union, parts).where(~led)

    slack = F.ceil(size * (1 - containment)).cast("int")
    low = F.greatest(start - slack, F.lit(0))
    around = F.slice("own", low + 1, F.greatest(start + size + slack - low, F.lit(0)))
    # In the order in which they first stand around the place.
    common = F.array_intersect(around, F.col("wanted"))
    share = F.size(common) / F.size(F.array_distinct("wanted"))
    shares = low.alias("low"), around.alias("around"), common.alias("common"), share.alias("share")
    found = found.select("key", "license", *shares)
    found = found.where(F.col("share") >= containment).select(
        "key",
        "license",
        "share",
        (F.col("low") + F.array_position("around", F.element_at("common", 1)) - 1).alias("first"),
        (F.col("low") + F.array_position("around", F.element_at("common", -1)) + 2).alias("end"),
    )
    best = found.groupBy("key", "license").agg(
        F.max(F.struct("share", (-F.col("first")).alias("back"), "end")).alias("m")
    )
    return best.select(
        F.col("key").alias(key),
        "license",
        F.col("m.share").alias("containment"),
        (-F.col("m.back")).alias("first_word"),
        F.col("m.end").alias("end_word"),
    )
