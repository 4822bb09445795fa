"""License scans: MinHash bands retrieve templates, exact shingle containment verifies them.

Words are lower-case runs of letters, digits and non-ASCII characters. Every text is read through
overlapping windows: two consecutive five-word shingles, each window one word further. A window's
MinHash values under eight hash functions are its bands (one row each); a template's windows
are banded alike, and a text is a candidate for a template when any band meets. A template
shingle that stands in a text is the least of one of its two windows under a function with
probability 2/3, so a template of a single shingle is retrieved with probability 1 - 3^-8, and
one with two intact neighbours always, as equal windows have equal bands. Candidates are verified
over the whole text: the share of the template's distinct shingles that occur in it.

Only DataFrame operations run; nothing leaves the JVM.

Edge cases: null texts, and texts or templates of fewer than five words, have no shingle and match
nothing; repeated shingles count once; rows that share an id are one document (a null id too). An
empty table of texts or templates gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclograin.operators.attach import settled

SHINGLE = 5
BANDS = 8
CONTAINMENT = 0.8
#: template rows up to which the template side is broadcast; larger sets are joined by a shuffle
BROADCAST_ROWS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Notices that name a public license.
NOTICES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "agpl-3.0-section-13": (
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer "
        "all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to "
        "receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no "
        "charge, through some standard or customary means of facilitating copying of software."
    ),
    "bsd-3-clause-notice": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."
    ),
    "cc0-1.0-notice": "has waived all copyright and related or neighboring rights to",
}
# The part of a notice that tells it from its neighbours: each differs from all others in over a fifth of its shingles.
for _license, _name, _version in (("gpl-2.0", "", "2"), ("lgpl-2.1", "Lesser ", "2.1"), ("lgpl-3.0", "Lesser ", "3"), ("agpl-3.0", "Affero ", "3")):
    NOTICES[f"{_license}-notice"] = (
        f"terms of the GNU {_name}General Public License as published by the Free Software Foundation, either version {_version} of the License"
    )
for _kind, _words in (("by", ""), ("by-sa", "-ShareAlike"), ("by-nd", "-NoDerivatives"), ("by-nc", "-NonCommercial"),
                      ("by-nc-sa", "-NonCommercial-ShareAlike"), ("by-nc-nd", "-NonCommercial-NoDerivatives")):
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        NOTICES[f"cc-{_kind}-{_version}-line"] = f"is licensed under a Creative Commons Attribution{_words} {_version} {_port} License."
        NOTICES[f"cc-{_kind}-{_version}-short"] = f"Licensed under CC {_kind.upper()} {_version}."
# the given notices keep their wording
NOTICES["cc-by-4.0-line"] = "This work is licensed under a Creative Commons Attribution 4.0 International License."
NOTICES["cc-by-nc-4.0-line"] = NOTICES.pop("cc-by-nc-4.0-short")

#: words of a passage of a whole text, at least
PASSAGE = 12


def _passages(text: str) -> list[str]:
    """A text's paragraphs, short ones joined with those that follow."""
    out: list[str] = []
    open_ = False
    for paragraph in re.split(r"\n\s*\n", text):
        if open_:
            out[-1] += "\n\n" + paragraph
        else:
            out.append(paragraph)
        open_ = len(out[-1].split()) < PASSAGE
    if open_ and len(out) > 1:
        out[-2:] = ["\n\n".join(out[-2:])]
    return out


def _table() -> dict[str, str]:
    """Notices, whole license texts, and (``license/number``) the passages of each, as a document may hold some clauses only."""
    out = dict(NOTICES)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        out[path.stem] = path.read_text(encoding="utf-8")
        out |= {f"{path.stem}/{k:02d}": p for k, p in enumerate(_passages(out[path.stem]), 1)}
    return out


TEMPLATES = _table()


def templates(spark: SparkSession) -> DataFrame:
    """The built-in ``template, text`` table."""
    rows = [F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in TEMPLATES.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.template", "t.text")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def _placed(df: DataFrame, key: str) -> DataFrame:
    """One row per shingle: the key, the words and the shingle's place ``i``."""
    texts = df.select(F.col(key).alias("key"), words(F.col("text")).alias("w"))
    last = F.size("w") - SHINGLE
    return texts.filter(last >= 0).withColumn("i", F.explode(F.sequence(F.lit(0), last)))


def _shingle_hash(offset: int) -> Column:
    # beyond the last shingle of a text there is none
    parts = [F.get("w", F.col("i") + offset + k) for k in range(SHINGLE)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(*parts))


def _shingle_text(offset: int = 0) -> Column:
    return F.concat_ws(" ", *[F.get("w", F.col("i") + offset + k) for k in range(SHINGLE)])


def banded(df: DataFrame, key: str) -> DataFrame:
    """``key, band``: the MinHash values of every window, each under its own function."""
    hashed = _placed(df, key).select("key", _shingle_hash(0).alias("a"), _shingle_hash(1).alias("b"))
    least = [F.least(F.xxhash64("a", F.lit(k)), F.when(F.col("b").isNotNull(), F.xxhash64("b", F.lit(k)))) for k in range(BANDS)]
    return hashed.select("key", F.explode(F.array(*least)).alias("band"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """``id, template, n_shared, n_template, containment, first_word, last_word`` of every match.

    ``known`` has columns ``template`` and ``text``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bands = settled(banded(known, "template").distinct().withColumnRenamed("key", "template"))
    shingles = _placed(known, "template").select(F.col("key").alias("template"), _shingle_text().alias("s")).distinct()
    shingles = settled(shingles)
    few = max(bands.count(), shingles.count()) <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    found = settled(banded(rows, "id").join(small(bands), "band").select(F.col("key").alias("id"), "template").distinct())
    ids = found.select(F.col("id").alias("hit")).distinct()
    texts = rows.join(ids, F.col("id").eqNullSafe(F.col("hit")), "left_semi")
    placed = _placed(texts, "id").select(F.col("key").alias("id"), "i", _shingle_text().alias("s"))
    shared = placed.join(small(shingles), "s").groupBy("id", "template")
    shared = shared.agg(F.count_distinct("s").alias("n_shared"), F.min("i").alias("first_word"), (F.max("i") + SHINGLE - 1).alias("last_word"))
    sizes = shingles.groupBy("template").agg(F.count("*").alias("n_template"))
    same = F.col("m.id").eqNullSafe(F.col("f.id")) & (F.col("m.template") == F.col("f.template"))
    matched = shared.alias("m").join(found.alias("f"), same, "left_semi").join(sizes, "template")
    share = F.col("n_shared") / F.col("n_template")
    return matched.filter(share >= least).select("id", "template", "n_shared", "n_template", share.alias("containment"), "first_word", "last_word")
