"""Whole license texts, their clauses and the notices of common licenses."""

from __future__ import annotations

import re

from cyclograin.llm import licenses


def test_whole_texts_clauses_and_notices(spark):
    whole = {k: v for k, v in licenses.TEMPLATES.items() if k in ("bsd-3-clause", "bsd-2-clause", "apache-2.0", "gpl-3.0", "lgpl-2.1", "mpl-2.0", "mit", "isc", "cc-by-sa-4.0")}
    assert len(whole) == 9
    mit_end = whole["mit"][whole["mit"].index("THE SOFTWARE IS PROVIDED") :]
    gpl_end = whole["gpl-3.0"][whole["gpl-3.0"].index("15. Disclaimer of Warranty") : whole["gpl-3.0"].index("END OF TERMS")]
    notices = {
        "agpl-3.0-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or later",
        "lgpl-2.1-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "cc-by-nc-nd-3.0-short": "Photos: licensed under CC BY-NC-ND 3.0.",
    }
    rows = [*whole.items(), ("mit end", mit_end), ("gpl end", gpl_end), *(("n " + k, v) for k, v in notices.items())]
    docs = spark.createDataFrame([(k, f"Some words before it all. {v} And after.") for k, v in rows], "doc_id string, text string")
    found = {(r["id"], r["template"]): r["containment"] for r in licenses.scan(docs, licenses.templates(spark)).collect()}
    for k in whole:
        assert found[k, k] == 1, k
    # either BSD text holds four fifths of the other: the best containment and the third clause tell them apart
    assert found["bsd-2-clause", "bsd-3-clause"] < 1 and found["bsd-3-clause", "bsd-2-clause"] < 1
    assert ("bsd-3-clause", "bsd-3-clause-notice") in found and ("bsd-2-clause", "bsd-3-clause-notice") not in found
    for k in notices:
        assert found["n " + k, k] == 1, k
        assert {t for d, t in found if d == "n " + k} == {k}
    assert any(d == "mit end" and t.startswith("mit/") for d, t in found) and ("mit end", "mit") not in found
    assert any(d == "gpl end" and t.startswith("gpl-3.0/") for d, t in found) and ("gpl end", "gpl-3.0") not in found


def test_notices_are_told_apart():
    shingles = {}
    for k, v in licenses.NOTICES.items():
        w = [x for x in re.split(licenses.SEPARATORS, v.lower()) if x]
        shingles[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert shingles[k], k
    core = [k for k in shingles if k.endswith("-notice") or k.startswith("cc-")]
    for a in core:
        for b in core:
            assert a == b or len(shingles[a] & shingles[b]) < 0.8 * len(shingles[a]), (a, b)
