from __future__ import annotations

import re

from pyspark.sql import functions as F

from risklattice.llm import licenses as L

LIBRARY = L.notices()


def slow_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "...", "Under the MIT License", "under the mit license under the mit license", "CC BY-NC cc by nc by nc", "thunder the mit license",
    "é Apache License, Version 2.0 é", "apache license version 3", "Released under te MIT Licence.", "x " * 3000 + "under\nthe\tMIT-license " + "y" * 9000,
    "All rights reserved. GNU General Publik License", "apache license version 20", "cc by nd", "under the mit license" * 3,
]


def test_base_columns():
    for text in TEXTS:
        assert L.scan(text, LIBRARY)[:5] == slow_base(text), text


def test_fuzzy_labels_and_spans():
    got = {t: L.scan(t, LIBRARY) for t in TEXTS}
    r = got["Released under te MIT Licence."]
    assert (r[4], r[5]) == ("", "mit") and 0 < r[6] < 1
    label, phrase, first, last, start, end, edits, matched = r[7][0]
    assert (label, first, last, matched) == ("mit", 1, 4, "under te MIT Licence") and edits == 2
    assert got["apache license version 3"][5] == "" and got["cc by nd"][5] == ""
    assert got["All rights reserved. GNU General Publik License"][5] == "all-rights-reserved,gpl"
    for text, r in got.items():
        assert set(filter(None, r[4].split(","))) <= set(r[5].split(","))
        assert all(text[s[4] : s[5]] == s[7] for s in r[7])


def test_seeds_find_every_edit():
    phrase = "under the mit license"
    for i in range(len(phrase)):
        for j in range(i + 2, len(phrase)):
            edited = phrase[:i] + phrase[i + 1 : j] + "q" + phrase[j:]
            assert "mit" in L.scan(f"zz {edited} zz", LIBRARY)[5].split(","), edited


def test_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (3, TEXTS[3])], "doc_id long, text string").withColumn("labels", F.lit("own"))
    out = L.scan_documents(docs).collect()
    assert len(out) == len(TEXTS) + 2 and sum(r.base_labels == "mit" for r in out if r.n_words == 4) == 3
    assert L.scan_documents(docs.limit(0)).count() == 0
