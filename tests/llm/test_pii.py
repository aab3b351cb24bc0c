"""Disclosure of personal data against counts by hand."""

import math
import random
import re

from pyspark.sql import functions as F

from cidrloom.llm import op8_pii
from cidrloom.llm.kit import Tables


def _plain(rows, support=3, generalise=0.75, remove=0.95):
    """Told terms from the definition: n(t, e) and n(e) over distinct texts, n(t) and N over rows."""
    said = {}
    for text in {t for _, t in rows if t is not None}:
        mails = set(re.findall(r"[a-z0-9.]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", text))
        bare = re.sub(r"[a-z0-9.]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", lambda m: " " * len(m[0]), text)
        said[text] = mails, {w.lower() for w in re.findall(r"[^\W\d_][\w'-]*", bare) if len(w) > 2}
    total = sum(t is not None for _, t in rows)
    n_t, told = {}, {}
    for _, text in rows:
        for w in said.get(text, (set(), set()))[1]:
            n_t[w] = n_t.get(w, 0) + 1
    for e in {e for mails, _ in said.values() for e in mails}:
        with_e = [terms for mails, terms in said.values() if e in mails]
        n_e = len(with_e)
        for t in set().union(*with_e):
            n_te = sum(t in terms for terms in with_e)
            if n_te >= support and n_e < total:
                share = math.log(n_te * total / (n_t[t] * n_e)) / math.log(total / n_e)
                if share >= generalise:
                    told[t] = "removed" if share >= remove or told.get(t) == "removed" else "general"
    return told


def _rows():
    rng = random.Random(4)
    filler = [f"filler{i:c}{j:c}" for i in range(97, 110) for j in range(97, 110)]
    rows = []
    for i in range(400):
        words = rng.sample(filler, 12)
        k = i % 40
        if k < 8:
            words += [f"secret{chr(97 + k)}", f"mail{k}@example.org"] + ([f"often{chr(97 + k)}"] if i % 3 else [])
        if k in (9, 10):
            words += [f"often{chr(97 + k - 9)}" if i % 80 < 40 else "never", "secreta" if i == 9 else "nothing"]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(600, None), (601, ""), (None, rows[1][1])]
    return rows


def test_disclosure_equals_counts_by_hand(shared, monkeypatch):
    rows = _rows()
    df = shared.createDataFrame(rows, "doc_id long, t string").repartition(4)
    want = _plain(rows)
    assert {"removed", "general"} <= set(want.values())
    for bits in (1 << 18, 128):  # a full filter lets every word pass and changes nothing
        monkeypatch.setattr(op8_pii, "FILTER_BITS", bits)
        got = op8_pii.disclosing_terms(op8_pii.with_base(df, "t"), "t", Tables(shared))
        assert {r.term: r.kind for r in got.collect()} == want
        found = {r.doc_id: r.spans for r in op8_pii.find(df.withColumnRenamed("t", "text")).filter("doc_id is not null").collect()}
        for key, text in rows:
            if key is not None and text:
                spans = [(k, text[int(a) : int(b)].lower()) for k, a, b in (s.split(":") for s in found[key].split(",") if s)]
                bare = re.sub(r"[a-z0-9.]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", " ", text)
                expect = sorted((want[w.lower()], w.lower()) for w in re.findall(r"[^\W\d_][\w'-]*", bare) if w.lower() in want)
                assert sorted(s for s in spans if s[0] in ("general", "removed")) == expect


def test_a_filter_holds_all_of_its_terms(shared):
    words = shared.range(3000).select(F.concat(F.lit("w"), "id").alias("term"))
    asked = shared.range(20000).select(F.concat(F.lit("w"), "id").alias("term"), "id")
    passed = {r.id for r in asked.filter(op8_pii.may_hold(op8_pii.term_filter(words), F.col("term"))).collect()}
    assert set(range(3000)) <= passed and len(passed) < 3600
    assert asked.filter(op8_pii.may_hold(op8_pii.term_filter(words.limit(0)), F.col("term"))).count() == 0
