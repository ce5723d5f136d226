from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from tickloom.llm import lines


def plain(rows, sites=5, most=0.5):
    """[(key, n_lines, n_removed, text)] by exact counts."""
    spread = defaultdict(set)
    for _, text, _, site in rows:
        for line in (text or "").split("\n"):
            if site is not None:
                spread[line.strip(" \t\r")].add(site)
    out = []
    for key, text, _, _ in rows:
        if text is None:
            out.append((key, 0, 0, None))
            continue
        every = text.split("\n")
        bad = [x.strip(" \t\r") != "" and len(spread[x.strip(" \t\r")]) >= sites for x in every]
        size = [len(x.strip(" \t\r")) for x in every]
        cut = any(bad) and sum(n for n, b in zip(size, bad) if b) <= most * sum(size)
        out.append((key, len(every), sum(bad) * cut, "\n".join(x for x, b in zip(every, bad) if not b) if cut else text))
    return out


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in df.collect()), key=str)


def test_boilerplate_at_and_around_the_threshold(docs_of):
    rows = []
    for n in range(1, 25):       # a line on n sites, twice on the last
        for s in [*range(n), n - 1]:
            rows.append((len(rows), f"own text number {len(rows)} of some length\n  shared by {n}\t\r\n\nmore own text {len(rows)}", "en", f"s{s}"))
    assert got(lines.without_boilerplate(docs_of(rows))) == sorted(plain(rows), key=str)


def test_copies_of_documents_are_left_whole(docs_of):
    rows = [(i, "a whole article\nwith two lines", "en", f"s{i}") for i in range(12)]
    assert all(r.text == rows[0][1] and r.n_removed == 0 for r in lines.without_boilerplate(docs_of(rows)).collect())


def test_odd_rows(docs_of, odd_rows):
    rows = [(k, t, "en", None if i % 5 == 0 else f"s{i % 7}") for i, (k, t) in enumerate(odd_rows)]
    rows += [(k, f"{t or ''}\nfooter of them all", "en", f"s{i % 9}") for i, (k, t) in enumerate(odd_rows)]
    rows += [(None, "x\n" * 4000 + "footer of them all", "en", "s1")] * 2
    docs = docs_of(rows, clash=True)
    out = lines.without_boilerplate(docs)
    assert got(out) == sorted(plain(rows), key=str)
    assert set(docs.columns) < set(out.columns)
    assert all(r.n_chars == len(r.text) for r in out.where("n_removed > 0").collect())


def test_empty_table(docs_of):
    assert lines.without_boilerplate(docs_of([])).count() == 0


def test_the_pipeline_removes_every_common_line_beside_own_ones(spark, docs_of):
    passage = "\n".join(f"a long passage that every site carries, line {i}" for i in range(9))
    rows = [(i, f"{passage}\n\nown {i}", "en", f"s{i}") for i in range(8)] + [(20, passage, "en", "s1"), (21, None, "en", "s2")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs_of(rows), "").collect()}
    assert got == {i: (f"\nown {i}", len(f"\nown {i}")) for i in range(8)} | {20: (passage, len(passage)), 21: (None, None)}


def test_names_do_not_clash(docs_of, odd_rows):
    from pyspark.sql import functions as F
    docs = docs_of(odd_rows, clash=True)
    for c in ("__marks", "__lines", "__cut", "marks_", "LINES", "cut_", "Cut"):
        docs = docs.withColumn(c, F.lit("kept"))
    out = lines.without_boilerplate(docs)
    assert out.columns == docs.columns + ["n_lines", "n_removed"]
    assert {r["__marks"] + r["marks_"] + r["LINES"] for r in out.collect()} == {"kept" * 3}
