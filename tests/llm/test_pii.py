from __future__ import annotations

import re

import regex
from pyspark.sql import functions as F

from tickloom.llm import pii

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1])))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != 3 or 9 <= len(digits) <= 15


def plain(rows):
    """The spans of each text: base patterns, and the terms of exact counts over distinct lines."""
    base = [[(k, m.start(), m.end(), m[0]) for k, p in enumerate(PLAIN) for m in re.finditer(p, t or "") if good(k, m[0])]
            for _, t in rows]
    name = lambda k, v: (k, v.lower() if k == 0 else v if k == 1 else re.sub("[^0-9]", "", v))       # noqa: E731
    words = lambda x: set(regex.findall(r"\p{L}{3,}", re.sub(PLAIN[0], " ", x).lower()))             # noqa: E731
    lines, of = set(), {}
    for (_, t), found in zip(rows, base):
        if t is not None:
            lines |= set(t.split("\n"))
            for k, s, _, v in found:
                of.setdefault(name(k, v), set()).add(t.split("\n")[t[:s].count("\n")])
    spread = {}
    for x in lines:
        for w in words(x):
            spread[w] = spread.get(w, 0) + 1
    disclosing = {}
    for c, xs in of.items():
        for w in set().union(*map(words, xs)):
            n = sum(w in words(x) for x in xs)
            if 2 * n >= spread[w] + 1:
                disclosing[c, w] = 3 * n >= 2 * (spread[w] + 1)
    out = []
    for (_, t), found in zip(rows, base):
        held = {name(k, v) for k, _, _, v in found}
        terms = []
        for m in regex.finditer(PLAIN[0].replace("(", "(?:") + r"|\p{L}+", t or ""):
            gone = [r for (c, w), r in disclosing.items() if c in held and w == m[0].lower()]
            if gone:
                terms.append((4 if any(gone) else 5, m.start(), m.end()))
        out.append(sorted([f[:3] for f in found] + terms))
    return out


ODD = ["a@b.co, c@d.e_f@g.hi x.y@z", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
       "+1 (377) 555-0271, +12, +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "4111--1111 41111111111111111111111111", "é.a@b.co 🙂x@y.zz 🙂🙂 1.2.3.4",
       "", None, "@", "a" * 60_000, "a" * 30_000 + "@b." + "c." * 20_000, "1 " * 40_000, "1" * 50_000, "+" * 30_000,
       "+1" + " ()-." * 9_000, "\n".join(["mail me: z@q.org"] * 2000)]


def spans_of(df):
    return [[tuple(s) for s in r.spans] for r in df.orderBy("doc_id").collect()]


def test_patterns_and_odd_texts(docs_of):
    rows = list(enumerate(ODD))
    assert spans_of(pii.spans(docs_of(rows, clash=True))) == plain(rows)


def test_disclosing_terms(docs_of):
    rows = [(i, f"Dr Quillfeather writes from bob@corp.example number {i}\nan unrelated line about Quillfeather") for i in range(4)]
    rows += [(10 + i, f"the writes of others {i}\nand more from Dr elsewhere") for i in range(9)]
    rows += [(30 + i, "copied text with al@corp.example and Zanzibar") for i in range(6)]        # one distinct line only
    want = plain(rows)
    assert spans_of(pii.spans(docs_of(rows))) == want
    kinds = {s[0] for r in want for s in r}
    assert kinds == {0, 5} or kinds == {0, 4, 5}
    shuffled = spans_of(pii.spans(docs_of(rows).repartition(5)))
    assert shuffled == want


def test_terms_joined_by_shuffle(docs_of, monkeypatch):
    monkeypatch.setattr(pii, "SMALL", 0)
    rows = [(i, f"Quillfeather of bob@corp.example {i}") for i in range(5)]
    assert spans_of(pii.spans(docs_of(rows))) == plain(rows)


def test_a_name_beside_an_address_seen_once_goes_and_a_common_word_stays(docs_of):
    rows = [(1, "please write to Quillfeather at bob@corp.example today")]
    rows += [(10 + i, f"please write to others at noon today {i}") for i in range(3)]
    texts = {r.doc_id: r.text for r in pii.sanitised(docs_of(rows)).collect()}
    assert texts[1] == "please write to [TERM] at [EMAIL] today"
    assert all(texts[k] == t for k, t in rows[1:])


def test_a_name_met_again_and_again_is_removed(docs_of):
    rows = [(i, f"Quillfeather mails from bob@corp.example {i}") for i in range(3)] + [(10 + i, f"mails from others {i}") for i in range(4)]
    rows += [(20, "Zanzibar and bob@corp.example"), (21, "Zanzibar and others")]
    texts = {r.doc_id: r.text for r in pii.sanitised(docs_of(rows)).collect()}
    assert texts[0] == " mails from [EMAIL] 0" and texts[20] == "Zanzibar and [EMAIL]"


def test_terms_by_broadcast_or_shuffle_of_many_documents(docs_of, monkeypatch):
    import random
    rng = random.Random(5)
    names = [f"{a}{b}" for a in ("quill", "zan", "mor", "tab") for b in ("feather", "zibar", "ris", "ula")]
    rows = [(i, "\n".join(" ".join(rng.choice(names + ["the", "and", "with"] * 6) for _ in range(6))
                          + (f" u{rng.randrange(9)}@corp.example" if rng.random() < 0.3 else "") for _ in range(3))) for i in range(150)]
    want = plain(rows)
    assert spans_of(pii.spans(docs_of(rows))) == want
    monkeypatch.setattr(pii, "SMALL", 0)
    assert spans_of(pii.spans(docs_of(rows))) == want


def test_sanitised_text(docs_of):
    rows = [(1, "call +1 (377) 555-0271 or a@b.co now"), (2, None), (3, "clean"), (None, "ip 1.2.3.4"), (1, "call +1 (377) 555-0271 or a@b.co now")]
    rows += [(10 + i, f"Quillfeather {i} bob@corp.example") for i in range(3)] + [(20 + i, f"call now {i}") for i in range(2)]
    docs = docs_of(rows, clash=True).withColumn("k_", F.lit(1)).withColumn("H", F.lit(2))
    out = pii.sanitised(docs)
    assert out.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert texts == sorted([(1, "call [PHONE] or [EMAIL] now")] * 2 + [(2, None), (3, "clean"), (None, "ip [IP]")]
                           + [(10 + i, f" {i} [EMAIL]") for i in range(3)] + [(20 + i, f"call now {i}") for i in range(2)], key=str)


def test_repeated_rows_null_keys_and_empty_table(docs_of):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co"), (None, None)]
    assert [len(r) for r in spans_of(pii.spans(docs_of(rows)).orderBy("doc_id"))] == [0, 1, 1, 1] or \
        sorted(len(r) for r in spans_of(pii.spans(docs_of(rows)))) == [0, 1, 1, 1]
    assert pii.spans(docs_of([])).count() == 0


def test_written_digest(docs_of):
    row = pii.spans(docs_of([(1, "b@c.de 9.9.9.9")])).select(pii.written(4).alias("w"), pii.count_of(0).alias("n")).first()
    assert (row.w, row.n) == ("email:0:6,ip:7:14", 1)
    assert pii.spans(docs_of([(1, "")])).select(F.sha2(pii.written(4), 256).alias("w")).first().w.startswith("e3b0c442")
