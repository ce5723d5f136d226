from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, or return, as extra columns of their input.
CLASHES = ("k t h w rid spans kind entity line place seed marks fp a b c parent root deep ids score chat keys held part extra "
           "lang_pred_2 text_hash component_id anchor m i value count").split()


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) or (id, text, lang, source); ``clash`` adds columns of clashing names."""
    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else f"s{i % 7}", None if r[1] is None else len(r[1]))
                for i, r in enumerate(rows)]
        schema = DOCS
        if clash:
            full = [r + tuple(str(i) for i in range(len(CLASHES))) for r in full]
            schema += "".join(f", {c} string" for c in CLASHES)
        return spark.createDataFrame(full, schema)
    return make


@pytest.fixture
def odd_rows():
    """Null key, null and empty texts, white space, repeated rows, repeated keys, long texts, one endless word."""
    return [(1, "one two three four"), (1, "one two three four"), (2, None), (3, ""), (4, " \n\t "), (5, "x"), (6, "x"),
            (None, "one two three four"), (None, None), (7, "word " * 30_000), (8, "a" * 50_000), (5, "other words here"),
            (9, "ünï cödé 漢字 🙂 text\nline two\r\n> three")]
