from __future__ import annotations

import re

import pytest

from tickloom.llm import quotes


@pytest.fixture
def messages_of(spark):
    def make(rows):
        extra = ("c", "t", "parent", "depth", "thread", "chat", "level", "p", "up", "h")
        return spark.createDataFrame([(*r, *extra) for r in rows], "conv_id long, turn long, role string, text string, "
                                     + ", ".join(f"{x} string" for x in extra))
    return make


def plain(rows):
    """[(conversation, turn, role, text, reply_to, thread, depth)] by looking every quote up."""
    split = lambda x: (len(re.match(r"(?:(?:[ \t]*>)+[ \t]?)?", x)[0].replace(" ", "").replace("\t", "")),        # noqa: E731
                       re.sub(r"[ \t\r]+", " ", re.sub(quotes.MARK, "", x).lower()).strip(" "))
    said, parent = {}, {}
    for c, t, _, text in rows:
        for line in (text or "").split("\n"):
            level, p = split(line)
            if level == 0 and p and c is not None and t is not None:
                said[c, p] = min(t, said.get((c, p), t))
    for c, t, _, text in rows:
        for line in (text or "").split("\n"):
            level, p = split(line)
            if level == 1 and p and c is not None and t is not None and said.get((c, p), t) < t:
                parent[c, t] = max(said[c, p], parent.get((c, t), said[c, p]))
    out = []
    for c, t, role, text in rows:
        at, depth = t, 0
        while (c, at) in parent:
            at, depth = parent[c, at], depth + 1
        own = None if text is None else "\n".join(x for x in text.split("\n") if split(x)[0] == 0)
        out.append((c, t, role, own, parent.get((c, t)), at, depth))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.conv_id, r.turn, r.role, r.text, r.reply_to, r.thread, r.depth) for r in df.collect()), key=str)


ROWS = [(1, 0, "user", "First question\nwith a second line"), (1, 1, "assistant", "> First  QUESTION\nAn answer"),
        (1, 2, "user", "> An answer\n>> First question\nthanks"), (1, 3, "user", ">with a second line\nother branch"),
        (1, 4, "x", "> An answer\n> First question\nboth"), (1, 5, None, "> said by nobody\n> later\nhm"), (1, 6, "x", "later"),
        (1, 7, "x", "> my own\nmy own"), (2, 0, "u", "An answer"), (2, 1, "u", "> First question\nanother conversation"),
        (3, 0, "u", None), (3, 1, "u", ""), (3, 2, "u", "> \n>\n"), (None, 0, "u", "First question"), (None, 1, "u", "> First question"),
        (4, None, "u", "> First question"), (1, 2, "user", "> An answer\n>> First question\nthanks"), (1, 4, "y", "> First question\nagain"),
        (5, 0, "u", "word " * 30_000), (5, 1, "u", "> " + "word " * 30_000 + "\nyes"), (6, 3, "u", "first in line"), (6, 9, "u", ">first in line")]


def test_links_levels_and_odd_rows(messages_of):
    out = quotes.linked_conversations(messages_of(ROWS))
    assert got(out) == plain(ROWS)
    row = out.where("conv_id = 1 AND turn = 1").first()
    assert row.chat == "<|assistant|>\nAn answer\n<|end|>" and row.n_quoted == 1 and row.level == "level"


def test_long_chains_and_hubs(messages_of):
    chain = [(1, i, "u", f"> message {i - 1}\nmessage {i}") for i in range(70)]
    hub = [(2, i, "u", "> the root\nme too" if i else "the root") for i in range(200)]
    out = quotes.linked_conversations(messages_of(chain + hub))
    assert got(out) == plain(chain + hub)
    assert {r.depth for r in out.where("conv_id = 1").collect()} == set(range(70))


def test_replies_come_after_their_parents(messages_of):
    seen = set()
    for r in quotes.linked_conversations(messages_of(ROWS)).orderBy("conv_id", "thread", "turn").collect():
        assert r.reply_to is None or (r.conv_id, r.reply_to) in seen
        seen.add((r.conv_id, r.turn))


def test_mail_of_the_given_conversations(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    out = quotes.linked_conversations(quotes.as_mail(given))
    texts = {(r.conv_id, r.turn): r.text for r in given.collect()}
    for r in out.collect():
        assert r.text == texts[r.conv_id, r.turn]
        assert r.turn == 0 or r.reply_to is not None


def test_empty_table(messages_of):
    assert quotes.linked_conversations(messages_of([])).count() == 0
