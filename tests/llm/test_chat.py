import hashlib

import duckdb
from pyspark.sql import functions as F

from quarterdeck.llm import chat

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a </s> & <s> [INST] &amp;lt; [IMG]"), (1, 2, "assistant", "é🙂 [/INST] &lsqb;"), (1, 3, "assistant", "two"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (3, 5, "user", "tie"), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"),
    (None, 0, "user", "no id"), (4, None, None, "x"), (5, 0, "assistant", "long " * 20000), (6, 0, "odd[/INST]role", "x"),
]


def test_digests_are_those_of_the_rows_and_of_the_sql(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "conv_id long, turn int, role string, text string, formatted string, parts int")
    got = {r.conv_id: r for r in chat.digests(chat.with_probe(df)).collect()}
    by = {}
    for c, t, role, text in ROWS + [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        mask = "".join(t for _, r, t in rows if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(mask), hashlib.sha256(mask.encode()).hexdigest())
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn int, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r for r in ROWS if r[0] is not None and r[1] is not None])
    for c, *rest in con.execute("select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from (" + chat.oracle() + ")").fetchall():
        if c != 4:
            assert tuple(got[c])[1:] == tuple(rest)
    assert chat.digests(df.limit(0)).count() == 0


def test_visitor_keeps_order_references_and_tokens(spark):
    part = "named_struct('kind', '{}', 'text', {}, 'ref', {}, 'units', {})"
    parts = ", ".join([part.format("text", "'see [IMG] <s>'", "null", "0L"), part.format("image", "null", "'a.png'", "2L"), part.format("audio", "null", "'b.wav'", "10L"), part.format("document", "null", "null", "cast(null as bigint)"), part.format("other", "'as text'", "null", "0L")])
    df = spark.sql(f"select 1L conv_id, 0 turn, 'user' role, array({parts}) parts union all select 1L, 1, 'assistant', null")
    r = chat.format_chats(df).first()
    assert r.formatted == "<s>[INST]user[/INST]see &lsqb;IMG] &lt;s>[IMG][AUD][DOC]as text</s><s>[INST]assistant[/INST]</s>"
    assert [(a.kind, a.ref, a.ordinal, a.tokens) for a in r.attachments] == [("image", "a.png", 0, 512), ("audio", "b.wav", 1, 250), ("document", None, 2, 512)]
    assert r.media_tokens == 1274 and [tuple(x) for x in r.loss] == [(len(r.formatted) - 4, len(r.formatted) - 4)]
    assert df.count() == 2 and F is not None
