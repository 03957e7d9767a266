"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is a list of parts, each text, image, audio or document. The visitor turns a part into text: text is escaped
reversibly, an attachment becomes a placeholder of its kind, its reference is recorded in order, and its token count is
the expansion of that kind. A turn is `<s>[INST]role[/INST]body</s>`; the loss mask holds the assistant's bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, END = "<s>[INST]", "[/INST]", "</s>"
#: Placeholder of each kind of attachment, and the tokens that one unit (tile, second, page) expands to.
PLACEHOLDERS = {"image": ("[IMG]", 256), "audio": ("[AUD]", 25), "document": ("[DOC]", 512)}
ESCAPES = [("&", "&amp;"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>")] + [(x, "&lsqb;" + x[1:]) for x in ("[INST]", "[/INST]", "[IMG]", "[AUD]", "[DOC]")]
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    """Control strings inside a text lose their first character to an entity; everything else stays."""
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for safe, raw in (("&lt;", "<"), ("&lsqb;", "["), ("&amp;", "&")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _by_kind(kind: Column, text: Column, of) -> Column:
    out = None
    for name, spec in PLACEHOLDERS.items():
        out = (F.when if out is None else out.when)(kind == name, of(*spec))
    return out.otherwise(text)


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part; null is empty text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))


def format_chats(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, parts array<struct<kind, text, ref, units>>) to a row for each conversation.

    Columns: conv_id; formatted; loss, spans (start, end) of code points of formatted; attachments (kind, ref, ordinal,
    tokens) in order; media_tokens, their sum. Turns stand by number; ties by role, then content. Null roles, texts and
    part lists are empty; a part of unknown kind counts as text. A null conv_id is a conversation of its own. An empty
    table gives no rows; other columns are not read.
    """
    seen = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    flat = seen.select(
        "conv_id", "turn", "role",
        F.array_join(F.transform("parts", lambda p: _by_kind(p["kind"], escape(F.coalesce(p["text"], F.lit(""))), lambda mark, _: F.lit(mark))), "").alias("body"),
        F.transform(
            F.filter("parts", lambda p: p["kind"].isin(*PLACEHOLDERS)),
            lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), (_by_kind(p["kind"], F.lit(0), lambda _, n: F.lit(n)) * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens")),
        ).alias("media"),
    )
    turns = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "media"))).alias("turns"))
    piece = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(HEAD), t["body"], F.lit(END))
    start = lambda t: F.lit(len(OPEN) + len(HEAD)) + F.length(escape(t["role"]))
    laid = turns.select(
        "conv_id", F.array_join(F.transform("turns", piece), "").alias("formatted"),
        F.aggregate(
            F.transform("turns", lambda t: F.struct(start(t).alias("head"), F.length(t["body"]).alias("body"), (t["role"] == "assistant").alias("loss"))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
            lambda acc, t: F.struct(
                (acc["at"] + t["head"] + t["body"] + len(END)).alias("at"),
                F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["body"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
            ),
        )["spans"].alias("loss"),
        F.transform(F.flatten(F.transform("turns", lambda t: t["media"])), lambda m, i: F.struct(m["kind"].alias("kind"), m["ref"].alias("ref"), i.alias("ordinal"), m["tokens"].alias("tokens"))).alias("attachments"),
    )
    return laid.withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, m: a + m["tokens"]))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted) from the formatted text and its mask alone."""
    pieces = F.filter(F.split("formatted", END, -1), lambda s: s != "")
    turn = lambda s: F.struct(
        unescape(F.substring_index(s.substr(F.lit(len(OPEN) + 1), F.length(s)), HEAD, 1)).alias("role"),
        unescape(s.substr(F.locate(HEAD, s) + len(HEAD), F.length(s))).alias("text"),
    )
    return chats.select(
        "conv_id", F.transform(pieces, turn).alias("turns"), "formatted",
        F.array_join(F.transform("loss", lambda x: unescape(F.col("formatted").substr(x["start"] + 1, x["end"] - x["start"]))), "").alias("loss_text"),
    )


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations(conv_id, turn, role, text), as counts and SHA-256."""
    back = read_back(format_chats(conversations.withColumn("parts", text_parts(F.col("text")))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -1, whose texts are control strings."""
    probe = conversations.sparkSession.sql(f"select * from values (-1L, 0, 'user', '{PROBE}'), (-1L, 1, 'assistant', '{PROBE}') as t(conv_id, turn, role, text)")
    kinds = {f.name: f.dataType for f in conversations.schema.fields}
    same = probe.select(*[F.col(c).cast(kinds[c]).alias(c) for c in probe.columns])
    return conversations.select(*probe.columns).unionByName(same)


def oracle() -> str:
    """DuckDB SQL of the digests."""
    safe = "{}"
    for raw, mark in ESCAPES:
        safe = f"replace({safe}, '{raw}', '{mark}')"
    role, text = safe.format("r"), safe.format("t")
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}')
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (where r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (where r = 'assistant'), '')) loss_sha256,
  cast(sum(length({role}) + length({text}) + {len(OPEN) + len(HEAD) + len(END)}) as bigint) formatted_chars
from rows group by conv_id"""
