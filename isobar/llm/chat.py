"""Chat formatting with Spark expressions only.

Template, for each run of turns of one role::

    ### role:
    text
    <turn/>
    next text of the same role
    </turn>

Backslash, ``###``, ``</turn>`` and ``<turn/>`` inside a text get a backslash before them, which
:func:`read_back` takes off again, so no text can end a turn or open another. Roles are
URL-encoded, which leaves the usual ones as they are. The loss mask covers the assistant's texts
and nothing else: not the marks, nor the lines between two texts of one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END, NEXT = "\n</turn>\n", "\n<turn/>\n"
CONTROL = r"\\|###|</turn>|<turn/>"


def escape(text):
    return F.regexp_replace(text, CONTROL, r"\\$0")


def unescape(text):
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_col, formatted, loss_spans``.

    The collected turns are sorted by turn (null first), ties by role and then text; rows repeated
    in full stay repeated. Null role or text counts as empty, and a null ``conv_col`` is one
    conversation. ``loss_spans`` holds start (from 1) and length in code points of every text of
    ``trained_role``. The unit of work is a conversation, which has to fit a row anyway. No rows
    in, no rows out; other columns are ignored.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                    F.coalesce(text_col, F.lit("")).alias("text"))
    chats = rows.groupBy(conv_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    at = lambda i: F.element_at("turns", i.cast("int"))
    n = F.size("turns")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (at(i)["role"] != at(F.greatest(i - 1, F.lit(1)))["role"]))
    chats = chats.withColumn("starts", F.concat(starts, F.array(n + 1)))
    run = lambda j: F.slice("turns", F.element_at("starts", j), F.element_at("starts", j + 1) - F.element_at("starts", j))
    runs = F.transform(F.sequence(F.lit(1), F.size("starts") - 1), lambda j: F.struct(
        at(F.element_at("starts", j))["role"].alias("role"),
        F.transform(run(j), lambda t: escape(t["text"])).alias("texts")))
    chats = chats.select(conv_col, runs.alias("runs"))
    head = lambda r: F.concat(F.lit("### "), F.url_encode(r["role"]), F.lit(":\n"))
    whole = lambda r: F.concat(head(r), F.array_join(r["texts"], NEXT), F.lit(END))
    chats = chats.withColumn("formatted", F.array_join(F.transform("runs", whole), ""))
    no_spans = F.array().cast("array<struct<start:int,length:int>>")

    def text_spans(acc, r):
        inner = F.aggregate(
            r["texts"], F.struct((acc["at"] + F.length(head(r))).alias("at"), acc["spans"].alias("spans")),
            lambda a, t: F.struct((a["at"] + F.length(t) + len(NEXT)).alias("at"),
                                  F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(t).alias("length")))).alias("spans")))
        return F.struct((acc["at"] + F.length(whole(r))).alias("at"),
                        F.when(r["role"] == trained_role, inner["spans"]).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("runs", F.struct(F.lit(1).alias("at"), no_spans.alias("spans")), text_spans, lambda a: a["spans"])
    return chats.select(conv_col, "formatted", spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (array of role and text, parsed from ``formatted``) and
    ``loss_text`` (what ``loss_spans`` covers, unescaped, nothing between)."""
    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")

    def turns_of(block):
        line = F.substring_index(block, "\n", 1)
        role = F.url_decode(F.substring(line, 5, F.length(line) - 5))
        texts = F.split(F.substring(block, F.length(line) + 2, F.length(block)), NEXT, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    covered = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"], s["length"])))
    return chats.withColumns({"turns": F.flatten(F.transform(blocks, turns_of)), "loss_text": F.array_join(covered, "")})


def op8_chat(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    back = read_back(format_chats(rows.unionByName(more)))
    per_turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(per_turn, ""), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP8_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked as (
  select *, lag(role) over w is not distinct from role and lag(turn) over w is not null as goes_on,
         length(regexp_replace(text, '(\\|###|</turn>|<turn/>)', '+\1', 'g')) as escaped
  from rows window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(escaped + case when goes_on then 9 else 4 + length(role) + 2 + 9 end)::bigint as formatted_chars
from marked group by conv_id
"""
