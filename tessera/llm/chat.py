"""Chat formatting by event-sourced reconstruction, in SQL functions only.

A log holds one event per row: (conversation, sequence, kind, message, role, text).  Events are
gathered per conversation, sorted by sequence and folded into final messages:

* ``message``     starts a message with a role and a text,
* ``delta``       appends a streamed piece to a message,
* ``edit``        replaces the text of a message,
* ``regenerate``  empties a message and drops all messages that started after it.

The messages are rendered with a template whose control strings cannot occur in a text: a control
string inside a text gets a backslash after its first character, one that already has k
backslashes there gets one more, and reading back takes one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

START, END = "<|turn|>", "<|end|>\n"
#: First character and rest of every control string, as regular expressions.
CONTROL = r"([<\[])(\\*)(\|turn\|>|\|end\|>|/s>|s>|INST\]|/INST\])"
ESCAPED = r"([<\[])\\(\\*)(\|turn\|>|\|end\|>|/s>|s>|INST\]|/INST\])"
EVENTS = ("conv_id", "seq", "kind", "msg", "role", "text")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def escape_role(c: Column) -> Column:
    """A role is one line: control strings and line feeds are escaped, percent sign first."""
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def turns_as_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """A table of finished turns as a log: each row is one ``message`` event of its own."""
    return turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("seq"), F.lit("message").alias("kind"),
                        F.lit(None).cast("string").alias("msg"), F.col(role).alias("role"), F.col(text).alias("text"))


CHANGES = ("delta", "edit", "regenerate")


def _dropped(log: Column) -> Column:
    """Disjoint spans (s, r) of a log: the regeneration at position r of the message started at s dropped what started between them.

    Only positions and names are folded, and of a run of events of one message only the first and the regenerations."""
    at = F.transform(log, lambda e, i: F.struct(i.alias("p"), e["kind"].alias("kind"), e["msg"].alias("msg"), F.get(log["msg"], i - 1).alias("last")))
    heads = F.filter(at, lambda e: e["msg"].isNotNull() & ((e["kind"] == "regenerate") | ~e["msg"].eqNullSafe(e["last"])))
    start = F.expr("struct(cast(array() as array<struct<msg:string,p:int>>) AS live, cast(array() as array<struct<s:int,r:int>>) AS spans)")

    def step(state: Column, e: Column) -> Column:
        place = F.coalesce(F.array_position(state["live"]["msg"], e["msg"]), F.lit(0)).cast("int")
        s = F.get(state["live"], place - 1)["p"]
        drops = F.concat(F.filter(state["spans"], lambda x: x["s"] < s), F.array(F.struct(s.alias("s"), e["p"].alias("r"))))
        return (F.when(place == 0, F.struct(F.concat(state["live"], F.array(F.struct(e["msg"].alias("msg"), e["p"].alias("p")))).alias("live"), state["spans"].alias("spans")))
                .when(e["kind"] == "regenerate", F.struct(F.slice(state["live"], F.lit(1), place).alias("live"), drops.alias("spans")))
                .otherwise(state))

    return F.aggregate(heads, start, step, lambda state: state["spans"])


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<msg, role, text>>), one row per conversation.

    Nulls: a null text or role is empty, a null kind is ``message``, a null message name
    belongs to this event alone, null conversations form one conversation and a null sequence comes first.
    Events of one sequence are taken in the order kind, message, role, text.  A delta, edit or regeneration
    of an unknown message starts it.  An unknown kind counts as ``message``; a ``message`` event of a name in use is one more
    message, which no later event changes.  A conversation's log is one row, as its rendered text has to be.

    Every log takes one way, linear in its texts: its events are grouped by message, a message's events are folded into its
    text (the last replacement and the deltas after it), and the messages meet again in their order.  Events are
    shuffled once.  Logs with regenerations first find the dropped spans (``_dropped``).
    """
    event = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), "msg",
                     F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id").agg(F.sort_array(F.collect_list(event)).alias("log"))
    again = F.exists("log", lambda e: e["kind"] == "regenerate")
    logs = logs.withColumn("spans", F.when(again, _dropped(F.col("log"))).otherwise(F.expr("cast(array() as array<struct<s:int,r:int>>)")))
    tagged = F.transform("log", lambda e, i: F.struct(
        i.alias("p"), e["kind"].alias("kind"), e["msg"].alias("msg"), e["role"].alias("role"), e["text"].alias("text"),
        F.exists("spans", lambda x: (x["s"] < i) & (i < x["r"])).alias("gone")))
    flat = logs.select("conv_id", F.inline(tagged))
    own = F.when(F.col("msg").isNull(), F.col("p")).alias("own")
    groups = flat.groupBy("conv_id", "msg", own).agg(F.sort_array(F.collect_list(F.struct("p", "kind", "role", "text", "gone"))).alias("log"))
    # a message starts at its first event outside the dropped spans; what came before went with them
    groups = groups.withColumn("first", F.get(F.filter("log", lambda e: ~e["gone"]), F.lit(0))).where(F.col("first").isNotNull())
    since = F.filter("log", lambda e: (e["p"] == F.col("first.p")) | ((e["p"] > F.col("first.p")) & e["kind"].isin(*CHANGES)))
    base = F.array_max(F.transform(F.filter("since", lambda e: (e["p"] == F.col("first.p")) | (e["kind"] != "delta")), lambda e: e["p"]))
    text = F.array_join(F.transform(F.filter("since", lambda e: e["p"] >= F.col("base")), lambda e: e["text"]), "")
    more = F.filter("log", lambda e: (e["p"] > F.col("first.p")) & ~e["kind"].isin(*CHANGES) & ~e["gone"])
    message = lambda e, text: F.struct(e["p"].alias("p"), F.col("msg").alias("msg"), e["role"].alias("role"), text.alias("text"))
    parts = groups.withColumn("since", since).withColumn("base", base).select("conv_id", F.concat(
        F.array(message(F.col("first"), text)), F.transform(more, lambda e: message(e, e["text"]))).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("all"))
    return whole.select("conv_id", F.transform("all", lambda m: F.struct(m["msg"].alias("msg"), m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def render(messages: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (0-based start and length in code points of every assistant text)."""
    parts = messages.withColumn("__parts", F.transform("messages", lambda m: F.struct(
        F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"),
        (m["role"] == "assistant").alias("loss"))))
    parts = parts.withColumn("__parts", F.transform("__parts", lambda p: F.struct(
        p["head"].alias("head"), p["body"].alias("body"), p["loss"].alias("loss"),
        F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"))))
    spans = F.aggregate(
        "__parts",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + p["h"] + p["b"] + len(END)).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + p["h"]).alias("start"), p["b"].alias("length")))))
            .otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return parts.select("conv_id", "messages", text.alias("formatted"), spans.alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, messages, formatted, loss_spans) of an event log with the columns EVENTS."""
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_texts array<string>, formatted), parsed from the rendered text alone."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)
    turns = F.transform(pieces, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(p.substr(F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END))).alias("text")))
    losses = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"])))
    return formatted.select("conv_id", turns.alias("turns"), losses.alias("loss_texts"), "formatted")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    back = read_back(format_chats(turns_as_events(chats.unionByName(extra))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_CONTROL_SQL = CONTROL.replace("'", "''")
OP2_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, '{START}' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '{_CONTROL_SQL}', '\1\\\2\3', 'g') || chr(10)
       || regexp_replace(text, '{_CONTROL_SQL}', '\1\\\2\3', 'g') || '{END.strip()}' || chr(10) AS piece FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
