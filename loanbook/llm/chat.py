"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log holds events (conv_id, seq, turn, kind, role, text) of these kinds:

* ``message`` opens the turn with a role and a first text. If the turn is open
  already, it starts anew.
* ``delta`` appends its text to the turn (a streamed piece).
* ``edit`` replaces the turn's text by its own.
* ``regenerate`` empties the turn's text and takes back what the log has said
  so far of later turns.

``fold`` brings the log to the final messages. ``render`` writes them in the
template as parts of at most ``PART`` turns numbers of a conversation, with
the spans that the loss counts; ``read_back`` takes parts apart again.

Template: every turn is ``<s>`` header text ``</s>``. The header of a user is
``[INST] `` (closed by `` [/INST]``), an assistant has none, every other role
is written out as ``[ROLE]`` role ``[/ROLE]``. Control strings in a text or a
role get a backslash after their first character; one that has backslashes
there already gets one more, so taking one away restores the text.

A long conversation is split by turn number: no task holds more than ``PART``
turns of it before the parts are joined to one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanbook.llm.tables import only

#: turn numbers of a part
PART = 256
#: characters of a streamed delta in a replayed log
DELTA = 400
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|/?ROLE\])"


def escape(text: Column) -> Column:
    """The text without any control string."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def replay(rows: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log that ends in the messages of ``rows`` (conv_id, turn, role,
    text): a message for every row, and an assistant's text streamed in deltas
    of ``delta`` characters. A null text is an empty one."""
    r = only(rows, "conv_id", "turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    streamed = F.col("role").eqNullSafe(F.lit("assistant"))
    pieces = F.when(streamed, F.floor((F.length(text) + delta - 1) / delta)).otherwise(0)
    whole = F.struct(F.lit("message").alias("kind"), F.when(streamed, "").otherwise(text).alias("text"))
    piece = F.transform(F.sequence(F.lit(1), pieces),
                        lambda k: F.struct(F.lit("delta").alias("kind"), F.substring(text, ((k - 1) * delta + 1).cast("int"), F.lit(delta)).alias("text")))
    events = F.concat(F.array(whole), F.when(pieces > 0, piece).otherwise(F.array().cast("array<struct<kind:string,text:string>>")))
    return (r.select("conv_id", "turn", "role", F.posexplode(events).alias("at", "event"))
            .select("conv_id", F.struct("turn", "at").alias("seq"), "turn", F.col("event.kind").alias("kind"), "role",
                    F.col("event.text").alias("text")))


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, part, turn, role, text) of a log, one a turn
    that a message has opened and nothing has taken back.

    ``log`` has conv_id, seq (any orderable type), turn, kind, role and text;
    further columns don't matter. Of events with the same seq, in this order:
    message, edit, regenerate, delta; then by text. Equal events count each. A
    null text is empty; a null conv_id is a conversation of its own, a null
    turn comes first; unknown kinds and a turn's events before its message
    (or with none) say nothing. An empty log gives an empty result.
    """
    e = only(log, "conv_id", "seq", "turn", "kind", "role", "text")
    step = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).otherwise(3)
    e = e.where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    e = e.select("conv_id", F.floor(F.col("turn") / PART).alias("part"), "turn",
                 F.struct("seq", step.alias("step"), F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"))
    again = F.when(F.col("e.step") == 2, F.struct(F.col("e.seq").alias("seq")))
    # what earlier parts of the conversation take back: one row a part
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = e.groupBy("conv_id", "part").agg(F.max(again).alias("cut"))
    parts = every.select("conv_id", "part", F.max("cut").over(before).alias("cut")).where("cut IS NOT NULL")
    parts = parts.withColumnsRenamed({"conv_id": "__conv", "part": "__part"})
    turns = e.repartition("conv_id", "part").groupBy("conv_id", "part", "turn").agg(
        F.collect_list("e").alias("events"), F.max(again).alias("again"))
    inner = Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("again").over(inner))
    turns = (turns.join(parts.withColumnRenamed("cut", "__cut"),
                        F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("part").eqNullSafe(F.col("__part")), "left")
             .withColumn("cut", F.greatest("cut", "__cut")))
    live = F.filter("events", lambda x: F.col("cut").isNull() | (F.struct(x["seq"].alias("seq")) > F.col("cut")))
    live = F.array_sort(live)
    turns = turns.select("conv_id", "part", "turn", live.alias("events"))
    opened = F.filter("events", lambda x: x["step"] == 0)
    turns = turns.withColumn("opened", F.element_at(opened, -1)).where(F.size(opened) > 0)
    # the last message, then the last edit or regeneration after it, then the deltas after that
    starts = F.filter("events", lambda x: (x["step"] < 3) & (x >= F.col("opened")))
    turns = turns.withColumn("start", F.element_at(starts, -1))
    first = F.when(F.col("start.step") == 2, "").otherwise(F.col("start.text"))
    deltas = F.transform(F.filter("events", lambda x: (x["step"] == 3) & (x > F.col("start"))), lambda x: x["text"])
    return turns.select("conv_id", "part", "turn", F.col("opened.role").alias("role"),
                        F.concat(first, F.array_join(deltas, "")).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Parts (conv_id, part, n_turns, formatted, loss) of the messages of
    ``fold``. ``loss`` lists the spans (start, length) of the assistants'
    texts in ``formatted``, in code points from 0; ``</s>`` isn't part of them."""
    role, text = F.coalesce("role", F.lit("")), escape(F.col("text"))
    head = (F.when(role == "user", "<s>[INST] ").when(role == "assistant", "<s>")
            .otherwise(F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"))))
    tail = F.when(role == "user", " [/INST]</s>").otherwise("</s>")
    turn = messages.select("conv_id", "part", "turn", (role == "assistant").alias("own"), head.alias("head"), text.alias("body"), tail.alias("tail"))
    before = Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.length("tail")
    turn = turn.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    row = F.struct("turn", F.concat("head", "body", "tail").alias("whole"),
                   F.when(F.col("own"), F.struct("start", F.length("body").cast("long").alias("length"))).alias("span"))
    rows = F.array_sort(F.collect_list(row))
    part = turn.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n_turns"), rows.alias("rows"))
    return part.select("conv_id", "part", "n_turns", F.array_join(F.transform("rows", lambda x: x["whole"]), "").alias("formatted"),
                       F.filter(F.transform("rows", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"))


def read_back(parts: DataFrame) -> DataFrame:
    """(conv_id, part, turns: role and text of each, loss: the text under the
    loss mask, unescaped, chars) from the rendered parts."""
    pieces = F.slice(F.split("formatted", "</s>"), F.lit(1), F.size(F.split("formatted", "</s>")) - 1)  # none but the template's own

    def turn(piece):
        body = F.substr(piece, F.lit(4))
        user, other = body.startswith("[INST] "), body.startswith("[ROLE]")
        role = F.when(user, "user").when(other, F.regexp_extract(body, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)).otherwise("assistant")
        text = (F.when(user, F.regexp_extract(body, r"(?s)^\[INST\] (.*) \[/INST\]$", 1))
                .when(other, F.regexp_extract(body, r"(?s)^\[ROLE\].*?\[/ROLE\](.*)$", 1)).otherwise(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    spans = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return parts.select("conv_id", "part", F.transform(pieces, turn).alias("turns"), F.array_join(spans, "").alias("loss"),
                        F.length("formatted").cast("long").alias("chars"))


def digests(parts: DataFrame) -> DataFrame:
    """One row a conversation, from its parts as read back: conv_id, n_turns,
    turns_sha256 (role, line feed, text, line feed of each turn), loss_chars,
    loss_sha256, formatted_chars."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = read_back(parts).select("conv_id", F.struct("part", said.alias("said"), "loss").alias("x"), F.size("turns").alias("n"),
                                   F.length("loss").alias("own"), "chars")
    whole = part.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("own").alias("loss_chars"),
                                        F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("x")).alias("x"))

    def joined(name):
        return F.sha2(F.array_join(F.transform("x", lambda x: x[name]), ""), 256)

    return whole.select("conv_id", "n_turns", joined("said").alias("turns_sha256"), "loss_chars",
                        joined("loss").alias("loss_sha256"), "formatted_chars")
