"""Chat formatting by event-sourced reconstruction, with built-in functions only.

A conversation is a log of events in sequence: ``start`` opens a turn with its
role, ``delta`` appends to the turn's text, ``edit`` replaces the text (later
deltas append to it) and ``regenerate`` empties it; both of the latter also
undo what later turns had logged before.  The log is partitioned by
conversation and turn, folded in sequence into final messages, and rendered.

Template: ``<s>[INST] role [/INST]text</s>`` for each turn.  Inside roles and
texts a backslash is doubled and one is put after the first character of every
control string, so a control string never appears in them, and dropping one
backslash before any character gives the text back.  The loss mask is kept as
the rendered segments: segments with ``loss`` hold exactly the assistants'
texts.

Defined cases: null roles and payloads are empty; events that repeat (same
conversation and sequence) count once; events of equal sequence and different
content are ordered by kind and payload; a turn without ``start`` has an empty
role; deltas before any start are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, HEADER_END, END = "<s>[INST] ", " [/INST]", "</s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """``text`` without control strings, reversibly."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"(<(?=/?s>)|\[(?=/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def final_messages(events: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: the state of every turn that is still alive.

    ``events``: ``conv_id, seq, turn, kind, role, payload``.
    """
    e = (events.select("conv_id", "seq", "turn", "kind", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("payload", F.lit("")).alias("payload")).distinct())
    # turn by turn: the last event that undoes later turns, and of all turns before
    undo = e.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("undo"))
    earlier = (Window.partitionBy("conv_id").orderBy("turn")
               .rowsBetween(Window.unboundedPreceding, -1))
    cut = undo.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"),
                      F.max("undo").over(earlier).alias("cut"))
    live = (e.join(cut, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")))
            .where("cut is null or seq > cut").drop("_c", "_t", "cut"))
    item = F.struct("seq", "kind", "payload")
    folded = live.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(item)).alias("log"),
        F.coalesce(F.max_by("role", F.when(F.col("kind") == "start", F.struct("seq", "role"))),
                   F.lit("")).alias("role"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.struct("seq", "kind", "payload"))
              ).alias("reset"))
    base = F.when(F.col("reset.kind") == "edit", F.col("reset.payload")).otherwise("")
    deltas = F.filter("log", lambda x: (x["kind"] == "delta")
                      & (F.col("reset").isNull() | (x["seq"] > F.col("reset.seq"))))
    text = F.concat(base, F.array_join(F.transform(deltas, lambda x: x["payload"]), ""))
    return folded.select("conv_id", "turn", "role", text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, segments, formatted``: one row per conversation.

    ``segments`` is an array of (text, loss); ``formatted`` is their texts in a row.
    """
    header = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(HEADER_END))
    body = escape(F.col("text"))
    turn = F.array(F.struct(header.alias("text"), F.lit(False).alias("loss")),
                   F.struct(body.alias("text"), (F.col("role") == ASSISTANT).alias("loss")),
                   F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    m = messages.select("conv_id", "turn", turn.alias("parts"))
    out = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "parts"))).alias("t"))
    segments = F.flatten(F.transform("t", lambda x: x["parts"]))
    out = out.select("conv_id", segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) parsed from a rendered conversation."""
    turns = F.filter(F.split(formatted, END), lambda t: t != "")

    def turn(t):
        header = F.substring_index(t, HEADER_END, 1)
        return F.struct(unescape(F.substr(header, F.lit(len(BEGIN) + 1))).alias("role"),
                        unescape(F.substr(t, F.length(header) + len(HEADER_END) + 1)).alias("text"))

    return F.transform(turns, turn)


def events_of(rows: DataFrame) -> DataFrame:
    """A log whose final messages are ``rows`` (``conv_id, turn, role, text``).

    Rows are numbered within their conversation by turn, role and text.  Every
    text is streamed in two deltas; every third turn is first drafted and
    regenerated, every fifth drafted and edited, as a live log would hold.
    """
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    r = r.withColumn("n", n.cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    left, right = F.left("text", half), F.substr(F.col("text"), half + 1)
    none = F.lit(None).cast("string")

    def event(at, kind, role=none, payload=none):
        return F.struct((F.col("n") * 8 + at).alias("seq"), F.lit(kind).alias("kind"),
                        role.alias("role"), payload.alias("payload"))

    draft = event(1, "delta", payload=F.reverse("text"))
    plain = [event(3, "delta", payload=left), event(4, "delta", payload=right)]
    log = (F.when(F.col("n") % 3 == 0, F.array(draft, event(2, "regenerate"), *plain))
           .when(F.col("n") % 5 == 0, F.array(draft, event(2, "edit", payload=left), plain[1]))
           .otherwise(F.array(*plain)))
    opened = F.concat(F.array(event(0, "start", role=F.col("role"))), log)
    return (r.select("conv_id", F.col("n").alias("turn"), F.explode(opened).alias("e"))
            .select("conv_id", "turn", "e.*"))


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and digests of rendered conversations, read back from them."""
    turns = read_back(F.col("formatted"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                    lambda s: unescape(s["text"])), "")
    r = rendered.select("conv_id", turns.alias("turns"), loss.alias("loss"),
                        F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(said, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
