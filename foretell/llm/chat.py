"""Chat formatting by event-sourced reconstruction (operator 10, DataFrame functions only).

The log has one event a row: conversation, turn, sequence number, event kind, role, text.  Events of a turn are sorted by sequence and folded:

    message     a new message with this text (also any unknown or null kind)
    delta       append to the latest message of the turn (a first delta starts one)
    edit        replace the latest message's text
    regenerate  drop the latest message's text and start anew with this one

An edit or a regeneration also voids every event of later turns that came before it, as a chat client does when an earlier turn changes.

Template: `<|im_start|>` role newline text `<|im_end|>` newline.  Inside roles and texts a backslash is doubled and one is put after each `<` and `[`; no control string of the usual templates survives that, and it is undone exactly by `unescape`.  A newline inside a role becomes `[n`, which no escaped text holds.

Scale: a fold reads each event once, however many deltas stream in, and is by (conversation, turn), so events of one hot conversation are spread; the window and the last grouping see one row per message.  A rendered conversation is one value by definition.

Defined cases: null text and null role count as empty; null turns and sequence numbers sort first; ties of sequence are ordered by kind, role, text; repeated `message` rows are repeated messages; rows with a null conversation form one conversation of their own; other columns are ignored; an empty log gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretell.llm.common import let

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def _fold(events: Column) -> Column:
    """Messages (role, text) of the sorted events of a turn, each event read once: a message is the events from its start to the next one's, and its text joins those from its last edit or regeneration on."""
    changes = lambda e: e.kind.isin("edit", "regenerate")

    def text(own: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(own, lambda e, j: F.when(changes(e), j + 1))), F.lit(1))
        return let(last, lambda at: F.array_join(F.transform(F.slice(own, at, F.size(own) - at + 1), lambda e: e.text), ""))

    def split(events: Column, starts: Column) -> Column:
        length = lambda at, k: F.coalesce(F.get(starts, k + 1), F.size(events) + 1) - at
        return F.transform(starts, lambda at, k: let(F.slice(events, at, length(at, k)), lambda own: F.struct(own[0].role.alias("role"), text(own).alias("text"))))

    def starts(events: Column) -> Column:
        begins = F.transform(events, lambda e, i: F.when((i == 0) | ~(changes(e) | (e.kind == "delta")), i + 1))
        return F.array_compact(begins)

    return let(events, lambda e: let(starts(e), lambda s: split(e, s)))


def messages(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, ord (from 0 within the turn), role, text.  events: conv_id, turn, seq, kind, role, text."""
    clean = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("cut")
    turns = clean.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("events"), cuts)
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    live = turns.withColumn("cut", F.max("cut").over(earlier))
    valid = F.filter("events", lambda e: F.col("cut").isNull() | (F.coalesce(e.seq, F.lit(-(2**62))) > F.col("cut")))
    return live.select("conv_id", "turn", F.posexplode(_fold(valid)).alias("ord", "m")).select("conv_id", "turn", "ord", "m.role", "m.text")


def render(msgs: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start and length in code points, from 0, of the texts of loss_role)."""
    place = Window.partitionBy("conv_id").orderBy("turn", "ord")
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("[n")), F.lit("\n"))
    piece = msgs.select("conv_id", "turn", "ord", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    piece = piece.withColumn("length", (F.char_length("head") + F.char_length("body") + len(END)).cast("long"))
    piece = piece.withColumn("at", F.sum("length").over(place) - F.col("length") + F.char_length("head"))
    span = F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("start"), F.char_length("body").cast("long").alias("length")))
    rows = piece.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "ord", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span")))).alias("rows"))
    return rows.select("conv_id", F.array_join(F.col("rows.piece"), "").alias("formatted"), F.filter(F.col("rows.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(messages(events), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says, taken from the output alone: turns (array of role, text) and loss_text."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p: p != "")
    role = lambda p: unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("[n"), F.lit("\n")))
    text = lambda p: unescape(F.substring(p, F.instr(p, "\n") + 1, F.char_length(p) - F.instr(p, "\n") - len(END)))
    turns = F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_text"))
