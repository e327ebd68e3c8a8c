"""Chat transcripts rebuilt from event logs and rendered for training.

A log has events (conv_id, seq, message, role, kind, text). A `delta` adds its text to its
message, an `edit` replaces what the message held, and a `regenerate` empties it. Folding
is associative, so events are folded in chunks of sequence numbers first and the chunks
afterwards: a message with very many events is never gathered event by event. Messages
stand in the order of their first event.

A turn is rendered as `### role:`, a line break, its text, `</turn>` and a line break.
Inside texts and roles `\\`, `<`, `#` (and `:` in roles) become `\\\\`, `\\l`, `\\h` (`\\c`), so
no control string can occur there and every text can be read back.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own;
events with equal seq are ordered by kind, text and role, and a message has the role of its first event; repeated events count each; unknown
kinds add nothing; an empty log has no conversations; long texts are kept whole. Extra
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, HEAD_END, TURN_END = "### ", ":\n", "</turn>\n"
_CHUNK = 4096
# fixed values: the characters of control strings and their escapes
_ESCAPES = [("\\", "\\\\"), ("<", "\\l"), ("#", "\\h"), (":", "\\c")]


def escape(text: Column, role: bool = False) -> Column:
    for plain, escaped in _ESCAPES if role else _ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    """The text before `escape`; pairs of backslashes are taken from the left."""

    def part(x: Column) -> Column:
        for plain, escaped in _ESCAPES[1:]:
            x = F.replace(x, F.lit(escaped), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def _fold(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: whether an event replaced what stood before, and the text since."""
    listed = F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "fresh", "role")))
    grouped = events.groupBy(*keys).agg(listed.alias("events"))
    last = F.array_max(F.transform("events", lambda e, i: F.when(e["fresh"], i)))
    since = F.slice("events", F.coalesce(last, F.lit(0)) + 1, F.size("events"))
    return grouped.select(
        *keys,
        F.get("events", F.lit(0))["role"].alias("role"),
        F.get("events", F.lit(0))["seq"].alias("seq"),
        F.lit("").alias("kind"),
        last.isNotNull().alias("fresh"),
        F.array_join(F.transform(since, lambda e: e["text"]), "").alias("text"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, seq, role, text); seq is that of the first event."""
    kind = F.col("kind")
    keeps_text = kind.isin("delta", "edit")
    clean = events.select(
        "conv_id",
        "message",
        "seq",
        F.coalesce("role", F.lit("")).alias("role"),
        kind,
        F.when(keeps_text, F.coalesce("text", F.lit(""))).otherwise("").alias("text"),
        F.coalesce(kind.isin("edit", "regenerate"), F.lit(False)).alias("fresh"),
        F.floor(F.col("seq") / _CHUNK).alias("chunk"),
    )
    chunks = _fold(clean, ["conv_id", "message", "chunk"])
    return _fold(chunks, ["conv_id", "message"]).select("conv_id", "message", "seq", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the transcript and the spans of its assistant texts.

    Spans are (start, stop) in code points of formatted.
    """
    head = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(HEAD_END))
    parts = messages.select(
        "conv_id", "seq", "message", (F.col("role") == "assistant").alias("learn"), head.alias("head"), escape(F.col("text")).alias("body")
    )
    before = Window.partitionBy("conv_id").orderBy("seq", "message").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(TURN_END)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    placed = parts.withColumn("start", start)
    turns = F.sort_array(F.collect_list(F.struct("seq", "message", "start", "head", "body", "learn")))
    grouped = placed.groupBy("conv_id").agg(turns.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))), "")
    spans = F.transform(
        F.filter("turns", lambda t: t["learn"]),
        lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["body"])).alias("stop")),
    )
    return grouped.select("conv_id", text.alias("formatted"), spans.alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """Read transcripts back: conv_id, turns (role, text), loss_text, formatted."""

    def turn(x: Column) -> Column:
        body = F.substring_index(x, HEAD_END, 1)
        role = unescape(F.substr(body, F.lit(len(HEAD) + 1)))
        text = unescape(F.substr(x, F.length(body) + len(HEAD_END) + 1))
        return F.struct(role.alias("role"), text.alias("text"))

    pieces = F.split("formatted", TURN_END)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)
    learnt = F.transform(
        "loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))
    )
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(learnt, "").alias("loss_text"))


def turn_events(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as the log of a live chat that ends in them.

    By turns, a message comes in two deltas; as a draft that is thrown away by a regenerate
    and then told anew; or as a delta that an edit replaces by the first half, the second
    half following.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select(
        "conv_id", "role", F.coalesce("text", F.lit("")).alias("whole"), F.row_number().over(order).cast("long").alias("message")
    )
    half = F.floor(F.length("whole") / 2).cast("int")
    first, second = F.substr("whole", F.lit(1), half), F.substr("whole", half + 1)

    def event(place: int, kind: str, text: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), text.alias("text"))

    draft = F.concat(second, F.lit(" draft"))
    whole, nothing = F.col("whole"), F.lit(None).cast("string")
    log = (
        F.when(F.col("message") % 3 == 1, F.array(event(0, "delta", first), event(1, "delta", second)))
        .when(F.col("message") % 3 == 2, F.array(event(0, "delta", draft), event(1, "regenerate", nothing), event(2, "delta", whole)))
        .otherwise(F.array(event(0, "delta", draft), event(1, "edit", first), event(2, "delta", second)))
    )
    events = numbered.select("conv_id", "message", "role", F.explode(log).alias("e"))
    return events.select(
        "conv_id", "message", (4 * F.col("message") + F.col("e.place")).alias("seq"), "role", "e.kind", "e.text"
    )


def transcript_digests(parsed: DataFrame) -> DataFrame:
    """Counts and digests of what `parse` read."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
