"""Chat formatting with a checked round trip (operator 1), in DataFrame functions only.

Grammar of the rendered text, one production per turn:

    turn := "<|im_start|>" role "\\n" body "<|im_end|>" "\\n"

A body or role never holds "<|": "<" + n backslashes + "|" in a source text is written with n + 1 backslashes, which maps all
texts one to one onto texts without "<|". A role also writes backslash, line feed and "<" as "\\\\", "\\n" and "\\l", as a line
feed ends it. The parser is deterministic: it cuts at "<|", and takes one backslash out of each "<\\...|".

A text is first rendered as it is. The rendering is parsed; where the parser doesn't give the source back, the text conflicts with
the grammar and is escaped, and the result is parsed again. One round of escaping makes every text identical, as the mapping is one
to one; a turn that still differed would stop the query.

Nulls: a null text or role is empty; null conversation ids form one conversation; null turns sort first. Turns with the same number
are ordered by role, then text; repeated rows stay. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for raw, written in (("\\", "\\\\"), ("\n", "\\n"), ("<", "\\l")):
        role = F.replace(role, F.lit(raw), F.lit(written))
    return role


def unescape_role(role: Column) -> Column:
    part = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<"))
    return F.array_join(F.transform(F.split(role, r"\\\\"), part), "\\")


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(f"{END}\n"))


def parse_turn(turn: Column) -> Column:
    """struct(role, text) of a rendered turn without its end marker, null if the grammar doesn't accept it."""
    inner = F.substring(turn, F.lit(len(START) + 1), F.length(turn))
    at = F.instr(inner, "\n")
    body = F.substring(inner, at + 1, F.length(inner))
    fits = F.startswith(turn, F.lit(START)) & (at > 0) & ~F.contains(inner, F.lit("<|"))
    return F.when(fits, F.struct(unescape_role(F.substring(inner, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """Turns of a rendered conversation: array of struct(role, text), with a null for each piece that is no turn."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse_turn)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 0 and end, in code points of formatted, of each assistant body).

    Each turn is rendered, parsed and, if need be, escaped on its own row; one shuffle by conversation then joins the turns.
    """
    role_raw, text_raw = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), role_raw.alias("role"), text_raw.alias("text"))

    def same(body: Column) -> Column:  # the first end marker ends a turn, also one that stands in the body
        back = parse_turn(F.substring_index(render(escape_role(F.col("role")), body), END, 1))
        return F.coalesce((back["role"] == F.col("role")) & (back["text"] == F.col("text")), F.lit(False))

    checked = rows.withColumn("body", F.when(same(F.col("text")), F.col("text")).otherwise(escape(F.col("text"))))
    stop = F.raise_error(F.concat(F.lit("a turn doesn't survive the round trip: conversation "), F.col("conv_id").cast("string")))
    proved = checked.withColumn("piece", F.when(same(F.col("body")), render(escape_role(F.col("role")), F.col("body"))).otherwise(stop.cast("string")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + len(START) + F.length(escape_role(F.col("role"))) + 1
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    placed = proved.select("conv_id", F.row_number().over(order).alias("n"), "piece", span.alias("span"))
    joined = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "span"))).alias("t"))
    return joined.select("conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"), F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the parser reads back from format_conversations()."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
