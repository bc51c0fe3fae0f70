"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only the reply is trainable. A
conversation that doesn't end with an assistant turn gives one more example without a target, so that no turn is lost. A
turn is written ``<s>role\\ntext</s>``; the role is url-encoded, and control strings inside a text are escaped with
backslashes, reversibly. An example is its context followed by its target; ``loss_start`` and ``loss_end`` delimit the
reply within it.

An example holds all turns before it, so the examples of a conversation of n turns have some n * n / 2 turns; they are made row
by row from one row that holds the conversation once.

Defined results: a null text or role is empty; turns are ordered by turn (nulls first), then role, then text, so ties
and repeated rows, which all count as turns, have one order; a row without a conversation id is a conversation of its own, told
apart by ``conv``; an empty table gives no examples. Only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings, after their first < or [: the template's own, and those of other templates that texts are likely to hold.
_CONTROL = r"/?s>|\||</?SYS>>", r"/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"(<)({_CONTROL[0]})|(\[)({_CONTROL[1]})", r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"(<)\\({_CONTROL[0]})|(\[)\\({_CONTROL[1]})", "$1$3$2$4"), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """(id, conv, example, last, context, target, loss_start, loss_end), one row an example; target is null without a reply.

    conv is null but for conversations without id, which have different ones.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    own = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    convs = turns.select(F.col(id_col).alias("id"), own.alias("conv"), row.alias("row")).groupBy("id", "conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    head = lambda x: F.concat(F.lit("<s>"), F.url_encode(x["role"]), F.lit("\n"))
    convs = convs.select(
        "id", "conv",
        F.transform("rows", lambda x: F.concat(head(x), escape(x["text"]), F.lit("</s>"))).alias("written"),
        F.filter(F.transform("rows", lambda x, i: F.when(x["role"] == trained_role, i + 1).otherwise(0)), lambda x: x > 0).alias("replies"),
        F.lit(f"<s>{trained_role}\n").alias("head"),
    )
    size = F.size("written")
    ends = F.when(F.coalesce(F.try_element_at("replies", F.lit(-1)), F.lit(0)) == size, F.col("replies")).otherwise(F.concat("replies", F.array(size + 1)))
    examples = convs.select("id", "conv", "written", "head", size.alias("n"), F.posexplode(ends).alias("example", "at"))
    context = F.array_join(F.slice("written", F.lit(1), F.col("at") - 1), "")
    target = F.when(F.col("at") <= F.col("n"), F.get("written", F.col("at") - 1))
    out = examples.select(F.col("id").alias(id_col), "conv", "example", (F.col("at") >= F.col("n")).alias("last"), context.alias("context"), target.alias("target"), F.length("head").alias("head"))
    start = F.when(F.col("target").isNotNull(), F.length("context") + F.col("head"))
    end = F.length("context") + F.length("target") - F.length(F.lit("</s>"))
    return out.select(id_col, "conv", "example", "last", "context", "target", start.cast("long").alias("loss_start"), end.cast("long").alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.filter(F.split(formatted, "</s>"), lambda x: x != "")
    role = lambda x: F.regexp_extract(x, r"(?s)^<s>([^\n]*)\n", 1)
    text = lambda x: F.regexp_extract(x, r"(?s)^<s>[^\n]*\n(.*)$", 1)
    return F.transform(parts, lambda x: F.struct(F.url_decode(role(x)).alias("role"), unescape(text(x)).alias("text")))


def digests(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from the examples of each conversation: turns, trained text and sizes."""
    whole = F.concat("context", F.coalesce("target", F.lit("")))
    turns = F.when(F.col("last"), read_turns(whole))
    lines = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = unescape(F.expr("substring(concat(context, target), int(loss_start) + 1, int(loss_end - loss_start))"))
    rows = examples.select(id_col, "conv", "example", F.length(whole).cast("long").alias("chars"), F.size(turns).cast("long").alias("n_turns"), F.when(F.col("last"), F.sha2(lines.cast("binary"), 256)).alias("turns_sha256"), F.coalesce(loss, F.lit("")).alias("loss"), "last")
    by = rows.groupBy(id_col, "conv").agg(
        F.max(F.when(F.col("last"), F.col("n_turns"))).alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"),
    )
    return by.select(id_col, "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
