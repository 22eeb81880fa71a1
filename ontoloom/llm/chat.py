r"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

Every assistant turn becomes an example of its own: all earlier turns as context and the reply, of which only the
text is trainable. What follows the last assistant turn (or a conversation without one) becomes an example with
nothing to train, so that no turn is lost.

A turn is ``<s>role[INST]text[/INST]</s>``. A control string inside a role or a text gets one backslash after its
first character, and so does one that already has backslashes there; reading takes one off again. So the escaped
text holds no control string, and the way back is exact.

Defined results. A null text is empty, a null role reads back as empty, a null turn number comes first; rows with
the same number are ordered by role, then text; repeated rows are turns of their own. Rows with a null conversation
id form one conversation. An example is a row; the turns of one conversation, which its last example holds anyway, are
gathered in one row to make them. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, ROLE_END, TEXT_END, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Control strings less their first character.
TAILS = r"(s>|/s>|INST\]|/INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAILS, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAILS, "$1$2$3")


def examples(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each example: ``id``, ``example`` (from 0), ``formatted``, ``loss_start`` (from 1; 0: nothing to
    train) and ``loss_chars``. The last example of a conversation has all of its turns."""
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    df = rows.groupBy(F.col(id).alias("conversation")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    df = df.select("conversation", F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.concat(F.lit(START), escaped(t["role"]), F.lit(ROLE_END)).alias("head"), escaped(t["text"]).alias("body"))).alias("turns"))
    # An example ends at each reply, and at the last turn.
    ends = "filter(transform(turns, (t, i) -> IF(t.reply OR i = size(turns) - 1, i, -1)), i -> i >= 0)"
    df = df.select("conversation", "turns", F.posexplode(F.expr(ends)).alias("example", "end"))
    context = f"concat_ws('', transform(slice(turns, 1, end), t -> concat(t.head, t.body, '{TEXT_END}{END}')))"
    df = df.select("conversation", "example", F.expr(context).alias("context"), F.expr("turns[end]").alias("target"))
    return df.select(
        F.col("conversation").alias(id), "example",
        F.concat("context", "target.head", "target.body", F.lit(TEXT_END + END)).alias("formatted"),
        F.when(F.col("target.reply"), F.length("context") + F.length("target.head") + 1).otherwise(0).alias("loss_start"),
        F.when(F.col("target.reply"), F.length("target.body")).otherwise(0).alias("loss_chars"),
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    turns = F.filter(F.split(formatted, r"</s>"), lambda x: x != "")
    return F.transform(turns, lambda x: F.struct(
        unescaped(F.regexp_extract(x, r"(?s)^<s>(.*?)\[INST\]", 1)).alias("role"),
        unescaped(F.regexp_replace(F.regexp_replace(x, r"(?s)^<s>.*?\[INST\]", ""), r"\[/INST\]$", "")).alias("text"),
    ))


def read_back(found: DataFrame, id: str = "conv_id") -> DataFrame:
    """Digests of conversations, got from the formatted texts and loss spans of their examples() alone. The examples
    of a conversation are where its turns were, so nothing is shuffled again."""
    loss = F.when(F.col("loss_start") > 0, unescaped(F.col("formatted").substr(F.col("loss_start"), F.col("loss_chars")))).otherwise("")
    df = found.groupBy(F.col(id).alias("conversation")).agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    df = df.select("conversation", parsed(F.col("whole")).alias("turns"), F.concat_ws("", F.transform("losses", lambda x: x["loss"])).alias("loss"), "formatted_chars", "n_examples")
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return df.select(
        F.col("conversation").alias(id), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
