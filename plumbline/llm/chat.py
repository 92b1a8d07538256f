"""Chat formatting by prefix-target expansion (operator 9).

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
A conversation that does not end on an assistant turn has one more example, without anything trainable, so that the
formatted examples hold every turn and can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """Reversible: one more backslash between ``<`` and ``|``, so no control string is left in the text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             target: str = "assistant") -> DataFrame:
    """Formatted examples: conv_id, example (from 0), n_turns, text, loss_start, loss_end.

    Turns stand in order of ``turn``, then role and text; a null turn comes first. A null role or text is empty. The
    mask is the range loss_start..loss_end of code points of ``text``, end excluded; both are null where nothing is
    trainable. Rows without conv_id are one conversation. Repeated rows are turns of their own. Other columns are not
    read. A conversation is the unit of work, as each example holds its turns.
    """
    given = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                         F.coalesce(F.col(role), F.lit("")).alias("role"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = given.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n"))
    cut = whole.select("conv_id", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == target).alias("reply"))).alias("t"))
    tail = END + "\n"
    cut = cut.select("conv_id", "t", F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(tail))).alias("all"))
    # the number of turns in each example: up to a reply, and all of them
    counts = F.array_distinct(F.concat(
        F.filter(F.transform("t", lambda t, i: F.when(t["reply"], i + 1)), lambda i: i.isNotNull()),
        F.array(F.size("t"))))
    each = cut.select("conv_id", "t", "all", F.posexplode(counts).alias("example", "n_turns"))
    last = F.element_at("t", F.col("n_turns"))
    done = each.select("conv_id", "example", F.col("n_turns").cast("long").alias("n_turns"), last["reply"].alias("reply"),
                       F.char_length(last["body"]).alias("size"),
                       F.array_join(F.slice("all", F.lit(1), F.col("n_turns")), "").alias("text"))
    end = F.when(F.col("reply"), F.char_length("text") - len(tail))
    return done.select("conv_id", "example", "n_turns", "text", (end - F.col("size")).alias("loss_start"),
                       end.alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Conversations from their examples: conv_id, turns (array of role, text), loss (text under all masks), and the
    code points of all formatted text. Turns come from the longest example, the loss from every example's mask."""
    pattern = r"(?s)<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n"
    loss = F.when(F.col("loss_end").isNotNull(), F.substring(
        F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = formatted.select("conv_id", "example", "n_turns", "text", loss.alias("loss"))
    met = rows.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("text"), F.sum(F.char_length("text")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    parts = met.select("conv_id", "formatted_chars", "losses", *(
        F.expr(f"regexp_extract_all(text, r'{pattern}', {i})").alias(name) for i, name in ((1, "roles"), (2, "texts"))))
    return parts.select(
        "conv_id", F.zip_with("roles", "texts", lambda r, t: F.struct(
            _role_in(r).alias("role"), unescaped(t).alias("text"))).alias("turns"),
        F.array_join(F.transform("losses", lambda x: unescaped(x["loss"])), "").alias("loss"), "formatted_chars")
