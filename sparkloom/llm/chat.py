"""Chat formatting with Spark expressions only.

The template. A run of turns with the same role is one block:

    ### role<line feed>text<next>text</turn><line feed>

`#`, `<` and backslash never stand in the formatted text but as parts of these marks: inside texts and roles a
backslash becomes `\\b`, `#` becomes `\\h`, `<` becomes `\\l`, and in roles a line feed becomes `\\n`. So the marks can't be
imitated and `parse` gives every turn back unchanged. Only texts of assistant turns are under the loss mask; the
mask is a list of runs: so many characters skipped, then so many taken.

Turns go in the order of turn, null first; equal numbers by role and text. A null text or role counts as empty.
A conversation is one value of the result, so its turns meet in one row, as in any output of this kind.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED = "assistant"
HEAD, NEXT, END = "### ", "<next>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_runs (skip, take) of each conversation. turns: conv_id, turn, role, text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    chats = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        """A turn's own part: what precedes its text, the text, what follows it. element_at counts from 1."""
        begins = (i == 0) | (F.element_at("turns", F.greatest(i, F.lit(1)))["role"] != x["role"])
        ends = F.coalesce(F.try_element_at("turns", i + 2)["role"] != x["role"], F.lit(True))
        head = F.concat(F.lit(HEAD), F.replace(escape(x["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
        return F.struct(F.when(begins, head).otherwise(F.lit(NEXT)).alias("before"), escape(x["text"]).alias("body"), F.when(ends, F.lit(END)).otherwise(F.lit("")).alias("after"), (x["role"] == LEARNED).alias("learned"))

    pieces = chats.select("conv_id", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        F.transform(
            "pieces",
            lambda p: F.struct(
                (F.length(p["before"]) + F.when(p["learned"], 0).otherwise(F.length(p["body"]) + F.length(p["after"]))).cast("bigint").alias("skip"),
                F.when(p["learned"], F.length(p["body"])).otherwise(0).cast("bigint").alias("take"),
                F.when(p["learned"], F.length(p["after"])).otherwise(0).cast("bigint").alias("skip_after"),
            ),
        ).alias("loss_runs"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """The columns of formatted, and turns (role, text), read back from its column formatted."""
    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")

    def block_turns(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = unescape(F.replace(F.substr(head, F.lit(len(HEAD) + 1)), F.lit("\\n"), F.lit("\n")))
        return F.transform(F.split(F.substr(b, F.length(head) + 2), NEXT, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, block_turns)))


def summary(formatted: DataFrame) -> DataFrame:
    """What op4 returns, from the formatted texts and the loss mask. A turn's mark begins its part, so that parts and runs go together one to one."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = F.split("formatted", f"(?={HEAD}|{NEXT})", -1)
    masked = F.zip_with(parts, "loss_runs", lambda p, run: F.substr(p, (run["skip"] + 1).cast("int"), run["take"].cast("int")))
    return parse(formatted.select("conv_id", "formatted", unescape(F.array_join(masked, "")).alias("learned"))).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
