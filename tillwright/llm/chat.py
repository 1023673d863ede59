""""Chat formatting with a grammar round trip, in DataFrame expressions only.

A conversation is rendered as ``<s>`` level, then per turn ``[INST]`` role, line break, text, ``</s>``. A deterministic
parser cuts the rendered text at control strings (``<s> </s> [INST] [/INST]``), takes the pieces between as the grammar
says and compares the recovered turns, and their own rendering, with the source. Level 0 renders as it is. Where that
isn't recovered, level 1 guards the content: a backslash goes behind the first character of every control string that
a text or role contains (one more where some are there already), and line breaks in roles are written ``%0A``. Both are
undone by the parser, and the round trip is checked again; a conversation that fails it stops the job.

The output keeps segments with a flag: the formatted text is their concatenation, the loss mask covers the texts of
assistant turns. Turns are ordered by turn number (null first), role and text; repeated rows are kept. Null roles and
texts are empty; a null conversation id is one conversation. An empty table gives no rows. Other columns are ignored.

Texts of any length are one value each and are never cut; a conversation has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 2
OPEN, CLOSE, START = "[INST]", "</s>", "<s>"
CONTROL = r"\[/?INST\]|</?s>"
# A control string with any number of guards behind its first character.
GUARDABLE = r"([\[<])(\\*)(/?(?:INST\]|s>))"
GUARDED = r"([\[<])\\(\\*)(/?(?:INST\]|s>))"
LEARNED_ROLE = "assistant"


def _guard(text: Column) -> Column:
    return F.regexp_replace(text, GUARDABLE, r"$1\\$2$3")


def _unguard(text: Column) -> Column:
    return F.regexp_replace(text, GUARDED, "$1$2$3")


def _guard_role(role: Column) -> Column:
    return _guard(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unguard_role(role: Column) -> Column:
    return F.replace(F.replace(_unguard(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as an array of (role, text)."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("turn")).alias("turns")
    )
    return gathered.select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def render(turns: Column, level: int) -> Column:
    """Segments of a conversation at an escape level: (text, learned)."""

    def of_turn(turn: Column) -> Column:
        role, text = turn["role"], turn["text"]
        head = F.concat(F.lit(OPEN), _guard_role(role) if level else role, F.lit("\n"))
        body = _guard(text) if level else text
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("learned")),
            F.struct(body.alias("text"), (role == LEARNED_ROLE).alias("learned")),
            F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("learned")),
        )

    first = F.struct(F.lit(f"{START}{level}").alias("text"), F.lit(False).alias("learned"))
    return F.concat(F.array(first), F.flatten(F.transform(turns, of_turn)))


def joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def level_of(formatted: Column) -> Column:
    """The character behind the opening ``<s>``; the text is not searched for it."""
    return F.substring(formatted, len(START) + 1, 1)


def parse(formatted: Column) -> Column:
    """The turns that a formatted text says, with guards undone where its level has them.

    Between control strings stand: nothing, the level, and per turn its content and nothing.
    """
    pieces = F.filter(F.split(formatted, CONTROL, -1), lambda piece, at: (at >= 2) & (at % 2 == 0))
    guarded = level_of(formatted) == "1"

    def of_piece(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role, text = F.left(piece, cut - 1), F.substring(piece, cut + 1, F.char_length(piece))
        return F.struct(
            F.when(guarded, _unguard_role(role)).otherwise(role).alias("role"),
            F.when(guarded, _unguard(text)).otherwise(text).alias("text"),
        )

    return F.transform(pieces, of_piece)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted): the lowest escape level whose round trip recovers every turn."""
    chats = conversations_of(rows)
    for level in range(LEVELS):
        # What an earlier level recovered is not rendered again.
        open_turns = F.when(~F.col("same_0"), F.col("turns")) if level else F.col("turns")
        chats = chats.withColumn(f"segments_{level}", render(open_turns, level))
        chats = chats.withColumn(f"formatted_{level}", joined(F.col(f"segments_{level}")))
        recovered = parse(F.col(f"formatted_{level}"))
        same = (recovered == F.col("turns")) & (joined(render(recovered, level)) == F.col(f"formatted_{level}"))
        chats = chats.withColumn(f"same_{level}", same)
    level = F.when(F.col("same_0"), 0).when(F.col("same_1"), 1).otherwise(
        F.raise_error(F.concat(F.lit("no escape level recovers conversation "), F.col("conv_id").cast("string"))).cast("int")
    )
    chats = chats.withColumn("level", level)
    return chats.select(
        "conv_id", F.when(F.col("level") == 0, F.col("segments_0")).otherwise(F.col("segments_1")).alias("segments"),
        F.when(F.col("level") == 0, F.col("formatted_0")).otherwise(F.col("formatted_1")).alias("formatted"),
    )


def digest_of(formatted: DataFrame) -> DataFrame:
    """Checks read back from the output: the turns by parsing it, the learned text by its mask."""
    turns = parse(F.col("formatted"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    under_mask = F.array_join(
        F.transform(F.filter("segments", lambda s: s["learned"]), lambda s: s["text"]), ""
    )
    pieces = F.filter("segments", lambda s: s["learned"])
    guarded = level_of(F.col("formatted")) == "1"
    learned = F.when(guarded, F.array_join(F.transform(pieces, lambda s: _unguard(s["text"])), "")).otherwise(under_mask)
    utf8 = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    parsed = formatted.select("conv_id", turns.alias("turns"), learned.alias("learned"), "formatted")
    return parsed.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        utf8(F.array_join(F.transform("turns", line), "")).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"), utf8(F.col("learned")).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
