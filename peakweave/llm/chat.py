r"""Chat formatting with Spark expressions only: turns are sorted, merged, escaped and concatenated.

A conversation becomes blocks `### Role: text</turn>` + newline; adjacent turns of one role share a
block, their texts parted by `<part/>`. Inside texts and roles the control strings are replaced:
`\` -> `\b`, `</turn>` -> `\t`, `<part/>` -> `\p`, `### ` -> `\h`, in roles also `: ` -> `\c`.
After that no text holds a control string, so splitting on them is exact and escaping reverses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, running

END, PART, HEAD, COLON = "</turn>\n", "<part/>", "### ", ": "
_ESCAPES = [("\\", "\\b"), ("</turn>", "\\t"), (PART, "\\p"), (HEAD, "\\h")]
_ROLE_ESCAPES = [*_ESCAPES, (COLON, "\\c")]


def escape(text: Column, role: bool = False) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ROLE_ESCAPES if role else _ESCAPES, text)


def unescape(text: Column, role: bool = False) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(_ROLE_ESCAPES if role else _ESCAPES), text)


def format_chats(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans (start, length) in code points.

    Turns are ordered by turn number (null first), then role and text, so ties and repeated rows have a
    defined place; every row counts. A null text or role is empty; rows with a null conversation form
    one conversation. The spans cover the escaped texts of trained_role, one span per turn, without
    headers, separators and ends. An empty table gives no rows; other columns are ignored. A
    conversation is one output row by definition, so its turns meet in one task; what is done with their sorted
    array takes n log n steps, so long conversations take time in proportion.
    """
    col = lambda name: F.col(f"`{name}`")
    rows = turns.select(col(conv).alias("conv_id"), F.struct(col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def merged(sorted_: Column) -> Column:
        """A turn opens a block unless its role is that of the turn before: then it joins that turn's block."""
        def piece(t: Column, i: Column) -> Column:
            head = F.concat(F.lit(HEAD), escape(t["role"], role=True), F.lit(COLON))
            opening = F.when(i == 0, head).when(t["role"] == F.get(sorted_, i - 1)["role"], F.lit(PART)).otherwise(F.concat(F.lit(END), head))
            return F.struct((t["role"] == F.lit(trained_role)).alias("trained"), opening.alias("opening"), escape(t["text"]).alias("body"))

        return F.transform(sorted_, piece)

    def written(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda p: F.length(p["opening"]) + F.length(p["body"])), lambda a, b: a + b)
        every = bound(ends, lambda e: F.transform(pieces, lambda p, i: F.when(p["trained"], F.struct((F.get(e, i) - F.length(p["body"])).alias("start"), F.length(p["body"]).alias("length")))))
        formatted = F.concat(F.array_join(F.transform(pieces, lambda p: F.concat(p["opening"], p["body"])), ""), F.lit(END))
        return F.struct(formatted.alias("formatted"), F.filter(every, lambda s: s.isNotNull()).alias("loss_spans"))

    return chats.select("conv_id", bound(bound(F.col("turns"), merged), written).alias("w")).select("conv_id", "w.formatted", "w.loss_spans")


def read_chats(chats: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, formatted, turns (role, text) and loss_text, from the string and the spans alone.

    The string is split once, and spans are found among the places of its texts, in the order of both. Spans that are not those of whole texts
    are cut out of the string instead. Equal rows give equal rows, a null conv_id stays null, an empty table gives no rows; other
    columns are ignored.
    """
    def parts_of(b: Column, k: Column) -> Column:
        colon = F.instr(b, COLON)
        role = F.substring(b, F.lit(len(HEAD) + 1), colon - F.lit(len(HEAD) + 1))
        opening = F.when(k == 0, 0).otherwise(len(END)) + colon - 1 + len(COLON)
        texts = F.split(F.substring(b, colon + F.lit(len(COLON)), F.length(b)), PART, -1)
        return F.transform(texts, lambda p, i: F.struct(role.alias("role"), p.alias("body"), F.when(i == 0, opening).otherwise(len(PART)).alias("gap")))

    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")
    parts = F.flatten(F.transform(blocks, parts_of))

    def read(parts: Column) -> Column:
        turns = F.transform(parts, lambda p: F.struct(unescape(p["role"], role=True).alias("role"), unescape(p["body"]).alias("text")))
        ends = running(F.transform(parts, lambda p: p["gap"] + F.length(p["body"])), lambda a, b: a + b)
        places = bound(ends, lambda e: F.transform(parts, lambda p, i: F.struct((F.get(e, i) - F.length(p["body"])).alias("start"), F.lit(1).alias("kind"), F.length(p["body"]).alias("length"), p["body"].alias("body"))))
        spans = F.transform("loss_spans", lambda s: F.struct(s["start"].cast("int").alias("start"), F.lit(0).alias("kind"), s["length"].cast("int").alias("length"), F.lit("").alias("body")))

        def covered(both: Column) -> Column:
            before = lambda i: F.get(both, i - 1)
            return F.filter(F.transform(both, lambda x, i: F.when((i > 0) & (x["kind"] == 1) & (before(i)["kind"] == 0) & (before(i)["start"] == x["start"]) & (before(i)["length"] == x["length"]), unescape(x["body"]))), lambda t: t.isNotNull())

        return F.struct(turns.alias("turns"), bound(F.sort_array(F.concat(spans, places)), covered).alias("loss"))

    out = chats.select("conv_id", "formatted", "loss_spans", bound(parts, read).alias("r"))
    cut = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    loss = F.when(F.size("r.loss") == F.size("loss_spans"), F.col("r.loss")).otherwise(cut)
    return out.select("conv_id", "formatted", F.col("r.turns").alias("turns"), F.array_join(loss, "").alias("loss_text"))
