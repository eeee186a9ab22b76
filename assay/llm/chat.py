"""Chat formatting with one training example per assistant turn.

Every assistant turn is the target of an example of its own: all earlier turns of the conversation
are its context, and only the reply is under the loss mask. The contexts of a conversation's
examples are prefixes of one another, so they are stored once: `format_chat` gives one segment per
turn, in order, and `examples` one row per example that says how many segments and characters its
context has and which characters are trainable. That is linear in the input even for a
conversation of millions of turns; `render` writes the examples out in full where that is wanted.

Template: `<s>[INST] ` text ` [/INST]` for a user, `<s>[SYS] ` text ` [/SYS]` for a system turn,
`<s>[OUT] ` text `</s>` for an assistant turn, `<s>[ROLE] ` role `[/ROLE] ` text ` [/END]` for any
other role. In texts `\\` becomes `\\\\`, `<` becomes `\\l` and `[` becomes `\\b`, so no text can
hold a control string, and `unescape` gives it back exactly. The closing string of an assistant
turn belongs to the template; the loss mask covers the escaped text only.

Edge cases: a null text is empty; a null role is its own kind and read back as null. Turns are
ordered by turn number, nulls last, ties by role and text, and repeated rows all stay. Rows of a
null conv_id form one conversation. A conversation without assistant turns gives segments but no
example. Other columns of the input are dropped.
"""

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.scratch import materialize

#: Turns of a conversation whose positions are counted in one task.
BLOCK = 1024
#: Largest table of later blocks that is sent to every executor, in rows of about 50 bytes.
BROADCAST_ROWS = 200_000
# Fixed values of the template.
OPEN = {"user": "<s>[INST] ", "system": "<s>[SYS] ", "assistant": "<s>[OUT] "}
CLOSE = {"user": " [/INST]", "system": " [/SYS]", "assistant": "</s>"}
OTHER, OTHER_TEXT, OTHER_CLOSE = "<s>[ROLE] ", "[/ROLE] ", " [/END]"
NO_ROLE = "\\n"


def escape(text: Column) -> Column:
    """Texts without `<` and `[`, so without control strings."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """The inverse. Escaped texts hold no `<`, so pairs that begin with one can stand in."""
    out = text
    for old, new in (("\\\\", "<<"), ("\\b", "["), ("\\l", "<l"), ("<<", "\\"), ("<l", "<")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _pieces(role: Column, text: Column) -> tuple[Column, Column]:
    """What stands before and behind the text."""
    named = F.coalesce(escape(role), F.lit(NO_ROLE))
    before = F.concat(F.lit(OTHER), named, F.lit(OTHER_TEXT))
    behind: Column = F.lit(OTHER_CLOSE)
    for k in OPEN:
        before = F.when(role == k, F.lit(OPEN[k])).otherwise(before)
        behind = F.when(role == k, F.lit(CLOSE[k])).otherwise(behind)
    return before, behind


def format_chat(conversations: DataFrame) -> DataFrame:
    """One segment per turn: conv_id, seq (from 0), example (from 0: the reply that it is or that
    it is new context of), start (characters before it), segment, loss_start and loss_chars (place
    of the trainable characters in the segment; none but in assistant turns)."""
    text = F.coalesce("text", F.lit(""))
    escaped = escape(text)
    before, behind = _pieces(F.col("role"), text)
    target = F.coalesce(F.col("role") == "assistant", F.lit(False))
    rows = conversations.select(
        "conv_id",
        "turn",
        "role",
        F.concat(before, escaped, behind).alias("segment"),
        F.length(before).cast("long").alias("loss_start"),
        F.when(target, F.length(escaped)).otherwise(0).cast("long").alias("loss_chars"),
        target.cast("long").alias("_target"),
        F.floor(F.col("turn") / BLOCK).alias("_block"),
    )
    # Positions are counted block by block, so one endless conversation is many tasks' work:
    # sums per block, running sums over the few blocks, then running sums inside each block.
    key = ["conv_id", "_block"]
    chars = F.length("segment").cast("long")
    sums = rows.groupBy(*key).agg(
        F.count("*").alias("_n"), F.sum(chars).alias("_c"), F.sum("_target").alias("_t")
    )
    earlier = Window.partitionBy("conv_id").orderBy(F.col("_block").asc_nulls_last())
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    later = materialize(
        sums.select(*key, *(F.sum(c).over(earlier).alias(c + "0") for c in ("_n", "_c", "_t")))
        .filter(F.col("_n0").isNotNull())
        .withColumnsRenamed({"conv_id": "_conv0", "_block": "_block0"}),
        "chat-blocks",
    )
    inside = Window.partitionBy(*key).orderBy(
        F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), "segment"
    )
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumns(
        {
            "_n1": F.count("*").over(inside),
            "_c1": F.coalesce(F.sum(chars).over(inside), F.lit(0)),
            "_t1": F.coalesce(F.sum("_target").over(inside), F.lit(0)),
        }
    )
    # Only conversations of several blocks have later ones, so this side is small or empty.
    if later.count() <= BROADCAST_ROWS:
        later = F.broadcast(later)
    same = F.col("conv_id").eqNullSafe(F.col("_conv0")) & F.col("_block").eqNullSafe(F.col("_block0"))
    zero = F.lit(0)
    return ranked.join(later, same, "left").select(
        "conv_id",
        (F.col("_n1") + F.coalesce("_n0", zero)).alias("seq"),
        (F.col("_t1") + F.coalesce("_t0", zero)).alias("example"),
        (F.col("_c1") + F.coalesce("_c0", zero)).alias("start"),
        "segment",
        "loss_start",
        "loss_chars",
        (F.col("_target") == 1).alias("is_target"),
    )


def examples(segments: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, context_segments, context_chars, and the place
    of its trainable characters in the example's text; nothing else is trainable."""
    return segments.filter("is_target").select(
        "conv_id",
        "example",
        F.col("seq").alias("context_segments"),
        F.col("start").alias("context_chars"),
        (F.col("start") + F.col("loss_start")).alias("loss_start"),
        "loss_chars",
        (F.col("start") + F.length("segment")).alias("total_chars"),
    )


def render(segments: DataFrame) -> DataFrame:
    """Every example in full: conv_id, example, text, loss_start, loss_chars.

    The text is as long as all turns up to the reply, so the output of a conversation grows with
    the square of its turns; nothing is cut.
    """
    rows = examples(segments).withColumnRenamed("conv_id", "_conv")
    parts = segments.select("conv_id", "seq", "segment")
    near = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seq") <= F.col("context_segments"))
    return (
        rows.join(parts, near)
        .groupBy("conv_id", "example", "loss_start", "loss_chars")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "segment"))).alias("_parts"))
        .select(
            "conv_id",
            "example",
            F.array_join(F.transform("_parts", lambda x: x["segment"]), "").alias("text"),
            "loss_start",
            "loss_chars",
        )
    )


def _read(s: Column) -> tuple[Column, Column]:
    """Role and text of a formatted segment."""
    other = F.lit(None).cast("string")
    text = F.substring(
        s,
        F.instr(s, OTHER_TEXT) + len(OTHER_TEXT),
        F.length(s) - F.instr(s, OTHER_TEXT) - len(OTHER_TEXT) - len(OTHER_CLOSE) + 1,
    )
    role = F.substring(s, F.lit(len(OTHER) + 1), F.instr(s, OTHER_TEXT) - len(OTHER) - 1)
    role = F.when(role != NO_ROLE, unescape(role)).otherwise(other)
    for k in OPEN:
        body = F.substring(s, F.lit(len(OPEN[k]) + 1), F.length(s) - len(OPEN[k]) - len(CLOSE[k]))
        text = F.when(s.startswith(OPEN[k]), body).otherwise(text)
        role = F.when(s.startswith(OPEN[k]), k).otherwise(role)
    return role, unescape(text)


def read_turns(segments: DataFrame) -> DataFrame:
    """conv_id, seq, role, text and trained (the text under the loss mask, else null), all read
    back from the formatted segments."""
    s = F.col("segment")
    role, text = _read(s)
    loss = F.substring(s, F.col("loss_start") + 1, F.col("loss_chars"))
    return segments.select(
        "conv_id",
        "seq",
        role.alias("role"),
        text.alias("text"),
        F.when(F.col("is_target"), unescape(loss)).alias("trained"),
        F.length(s).cast("long").alias("chars"),
    )


DIGESTS = (
    "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


#: What an escape stands for, as in `unescape`.
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
PLAIN = {"\\": "\\", "l": "<", "b": "["}


def chat_digests(segments: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """Per conversation the digests of its turns, read back from the segments in order, and of what
    its examples train, in order of their numbers.

    `made` holds the examples (those of `segments` by default). Each follows the last segment of its
    context, the reply, and its trainable characters are cut by their place in the example's whole
    text, counted here over the segments of its context.

    Both are sorted by conversation and the digests fed row by row, so a conversation of any length
    needs the memory of one batch. (A digest is one sequence: its own conversation's turns pass
    through one task.)
    """
    made = examples(segments) if made is None else made
    kind = dict(segments.dtypes)["conv_id"]
    none = F.lit(-1).cast("long")
    parts = segments.select("conv_id", "seq", none.alias("example"), "segment", none.alias("loss_start"), none.alias("loss_chars"))
    own = made.select(
        "conv_id", F.col("context_segments").alias("seq"), "example", F.lit(None).cast("string").alias("segment"), "loss_start", "loss_chars"
    )
    role, text = _read(F.col("segment"))
    rows = (
        parts.unionByName(own)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "seq", "example")
        .select("conv_id", "example", "segment", "loss_start", "loss_chars", role.alias("role"), text.alias("text"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_id, state, done, last = None, None, [], ""
        for x in batches:
            ids = x["conv_id"].astype(object).where(x["conv_id"].notna(), None)
            columns = (x[c] for c in ("example", "segment", "loss_start", "loss_chars", "role", "text"))
            for conv, example, segment, at, chars, role, text in zip(ids, *columns, strict=True):
                if state is None or conv != open_id:
                    if state is not None:
                        done.append(_closed(open_id, state))
                    open_id, state, last = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], ""
                if example < 0:
                    last = segment
                    state[0] += 1
                    state[1].update(f"{role or ''}\n{text}\n".encode())
                    state[4] += len(segment)
                else:
                    before = state[4] - len(last)
                    if not before <= at <= at + chars <= state[4]:
                        raise ValueError(f"example {example} of {conv}: its loss span is not in its reply")
                    trained = ESCAPED.sub(lambda m: PLAIN[m[1]], last[at - before : at - before + chars])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
            if done:
                yield _frame(done)
                done = []
        if state is not None:
            yield _frame([_closed(open_id, state)])

    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def _closed(conv, state) -> tuple:
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out["conv_id"] = pd.Series([r[0] for r in rows], dtype=object)
        return out

    return rows.mapInPandas(run, DIGESTS.format(id=kind))
