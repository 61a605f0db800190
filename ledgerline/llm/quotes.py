"""Quotation linking: messages without their quotes, in reply order, all in DataFrame functions.

Lines that begin with ``>`` are quotes; the number of such marks, blanks between them
aside, is the level. Successive lines of one level are a run, and so are successive own
lines; lines without any letter or digit part the paragraphs of a run and tell no message.
Passages are compared by their letters and digits without case, marks, blanks and line
breaks, so they are found however a mail client wraps them. The own passages of a message
are its runs, their paragraphs, and any two neighbouring paragraphs; a passage belongs to
the earliest message of its conversation that has it.

A quoted run is looked up as a whole. If no earlier message has it, each of its paragraphs
is; of a paragraph that is not found, each line belongs to the earliest message that has it
as an own line, normalised (case, marks and blanks folded). A quoted line that none of these
finds stays unlinked. Lookups compare the conversation and a hash of the passage or line.

A message replies to the message that its quotes of the lowest linked level come from:
that with most lines, the latest one of equals. Messages linked so are a thread, named by
its first message. Reply order is by the first message of the thread, then by turn: every
message comes after the one it replies to. Threads are found by pointer jumping, in as
many rounds as the logarithm of the longest chain of replies.

The own text is the text without quoted lines and without the line that announces a
quote (it ends with a colon, names a writer, and the quote follows).

Defined results: a NULL or empty text has no lines and no quotes, its own text is empty; a
message whose conversation or turn is NULL is a thread of its own; rows that repeat
(conversation, turn) are answered each, and count as one original; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.numbering import in_ranges, row_number_in_ranges
from ledgerline.sources.workspace import Workspace

QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
# The line before a quote that says whose it is, in some languages (fixed values).
ANNOUNCEMENT = r"(?i)^.*\b(wrote|writes|said|schrieb|écrit|escribió)\b.*:[ \t]*$"
# Signs that part passages, and their level from their lines, inside a text.
_BEGIN, _LEVEL = "\x01", "\x02"


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, QUOTE, 1)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def normalised(line: Column) -> Column:
    """The words of a line without case and marks, one blank apart."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(line, QUOTE, "")), r"[^\p{L}\p{N}]+", " ")
    return F.trim(bare)


def _runs(messages: DataFrame, *keys: str) -> DataFrame:
    """One row per run: ``keys``, ``place``, ``level``, ``paragraphs`` of normalised lines."""
    text = F.translate(F.coalesce("text", F.lit("")), _BEGIN + _LEVEL, "")
    lines = F.split(text, "\r?\n")
    levels = F.transform(lines, quote_level)
    before = F.slice(F.concat(F.array(F.lit(-1)), levels), 1, F.size(lines))
    beside = F.arrays_zip(lines.alias("line"), levels.alias("level"), before.alias("before"))
    # A line that goes on with the passage follows a break, another one begins with its level.
    marked = F.transform(
        beside,
        lambda x: F.concat(
            F.when(x["level"] == x["before"], F.lit("\n")).otherwise(
                F.concat(F.lit(_BEGIN), x["level"].cast("string"), F.lit(_LEVEL))
            ),
            x["line"],
        ),
    )
    # A text without any mark is one passage.
    run_on = F.when(text.contains(">"), F.array_join(marked, "")).otherwise(F.concat(F.lit(f"0{_LEVEL}"), text))
    split = messages.select(*keys, F.posexplode(F.split(run_on, _BEGIN)).alias("place", "passage"))
    body = F.split(F.substring_index("passage", _LEVEL, -1), "\r?\n")
    plain = F.array_join(F.transform(body, normalised), "\n")
    level = F.substring_index("passage", _LEVEL, 1).cast("int").alias("level")
    return (
        split.where("passage <> ''")
        .select(*keys, "place", level, F.regexp_replace(plain, r"^\n+|\n+$", "").alias("run"))
        .where("run <> ''")
        .select(*keys, "place", "level", F.split("run", "\n{2,}").alias("paragraphs"))
    )


def _passage_hash(*paragraphs: Column) -> Column:
    return F.xxhash64(F.lit("passage"), F.regexp_replace(F.concat(*paragraphs), "[ \n]", ""))


def _line_hashes(paragraph: Column) -> Column:
    return F.transform(F.split(paragraph, "\n"), lambda x: F.xxhash64(x))


def own_text(text: Column) -> Column:
    """The text without quoted and announcing lines, and without blank lines at its ends."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    levels = F.transform(lines, quote_level)
    # Each line beside its own level and that of the next line.
    beside = F.arrays_zip(
        lines.alias("line"), levels.alias("level"), F.slice(levels, 2, F.size(lines)).alias("next")
    )
    kept = F.filter(
        beside,
        lambda x: (x["level"] == 0)
        & ~((F.coalesce(x["next"], F.lit(0)) > 0) & x["line"].rlike(ANNOUNCEMENT)),
    )
    joined = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return F.regexp_replace(joined, r"^\s*\n|\s+$", "")


def _replies(messages: DataFrame) -> DataFrame:
    """(conversation, turn, text hash), the turn replied to, and how many quoted lines are linked.

    Both sides are reduced before they meet: originals to one row per passage or line of a
    conversation, quotes to one row per message, run and passage or line of it, so a line that
    everybody writes or quotes is no group.
    """
    known = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    paragraphs = F.col("paragraphs")
    whole = _passage_hash(F.array_join(paragraphs, ""))
    # No sequence without neighbours: sequence(1, 0) would count down.
    neighbours = F.when(
        F.size(paragraphs) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(paragraphs) - 1),
            lambda i: _passage_hash(F.get(paragraphs, i - 1), F.get(paragraphs, i)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    own = F.concat(
        F.array(whole), F.transform(paragraphs, lambda x: _passage_hash(x)), neighbours,
        F.flatten(F.transform(paragraphs, _line_hashes)),
    )
    originals = (
        _runs(known, "conv_id", "turn")
        .where("level = 0")
        .select("conv_id", "turn", F.explode(own).alias("hash"))
        .groupBy("conv_id", "hash")
        .agg(F.min("turn").alias("original"))
    )
    message = ("conv_id", "turn", "text_hash")
    quoting = known.where(F.col("text").contains(">")).withColumn("text_hash", F.xxhash64("text"))
    run = (*message, "place", "level")

    def part(tier: int, number: Column, hashed: Column, lines: Column) -> Column:
        return F.struct(
            F.lit(tier).alias("tier"), number.alias("paragraph"), hashed.alias("hash"), lines.alias("lines")
        )

    def of_paragraph(paragraph: Column, number: Column) -> Column:
        hashes = _line_hashes(paragraph)
        entire = part(1, number, _passage_hash(paragraph), F.size(hashes))
        return F.concat(F.array(entire), F.transform(hashes, lambda x: part(2, number, x, F.lit(1))))

    lines = F.aggregate(paragraphs, F.lit(0), lambda n, x: n + F.size(F.split(x, "\n")))
    parts = F.concat(
        F.array(part(0, F.lit(-1), whole, lines)), F.flatten(F.transform(paragraphs, of_paragraph))
    )
    quoted = (
        _runs(quoting.dropDuplicates(message), *message)
        .where("level > 0")
        .select(*run, F.explode(parts).alias("part"))
        .select(*run, "part.*")
        .groupBy(*run, "tier", "paragraph", "hash")
        .agg(F.sum("lines").alias("n"))
    )
    linked = (
        quoted.join(originals, ["conv_id", "hash"])
        .where("original < turn")
        .groupBy(*run, "paragraph", "tier", "original")
        .agg(F.sum("n").alias("n"))
    )
    # A run that is found as a whole stands for its paragraphs, a paragraph for its lines.
    of_run = F.min("tier").over(Window.partitionBy(*run))
    of_part = F.min("tier").over(Window.partitionBy(*run, "paragraph"))
    per_original = (
        linked.withColumn("of_run", of_run)
        .withColumn("of_part", of_part)
        .where("tier = IF(of_run = 0, 0, of_part)")
        .groupBy(*message, "level", "original")
        .agg(F.sum("n").alias("n"))
    )
    # The least of (level, -lines, -turn): the lowest level, the most lines, the latest message.
    choice = F.struct("level", (-F.col("n")).alias("n"), (-F.col("original")).alias("back"))
    return (
        per_original.groupBy(*message)
        .agg(F.min(choice).alias("best"), F.sum("n").alias("linked_lines"))
        .select(*message, (-F.col("best.back")).alias("reply_to"), "linked_lines")
    )


def _threads(links: DataFrame, workspace: Workspace) -> DataFrame:
    """``conv_id``, ``turn``, ``thread`` and ``depth`` of every turn that replies to another.

    Each round every pointer jumps to where its target points, until all point to a turn
    that does not reply. Pointers lead to lesser turns, so there are no rings.
    """
    now = workspace.table("pointers", lambda: links.withColumn("depth", F.lit(1)))
    round_no = 0
    while True:
        target = now.select(
            F.col("conv_id").alias("target_conv"),
            F.col("turn").alias("target_turn"),
            F.col("thread").alias("next_thread"),
            F.col("depth").alias("more"),
        )
        there = (F.col("conv_id") == F.col("target_conv")) & (F.col("thread") == F.col("target_turn"))
        jumped = now.join(target, there, "left").select(
            "conv_id",
            "turn",
            F.coalesce("next_thread", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next_thread").isNotNull().alias("moved"),
        )
        round_no += 1
        stepped = workspace.table(f"pointers_{round_no}", lambda jumped=jumped: jumped)
        now = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return now


def link_quotes(messages: DataFrame, workspace: Workspace) -> DataFrame:
    """One row per message: its own text, what it replies to, and its place in reply order.

    ``messages`` has ``conv_id``, ``turn``, ``role`` and ``text``; ``depth`` counts the replies from
    the first message of the thread on, ``position`` the messages of the conversation.
    """
    whole = messages.select("conv_id", "turn", "role", "text")
    replies = workspace.table("replies", lambda: _replies(whole))
    links = replies.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread"))
    threads = _threads(links, workspace)
    levels = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), quote_level)
    linked = (
        whole.withColumn("text_hash", F.xxhash64("text"))
        .join(replies, ["conv_id", "turn", "text_hash"], "left")
        .join(threads, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            own_text(F.col("text")).alias("own_text"),
            F.size(F.filter(levels, lambda x: x > 0)).cast("long").alias("quoted_lines"),
            F.coalesce(F.array_max(levels), F.lit(0)).cast("long").alias("deepest_quote"),
            F.coalesce("linked_lines", F.lit(0)).cast("long").alias("linked_lines"),
            "reply_to",
            F.coalesce("thread", "turn").alias("thread"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
            # A key that is never NULL, to count a conversation's messages by.
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conversation"),
        )
    )
    # A conversation may hold most of all messages, so they are counted piece by piece.
    order = ["conversation", "thread", "turn", "own_text", "role"]
    ranged = in_ranges(linked, order, workspace, "ordered")
    numbered = row_number_in_ranges(ranged, order[1:], ("conversation",))
    return numbered.withColumn("position", F.col("row_number").cast("long")).select(
        "conv_id", "turn", "role", "own_text", "quoted_lines", "deepest_quote",
        "linked_lines", "reply_to", "thread", "depth", "position",
    )
