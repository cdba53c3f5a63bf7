"""Chat formatting of reply trees.

Messages form trees by parent. Paths from roots to leaves are enumerated by self-joins that double
the distance of known ancestors in each round; branches are ranked by score and each chosen path becomes
one conversation in a template. Control strings inside texts are escaped, reversibly.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, prepared, written

#: Fixed values of the template. A turn is OPEN role NEXT text CLOSE.
OPEN, NEXT, CLOSE = "<|turn|>", "<|text|>", "</|turn|>"
ESCAPE = "\\"
#: Strings with a meaning to this template or to common others; one inside a text is escaped before its last character.
CONTROLS = (OPEN, NEXT, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED = "assistant"

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)) + "|" + re.escape(ESCAPE))
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(NEXT)}(.*?){re.escape(CLOSE)}", re.DOTALL)


def escaped(text: str) -> str:
    """text without control strings: an escape sign is doubled, and one goes before a control string's last character."""
    return _CONTROL.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][:-1] + ESCAPE + m[0][-1], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def formatted(turns: list[tuple[str, str]]) -> str:
    """One conversation of (role, text) in the template."""
    return "".join(f"{OPEN}{escaped(role)}{NEXT}{escaped(text)}{CLOSE}" for role, text in turns)


def read_back(conversation: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """The turns of a formatted conversation, and the spans under the loss mask (texts of learned roles, as they stand)."""
    turns, mask = [], []
    for m in _TURN.finditer(conversation):
        role = unescaped(m[1])
        turns.append((role, unescaped(m[2])))
        if role == LEARNED:
            mask.append(m.span(2))
    return turns, mask


def one_row_an_id(messages: DataFrame, columns: list[str]) -> DataFrame:
    """Of messages (id and columns) that repeat an id the row least by the columns in their order, nulls first; null ids go."""
    rest = [c for c in columns if c != "id"]
    least = messages.where("id is not null").groupBy("id").agg(F.min(F.struct(*rest)).alias("row"))
    return least.select("id", *[F.col("row")[c].alias(c) for c in rest])


def _steps_of(nodes: DataFrame) -> DataFrame:
    """As root_to_leaf_steps, of nodes (id, parent) without repeated ids, in a table that can be read several times.

    Roots never meet the join on parents, so that a forest's many null parents make no task large.
    """
    links = nodes.where("parent is not null").join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi")
    jumps = [written(links.select("id", F.col("parent").alias("up")), "jumps")]
    n_links = jumps[0].count()
    while 2 ** (len(jumps) - 1) <= n_links and not jumps[-1].isEmpty():
        further = jumps[-1].select(F.col("id").alias("up"), F.col("up").alias("next"))
        jumps.append(written(jumps[-1].join(further, "up").select("id", F.col("next").alias("up")), "jumps"))
    endless = jumps.pop()  # further from a root than there are links
    leaves = nodes.select("id").join(jumps[0].select(F.col("up").alias("id")) if jumps else endless.select("id"), "id", "left_anti").join(endless, "id", "left_anti")
    steps = written(leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("height")), "leaves")
    for k in reversed(range(len(jumps))):
        climbed = steps.join(jumps[k], "id").select("leaf", F.col("up").alias("id"), (F.col("height") + 2**k).alias("height"))
        steps = steps.union(written(climbed, "climbed"))
    discard(endless, *jumps)
    return steps


def root_to_leaf_steps(messages: DataFrame) -> DataFrame:
    """All root-to-leaf paths of messages (id, parent), a row for each message on them: leaf, id, height (0 at the leaf).

    A message whose parent is null or absent is a root. Self-joins first find every message's ancestor at
    distance 1, 2, 4 and so on, as far as one has any; then the leaves climb, the farthest jump first, so that each round adds the
    ancestors whose distance has that binary digit. Depth d takes log2(d) rounds of each kind, and only what lies on a
    leaf's path becomes a row. Messages on a cycle, or below one, have no root and are left out; null ids too. Of rows that
    repeat an id the one of least parent is used, a null parent first. An empty table has no paths.
    """
    return _steps_of(written(one_row_an_id(messages, ["id", "parent"]), "nodes"))


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """The paths of root_to_leaf_steps as one row each: leaf, root, path (ids from root to leaf)."""
    whole = root_to_leaf_steps(messages).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("height", "id")), asc=False).alias("steps"))
    path = F.transform("steps", lambda x: x["id"])
    return whole.select("leaf", F.get(path, F.lit(0)).alias("root"), path.alias("path"))


def format_reply_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """Conversations of messages (id, parent, role, text, score): root, leaf, rank, score, conversation, loss_spans.

    A branch's score is the sum of its messages' scores (null counts as 0); the best ones of each root are taken, all of them for None,
    ties by leaf. Null texts and roles are empty. loss_spans are the code point ranges of learned texts in
    the conversation. Of rows that repeat an id the least by parent, role, text and score, nulls first, is the message, with its own
    parent; rows of null id go. Other columns are ignored. A very long text is formatted whole, in one string; an empty table gives no conversation.
    """
    prepared(messages.sparkSession)
    own = written(one_row_an_id(messages, ["id", "parent", "role", "text", "score"]), "messages")
    own = own.select("id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    steps = _steps_of(own.select("id", "parent"))
    branches = steps.join(own.select("id", "score"), "id").groupBy("leaf").agg(F.max_by("id", "height").alias("root"), F.sum("score").alias("total"))
    ranked = branches.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.col("total").desc(), "leaf")))
    chosen = ranked if best is None else ranked.where(F.col("rank") <= best)
    turns = steps.join(chosen, "leaf").join(own.select("id", "role", "text"), "id")
    whole = turns.groupBy("root", "leaf", "rank", "total").agg(F.sort_array(F.collect_list(F.struct((-F.col("height")).alias("step"), "role", "text"))).alias("turns"))

    def write(frames):
        for frame in frames:
            out = [formatted([(t["role"], t["text"]) for t in turns]) for turns in frame.turns]
            spans = [[{"start": a, "stop": b} for a, b in read_back(c)[1]] for c in out]
            yield pd.DataFrame({"root": frame.root, "leaf": frame.leaf, "rank": frame["rank"], "score": frame.total, "conversation": out, "loss_spans": spans})

    kind = messages.schema["id"].dataType.simpleString()
    return whole.mapInPandas(write, f"root {kind}, leaf {kind}, rank int, score double, conversation string, loss_spans array<struct<start:int,stop:int>>")


def digests(conversations: DataFrame, id_column: str) -> DataFrame:
    """What can be read back from formatted conversations: ids, counts and digests of turns and of learned text.

    Every row is read by itself, so repeated rows and null ids stay; a null conversation has no turns, as an empty one.
    """

    def read(frames):
        for frame in frames:
            rows = []
            for key, conversation in zip(frame[id_column], frame.conversation, strict=True):
                conversation = conversation or ""
                turns, mask = read_back(conversation)
                learned = "".join(unescaped(conversation[a:b]) for a, b in mask)
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), learned)]
                rows.append((key, len(turns), sha[0], len(learned), sha[1], len(conversation)))
            yield pd.DataFrame(rows, columns=[id_column, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = conversations.schema[id_column].dataType.simpleString()
    return conversations.select(id_column, "conversation").mapInPandas(read, f"{id_column} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text) as trees without branches; ties of turn go by role and text, nulls first.

    Ids are structs (conv_id, place), so a conversation's root is its first row; a null conv_id is a conversation too. Repeated rows
    are turns each, and other columns are ignored; an empty table has no messages.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    at = lambda p: F.struct(F.col("conv_id").cast("long").alias("conv_id"), p.cast("long").alias("place"))
    placed = conversations.select("conv_id", "turn", "role", "text").withColumn("_place", place)
    return placed.select(at(F.col("_place")).alias("id"), F.when(F.col("_place") > 1, at(F.col("_place") - 1)).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
