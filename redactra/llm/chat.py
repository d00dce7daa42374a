"""Chat formatting of reply trees.

Messages that name their parent form trees.  Root-to-leaf paths are enumerated
by self-joins of a table of jumps, doubled each round, so a thread of n
messages takes log2(n) joins of narrow rows.  Branches are ranked by score, and
each path chosen is formatted as one conversation.

Format: ``<s>``, then for each turn ``<|role|>`` text ``<|end|>``, then ``</s>``.
Control strings inside a text are broken up by a backslash behind their first
character, and a backslash is doubled, so that no text can open or close a turn
and every text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, named, small_batches

START, STOP, END = "<s>", "</s>", "<|end|>"
#: Control strings of this and other public chat formats.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ESCAPE = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
_BACK = re.compile(r"\\\\|\\")
_TURN = re.compile(r"<\|(.*?)\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: "\\" if len(m[0]) == 2 else "", text)


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans (code points) that carry loss: the texts of ``loss_role``."""
    parts, at, spans = [START], len(START), []
    for role, text in turns:
        head, body = f"<|{escape(role)}|>", escape(text)
        parts += [head, body, END]
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join([*parts, STOP]), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from a formatted conversation."""
    if not (formatted.startswith(START) and formatted.endswith(STOP)):
        raise ValueError("not a formatted conversation")
    body, at, turns = formatted[len(START) : len(formatted) - len(STOP)], 0, []
    while at < len(body):
        m = _TURN.match(body, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _doubled(jumps: DataFrame) -> DataFrame:
    ahead = jumps.select(F.col("node").alias("from"), "to")
    second = jumps.select("node", F.col("to").alias("mid"))
    return cut(second.join(ahead, F.col("mid") == F.col("from")).select("node", "to"), "jumps")


def reply_paths(messages: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """``leaf``, ``node`` and ``distance`` from the leaf, for each message on the path of each leaf.

    A message is a leaf if no message names it as parent, and a root if its
    parent is null or missing.  Ids must be unique.  Messages in a cycle of
    parents, and all that hang on one, belong to no path.
    """
    own = messages.select(named(id_col).alias("node"), named(parent_col).alias("parent"))
    there = own.select(F.col("node").alias("there"))
    tables = [cut(own.join(there, F.col("parent") == F.col("there"), "left_semi").select("node", F.col("parent").alias("to")), "jumps")]
    # the k-th table jumps 2^k messages up; it is empty once no path is as long, unless there is a cycle
    most = max(1, tables[0].count()).bit_length()
    while len(tables) <= most and not tables[-1].isEmpty():
        tables.append(_doubled(tables[-1]))
    lost = None if tables[-1].isEmpty() else tables[-1].select(F.col("node").alias("lost"))
    leaves = own.join(tables[0].select("to").distinct(), F.col("node") == F.col("to"), "left_anti")
    if lost is not None:
        leaves = leaves.join(lost, F.col("node") == F.col("lost"), "left_anti")
    paths = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    for k, jumps in enumerate(tables):
        if k and lost is None and k == len(tables) - 1:
            break  # empty
        ahead = jumps.select(F.col("node").alias("from"), "to")
        further = paths.join(ahead, F.col("node") == F.col("from")).select("leaf", F.col("to").alias("node"), (F.col("distance") + (1 << k)).alias("distance"))
        paths = cut(paths.unionByName(further), "paths")
    return paths


def format_trees(
    messages: DataFrame, id_col: str, parent_col: str, tree_col: str, role_col: str = "role", text_col: str = "text", score_col: str | None = None, top: int = 1, loss_role: str = "assistant"
) -> DataFrame:
    """One row for each chosen path: tree, leaf, rank, n_turns, formatted, loss_spans.

    A tree's branches rank by the sum of their messages' scores (null: 0), then
    length, then the smaller leaf; ``top`` of them are formatted.  Null roles
    and texts count as empty, a null tree is a tree; an empty table gives an
    empty result.  Messages of a path are sorted within its
    partition and streamed, so memory holds one conversation at a time.
    """
    small_batches(messages.sparkSession)
    score = F.coalesce(named(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    # ids, trees and scores are settled once; the texts are joined once, to the paths chosen
    thin = cut(messages.select(named(id_col).alias("m"), named(parent_col).alias("parent"), named(tree_col).alias("tree"), score.alias("score")), "messages")
    body = messages.select(named(id_col).alias("m"), F.coalesce(named(role_col), F.lit("")).alias("role"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    paths = reply_paths(thin, "m", "parent")
    weighed = paths.join(thin.select("m", "score"), F.col("node") == F.col("m")) if score_col else paths.withColumn("score", F.lit(0.0))
    scored = weighed.groupBy("leaf").agg(F.sum("score").alias("score"), F.count("*").alias("turns"))
    tree_of = thin.select(F.col("m").alias("l"), "tree")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("turns"), "leaf")
    chosen = scored.join(tree_of, F.col("leaf") == F.col("l")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("tree", "leaf", "rank")
    lines = paths.join(chosen, "leaf").join(body, F.col("node") == F.col("m")).select("tree", "leaf", "rank", "distance", "role", "text")
    dealt = lines.repartition(F.col("leaf")).sortWithinPartitions("leaf", F.desc("distance"))
    kinds = dict(lines.dtypes)
    schema = f"tree {kinds['tree']}, leaf {kinds['leaf']}, rank int, n_turns long, formatted string, loss_spans array<array<long>>"
    names = ["tree", "leaf", "rank", "n_turns", "formatted", "loss_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, done = None, [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kind = [tree_type, leaf_type, pa.int32(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kind, strict=True)], names=names)

        def close() -> None:
            formatted, spans = format_turns(turns, loss_role)
            done.append((*now, len(turns), formatted, [list(s) for s in spans]))

        tree_type = leaf_type = None
        for b in batches:
            tree_type, leaf_type = b.column(0).type, b.column(1).type
            for tree, leaf, rank, role, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4, 5)), strict=True):
                if now is None or now[1] != leaf:
                    if now is not None:
                        close()
                    now, turns = (tree, leaf, rank), []
                turns.append((role, text))
            if done:
                yield flush()
        if now is not None:
            close()
            yield flush()

    return dealt.mapInArrow(run, schema)


def conversation_messages(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Linear conversations as trees: each row replies to the row before it (by turn, then role and text).

    Adds mid and parent; ids are structs of conversation and place.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(named(conv_col).alias("conv_id"), named(turn_col).alias("turn"), "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order).cast("long"))
    ident = lambda place: F.struct(F.coalesce("conv_id", F.lit(-(1 << 62))).alias("conv"), place.alias("place"))
    parent = F.when(F.col("place") > 1, ident(F.col("place") - 1))
    return placed.select("conv_id", "role", "text", ident(F.col("place")).alias("mid"), parent.alias("parent"))


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the formatted texts: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    small_batches(formatted.sparkSession)
    rows = formatted.select("tree", "formatted", "loss_spans")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                loss = "".join(unescape(text[a:z]) for a, z in spans)
                out.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, f"conv_id {dict(rows.dtypes)['tree']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
