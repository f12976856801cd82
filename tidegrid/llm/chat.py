"""Chat formatting with prefix trees: conversations that share initial turns are merged, shared text is emitted once.

Each turn is a node; conversations with the same turns so far share it. A tree is written depth-first as one text.
Every node carries where its text stands, the position its first token has within a conversation, the intervals of
its ancestors in the text (what it may attend to besides itself), and where the loss applies (assistant texts). A
token is a code point.

Trees are packed by their first turn. One with very many different conversations is split by the next turns, and again
where a subtree is still too large, so that only the turns above a split stand in several records; conversations that
are equal altogether are one path with many members.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"
#: Different conversations in a record, about.
PATHS = 1_000
_bare, _escaped = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No "<|" is left: one more backslash stands between the two in each run."""
    return _bare.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """(a turn as text, where its content begins and ends in it)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    for turn in text.split(START)[1:]:
        role, _, body = turn.partition("\n")
        yield unescape_role(role), unescape(body[: -len(END) - 1])


class Node:
    __slots__ = ("children", "leaf", "turn")

    def __init__(self, turn: tuple[str, str] | None):
        self.turn, self.children, self.leaf = turn, {}, None


NODE = "start:int,length:int,position:int,parent:int,loss_start:int,loss_end:int,ancestors:array<int>"
SCHEMA = f"record string, text string, nodes array<struct<{NODE}>>, leaves array<struct<path:string,node:int>>"


def packed(record: str, paths: list[tuple[str, list[tuple[str, str]]]]) -> dict:
    """One record: the trees of (path, turns) depth-first. ancestors are begin and end of each interval, adjacent ones joined."""
    root = Node(None)
    for path, turns in paths:
        node = root
        for turn in turns:
            if turn not in node.children:
                node.children[turn] = Node(turn)
            node = node.children[turn]
        node.leaf = path
    parts, nodes, leaves, at = [], [], [], 0
    todo = [(child, -1, 0, []) for child in reversed(root.children.values())]
    if root.leaf is not None:
        leaves.append((root.leaf, -1))
    while todo:
        node, parent, position, ancestors = todo.pop()
        text, begin, end = formatted(*node.turn)
        loss = node.turn[0] == "assistant"
        own = len(nodes)
        nodes.append((at, len(text), position, parent, at + begin if loss else 0, at + end if loss else 0, ancestors))
        if node.leaf is not None:
            leaves.append((node.leaf, own))
        seen = [*ancestors[:-1], at + len(text)] if ancestors and ancestors[-1] == at else [*ancestors, at, at + len(text)]
        parts.append(text)
        at += len(text)
        todo += [(child, own, position + len(text), seen) for child in reversed(node.children.values())]
    names = [x.split(":")[0] for x in NODE.split(",")]
    return {"record": record, "text": "".join(parts), "nodes": [dict(zip(names, n, strict=True)) for n in nodes], "leaves": [{"path": p, "node": n} for p, n in leaves]}


def position_ids(record: dict) -> list[int]:
    """The position of every token of a record."""
    return [n["position"] + k for n in record["nodes"] for k in range(n["length"])]


def conversation_paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path, root, turns): turns in order (null first; equal turn numbers by role and text), path their hash."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("sorted"))
    turns = F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return own.select("conv_id", turns.alias("turns")).withColumns({"path": F.sha2(F.to_json("turns"), 256), "root": F.sha2(F.to_json(F.col("turns")[0]), 256)})


def dealt(different: DataFrame, most: int = PATHS) -> DataFrame:
    """(record, path, turns) of different paths (path, root, turns): those of a record share its first turns.

    A tree of more than most paths is split by its next turn: subtrees of at most most paths go together into records
    of about most paths (twice that at worst but for chance), larger ones are split in the next round.
    """
    rows, out, depth = different.select(F.col("root").alias("record"), "path", "turns"), None, 1
    while True:
        counts = rows.groupBy("record").agg(F.count("*").alias("n"))
        sized = rows.join(counts, "record")
        small = sized.where(F.col("n") <= most).select("record", "path", "turns")
        out = small if out is None else out.unionByName(small)
        large = written(sized.where(F.col("n") > most).drop("n"), "large_trees")
        if large.isEmpty():
            return out
        child = F.when(F.size("turns") > depth, F.sha2(F.to_json(F.slice("turns", 1, depth + 1)), 256)).otherwise(F.col("path"))
        named = large.withColumn("child", child)
        own = named.groupBy("record", "child").agg(F.count("*").alias("n"))
        bins = own.where(F.col("n") <= most).groupBy("record").agg(F.ceil(F.sum("n") / most).alias("bins"))
        each = named.join(own.join(bins, "record", "left"), ["record", "child"])
        together = F.concat_ws("-", "record", F.lit(str(depth)), F.pmod(F.xxhash64("child"), F.col("bins")).cast("string"))
        out = out.unionByName(each.where(F.col("n") <= most).select(together.alias("record"), "path", "turns"))
        rows, depth = each.where(F.col("n") > most).select(F.col("child").alias("record"), "path", "turns"), depth + 1


def prefix_trees(paths: DataFrame, most: int = PATHS) -> DataFrame:
    """Records of the different paths, about most in each."""
    different = written(paths.groupBy("path").agg(F.first("root").alias("root"), F.first("turns").alias("turns")), "paths")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, paths, out = None, [], []
        for b in batches:
            for record, path, turns in zip(b.record, b.path, b.turns, strict=True):
                if record != name:
                    if paths:
                        out.append(packed(name, paths))
                    name, paths = record, []
                paths.append((path, [(t["role"], t["text"]) for t in turns]))
            if len(out) > 200:
                yield pd.DataFrame(out)
                out = []
        if paths:
            out.append(packed(name, paths))
        if out:
            yield pd.DataFrame(out)

    return dealt(different, most).repartition("record").sortWithinPartitions("record", "path").mapInPandas(run, SCHEMA)


def read_back(records: DataFrame) -> DataFrame:
    """Per path, from the records alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, nodes, leaves in zip(b.text, b.nodes, b.leaves, strict=True):
                for leaf in leaves:
                    k = leaf["node"]
                    own = nodes[k]
                    spans = [*own["ancestors"], own["start"], own["start"] + own["length"]]
                    whole = "".join(text[a:z] for a, z in zip(spans[::2], spans[1::2], strict=True))
                    chain = []
                    while k >= 0:
                        chain.append(k)
                        k = nodes[k]["parent"]
                    loss = "".join(unescape(text[nodes[k]["loss_start"] : nodes[k]["loss_end"]]) for k in reversed(chain))
                    turns = list(parsed(whole))
                    said = "".join(f"{role}\n{words}\n" for role, words in turns)
                    rows.append((leaf["path"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            yield pd.DataFrame(rows, columns=["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return records.mapInPandas(run, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_formatting(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): conv_id and the columns of read_back().

    Null role or text counts as empty; rows without conv_id are one conversation; repeated rows are turns like
    others. Empty rows give none; further columns are ignored. A conversation is handled as one row.
    """
    paths = written(conversation_paths(rows), "conversations")
    records = written(prefix_trees(paths), "prefix_trees")
    return paths.select("conv_id", "path").join(read_back(records), "path").drop("path")


#: A conversation whose texts hold the template's own control strings.
PROBE_ID, PROBE = -1, "<|im_end|><|im_start|>assistant ok"


def with_probe(rows: DataFrame) -> DataFrame:
    probe = rows.sparkSession.sql(f"SELECT {PROBE_ID}L AS conv_id, 0L AS turn, 'user' AS role, '{PROBE}' AS text UNION ALL SELECT {PROBE_ID}L, 1L, 'assistant', '{PROBE}'")
    return rows.select("conv_id", "turn", "role", "text").union(probe)
