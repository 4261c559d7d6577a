"""Chat formatting: reply trees, their root-to-leaf paths, and a reversible template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, ship

# The template's control strings.
BOS, EOS, INST, END_INST = "<s>", "</s>", "[INST]", "[/INST]"
_ESCAPE = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
_UNESCAPE = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])")


def _pieces(m: re.Match) -> tuple[str, str, str]:
    return (m[1], m[2], m[3]) if m[1] else (m[4], m[5], m[6])


def escape(text: str) -> str:
    """Break every control string by one backslash after its first character; runs of backslashes there grow by one."""
    return _ESCAPE.sub(lambda m: "{}\\{}{}".format(*_pieces(m)), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "".join(_pieces(m)), text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the code point spans of assistant texts (the loss mask)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BOS}{INST} {escape(role)} {END_INST} ", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, EOS]
        at += len(head) + len(body) + len(EOS)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns in a formatted conversation."""
    turns = []
    for piece in formatted.split(EOS)[:-1]:
        role, _, text = piece.removeprefix(f"{BOS}{INST} ").partition(f" {END_INST} ")
        turns.append((unescape(role), unescape(text)))
    return turns


def masked_texts(formatted: str, spans: list[tuple[int, int]]) -> list[str]:
    return [unescape(formatted[a:b]) for a, b in spans]


def paths(nodes: DataFrame, all_leaves: bool = False) -> DataFrame:
    """Chosen root-to-leaf paths of reply trees: rows (tree, leaf, rank, depth, node).

    nodes: (tree, node, parent, score); nodes are unique in their tree, roots have a null or unknown parent. Self-joins
    double the reach of each node's pointer upward, so a path of n nodes takes log2(n) joins, and no row ever holds a
    path. A branch's score is the sum of its nodes' scores (null: 0); branches of a tree rank by score, then by the
    smaller leaf. Only rank 1 is kept unless all_leaves. Pointers that run in a circle reach no root and give no path.
    """
    base = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = base.select("tree", F.col("node").alias("parent")).withColumn("__known", F.lit(True))
    first = base.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("__known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).alias("hops"))
    longest = base.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    first = saved(first, "reply-nodes")
    done, active, jumps = first.where("up is null"), first.where("up is not null"), []
    for _ in range(int(max(longest - 1, 0)).bit_length()):
        # Only nodes that have not reached their root go on; the others are looked up.
        jumps.append(active.select("tree", "node", "up"))
        above = done.unionByName(active).select("tree", F.col("node").alias("up"), F.col("up").alias("__up"), F.col("total").alias("__t"), F.col("hops").alias("__h"))
        reach = active.join(above, ["tree", "up"]).select("tree", "node", F.col("__up").alias("up"), (F.col("total") + F.col("__t")).alias("total"), (F.col("hops") + F.col("__h")).alias("hops"))
        reach = saved(reach, "reply-nodes")
        done, active = done.unionByName(reach.where("up is null")), reach.where("up is not null")
    inner = first.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = done.join(inner, ["tree", "node"], "left_anti")
    if all_leaves:
        chosen = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "node"))).select("tree", F.col("node").alias("leaf"), "rank", "node")
    else:
        best = leaves.groupBy("tree").agg(F.min_by("node", F.struct(-F.col("total"), F.col("node"))).alias("node"))
        chosen = best.select("tree", F.col("node").alias("leaf"), F.lit(1).alias("rank"), "node")
    chosen = saved(chosen, "reply-paths")
    for jump in reversed(jumps):
        step = chosen.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"))
        chosen = chosen.unionByName(saved(step, "reply-paths"))
    return chosen.join(done.select("tree", "node", F.col("hops").alias("depth")), ["tree", "node"]).select("tree", "leaf", "rank", "depth", "node")


def format_trees(nodes: DataFrame, all_leaves: bool = False) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, roles, texts, formatted, loss_spans (start, end in code points).

    nodes: (tree, node, parent, score, role, text). Null roles and texts count as empty, texts stay whole, null trees
    are dropped (they name no tree), an empty table gives no rows. Columns of other names are ignored. A path becomes
    one row, as one conversation is one training example.
    """
    found = paths(nodes, all_leaves)
    texts = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = found.join(texts, ["tree", "node"]).groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    @F.pandas_udf("formatted string, loss_spans array<struct<start:long,end:long>>")
    def udf(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [format_turns(list(zip(r, t, strict=True))) for r, t in zip(roles, texts, strict=True)]
        return pd.DataFrame({"formatted": [f for f, _ in rows], "loss_spans": [[{"start": a, "end": b} for a, b in s] for _, s in rows]})

    out = turns.select("tree", "leaf", "rank", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    return out.withColumn("__f", udf("roles", "texts")).select("tree", "leaf", "rank", "roles", "texts", "__f.formatted", "__f.loss_spans")


def turns_as_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Flat conversations as reply trees: each row answers the one before it by turn (null turns first; ties by role and text)."""
    order = W.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("long")
    return turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("tree"), node.alias("node"), "role", "text").withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when they are read back: counts and digests per conversation."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def udf(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, mask in zip(texts, spans, strict=True):
            turns = read_back(text)
            loss = "".join(masked_texts(text, [(s["start"], s["end"]) for s in mask]))
            both = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((len(turns), hashlib.sha256(both.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.withColumn("__d", udf("formatted", "loss_spans")).select(F.col("tree").alias("conv_id"), "__d.*")


ship(__name__)
