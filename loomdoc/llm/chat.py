"""Chat formatting as prefix trees.

Conversations that share their first turns share those turns' characters: a
tree's turns are laid out depth-first, each once, and every turn carries the
position its first character has in its conversation and the intervals of the
layout that it may attend to, its ancestors and itself. A loss mask covers the
assistant's texts and nothing else.

The template, per turn (the end of a tree's text needs no mark):

    user       [INST] text [/INST]
    assistant   text</s>        (a space before, none after)
    system     <<SYS>>text<</SYS>>
    any other  <<ROLE name>>text<</ROLE>>

Inside texts and names a backslash becomes two, and the first character of
anything that looks like a control string gets a stand-in (``<`` becomes ``\\l``,
``[`` becomes ``\\b``), so no text holds a control string and every text comes
back as it was.

A tree holds conversations that share their first turn, about ``group_size`` at
most, so a first turn that a third of all conversations share isn't one task. More
are split where they part: a prefix that more of them share is a trunk, and what
goes on from a trunk by a turn that isn't one itself is a branch and stays whole.
Branches of a trunk are dealt to trees by their own hash, and each such tree
repeats the trunk's turns once; every other shared turn is in one tree alone. Only
conversations that are the same to their ends, or end within a trunk, are dealt by
their ids.

Defined cases: a null text or role is the empty one; rows of equal turn number
are ordered by role, then text; repeated rows are repeated turns; conversations
with a null id are one conversation; a conversation may share another's turns
wholly; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, hot_keys, materialize, replicated, salted, whole

CONTROL = re.compile(r"\\|<(?=/?s>|</?SYS>>|</?ROLE)|\[(?=/?INST\])")
STAND_IN = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
BACK = {"\\\\": "\\", "\\l": "<", "\\b": "["}
TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|<<ROLE (?P<role>.*?)>>(?P<other>.*?)<</ROLE>>| (?P<assistant>.*?)</s>", re.DOTALL)
TREES = "tree long, text string, nodes array<struct<parent:int,begin:int,end:int,loss_begin:int,loss_end:int,position:int,attention:array<struct<begin:int,end:int>>>>, leaves array<struct<conv_id:long,node:int>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: STAND_IN[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lb]", lambda m: BACK[m[0]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(a turn's characters, where its loss begins and ends in them)."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        return f" {body}</s>", 1, 1 + len(body)
    if role == "system":
        return f"<<SYS>>{body}<</SYS>>", 0, 0
    # a ">>" inside the name would end it
    return f"<<ROLE {escape(role).replace('>', chr(92) + 'g')}>>{body}<</ROLE>>", 0, 0


def parse(turn: str) -> tuple[str, str]:
    """(role, text) of a turn's characters."""
    m = TURN.fullmatch(turn)
    if not m:
        raise ValueError("not a turn of this template")
    for role in ("user", "system", "assistant"):
        if m[role] is not None:
            return role, unescape(m[role])
    return re.sub(r"\\[\\lbg]", lambda x: ">" if x[0] == "\\g" else BACK[x[0]], m["role"]), unescape(m["other"])


def build_tree(conversations: list[tuple[int | None, list[tuple[str, str]]]]) -> tuple[str, list[dict], list[dict]]:
    """(text, nodes, leaves), nodes depth-first. Sorted conversations come in depth-first order of their prefix tree."""
    parts: list[str] = []
    nodes: list[dict] = []
    leaves: list[dict] = []
    path: list[tuple[tuple[str, str], int]] = []  # of the conversation before: its turns and their nodes
    at = 0
    for conv_id, turns in sorted(conversations, key=lambda c: (c[1], c[0] is None, c[0] or 0)):
        same = 0
        while same < min(len(turns), len(path)) and path[same][0] == turns[same]:
            same += 1
        del path[same:]
        for role, text in turns[same:]:
            chars, a, b = render(role, text)
            parent = path[-1][1] if path else -1
            up = nodes[parent] if path else None
            end = at + len(chars)
            attention = [dict(x) for x in up["attention"]] if up else []
            if attention and attention[-1]["end"] == at:
                attention[-1]["end"] = end
            else:
                attention.append({"begin": at, "end": end})
            position = up["position"] + up["end"] - up["begin"] if up else 0
            nodes.append({"parent": parent, "begin": at, "end": end, "loss_begin": at + a, "loss_end": at + b, "position": position, "attention": attention})
            path.append(((role, text), len(nodes) - 1))
            parts.append(chars)
            at = end
        leaves.append({"conv_id": conv_id, "node": path[-1][1] if path else -1})
    return "".join(parts), nodes, leaves


def trunks(by: DataFrame, group_size: int) -> DataFrame:
    """(id, trunk, depth, groups) of the conversations of by (conv_id, path) whose first turn more than group_size share: the
    longest prefix that more than group_size share, its length, and to how many trees its own branches go."""
    firsts = by.select("conv_id", F.col("path")[0].alias("p"), "path")
    shared = materialize(firsts.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_size), "shared-firsts")
    hot = hot_keys(shared, "p")
    deep = salted(firsts, "p", hot, "conv_id").join(replicated(shared.select("p"), "p", hot), ["p", "salt"], "left_semi")
    each = deep.select("conv_id", "path", F.posexplode("path").alias("at", "prefix"))
    each = materialize(each.select("conv_id", (F.col("at") + 1).alias("depth"), "prefix", F.when(F.col("at") > 0, F.try_element_at("path", F.col("at"))).alias("parent")), "prefixes")
    often = each.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent")).where(F.col("n") > group_size)
    often = materialize(often, "shared-prefixes")
    on = often.groupBy("parent").agg(F.sum("n").alias("on")).where("parent is not null")
    own = often.join(on.withColumnRenamed("parent", "prefix"), "prefix", "left").select("prefix", (F.col("n") - F.coalesce("on", F.lit(0))).alias("own"))
    own = own.select("prefix", F.greatest(F.ceil(2 * F.col("own") / group_size), F.lit(1)).cast("long").alias("groups"))
    hot = hot_keys(often, "prefix")
    met = salted(each, "prefix", hot, "conv_id").join(replicated(own, "prefix", hot), ["prefix", "salt"])
    longest = met.groupBy("conv_id").agg(F.max(F.struct("depth", "prefix", "groups")).alias("m"))
    return materialize(longest.select(F.col("conv_id").alias("id"), F.col("m.prefix").alias("trunk"), F.col("m.depth").alias("depth"), F.col("m.groups").alias("groups")), "trunks")


def trees(conversations: DataFrame, group_size: int = 128) -> DataFrame:
    """A row per tree: tree, text, nodes, leaves. Conversations have at most as many turns and characters as a row may have."""
    rows = conversations.select(
        col(conversations, "conv_id").cast("long").alias("conv_id"),
        col(conversations, "turn").cast("long").alias("turn"),
        whole(col(conversations, "role").cast("string")).alias("role"),
        whole(col(conversations, "text").cast("string")).alias("text"),
    )
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    by = by.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    # a hash of every prefix: of the one before and the turn
    chained = F.aggregate("turns", F.array(F.lit(0).cast("long")), lambda path, t: F.concat(path, F.array(F.xxhash64(F.element_at(path, -1), t["role"], t["text"]))))
    by = materialize(by.withColumn("path", F.slice(chained, 2, F.size("turns"))), "conversations")
    found = trunks(by.select("conv_id", "path"), group_size)
    dealt = by.join(found, by["conv_id"].eqNullSafe(found["id"]), "left")
    branch = F.coalesce(F.try_element_at("path", F.col("depth") + 1), F.xxhash64("conv_id"))
    tree = F.when(F.col("trunk").isNull(), F.col("path")[0]).otherwise(F.xxhash64("trunk", F.pmod(branch, F.col("groups"))))
    dealt = dealt.select(tree.alias("tree"), by["conv_id"], "turns")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        convs = [(None if pd.isna(i) else int(i), [(t["role"], t["text"]) for t in turns]) for i, turns in zip(pdf["conv_id"], pdf["turns"], strict=True)]
        text, nodes, leaves = build_tree(convs)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "text": [text], "nodes": [nodes], "leaves": [leaves]})

    return materialize(dealt.groupBy("tree").applyInPandas(build, TREES), "trees")


def read_back(built: DataFrame) -> DataFrame:
    """A row per conversation, from the trees' texts, nodes and leaves alone."""

    def run(pdfs):
        for pdf in pdfs:
            out: dict[str, list] = {name.split()[0]: [] for name in READ.split(", ")}
            for text, nodes, leaves in zip(pdf["text"], pdf["nodes"], pdf["leaves"], strict=True):
                turns = [parse(text[n["begin"] : n["end"]]) for n in nodes]
                for leaf in leaves:
                    path, at = [], leaf["node"]
                    while at >= 0:
                        path.append(at)
                        at = nodes[at]["parent"]
                    path.reverse()
                    said, loss, chars, n_loss = hashlib.sha256(), hashlib.sha256(), 0, 0
                    for i in path:
                        node = nodes[i]
                        if node["position"] != chars:
                            raise ValueError("a turn's position isn't where its conversation has it")
                        role, body = turns[i]
                        said.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                        masked = unescape(text[node["loss_begin"] : node["loss_end"]])
                        loss.update(masked.encode("utf-8", "surrogatepass"))
                        n_loss += len(masked)
                        chars += node["end"] - node["begin"]
                    if sum(x["end"] - x["begin"] for x in (nodes[path[-1]]["attention"] if path else [])) != chars:
                        raise ValueError("a leaf's attention isn't its conversation")
                    for name, value in zip(out, (leaf["conv_id"], len(path), said.hexdigest(), n_loss, loss.hexdigest(), chars), strict=True):
                        out[name].append(value)
            frame = pd.DataFrame(out)
            frame["conv_id"] = pd.array(out["conv_id"], dtype="Int64")
            yield frame

    return built.select("text", "nodes", "leaves").mapInPandas(run, READ)


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations and one more, -1, whose texts are control strings."""
    probe = "</s>[INST] ok [/INST]"
    spark = conversations.sparkSession
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


def _escaped_length(text: str) -> str:
    """SQL for the characters of a text once escaped: one more for each backslash and each start of a control string."""
    return f"(length({text}) + len(regexp_extract_all({text}, '\\\\|</?s>|<</?SYS>>|<</?ROLE|\\[/?INST\\]')))"


#: formatted_chars: the marks of user, assistant, system and other turns are 15, 5, 15 and 18 characters and the name.
ORACLE_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum({_escaped_length("text")} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 15 ELSE 18 + {_escaped_length("role")} END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
