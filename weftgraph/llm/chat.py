"""Chat formatting: reply trees to conversations, with DataFrame functions only.

Nodes point at the node they reply to. Paths from the root are found by
iterative self-joins that double the reach of each node's pointer, so their
number is the logarithm of the deepest thread's length. Leaves are ranked by the
summed score of their path; the chosen ones are read off from leaf to root and
formatted turn by turn.

The template: `<|start|>role<|text|>text<|end|>` and a newline. Inside roles and
texts a backslash is doubled and a backslash is put into every control string
(also those of other common templates), which unescaping takes out again.

Defined cases: null text and null role count as empty; repeated rows of a
conversation's turn are turns of their own, ordered by turn (null first), role,
text; a null conv_id is one conversation; a node whose parent is missing is a
root; a cycle of replies has no root and gives no path; paths with equal scores:
the leaf with the smaller node id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm._base import cut, drop_cut, table

#: The control strings of this template, and others that must not stand unescaped in a text.
START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
_CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)"


def escape(c: Column) -> Column:
    """Each control string gets a backslash after its first character; a backslash is doubled."""
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), _CONTROL, "$0\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """nodes (conv, node, parent, score) to (conv, rank, leaf, node, up): the nodes of the chosen root-to-leaf paths.

    `up` is the distance to the leaf. The best `branches` leaves of each conversation are kept, by the sum of
    scores from the root.
    """
    base = cut(nodes.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    known = base.select("conv", F.col("node").alias("parent")).distinct()
    # A node whose parent is missing is a root.
    tree = cut(base.join(known.withColumn("_has", F.lit(True)), ["conv", "parent"], "left").select("conv", "node", F.when(F.col("_has"), F.col("parent")).alias("jump"), "score"))
    drop_cut(base)
    leaves = tree.select("conv", "node").join(tree.where("jump is not null").select("conv", F.col("jump").alias("node")), ["conv", "node"], "left_anti")
    # After round k a node knows its ancestor 2**k up and the score of the 2**k nodes up to there.
    jumps = [tree]
    most = tree.select("conv", "node").groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while (1 << (len(jumps) - 1)) < most and jumps[-1].where("jump is not null").limit(1).count():
        one = jumps[-1]
        two = one.select("conv", F.col("node").alias("jump"), F.col("jump").alias("_far"), F.col("score").alias("_more"))
        # Nodes that know their root already are not joined again.
        further = one.where("jump is not null").join(two, ["conv", "jump"]).select("conv", "node", F.col("_far").alias("jump"), (F.col("score") + F.col("_more")).alias("score"))
        jumps.append(cut(further.unionByName(one.where("jump is null"))))
    scored = jumps[-1].where("jump is null").select("conv", "node", "score").join(leaves, ["conv", "node"])
    best = W.partitionBy("conv").orderBy(F.col("score").desc(), "node")
    chosen = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches).select("conv", "rank", F.col("node").alias("leaf"))
    member = cut(chosen.select("conv", "rank", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(jumps[:-1] if len(jumps) > 1 else jumps):
        above = member.join(jump.where("jump is not null").select("conv", "node", "jump"), ["conv", "node"]).select("conv", "rank", "leaf", F.col("jump").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        member = cut(member.unionByName(above))
    return member


def format_conversations(turns: DataFrame, member: DataFrame) -> DataFrame:
    """turns (conv, node, role, text) and paths() to one row per path: conv, rank, n_turns, formatted, mask.

    `mask` lists the spans (start from 1, length) of `formatted` under the loss: the assistant's texts.
    """
    own = F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END), F.lit("\n"))
    rows = turns.select("conv", "node", own.alias("own"), F.when(F.col("role") == "assistant", F.length(escape(F.col("text")))).otherwise(-1).alias("long"))
    rows = rows.join(member, ["conv", "node"])
    done = rows.groupBy("conv", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "own", "long"))).alias("t"))
    # Start of each turn's text in the whole, by a running sum of lengths.
    tail = len(END) + 1
    spans = F.aggregate("t", F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,size:int>>").alias("spans")), lambda acc, x: F.struct((acc["end"] + F.length(x["own"])).alias("end"), F.when(x["long"] >= 0, F.array_append(acc["spans"], F.struct((acc["end"] + F.length(x["own"]) - tail - x["long"] + 1).alias("start"), x["long"].alias("size")))).otherwise(acc["spans"]).alias("spans")))
    return done.select("conv", "rank", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["own"]), "").alias("formatted"), spans["spans"].alias("mask"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted conversation."""
    quoted = lambda s: f"\\Q{s}\\E"
    parts = F.filter(F.split(formatted, quoted(START)), lambda p, i: i > 0)
    body = lambda p: F.split(p, quoted(TEXT))
    return F.transform(parts, lambda p: F.struct(unescape(body(p)[0]).alias("role"), unescape(F.substring_index(body(p)[1], END, 1)).alias("text")))


def thread(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as nodes: each turn replies to the one before it."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("node", F.row_number().over(order).cast("long"))
    return out.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    nodes = cut(thread(rows))
    done = cut(format_conversations(nodes.select("conv", "node", "role", "text"), paths(nodes.select("conv", "node", "parent", "score"))))
    turns = read_back(F.col("formatted"))
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"], m["size"]))), "")
    out = done.select(
        F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return out


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(role, '\', '\\'),
      '(<)(\||/?s>|</?SYS>>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g')) AS role_chars,
    length(regexp_replace(regexp_replace(replace(text, '\', '\\'),
      '(<)(\||/?s>|</?SYS>>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g')) AS text_chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + 25) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
