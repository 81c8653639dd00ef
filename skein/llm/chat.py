"""Chat formatting: root-to-leaf paths of reply trees, the best branches, each as one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Reversible: afterwards no control string (they begin ``<|``) is left in the text."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    back = F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&#10;"), F.lit("\n"))
    return F.replace(back, F.lit("&amp;"), F.lit("&"))


def paths(scratch: Scratch, nodes: DataFrame, top: int = 1, most_rounds: int = 40) -> DataFrame:
    """The ``top`` branches of each tree: (conv, leaf, rank, node, place), place from 1 at the root.

    nodes: conv, node, parent, score; (conv, node) unique. Each self-join doubles how far a node's pointer reaches
    and adds the scores on the way, so a path of n turns takes log2(n) joins. Branches are ranked by mean score, then
    length, then smallest leaf. Null scores count 0; nodes whose parent is null, missing or themselves are roots; nodes on
    a cycle raise a ValueError.
    """
    parents = nodes.select("conv", F.col("node").alias("parent"))
    linked = nodes.where("parent <> node").join(parents, ["conv", "parent"], "left_semi").select("conv", "node", "parent")
    gain = F.coalesce(F.col("score"), F.lit(0)).cast("double").alias("gain")
    cur = nodes.select("conv", "node", gain).join(linked.withColumnRenamed("parent", "up"), ["conv", "node"], "left")
    cur, jumps = scratch.keep(cur.withColumn("hops", F.lit(1).cast("long"))), []
    while not cur.where("up is not null").isEmpty():
        if len(jumps) == most_rounds:
            raise ValueError("a reply is its own ancestor")
        jumps.append(cur)
        above = cur.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("gain").alias("g2"), F.col("hops").alias("h2"))
        # Only what has not reached its root is joined, so short conversations cost no more beside long ones.
        resolved = cur.where("up is null")
        cur = cur.where("up is not null").join(above, ["conv", "up"], "left").select(
            "conv", "node", (F.col("gain") + F.coalesce("g2", F.lit(0.0))).alias("gain"), F.col("up2").alias("up"),
            (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
        )
        cur = scratch.keep(cur.unionByName(resolved))
        if cur.where(f"hops > {2 ** len(jumps)} or hops < 1").limit(1).count():
            raise ValueError("a reply is its own ancestor")
    leaves = cur.join(linked.select("conv", F.col("parent").alias("node")).distinct(), ["conv", "node"], "left_anti")
    order = Window.partitionBy("conv").orderBy(F.desc(F.col("gain") / F.col("hops")), F.desc("hops"), "node")
    best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = best.select("conv", F.col("node").alias("leaf"), "rank", "hops", "node", F.lit(0).cast("long").alias("back"))
    for k, jump in reversed(list(enumerate(jumps))):
        step = jump.where("up is not null").select("conv", "node", "up")
        more = out.join(step, ["conv", "node"]).withColumn("node", F.col("up")).withColumn("back", F.col("back") + 2**k).drop("up")
        out = scratch.keep(out.unionByName(more))
    return out.select("conv", "leaf", "rank", "node", (F.col("hops") - F.col("back")).alias("place"))


def format_chats(turns: DataFrame, keys: list[str], learn: str = "assistant") -> DataFrame:
    """One row per ``keys`` from rows (keys, place, role, text): ``formatted`` and the spans of it under the loss mask
    (``loss``: start from 1 and length, in code points). Null roles and texts are empty."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    row = F.struct("place", role.alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    g = turns.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("t"))  # one conversation
    whole = F.array_join(F.transform("t", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    empty = F.array().cast("array<struct<start:int,length:int>>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(START) + F.length(t["role"]) + 1
        span = F.struct(start.alias("start"), F.length(t["text"]).alias("length"))
        out = F.when(t["role"] == learn, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct((start + F.length(t["text"]) + len(END)).alias("at"), out.alias("out"))

    spans = F.aggregate("t", F.struct(F.lit(1).alias("at"), empty.alias("out")), step)["out"]
    return g.select(*keys, whole.alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    raw = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substr(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(raw, turn)


def chats(scratch: Scratch, rows: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` branches of each conversation as (conv_id, rank, formatted, loss).

    rows: conv_id, node, parent, role, text, score; other columns are ignored. Of rows with equal (conv_id, node) the
    first by parent, role, text and score counts. A null conv_id is a conversation like others; rows without node are
    dropped. An empty table gives an empty result.
    """
    key = F.to_json(F.struct("conv_id"))
    order = Window.partitionBy("conv", "node").orderBy("parent", "role", "text", "score")
    kept = rows.where("node is not null").select(key.alias("conv"), "conv_id", "node", "parent", "role", "text", "score")
    kept = scratch.keep(kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n"))
    chosen = paths(scratch, kept.select("conv", "node", "parent", "score"), top)
    turns = chosen.join(kept.select("conv", "conv_id", "node", "role", "text"), ["conv", "node"])
    return format_chats(turns, ["conv", "conv_id", "leaf", "rank"]).select("conv_id", "rank", "formatted", "loss")


def op1_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each turn the reply to the one before, and one whose texts hold control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = rows.unionByName(extra).withColumn("node", F.row_number().over(order))
    nodes = nodes.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))
    out = chats(Scratch(spark), nodes).withColumn("t", read_back(F.col("formatted")))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"], s["length"])))
    out = out.withColumn("m", F.array_join(masked, ""))
    return out.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("m").cast("long").alias("loss_chars"), F.sha2("m", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op1_reply_trees": op1_reply_trees}
ORACLES = {
    "op1_reply_trees": """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') as et,
  replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') as er from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(12 + length(er) + 1 + length(et) + 11)::bigint as formatted_chars
from e group by conv_id"""
}
