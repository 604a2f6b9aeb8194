"""Chat formatting of reply trees, in DataFrame functions only.

Self-joins that double their reach each time give every message its root, depth and path score in a logarithmic number
of rounds, whatever the depth. Leaves are ranked by the score of their path; for the chosen ones the same jump tables,
taken from the longest to the shortest, enumerate the messages from leaf to root. Each chosen path is formatted as one
conversation.

Format: every turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. ROLE is URL-encoded. In TEXT a backslash is doubled and
every control string gets a backslash after its first character, so no control string is left in it; dropping each
escaping backslash gives the text back. Assistant texts are under the loss mask, as spans of code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, prefix_sums, settle

# Strings that chat templates use as controls. The first two mark turns here.
START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")
LOSS_ROLE = "assistant"


def _rest(first: str) -> str:
    """A pattern for what follows that first character in a control string."""
    return "|".join("\\Q%s\\E" % c[1:] for c in CONTROLS if c[0] == first)


_ESCAPED = "(<)(?=%s)|(\\[)(?=%s)" % (_rest("<"), _rest("["))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_ESCAPED), F.lit("$1$2\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("(?s)\\\\(.)"), F.lit("$1"))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables, and (tree, node, sum, steps) up to the root for every node that has one.

    The k-th table has the ancestor 2**k steps up of each node that is so deep, with the score and steps of what lies
    between. Nodes whose root is found leave the rounds, so a few deep trees do not drag the shallow ones along.
    """
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.lit(True).alias("there"))
    own = nodes.join(known, (F.col("t") == F.col("tree")) & (F.col("p") == F.col("parent")), "left")
    table = settle(own.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("steps")))
    rooted, active = table.filter("up is null"), table.filter("up is not null")
    tables, most = [active], nodes.count()
    while 2 ** len(tables) <= 2 * most and not active.isEmpty():
        far = rooted.unionByName(active).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("steps").alias("steps2"))
        both = active.join(far, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")))
        table = settle(both.select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("steps") + F.col("steps2")).alias("steps")))
        rooted, active = rooted.unionByName(table.filter("up is null")), table.filter("up is not null")
        tables.append(active)
    return tables, rooted.drop("up")


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, path_score, node, at): the messages of each tree's best root-to-leaf paths, at = place from the root.

    nodes: tree, node, parent, score (null: 0). A parent that is not in the tree makes its message a root. Messages on
    or below a cycle reach no root and are left out. Ties go to the smaller leaf. branches=None keeps every path.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    jumps, rooted = _jumps(nodes)
    rooted = rooted.select("tree", "node", F.col("sum").alias("path_score"), F.col("steps").alias("depth"))
    inner = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = rooted.join(inner, ["tree", "node"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "node")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    reached = settle(ranked.select("tree", F.col("node").alias("leaf"), "rank", "path_score", "depth", "node", F.lit(0).cast("long").alias("above")))
    for k in range(len(jumps) - 1, -1, -1):
        step = jumps[k].select("tree", "node", "up")
        more = reached.join(step, ["tree", "node"]).select("tree", "leaf", "rank", "path_score", "depth", F.col("up").alias("node"), (F.col("above") + 2**k).alias("above"))
        reached = settle(reached.unionByName(more))
    return reached.select("tree", "leaf", "rank", "path_score", "node", (F.col("depth") - 1 - F.col("above")).alias("at"))


def format_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """One conversation per chosen path: tree, leaf, rank, path_score, formatted, loss_spans (start, end in code points).

    nodes: tree, node, parent, score, role, text. Null roles and texts are empty.
    """
    turn = F.concat(F.lit(START), F.url_encode(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    parts = nodes.select("tree", "node", turn.alias("head"), body.alias("body"), (F.coalesce("role", F.lit("")) == LOSS_ROLE).alias("loss"))
    rows = paths(nodes, branches).join(parts, ["tree", "node"])
    told = rows.groupBy("tree", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list(F.struct("at", "head", "body", "loss"))).alias("turns"))
    tail = END + "\n"

    ends = prefix_sums(F.transform("turns", lambda t: (F.length(t["head"]) + F.length(t["body"]) + len(tail)).cast("bigint")))
    placed = F.zip_with("turns", ends, lambda t, e: F.struct(t["loss"].alias("loss"), (e - len(tail) - F.length(t["body"])).alias("start"), (e - len(tail)).alias("end")))
    spans = F.transform(F.filter(placed, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return told.select(
        "tree", "leaf", "rank", "path_score",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        spans.cast("array<struct<start:bigint,end:bigint>>").alias("loss_spans"),
    )


def parse_formatted(rows: DataFrame) -> DataFrame:
    """Formatted conversations read back: adds turns (role, text) and loss_text, both unescaped."""
    tail = len(END) + 1
    chunks = F.filter(F.split("formatted", "\\Q%s\\E" % START, -1), lambda c: F.length(c) > 0)

    def turn(c: Column) -> Column:
        head = F.substring_index(c, "\n", 1)
        return F.struct(F.url_decode(head).alias("role"), unescape(F.substr(c, F.length(head) + 2, F.length(c) - F.length(head) - 1 - tail)).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return rows.withColumn("turns", F.transform(chunks, turn)).withColumn("loss_text", F.array_join(loss, ""))


def chains(rows: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as reply trees: each row replies to the one before it.

    Rows go by turn, nulls first; rows of one turn by role and text. Rows with a null conv_id are one conversation.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    told = rows.withColumn("tree", tree).withColumn("node", place)
    return settle(told.select("tree", "node", (F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"))


def format_conversations(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Format every conversation of rows (conv_id, turn, role, text), write the result to path, read it back and say what it holds.

    Null roles and texts are empty, rows without a conv_id are one conversation, null turns come first, repeated rows are
    turns each, texts and conversations may have any length, and other columns are ignored.

    Gives conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. An empty table gives no rows.
    """
    spark = rows.sparkSession
    path = path or new_path(spark, "chat")
    formatted = format_paths(chains(rows))
    formatted.select(F.col("tree").alias("conv"), "formatted", "loss_spans").write.parquet(path)
    back = parse_formatted(spark.read.schema("conv string, formatted string, loss_spans array<struct<start:bigint,end:bigint>>").parquet(path))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.when(F.col("conv") != "null", F.col("conv")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
