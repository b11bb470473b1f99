"""Sharding by a k-d tree over metadata, in DataFrame operations only.

Each document has numeric metadata and a size in bytes. A node that is to hold ``n`` leaves is cut at the weighted
quantile floor(n/2)/n of the dimension in which it is widest, until each leaf has the target bytes (all bytes over
the number of shards). The quantiles of all nodes of a level come from one histogram over the whole table, refined
only inside the bucket where the quantile falls. Coordinates are functions of the text and ties are broken by a
hash of the text, so equal texts always meet in one shard, without a join; a text whose copies alone fill a shard
gets a shard of its own. The finished tree is an expression of a few comparisons.

Only histograms (nodes x buckets) and at most ``shards`` heavy texts reach the driver.

Defined results: a null text counts as the empty one (size 1); null ids are rows like others; an empty table gives
no rows; rows that agree fully get different slots of the same shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUCKETS = 1024
#: Part of a leaf's bytes that a cut may miss its quantile by, where single texts are that small.
TOLERANCE = 0.002
ROWS_IN_SLOT_GROUP = 200_000


@dataclass(frozen=True)
class Leaf:
    shard: int


@dataclass(frozen=True)
class Cut:
    dim: str
    value: float
    tie: float | None  # rows with this very value go left if their tie is below; None: they go right
    left: Cut | Leaf
    right: Cut | Leaf


def text_dimensions(text: Column) -> dict[str, Column]:
    """Metadata that a text has in itself: length, words a line, share of bytes beyond ASCII, digits and markup."""
    n = F.octet_length(text).cast("double")
    chars = F.char_length(text).cast("double")
    lines = (chars - F.char_length(F.replace(text, F.lit("\n"))) + 1).cast("double")
    return {
        "log_bytes": F.log2(n + 1),
        "line_length": F.log2(n / lines + 1),
        "wide_share": F.coalesce((n - chars) / F.nullif(n, F.lit(0.0)), F.lit(0.0)),
    }


def _tie(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 12).cast("double")


def _goes_left(c: Cut) -> Column:
    at, tie = F.col(c.dim), F.col("tie")
    return at < c.value if c.tie is None else (at < c.value) | ((at == c.value) & (tie < c.tie))


def shard_of(tree: Cut | Leaf) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.shard)
    return F.when(_goes_left(tree), shard_of(tree.left)).otherwise(shard_of(tree.right))


@dataclass
class _Node:
    path: Column  # of the rows in the node
    first: int
    leaves: int
    dim: str = ""
    value: float = 0.0
    tie: float | None = None
    left: _Node | None = None
    right: _Node | None = None

    def tree(self) -> Cut | Leaf:
        return Leaf(self.first) if self.left is None else Cut(self.dim, self.value, self.tie, self.left.tree(), self.right.tree())


def _node_column(nodes: list[_Node]) -> Column:
    out = F.lit(None).cast("int")
    for i, n in enumerate(nodes):
        out = F.when(n.path, i).otherwise(out)
    return out


def _pick(values: list[float], nodes_at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (nodes_at + 1).cast("int"))


def _quantiles(rows: DataFrame, nodes: list[_Node], tolerance: float) -> None:
    """Sets each node's value and tie: the cut where the rows left of it weigh floor(n/2)/n of the node."""
    open_ = {i: {"axis": n.dim, "before": 0.0, "goal": None, "where": F.lit(True), "lo": None, "hi": None} for i, n in enumerate(nodes)}
    while open_:
        ids = list(open_)
        base, axis, inside = rows.where("node is not null"), F.lit(None).cast("double"), F.lit(False)
        for i in ids:
            here = F.col("node") == i
            axis = F.when(here, F.col(open_[i]["axis"])).otherwise(axis)
            inside = inside | (here & open_[i]["where"])
        base = base.where(inside).withColumn("axis", axis)
        if any(open_[i]["lo"] is None for i in ids):
            for r in base.groupBy("node").agg(F.min("axis").alias("lo"), F.max("axis").alias("hi"), F.sum("size").alias("w")).collect():
                o = open_[r["node"]]
                o["lo"], o["hi"] = r["lo"], r["hi"]
                o["goal"] = r["w"] * (nodes[r["node"]].leaves // 2) / nodes[r["node"]].leaves if o["goal"] is None else o["goal"]
        span = [1.0] * len(nodes)
        low = [0.0] * len(nodes)
        for i in ids:
            low[i], span[i] = float(open_[i]["lo"] or 0.0), float((open_[i]["hi"] or 0.0) - (open_[i]["lo"] or 0.0)) or 1.0
        at = F.least(F.lit(BUCKETS - 1), F.floor((F.col("axis") - _pick(low, F.col("node"))) / _pick(span, F.col("node")) * BUCKETS).cast("int"))
        found: dict[int, list] = {i: [] for i in ids}
        for r in base.groupBy("node", at.alias("bucket")).agg(F.sum("size").alias("w"), F.min("axis").alias("lo"), F.max("axis").alias("hi")).collect():
            found[r["node"]].append(r)
        for i in ids:
            o, n = open_[i], nodes[i]
            cum, hit = o["before"], None
            for r in sorted(found[i], key=lambda r: r["bucket"]):
                if cum + r["w"] > o["goal"] or hit is None and r is max(found[i], key=lambda r: r["bucket"]):
                    hit = r
                    break
                cum += r["w"]
            if hit is None:  # no rows
                n.value, n.tie = 0.0, None
                del open_[i]
                continue
            on_tie = o["axis"] == "tie"
            if hit["lo"] == hit["hi"] and on_tie or hit["w"] <= tolerance:
                # the bucket goes to the side that leaves less to mend
                edge = hit["lo"] if o["goal"] - cum <= hit["w"] / 2 else None
                if edge is None:
                    later = [r for r in found[i] if r["bucket"] > hit["bucket"]]
                    edge = min(later, key=lambda r: r["bucket"])["lo"] if later else float(hit["hi"]) * (1 + 1e-15) + 1e-9 if not on_tie else float(hit["hi"]) + 1
                if on_tie:
                    n.tie = float(edge)
                else:
                    n.value, n.tie = float(edge), None
                del open_[i]
            elif hit["lo"] == hit["hi"]:
                n.value = float(hit["lo"])
                open_[i] = o | {"axis": "tie", "before": cum, "where": F.col(n.dim) == n.value, "lo": None, "hi": None}
            else:
                a = F.col(o["axis"])
                open_[i] = o | {"before": cum, "where": o["where"] & (a >= hit["lo"]) & (a <= hit["hi"]), "lo": hit["lo"], "hi": hit["hi"]}


def plan_shards(rows: DataFrame, dims: list[str], shards: int) -> tuple[dict[float, int], Cut | Leaf]:
    """``rows`` has the doubles ``dims`` and ``tie`` and a long ``size``. Returns the shards of heavy texts by tie, and the tree."""
    total = rows.agg(F.sum("size").alias("w"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    if total["w"] is None:
        return {}, Leaf(0)
    width = {d: ((total[f"hi_{d}"] - total[f"lo_{d}"]) or 1.0) for d in dims}
    left, leaves, heavy = float(total["w"]), shards, {}
    for r in rows.groupBy("tie").agg(F.sum("size").alias("w")).orderBy(F.desc("w"), "tie").limit(shards).collect():
        if leaves > 1 and r["w"] * leaves >= left:
            heavy[r["tie"]] = len(heavy)
            left, leaves = left - r["w"], leaves - 1
        else:
            break
    rest = rows.where(~F.col("tie").isin([F.lit(t) for t in heavy])) if heavy else rows
    root = _Node(F.lit(True), len(heavy), leaves)
    level = [root]
    while level := [n for n in level if n.leaves > 1]:
        at = rest.withColumn("node", _node_column(level))
        spread = {r["node"]: r for r in at.where("node is not null").groupBy("node").agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()}
        for i, n in enumerate(level):
            n.dim = max(dims, key=lambda d: ((spread[i][d] or 0.0) / width[d], d)) if i in spread else dims[0]
        _quantiles(at, level, left / leaves * TOLERANCE)
        below = []
        for n in level:
            c = Cut(n.dim, n.value, n.tie, Leaf(0), Leaf(0))
            n.left = _Node(n.path & _goes_left(c), n.first, n.leaves // 2)
            n.right = _Node(n.path & ~_goes_left(c), n.first + n.leaves // 2, n.leaves - n.leaves // 2)
            below += [n.left, n.right]
        level = below
    return heavy, root.tree()


def shard_documents(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row. ``dims``: coordinates, functions of the text alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = dims or text_dimensions(text)
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), _tie(text).alias("tie"), *[c.alias(k) for k, c in dims.items()]))
    heavy, tree = plan_shards(rows, list(dims), shards)
    shard = shard_of(tree)
    for tie, s in heavy.items():
        shard = F.when(F.col("tie") == tie, s).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    groups = max(16, rows.count() // ROWS_IN_SLOT_GROUP)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32", "tie"))
    return placed.withColumn("place", place).join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"))
