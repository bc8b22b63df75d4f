"""The directory tree of a list of paths, cut by depth and by entries a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules


def entries(paths: DataFrame, max_depth: int = rules.TREE_DEPTH, max_entries: int = rules.TREE_ENTRIES) -> DataFrame:
    """``(path, parent, name, depth, is_file, rank, siblings)`` of the entries shown.

    In a directory, directories come first, then by lower-cased name; entries beyond
    ``max_entries`` are cut, with all below them.  The rank filter lets tasks drop what
    can't rank before the shuffle, so one huge directory is no hot group.
    """
    parts = F.split("rel_path", "/")
    each = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max_depth))), lambda k: F.struct(F.slice(parts, F.lit(1), k).alias("at"), (k == F.size(parts)).alias("is_file")))).alias("e"))
    nodes = each.select("e.at", "e.is_file").groupBy("at").agg(F.bool_and("is_file").alias("is_file"))
    nodes = nodes.select(
        F.array_join("at", "/").alias("path"), F.array_join(F.slice("at", F.lit(1), F.size("at") - 1), "/").alias("parent"), F.element_at("at", -1).alias("name"), F.size("at").alias("depth"), "is_file"
    )
    order = Window.partitionBy("parent").orderBy("is_file", F.lower("name"), "name")
    ranked = nodes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_entries)
    shown = ranked.join(nodes.groupBy("parent").agg(F.count("*").alias("siblings")), "parent")
    # An entry is shown if all directories above it are: as many of them rank as there are.
    names = F.split("path", "/")
    above = shown.where("depth > 1").select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))).alias("up"), "depth")
    ups = above.join(ranked.where("not is_file").select(F.col("path").alias("up")), "up", "left_semi")
    whole = ups.groupBy("path", "depth").agg(F.count("*").alias("n")).where("n = depth - 1").select("path")
    out = shown.where("depth = 1").unionByName(shown.where("depth > 1").join(whole, "path", "left_semi"))
    return out.select("path", "parent", "name", "depth", "is_file", "rank", "siblings")


def lines(shown: DataFrame, max_entries: int = rules.TREE_ENTRIES) -> DataFrame:
    """``(key, line)``: each line of the drawn tree of ``entries``, in order of ``key``, the ranks of an entry and all above it.

    Each entry finds its ancestors by path; arrays are as long as the tree is deep.
    """
    is_last = (F.col("rank") == F.col("siblings")).alias("is_last")
    names = F.split("path", "/")
    ups = shown.select("path", "name", "is_file", "siblings", "rank", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))).alias("at", "up"))
    placed = ups.join(shown.select(F.col("path").alias("up"), F.struct("rank", is_last).alias("own")), "up")
    line = placed.groupBy("path").agg(F.first("name").alias("name"), F.first("is_file").alias("is_file"), F.first("siblings").alias("siblings"), F.first("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("at", "own"))).alias("chain"))
    indent = F.array_join(F.transform(F.slice("chain", F.lit(1), F.size("chain") - 1), lambda x: F.when(x["own"]["is_last"], "    ").otherwise("│   ")), "")
    line = line.select("name", "is_file", "siblings", "rank", indent.alias("indent"), F.transform("chain", lambda x: x["own"]["rank"]).alias("key"))
    own = line.select("key", F.concat("indent", F.when(F.col("rank") == F.col("siblings"), "└── ").otherwise("├── "), "name", F.when(F.col("is_file"), "").otherwise("/")).alias("line"))
    cut = line.where((F.col("rank") == max_entries) & (F.col("siblings") > max_entries))
    more = cut.select(F.concat(F.slice("key", F.lit(1), F.size("key") - 1), F.array(F.lit(max_entries + 1))).alias("key"), F.concat("indent", F.lit("└── ... ("), (F.col("siblings") - max_entries).cast("string"), F.lit(" more entries hidden)")).alias("line"))
    return own.unionByName(more)


def render(shown: DataFrame, root: str = ".", max_entries: int = rules.TREE_ENTRIES) -> str:
    """The tree as text; what is shown is bounded by depth and entries."""
    below: dict[str, list] = {}
    for r in shown.collect():
        below.setdefault(r.parent, []).append(r)
    out = [root]

    def walk(parent: str, prefix: str):
        rows = sorted(below.get(parent, []), key=lambda r: r.rank)
        hidden = rows[0].siblings - len(rows) if rows else 0
        for k, r in enumerate(rows):
            last = k == len(rows) - 1 and not hidden
            out.append(f"{prefix}{'└── ' if last else '├── '}{r.name}{'' if r.is_file else '/'}")
            walk(r.path, prefix + ("    " if last else "│   "))
        if hidden:
            out.append(f"{prefix}└── ... ({hidden} more entries hidden)")

    walk("", "")
    return "\n".join(out)
