"""Exact DBSCAN on DataFrames (M4) and connected components.

On the cells of a metric tree (see ``metric_tree``; equal rows are one weighted point):

1. Leaves and cells are paired by descent. A cell of at least ``min_samples`` rows
   that lies wholly within ``eps`` of a whole leaf (itself narrower than ``eps``)
   settles that leaf without measuring: it is *full*, all its points are core and
   linked, and one edge links them to the cell's core points. What lies partly within reach stays an open leaf pair.
2. Neighbours are counted for the points of the other leaves only. Each of them
   has fewer than ``min_samples`` rows in every cell within reach, so dense regions
   are never counted pair by pair.
3. Open leaf pairs that the settled edges have connected already are dropped;
   the others are measured once more, giving links of core points (components
   inside the task, a full leaf being one vertex) and, in the same pass, the
   core neighbours of border rows.
4. Connected components of these links (alternating large-star / small-star
   rounds, written between rounds); clusters numbered by their lowest core row
   id (0, 1, ...), border rows take the lowest-numbered cluster among their core
   neighbours, the rest is noise (-1).

This matches the sequential lowest-row-first labelling of the reference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.distances import within
from faultline.operators.metric_tree import BRANCH, LEAF_ROWS, MEASURED, Leaf, Tree, build, counts_within, look, pairs
from faultline.operators.ordering import row_index
from faultline.session import materialize


def _hash_stats(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return int(r["n"]), int(r["h"] or 0)


def connected_components(vertices: DataFrame, edges: DataFrame, id_col: str = "id", src: str = "src",
                         dst: str = "dst") -> DataFrame:
    """(id, component) with component = smallest id of the connected component.

    Alternating large-star / small-star (Kiveris et al., 2014). Each round
    is two grouped aggregates and two joins; the edge set is written to
    ``spark.checkpoint.dir`` every round (``session.materialize``), so lineage stays one round long and
    lost executors recompute at most one round. Stops when a round leaves
    the edge set unchanged, which every finite edge set reaches.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")) \
        .filter(F.col("u") != F.col("v")).distinct().transform(materialize)
    stats = _hash_stats(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(m, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .unionByName(m2.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = small.filter(F.col("a") != F.col("b")) \
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().transform(materialize)
        new_stats = _hash_stats(new)
        if new_stats == stats:
            e = new
            break
        e, stats = new, new_stats
    parent = e.groupBy("u").agg(F.min("v").alias("root"))
    return vertices.select(F.col(id_col).alias("id")).join(parent, F.col("id") == F.col("u"), "left") \
        .select("id", F.coalesce(F.col("root"), F.col("id")).alias("component"))


def _parts(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the links between the rows and the columns of a table: their numbers by row and by column, -1 without a link."""
    turned = np.ascontiguousarray(linked.T)
    row_part, column_part, number = np.full(len(linked), -1), np.full(len(turned), -1), 0
    for i in np.flatnonzero(linked.any(axis=1)):
        if row_part[i] >= 0:
            continue
        rows = np.array([i])
        while len(rows):
            row_part[rows] = number
            columns = np.flatnonzero(linked[rows].any(axis=0) & (column_part < 0))
            column_part[columns] = number
            rows = np.flatnonzero(turned[columns].any(axis=0) & (row_part < 0))
        number += 1
    return row_part, column_part


def _vertex(node: str):
    """Tree cells as vertices: negative numbers, points having none."""
    return -F.col(node) - 1


def _unified(tree: Tree, settled: DataFrame, core_leaves: DataFrame) -> DataFrame:
    """Edges (src, dst) between cells: a settled leaf with its cell, and from every
    such cell down to the leaves under it that have core points."""
    above = core_leaves.select(F.col("leaf").alias("node"))
    up = None  # (leaf, node): a leaf with core points and all cells it stands in
    front = above.withColumn("leaf", F.col("node"))
    for _ in range(tree.depth + 1):
        up = front if up is None else up.unionByName(front)
        front = front.filter("node > 0").withColumn("node", ((F.col("node") - 1) / BRANCH).cast("long"))
    met = settled.join(up.select("node").distinct(), "node", "left_semi")  # a cell without core points links nothing
    down = up.join(met.select("node").distinct(), "node", "left_semi")
    return met.select(_vertex("leaf").alias("src"), _vertex("node").alias("dst")).unionByName(
        down.select(_vertex("leaf").alias("src"), _vertex("node").alias("dst"))).filter("src != dst")


def dbscan(df: DataFrame, eps: float, min_samples: int = 5, id_col: str = "row_id", vec: str = "features",
           block_rows: int = LEAF_ROWS, sent: dict | None = None, tree: Tree | None = None) -> DataFrame:
    """M4: (row_id, cluster, is_core); cluster -1 = noise. ``sent`` collects the
    numbers of leaf pairs: open, counted, and measured for links. ``tree`` is the
    tree of ``df``, if it is built already."""
    tree = tree or build(df, id_col, vec, block_rows)
    rows = df.select(F.col(id_col), F.col(vec).cast("array<double>").alias("vec"))
    if tree.nodes is None:
        return rows.select(id_col, F.lit(-1).alias("cluster"), F.lit(False).alias("is_core"))
    # points are vertices from 0 on, whatever the row ids; the order stays
    shift = min(0, tree.nodes.filter("level = 0").first()["min_pid"])
    tree = tree._replace(points=tree.points.withColumn("pid", F.col("pid") - shift))
    leaves = tree.nodes.filter("is_leaf").select(F.col("node").alias("leaf"), (F.col("min_pid") - shift).alias("min_pid"))
    reach = leaves.select("leaf", F.lit(float(eps)).alias("reach"))
    open_, settled = (materialize(t) for t in pairs(tree, reach, full=min_samples, tight=True))
    full = materialize(settled.select("leaf").distinct())

    # core points: all of a full leaf, the others by counting
    counted = open_.join(full, "leaf", "left_anti")
    n = counts_within(tree, eps, counted)
    flagged = tree.points.select("pid", "vec", "w", "leaf", "refd").join(full.withColumn("full", F.lit(True)), "leaf", "left").join(n, "pid", "left")
    pts = materialize(flagged.select("pid", "vec", "w", "leaf", "refd", F.col("full").isNotNull().alias("full"),
                                     (F.col("full").isNotNull() | (F.coalesce("n", F.lit(0)) >= min_samples)).alias("core")))
    kinds = materialize(pts.groupBy("leaf").agg(F.max("full").alias("full"), F.max("core").alias("core"), F.min("core").alias("all_core")))

    # links of settled leaves, and the components they make already
    cell_edges = materialize(_unified(tree, settled, kinds.filter("core")))
    vertices = full.select(_vertex("leaf").alias("id"))
    known = None if cell_edges.isEmpty() else materialize(
        connected_components(vertices, cell_edges, "id").select((-F.col("id") - 1).alias("leaf"), "component"))

    # open pairs: a core point on one side, anything on the other (a pair of two is measured once)
    left, right = kinds.select("leaf", F.col("full").alias("f"), F.col("core").alias("c"), F.col("all_core").alias("a")),         kinds.select(F.col("leaf").alias("other"), F.col("full").alias("f2"), F.col("core").alias("c2"), F.col("all_core").alias("a2"))
    both = open_.select(F.least("leaf", "other").alias("leaf"), F.greatest("leaf", "other").alias("other")).distinct()
    met = both.join(left, "leaf").join(right, "other").filter("c or c2").filter("leaf != other or not f")
    if known is not None:
        met = met.join(known, "leaf", "left").join(known.select(F.col("leaf").alias("other"), F.col("component").alias("component2")), "other", "left") \
            .filter("not (f and f2 and component <=> component2 and component is not null)")
    met = materialize(met.select("leaf", F.col("other").alias("target")))
    if sent is not None:
        sent.update(open=open_.count(), counted=counted.count(), measured=met.count(), leaves=leaves.count())
    out = "kind int, src long, dst long"

    def link(leaf: int, target: int, q: Leaf, p: Leaf) -> pd.DataFrame:
        x, y, x_core, y_core, x_pid, y_pid = q.vec, p.vec, q["core"].astype(bool), p["core"].astype(bool), q["pid"], p["pid"]
        step = max(1, MEASURED // len(y))
        near = np.concatenate([np.zeros((0, len(y)), bool), *[within(x[i:i + step], y, eps * eps) for i in range(0, len(x), step)]])
        # a full leaf is one vertex
        links, x_name, y_name = near[x_core][:, y_core], x_pid[x_core], y_pid[y_core]
        if len(x) and q["full"][0]:
            links, x_name = links.any(axis=0, keepdims=True), np.array([-leaf - 1])
        if p["full"][0]:
            links, y_name = links.any(axis=1, keepdims=True), np.array([-target - 1])
        names, part = np.concatenate([x_name, y_name]), np.concatenate(_parts(links))
        names, part = names[part >= 0], part[part >= 0]
        root = np.full(part.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(root, part, names)
        star = names != root[part]
        found = [np.column_stack([np.zeros(star.sum(), np.int64), names[star], root[part[star]]])]
        for border, pid, name in ((near[~x_core][:, y_core], x_pid[~x_core], y_name), (near[x_core][:, ~y_core].T, y_pid[~y_core], x_name)):
            if len(name) < border.shape[1]:
                border = border.any(axis=1, keepdims=True)
            a, b = np.nonzero(border)
            found.append(np.column_stack([np.ones(len(a), np.int64), pid[a], name[b]]))
        all_ = np.concatenate(found)
        return pd.DataFrame({"kind": all_[:, 0].astype("int32"), "src": all_[:, 1], "dst": all_[:, 2]})

    sides = pts.select("leaf", "pid", "vec", "refd", "full", "core")
    linked = look(met, sides, sides, lambda q: np.full(len(q.vec), float(eps)), link, out)
    edges = linked.filter("kind = 0").select("src", "dst").unionByName(cell_edges)
    vertices = vertices.unionByName(pts.filter("core and not full").select(F.col("pid").alias("id")))
    comp = materialize(connected_components(vertices, edges, "id"))
    lowest = leaves.select(_vertex("leaf").alias("id"), F.col("min_pid").alias("low")).join(full.select(_vertex("leaf").alias("id")), "id") \
        .unionByName(pts.filter("core and not full").select(F.col("pid").alias("id"), F.col("pid").alias("low")))
    roots = comp.join(lowest, "id").groupBy("component").agg(F.min("low").alias("low"))
    numbered = materialize(comp.join(row_index(roots, ["low"], "cluster").select("component", "cluster"), "component").select("id", "cluster"))
    name = F.when(F.col("full"), _vertex("leaf")).when(F.col("core"), F.col("pid"))
    border = linked.filter("kind = 1").join(numbered, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("pid")) \
        .agg(F.min("cluster").alias("near"))
    labels = pts.withColumn("id", name).join(numbered, "id", "left").join(border, "pid", "left").select(
        "vec", F.coalesce("cluster", "near", F.lit(-1)).cast("int").alias("cluster"), F.col("core").alias("is_core"))
    return rows.join(labels, "vec").select(id_col, "cluster", "is_core")
