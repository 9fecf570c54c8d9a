"""Repair of invalid polygons by the planar arrangement of their edges, and the quality record of a layer.

A geometry's rings cover what lies inside an odd number of them. Edges meet in the cells of a grid of their own feature; where two
cross, touch or overlap both are split. An edge piece that occurs an odd number of times is a boundary of the covered area, the others
cancel: spikes, doubled edges, edges inside the area. Crossing, touching and counting are joins and aggregates over the edges of
the whole layer, so one feature of a million vertices is spread over tasks; only walking its boundary pieces into rings is a small
helper for a feature at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sitelens.functions import geo
from sitelens.operators import layers
from sitelens.staging import staged

#: A feature's own grid has up to so many cells a side.
GRID = 64
#: Crossings are rounded to so many decimals, so that edges through one place meet in one point.
DIGITS = 7
KEEP, REPAIRED, EMPTY, UNUSABLE = "VALID", "REPAIRED", "EMPTY", "UNUSABLE"


class RepairError(ValueError):
    """A layer without a usable polygon, or with unusable ones that were not to be dropped; ``quality`` holds its record."""

    def __init__(self, message: str, quality: dict) -> None:
        super().__init__(message)
        self.quality = quality


def tidy_rings(rings: Column) -> Column:
    """Rings closed, without repeated neighbours, of finite points; rings of fewer than three places go."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    held = F.transform(rings, lambda r: F.filter(r, lambda p: finite(p["x"]) & finite(p["y"])))
    open_ = F.transform(held, lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.element_at(r, F.when(i == 0, 1).otherwise(i)))))
    shut = F.transform(open_, lambda r: F.when((F.size(r) > 0) & (F.element_at(r, 1) != F.element_at(r, -1)), F.concat(r, F.array(F.element_at(r, 1)))).otherwise(r))
    return F.filter(shut, lambda r: F.size(F.array_distinct(r)) >= 3)


def edges(layer: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """``key, sid, ring, place, of, ax, ay, bx, by``: the edges of each feature."""
    one = lambda r, ri: F.transform(
        F.sequence(F.lit(1), F.size(r) - 1),
        lambda i: F.struct(ri.alias("ring"), i.alias("place"), (F.size(r) - 1).alias("of"), *[F.element_at(r, i + d)[c].alias(n + c) for n, d in (("a", 0), ("b", 1)) for c in ("x", "y")]),
    )
    listed = layer.select(key, F.posexplode(F.flatten(F.transform(tidy_rings(F.col(rings)), one))).alias("sid", "e"))
    return listed.select(key, "sid", "e.*")


def meetings(segments: DataFrame, key: str) -> DataFrame:
    """Pairs of edges ``s < t`` of one feature that share a point: whether they cross or run along each other, and their common points."""
    box = {"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")}
    boxed = segments.withColumns(box)
    span = boxed.groupBy(key).agg(F.min("x0").alias("left"), F.min("y0").alias("low"), F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("wide"), F.least(F.lit(GRID), F.ceil(F.sqrt(F.count("*")))).alias("g"))
    placed = boxed.join(span, key).withColumn("cell", F.when(F.col("wide") > 0, F.col("wide") / F.col("g")).otherwise(1.0))
    at = lambda v, o: F.floor((F.col(v) - F.col(o)) / F.col("cell")).cast("int")
    listed = placed.withColumn("cx", F.explode(F.sequence(at("x0", "left"), at("x1", "left")))).withColumn("cy", F.explode(F.sequence(at("y0", "low"), at("y1", "low"))))
    listed = listed.select(key, "cx", "cy", "sid", "ring", "place", "of", "ax", "ay", "bx", "by", *box)
    other = listed.select(key, "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in listed.columns if c not in (key, "cx", "cy")])
    pairs = listed.join(other, [key, "cx", "cy"]).where("sid < o_sid and x0 <= o_x1 and o_x0 <= x1 and y0 <= o_y1 and o_y0 <= y1").drop("cx", "cy")
    side = lambda p, q, r: f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
    turns = {"t1": side("a", "b", "o_a"), "t2": side("a", "b", "o_b"), "t3": side("o_a", "o_b", "a"), "t4": side("o_a", "o_b", "b")}
    pairs = pairs.withColumns({n: F.expr(e) for n, e in turns.items()})
    on = lambda t, p, e: f"if({t} = 0 and {p}x between {e}x0 and {e}x1 and {p}y between {e}y0 and {e}y1, named_struct('x', {p}x, 'y', {p}y), null)"
    touch = F.expr(f"array_distinct(array_compact(array({on('t1', 'o_a', '')}, {on('t2', 'o_b', '')}, {on('t3', 'a', 'o_')}, {on('t4', 'b', 'o_')})))")
    cross = F.expr("sign(t1) * sign(t2) < 0 and sign(t3) * sign(t4) < 0")
    spot = F.expr(f"named_struct('x', round(ax + (bx - ax) * t3 / (t3 - t4), {DIGITS}), 'y', round(ay + (by - ay) * t3 / (t3 - t4), {DIGITS}))")
    pairs = pairs.withColumn("crosses", cross).withColumn("common", F.when(F.col("crosses"), F.array(spot)).otherwise(touch)).where(F.size("common") > 0)
    neighbours = F.expr("ring = o_ring and (o_place - place = 1 or (place = 1 and o_place = of))")
    # Rings may touch other rings in single points, and themselves nowhere but from an edge to the next.
    wrong = F.col("crosses") | (F.size("common") > 1) | ((F.col("ring") == F.col("o_ring")) & ~neighbours)
    return pairs.select(key, "sid", F.col("o_sid").alias("other"), "common", wrong.alias("wrong")).distinct()


def boundary(segments: DataFrame, met: DataFrame, key: str) -> DataFrame:
    """``key, px, py, qx, qy, times``: the pieces of the edges between all their common points, and how often each occurs."""
    cuts = met.select(key, "sid", F.explode("common").alias("p")).union(met.select(key, F.col("other").alias("sid"), F.explode("common").alias("p")))
    cuts = cuts.groupBy(key, "sid").agg(F.collect_set("p").alias("cuts"))
    ends = [F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in ("a", "b")]
    joined = segments.join(cuts, [key, "sid"], "left").withColumn("all", F.array_distinct(F.concat(F.array(*ends), F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double>>")))))
    along = F.transform("all", lambda p: F.struct(((p["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (p["y"] - F.col("ay")) * (F.col("by") - F.col("ay"))).alias("t"), p.alias("p")))
    path = joined.withColumn("path", F.transform(F.array_sort(along), lambda s: s["p"]))
    piece = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("p"), F.element_at("path", i + 1).alias("q")))
    pieces = path.where(F.size("path") > 1).select(key, F.explode(piece).alias("e")).select(key, F.least("e.p", "e.q").alias("p"), F.greatest("e.p", "e.q").alias("q"))
    return pieces.groupBy(key, "p", "q").agg(F.count("*").alias("times")).select(key, *[F.col(f"{n}.{c}").alias(n + c) for n in "pq" for c in "xy"], "times")


def walked(edge_list: np.ndarray) -> list[list[float]]:
    """Rings of the area inside the boundary pieces ``[px, py, qx, qy]``: outer ones counter-clockwise, holes clockwise.

    Faces are walked with the area on the left. Faces on the two sides of a piece are inside and outside by turns, and the
    outermost face of a connected part is inside if the part lies inside the others.
    """
    ends = edge_list.reshape(-1, 4)
    points, ids = np.unique(np.concatenate([ends[:, :2], ends[:, 2:]]), axis=0, return_inverse=True)
    n = len(ends)
    # Half-edges 2e and 2e + 1 are the two directions of piece e.
    start = np.empty(2 * n, np.int64)
    start[0::2], start[1::2] = ids.ravel()[:n], ids.ravel()[n:]
    stop = start[np.arange(2 * n) ^ 1]
    way = points[stop] - points[start]
    order = np.lexsort((np.arctan2(way[:, 1], way[:, 0]), start))
    place = np.empty(2 * n, np.int64)
    place[order] = np.arange(2 * n)
    first = np.searchsorted(start[order], np.arange(len(points)))
    last = np.append(first[1:], 2 * n) - 1
    back = place[np.arange(2 * n) ^ 1]
    following = order[np.where(back == first[stop], last[stop], back - 1)]
    face = np.full(2 * n, -1)
    walks: list[list[int]] = []
    for h in range(2 * n):
        if face[h] < 0:
            walk = []
            while face[h] < 0:
                face[h] = len(walks)
                walk.append(h)
                h = following[h]
            walks.append(walk)
    turned = points[start][:, 0] * points[stop][:, 1] - points[stop][:, 0] * points[start][:, 1]
    area = np.bincount(face, turned, len(walks))
    # Connected parts by their faces; each has one outermost face, which runs clockwise.
    part, inside = np.full(len(walks), -1), np.zeros(len(walks), bool)
    for f in np.argsort(area).tolist():
        if part[f] >= 0:
            continue
        part[f], todo = f, [f]
        while todo:
            g = todo.pop()
            for h in walks[g]:
                k = face[h ^ 1]
                if part[k] < 0:
                    part[k], inside[k] = f, not inside[g]
                    todo.append(k)
    of_edge = part[face[0::2]]
    for f in np.unique(part):
        x, y = points[start[walks[f]]].min(axis=0)[0], None
        h = next(h for h in walks[f] if points[start[h]][0] == x)
        y = points[start[h]][1]
        others = ends[of_edge != f]
        spans = (others[:, 1] > y) != (others[:, 3] > y)
        o = others[spans]
        at = o[:, 0] + (y - o[:, 1]) * (o[:, 2] - o[:, 0]) / (o[:, 3] - o[:, 1])
        if (at < x).sum() % 2:
            inside[part == f] ^= True
    rings = []
    for f, walk in enumerate(walks):
        if inside[f]:
            rings += _simple(start[walk].tolist())
    return [points[[*r, r[0]]].ravel().tolist() for r in rings]


def _simple(walk: list[int]) -> list[list[int]]:
    """A closed walk cut where it comes back to a point."""
    out, path, seen = [], [], {}
    for v in walk:
        if v in seen:
            at = seen[v]
            out.append(path[at:])
            for w in path[at + 1 :]:
                del seen[w]
            path = path[: at + 1]
        else:
            seen[v] = len(path)
            path.append(v)
    return [r for r in [*out, path] if len(r) >= 3]


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def _walked(pieces: pd.Series) -> pd.Series:
    return pieces.map(lambda p: walked(np.asarray(p, float)) if p is not None and len(p) else [])


def _points(flat: Column) -> Column:
    spot = lambda r, i: F.struct(F.element_at(r, 2 * i - 1).alias("x"), F.element_at(r, 2 * i).alias("y"))
    return F.transform(flat, lambda r: F.transform(F.sequence(F.lit(1), (F.size(r) / 2).cast("int")), lambda i: spot(r, i)))


def _torn(layer: DataFrame, key: str, rings: str) -> DataFrame:
    finite = lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))
    sound = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & F.forall(r, finite)
    return layer.where(F.size(rings) > 0).where(~F.coalesce(F.forall(rings, sound), F.lit(False))).select(key)


def wrong_features(layer: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """The keys of features that are not valid: a ring that is open, too short or not finite, or edges that meet where they must not."""
    met = meetings(staged(edges(layer, key, rings), "repair-edges"), key).where("wrong").select(key)
    return staged(_torn(layer, key, rings).union(met).distinct(), "repair-wrong")


def repaired(layer: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """``layer`` with invalid geometries rebuilt, and two more columns: ``geometry_state`` (VALID, REPAIRED, EMPTY or UNUSABLE) and
    ``left_over``, whether edges of a rebuilt geometry bound no area. ``key`` tells features apart; valid ones stay as they are.

    The edges, their meetings and the rebuilt rings are written tables, so each is found once. Features are dealt out first: a layer
    is a small file that one task reads, and most of the work is on what it is opened into.
    """
    taken = {c.lower() for c in layer.columns} & {"geometry_state", "left_over"}
    if taken:
        raise ValueError(f"{sorted(taken)} are columns of the layer already")
    layer = layer.repartition(int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    segments = staged(edges(layer, key, rings), "repair-edges")
    met = staged(meetings(segments, key), "repair-meetings")
    wrong = staged(_torn(layer, key, rings).union(met.where("wrong").select(key)).distinct(), "repair-wrong")
    pieces = boundary(segments.join(wrong, key, "left_semi"), met.join(wrong, key, "left_semi"), key)
    odd = F.col("times") % 2 == 1
    gathered = pieces.groupBy(key).agg(F.flatten(F.collect_list(F.when(odd, F.array("px", "py", "qx", "qy")))).alias("_pieces"), F.max(~odd).alias("_left_over"))
    rebuilt = gathered.select(key, _points(_walked("_pieces")).alias("_rings"), "_left_over")
    found = staged(wrong.join(rebuilt, key, "left").withColumn("_wrong", F.lit(True)), "repair-rebuilt")
    marked = layer.join(found, key, "left")
    none = F.coalesce(F.size(rings) == 0, F.lit(True))
    state = F.when(none, EMPTY).when(F.col("_wrong").isNull(), KEEP).when(F.coalesce(F.size("_rings") > 0, F.lit(False)), REPAIRED).otherwise(UNUSABLE)
    out = marked.withColumn("geometry_state", state).withColumn("left_over", F.coalesce(F.col("_left_over"), F.lit(False)))
    return out.withColumn(rings, F.when(F.col("geometry_state") == REPAIRED, F.col("_rings")).when(F.col("geometry_state") == UNUSABLE, None).otherwise(F.col(rings))).select(*layer.columns, "geometry_state", "left_over")


def repair_quality(mended: DataFrame, by: str, key: str, rings: str = "rings") -> DataFrame:
    """The quality record of each layer of a ``repaired`` table, counts before and after, with unusable features dropped.

    Areas come from edges that occur an odd number of times, so no feature needs a second way of repair and that count is 0.
    """
    usable = F.col("geometry_state").isin(KEEP, REPAIRED)
    mended = staged(mended, "repair-mended")
    still = wrong_features(mended.where(usable), key, rings).withColumn("_still", F.lit(True))
    rows = mended.join(still, key, "left")
    kind = F.when(usable, F.when(geo.outer_rings(F.col(rings)) == 1, "Polygon").otherwise("MultiPolygon"))
    state = lambda s: F.count_if(F.col("geometry_state") == s)
    wrong = F.col("geometry_state").isin(REPAIRED, UNUSABLE)
    return rows.groupBy(F.col(by).alias("layer")).agg(
        F.count("*").alias("feature_count"),
        state(EMPTY).alias("empty_geometry_count_before"),
        F.count_if(wrong).alias("invalid_geometry_count_before"),
        (F.count_if(wrong) > 0).alias("repair_attempted"),
        state(REPAIRED).alias("repaired_geometry_count"),
        F.count_if(~usable).alias("unusable_after_repair_count"),
        F.count_if(F.col("_still")).alias("invalid_geometry_count_after_repair"),
        state(EMPTY).alias("empty_geometry_count_after_repair"),
        F.count_if((F.col("geometry_state") == REPAIRED) & F.col("left_over")).alias("geometry_collection_repair_count"),
        F.lit(0).cast("long").alias("buffer_zero_fallback_count"),
        F.array_join(F.array_sort(F.collect_set(kind)), ", ").alias("output_geometry_type_after_repair"),
        F.count_if(usable).alias("output_feature_count_after_repair"),
        F.count_if(~usable).alias("dropped_unusable_feature_count"),
    )


def standardised(layer: DataFrame, key: str, keep: Sequence[str], required: Sequence[str] = (), drop_unusable: bool = True, rings: str = "rings", projected: bool = False) -> tuple[DataFrame, dict]:
    """The standard form of one layer and its quality record: safe columns only, valid polygons, metres of the Irish grid.

    Required columns are checked first; then geometries are repaired, those left unusable dropped (or, if they are not to be,
    ``RepairError`` raised), the wanted columns selected and the rings projected. A layer without a usable polygon raises too. Wanted
    columns that do not exist are listed in the record. ``projected`` layers are in metres already.
    """
    from sitelens.operators.spatial import boxed

    missing = layers.resolve_columns(layer.columns, required)[1]
    if missing:
        raise RepairError(f"missing required columns: {', '.join(missing)}", {"missing_required_columns": missing})
    found, absent = layers.resolve_columns(layer.columns, keep)
    mended = staged(repaired(layer, key, rings), "repair-layer")
    record = repair_quality(mended.withColumn("_layer", F.lit(1)), "_layer", key, rings).drop("layer").first()
    quality = record.asDict() if record else {"feature_count": 0, "output_feature_count_after_repair": 0, "unusable_after_repair_count": 0}
    if quality["unusable_after_repair_count"] and not drop_unusable:
        raise RepairError("polygons are unusable after repair", quality)
    if not quality["output_feature_count_after_repair"]:
        raise RepairError("no usable polygon", quality)
    good = mended.where(F.col("geometry_state").isin(KEEP, REPAIRED)).select(*dict.fromkeys([key, *found, rings]))
    out = good if projected else layers.to_itm_layer(good, rings)
    bounds = boxed(out, rings).agg(*[f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]).first()
    return out, quality | {"missing_optional_columns": absent, "valid_spatial_bounds": list(bounds)}
