"""One-to-one matching of two region sets by overlap.

Both sides hold page_id, ord (a region's place in its list), region_type and the box x1..y2.
Candidates come from an equi-join on page_id (and type), with the overlap as its residual. Of all
candidates of a page the best is taken, then the best whose regions are both free, and so on: by
IoU, then truth ord, then prediction ord, all descending.

Pages of many regions have another way, by ``large``: a grid over the page, so that only regions of one
cell meet, and rounds in place of the fold over one row. Both give the same pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box, iou, overlaps
from folioscope.sources.store import settle

KEYS = ("page_id",)
#: Regions of a page, on either side, from which on it has a grid; candidates from which on it has rounds.
LARGE, MANY = 500, 5_000


def _sided(df: DataFrame, side: str, by: tuple[str, ...]) -> DataFrame:
    return df.select(*by, F.col("ord").alias(f"{side}_ord"), F.col("region_type").alias(f"{side}_type"), *Box.of().columns(f"{side}_"))


def _cells(side: DataFrame, prefix: str, by: tuple[str, ...]) -> DataFrame:
    """A row for each cell of its page's grid that a region touches."""
    b = Box.of(prefix)
    first = lambda v, low, step: F.floor((v - F.col(low)) / F.col(step)).cast("long")
    spans = {"cx": (b.x1, b.x2, "left", "wide"), "cy": (b.y1, b.y2, "top", "high")}
    for name, (low, high, start, step) in spans.items():
        side = side.withColumn(name, F.explode(F.sequence(first(low, start, step), first(high, start, step))))
    return side


def overlap_join(left: DataFrame, right: DataFrame, by: tuple[str, ...] = KEYS, sides: tuple[str, str] = ("t_", "p_"), large: int | None = None) -> DataFrame:
    """All pairs of one key whose boxes (columns with the two prefixes) overlap; other columns are kept.

    ``large``: keys with more boxes than that on a side go by a grid of about as many cells as boxes, square
    ones where the page's shape allows it, and no smaller than the mean box. A pair counts in the one
    cell that has the upper left corner of what both share."""
    l, r = (Box.of(s) for s in sides)
    if large is None:
        return left.join(right, list(by)).where(overlaps(l, r))
    sized = lambda df, b: df.select(*by, *(F.col(c).cast("double").alias(n) for c, n in zip((f"{b}x1", f"{b}y1", f"{b}x2", f"{b}y2"), Box._fields, strict=True)))
    facts = [sized(df, s).groupBy(*by).agg(F.count("*").alias("n"), F.min("x1").alias("left"), F.min("y1").alias("top"), F.max("x2").alias("right"), F.max("y2").alias("bottom"), F.sum(F.col("x2") - F.col("x1")).alias("w"), F.sum(F.col("y2") - F.col("y1")).alias("h")) for df, s in ((left, sides[0]), (right, sides[1]))]
    both = facts[0].unionByName(facts[1]).groupBy(*by).agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("sides"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.sum("w").alias("w"), F.sum("h").alias("h"))
    width, height, n = F.col("right") - F.col("left"), F.col("bottom") - F.col("top"), F.col("n")
    # on a long narrow page the root of its boxes for either side would make cells of ever more boxes
    high = F.greatest(F.least(F.sqrt(width * height / n), height), F.col("h") / n, F.lit(1e-9))
    wide = F.greatest(width * F.greatest(height / high, F.lit(1.0)) / n, F.col("w") / n, F.lit(1e-9))
    crowded = both.where((F.col("most") > large) & (F.col("sides") == 2)).select(*by, "left", "top", wide.alias("wide"), high.alias("high"))
    crowded = settle(crowded, "crowded-pages")
    if crowded.isEmpty():
        return overlap_join(left, right, by, sides)
    few = overlap_join(left.join(crowded, list(by), "left_anti"), right.join(crowded, list(by), "left_anti"), by, sides)
    placed = lambda df, s: _cells(df.join(crowded, list(by)), s, by)
    met = placed(left, sides[0]).join(placed(right, sides[1]).drop("left", "top", "wide", "high"), [*by, "cx", "cy"]).where(overlaps(l, r))
    corner = lambda a, b, start, width: F.floor((F.greatest(a, b) - F.col(start)) / F.col(width))
    once = (corner(l.x1, r.x1, "left", "wide") == F.col("cx")) & (corner(l.y1, r.y1, "top", "high") == F.col("cy"))
    return few.unionByName(met.where(once).drop("cx", "cy", "left", "top", "wide", "high"))


def iou_candidates(truth: DataFrame, predictions: DataFrame, threshold: float = 0.5, same_type: bool = False, by: tuple[str, ...] = KEYS, large: int | None = None) -> DataFrame:
    """All pairs of a page (and type) with IoU of at least ``threshold``. ``large``: see ``overlap_join``."""
    t, p = _sided(truth, "t", by), _sided(predictions, "p", by)
    keys = by
    if same_type and "region_type" not in by:
        t, p = t.withColumn("same_type", F.col("t_type")), p.withColumn("same_type", F.col("p_type"))
        keys = (*by, "same_type")
    joined = overlap_join(t, p, keys, large=large) if threshold > 0 else t.join(p, list(keys))  # at 0, pairs that don't touch count too
    pairs = joined.select(*by, "t_ord", "p_ord", "t_type", "p_type", iou(Box.of("t_"), Box.of("p_")).alias("iou"))
    return pairs.where(F.col("iou") >= threshold)


def greedy(candidates: DataFrame, by: tuple[str, ...] = KEYS) -> DataFrame:
    """The one-to-one assignment out of candidates, folded over each page's sorted candidates."""
    best_first = F.sort_array(F.collect_list(F.struct("iou", "t_ord", "p_ord", "t_type", "p_type")), asc=False)
    grouped = candidates.groupBy(*by).agg(best_first.alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    take = lambda acc, k: F.when(F.exists(acc, lambda z: (z["t_ord"] == k["t_ord"]) | (z["p_ord"] == k["p_ord"])), acc).otherwise(F.array_append(acc, k))
    return grouped.select(*by, F.explode(F.aggregate("all", none, take)).alias("m")).select(*by, "m.*")


def greedy_rounds(candidates: DataFrame, by: tuple[str, ...] = KEYS, cut=None) -> DataFrame:
    """The same assignment for pages with more candidates than one row should hold: in each round
    the pairs that are best for both their regions are taken, and what they block is removed. The
    order of candidates is strict, so rounds and the fold agree. ``cut``: ends lineage after a round."""
    cut = cut or (lambda df: df.checkpoint())
    rest, taken = cut(candidates), None
    order = [F.desc("iou"), F.desc("t_ord"), F.desc("p_ord")]
    while not rest.isEmpty():
        by_t, by_p = Window.partitionBy(*by, "t_ord").orderBy(*order), Window.partitionBy(*by, "p_ord").orderBy(*order)
        best = cut(rest.withColumn("rt", F.row_number().over(by_t)).withColumn("rp", F.row_number().over(by_p)).where("rt = 1 and rp = 1").drop("rt", "rp"))
        taken = best if taken is None else taken.unionByName(best)
        rest = rest.join(best.select(*by, "t_ord"), [*by, "t_ord"], "left_anti").join(best.select(*by, "p_ord"), [*by, "p_ord"], "left_anti")
        rest = cut(rest)
    return candidates.limit(0) if taken is None else taken


def assign(candidates: DataFrame, by: tuple[str, ...] = KEYS, many: int = MANY) -> DataFrame:
    """The one-to-one assignment: folded, and by rounds for keys of more than ``many`` candidates."""
    candidates = settle(candidates, "candidates")
    crowded = settle(candidates.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > many).select(*by), "crowded-candidates")
    if crowded.isEmpty():
        return greedy(candidates, by)
    rounds = greedy_rounds(candidates.join(crowded, list(by), "left_semi"), by, lambda df: settle(df, "round"))
    return greedy(candidates.join(crowded, list(by), "left_anti"), by).unionByName(rounds, allowMissingColumns=True)


def match_regions(truth: DataFrame, predictions: DataFrame, threshold: float = 0.5, same_type: bool = False, by: tuple[str, ...] = KEYS, large: int | None = None, many: int = MANY) -> DataFrame:
    """Matches: keys, t_ord, p_ord, t_type, p_type, iou and type_match. ``large`` and ``many``: for pages of many regions."""
    candidates = iou_candidates(truth, predictions, threshold, same_type, by, large)
    matches = greedy(candidates, by) if large is None else assign(candidates, by, many)
    return matches.withColumn("type_match", F.col("t_type").eqNullSafe(F.col("p_type")))


def unmatched(regions: DataFrame, matches: DataFrame, side: str, by: tuple[str, ...] = KEYS) -> DataFrame:
    """The regions of a side (t or p) that no match took."""
    return regions.join(matches.select(*by, F.col(f"{side}_ord").alias("ord")), [*by, "ord"], "left_anti")


def best_overlaps(anchors: DataFrame, regions: DataFrame, anchor_key: tuple[str, ...], threshold: float = 0.5, large: int | None = None) -> DataFrame:
    """For each anchor (page_id, anchor_key, box) and system of its page: the region of greatest IoU
    and smallest ord; a system without regions has overlap 0.0. ``regions`` holds page_id, system
    and, where it has any, ord, id, region_type and box."""
    r = regions.select("page_id", "system", F.col("ord").alias("r_ord"), F.col("id").alias("r_id"), F.col("region_type").alias("r_type"), *Box.of().columns("r_"))
    columns = ["page_id", *anchor_key, "system", "r_ord", "r_id", "r_type", "overlap"]
    touching = overlap_join(anchors, r.where("r_ord is not null"), sides=("", "r_"), large=large).withColumn("overlap", iou(Box.of(), Box.of("r_")))
    # where nothing touches, the first region of each system stands for all
    place = F.when(F.col("r_ord").isNotNull(), F.struct("r_ord", "r_id", "r_type"))
    least = r.groupBy("page_id", "system").agg(F.min(place).alias("some")).select("page_id", "system", "some.*")
    others = anchors.select("page_id", *anchor_key).join(least, "page_id").withColumn("overlap", F.lit(0.0))
    rows = touching.select(*columns).unionByName(others.select(*columns))
    order = Window.partitionBy("page_id", *anchor_key, "system").orderBy(F.desc("overlap"), "r_ord")
    first = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    matched = F.col("r_ord").isNotNull() & (F.col("overlap") >= threshold)
    return first.select("page_id", *anchor_key, "system", "overlap", matched.alias("matched"), F.col("r_id").alias("nearest_id"), F.col("r_type").alias("nearest_type"))
