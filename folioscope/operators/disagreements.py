"""Where prediction systems differ, ranked, and a spatially varied selection of it.

``regions`` holds page_id, system, sys_ord (a system's place on its page), reviewed, ord, id,
region_type and the box. References (reviewed) never make disagreements of their own; they are
shown beside those of predictions. Only boxes are compared, never one system's polygon with
another's box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box, area, iou, overlap_area, overlaps, union_box
from folioscope.functions.labels import PAIRED_FAMILY
from folioscope.operators.matching import best_overlaps, match_regions, unmatched
from folioscope.sources.store import settle

PAIR = ("page_id", "l_sys", "r_sys")
NMS_IOU = 0.4
#: Disagreements of a page from which on they are selected in rounds.
LARGE = 10_000


def system_pairs(systems: DataFrame) -> DataFrame:
    """Ordered pairs of a page's prediction systems: page_id, l_sys, r_sys (places) and names."""
    s = systems.where(~F.col("reviewed"))
    left = s.select("page_id", F.col("sys_ord").alias("l_sys"), F.col("system").alias("l_name"))
    right = s.select("page_id", F.col("sys_ord").alias("r_sys"), F.col("system").alias("r_name"))
    return left.join(right, "page_id").where("l_sys < r_sys")


def _side(regions: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    keyed = regions.withColumnRenamed("sys_ord", f"{side}_sys").drop("system", "reviewed")
    return pairs.join(keyed, ["page_id", f"{side}_sys"])


def disagreements(regions: DataFrame, systems: DataFrame, threshold: float = 0.5, large: int | None = None) -> DataFrame:
    """All label conflicts and unmatched regions of all pairs, with ``rank`` from 1 within the page.
    ``large``: for pages of many regions (see ``matching``).

    page_id, rank, l_name, r_name, kind, owner_sys, other_sys, owner_ord, other_ord, iou, box."""
    if large is None:
        return _by_page(regions, systems, threshold)
    regions, pairs = settle(regions, "disagreement-regions"), settle(system_pairs(systems), "disagreement-pairs")
    left, right = _side(regions, pairs, "l"), _side(regions, pairs, "r")
    matches = settle(match_regions(left, right, threshold, False, PAIR, large), "disagreement-matches")
    lone = "cast(null as int)"
    boxed = lambda df, ord_, prefix: df.select(*PAIR, F.col("ord").alias(ord_), *Box.of().columns(prefix))
    order = Window.partitionBy(*PAIR).orderBy(F.desc("iou"), F.desc("t_ord"), F.desc("p_ord"))
    conflicts = matches.withColumn("elem", F.row_number().over(order)).where("not type_match")
    conflicts = conflicts.join(boxed(left, "t_ord", "a_"), [*PAIR, "t_ord"]).join(boxed(right, "p_ord", "b_"), [*PAIR, "p_ord"])
    conflicts = conflicts.select(
        *PAIR, F.lit("different_types").alias("kind"), F.lit(0).alias("kind_ord"), (-F.col("iou")).alias("score"), F.lit(0).alias("side_ord"), F.col("elem").cast("long").alias("elem"),
        F.col("l_sys").alias("owner_sys"), F.col("r_sys").alias("other_sys"), F.col("t_ord").alias("owner_ord"), F.col("p_ord").alias("other_ord"), "iou",
        *union_box(Box.of("a_"), Box.of("b_")).columns(),
    )
    out = conflicts
    for n, (side, own, other, mine) in enumerate((("t", "l_sys", "r_sys", left), ("p", "r_sys", "l_sys", right)), 1):
        rest = unmatched(mine, matches, side, PAIR)
        rest = rest.select(
            *PAIR, F.lit("unmatched").alias("kind"), F.lit(1).alias("kind_ord"), (-area(Box.of())).cast("double").alias("score"), F.lit(n).alias("side_ord"), F.col("ord").cast("long").alias("elem"),
            F.col(own).alias("owner_sys"), F.col(other).alias("other_sys"), F.col("ord").alias("owner_ord"), F.expr(lone).alias("other_ord"), F.lit(None).cast("double").alias("iou"), *Box.of().columns(),
        )
        out = out.unionByName(rest)
    out = out.join(pairs, list(PAIR))
    family = F.col("l_name").startswith(PAIRED_FAMILY) & F.col("r_name").startswith(PAIRED_FAMILY)
    out = out.withColumn("priority", F.when(family, 0).otherwise(1))
    rank = Window.partitionBy("page_id").orderBy("priority", "kind_ord", "score", "l_sys", "r_sys", "side_ord", "elem")
    out = out.withColumn("rank", F.row_number().over(rank))
    return out.select("page_id", "rank", "l_name", "r_name", "kind", "owner_sys", "other_sys", "owner_ord", "other_ord", "iou", *Box._fields)


def _pages(regions: DataFrame, systems: DataFrame, *more: str) -> DataFrame:
    """A row for each page that has regions: its systems, and all its regions (with ``more`` of their columns). Keyed by the page alone, so
    that tables dealt by page meet where they are."""
    region = F.struct(F.col("sys_ord").alias("sys"), "ord", *more, F.col("region_type").alias("type"), *Box._fields)
    of_page = systems.groupBy("page_id").agg(F.collect_list(F.struct(F.col("sys_ord").alias("sys"), F.col("system").alias("name"), "reviewed")).alias("systems"))
    return of_page.join(regions.groupBy("page_id").agg(F.collect_list(region).alias("regions")), "page_id")


def _iou_of(met: Column) -> Column:
    """``iou`` of two boxes, from what they share and the sum of both areas."""
    union = met["both"] - met["shared"]
    return F.when(union == 0, F.lit(0.0)).otherwise(F.try_divide(met["shared"].cast("double"), union.cast("double")))


def _by_page(regions: DataFrame, systems: DataFrame, threshold: float) -> DataFrame:
    """``disagreements`` with each page in one row: candidates, assignment and order without another shuffle."""
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    own = F.transform(F.filter("systems", lambda s: ~s["reviewed"]), lambda s: F.struct(s["sys"], s["name"], F.filter("regions", lambda r: r["sys"] == s["sys"]).alias("regions")))
    rows = _pages(regions, systems).select("page_id", own.alias("own"))
    rows = rows.select("page_id", F.flatten(F.transform("own", lambda l: F.transform(F.filter("own", lambda r: l["sys"] < r["sys"]), lambda r: F.struct(l.alias("l"), r.alias("r"))))).alias("pairs"))  # noqa: E741
    met = lambda t, p: F.struct(overlap_area(Box.struct(t), Box.struct(p)).alias("shared"), (area(Box.struct(t)) + area(Box.struct(p))).alias("both"), t.alias("t"), p.alias("p"))
    pair = lambda x: F.struct(_iou_of(x).alias("iou"), x["t"]["ord"].alias("t_ord"), x["p"]["ord"].alias("p_ord"), x["t"]["type"].alias("t_type"), x["p"]["type"].alias("p_type"), *union_box(Box.struct(x["t"]), Box.struct(x["p"])).columns())
    # at 0, pairs that don't touch count too
    meets = lambda t, p: overlaps(Box.struct(t), Box.struct(p)) if threshold > 0 else F.lit(True)
    touching = lambda x: F.flatten(F.transform(x["l"]["regions"], lambda t: F.transform(F.filter(x["r"]["regions"], lambda p: meets(t, p)), lambda p: met(t, p))))
    found = lambda x: F.transform(F.filter(touching(x), lambda v: _iou_of(v) >= threshold), pair)
    rows = rows.select("page_id", F.transform("pairs", lambda x: F.struct(x.alias("x"), F.sort_array(found(x), asc=False).alias("c"))).alias("pairs"))
    take = lambda acc, k: F.when(F.exists(acc, lambda z: (z["t_ord"] == k["t_ord"]) | (z["p_ord"] == k["p_ord"])), acc).otherwise(F.array_append(acc, k))
    rows = rows.select("page_id", F.transform("pairs", lambda y: F.struct(y["x"].alias("x"), F.aggregate(y["c"], F.filter(y["c"], lambda z: F.lit(False)), take).alias("m"))).alias("pairs"))

    def shown(x: Column, kind: str, order: int, score: Column, side: int, elem: Column, sides: tuple[str, str], ords: tuple[Column, Column], overlap: Column, box: Box) -> Column:
        family = x["l"]["name"].startswith(PAIRED_FAMILY) & x["r"]["name"].startswith(PAIRED_FAMILY)
        return F.struct(
            F.when(family, 0).otherwise(1).alias("priority"), F.lit(order).alias("kind_ord"), score.cast("double").alias("score"), x["l"]["sys"].alias("l_sys"), x["r"]["sys"].alias("r_sys"), F.lit(side).alias("side_ord"), elem.cast("long").alias("elem"),
            x["l"]["name"].alias("l_name"), x["r"]["name"].alias("r_name"), F.lit(kind).alias("kind"), x[sides[0]]["sys"].alias("owner_sys"), x[sides[1]]["sys"].alias("other_sys"), ords[0].alias("owner_ord"), ords[1].alias("other_ord"), overlap.cast("double").alias("iou"), *box.columns(),
        )

    def lone(x: Column, m: Column, mine: str, other: str, took: str, side: int) -> Column:
        rest = F.filter(x[mine]["regions"], lambda r: ~F.exists(m, lambda z: same(z[took], r["ord"])))
        return F.transform(rest, lambda r: shown(x, "unmatched", 1, -area(Box.struct(r)), side, r["ord"], (mine, other), (r["ord"], F.nullif(r["ord"], r["ord"])), F.lit(None), Box.struct(r)))

    def all_of(y: Column) -> Column:
        x, m = y["x"], y["m"]
        nth = F.transform(m, lambda z, i: F.struct(z.alias("z"), i.alias("i")))
        unlike = F.filter(nth, lambda e: ~e["z"]["t_type"].eqNullSafe(e["z"]["p_type"]))
        conflicts = F.transform(unlike, lambda e: shown(x, "different_types", 0, -e["z"]["iou"], 0, e["i"] + 1, ("l", "r"), (e["z"]["t_ord"], e["z"]["p_ord"]), e["z"]["iou"], Box.struct(e["z"])))
        return F.concat(conflicts, lone(x, m, "l", "r", "t_ord", 1), lone(x, m, "r", "l", "p_ord", 2))

    ranked = rows.select("page_id", F.posexplode(F.sort_array(F.flatten(F.transform("pairs", all_of)))).alias("rank", "d"))
    return ranked.select("page_id", (F.col("rank") + 1).alias("rank"), *(F.col(f"d.{c}").alias(c) for c in ("l_name", "r_name", "kind", "owner_sys", "other_sys", "owner_ord", "other_ord", "iou", *Box._fields)))


def select_varied(ranked: DataFrame, limit: int = 4, nms_iou: float = NMS_IOU, large: int | None = LARGE) -> DataFrame:
    """The first ``limit`` of a page by rank that overlap none taken before by ``nms_iou`` or more.

    Pages of more than ``large`` disagreements never lie in one row: they take one of them in each of
    ``limit`` rounds, as many as a page can keep."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    if large is None:
        return _folded(ranked, limit, nms_iou)
    ranked = settle(ranked, "ranked")
    crowded = settle(ranked.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > large).select("page_id"), "crowded-disagreements")
    if crowded.isEmpty():
        return _folded(ranked, limit, nms_iou)
    rounds = _in_rounds(ranked.join(crowded, "page_id", "left_semi"), limit, nms_iou)
    return _folded(ranked.join(crowded, "page_id", "left_anti"), limit, nms_iou).unionByName(rounds)


def _in_rounds(ranked: DataFrame, limit: int, nms_iou: float) -> DataFrame:
    """Each round takes the first of every page that overlaps none of its few taken before."""
    row = F.struct("rank", F.struct(*(F.col(c) for c in ranked.columns if c not in ("page_id", "rank"))).alias("d"))
    taken = ranked.select("page_id").distinct().withColumn("taken", F.filter(F.array(F.lit(None).cast(ranked.select(row.alias("r")).schema["r"].dataType)), lambda x: x.isNotNull()))
    for _ in range(limit):
        near = F.exists("taken", lambda z: iou(Box.struct(z["d"]), Box.of()) >= nms_iou)
        later = F.size("taken") == 0
        rest = ranked.join(taken, "page_id").where(~near & (later | (F.col("rank") > F.element_at("taken", -1)["rank"])))
        first = rest.groupBy("page_id").agg(F.min_by(row, "rank").alias("next"))
        taken = taken.join(first, "page_id", "left").select("page_id", F.when(F.col("next").isNotNull(), F.array_append("taken", F.col("next"))).otherwise(F.col("taken")).alias("taken"))
        taken = settle(taken, "taken")
    return taken.select("page_id", F.explode("taken").alias("p")).select("page_id", "p.rank", "p.d.*")


def _folded(ranked: DataFrame, limit: int, nms_iou: float) -> DataFrame:
    whole = F.sort_array(F.collect_list(F.struct("rank", F.struct(*(F.col(c) for c in ranked.columns if c not in ("page_id", "rank"))).alias("d"))))
    pages = ranked.groupBy("page_id").agg(whole.alias("all"))
    close = lambda k: lambda z: iou(Box.struct(z["d"]), Box.struct(k["d"])) >= nms_iou
    keep = lambda acc, k: F.when((F.size(acc) >= limit) | F.exists(acc, close(k)), acc).otherwise(F.array_append(acc, k))
    picked = pages.select("page_id", F.explode(F.aggregate("all", F.filter("all", lambda x: F.lit(False)), keep)).alias("p"))
    return picked.select("page_id", "p.rank", "p.d.*")


def observations(ranked: DataFrame, regions: DataFrame, systems: DataFrame, threshold: float = 0.5, large: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """What each system of the page has where a disagreement lies: page_id, rank, system, reviewed,
    relationship (in_pair, overlapping, no_counterpart or none), region_id, region_type, overlap,
    and nearby_id and nearby_type for a box that touches without matching. ``carry``: columns of ``ranked``
    that each row keeps."""
    if large is None:
        rows = _seen_by_page(ranked, regions, systems, threshold, carry)
    else:
        rows = _seen_by_joins(ranked, regions, systems, threshold, large, carry)
    unpaired = ~F.col("reviewed") & (F.col("sys_ord") == F.col("other_sys")) & F.col("other_ord").isNull()
    found = F.col("e_id").isNotNull() | (F.col("matched") & ~unpaired)
    kind = F.when(F.col("e_id").isNotNull(), "in_pair").when(unpaired, "no_counterpart").when(F.col("matched"), "overlapping").otherwise("none")
    touching = ~found & (F.col("overlap") > 0)
    return rows.select(
        "page_id", "rank", *carry, "system", "reviewed", kind.alias("relationship"),
        F.when(F.col("e_id").isNotNull(), F.col("e_id")).when(found, F.col("nearest_id")).alias("region_id"),
        F.when(F.col("e_id").isNotNull(), F.col("e_type")).when(found, F.col("nearest_type")).alias("region_type"),
        F.when(F.col("e_id").isNotNull(), iou(Box.of("k_"), Box.of("e_"))).otherwise(F.col("overlap")).alias("overlap"),
        F.when(touching, F.col("nearest_id")).alias("nearby_id"), F.when(touching, F.col("nearest_type")).alias("nearby_type"),
    )


_ANCHOR = ("rank", "owner_sys", "other_sys", "owner_ord", "other_ord")


def _seen_by_joins(ranked: DataFrame, regions: DataFrame, systems: DataFrame, threshold: float, large: int, carry: tuple[str, ...]) -> DataFrame:
    """For each disagreement and system its nearest region, and that of its pair (e_): by joins."""
    anchors = ranked.select("page_id", *_ANCHOR, *carry, *Box.of().columns("k_"))
    have = systems.select("page_id", "system", "sys_ord", "reviewed").join(regions.drop("system", "reviewed"), ["page_id", "sys_ord"], "left")
    best = best_overlaps(ranked.select("page_id", "rank", *Box._fields), have, ("rank",), threshold, large)
    rows = anchors.join(best, ["page_id", "rank"]).join(systems.select("page_id", "system", "sys_ord", "reviewed"), ["page_id", "system"])
    in_pair = F.when(F.col("sys_ord") == F.col("owner_sys"), F.col("owner_ord")).when(F.col("sys_ord") == F.col("other_sys"), F.col("other_ord"))
    exact = regions.select("page_id", "sys_ord", F.col("ord").alias("e_ord"), F.col("id").alias("e_id"), F.col("region_type").alias("e_type"), *Box.of().columns("e_"))
    return rows.withColumn("e_ord", F.when(~F.col("reviewed"), in_pair)).join(exact, ["page_id", "sys_ord", "e_ord"], "left")


def _seen_by_page(ranked: DataFrame, regions: DataFrame, systems: DataFrame, threshold: float, carry: tuple[str, ...]) -> DataFrame:
    """The same with each page in one row."""
    anchor = F.struct(*_ANCHOR, *carry, *Box.of().columns("k_"))
    rows = _pages(regions, systems, "id").join(ranked.groupBy("page_id").agg(F.collect_list(anchor).alias("anchors")), "page_id")
    named = lambda s: F.transform(F.filter("systems", lambda z: z["name"] == s["name"]), lambda z: z["sys"])
    rows = rows.select("page_id", "anchors", "regions", F.explode(F.transform("systems", lambda s: F.struct(s.alias("s"), named(s).alias("of")))).alias("y"))
    rows = rows.select("page_id", "anchors", F.col("y.s").alias("s"), F.filter("regions", lambda r: F.array_contains(F.col("y.of"), r["sys"])).alias("near"), F.filter("regions", lambda r: r["sys"] == F.col("y.s.sys")).alias("own"))
    # of equal overlaps the smallest ord; where nothing touches, the first region stands for all
    rows = rows.select("*", F.array_min(F.transform("near", lambda r: F.struct(r["ord"].alias("ord"), r["id"].alias("id"), r["type"].alias("type")))).alias("least"))
    met = lambda k, r: F.struct(overlap_area(Box.struct(k, "k_"), Box.struct(r)).alias("shared"), (area(Box.struct(k, "k_")) + area(Box.struct(r))).alias("both"), r.alias("r"))
    touching = lambda k: F.transform(F.filter("near", lambda r: overlaps(Box.struct(k, "k_"), Box.struct(r))), lambda r: met(k, r))
    best = lambda k: F.array_max(F.transform(touching(k), lambda v: F.struct(_iou_of(v).alias("overlap"), (-v["r"]["ord"]).alias("first"), v["r"]["id"].alias("id"), v["r"]["type"].alias("type"))))
    in_pair = lambda k: F.when(F.col("s.sys") == k["owner_sys"], k["owner_ord"]).when(F.col("s.sys") == k["other_sys"], k["other_ord"])
    exact = lambda k: F.when(~F.col("s.reviewed"), F.get(F.filter("own", lambda r: r["ord"] == in_pair(k)), F.lit(0)))
    each = rows.select("page_id", "s", "least", F.explode(F.transform("anchors", lambda k: F.struct(k.alias("k"), best(k).alias("b"), exact(k).alias("e")))).alias("o"))
    return each.select(
        "page_id", "o.k.*", F.col("s.sys").alias("sys_ord"), F.col("s.name").alias("system"), F.col("s.reviewed").alias("reviewed"), F.coalesce("o.b.overlap", F.lit(0.0)).alias("overlap"),
        (F.col("least").isNotNull() & (F.coalesce("o.b.overlap", F.lit(0.0)) >= threshold)).alias("matched"),
        *(F.when(F.col("o.b").isNotNull(), F.col(f"o.b.{c}")).otherwise(F.col(f"least.{c}")).alias(f"nearest_{c}") for c in ("id", "type")),
        F.col("o.e.id").alias("e_id"), F.col("o.e.type").alias("e_type"), *(F.col(f"o.e.{c}").alias(f"e_{c}") for c in Box._fields),
    )


def identifier(page_id: Column, l_name: Column, r_name: Column, kind: Column, box: Box, observed: Column) -> Column:
    """A short id, unique for a pair, kind, place and what was observed."""
    parts = [c.cast("string") for c in (page_id, l_name, r_name, kind, *box, observed)]
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 16)


def identified(ranked: DataFrame, seen: DataFrame) -> DataFrame:
    """``ranked`` with the identifier of each row, by the regions that its systems were seen to have.
    Observations that carry all columns of ``ranked`` aren't joined with it."""
    said = F.concat_ws("=", "system", F.coalesce("region_id", F.lit("")))
    keys = ranked.columns if set(ranked.columns) <= set(seen.columns) else ["page_id", "rank"]
    if len(keys) > 2:  # a page's observations in one place, as they were made
        taken = F.struct(*(c for c in keys if c != "page_id"))
        rows = seen.groupBy("page_id", taken.alias("d"))
    else:
        rows = seen.groupBy(*keys)
    observed = rows.agg(F.array_join(F.sort_array(F.collect_list(F.struct("system", said.alias("said"))))["said"], ";").alias("observed"))
    rows = observed.select("page_id", "d.*", "observed") if len(keys) > 2 else ranked.join(observed, keys)
    named = identifier(F.col("page_id"), F.col("l_name"), F.col("r_name"), F.col("kind"), Box.of(), F.col("observed"))
    return rows.withColumn("identifier", named).drop("observed")
