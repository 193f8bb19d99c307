"""Linking readings, failures and references to regions.

Regions here hold page_id, source, ord, id and the box; ``link_equivalent`` compares two such sets
page by page. Two regions are the same if exactly one candidate has the id, or else if exactly one
candidate overlaps by ``CLOSE`` or more; a link counts only if it holds both ways.

Groups and readings of ordinary pages are made with the page in one row, dealt once. Callers that ask for
large pages (``large``) have joins. Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box, iou, overlaps
from folioscope.functions.ids import region_of_crop
from folioscope.functions.labels import system_name, system_rank
from folioscope.functions.text import htr_metrics
from folioscope.operators.matching import overlap_join
from folioscope.sources.store import settle

CLOSE = 0.95


def _alike(left: DataFrame, right: DataFrame, close: float, large: int | None) -> DataFrame:
    """page_id, l_ord, r_ord and same: pairs with one id (same), and pairs that are close. Ids meet in an
    equi-join of their own, boxes by their overlap."""
    a = left.select("page_id", F.col("ord").alias("l_ord"), F.col("id").alias("l_id"), *Box.of().columns("l_"))
    b = right.select("page_id", F.col("ord").alias("r_ord"), F.col("id").alias("r_id"), *Box.of().columns("r_"))
    same = a.join(b, (a["page_id"] == b["page_id"]) & (F.col("l_id") == F.col("r_id"))).select(a["page_id"], "l_ord", "r_ord", F.lit(True).alias("same"))
    near = overlap_join(a, b, sides=("l_", "r_"), large=large).where(iou(Box.of("l_"), Box.of("r_")) >= close).select("page_id", "l_ord", "r_ord", F.lit(False).alias("same"))
    return same.unionByName(near)


def _only(pairs: DataFrame, mine: str, other: str) -> DataFrame:
    """For each region of a side its one equivalent: by id, or else by overlap."""
    once = lambda which: (F.count_if(which), F.max(F.when(which, F.col(other))))
    (n_same, by_id), (n_near, by_box) = once(F.col("same")), once(~F.col("same"))
    found = pairs.groupBy("page_id", mine).agg(F.when(n_same == 1, by_id).when(n_near == 1, by_box).alias(other))
    return found.where(F.col(other).isNotNull()).select("page_id", "l_ord", "r_ord")


def link_equivalent(left: DataFrame, right: DataFrame, close: float = CLOSE, large: int | None = None) -> DataFrame:
    """page_id, l_ord, r_ord: for each left region its one equivalent on the right, if there is one.
    ``large``: see ``overlap_join``."""
    return _only(_alike(left, right, close, large), "l_ord", "r_ord")


def link_reciprocal(left: DataFrame, right: DataFrame, close: float = CLOSE, large: int | None = None) -> DataFrame:
    """The links that hold from both sides, out of the same pairs."""
    pairs = settle(_alike(left, right, close, large), "alike")
    return _only(pairs, "l_ord", "r_ord").join(_only(pairs, "r_ord", "l_ord"), ["page_id", "l_ord", "r_ord"], "left_semi")


def link_unique(records: DataFrame, groups: DataFrame, key: str = "region_id") -> tuple[DataFrame, DataFrame]:
    """Records with exactly one group of their page and region id (with group_ord), and the rest."""
    once = groups.groupBy("page_id", F.col("id").alias(key)).agg(F.count("*").alias("n"), F.min("ord").alias("group_ord")).where("n = 1").drop("n")
    return records.join(once, ["page_id", key]), records.join(once, ["page_id", key], "left_anti")


def open_failures(failures: DataFrame, readings: DataFrame) -> DataFrame:
    """Failures of a group and system that have no reading after all."""
    return failures.join(readings.select("page_id", "group_ord", "system"), ["page_id", "group_ord", "system"], "left_anti")


def merge_frozen(groups: DataFrame, frozen: DataFrame) -> DataFrame:
    """Groups with the frozen input regions whose ids they don't have, an id's first only."""
    side = lambda n: F.lit(n).alias("side")
    rows = groups.select("*", side(0)).unionByName(frozen.select("*", side(1)), allowMissingColumns=True)
    named, page = Window.partitionBy("page_id", "id"), Window.partitionBy("page_id")
    rows = rows.withColumn("nth", F.row_number().over(named.orderBy("side", "ord"))).withColumn("before", F.count_if(F.col("side") == 0).over(named))
    rows = rows.withColumn("after", F.max(F.when(F.col("side") == 0, F.col("ord") + 1)).over(page))
    fresh = (F.col("nth") == F.col("before") + 1) & ((F.col("before") == 0) | F.col("id").isNull())  # no id is like another
    place = F.when(F.col("side") == 0, F.col("ord")).otherwise(F.coalesce("after", F.lit(0)) + F.col("ord"))
    return rows.where((F.col("side") == 0) | fresh).withColumn("ord", place).drop("side", "nth", "before", "after")


def _in_pages(sides: dict[str, DataFrame]) -> DataFrame:
    """page_id, and the rows of each side on that page in an array. All are dealt by page, once."""
    rows = None
    for name, df in sides.items():
        item = F.struct(*(F.col(c) for c in df.columns if c != "page_id"))
        one = df.select("page_id", *((item if k == name else F.lit(None).cast(x.select(F.struct(*(c for c in x.columns if c != "page_id")).alias("x")).schema["x"].dataType)).alias(k) for k, x in sides.items()))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("page_id").agg(*(F.collect_list(k).alias(k) for k in sides))


def _with(value: Column, f) -> Column:
    """``f`` of a value that is made once, and not anew for each element that is compared with it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _one_of(x: Column, others: Column, close: float) -> Column:
    """Of the others in an array the one equivalent of a region, or null: by id, or else by overlap."""
    mine = Box.struct(x)
    same = F.filter(others, lambda y: y["id"] == x["id"])
    near = F.filter(others, lambda y: overlaps(mine, Box.struct(y)) & (iou(mine, Box.struct(y)) >= close))
    return _with(same, lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(_with(near, lambda more: F.when(F.size(more) == 1, F.get(more, F.lit(0))))))


def _linked(mine: str, other: str, close: float, beside=None) -> tuple[Column, Column]:
    """For arrays of two sides: each region of the first (a) with its equivalent (b), and of a column ``met`` of
    these the links that hold both ways. ``beside``: which of the first's regions one of the second is compared with."""
    met = F.transform(mine, lambda a: F.struct(a.alias("a"), _one_of(a, F.col(other), close).alias("b")))
    back = lambda p: F.col(mine) if beside is None else F.filter(mine, lambda z: beside(z, p["a"]))
    return met, F.filter("met", lambda p: p["b"].isNotNull() & (_one_of(p["b"], back(p), close)["ord"] == p["a"]["ord"]))


def human_text(annotated: Column, review_status: Column, corrected: Column) -> Column:
    """A human's transcription in an annotation if it is marked so, else that of corrected layout."""
    return F.coalesce(F.when(review_status == "human_corrected", annotated), corrected)


def prioritized(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose keys it doesn't have."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def build_groups(annotations: DataFrame, frozen: DataFrame, corrected: DataFrame, large: int | None = None) -> DataFrame:
    """Comparison groups of all pages: page_id, ord, id, region_type, box, region_source, human_text,
    human_source. Annotated regions come first, then frozen inputs, then corrected layout that is
    equivalent to none of these both ways. ``large``: for pages of many regions."""
    box = list(Box._fields)
    base = annotations.select("page_id", "ord", "id", "region_type", *box, F.col("source").alias("region_source"), F.when(F.col("review_status") == "human_corrected", F.col("transcription")).alias("human_text"), F.when((F.col("review_status") == "human_corrected") & F.col("transcription").isNotNull(), F.col("source")).alias("human_source"))
    given = frozen.select("page_id", "ord", "id", "region_type", *box, F.col("source").alias("region_source"))
    if large is None:
        return _groups_of_pages(merge_frozen(base, given), corrected.select("page_id", "ord", "id", "region_type", *box, "source", "text"))
    base = settle(merge_frozen(base, given), "groups-base")
    links = settle(link_reciprocal(corrected, base, large=large).select("page_id", F.col("l_ord").alias("c_ord"), F.col("r_ord").alias("ord")), "groups-links")
    read = corrected.select("page_id", F.col("ord").alias("c_ord"), F.col("text").alias("c_text"), F.col("source").alias("c_source"))
    linked = base.join(links.join(read, ["page_id", "c_ord"]), ["page_id", "ord"], "left")
    source = F.coalesce("human_source", F.when(F.col("c_text").isNotNull(), F.col("c_source")))
    linked = linked.withColumn("human_source", source).withColumn("human_text", F.coalesce("human_text", "c_text")).drop("c_ord", "c_text", "c_source")
    last = base.groupBy("page_id").agg((F.max("ord") + 1).alias("after"))
    rest = corrected.join(links.select("page_id", F.col("c_ord").alias("ord")), ["page_id", "ord"], "left_anti").join(last, "page_id", "left")
    rest = rest.select("page_id", (F.coalesce("after", F.lit(0)) + F.col("ord")).alias("ord"), "id", "region_type", *box, F.col("source").alias("region_source"), F.col("text").alias("human_text"), F.when(F.col("text").isNotNull(), F.col("source")).alias("human_source"))
    return linked.unionByName(rest)


def _groups_of_pages(base: DataFrame, corrected: DataFrame) -> DataFrame:
    """``build_groups`` behind the merging of frozen inputs, a page in a row."""
    box = list(Box._fields)
    met, links = _linked("corrected", "base", CLOSE)
    pages = _in_pages({"base": base, "corrected": corrected}).withColumn("met", met).withColumn("links", links)

    def read(b: Column) -> Column:
        c = F.get(F.filter("links", lambda p: p["b"]["ord"] == b["ord"]), F.lit(0))["a"]
        source = F.coalesce(b["human_source"], F.when(c["text"].isNotNull(), c["source"]))
        return F.struct(*(b[x].alias(x) for x in ("ord", "id", "region_type", *box, "region_source")), F.coalesce(b["human_text"], c["text"]).alias("human_text"), source.alias("human_source"))

    after = F.coalesce(F.array_max(F.transform("base", lambda b: b["ord"])) + 1, F.lit(0))
    alone = F.filter("corrected", lambda c: ~F.exists("links", lambda p: p["a"]["ord"] == c["ord"]))
    own = lambda c: F.struct((F.col("after") + c["ord"]).alias("ord"), *(c[x].alias(x) for x in ("id", "region_type", *box)), c["source"].alias("region_source"), c["text"].alias("human_text"), F.when(c["text"].isNotNull(), c["source"]).alias("human_source"))
    pages = pages.withColumn("after", after).select("page_id", F.explode(F.concat(F.transform("base", read), F.transform(alone, own))).alias("x"))
    return pages.select("page_id", "x.*")


def htr_comparisons(groups: DataFrame, results: DataFrame, machine: DataFrame, failures: DataFrame, large: int | None = None) -> dict[str, DataFrame]:
    """groups (those with a reading or failure), readings with metrics where a human text exists,
    failures, and issues.

    ``results``: page_id, path, region_id, image, model, transcription, script, language of HTR results;
    ``machine``: machine layout with text; ``failures``: page_id, path, region_id, model. ``large``: for pages of
    many regions, and for callers that need all of these."""
    if large is None:
        return _comparisons_of_pages(groups, results, machine, failures)
    groups = settle(groups, "groups")
    named = results.withColumn("region_id", F.coalesce(F.nullif("region_id", F.lit("")), region_of_crop(F.col("image"), F.col("page_id"))))
    linked, orphans = link_unique(named, groups)
    silent = linked.where("transcription is null")
    issues = orphans.select("path", F.lit("no unique region link").alias("message")).unionByName(silent.select("path", F.lit("transcription unavailable").alias("message")))
    model = linked.where("transcription is not null").select("page_id", "group_ord", system_name(F.col("model")).alias("system"), F.col("transcription").alias("text"), F.col("path").alias("source"), "script", "language")
    sources = machine.select("page_id", "source").distinct()
    per_source = machine.withColumn("page", F.col("page_id")).withColumn("page_id", F.concat_ws("\u0001", "page_id", "source"))
    spread = groups.join(sources, "page_id").withColumn("page_id", F.concat_ws("\u0001", "page_id", "source"))
    links = link_reciprocal(spread, per_source, large=large).select("page_id", F.col("l_ord").alias("group_ord"), F.col("r_ord").alias("ord"))
    layout = links.join(per_source, ["page_id", "ord"]).where("text is not null")
    layout = layout.select(F.col("page").alias("page_id"), "group_ord", F.lit("eScriptorium").alias("system"), "text", "source", F.lit(None).cast("string").alias("script"), F.lit(None).cast("string").alias("language"))
    readings = model.unionByName(layout)
    human = groups.select("page_id", F.col("ord").alias("group_ord"), "human_text")
    readings = readings.join(human, ["page_id", "group_ord"]).withColumn("metrics", F.when(F.col("human_text").isNotNull(), htr_metrics(F.col("human_text"), F.col("text"))))
    order = Window.partitionBy("page_id", "group_ord").orderBy(system_rank(F.col("system")), "source")
    readings = settle(readings.drop("human_text").withColumn("reading_ord", F.row_number().over(order) - 1), "readings")
    failed, _ = link_unique(failures, groups)
    failed = open_failures(failed.select("page_id", "group_ord", system_name(F.col("model")).alias("system"), F.col("path").alias("source")), readings)
    used = readings.select("page_id", F.col("group_ord").alias("ord")).unionByName(failed.select("page_id", F.col("group_ord").alias("ord"))).distinct()
    return {"groups": groups.join(used, ["page_id", "ord"], "left_semi"), "readings": readings, "failures": failed, "issues": issues}


def _comparisons_of_pages(groups: DataFrame, results: DataFrame, machine: DataFrame, failures: DataFrame) -> dict[str, DataFrame]:
    """``htr_comparisons`` with a page in a row; nothing is written, each result is made anew where it is read."""
    none = F.lit(None).cast("string")
    box = list(Box._fields)
    named = results.select("page_id", "path", F.coalesce(F.nullif("region_id", F.lit("")), region_of_crop(F.col("image"), F.col("page_id"))).alias("region_id"), "model", "transcription", "script", "language")
    met, links = _linked("machine", "groups", CLOSE, lambda z, a: z["source"].eqNullSafe(a["source"]))
    sides = {"groups": groups, "results": named, "machine": machine.select("page_id", "ord", "id", *box, "source", "text"), "failures": failures.select("page_id", "path", "region_id", "model")}
    pages = _in_pages(sides).withColumn("met", met).withColumn("links", F.filter(links, lambda p: p["a"]["text"].isNotNull()))

    def group_of(r: Column) -> Column:
        same = F.filter("groups", lambda g: g["id"] == r["region_id"])
        return F.when(F.size(same) == 1, F.get(same, F.lit(0))["ord"])

    reading = lambda place, system, text, source, script, language: F.struct(place.alias("group_ord"), system.alias("system"), text.alias("text"), source.alias("source"), script.alias("script"), language.alias("language"))
    by_model = F.filter(F.transform("results", lambda r: reading(group_of(r), system_name(r["model"]), r["transcription"], r["path"], r["script"], r["language"])), lambda x: x["group_ord"].isNotNull() & x["text"].isNotNull())
    by_layout = F.transform("links", lambda p: reading(p["b"]["ord"], F.lit("eScriptorium"), p["a"]["text"], p["a"]["source"], none, none))
    pages = pages.withColumn("said", F.concat(by_model, by_layout))
    failed = lambda said: F.filter(F.transform("failures", lambda f: F.struct(group_of(f).alias("group_ord"), system_name(f["model"]).alias("system"), f["path"].alias("source"))), lambda x: x["group_ord"].isNotNull() & ~F.exists(said, lambda y: (y["group_ord"] == x["group_ord"]) & F.coalesce(y["system"] == x["system"], F.lit(False))))
    human = lambda x: F.get(F.filter("groups", lambda g: g["ord"] == x["group_ord"]), F.lit(0))["human_text"]
    readings = pages.select("page_id", F.explode(F.transform("said", lambda x: F.struct(x.alias("said"), human(x).alias("human_text")))).alias("x")).select("page_id", "x.said.*", "x.human_text")
    readings = readings.withColumn("metrics", F.when(F.col("human_text").isNotNull(), htr_metrics(F.col("human_text"), F.col("text"))))
    order = Window.partitionBy("page_id", "group_ord").orderBy(system_rank(F.col("system")), "source")
    readings = readings.drop("human_text").withColumn("reading_ord", F.row_number().over(order) - 1)
    pages = pages.withColumn("failed", _with(F.col("said"), failed))
    used = F.filter("groups", lambda g: F.exists("said", lambda x: x["group_ord"] == g["ord"]) | F.exists("failed", lambda x: x["group_ord"] == g["ord"]))
    issue = lambda r: F.when(group_of(r).isNull(), F.struct(r["path"].alias("path"), F.lit("no unique region link").alias("message"))).when(r["transcription"].isNull(), F.struct(r["path"].alias("path"), F.lit("transcription unavailable").alias("message")))
    return {
        "groups": pages.select("page_id", F.explode(used).alias("x")).select("page_id", "x.*"),
        "readings": readings,
        "failures": pages.select("page_id", F.explode("failed").alias("x")).select("page_id", "x.*"),
        "issues": pages.select(F.explode(F.filter(F.transform("results", issue), lambda x: x.isNotNull())).alias("x")).select("x.*"),
    }
