import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import batch, disagreements, linkage, matching, metrics, overview

REGION = "page_id string, ord int, region_type string, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows):
    return spark.createDataFrame([(p, o, t, *map(float, b)) for p, o, t, b in rows], REGION)


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def plain_greedy(t, p, same_type):
    pairs = sorted(((plain_iou(a[3], b[3]), a[1], b[1]) for a in t for b in p if not same_type or a[2] == b[2]), reverse=True)
    out, ts, ps = set(), set(), set()
    for v, i, j in pairs:
        if v >= 0.5 and i not in ts and j not in ps:
            out.add((i, j))
            ts.add(i)
            ps.add(j)
    return out


def random_pages(seed, pages=60):
    r = random.Random(seed)
    rows = [[], []]
    for page in range(pages):
        for side in rows:
            for o in range(r.randint(0, 7)):
                x, y = r.randint(0, 3), r.randint(0, 3)
                side.append((f"p{page}", o, r.choice("ab"), (x, y, x + r.randint(3, 5), y + r.randint(3, 5))))
    return rows


@pytest.mark.parametrize("same_type", [True, False])
def test_matching_with_many_ties(spark, same_type):
    t, p = random_pages(1 + same_type)
    truth, predictions = boxes(spark, t), boxes(spark, p)
    found = matching.match_regions(truth, predictions, 0.5, same_type)
    got = {(r["page_id"], r["t_ord"], r["p_ord"]) for r in found.collect()}
    want = {(page, *m) for page in {x[0] for x in t} for m in plain_greedy([x for x in t if x[0] == page], [x for x in p if x[0] == page], same_type)}
    assert got == want
    rounds = matching.greedy_rounds(matching.iou_candidates(truth, predictions, 0.5, same_type))
    assert {(r["page_id"], r["t_ord"], r["p_ord"]) for r in rounds.collect()} == want
    assert matching.unmatched(truth, found, "t").count() == len(t) - len(want)


def test_the_later_of_equal_truths_matches(spark):
    b = (0, 0, 9, 9)
    found = matching.match_regions(boxes(spark, [("p", 0, "a", b), ("p", 1, "a", b)]), boxes(spark, [("p", 0, "a", b)]))
    assert [(r["t_ord"], r["p_ord"]) for r in found.collect()] == [(1, 0)]


def test_threshold_zero_pairs_what_does_not_touch(spark):
    pairs = matching.iou_candidates(boxes(spark, [("p", 0, "a", (0, 0, 1, 1))]), boxes(spark, [("p", 0, "a", (5, 5, 6, 6))]), 0.0)
    assert [r["iou"] for r in pairs.collect()] == [0.0]


def test_two_zero_policies(spark):
    truth, nothing = boxes(spark, [("p", 0, "a", (0, 0, 9, 9)), ("q", 0, "a", (0, 0, 9, 9))]), boxes(spark, [])
    m = metrics.detection_metrics(truth, nothing).first()
    assert (m["tp"], m["fn"], m["precision"], m["recall"], m["f1"]) == (0, 1, 0.0, 0.0, 0.0)
    pooled = metrics.pooled_metrics(metrics.metrics_by_type(truth, nothing).withColumn("run", F.lit("r"))).first()
    assert pooled["precision"] is None and pooled["recall"] == 0.0 and pooled["f1"] == 0.0
    half = metrics.pooled_metrics(metrics.metrics_by_type(truth, truth.where("page_id = 'p'")).withColumn("run", F.lit("r"))).first()
    assert (half["precision"], half["recall"], half["f1"]) == (1.0, 0.5, pytest.approx(2 / 3))
    assert metrics.pooled_metrics(metrics.metrics_by_type(truth, truth).withColumn("run", F.lit("r")), 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        metrics.pooled_metrics(truth, 0)
    assert metrics.classification_accuracy(matching.match_regions(truth, nothing)).first()["accuracy"] == 0.0


def systems_of(spark, layout):
    """layout: (system, reviewed, [(type, box), ...]) in page order."""
    rows = [("p", i, s, rev, o, f"{s}-{o}", t, *map(float, b)) for i, (s, rev, regions) in enumerate(layout) for o, (t, b) in enumerate(regions)]
    regions = spark.createDataFrame(rows, "page_id string, sys_ord int, system string, reviewed boolean, ord int, id string, region_type string, x1 double, y1 double, x2 double, y2 double")
    systems = spark.createDataFrame([("p", i, s, rev) for i, (s, rev, _) in enumerate(layout)], "page_id string, sys_ord int, system string, reviewed boolean")
    return regions, systems


BIG, SMALL = (100, 100, 600, 600), (700, 700, 800, 800)


def test_three_systems(spark):
    regions, systems = systems_of(spark, [("A", False, [("main_text", BIG)]), ("B", False, [("stamp_or_seal", BIG), ("unknown", SMALL)]), ("C", False, [("illustration", BIG)])])
    ranked = disagreements.disagreements(regions, systems)
    kinds = [r["kind"] for r in ranked.orderBy("rank").collect()]
    assert kinds == ["different_types"] * 3 + ["unmatched"] * 2
    assert disagreements.select_varied(ranked).count() == 2
    assert disagreements.select_varied(ranked, limit=1).count() == 1 and disagreements.select_varied(ranked, limit=0).count() == 0
    with pytest.raises(ValueError, match="negative"):
        disagreements.select_varied(ranked, limit=-1)
    assert disagreements.observations(ranked, regions, systems).count() == 15


def test_references_make_no_rows_and_are_shown(spark):
    regions, systems = systems_of(spark, [("A", False, [("main_text", BIG)]), ("B", False, []), ("H", True, [("main_text", BIG)])])
    ranked = disagreements.disagreements(regions, systems)
    assert [r["kind"] for r in ranked.collect()] == ["unmatched"]
    seen = {r["system"]: r for r in disagreements.observations(ranked, regions, systems).collect()}
    assert (seen["A"]["relationship"], seen["B"]["relationship"], seen["H"]["relationship"]) == ("in_pair", "no_counterpart", "overlapping")
    assert seen["B"]["overlap"] == 0.0 and seen["H"]["region_id"] == "H-0"


def test_a_small_box_inside_a_page_stays_unmatched(spark):
    regions, systems = systems_of(spark, [("A", False, [("main_text", (0, 0, 1000, 1000))]), ("B", False, [("main_text", (0, 0, 100, 100))])])
    ranked = disagreements.disagreements(regions, systems)
    assert ranked.count() == 2
    seen = [r for r in disagreements.observations(ranked, regions, systems).collect() if r["relationship"] == "no_counterpart"]
    assert [r["nearby_id"] for r in sorted(seen, key=lambda r: r["rank"])] == ["B-0", "A-0"]


GROUP = "page_id string, ord int, id string, region_type string, x1 double, y1 double, x2 double, y2 double, source string, text string, review_status string, transcription string"


def group_rows(spark, rows):
    return spark.createDataFrame([(p, o, i, "main_text", *map(float, b), s, t, rs, tr) for p, o, i, b, s, t, rs, tr in rows], GROUP)


def test_links(spark):
    a = group_rows(spark, [("p", 0, "x", BIG, "s", None, None, None), ("p", 1, "y", SMALL, "s", None, None, None), ("p", 2, "z", SMALL, "s", None, None, None)])
    b = group_rows(spark, [("p", 0, "x", SMALL, "t", None, None, None), ("p", 1, "q", BIG, "t", None, None, None)])
    assert sorted(map(tuple, linkage.link_equivalent(a, b).collect())) == [("p", 0, 0), ("p", 1, 0), ("p", 2, 0)]  # by id first, then by place
    assert sorted(map(tuple, linkage.link_reciprocal(a, b).collect())) == [("p", 0, 0)]


def test_comparisons(spark):
    none = group_rows(spark, [])
    annotated = group_rows(spark, [("p", 0, "r1", BIG, "gt", None, "human_corrected", "سلام"), ("p", 1, "r2", SMALL, "gt", None, None, "not reviewed")])
    frozen = group_rows(spark, [("p", 0, "r1", BIG, "in", None, None, None), ("p", 1, "r3", (1, 1, 9, 9), "in", None, None, None), ("p", 2, "r3", (2, 2, 9, 9), "in", None, None, None)])
    corrected = group_rows(spark, [("p", 0, "r3", (1, 1, 9, 9), "gt/alto", "a b", None, None)])
    groups = linkage.build_groups(annotated, frozen, corrected)
    assert [(r["id"], r["human_text"]) for r in groups.orderBy("ord").collect()] == [("r1", "سلام"), ("r2", None), ("r3", "a b")]
    results = spark.createDataFrame(
        [("p", "1", "r1", None, "qwen3-vl-8b-instruct-mlx", "سَلام", None, None), ("p", "2", "", "crops/p/r3.png", "m", "", None, None), ("p", "3", "gone", None, "m", "x", None, None), ("p", "4", "r2", None, "m", None, None, None), ("p", "5", "r2", None, "n", "t", None, None)],
        "page_id string, path string, region_id string, image string, model string, transcription string, script string, language string",
    )
    failures = spark.createDataFrame([("p", "e1", "r1", "qwen3-vl-8b-instruct-mlx"), ("p", "e2", "r3", "other"), ("p", "e3", "gone", "m")], "page_id string, path string, region_id string, model string")
    machine = group_rows(spark, [("p", 0, "m1", BIG, "alto/p.xml", "سلام", None, None)])
    out = linkage.htr_comparisons(groups, results, machine, failures)
    read = {r["source"]: r for r in out["readings"].collect()}
    assert sorted(read) == ["1", "2", "5", "alto/p.xml"]
    assert read["1"]["metrics"]["char_errors"] == 1 and read["alto/p.xml"]["metrics"]["cer"] == 0.0
    assert read["2"]["metrics"]["cer"] == 1.0  # an empty reading is one
    assert read["5"]["metrics"] is None  # no reviewed text, no metrics
    assert sorted(r["path"] for r in out["issues"].collect()) == ["3", "4"]
    assert [(r["group_ord"], r["system"]) for r in out["failures"].collect()] == [(3, "other")]
    assert out["groups"].count() == 3
    assert linkage.htr_comparisons(linkage.build_groups(none, frozen, none), results, machine, failures)["readings"].where("metrics is not null").count() == 0


def test_overview(spark):
    manifest = spark.createDataFrame([("a", "m1", True), ("b", "m1", True), ("c", "  ", True), ("x", "m9", True)], "page_id string, manuscript_id string, layout_review_complete boolean")
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "page_id string")
    m = overview.manuscript_count(manifest, pages).first()
    assert (m["manuscripts"], m["mapped_pages"], m["mapping_complete"]) == (1, 2, False)
    assert overview.manuscript_count(manifest.limit(0), pages).first()["manuscripts"] is None
    systems = spark.createDataFrame(
        [("a", "S", "a1", "v1", False, 0), ("a", "H", "ha", None, True, 0), ("b", "S", "b1", "v1", False, 0), ("b", "S", "b2", "v1", False, 0), ("b", "H", "hb", None, True, 0), ("c", "S", "c1", "v1", False, 0), ("c", "H", "hc", None, True, 1)],
        "page_id string, system string, source string, prompt_version string, reviewed boolean, skipped_blocks int",
    )
    regions = spark.createDataFrame([("a", s, 0, "main_text", 0.0, 0.0, 9.0, 9.0) for s in ("a1", "ha")] + [("a", "ha", 1, "unknown", 0.0, 0.0, 9.0, 9.0)], "page_id string, source string, ord int, region_type string, x1 double, y1 double, x2 double, y2 double")
    counts = overview.run_counts(systems, regions).first()
    assert (counts["run"], counts["pages"], counts["records"], counts["regions"]) == ("S · v1", 3, 4, 1)
    out = overview.evaluations(systems, regions, manifest, 1)
    assert out["ambiguous"].first()[0] == 1 and [tuple(r) for r in out["eligible"].collect()] == [("S · v1", 1)]
    by = {r["region_type"]: r for r in out["evaluations"].collect()}
    assert (by["main_text"]["f1"], by["unknown"]["precision"], by["unknown"]["recall"]) == (1.0, None, 0.0)
    assert overview.evaluations(systems, regions, manifest, 2)["evaluations"].count() == 0
    artifacts = spark.createDataFrame([("a", "eScriptorium", "prediction"), ("a", "eScriptorium", "prediction"), ("b", "eScriptorium", "reference"), ("b", "z", "prediction")], "page_id string, origin string, role string")
    assert {r["system"]: r["pages"] for r in overview.coverage(artifacts, spark).collect()} == {"eScriptorium": 1, "Qwen3-VL 8B": 0, "Qwen3-VL 30B": 0}


def make_client():
    """A function of its own for the executors, which don't import the tests."""

    def client(job):
        return reply(job["region_id"])

    def reply(region):
        if region == "bad":
            return {"content": "no json", "finish_reason": "stop"}
        if region == "cut":
            return {"content": '{"transcription": "x"}', "finish_reason": "length"}
        if region == "down":
            raise OSError("no connection")
        return {"content": '```json\n{"transcription": "read", "script": 3}\n```', "finish_reason": "stop", "elapsed_seconds": 0.5}

    return client


def test_batches_resume(spark):
    jobs = spark.createDataFrame([("p", r, "m", "v1", "read", "sha") for r in ("ok", "bad", "cut", "down")], "page_id string, region_id string, model string, prompt_version string, prompt string, image_sha256 string")
    done = jobs.limit(0).withColumn("transcription", F.lit("x"))
    todo, conflicts = batch.pending(jobs, done)
    out = {r["region_id"]: r for r in batch.run_batch(todo, make_client()).collect()}
    assert conflicts.isEmpty() and [out[k]["ok"] for k in ("ok", "bad", "cut", "down")] == [True, False, False, False]
    assert out["ok"]["script"] is None and out["bad"]["raw_content"] == "no json" and out["cut"]["finish_reason"] == "length" and "no connection" in out["down"]["error"]
    finished = batch.run_batch(todo, make_client()).where("ok").select("page_id", "region_id", "model", "prompt_version", "prompt", "image_sha256", "transcription")
    assert sorted(r["region_id"] for r in batch.pending(jobs, finished)[0].collect()) == ["bad", "cut", "down"]
    other = finished.withColumn("prompt", F.lit("other"))
    assert batch.pending(jobs, other)[1].count() == 1


def test_region_sources_in_order(spark):
    ddl = "page_id string, ord int, id string, region_type string, x1 double, y1 double, x2 double, y2 double, region_source string"
    rows = lambda pages, name, kind="main_text": spark.createDataFrame([(p, 0, name, kind, 0.0, 0.0, 1.0, 1.0, name) for p in pages], ddl)
    images = spark.createDataFrame([(p,) for p in "abcde"], "page_id string")
    found = batch.plan_regions(images, rows("a", "frozen", "illustration"), rows("abz", "annotated"), rows("abc", "layout").unionByName(rows("d", "layout", "illustration")))
    assert sorted((r["page_id"], r["id"]) for r in found.collect()) == [("a", "frozen"), ("b", "annotated"), ("c", "layout"), ("e", "whole-page")]


def spread_boxes(seed, n, width):
    """Boxes of many sizes over a wide page, ties and touching edges included."""
    r = random.Random(seed)
    out = []
    for o in range(n):
        x, y = r.randint(0, width), r.randint(0, 60)
        w, h = (r.randint(1, 8), r.randint(1, 8)) if o % 40 else (r.randint(1, width), 40)
        out.append(("big", o, r.choice("ab"), (x, y, x + w, y + h)))
    return out


def test_a_grid_gives_the_same_pairs(spark):
    t, p = spread_boxes(3, 700, 400) + random_pages(5, 20)[0], spread_boxes(4, 600, 400) + random_pages(5, 20)[1]
    truth, predictions = boxes(spark, t), boxes(spark, p)
    for threshold, same in ((0.5, False), (0.05, True)):
        rows = lambda large: sorted(tuple(r) for r in matching.iou_candidates(truth, predictions, threshold, same, large=large).collect())  # noqa: E731, B023
        assert rows(None) == rows(100) == rows(1) and len(rows(None)) > 50
    fold = matching.match_regions(truth, predictions, 0.2)
    assert sorted(map(tuple, fold.collect())) == sorted(map(tuple, matching.match_regions(truth, predictions, 0.2, large=100, many=50).select(*fold.columns).collect()))
    named = lambda df: df.withColumn("id", F.concat(F.lit("r"), F.col("ord") % 400))
    for close in (0.4, 0.95):
        links = [sorted(map(tuple, linkage.link_reciprocal(named(truth), named(predictions), close, large).collect())) for large in (None, 50)]
        assert links[0] == links[1]
    anchors = truth.select("page_id", F.col("ord").alias("anchor"), "x1", "y1", "x2", "y2")
    systems = predictions.withColumn("id", F.col("ord").cast("string")).withColumn("system", F.concat(F.lit("s"), F.col("ord") % 3)).unionByName(predictions.select("page_id").distinct().withColumn("system", F.lit("none")), allowMissingColumns=True)
    found = [sorted(map(tuple, matching.best_overlaps(anchors, systems, ("anchor",), large=large).collect())) for large in (None, 50)]
    plain = {}
    for a in t:
        for s in ("s0", "s1", "s2", "none"):
            mine = [b for b in p if b[0] == a[0] and f"s{b[1] % 3}" == s]
            best = max(mine, key=lambda b: (plain_iou(a[3], b[3]), -b[1]), default=None)
            if any(b[0] == a[0] for b in p) and (best or s == "none"):
                plain[a[0], a[1], s] = str(best[1]) if best else None
    assert found[0] == found[1] and {(r[0], r[1], r[2]): r[5] for r in found[0]} == plain


def test_rounds_select_as_the_fold_does(spark):
    r, rows = random.Random(6), []
    for page, n in (("big", 3000), ("small", 30), ("one", 1)):
        for rank in range(1, n + 1):
            x, y = (0, 0) if rank % 3 else (r.randint(0, 90), r.randint(0, 90))
            rows.append((page, rank, f"k{rank % 2}", float(x), float(y), float(x + r.randint(5, 9)), float(y + r.randint(5, 9))))
    ranked = spark.createDataFrame(rows, "page_id string, rank long, kind string, x1 double, y1 double, x2 double, y2 double")
    for limit in (0, 1, 4, 7):
        some = [sorted(map(tuple, disagreements.select_varied(ranked, limit, large=large).collect())) for large in (None, 100, 1)]
        assert some[0] == some[1] == some[2] and len(some[0]) == (2 * limit + min(limit, 1))


def test_disagreements_of_a_page_in_one_row(spark):
    """The way by whole pages gives the rows of the way by joins, and shuffles each page's regions once."""
    from folioscope.plans import queries

    rng = random.Random(3)
    names = [("one", False), ("two", False), ("three", False), ("checked", True)]
    boxes, systems = [], []
    for page in ("p", "q", "r"):
        for place, (name, reviewed) in enumerate(names):
            systems.append((page, name, place, reviewed))
            for i in range(0 if page == "q" and place == 1 else 12):
                x, y = rng.randrange(0, 60, 5), rng.randrange(0, 60, 5)
                boxes.append((page, name, place, reviewed, i, f"r{i}", rng.choice("ab"), x, y, x + rng.randrange(10, 40, 5), y + rng.randrange(10, 40, 5)))
    regions = spark.createDataFrame(boxes, "page_id string, system string, sys_ord int, reviewed boolean, ord long, id string, region_type string, x1 long, y1 long, x2 long, y2 long")
    have = spark.createDataFrame(systems, "page_id string, system string, sys_ord int, reviewed boolean")
    ways = []
    for large in (None, 1000):
        ranked = disagreements.disagreements(regions, have, 0.3, large)
        seen = disagreements.observations(ranked, regions, have, 0.3, large)
        carried = disagreements.observations(ranked, regions, have, 0.3, large, carry=("l_name", "r_name", "kind", "x1", "y1", "x2", "y2"))
        short = ranked.select("page_id", "rank", "l_name", "r_name", "kind", "x1", "y1", "x2", "y2")
        ids = [sorted((r["page_id"], r["rank"], r["identifier"]) for r in disagreements.identified(short, s).collect()) for s in (seen, carried)]
        assert ids[0] == ids[1]
        ways.append([sorted(map(repr, map(tuple, df.collect()))) for df in (ranked, seen)] + [ids[0]])
    assert ways[0] == ways[1] and len(ways[0][0]) > 20
    for name in ("disagreements_ranked", "observations", "disagreement_ids"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == plan.count("Exchange hashpartitioning(page_id") and "observed-" not in plan, name


def test_groups_and_readings_of_a_page_in_one_row_are_those_of_joins(spark):
    import random

    r = random.Random(11)

    def rows(source, n, more):
        out = []
        for page in "pqr":
            for ord_ in range(r.randint(0, n)):
                x, y = r.choice((0, 1, 50)), r.choice((0, 1, 60))
                out.append((page, ord_, r.choice(("a", "b", "c", "d", None)), "main_text", float(x), float(y), float(x + 40), float(y + 40), source, *more(ord_)))
        return out

    frame = "page_id string, ord long, id string, region_type string, x1 double, y1 double, x2 double, y2 double, source string"
    for _ in range(3):
        annotated = spark.createDataFrame(rows("drawn", 4, lambda o: ("human_corrected" if o % 2 else None, "said" if o % 3 else None)), frame + ", review_status string, transcription string")
        frozen = spark.createDataFrame(rows("frozen", 5, lambda o: ()), frame)
        corrected = spark.createDataFrame(rows("corrected", 5, lambda o: ("text" if o % 3 else None,)), frame + ", text string")
        machine = spark.createDataFrame(rows("m1", 4, lambda o: ("read",)) + rows("m2", 4, lambda o: (None if o == 1 else "red",)), frame + ", text string")
        results = spark.createDataFrame([(p, f"results/{p}/{i}", r.choice(("a", "b", "c", "z", None)), None, "m", r.choice(("sad", None)), None, None) for p in "pqrs" for i in range(5)], "page_id string, path string, region_id string, image string, model string, transcription string, script string, language string")
        failures = spark.createDataFrame([(p, f"errors/{p}/{i}", r.choice(("a", "b", "c", "z", None)), "m") for p in "pqrs" for i in range(5)], "page_id string, path string, region_id string, model string")
        groups = [linkage.build_groups(annotated, frozen, corrected, large) for large in (None, 1)]
        order = lambda df: sorted((tuple(x) for x in df.select(*sorted(df.columns)).collect()), key=repr)
        assert order(groups[0]) == order(groups[1])
        small, large = (linkage.htr_comparisons(g, results, machine, failures, n) for g, n in zip(groups, (None, 1), strict=True))
        for name in ("groups", "readings", "failures", "issues"):
            assert order(small[name]) == order(large[name]), name


def test_grid_of_a_long_narrow_page_has_few_boxes_in_a_cell(spark, monkeypatch):
    seen, cells = [], matching._cells
    monkeypatch.setattr(matching, "_cells", lambda *a: seen.append(cells(*a)) or seen[-1])
    strip = lambda s: spark.range(2000).select(F.lit("p").alias("page_id"), F.col("id").alias(f"{s}ord"), *(F.expr(e).alias(f"{s}{c}") for c, e in zip(("x1", "y1", "x2", "y2"), ("id * 1000", "0", "id * 1000 + 300", "100"), strict=True)))
    assert matching.overlap_join(strip("t_"), strip("p_"), large=500).count() == 2000
    assert max(r["count"] for r in seen[0].groupBy("cx", "cy").count().collect()) <= 4
