"""Operators against brute force on small random or literal inputs."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from martloom.config import ScaleRules
from martloom.operators import joins, quarantine, ranking
from martloom.operators.pairs import pair_counts
from martloom import session
from martloom.operators.ranking import ntile_of, percent_ranks, quantile_bin_of, row_positions
from martloom.operators.timeseries import calendar_spine, if_full, next_value_if, trailing

SPREAD = ScaleRules(one_task_rows=0, small_basket=3, block_items=3)


@pytest.mark.parametrize("scale", [ScaleRules(), SPREAD])
def test_percent_ranks_equal_the_window(spark, scale):
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 9), rng.choice([0.0, None, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a int, b double")
    got = percent_ranks(df, {"ra": "a", "rb": "b"}, ["id"], scale)
    want = df.select(
        "id",
        F.percent_rank().over(Window.orderBy("a")).alias("ra"),
        F.percent_rank().over(Window.orderBy("b")).alias("rb"),
    )
    assert got.select("id", "ra", "rb").exceptAll(want).count() == 0
    assert got.count() == 500


@pytest.mark.parametrize("n", [0, 1, 4, 5, 23])
def test_ntile_equals_the_window(spark, n):
    df = spark.range(n).withColumn("v", F.col("id") % 3)
    placed, rows = row_positions(df, {"up": ("v", True), "down": ("v", False)}, "id", SPREAD)
    assert rows == n
    got = placed.select("id", ntile_of("up", n, 5).alias("u"), ntile_of("down", n, 5).alias("d"))
    want = df.select(
        "id",
        F.ntile(5).over(Window.orderBy("v", "id")).alias("u"),
        F.ntile(5).over(Window.orderBy(F.desc("v"), "id")).alias("d"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quantile_bins_of_positions(spark):
    df = spark.range(1, 11).select(F.col("id").alias("p"))
    assert [r[0] for r in df.select(quantile_bin_of("p", 10, 5)).collect()] == [
        1, 1, 2, 2, 3, 3, 4, 4, 5, 5,
    ]


@pytest.mark.parametrize("threshold", [1, 3, 6])
@pytest.mark.parametrize("scale", [ScaleRules(), SPREAD, ScaleRules(small_basket=5, block_items=7)])
def test_pairs_equal_brute_force(spark, scale, threshold):
    rng = random.Random(3)
    groups = {g: rng.sample(range(30), rng.randint(1, 6)) for g in range(60)}
    groups[99] = list(range(30))
    groups[98] = list(range(5, 30))
    members = [(g, i) for g, items in groups.items() for i in items]
    df = spark.createDataFrame(members, "g int, item int")
    pairs, per_item, total = pair_counts(df, "g", "item", threshold, scale)
    kept = {g: items for g, items in groups.items() if len(items) >= 2}
    counted = Counter(p for items in kept.values() for p in combinations(sorted(items), 2))
    want = {p: n for p, n in counted.items() if n >= threshold}
    assert {(a, b): n for a, b, n in map(tuple, pairs.collect())} == want
    singles = Counter(i for items in kept.values() for i in items)
    assert dict(map(tuple, per_item.collect())) == dict(singles)
    assert total.first()["groups"] == len(kept)


def moment(day: int) -> dt.datetime:
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=day)


def test_as_of_equals_brute_force(spark):
    rng = random.Random(11)
    versions = []
    for key in range(4):
        for n in range(8):
            start = rng.randint(0, 200)
            end = None if rng.random() < 0.1 else moment(start + rng.randint(1, 60))
            versions.append((key * 100 + n, key, moment(start), end, float(n)))
    facts = [(i, rng.randint(0, 4), moment(rng.randint(0, 260))) for i in range(400)]
    v = spark.createDataFrame(versions, "vid int, k int, start timestamp, end timestamp, price double")
    f = spark.createDataFrame(facts, "id int, k int, at timestamp")
    got = joins.as_of(
        f, v, key="k", at="at", start="start", end="end", order_id="vid", values={"price": "price"}
    )

    def expected(key, at):
        mine = sorted((x for x in versions if x[1] == key), key=lambda x: (x[2], x[0]))
        for _, _, start, end, price in mine:
            if start <= at and (end is None or end > at):
                return price
        return mine[-1][4] if mine else None

    rows = got.collect()
    assert len(rows) == 400
    assert {r["id"]: r["price"] for r in rows} == {i: expected(k, at) for i, k, at in facts}


def test_promotion_match_equals_brute_force(spark):
    rng = random.Random(5)
    kinds = ["Fixed Amount", "Percentage", "Buy One Get One"]
    promos = []
    for pid in range(12):
        start = dt.date(2025, 1, 1) + dt.timedelta(days=rng.randint(0, 20))
        item, channel = (rng.randint(0, 3), None) if pid % 2 else (None, rng.choice("ab"))
        promos.append(
            (pid, kinds[pid % 3], float(rng.randint(1, 20)), start,
             start + dt.timedelta(days=rng.randint(0, 10)), item, channel)
        )
    lines = [
        (i, rng.randint(0, 3), rng.choice("abc"), rng.randint(1, 4), rng.randint(100, 999) / 100,
         moment(rng.randint(0, 35)))
        for i in range(300)
    ]
    p = spark.createDataFrame(
        promos,
        "source_promotion_id int, discount_type string, discount_value double, start_date date, "
        "end_date date, source_menu_item_id int, applicable_channel string",
    )
    f = spark.createDataFrame(
        lines,
        "id int, source_menu_item_id int, order_channel string, quantity int, unit_price double, "
        "at timestamp",
    )
    got = {r["id"]: r for r in joins.match_promotion(f, p, date="at").collect()}
    assert len(got) == 300
    for i, item, channel, qty, price, at in lines:
        hit = next(
            (x for x in promos if x[3] <= at.date() <= x[4] and (x[5] == item or x[6] == channel)),
            None,
        )
        assert got[i]["source_promotion_id"] == (hit[0] if hit else None)
        if hit is None or hit[1] == "Buy One Get One":
            assert got[i]["line_discount"] == 0.0
        elif hit[1] == "Fixed Amount":
            assert got[i]["line_discount"] == pytest.approx(min(hit[2], price * qty), abs=1e-9)
        else:
            assert got[i]["line_discount"] == pytest.approx(price * qty * hit[2] / 100, abs=0.0051)


def test_event_windows_equal_brute_force(spark):
    rng = random.Random(2)
    sales = [
        (rng.randint(0, 2), rng.randint(0, 2), moment(rng.randint(0, 150)), rng.randint(1, 5),
         rng.randint(100, 500) / 100, rng.choice([None, 1]))
        for _ in range(800)
    ]
    events = [
        (e, rng.randint(0, 2), rng.choice([None, 0, 1, 2]), moment(rng.randint(0, 150)).date())
        for e in range(25)
    ]
    s = spark.createDataFrame(
        sales,
        "source_menu_item_id int, source_restaurant_id int, order_timestamp timestamp, quantity int, "
        "unit_price_at_sale double, source_promotion_id int",
    )
    ev = spark.createDataFrame(
        events,
        "source_pricing_history_id int, source_menu_item_id int, source_restaurant_id int, event_day date",
    )
    got = {
        r["source_pricing_history_id"]: r
        for r in joins.event_window_sales(ev, s, pre_days=28, post_days=28).collect()
    }
    for e, item, branch, day in events:
        near = [
            x for x in sales
            if x[0] == item and (branch is None or x[1] == branch)
            and -28 <= (x[2].date() - day).days <= 27
        ]
        if not near:
            assert e not in got
            continue
        before = [x for x in near if x[2].date() < day]
        after = [x for x in near if x[2].date() >= day]
        r = got[e]
        assert r["pre_quantity"] == sum(x[3] for x in before)
        assert r["post_quantity"] == sum(x[3] for x in after)
        assert r["pre_cents"] == sum(round(x[4] * 100) for x in before)
        assert r["post_lines"] == len(after)
        assert r["promoted_lines"] == sum(x[5] is not None for x in near)


def test_split_equals_a_row_loop(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 40), rng.randint(0, 6), rng.choice([-1, 1, 1, 1])) for _ in range(200)]
    rows += [(50, 1, 1)] * 5 + [(51, 0, -1)] * 3
    df = spark.createDataFrame(rows, "id int, at int, price int")
    out = quarantine.split(
        df,
        [quarantine.Rule("NEGATIVE", F.col("price") < 0)],
        quarantine.Uniqueness("id", "DUPLICATE", ["at"]),
    )
    seen, clean, bad = set(), Counter(), Counter()
    for row in sorted(rows, key=lambda r: (r[1], r)):
        if row[0] in seen:
            bad[(*row, "DUPLICATE")] += 1
        elif row[2] < 0:
            bad[(*row, "NEGATIVE")] += 1
        else:
            seen.add(row[0])
            clean[row] += 1
    assert Counter(map(tuple, out.clean.collect())) == clean
    assert Counter(map(tuple, out.quarantined.collect())) == bad


def test_split_with_parents(spark):
    df = spark.createDataFrame([(1, 10, 1), (2, 11, 5), (3, None, 1), (4, 10, 0)], "id int, parent int, n int")
    parents = spark.createDataFrame([(10,), (10,)], "pk int")
    for optional, clean in ((True, [1, 3]), (False, [1])):
        parent = quarantine.Parent("ORPHAN", "parent", parents, "pk", optional)
        out = quarantine.split(df, [quarantine.Rule("ZERO", F.col("n") <= 0), parent])
        assert sorted(r["id"] for r in out.clean.collect()) == clean
        bad = {r["id"]: r["quarantine_reason"] for r in out.quarantined.collect()}
        assert bad == {2: "ORPHAN", 4: "ZERO"} | ({} if optional else {3: "ORPHAN"})
    assert "quarantined_at" in quarantine.stamp(out.quarantined).columns


def test_calendar_ends_where_told(spark):
    day = dt.date
    rows = [("a", day(2025, 1, 1), 4), ("a", day(2025, 1, 4), 5), ("b", day(2025, 1, 3), 6), ("b", day(9999, 1, 1), 7)]
    df = spark.createDataFrame(rows, "k string, d date, n int")
    found = calendar_spine(df, ["k"], "d", ["n"], until=day(2025, 1, 31)).collect()
    assert len(found) == 4 + 2 + 1
    assert sum(r["n"] for r in found) == 22


def test_rows_without_a_key_are_copies(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (7, 1)], "id int, n int")
    out = quarantine.split(df, [], quarantine.Uniqueness("id", "DUPLICATE", ["n"]))
    assert sorted(map(tuple, out.clean.collect()), key=str) == [(7, 1), (None, 1)]
    assert [(r["n"], r["quarantine_reason"]) for r in out.quarantined.collect()] == [(2, "DUPLICATE")]


@pytest.mark.parametrize("values", [[None], [3.0], [5.0, None, 9.0], [None, None, 2.0, 2.0, None, -1.0]])
def test_rank_paths_agree_on_nulls(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")

    def ranks(rows_in_one_task):
        scale = ScaleRules(one_task_rows=rows_in_one_task)
        placed, n = ranking.row_positions(df, {"up": ("v", True), "down": ("v", False)}, "k", scale)
        assert n == len(values)
        return sorted(map(tuple, ranking.percent_ranks(placed, {"share": "v"}, ["k"], scale).select("k", "up", "down", "share").collect()))

    assert ranks(0) == ranks(100)


def test_as_of_and_promotions_leave_columns_alone(spark):
    facts = spark.createDataFrame(
        [(1, dt.datetime(2020, 5, 3), 7, "mine", 1, 9.0, "a")],
        "source_menu_item_id int, t timestamp, month int, offer string, quantity int, unit_price double, order_channel string",
    )
    versions = spark.createDataFrame(
        [(1, 1, 4.0, dt.datetime(2020, 1, 1), None)], "source_menu_item_id int, id int, price double, start timestamp, stop timestamp"
    )
    found = joins.as_of(
        facts, versions, key="source_menu_item_id", at="t", start="start", end="stop", order_id="id", values={"p": "price"}
    ).first()
    assert (found["month"], found["offer"], found["p"]) == (7, "mine", 4.0)
    day = dt.date
    offers = spark.createDataFrame(
        [
            (1, 1, None, "Percentage", 10.0, day(2020, 5, 5), day(2020, 5, 1)),
            (2, 1, None, "Percentage", 20.0, day(2020, 5, 1), day(9999, 12, 31)),
        ],
        "source_promotion_id int, source_menu_item_id int, applicable_channel string, discount_type string, "
        "discount_value double, start_date date, end_date date",
    )
    matched = joins.match_promotion(facts, offers, date="t").first()
    assert (matched["source_promotion_id"], matched["offer"], matched["month"]) == (2, "mine", 7)


def test_hot_key_join_is_split(spark):
    """A key with most of the rows is joined by several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        facts = spark.range(0, 200_000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"),
            F.xxhash64("id").alias("v"),
        )
        dims = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("name"))
        joined = joins.attach(facts, dims, "k", ["name"])
        assert joined.filter("name is null").count() == 0
        joined.write.format("noop").mode("overwrite").save()
        rows = joined.groupBy("name").count()
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_spine_and_frames(spark):
    days = [dt.date(2025, 1, d) for d in (1, 2, 4)]
    df = spark.createDataFrame([("a", days[0], 5), ("a", days[2], 7), ("b", days[1], 1)], "k string, d date, n int")
    filled = calendar_spine(df, ["k"], "d", ["n"])
    rows = sorted((r["k"], r["d"].day, r["n"]) for r in filled.collect())
    assert rows == [("a", 1, 5), ("a", 2, 0), ("a", 3, 0), ("a", 4, 7), ("b", 2, 1), ("b", 3, 0), ("b", 4, 0)]
    frame = trailing(["k"], "d", 2)
    means = filled.withColumn("m", if_full(F.avg("n").over(frame), frame, 2)).filter("k = 'a'")
    assert [r["m"] for r in means.orderBy("d").collect()] == [None, None, 2.5, 0.0]
    nxt = df.withColumn("x", next_value_if("n", "d", ["k"], 1, 0)).filter("k = 'a'")
    assert [r["x"] for r in nxt.collect()] == [0, 0]


def test_raw_waste_meets_the_latest_stock_record(spark):
    when = dt.datetime(2025, 1, 1)
    waste = spark.createDataFrame(
        [(1, "r1", None, "salt"), (2, "r1", "d1", None), (3, "r2", None, "salt")],
        "source_wastage_id int, source_restaurant_id string, source_menu_item_id string, ingredient_name string",
    )
    menu = spark.createDataFrame(
        [("d1", "c1", "Soup", 2.0, False)],
        "source_menu_item_id string, source_category_id string, item_name string, "
        "current_base_cost double, is_seasonal boolean",
    )
    stock = spark.createDataFrame(
        [("i1", "r1", "salt", "Dry Goods", 1.0, 9.0, 2.0, when),
         ("i2", "r1", "salt", "Dry Goods", 1.5, 4.0, 2.0, when + dt.timedelta(days=1))],
        "source_inventory_id string, source_restaurant_id string, ingredient_name string, "
        "ingredient_category string, unit_purchase_cost double, current_stock_quantity double, "
        "reorder_threshold double, updated_at timestamp",
    )
    dish, raw = joins.route_wastage(waste, menu, stock)
    assert [r["item_name"] for r in dish.collect()] == ["Soup"]
    got = {r["source_wastage_id"]: r["current_stock_quantity"] for r in raw.collect()}
    assert got == {1: 4.0, 3: None}


def test_frequent_values_meet_their_ranks_without_a_shuffle(spark):
    rows = [(i, float(i % 3) if i % 7 else None, i * 0.5) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, hot double, cold double")
    columns = {"rh": "hot", "rc": "cold"}
    one = percent_ranks(df, columns, ["k"])
    for bound in (0, 10, 1_000):
        spread = percent_ranks(df, columns, ["k"], ScaleRules(one_task_rows=0, broadcast_values=bound))
        assert spread.columns == one.columns
        assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, one.collect()))
        joins = spread._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
        assert joins >= {0: 0, 10: 1, 1_000: 2}[bound]


def test_rows_meet_their_ranks_in_one_shuffle(spark):
    rows = [(i % 4, i // 4 if i < 396 else None, f"n{i}", float(i * 7 % 100), (i * 31 % 400) * 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "branch int, item int, name string, a double, b double")
    columns = {"ra": "a", "rb": "b"}
    scale = ScaleRules(one_task_rows=0, broadcast_values=0)
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = percent_ranks(df, columns, ["branch", "item"], scale, ["item"])
        got = got.withColumn("best", F.max("ra").over(Window.partitionBy("item")))
        items = got.join(df.groupBy("item").count(), "item", "left")
        found = items.collect()
        # rows and ranks by item once, the counts once: no shuffle for the window or the join
        assert items._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count(" Exchange ") <= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)
    one = percent_ranks(df, columns, ["branch", "item"])
    assert got.columns == [*one.columns, "best"]
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got.drop("best").collect())) == sorted(map(key, one.collect()))
    assert len(found) == 400


def test_tasks_stay_small_however_much_data_there_is(spark):
    tuned = session.tune(spark)
    assert tuned.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
    asked = int(tuned.conf.get("spark.sql.shuffle.partitions"))
    assert int(tuned.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > asked
