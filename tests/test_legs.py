"""Sums of trades by side: nations are met before the trades, and by number."""

import datetime as dt
import threading
from collections import defaultdict

from tidebook.functions import frames
from tidebook.sources import tables


def written(spark, root):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")

    put("nation", [(1, 0), (2, 1)], "n_nationkey int, n_regionkey int")
    put("customer", [(1, 1), (2, 2), (3, None), (4, 9)], "c_custkey long, c_nationkey int")
    put("supplier", [(1, 2), (2, None), (3, 1)], "s_suppkey long, s_nationkey int")
    put("part", [(1, "Brand#1", 10.0), (2, None, 20.0)], "p_partkey long, p_brand string, p_retailprice double")
    put("orders", [(k, k) for k in range(1, 5)], "o_orderkey long, o_custkey long")
    day = dt.datetime(2000, 1, 2)
    lines = [(o, p, s, 1, float(o + p + s), 5.0, 0.5, "F", "R", day) for o in range(1, 5) for p in (1, 2) for s in (1, 2, 3)]
    lines.append((1, 1, 1, 2, None, 5.0, 0.5, "O", "N", None))
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string, l_returnflag string, l_shipdate timestamp_ntz"
    put("lineitem", lines, names)
    return lines


def test_legs_equal_a_plain_count(spark, tmp_path):
    lines = written(spark, str(tmp_path))
    region, buys, sells = {1: 0, 2: 1}, {1: 1, 2: 2, 3: None, 4: 9}, {1: 2, 2: None, 3: 1}
    want = defaultdict(lambda: [0.0, 0.0])
    for o, p, s, _, q, _, _, status, flag, day in lines:
        sides = (buys[o], sells[s])
        crosses = region[sides[0]] != region[sides[1]] if all(n in region for n in sides) else None
        for k, n in enumerate(sides):
            key = ("BRAND1" if p == 1 else None, day and day.date(), n and f"N{n}", region.get(n), status, flag, crosses)
            want[key][k] += q or 0.0
    legs = tables.trade_legs(spark, str(tmp_path))
    got = {
        (r.ticker, r.trade_date, r.participant, r.region, r.line_status, r.return_flag, r.crosses): [r.buy_volume or 0.0, r.sell_volume or 0.0]
        for r in legs.collect()
    }
    assert got == dict(want)
    # Trades are summed by numbers: no text of a participant is made or met for each of them.
    plan = legs._jdf.queryExecution().optimizedPlan().toString()
    assert "participant_buy" not in plan and "participant_sell" not in plan


def test_frames_are_staged_at_the_same_time(spark, monkeypatch):
    gate, one = threading.Barrier(2, timeout=60), frames.staged

    def met(df, name):
        gate.wait()  # fails unless both are under way
        return one(df, name)

    monkeypatch.setattr(frames, "staged", met)
    a, b = frames.staged_together({"a": spark.range(3), "b": spark.range(5)})
    assert (a.count(), b.count()) == (3, 5)
