import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.frames import frame, line
from tillroll.operators import basket, cancel
from tillroll.session import materialize


def netted(spark, rows):
    df = frame(spark, rows)
    kept = {(r.InvoiceNo, r.Quantity): r.QuantityCanceled for r in cancel.net_cancels(df).collect()}
    census = {r.status: r.n for r in cancel.cancel_census(cancel.match_cancels(df)).collect()}
    return kept, census


def test_cancel_without_earlier_order_is_removed(spark):
    kept, census = netted(spark, [line("1", day=2), line("C1", quantity=-1, day=1)])
    assert kept == {("1", 1): 0} and census == {"doubtful": 1}


def test_single_candidate_matches_whatever_its_quantity(spark):
    kept, census = netted(spark, [line("1", quantity=3), line("C1", quantity=-10, day=1)])
    assert kept == {("1", 3): 10} and census == {"matched": 1}
    cleaned = basket.with_line_value(cancel.net_cancels(
        frame(spark, [line("1", quantity=3), line("C1", quantity=-10, day=1)])))
    assert cleaned.first().TotalPrice == Decimal(-7)


def test_last_candidate_that_is_large_enough(spark):
    kept, _ = netted(spark, [line("1", quantity=8), line("2", quantity=4, day=1), line("C1", quantity=-5, day=2)])
    assert kept == {("1", 8): 5, ("2", 4): 0}


def test_no_candidate_large_enough_leaves_a_negative_line(spark):
    kept, census = netted(spark, [line("1", quantity=8), line("2", quantity=4, day=1), line("C1", quantity=-9, day=2)])
    assert kept == {("1", 8): 0, ("2", 4): 0, ("C1", -9): 0} and census == {"remaining": 1}


def test_later_cancel_overwrites_the_earlier_one(spark):
    kept, _ = netted(spark, [line("1", quantity=8), line("C1", quantity=-5, day=2), line("C2", quantity=-2, day=3)])
    assert kept == {("1", 8): 2}


def test_same_time_is_not_earlier(spark):
    _, census = netted(spark, [line("1"), line("C1", quantity=-1)])
    assert census == {"doubtful": 1}


def test_discounts_stay_and_null_descriptions_are_not_discounts(spark):
    kept, census = netted(spark, [line("1"), line("C1", text="Discount", quantity=-1, day=1),
                                  line("C2", text=None, quantity=-1, day=1)])
    assert kept == {("1", 1): 1, ("C1", -1): 0} and census == {"matched": 1}


def test_zero_quantity_counts_as_cancel(spark):
    kept, census = netted(spark, [line("1", quantity=2), line("2", quantity=3, day=1), line("3", quantity=0, day=2)])
    assert kept == {("1", 2): 0, ("2", 3): 0} and census == {"matched": 1}


def brute_force(rows):
    """The rules, line by line."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][4], rows[i][0], rows[i][1], rows[i][2] is not None,
                                                    rows[i][2] or "", rows[i][3], rows[i][5], rows[i][6], rows[i][7]))
    place = {i: p for p, i in enumerate(order)}
    cancelled, removed = {}, set()
    for i in order:
        r = rows[i]
        if r[3] > 0 or r[2] == "Discount":
            continue
        earlier = [j for j in order if rows[j][6] == r[6] and rows[j][1] == r[1] and rows[j][4] < r[4] and rows[j][3] > 0]
        if not earlier:
            removed.add(i)
        elif len(earlier) == 1:
            cancelled[earlier[0]] = -r[3]
            removed.add(i)
        else:
            fit = [j for j in earlier if rows[j][3] >= -r[3]]
            if fit:
                cancelled[max(fit, key=place.get)] = -r[3]
                removed.add(i)
    return sorted(((*rows[i], cancelled.get(i, 0)) for i in range(len(rows)) if i not in removed), key=repr)


@pytest.mark.parametrize("seed,chunk", [(1, 1), (2, 5), (3, 1000)])
def test_against_brute_force_with_a_hot_key(spark, seed, chunk):
    rng = random.Random(seed)
    rows = []
    for n in range(260):
        hot = rng.random() < 0.5
        quantity = rng.choice([1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 1000])
        cancels = rng.random() < 0.4
        rows.append(line(("C" if cancels else "") + str(n), "HOT" if hot else rng.choice("AB"),
                         rng.choice(["MUG", None, "Discount"]), -quantity if cancels else quantity,
                         rng.randrange(0, 40) / 24, "1.5", 1 if hot else rng.randrange(2, 4)))
    df = frame(spark, rows)
    got = cancel.net_cancels(df, cancel.match_cancels(df, chunk))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows)


def test_matching_plan_pairs_no_lines_and_prunes(spark, tmp_path):
    path = str(tmp_path / "lines")
    frame(spark, [line()]).write.parquet(path)
    lines = spark.read.parquet(path)
    plan = cancel.match_cancels(lines)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "GreaterThan(Quantity,0)" in plan


def test_cancel_flag_is_contained_not_prefixed(spark):
    flags = cancel.lines_per_basket(frame(spark, [line("1C1"), line("2")]))
    assert {r.InvoiceNo: r.order_canceled for r in flags.collect()} == {"1C1": 1, "2": 0}


def test_first_return_without_counterpart(spark):
    df = frame(spark, [line("1", quantity=2), line("C1", quantity=-2, day=1), line("C2", quantity=-3, day=2),
                       line("C3", quantity=-4, day=3), line("C0", text="Discount", quantity=-1, day=0.5)])
    assert cancel.first_without_counterpart(df).first().InvoiceNo == "C0"
    assert cancel.first_without_counterpart(df, skip_discounts=True).first().InvoiceNo == "C2"
    assert cancel.without_counterpart(df.where(F.col("InvoiceNo") != "C0")).count() == 2


def test_equal_lines_are_refused(spark):
    with pytest.raises(Exception, match="equal lines"):
        cancel.net_cancels(frame(spark, [line("1"), line("1"), line("2")])).collect()


def test_purchases_are_searched_once(spark):
    lines = materialize(frame(spark, [line("1", quantity=8), line("2", quantity=4, day=1), line("C1", quantity=-5, day=2)]), "lines")
    found = cancel.match_cancels(lines)
    assert [(r.status, r.order_line.InvoiceNo) for r in found.collect()] == [("matched", "1")]
    # the search for larger purchases reads what the first step kept, not the lines
    assert not set(lines.inputFiles()) & set(found.inputFiles())


def test_lines_without_cancels_are_not_shuffled(spark):
    """Only keys with a cancel (and keys whose hash falls together with one's) take part in the matching."""
    rows = [line("1", quantity=8), line("C1", quantity=-5, day=2), line("9", customer=None), line("10", stock=None, quantity=-1)]
    rows += [line(str(n), stock=f"B{n}", quantity=n + 1) for n in range(400)]
    marks = {(r.CustomerID, r.StockCode): r.maybe for r in cancel.with_key_mark(frame(spark, rows)).collect()}
    assert marks[(1, "A1")] and sum(marks.values()) < 10 and len(marks) == 403
    kept = cancel.net_cancels(frame(spark, rows))
    assert sorted((r.InvoiceNo, r.StockCode, r.QuantityCanceled) for r in kept.collect() if r.QuantityCanceled or r.CustomerID is None) == [
        ("1", "A1", 5), ("9", "A1", 0)]
    assert kept.count() == 403
    stored = materialize(frame(spark, rows[:-1]), "lines")
    plan = cancel.net_cancels(stored, materialize(cancel.match_cancels(stored), "matches"))._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan.splitlines()[1]


def test_equal_lines_without_cancels_are_refused(spark):
    rows = [line("1"), line("C1", quantity=-1, day=1), line("5", stock="Z"), line("5", stock="Z")]
    with pytest.raises(Exception, match="equal lines"):
        cancel.net_cancels(frame(spark, rows)).collect()


def test_cancels_are_joined_with_their_matches_once(spark):
    rows = [line("1", quantity=8), line("2", quantity=9, day=0.5), line("C1", quantity=-5, day=2), line("C2", quantity=-6, day=3), line("C3", quantity=-50, day=4),
            line("C4", stock="B", quantity=-1), line("C5", stock=None, quantity=-1), line("3", quantity=0, text="Discount"), line("C6", stock="E", text=None, quantity=0)]
    lines = materialize(frame(spark, rows), "lines")
    matches = materialize(cancel.match_cancels(lines), "matches")
    kept = cancel.net_cancels(lines, matches)
    assert sorted((r.InvoiceNo, r.QuantityCanceled) for r in kept.collect()) == [("1", 0), ("2", 6), ("3", 0), ("C3", 0), ("C5", 0)]
    # neither the lines that stay nor the marks read the matches again, and no cancel is grouped with the purchases
    assert not set(matches.inputFiles()) & set(kept.inputFiles())


def test_equal_cancels_are_refused(spark):
    with pytest.raises(Exception, match="equal lines"):
        cancel.net_cancels(frame(spark, [line("1"), line("C1", quantity=-1, day=1), line("C1", quantity=-1, day=1)])).collect()
