import pytest

from custvalue.operators import segments
from custvalue.rules import Rules
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def clv(make_clv):
    return make_clv(
        # One visit: frequency 0, at risk as soon as a day has passed.
        {"ctc_id": 1, "location": "A", "value": 1, "days_since_last_visit": 1},
        {"ctc_id": 2, "location": "A", "value": 2, "days_since_last_visit": 0},
        {"ctc_id": 3, "location": "A", "no_visit": 2, "value": 30, "frequency": 5,
         "days_since_last_visit": 10},
        {"ctc_id": 4, "location": "A", "no_visit": 3, "value": 40, "frequency": 7,
         "days_since_last_visit": 19},
        {"ctc_id": 4, "location": "B", "no_visit": 4, "value": 8, "frequency": 6,
         "days_since_last_visit": 18},
    )


def test_members(clv):
    def users(name):
        return rows_of(segments.segment(clv, name), "location", f"{segments.PREFIXES[name]}_users")

    assert users("all") == [("A", 4), ("B", 1)]
    assert users("loyal") == [("A", 1), ("B", 1)]
    assert users("repeat") == [("A", 2), ("B", 1)]
    # Idle days must exceed twice the frequency: 10 > 10 does not.
    assert users("risk") == [("A", 2), ("B", 1)]
    # Threshold 6 over the three returning rows of both locations; 18 > 18 does not.
    assert segments.churn_frequency(clv).first()[0] == 6.0
    assert users("churn") == [("A", 1)]
    # A quarter of five rows, half-even: one customer.
    assert users("top") == [("A", 1), ("B", 1)]
    assert users("low") == [("A", 1)]


def test_metrics(clv):
    row = segments.segment(clv, "repeat").filter("location = 'A'").first()
    assert row.asDict() == {
        "location": "A", "repeat_clv": 35.0, "repeat_aov": 35.0, "repeat_revenue": 70.0,
        "repeat_users": 2, "repeat_frequency": 6.0,
    }


def test_one_table_equals_the_seven(clv):
    together = segments.segments(clv)
    for name, prefix in segments.PREFIXES.items():
        alone = segments.segment(clv, name)
        metrics = [f"{prefix}_{m}" for m in segments.METRICS]
        mine = together.filter(f"segment = '{name}'")
        assert rows_of(mine, "location", *segments.METRICS) == rows_of(alone, "location", *metrics)


def test_no_returning_customers_means_no_churn(make_clv):
    new_only = make_clv({"ctc_id": 1, "location": "A", "days_since_last_visit": 99})
    assert segments.churn_frequency(new_only).first()[0] is None
    assert segments.segment(new_only, "churn").count() == 0
    found = rows_of(segments.segments(new_only), "segment")
    # A quarter of one row rounds to no customer.
    assert found == [("all",), ("risk",)]


def test_one_location_lists_all_seven(clv):
    got = segments.segments_for_location(segments.segments(clv), "B")
    assert rows_of(got, "segment", "users") == [
        ("all", 1), ("churn", None), ("low", None), ("loyal", 1), ("repeat", 1), ("risk", 1), ("top", 1),
    ]


def test_factors_are_rules(clv):
    rules = Rules(churn_factor=2.9, risk_factor=1.9, repeat_visits=3, spender_share=1.0)
    got = rows_of(segments.segments(clv, rules).filter("location = 'A'"), "segment", "users")
    assert got == [("all", 4), ("churn", 1), ("low", 4), ("loyal", 1), ("repeat", 1), ("risk", 3), ("top", 4)]


def test_loyal_are_repeat_and_new_plus_repeat_are_all(clv):
    loyal = clv.filter("no_visit >= 3")
    repeat = clv.filter("no_visit >= 2")
    assert loyal.exceptAll(repeat).count() == 0
    assert clv.filter("no_visit = 1").count() + repeat.count() == clv.count()


@pytest.mark.parametrize("share", [0.25, 0.5, 0.0])
def test_observed_facts_save_a_pass(spark, make_clv, tmp_path, share):
    """The facts of the write are those of the table, also without returning customers or any row."""
    rules = Rules(spender_share=share)
    some = [{"ctc_id": c, "location": "AB"[c % 2], "value": c % 7, "no_visit": 1 + c % 3, "frequency": c / 8,
             "days_since_last_visit": c} for c in range(61)]
    for rows in (some, some[::3], some[:0]):
        clv = make_clv(*rows) if rows else make_clv(*some).filter("ctc_id < 0")
        marked, seen = segments.observed(clv)
        marked.write.mode("overwrite").parquet(str(tmp_path / "clv"))
        stored = spark.read.parquet(str(tmp_path / "clv"))
        facts = segments.facts_of(seen)
        assert facts == (len(rows), segments.churn_frequency(stored).first()[0])
        with_facts = segments.segments(stored, rules, facts)
        assert rows_of(with_facts) == rows_of(segments.segments(stored, rules))
        plan = with_facts._jdf.queryExecution().executedPlan().toString()
        assert "Subquery" not in plan
