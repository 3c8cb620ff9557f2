"""Drafts of one batch against each other: a request falls to an earlier one that holds all its metadata."""

import datetime as dt
import random

from hygeia.plans import decisions as D
from tests import golden as G

AS_OF = "2026-03-30T00:00:00.000000Z"


def _requests(spark, rows):
    return spark.createDataFrame([(i, dt.datetime(2026, 3, 30), "draft", None, None, None, None, None, None, t, v, m)
                                  for i, t, v, m in rows], D.DECISION_SCHEMA)


def _kept(spark, rows):
    ml = spark.createDataFrame([], G.ML_SCHEMA)
    return sorted(r["ordinal"] for r in D.draft_records(ml, _requests(spark, rows), AS_OF).collect())


def test_less_after_more_is_one_draft(spark):
    cpu = "cpumodel"
    assert _kept(spark, [(1, cpu, "X", {"Family": "F"}), (2, cpu, "X", {})]) == [1]
    assert _kept(spark, [(1, cpu, "X", {}), (2, cpu, "X", {"Family": "F"}), (3, cpu, "X", None)]) == [1, 2]
    assert _kept(spark, [(1, cpu, "X", {"Family": "F"}), (2, cpu, "Y", {}), (3, "instancetype", "X", {})]) == [1, 2, 3]
    # names that the layout doesn't hold and empty values are no metadata
    assert _kept(spark, [(1, cpu, "X", {"Family": "F"}), (2, cpu, "X", {"colour": "red", "coreCount": ""})]) == [1]
    assert _kept(spark, []) == []


def test_equals_one_request_after_the_other(spark):
    rng = random.Random(5)
    names = ["CPUModel", "cloudProvider", "Family", "coreCount"]
    rows = [(i, "instancetype", rng.choice("ab"), {n: rng.choice("12") for n in names if rng.random() < 0.5}) for i in range(300)]
    drafted = []
    for i, t, v, m in rows:
        if not any(v == w and m.items() <= have.items() for _, w, have in drafted):
            drafted.append((i, v, m))
    assert _kept(spark, rows) == [i for i, _, _ in drafted]
