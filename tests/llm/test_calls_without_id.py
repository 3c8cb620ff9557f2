"""Calls without an identifier are rows of their own."""

from hygeia.llm import chat
from tests.llm.test_pages import CALLS, RESULTS, SCHEMAS


def test_every_call_without_id_stays(spark):
    calls = [(1, None, t, "add", f'{{"a":{t}}}', ["c"] if t == 2 else [], "x") for t in (1, 2, 2, 3)] + [(1, "c", 0, "add", '{"a":1}', [], "x")]
    calls += [(None, None, t, "add", '{"a":1}', None, "x") for t in (None, 1)]
    results = [(1, None, 5, "nobody's"), (1, "c", 1, "ok")]
    got = chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    assert len(got) == 7
    assert sorted((x["turn"], x["level"], x["n_results"]) for x in got if x["conv_id"] == 1 and x["call_id"] is None) == [
        (1, 0, 0), (2, 1, 0), (2, 1, 0), (3, 0, 0)]
    assert [x["n_results"] for x in got if x["call_id"] == "c"] == [1]
    assert sorted(x["position"] for x in got if x["conv_id"] == 1) == [0, 1, 2, 3, 4]
