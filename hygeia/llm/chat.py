"""Linking of tool calls and their results in chat logs (DataFrame functions only).

Calls and results meet by a hash join on (conversation, call id), results
reduced to the first of each id before it.  Calls are put in topological order of their references by
levels: those without open references, then those whose references all have a level,
round by round; each round is a join on what is left, so no conversation is ever
gathered in one row or task.  Arguments are validated against the tool's schema and serialised as canonical
JSON (keys sorted, no white space), both on Spark's VARIANT.

Cases: rows that repeat a call id are one call (the first by turn, then arguments); each row without a call id is a call of
its own that no result can name (null id, no result); a result without
call is dropped from the calls and counted by ``orphan_results``; null or malformed arguments, null names and unknown
tools are errors of the call, not failures; a reference to a missing call, to itself or into a cycle leaves
the level null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.llm.common import Scratch, running_sum

ID = ["conv_id", "call_id"]
#: Turns in a block of the running order of a conversation.
BLOCK_TURNS = 50_000

#: tool -> parameter -> (type, required, least, most).
Schemas = dict[str, dict[str, tuple[str, bool, float | None, float | None]]]


def _same(a: str, b: str, keys: list[str] = ID) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def schema_errors(arguments: str, name: str, schemas: Schemas) -> Column:
    """Array of what is wrong with JSON arguments: sorted, empty if nothing."""
    v = F.try_parse_json(F.col(arguments))
    keys = F.json_object_keys(F.col(arguments))

    def of(tool: str, parameters: dict) -> Column:
        checks = [F.when(F.size(F.array_except(keys, F.lit(sorted(parameters)))) > 0, F.lit("unknown parameter"))]
        for p, (kind, required, least, most) in sorted(parameters.items()):
            there = F.array_contains(keys, p)
            found = F.schema_of_variant(F.variant_get(v, f"$.{p}", "variant"))
            value = F.try_variant_get(v, f"$.{p}", "double")
            low = value < least if least is not None else F.lit(False)
            high = value > most if most is not None else F.lit(False)
            right = found.isin(*(["BIGINT"] if kind == "integer" else ["STRING"] if kind == "string" else ["BOOLEAN"]))
            checks.append(F.when(~there, F.lit(f"{p}: missing") if required else F.lit(None))
                          .when(~right | found.isNull(), F.lit(f"{p}: not {kind}"))
                          .when(low | high, F.lit(f"{p}: out of range")))
        return F.array_sort(F.array_compact(F.array(*checks)))

    out = F.when(v.isNull() | keys.isNull(), F.array(F.lit("malformed")))
    for tool, parameters in sorted(schemas.items()):
        out = out.when(F.col(name) == tool, of(tool, parameters))
    return out.otherwise(F.array(F.lit("unknown tool")))


def levels(calls: DataFrame, references: DataFrame, work: Scratch) -> DataFrame:
    """(conv_id, call_id, level) of the calls that topological order reaches; references: conv_id, call_id, needs."""
    open_ = work.table(references.select(*ID, "needs").distinct(), "needs0")
    found = work.table(calls.alias("c").join(open_.alias("n"), _same("c", "n"), "left_anti")
                       .select(*ID).withColumn("level", F.lit(0)), "level0")
    done, step = found, 0
    while not open_.isEmpty():
        step += 1
        cond = F.col("n.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("n.needs") == F.col("f.call_id"))
        left = work.table(open_.alias("n").join(found.alias("f"), cond, "left_anti"), f"needs{step}")
        free = (open_.select(*ID).distinct().alias("o").join(left.alias("l"), _same("o", "l"), "left_anti")
                .select(*ID).withColumn("level", F.lit(step)))
        found = work.table(free, f"level{step}")
        if found.isEmpty():
            break
        done, open_ = done.unionByName(found), left
    return done


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call of ``calls`` (conv_id, call_id, turn, name, arguments, needs array<string>) with its result
    from ``results`` (conv_id, call_id, turn, content), level, position in the conversation, errors and record."""
    work = Scratch(calls.sparkSession, "chat")
    fields = ["turn", "name", "arguments", "needs"]
    one = (calls.where("call_id is not null").groupBy(*ID).agg(F.min(F.struct(*fields)).alias("c"), F.count(F.lit(1)).alias("n_rows"))
           .select(*ID, *[F.col(f"c.{f}").alias(f) for f in fields], "n_rows"))
    unnamed = calls.where("call_id is null").select(*ID, *fields, F.lit(1).cast("bigint").alias("n_rows"))
    key = F.coalesce("call_id", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    one = work.table(one.unionByName(unnamed).withColumn("_key", key), "calls")
    first = results.groupBy(*ID).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    linked = (one.alias("c").join(first.where("call_id is not null").alias("r"), _same("c", "r"), "left")
              .select("c.*", F.col("r.r.turn").alias("result_turn"), F.col("r.r.content").alias("result"),
                      F.coalesce("r.n_results", F.lit(0)).cast("bigint").alias("n_results")))
    keyed = one.select("conv_id", F.col("_key").alias("call_id"), "needs")
    order = levels(keyed.select(*ID), keyed.select(*ID, F.explode("needs").alias("needs")), work)
    same = F.col("c.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("c._key") == F.col("o.call_id"))
    ranked = linked.alias("c").join(order.alias("o"), same, "left").select("c.*", "o.level")
    last = F.coalesce(F.col("level"), F.lit(2**30)).cast("bigint")
    ranked = ranked.withColumn("_block", last * 2**30 + F.coalesce(F.expr(f"turn div {BLOCK_TURNS}"), F.lit(0)))
    placed = running_sum(ranked, ["conv_id"], "_block", [F.col("level").asc_nulls_last(), F.col("turn"), F.col("_key")],
                         F.lit(1), "position")
    parsed = F.try_parse_json(F.col("arguments"))
    record = F.to_json(F.struct(
        F.coalesce(parsed, F.to_variant_object(F.struct(F.col("arguments").alias("raw")))).alias("arguments"),
        F.col("call_id").alias("id"), F.col("name"), F.col("result")), {"ignoreNullFields": "false"})
    errors = schema_errors("arguments", "name", schemas)
    return placed.select(*ID, "turn", "name", "result_turn", "n_rows", "n_results", "level",
                         F.col("position").cast("bigint").alias("position"), errors.alias("errors"),
                         F.to_json(F.try_parse_json(record)).alias("record"))


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call id no call has."""
    ids = calls.select(*ID).distinct()
    return results.alias("r").join(ids.alias("c"), _same("r", "c"), "left_anti")
