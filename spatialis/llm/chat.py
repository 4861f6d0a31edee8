"""Chat formatting: tool calls linked to their results.

Calls and results of a conversation are joined by identifier, ordered so that a call comes after those
whose results its arguments refer to, validated against the tools' schemas and written as canonical JSON
(keys sorted, no spaces).

Calls are given in two ways. Explicit: an assistant's turn holds {"tool_calls": [{"id", "name",
"arguments"}]}, a turn of the role `tool` holds {"tool_call_id", "content"}. An assistant's turn that
isn't such JSON, or lists no calls, is a plain turn. Implicit, for plain conversations: a user's turn is a
call of the tool `reply` with the argument `text`, and with `after`, a reference to the user's turn two
before it if there is one; its identifier is its place, and an assistant's plain turn right after it is
the result.

A value {"$ref": "<id>"} in the arguments refers to a call's result and fits every type, if it is the
whole of what the schema names. Schemas nest: see SCHEMAS.

Rows without conversation or turn take no part. Null texts count as empty. Where an identifier is used
more than once in a conversation, the earliest call and the earliest result count, the smaller text first
at the same turn; repeated rows are thus one. Results without a call are listed with the error `no call`,
calls without an identifier with `no id`, turns of a tool that hold no such JSON or no identifier with
`unreadable result`. Calls on a reference cycle, or on a call that isn't there, have no level and the error
`unresolved reference`. Arguments that aren't a JSON object have the error `not an object`. Other columns
of the messages are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialis.llm.common import staged

#: Tools: for each argument its JSON type (string, integer, number, boolean, object, array, any), whether a
#: call must have it, and after that, for an object, its own arguments, for an array, (type, ...) of its items.
SCHEMAS: dict[str, dict[str, tuple]] = {"reply": {"text": ("string", True), "after": ("string", False)}}
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
_KEY = ["conv_id", "call_id"]


def _calls_and_results(messages: DataFrame, implicit: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls and results by identifier, and what has none, as rows with an error."""
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null and turn is not null")
    told = F.when((F.col("role") == "assistant") & F.contains("text", F.lit('"tool_calls"')), F.from_json("text", _CALLS)["tool_calls"])
    m = m.withColumn("told", told)
    marked = F.coalesce(F.size("told") > 0, F.lit(False))
    calls = m.where(marked).select("conv_id", "turn", F.explode("told").alias("c")).select("conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    answer = F.from_json("text", _RESULT)
    results = m.where("role = 'tool'").select("conv_id", answer["tool_call_id"].alias("call_id"), "turn", F.coalesce(answer["content"], F.when(answer["tool_call_id"].isNull(), F.col("text"))).alias("content"))
    nameless = calls.where("call_id is null").withColumn("error", F.lit("no id")).unionByName(
        results.where("call_id is null").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content").withColumn("error", F.lit("unreadable result")), allowMissingColumns=True
    )
    if implicit:
        place = lambda turn: F.concat(F.lit("turn-"), turn.cast("string"))
        asked = staged(m.where("role = 'user'").groupBy("conv_id", "turn").agg(F.min("text").alias("text")), "asked")
        before = asked.select("conv_id", (F.col("turn") + 2).alias("turn"), F.struct(place(F.col("turn")).alias("$ref")).alias("after"))
        own = asked.join(before, ["conv_id", "turn"], "left").select("conv_id", place(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), F.to_json(F.struct("after", "text")).alias("arguments"))
        calls = calls.unionByName(own)
        # An assistant's turn that follows no user's turn isn't a result.
        said = m.where((F.col("role") == "assistant") & ~marked).select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
        said = said.join(asked.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
        results = results.unionByName(said.select("conv_id", place(F.col("turn")).alias("call_id"), (F.col("turn") + 1).alias("turn"), F.col("text").alias("content")))
    one = lambda df, *rest: df.where("call_id is not null").groupBy(*_KEY).agg(F.min(F.struct("turn", *rest)).alias("own")).select(*_KEY, "own.*")
    return one(calls, "name", "arguments"), one(results, "content").withColumnRenamed("turn", "result_turn"), nameless.distinct()


def _chains(refs: DataFrame) -> DataFrame:
    """(conv_id, call_id, end, steps) of calls with one reference: the first call on the way of references
    that has none or several, or isn't there, found by doubling. Calls that lead into a cycle have no row."""
    single = refs.groupBy(*_KEY).agg(F.min("ref").alias("end"), F.count(F.lit(1)).alias("n")).where("n = 1").select(*_KEY, "end", F.lit(1).alias("steps"))
    now = staged(single, "chains")
    longest = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= 2 * longest:
        on = now.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"))
        both = now.join(on, ["conv_id", "end"], "left")
        grown = both.select(*_KEY, F.coalesce("next", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"))
        grown = staged(grown, "chains")
        done = grown.where("moved").isEmpty()
        now, reach = grown.drop("moved"), 2 * reach
        if done:
            break
    return now.join(single.select("conv_id", F.col("call_id").alias("end")), ["conv_id", "end"], "left_anti")


def _levels(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls whose references can be resolved: one more than the highest level
    of those referred to. Chains of single references are followed by doubling; a round settles the calls
    with several references whose references are settled, so the rounds are as many as such calls are deep."""
    chains = staged(_chains(refs), "chains")
    several = refs.join(refs.groupBy(*_KEY).count().where("count > 1").select(*_KEY), _KEY, "left_semi")

    def with_chains(own: DataFrame) -> DataFrame:
        below = own.select("conv_id", F.col("call_id").alias("end"), "level")
        return own.unionByName(chains.join(below, ["conv_id", "end"]).select(*_KEY, (F.col("level") + F.col("steps")).cast("int").alias("level")))

    free = calls.join(refs.select(*_KEY).distinct(), _KEY, "left_anti").select(*_KEY, F.lit(0).alias("level"))
    parts, left = [staged(with_chains(free), "settled")], staged(several, "refs")
    while not left.isEmpty():
        settled = reduce(DataFrame.unionByName, parts)
        to = settled.select("conv_id", F.col("call_id").alias("ref"), F.col("level").alias("below"))
        ready = left.join(to, ["conv_id", "ref"], "left").groupBy(*_KEY).agg((F.max("below") + 1).alias("level"), F.count_if(F.col("below").isNull()).alias("open"))
        ready = staged(ready.where("open = 0").drop("open"), "ready")
        if ready.isEmpty():
            break
        parts.append(staged(with_chains(ready), "settled"))
        left = staged(left.join(ready.select(*_KEY), _KEY, "left_anti"), "refs")
    return reduce(DataFrame.unionByName, parts)


def _wrong(value: Column, spec: tuple, path: str) -> Column:
    """What is wrong with a value (a variant that is there) by its schema, or null."""
    kind, inner = spec[0], spec[2] if len(spec) > 2 else None
    if kind == "any":
        return F.lit(None).cast("string")
    own = F.schema_of_variant(value)
    fits = reduce(lambda a, b: a | b, [F.startswith(own, F.lit(t)) for t in _TYPES[kind]])
    found = [F.when(~fits, f"not a {kind}: {path}")]
    if kind == "object" and inner is not None:
        found.append(_wrong_object(value, inner, f"{path}."))
    if kind == "array" and inner is not None:
        items = F.try_variant_get(value, "$", "array<variant>")
        found.append(F.try_element_at(F.filter(F.transform(items, lambda x: _wrong(x, (inner[0], True, *inner[1:]), f"{path}[]")), lambda e: e.isNotNull()), F.lit(1)))
    is_ref = F.rlike(own, F.lit(r"^OBJECT<`?\$ref`?: STRING>$"))
    return F.when(~is_ref, F.coalesce(*found))


def _wrong_object(value: Column, fields: dict[str, tuple], path: str) -> Column:
    """The first thing wrong with an object: by the names it may have, in order, then names that it may not."""
    held = F.try_variant_get(value, "$", "map<string,variant>")
    names = F.map_keys(held)
    found = []
    for name, spec in sorted(fields.items()):
        there = F.array_contains(names, name)
        found.append(F.when(there, _wrong(F.element_at(held, F.lit(name)), spec, f"{path}{name}")).otherwise(F.lit(f"missing: {path}{name}") if spec[1] else F.lit(None)))
    other = F.try_element_at(F.array_sort(F.filter(names, lambda n: ~n.isin(*fields) if fields else F.lit(True))), F.lit(1))
    return F.coalesce(*found, F.when(other.isNotNull(), F.concat(F.lit(f"unexpected: {path}"), other)))


def _error(name: Column, value: Column, schemas: dict[str, dict[str, tuple]]) -> Column:
    """The first thing wrong with a call's arguments, or null. value: the arguments as a variant."""
    found = [F.when(value.isNull() | ~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), "not an object"), F.when(name.isNull() | ~name.isin(*schemas), "unknown tool")]
    return F.coalesce(*found, *[F.when(name == tool, _wrong_object(value, fields, "")) for tool, fields in sorted(schemas.items())])


def linked_calls(messages: DataFrame, schemas: dict[str, dict[str, tuple]] | None = None, implicit: bool = True) -> DataFrame:
    """One row for each call, and each result without one: conv_id, call_id, turn, result_turn, level,
    name, valid, error, json. A conversation's rows in the order of (level, turn, call_id) are in
    topological order."""
    schemas = SCHEMAS if schemas is None else schemas
    calls, results, nameless = _calls_and_results(messages, implicit)
    calls = staged(calls, "calls")
    ref = F.regexp_extract_all("arguments", F.lit(r'"\$ref"\s*:\s*"([^"]*)"'), F.lit(1))
    refs = staged(calls.where(F.contains("arguments", F.lit('"$ref"'))).select(*_KEY, F.explode(F.array_distinct(ref)).alias("ref")), "refs")
    leveled = calls.join(_levels(calls, refs), _KEY, "left") if not refs.isEmpty() else calls.withColumn("level", F.lit(0))
    joined = leveled.join(results, _KEY, "full_outer").unionByName(nameless, allowMissingColumns=True)
    value = F.try_parse_json("arguments")
    is_call = F.col("turn").isNotNull()
    linked = F.when(~is_call, "no call").otherwise(F.coalesce(F.when(F.col("level").isNull(), "unresolved reference"), _error(F.col("name"), value, schemas)))
    error = F.coalesce("error", linked)
    # to_json writes a variant's keys in order; fields are named in order here.
    body = F.concat(
        F.lit('{"arguments":'),
        F.coalesce(F.to_json(value), F.lit("null")),
        F.lit(',"id":'),
        F.coalesce(_quoted(F.col("call_id")), F.lit("null")),
        F.lit(',"name":'),
        F.coalesce(_quoted(F.col("name")), F.lit("null")),
        F.lit(',"result":'),
        F.coalesce(_quoted(F.col("content")), F.lit("null")),
        F.lit("}"),
    )
    out = joined.withColumns({"error": error, "json": body})
    return out.select("conv_id", "call_id", "turn", "result_turn", "level", "name", F.col("error").isNull().alias("valid"), "error", "json")


def _quoted(x: Column) -> Column:
    """A JSON string: what to_json writes between `{"s":` and `}`."""
    whole = F.to_json(F.struct(x.alias("s")))
    return F.when(x.isNotNull(), F.substr(whole, F.lit(6), F.length(whole) - 6))


#: The same rows in DuckDB, for plain conversations: a call's level is its place in a run of user's turns
#: that lie two apart.
SQL = """
with m as (select conv_id, turn::bigint as turn, role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
asked as (select conv_id, turn, min(text) as text from m where role = 'user' group by conv_id, turn),
runs as (select *, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as run from asked),
calls as (select conv_id, turn, 'turn-' || turn as call_id, text, (row_number() over (partition by conv_id, turn % 2, run order by turn) - 1)::int as level from runs),
results as (select conv_id, 'turn-' || (turn - 1) as call_id, turn as result_turn, min(text) as content from m where role = 'assistant' group by conv_id, turn)
select c.conv_id, c.call_id, c.turn, r.result_turn, c.level, 'reply' as name, true as valid, null::varchar as error,
  '{"arguments":{' || case when c.level > 0 then '"after":{"$ref":"turn-' || (c.turn - 2) || '"},' else '' end || '"text":' || to_json(c.text)::varchar || '},"id":' || to_json(c.call_id)::varchar || ',"name":"reply","result":' || coalesce(to_json(r.content)::varchar, 'null') || '}' as json
from calls c left join results r on c.conv_id = r.conv_id and c.call_id = r.call_id
"""
