"""Tool-call linking for chat formatting, by DataFrame functions alone.

Calls and results are joined by identifier, calls are ordered topologically
by the identifiers that they depend on, arguments are validated against their
tool's schema, and every message becomes one line of canonical JSON: keys in
order of their names at every depth, no white space, no absent fields. Values
keep their JSON types; numbers are written in one way (3.0 as 3, 1e3 as
1000.0), with up to 38 digits and beyond these as doubles.

The order: a call without dependencies has level 0, any other has one more
than the highest of the calls it depends on. A result follows its call. Calls
in a cycle, or that depend on an absent one, have no level and come last.
Chains of calls with one dependency each take a round for each doubling of
their length; calls with several take one for each level among themselves, as
many as there are. Places within a conversation are counted by blocks of 1,024 turns and
added up over the blocks, so that no task sorts a whole conversation.

Cases: a null identifier links to nothing; of calls (or results) with equal
identifiers in one conversation only the first turn's counts. The others
have rows too (unless ``every`` is false), without level or link, whose problems begin with
``no identifier`` or ``repeated``. Turns that neither call nor answer are messages, before all calls, without level. Null conversations are one. A null text is the empty string; null arguments or
arguments that are no JSON object (or name a key twice) are invalid; a field
that is null counts as absent in validation and stays in the JSON; other columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm import tables

#: Schemas: tool, field, type (string, integer, number, boolean, object, array or null), required.
SCHEMA_TYPE = "tool string, field string, type string, required boolean"
BLOCK = 1024
CALL = ["conv_id", "call_id"]


def firsts(rows: DataFrame) -> DataFrame:
    """Of equal identifiers in a conversation the row of the first turn (the least ``tie`` in one), others dropped."""
    others = ["tie", *(c for c in rows.columns if c not in (*CALL, "turn", "tie"))]
    best = rows.filter("call_id is not null").groupBy(*CALL).agg(F.min(F.struct("turn", *others)).alias("x"))
    return best.select(*CALL, "x.*")


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` by equal keys; null conversations are equal."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) if k == "conv_id" else F.col(k) == F.col(f"_r_{k}") for k in keys]
    return left.join(other, on, how).drop(*(f"_r_{k}" for k in keys))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) from (conv_id, call_id, depends_on array).

    Calls with one dependency point along their chain to its anchor, the next
    call that has none or several; pointers double in each round. What is left
    are calls with several, in rounds over their own levels.
    """
    edges = tables.staged(calls.select(*CALL, F.explode("depends_on").alias("needs")).distinct(), "needs")
    fan = edges.groupBy(*CALL).agg(F.count("*").alias("n"), F.min("needs").alias("needs"))
    each = met(calls.select(*CALL), fan, CALL, "left")
    # ``to`` is the call that ``far`` steps lead to, ``done`` that it is an anchor, ``root`` that nothing comes before it.
    whole = tables.staged(
        each.select(
            *CALL, F.when(F.col("n") == 1, F.col("needs")).otherwise(F.col("call_id")).alias("to"), F.when(F.col("n") == 1, 1).otherwise(0).alias("far"),
            (F.coalesce("n", F.lit(0)) != 1).alias("done"), F.col("n").isNull().alias("root"),
        ),
        "chain",
    )
    several = not whole.filter("done and not root").isEmpty()
    chains, loose = whole.filter("done"), whole.filter("not done")
    left = loose.count()
    while left:
        ahead = chains.unionByName(loose).select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("done").alias("_done"), F.col("root").alias("_root"))
        step = met(loose.select(*CALL, "to", "far"), ahead, ["conv_id", "to"])
        now = tables.staged(step.select(*CALL, F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far"), F.col("_done").alias("done"), F.col("_root").alias("root")), "chain")
        chains, loose = chains.unionByName(now.filter("done")), now.filter("not done")
        before, left = left, loose.count()
        if left == before:  # only cycles are left
            break
    found = chains.filter("root").select(*CALL, F.col("far").alias("level"))
    if not several:
        return found
    chains = tables.staged(chains, "chains")
    several = chains.filter("to = call_id and not root").select(*CALL)
    wants = met(met(edges, several, CALL), chains.select("conv_id", F.col("call_id").alias("needs"), "to", "far", "root"), ["conv_id", "needs"], "left")
    # ``level`` is the one that a dependency asks for, null until its anchor has one.
    wants = tables.staged(wants.select(*CALL, "to", (F.col("far") + 1).alias("plus"), F.when(F.col("root"), F.col("far") + 1).alias("level")), "wants")
    anchors = []
    while True:
        whole = wants.groupBy(*CALL).agg(F.max("level").alias("level"), F.min(F.col("level").isNotNull()).alias("whole"))
        now = tables.staged(whole.filter("whole").select(*CALL, "level"), "level")
        if now.isEmpty():
            break
        anchors.append(now)
        if len(anchors) == 32:
            anchors = [tables.staged(reduce(DataFrame.unionByName, anchors), "level")]
        rest = met(wants, now.select(*CALL), CALL, "left_anti")
        placed_ = now.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("below"))
        rest = met(rest, placed_, ["conv_id", "to"], "left")
        wants = tables.staged(rest.select(*CALL, "to", "plus", F.coalesce("level", F.col("below") + F.col("plus")).alias("level")), "wants")
    if not anchors:
        return found
    above = reduce(DataFrame.unionByName, anchors).select("conv_id", F.col("call_id").alias("to"), "level")
    later = met(chains.filter("not root"), above, ["conv_id", "to"])
    return found.unionByName(later.select(*CALL, (F.col("far") + F.col("level")).alias("level")))


def judged(field: Column, given: Column) -> Column:
    """The problem of one field of a schema with a tool's arguments, null for none."""
    value = F.try_element_at(given, field["field"])
    found, want = F.schema_of_variant(value), field["type"]
    number = found.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    # 3.0 is an integer, as in JSON Schema; a double is one where it has no fraction.
    whole = found.rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))$") | ((found == "DOUBLE") & (F.try_variant_get(value, "$", "double") % 1 == 0))
    fits = (
        F.when(want == "string", found == "STRING")
        .when(want == "integer", whole)
        .when(want == "number", number)
        .when(want == "boolean", found == "BOOLEAN")
        .when(want == "object", found.startswith("OBJECT"))
        .when(want == "array", found.startswith("ARRAY"))
        .when(want == "null", F.lit(False))
    )
    absent = found.isNull() | ((found == "VOID") & (want != "null"))
    return (
        F.when(absent, F.when(field["required"], F.concat(F.lit("missing "), field["field"])))
        .when((found == "VOID") & (want == "null"), F.lit(None))
        .when(fits.isNull(), F.concat(F.lit("unknown type "), want, F.lit(" of "), field["field"]))
        .when(~fits, F.concat(F.lit("no "), want, F.lit(" "), field["field"]))
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``problems``: sorted texts, none for valid arguments."""
    fields = schemas.groupBy("tool").agg(F.collect_list(F.struct("field", "type", "required")).alias("_fields"))
    held = calls.join(F.broadcast(fields), "tool", "left").withColumn("_given", F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>"))
    given = F.col("_given")
    unknown = F.transform(F.array_except(F.map_keys(given), F.transform("_fields", lambda f: f["field"])), lambda k: F.concat(F.lit("unknown field "), k))
    broken = F.when(given.isNull(), F.lit("no object"))
    wrong = F.concat(F.transform("_fields", lambda f: judged(f, given)), F.coalesce(unknown, F.array().cast("array<string>")), F.array(broken))
    # Fields of a tool without a schema are not judged one by one.
    found = F.when(F.col("_fields").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(F.array_distinct(F.array_compact(wrong))))
    return held.withColumn("problems", found).select(*calls.columns, "problems")


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame, every: bool = True, messages: DataFrame | None = None, line: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each call, each result and each message in topological order.

    ``calls``: conv_id, turn, call_id, tool, arguments (JSON), depends_on;
    ``results``: conv_id, turn, call_id, content; ``messages``: conv_id, turn,
    role, content. Returns conv_id, place (from 0), kind, call_id, turn,
    level, linked, problems (joined by ``; ``), json. Of rows of one turn with
    equal identifiers the first by ``tie``, a column that calls and results may have, counts;
    rows alike in all but their JSON are in its order, or in that of ``line`` of it.
    """
    calls, results = (rows if "tie" in rows.columns else rows.withColumn("tie", F.lit(None).cast("string")) for rows in (calls, results))
    number = F.monotonically_increasing_id().alias("_id")
    all_calls = tables.staged(calls.select(*CALL, "turn", "tool", "arguments", "depends_on", "tie", number), "all_calls")
    all_results = tables.staged(results.select(*CALL, "turn", "content", "tie", number), "all_results")
    first = tables.staged(firsts(all_calls), "calls")
    replies = tables.staged(firsts(all_results), "results")
    judged = met(validated(first, schemas), levels(first), CALL, "left")
    hit = met(judged, replies.select(*CALL, F.lit(True).alias("answered")), CALL, "left")
    none = F.lit(None).cast("string")
    sent = hit.select(
        *CALL, "turn", F.lit("call").alias("kind"), "level", F.coalesce("answered", F.lit(False)).alias("linked"), F.array_join("problems", "; ").alias("problems"),
        "tool", "arguments", none.alias("content"),
    )
    came = met(replies, judged.select(*CALL, "tool", "level", F.lit(True).alias("called")), CALL, "left").select(
        *CALL, "turn", F.lit("result").alias("kind"), "level", F.coalesce("called", F.lit(False)).alias("linked"), F.when(F.col("called").isNull(), "no call").otherwise("").alias("problems"),
        "tool", none.alias("arguments"), "content",
    )
    if every:
        why = F.when(F.col("call_id").isNull(), "no identifier").otherwise("repeated")
        loose = [F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked")]
        more = validated(all_calls.join(first.select("_id"), "_id", "left_anti"), schemas)
        more = more.select(*CALL, "turn", F.lit("call").alias("kind"), *loose, F.array_join(F.concat(F.array(why), "problems"), "; ").alias("problems"), "tool", "arguments", none.alias("content"))
        sent = sent.unionByName(more)
        more = all_results.join(replies.select("_id"), "_id", "left_anti")
        came = came.unionByName(more.select(*CALL, "turn", F.lit("result").alias("kind"), *loose, why.alias("problems"), none.alias("tool"), none.alias("arguments"), "content"))
    rows = sent.unionByName(came)
    # Canonical: struct fields in order of their names, as a variant's are at every depth; absent ones are left out.
    given = F.try_parse_json("arguments")
    object_ = F.when(F.schema_of_variant(given).startswith("OBJECT"), given)
    call_json = F.to_json(F.struct(object_.alias("arguments"), F.col("call_id").alias("id"), F.lit("assistant").alias("role"), F.col("tool").alias("tool")))
    result_json = F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"), F.col("call_id").alias("id"), F.lit("tool").alias("role"), F.col("tool").alias("tool")))
    rows = rows.withColumn("json", F.when(F.col("kind") == "call", call_json).otherwise(result_json))
    if messages is not None:
        said = F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"), F.col("role")))
        rows = rows.drop("tool", "arguments", "content").unionByName(
            messages.select("conv_id", none.alias("call_id"), "turn", F.lit("message").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.lit("").alias("problems"), said.alias("json"))
        )
    return placed(rows, line).select("conv_id", "place", "kind", "call_id", "turn", "level", "linked", "problems", "json")


def placed(rows: DataFrame, line: Callable[[Column], Column] | None = None) -> DataFrame:
    """``rows`` with ``place`` in their conversation by (level, turn, kind, call_id, json, or ``line`` of it), counted by blocks."""
    rank = F.coalesce("level", F.when(F.col("kind") == "message", -1), F.lit(2**31 - 1))
    held = tables.staged(rows.withColumn("_rank", rank).withColumn("_block", F.expr(f"turn div {BLOCK}")), "placed")
    own = Window.partitionBy("conv_id", "_rank", "_block").orderBy("turn", "kind", "call_id", *([line(F.col("json"))] if line else []), "json")
    counts = held.groupBy("conv_id", "_rank", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_rank", "_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = held.withColumn("_own", F.row_number().over(own) - 1)
    keys = ["conv_id", "_rank", "_block"]
    joined = found.alias("f").join(counts.alias("c"), [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    return joined.select("f.*", (F.col("_before") + F.col("_own")).cast("long").alias("place"))


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, messages) that stand for turns: a user's turn calls, the assistant's next one answers, all others are messages.

    Call ``c<turn>`` asks for a search of the turn's whole text (``lookup`` in every
    third), and results and messages say theirs; it depends on the call two turns before, four calls to a chain.
    """
    text = F.coalesce("text", F.lit(""))
    user = turns.filter("role = 'user'")
    step = F.expr("turn div 2")
    tool = F.when(step % 3 == 2, "lookup").otherwise("search")
    where = F.struct(F.col("turn"), step.alias("step"), (step % 2 == 0).alias("even"))
    arguments = F.to_json(F.struct(text.alias("query"), F.length(text).alias("limit"), where.alias("at")))
    depends = F.when(step % 4 > 0, F.array(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    calls = user.select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), depends.alias("depends_on"), F.concat_ws(" ", F.substring(F.md5(text), 1, 8), F.length(text)).alias("tie"))
    replies = turns.filter("role = 'assistant'")
    results = replies.select("conv_id", "turn", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), text.alias("content"), F.md5(text).alias("tie"))
    others = turns.filter(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)))
    return calls, results, others.select("conv_id", "turn", "role", text.alias("content"))


SCHEMAS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("search", "at", "object", False), ("lookup", "query", "string", True), ("lookup", "key", "string", True)]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, results and messages that stand for the turns of all conversations, linked and in order, with their whole texts."""
    calls, results, messages = from_conversations(tables.table(spark, sf_dir, "conversations"))
    return linked(calls, results, spark.createDataFrame(SCHEMAS, SCHEMA_TYPE), messages=messages, line=digested)


def digested(json: Column) -> Column:
    """A canonical line with a digest in the place of each whole text: of ``content``, and of ``query`` among the arguments."""
    said = F.parse_json(json)
    part = lambda path, kind="string": F.variant_get(said, path, kind)
    given = F.struct(F.variant_get(said, "$.arguments.at", "variant").alias("at"), part("$.arguments.limit", "long").alias("limit"), F.substring(F.md5(part("$.arguments.query")), 1, 8).alias("query"))
    arguments = F.when(part("$.arguments", "variant").isNotNull(), given)
    return F.to_json(F.struct(arguments.alias("arguments"), F.md5(part("$.content")).alias("content"), *(part(f"$.{k}").alias(k) for k in ("id", "role", "tool"))))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``conversations``, with digests for the texts of their lines."""
    return conversations(spark, sf_dir).withColumn("json", digested(F.col("json")))


OP9_SQL = r"""
with recursive t as (select conv_id, turn, role, coalesce(text, '') as text from conversations),
c0 as (
  select conv_id, turn, 'c' || turn as call_id, case when turn // 2 % 3 = 2 then 'lookup' else 'search' end as tool,
         length(text) as lim, substr(md5(text), 1, 8) as q, case when turn // 2 % 4 > 0 then 'c' || (turn - 2) end as needs,
         case when turn is null then '{}' else '{"even":' || (turn // 2 % 2 = 0) || ',"step":' || turn // 2 || ',"turn":' || turn || '}' end as spot
  from t where role = 'user'),
ca as (
  select *, case when tool = 'lookup' then 'missing key; unknown field at; unknown field limit' else '' end as wrong,
         row_number() over (partition by conv_id, call_id order by turn, tool, q, lim) as nth from c0),
c as (select * from ca where nth = 1 and call_id is not null),
ra as (
  select *, row_number() over (partition by conv_id, call_id order by turn, content) as nth
  from (select conv_id, turn, 'c' || (turn - 1) as call_id, md5(text) as content from t where role = 'assistant')),
r as (select * from ra where nth = 1 and call_id is not null),
lv as (
  select conv_id, call_id, 0 as level from c where needs is null
  union all
  select c.conv_id, c.call_id, lv.level + 1 from c join lv on c.conv_id is not distinct from lv.conv_id and c.needs = lv.call_id),
kept as (
  select ca.*, ca.nth = 1 and ca.call_id is not null as first,
         '{"arguments":{"at":' || spot || ',"limit":' || lim || ',"query":"' || q || '"}' || coalesce(',"id":"' || call_id || '"', '') || ',"role":"assistant","tool":"' || tool || '"}' as json
  from ca),
a as (
  select k.conv_id, k.turn, 'call' as kind, k.call_id, lv.level, k.first and r.call_id is not null as linked,
         case when k.first then wrong else concat_ws('; ', case when k.call_id is null then 'no identifier' else 'repeated' end, nullif(wrong, '')) end as problems, json
  from kept k left join lv on k.first and k.conv_id is not distinct from lv.conv_id and k.call_id = lv.call_id
              left join r on k.first and k.conv_id is not distinct from r.conv_id and k.call_id = r.call_id
  union all
  select ra.conv_id, ra.turn, 'result', ra.call_id, lv.level, c.call_id is not null,
         case when ra.call_id is null then 'no identifier' when ra.nth > 1 then 'repeated' when c.call_id is null then 'no call' else '' end,
         '{"content":"' || content || '"' || coalesce(',"id":"' || ra.call_id || '"', '') || ',"role":"tool"' || coalesce(',"tool":"' || tool || '"', '') || '}'
  from ra left join c on ra.nth = 1 and ra.conv_id is not distinct from c.conv_id and ra.call_id = c.call_id
          left join lv on ra.nth = 1 and ra.conv_id is not distinct from lv.conv_id and ra.call_id = lv.call_id
  union all
  select conv_id, turn, 'message', null, null, false, '', '{"content":"' || md5(text) || '"' || coalesce(',"role":"' || role || '"', '') || '}'
  from t where role is null or role not in ('user', 'assistant'))
select conv_id,
       cast(row_number() over (partition by conv_id order by coalesce(level, case when kind = 'message' then -1 else 2147483647 end), turn nulls first, kind, call_id nulls first, json) - 1 as bigint) as place,
       kind, call_id, turn, level, linked, problems, json
from a
"""
