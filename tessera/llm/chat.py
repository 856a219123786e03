"""Chat formatting: tool-call linking, DataFrame and SQL functions only.

Calls and results are linked by a hash join on (conv_id, call_id), calls are ordered
topologically by what they depend on, their arguments are validated against the schemas
of their tools, and each call is serialised with its result as canonical JSON (keys sorted,
no white space; arguments pass through the variant type, which keeps objects in key order).

Ordering never gathers a conversation in one task: chains of single dependencies are folded
by doubling pointers, and the calls with several dependencies are peeled level by level
(Kahn), each round a join whose result is stored.  Rounds follow the logarithm of the longest
chain and the depth of calls with several dependencies, not the number of rows.

Defined results: every message and every result gives a row.  Of several calls (or results) of
one id the earliest turn counts, then the smallest content; the others are `duplicate_call` or
`duplicate_result` (equal ones as one row, their number in n_calls or n_results).  Calls and
results with a null id or conversation are `null_id_call` and `null_id_result`, unreadable
lists of calls `malformed`, messages without calls `no_calls`; none of these is linked or has a
level.  Dependencies on unknown ids are listed as violations and don't hold a call back; calls
in or behind a cycle have a null level; arguments that are no JSON object are one violation and
are null in the canonical form; tools without a schema are one too; texts of any length are
kept whole; empty tables give an empty result; only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, stored, table, word_count

CALL = "array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"
KEY = ["conv_id", "call_id"]


def parse_calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, name, arguments, depends_on, problem from the JSON lists in column tool_calls (null: none)."""
    listed = F.from_json("tool_calls", CALL)
    calls = messages.select("conv_id", "turn", "tool_calls", listed.alias("list"), F.explode_outer(listed).alias("c"))
    empty = F.col("tool_calls").isNull() | (F.size("list") == 0)
    problem = F.when(empty, "no_calls").when(F.col("c").isNull(), "malformed").when(F.col("c.id").isNull() | F.col("conv_id").isNull(), "null_id_call")
    return calls.select(
        "conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", F.when(problem == "malformed", F.col("tool_calls")).otherwise(F.col("c.arguments")).alias("arguments"),
        F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"), problem.alias("problem"),
    )


def link_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Full outer hash join of calls and results (conv_id, turn, call_id, content) by identifier, and every row that has no part in it."""
    odd = calls.where("problem is not null").select("*", F.lit(1).alias("n_calls"), F.lit(0).alias("n_results"), F.col("problem").alias("status"))
    nameless = F.col("call_id").isNull() | F.col("conv_id").isNull()
    lost = results.where(nameless).select("conv_id", "turn", "call_id", "content", F.lit(0).alias("n_calls"), F.lit(1).alias("n_results"), F.lit("null_id_result").alias("status"))
    each_call = stored(calls.where("problem is null").groupBy(*KEY, F.struct("turn", "name", "arguments", "depends_on").alias("call")).agg(F.count(F.lit(1)).alias("k")))
    each_result = stored(results.where(~nameless).groupBy(*KEY, F.struct("turn", "content").alias("result")).agg(F.count(F.lit(1)).alias("k")))
    first_call = each_call.groupBy(*KEY).agg(F.min("call").alias("call"), F.sum("k").alias("n_calls"))
    first_result = each_result.groupBy(*KEY).agg(F.min("result").alias("result"), F.sum("k").alias("n_results"))
    status = (
        F.when(F.col("call").isNull(), "orphan_result")
        .when(F.col("result").isNull(), "no_result")
        .when(F.col("result.turn") < F.col("call.turn"), "result_before_call")
        .otherwise("linked")
    )
    linked = (
        first_call.join(first_result.hint("shuffle_hash"), KEY, "full_outer")
        .select(*KEY, "call.turn", "call.name", "call.arguments", "call.depends_on", "result.content",
                F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"))
    )

    def repeated(each: DataFrame, first: DataFrame, x: str) -> DataFrame:
        several = first.where(f"n_{x}s > 1").select(*KEY, F.col(x).alias("first"))
        again = each.join(several, KEY).withColumn("k", F.col("k") - (F.col(x) == F.col("first")).cast("int")).where("k > 0")
        return again.select(*KEY, f"{x}.*", F.col("k").alias(f"n_{x}s"), F.lit(f"duplicate_{x}").alias("status"))

    for part in (odd.drop("problem"), lost, repeated(each_call, first_call, "call"), repeated(each_result, first_result, "result")):
        linked = linked.unionByName(part, allowMissingColumns=True)
    none = F.lit(0)
    return linked.withColumn("n_calls", F.coalesce("n_calls", none)).withColumn("n_results", F.coalesce("n_results", none))


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of `calls` (conv_id, call_id, depends_on): 0 without dependencies, else one above the deepest.

    Calls with one dependency form chains; each finds the head of its chain (a call with none or
    several) and its distance by doubling pointers.  Then the heads alone are peeled level by level.
    """
    nodes = calls.select(*KEY).distinct()
    wanted = calls.select("conv_id", F.explode("depends_on").alias("src"), F.col("call_id").alias("dst")).distinct()
    edges = stored(wanted.join(nodes.withColumnRenamed("call_id", "src"), ["conv_id", "src"], "left_semi"))
    into = edges.groupBy("conv_id", F.col("dst").alias("call_id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src"))
    single = F.coalesce("n", F.lit(0)) == 1
    chains = stored(
        nodes.join(into, KEY, "left").select(
            *KEY, F.when(single, F.col("src")).otherwise(F.col("call_id")).alias("head"), single.cast("long").alias("dist"), (~single).alias("ready"), F.coalesce("n", F.lit(0)).alias("n")
        )
    )
    several = chains.where("n > 1").select(*KEY)
    reached, total = 1, chains.count()
    while reached <= total and not chains.where("not ready").isEmpty():
        onward = chains.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("dist").alias("more"), F.col("ready").alias("there"))
        moved = chains.where("not ready").join(onward, ["conv_id", "head"]).select(*KEY, F.col("next").alias("head"), (F.col("dist") + F.col("more")).alias("dist"), F.col("there").alias("ready"), "n")
        chains, reached = stored(chains.where("ready").unionByName(moved)), reached * 2
    # what is not ready by now turns in a circle and gets no level
    known = chains.where("n = 0").select(*KEY, F.lit(0).cast("long").alias("level"))
    if not several.isEmpty():
        to = chains.where("ready").select("conv_id", F.col("call_id").alias("src"), "head", "dist")
        arcs = stored(edges.join(several.withColumnRenamed("call_id", "dst"), ["conv_id", "dst"], "left_semi").join(to, ["conv_id", "src"], "left"))
        waiting, done = stored(several), [stored(known)]
        while not waiting.isEmpty():
            levels = done[0]
            for d in done[1:]:
                levels = levels.unionByName(d)
            above = arcs.join(levels.select("conv_id", F.col("call_id").alias("head"), "level"), ["conv_id", "head"], "left")
            full = above.groupBy("conv_id", F.col("dst").alias("call_id")).agg(F.max(F.col("level") + F.col("dist") + 1).alias("level"), F.count("level").alias("have"), F.count(F.lit(1)).alias("all"))
            found = stored(full.where("have = all").select(*KEY, "level").join(waiting, KEY, "left_semi"))
            if found.isEmpty():
                break
            waiting = stored(waiting.join(found, KEY, "left_anti"))
            done.append(found)
        known = done[0]
        for d in done[1:]:
            known = known.unionByName(d)
    heads = known.select("conv_id", F.col("call_id").alias("head"), F.col("level").alias("base"))
    placed = chains.join(heads, ["conv_id", "head"], "left")
    return placed.select(*KEY, F.when(F.col("ready"), F.col("base") + F.col("dist")).cast("int").alias("level"))


def validate(calls: DataFrame, schemas: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`calls` plus args (variant) and violations (sorted array).

    `schemas`: name, field, type (string, integer, number, boolean, array, object), required,
    least, most (numbers, or lengths of strings).  A field's rules are checked inside the row.
    """
    rules = stored(
        schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("field", "type", "required", "least", "most"))).alias("rules"))
    )  # a row a tool, its fields only
    known = calls.join(small(rules, broadcast_rows), "name", "left").withColumn("args", F.try_parse_json("arguments"))
    known = known.withColumn("_fields", F.expr("try_cast(args as map<string, variant>)"))

    def broken(rule):
        value = F.element_at(F.col("_fields"), rule["field"])
        kind = F.regexp_extract(F.call_function("schema_of_variant", value), r"^[A-Z]+", 0)
        actual = (
            F.when(kind == "STRING", "string").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(kind.isin("DOUBLE", "DECIMAL", "FLOAT"), "number")
            .when(kind == "BOOLEAN", "boolean").when(kind == "ARRAY", "array").when(kind == "OBJECT", "object").otherwise("null")
        )
        amount = F.when(actual == "string", F.length(value.cast("string")).cast("double")).when(actual.isin("integer", "number"), value.cast("double"))
        fits = (actual == rule["type"]) | ((rule["type"] == "number") & (actual == "integer"))
        return (
            F.when(value.isNull(), F.when(rule["required"], F.concat(F.lit("missing:"), rule["field"])))
            .when(~fits, F.concat(F.lit("type:"), rule["field"]))
            .when((amount < rule["least"]) | (amount > rule["most"]), F.concat(F.lit("range:"), rule["field"]))
        )

    unknown = F.transform(
        F.array_except(F.map_keys("_fields"), F.transform("rules", lambda r: r["field"])), lambda k: F.concat(F.lit("unknown:"), k)
    )
    found = (
        F.when(F.col("rules").isNull(), F.array(F.lit("no_schema")))
        .when(F.col("_fields").isNull(), F.array(F.lit("not_an_object")))
        .otherwise(F.array_sort(F.concat(F.array_compact(F.transform("rules", broken)), unknown)))
    )
    return known.withColumn("violations", found).drop("_fields", "rules")


def canonical(linked: DataFrame) -> DataFrame:
    """`linked` plus canonical: arguments, id, name and result as JSON with sorted keys."""
    whole = F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"))
    return linked.withColumn("canonical", F.to_json(whole, {"ignoreNullFields": "false"}))


def link_tool_calls(messages: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for every call, result and message without calls: conv_id, call_id, turn, name, level, status, n_calls, n_results, violations, canonical."""
    linked = stored(link_results(parse_calls(messages), results))
    calls = linked.where(F.col("status").isin("linked", "no_result", "result_before_call"))
    levels = topological_levels(calls)
    checked = validate(linked, schemas)
    unknown = calls.select("conv_id", "call_id", F.explode("depends_on").alias("src"))
    ids = calls.select("conv_id", F.col("call_id").alias("src"))
    dangling = unknown.join(ids, ["conv_id", "src"], "left_anti").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.concat(F.lit("dependency:"), "src"))).alias("dangling"))
    # a duplicate has the id of its call, but neither its level nor its dependencies
    placed = levels.join(dangling, KEY, "left").withColumn("placed", F.lit(True))
    own = checked.withColumn("placed", F.when(F.col("status").isin("linked", "no_result", "result_before_call"), True))
    out = canonical(own.join(placed, [*KEY, "placed"], "left"))
    is_call = ~F.col("status").isin("orphan_result", "duplicate_result", "null_id_result", "no_calls", "malformed")
    every = F.concat(F.col("violations"), F.coalesce("dangling", F.array().cast("array<string>")))
    return out.select(
        *KEY, "turn", "name", "level", "status", "n_calls", "n_results", F.when(is_call, F.array_sort(every)).alias("violations"),
        F.when(~F.col("status").isin("no_calls", "malformed"), F.col("canonical")).alias("canonical"),
    )


def conversation_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table `conversations` read as tool traffic: every user turn is a call whose arguments
    are its text, every assistant turn is the result of the turn before, calls depend on the call
    two turns earlier.  The tool is chosen by the number of words.  Turns of other roles are
    messages without calls."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", word_count(F.col("text")).alias("words"))

    def call_id(turn):
        return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    before = F.when(F.col("turn") >= 2, call_id(F.col("turn") - 2))
    arguments = F.to_json(F.struct(F.col("words").alias("limit"), F.col("text").alias("query"), before.alias("after")))
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("report")), (F.col("words") % 3 + 1).cast("int"))
    call = F.struct(call_id(F.col("turn")).alias("id"), name.alias("name"), arguments.alias("arguments"), F.array_compact(F.array(before)).alias("depends_on"))
    asks = F.when(F.col("role") == "user", F.to_json(F.array(call)))
    messages = turns.where(~F.col("role").eqNullSafe("assistant")).select("conv_id", "turn", asks.alias("tool_calls"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    rules = [
        ("search", "query", "string", True, 1.0, 200.0), ("search", "limit", "integer", True, 1.0, 40.0), ("search", "after", "string", False, None, None),
        ("lookup", "query", "string", True, 1.0, 400.0), ("lookup", "limit", "integer", True, 1.0, 60.0), ("lookup", "after", "string", True, None, None),
        ("report", "topic", "string", True, None, None), ("report", "query", "string", False, None, None), ("report", "limit", "number", False, 1.0, None),
    ]
    schemas = spark.createDataFrame(rules, "name string, field string, type string, required boolean, least double, most double")
    return messages, results, schemas


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_tool_calls(*conversation_calls(spark, sf_dir))
    return linked.select(
        "conv_id", "call_id", F.col("turn").cast("int").alias("turn"), "name", F.col("level").cast("int").alias("level"), "status",
        F.concat_ws(",", "violations").alias("violations"), "canonical",
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS INT) AS turn, role, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations
), calls AS (
  SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, ['search', 'lookup', 'report'][words % 3 + 1] AS name, text, words,
    CASE WHEN turn >= 2 THEN 'c' || conv_id || '-' || (turn - 2) END AS after
  FROM t WHERE role = 'user'
), results AS (
  SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, text AS content FROM t WHERE role = 'assistant'
), known AS (
  SELECT c.*, p.call_id IS NOT NULL AS chained FROM calls c LEFT JOIN calls p ON c.conv_id = p.conv_id AND c.after = p.call_id
), levels AS (
  SELECT *, turn // 2 - max(CASE WHEN chained THEN NULL ELSE turn // 2 END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS level FROM known
), checked AS (
  SELECT *, list_sort(list_filter([
    CASE WHEN after IS NULL AND name = 'lookup' THEN 'missing:after' END,
    CASE WHEN after IS NOT NULL AND name = 'report' THEN 'unknown:after' END,
    CASE WHEN name = 'report' THEN 'missing:topic' END,
    CASE WHEN name = 'search' AND NOT words BETWEEN 1 AND 40 THEN 'range:limit' WHEN name = 'lookup' AND NOT words BETWEEN 1 AND 60 THEN 'range:limit' WHEN name = 'report' AND words < 1 THEN 'range:limit' END,
    CASE WHEN text IS NULL AND name <> 'report' THEN 'missing:query' WHEN name = 'search' AND NOT length(text) BETWEEN 1 AND 200 THEN 'range:query' WHEN name = 'lookup' AND NOT length(text) BETWEEN 1 AND 400 THEN 'range:query' END,
    CASE WHEN after IS NOT NULL AND NOT chained THEN 'dependency:' || after END
  ], lambda x: x IS NOT NULL)) AS v FROM levels
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, turn, name, CAST(level AS INT) AS level,
  CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  coalesce(array_to_string(v, ','), '') AS violations,
  CASE WHEN c.call_id IS NULL THEN '{"arguments":null' ELSE '{"arguments":{' || coalesce('"after":"' || after || '",', '') || '"limit":' || words || coalesce(',"query":' || CAST(to_json(text) AS VARCHAR), '') || '}' END
    || ',"id":"' || coalesce(c.call_id, r.call_id) || '","name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS canonical
FROM checked c FULL OUTER JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
UNION ALL SELECT conv_id, NULL, turn, NULL, NULL, 'no_calls', '', NULL FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
