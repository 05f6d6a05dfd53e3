"""Chat formatting: calls and results hash-joined by identifier, put in topological order, checked against schemas, and
written as canonical JSON. DataFrame operations only.

calls: conv_id, turn, call_id, name, arguments (JSON text). results: conv_id, turn, call_id, content. A link is one row of
the full outer join on (conv_id, call_id) of the first call and the first result of each identifier: a call without a
result and a result without a call stay, with nulls. Every other call and result of an identifier has a row of its own,
with the error `repeated call` or `repeated result`, so no text is lost; rows that are equal in all columns are one row,
and n_copies says how many. Firsts and copies are counted by aggregation before anything is joined, so an identifier that
holds a third of all rows costs each task a few rows; adaptive execution splits the join of repeated rows.

Canonical JSON has sorted keys at every depth, no white space, and nulls written out. Arguments are parsed as variants,
whose objects keep their keys in order. Validation says which rule an argument breaks. A schema gives each parameter a
type (string, integer, number, boolean, array, object) and, if wanted, required, min_length, max_length, minimum, maximum.

Levels: a node comes after all its parents. Where every node has one parent at most, ancestors are found by pointer
doubling, so a chain of k turns takes log2(k) joins, and each join is on single nodes, however long one conversation is.
Where a node has several, levels are given rank by rank, one join a rank. Nodes on or behind a cycle have a null level.

Defined results: a null conversation, identifier or turn equals nothing: such calls and results are never linked, have
rows of their own, and no level; null and empty texts are null and empty strings and break the rules of their schema; an
unknown name breaks `unknown tool`; ties are broken by turn, then text; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.llm.common import dropped, table, written

#: name -> parameter -> rules
SCHEMAS = {
    "reply": {"text": {"type": "string", "required": True, "min_length": 1, "max_length": 1000}, "turn": {"type": "integer", "required": True, "minimum": 1}},
    "configure": {"text": {"type": "string", "required": True, "min_length": 1}, "turn": {"type": "integer", "required": True, "maximum": 0}},
}
# How a variant names the types of a schema.
VARIANT_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>"}


def _scalar(column: Column) -> Column:
    """JSON of one value; null is null."""
    text = F.to_json(F.array(column))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _object(**members: Column) -> Column:
    """JSON object of members that are JSON already, in order of key."""
    parts = [F.concat(F.lit(f'"{key}":'), F.coalesce(value, F.lit("null"))) for key, value in sorted(members.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical(json: Column) -> Column:
    """Sorted keys, no white space; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(json))


def _broken(parsed: Column, parameter: str, rules: dict) -> list[Column]:
    """One column for each rule of a parameter: what it says if the rule is broken, else null."""
    path, none = f"$.{parameter}", F.lit(None).cast("string")
    value = F.try_variant_get(parsed, path, "variant")
    missing = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))
    fits = F.coalesce(F.schema_of_variant(value).rlike(f"^{VARIANT_TYPES[rules['type']]}$"), F.lit(False))
    out = [F.when(missing, F.lit(f"{parameter}: missing") if rules.get("required") else none).when(~fits, F.lit(f"{parameter}: not {rules['type']}"))]
    size, number = F.length(F.try_variant_get(parsed, path, "string")), F.try_variant_get(parsed, path, "double")
    tests = {"min_length": (size < F.lit(rules.get("min_length")), "too short"), "max_length": (size > F.lit(rules.get("max_length")), "too long"),
             "minimum": (number < F.lit(rules.get("minimum")), "too small"), "maximum": (number > F.lit(rules.get("maximum")), "too large")}
    return out + [F.when(fits & broken, F.lit(f"{parameter}: {said}")) for rule, (broken, said) in tests.items() if rule in rules]


def violations(name: Column, arguments: Column, schemas=None) -> Column:
    """The rules that the arguments break, in order."""
    parsed = F.try_parse_json(arguments)
    out = F.array(F.lit("unknown tool"))
    for tool, parameters in (SCHEMAS if schemas is None else schemas).items():
        found = [F.when(parsed.isNull() | ~F.schema_of_variant(parsed).rlike("^OBJECT"), F.lit("not an object"))]
        for parameter, rules in parameters.items():
            found += _broken(parsed, parameter, rules)
        out = F.when(name == tool, F.array_compact(F.array(*found))).otherwise(out)
    return F.when(name.isNull(), F.array(F.lit("unknown tool"))).otherwise(out)


def _firsts(rows: DataFrame, value: str, n: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, call_id, value): the first of each identifier with how many it has; and the others, each distinct
    one with its copies. What has no identifier is among the others."""
    keys = ["conv_id", "call_id"]
    distinct = rows.groupBy(*keys, value).agg(F.count("*").alias("n_copies"))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col(f"{value}.turn").isNotNull()
    mine = F.struct(value, "n_copies")
    first = distinct.filter(known).groupBy(*keys).agg(F.min(mine).alias("f"), F.sum("n_copies").alias(n)).select(*keys, F.col(f"f.{value}").alias(value), F.col("f.n_copies").alias(f"{n}_same"), n)
    least = first.select(*keys, F.col(value).alias("least"), n)
    repeated = distinct.filter(known).join(least, keys).filter(~F.col(value).eqNullSafe(F.col("least"))).select(*keys, value, "n_copies", n, F.lit(True).alias("repeated"))
    loose = distinct.filter(~known).select(*keys, value, "n_copies", F.lit(1).cast("bigint").alias(n), F.lit(False).alias("repeated"))
    return first, repeated.union(loose)


def link(calls: DataFrame, results: DataFrame, schemas=None) -> DataFrame:
    """conv_id, call_id, turn, name, result_turn, n_calls, n_results, n_copies, errors, valid and json of each link."""
    keys = ["conv_id", "call_id"]
    text = lambda c: F.col(c).cast("string").alias(c)
    turn = F.col("turn").cast("bigint").alias("turn")
    asked, more_asked = _firsts(calls.select(*map(text, keys), F.struct(turn, "name", "arguments").alias("c")), "c", "n_calls")
    given, more_given = _firsts(results.select(*map(text, keys), F.struct(turn, "content").alias("r")), "r", "n_results")
    none, zero = F.lit(None), F.lit(0).cast("bigint")
    columns = [*keys, "c", "r", "n_calls", "n_results", "n_copies", "repeated"]
    both = asked.join(given.hint("shuffle_hash"), keys, "full_outer").withColumn("n_copies", F.greatest("n_calls_same", "n_results_same")).withColumn("repeated", F.lit(False)).select(columns)
    only_calls = more_asked.withColumns({"r": none.cast(given.schema["r"].dataType), "n_results": zero}).select(columns)
    only_results = more_given.withColumns({"c": none.cast(asked.schema["c"].dataType), "n_calls": zero}).select(columns)
    df = both.union(only_calls).union(only_results)
    is_call, answered = F.col("c").isNotNull(), F.col("r").isNotNull()
    df = df.select(*keys, F.col("c.turn").alias("turn"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"),
                   is_call.alias("is_call"), answered.alias("answered"), *(F.coalesce(n, zero).alias(n) for n in ("n_calls", "n_results")), "n_copies", "repeated")
    said = F.when(F.col("is_call"), violations(F.col("name"), F.col("arguments"), schemas)).otherwise(F.when(F.col("repeated"), F.array().cast("array<string>")).otherwise(F.array(F.lit("no call"))))
    also = F.array_compact(F.array(F.when(F.col("repeated"), F.when(F.col("is_call"), F.lit("repeated call")).otherwise(F.lit("repeated result"))), F.when(F.col("result_turn") < F.col("turn"), F.lit("result before call"))))
    df = df.withColumn("errors", F.concat(said, also)).withColumn("valid", F.size("errors") == 0)
    result = F.when(F.col("answered"), _object(content=_scalar(F.col("content")), turn=_scalar(F.col("result_turn"))))
    call = F.when(F.col("is_call"), _object(arguments=canonical(F.col("arguments")), name=_scalar(F.col("name")), turn=_scalar(F.col("turn"))))
    json = _object(call=call, errors=F.to_json("errors"), id=_scalar(F.col("call_id")), result=result, valid=_scalar(F.col("valid")))
    return df.select(*keys, "turn", "name", "result_turn", "n_calls", "n_results", "n_copies", "errors", "valid", json.alias("json"))


def levels(nodes: DataFrame) -> DataFrame:
    """id and level of each node; nodes has a row (id, parent) for each parent, with a null one where there is none. A
    parent that is no node counts as none. A level is one more than the largest of the parents'."""
    ids = nodes.filter("id is not null").select("id").distinct()
    edges = nodes.filter("id is not null").select("id", "parent").distinct().join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")
    known = written(ids.join(edges.groupBy("id").agg(F.min("parent").alias("parent"), F.count("*").alias("n")), "id", "left"))
    if known.filter("n > 1").limit(1).count():
        out = _by_rank(known.select("id"), edges)
    else:
        out = _by_doubling(known.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("level")))
    dropped(known)
    return out


def _by_doubling(start: DataFrame) -> DataFrame:
    open_ = written(start)
    total, covered = open_.count(), 1
    while covered <= total and open_.filter("up is not null").limit(1).count():
        ends = open_.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        moved = open_.filter("up is not null").join(ends, "up").select("id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        # nodes that have arrived stay: others still point at them
        after = written(moved.union(open_.filter("up is null")))
        dropped(open_)
        open_, covered = after, covered * 2
    return open_.select("id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def _by_rank(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranks are given to nodes all of whose parents have one, until no node gets one."""
    waiting = written(edges.select("id", "parent"))
    first = written(ids.join(waiting.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).cast("bigint").alias("level")))
    ranks, new = [first], first
    while new.limit(1).count():
        rest = written(waiting.join(new.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent"))
        ready = waiting.select("id").distinct().join(rest.select("id").distinct(), "id", "left_anti")
        new = written(ready.select("id", F.lit(len(ranks)).cast("bigint").alias("level")))
        # the others wait for the parents that are left; a node's rank is that of its last parent, and one
        still = written(rest)
        dropped(rest, waiting)
        waiting = still
        ranks.append(new)
    out = ranks[0]
    for more in ranks[1:]:
        out = out.union(more)
    return out.union(waiting.select("id").distinct().select("id", F.lit(None).cast("bigint")))


#: Turns of a conversation that one window sorts; what is before them comes from an aggregate.
TURNS = 1024


def with_previous(turns: DataFrame) -> DataFrame:
    """conv_id, turn and before: the turn before it that exists. A long conversation is cut into stretches of TURNS."""
    df = turns.select("conv_id", "turn").filter("conv_id is not null and turn is not null").distinct().withColumn("stretch", F.floor(F.col("turn") / TURNS))
    ends = df.groupBy("conv_id", "stretch").agg(F.max("turn").alias("last"))
    ends = ends.select("conv_id", "stretch", F.lag("last").over(W.partitionBy("conv_id").orderBy("stretch")).alias("earlier"))
    own = F.lag("turn").over(W.partitionBy("conv_id", "stretch").orderBy("turn"))
    return df.withColumn("own", own).join(ends, ["conv_id", "stretch"]).select("conv_id", "turn", F.coalesce("own", "earlier").alias("before"))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and nodes of plain turns: a user or system turn calls for a reply, an assistant turn is the result
    of the turn before it, if there is one; every turn comes after the turn before it."""
    df = messages.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ident = lambda turn: F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), F.concat_ws(":", "conv_id", turn.cast("string")))
    asks = F.coalesce(F.col("role"), F.lit("user")) != "assistant"
    order = with_previous(df)
    arguments = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    name = F.when(F.col("role") == "system", "configure").otherwise("reply")
    calls = df.filter(asks).select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    results = df.filter(~asks).join(order, ["conv_id", "turn"], "left").select("conv_id", "turn", ident(F.col("before")).alias("call_id"), F.col("text").alias("content"))
    nodes = order.select(ident(F.col("turn")).alias("id"), ident(F.col("before")).alias("parent"))
    return calls, results, nodes


def query(spark, sf_dir):
    calls, results, nodes = turns_as_calls(table(spark, sf_dir, "conversations"))
    out = link(calls, results).select("conv_id", "call_id", "turn", "name", "result_turn", "n_calls", "n_results", "n_copies", "valid", F.array_join("errors", "; ").alias("errors"), F.sha2("json", 256).alias("json_sha256"), F.length("json").cast("bigint").alias("json_chars"))
    # a link stands where its call does, or its result where there is no call
    at = F.coalesce("turn", "result_turn")
    at = F.when(F.col("conv_id").isNotNull() & at.isNotNull(), F.concat_ws(":", "conv_id", at.cast("string")))
    out = out.withColumn("id", at).join(levels(nodes), "id", "left").drop("id")
    return out.fillna({"turn": -1, "result_turn": -1, "level": -1, "name": "", "call_id": "", "conv_id": ""})


ORACLE = r"""
WITH m AS (SELECT conv_id::VARCHAR AS conv_id, turn, role, text, coalesce(role, 'user') <> 'assistant' AS asks FROM conversations),
t AS (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level FROM t),
cd AS (SELECT conv_id, conv_id || ':' || turn AS call_id, turn, CASE WHEN role = 'system' THEN 'configure' ELSE 'reply' END AS name, text, count(*) AS n_copies FROM m WHERE asks GROUP BY ALL),
cr AS (SELECT *, row_number() OVER w AS k, sum(n_copies) OVER (PARTITION BY conv_id, call_id) AS n FROM cd
        WINDOW w AS (PARTITION BY conv_id, call_id ORDER BY turn, name, to_json({'text': text, 'turn': turn})::VARCHAR)),
rd AS (SELECT m.conv_id, m.conv_id || ':' || before AS call_id, m.turn, text, count(*) AS n_copies FROM m LEFT JOIN o USING (conv_id, turn) WHERE NOT asks GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text NULLS FIRST) AS k, sum(n_copies) OVER (PARTITION BY conv_id, call_id) AS n FROM rd),
l AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, c.name, c.text, c.name IS NOT NULL AS is_call, r.turn AS result_turn, r.text AS content, r.n IS NOT NULL AS answered,
        coalesce(c.n, 0) AS n_calls, coalesce(r.n, 0) AS n_results, greatest(c.n_copies, r.n_copies) AS n_copies, false AS repeated
        FROM (SELECT * FROM cr WHERE k = 1 AND call_id IS NOT NULL) c FULL JOIN (SELECT * FROM rr WHERE k = 1 AND call_id IS NOT NULL) r USING (conv_id, call_id)
      UNION ALL SELECT conv_id, call_id, turn, name, text, true, NULL, NULL, false, CASE WHEN call_id IS NULL THEN 1 ELSE n END, 0, n_copies, call_id IS NOT NULL FROM cr WHERE call_id IS NULL OR k > 1
      UNION ALL SELECT conv_id, call_id, NULL, NULL, NULL, false, turn, text, true, 0, CASE WHEN call_id IS NULL THEN 1 ELSE n END, n_copies, call_id IS NOT NULL FROM rr WHERE call_id IS NULL OR k > 1),
e AS (SELECT *, list_filter([CASE WHEN NOT is_call AND NOT repeated THEN 'no call' END,
        CASE WHEN is_call AND text IS NULL THEN 'text: missing' END, CASE WHEN is_call AND text = '' THEN 'text: too short' END,
        CASE WHEN is_call AND name = 'reply' AND length(text) > 1000 THEN 'text: too long' END,
        CASE WHEN is_call AND turn IS NULL THEN 'turn: missing' END,
        CASE WHEN is_call AND name = 'reply' AND turn < 1 THEN 'turn: too small' END, CASE WHEN is_call AND name = 'configure' AND turn > 0 THEN 'turn: too large' END,
        CASE WHEN repeated THEN CASE WHEN is_call THEN 'repeated call' ELSE 'repeated result' END END], lambda x: x IS NOT NULL) AS errors FROM l),
j AS (SELECT *, '{"call":' || CASE WHEN NOT is_call THEN 'null' ELSE '{"arguments":{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '},"name":"' || name || '","turn":' || coalesce(turn::VARCHAR, 'null') || '}' END
        || ',"errors":' || to_json(errors)::VARCHAR || ',"id":' || coalesce('"' || call_id || '"', 'null') || ',"result":'
        || CASE WHEN answered THEN '{"content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"turn":' || coalesce(result_turn::VARCHAR, 'null') || '}' ELSE 'null' END
        || ',"valid":' || (len(errors) = 0) || '}' AS json FROM e)
SELECT coalesce(j.conv_id, '') AS conv_id, coalesce(call_id, '') AS call_id, coalesce(j.turn, -1) AS turn, coalesce(name, '') AS name, coalesce(result_turn, -1) AS result_turn, n_calls::BIGINT AS n_calls, n_results::BIGINT AS n_results,
  n_copies, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors, sha256(json) AS json_sha256, length(json)::BIGINT AS json_chars, coalesce(level, -1) AS level
FROM j LEFT JOIN o ON o.conv_id = j.conv_id AND o.turn = coalesce(j.turn, j.result_turn)
"""
