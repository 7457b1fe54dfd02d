"""Operator 4: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results are hash-joined by identifier (conversation, call). A call may name the call whose result it uses
(`after`); the calls of a conversation are put in topological order by their depth below the calls that use none. Depths
come from pointer doubling: each round every call's distance and ancestor are joined with its ancestor's, so a chain of
n calls takes log2(n) rounds, however the calls are dealt, and no task holds a conversation. Calls on a cycle never
reach a beginning and are marked. Arguments are parsed and checked against the tool's schema (a JSON-schema subset), and
each row becomes one line of canonical JSON: keys sorted, no spaces, text as it is, whole numbers without a fraction, lone
surrogates escaped. `line` numbers a conversation's rows from 1 by depth, then place (`at`; a hash of the identifier where
none is given), then identifier: its lines in this order are the serialised conversation. The numbers are sums over ranges
of depths, then of places, so no window holds a conversation.

Statuses: linked, unanswered (no result), orphan (a result of no call), dangling (uses a call that is not there), cycle,
message (neither call nor result; depth 0 in the order, as are orphans; cycles come last). A linked, unanswered or dangling
call counts as valid if its arguments parse and fit the schema; messages are valid, orphans are not.

Rows with null conversation, call or turn cannot be linked: such calls are unanswered, such results orphans, each a row
without a line number. Repeated calls, results or messages of one identifier become one (the least in order of their
fields), with their number; null arguments are invalid. Arguments that are no JSON, hold a number beyond what Python reads
(infinite, or of over 4300 digits) or are nested too deeply are kept as a string and are invalid. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import ship, stash

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What of a JSON value breaks a schema: type, required, properties, additionalProperties, items, enum, bounds, lengths."""
    found, kind = [], schema.get("type")
    if kind in ("integer", "number"):
        good = isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    else:
        good = kind is None or isinstance(value, _TYPES[kind])
    if not good:
        return [f"{path}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not in enum")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        found.append(f"{path}: length")
    if isinstance(value, int | float) and not isinstance(value, bool) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        found.append(f"{path}: range")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{path}[{i}]")
    return found


def plain(value):
    """A JSON value with whole floats as integers."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _lines(schemas: dict):
    def one(tool, arguments, result, status, call, after, depth, role):
        if status == "message":
            return True, "", canonical({"content": result, "id": call, "role": role})
        if status == "orphan":
            return False, "$: no call", canonical({"content": result, "role": "tool", "tool_call_id": call})
        try:
            value = plain(json.loads(arguments)) if arguments is not None else None
            broken = violations(value, schemas[tool]) if tool in schemas else ["$: unknown tool"]
            errors = canonical("; ".join(broken))[1:-1] if any(map(_LONE.search, broken)) else "; ".join(broken)
            line = canonical({"arguments": value, "id": call, "result": result, "tool": tool} | ({"after": after} if after is not None else {}) | ({"depth": depth} if depth is not None else {}))
        except (ValueError, OverflowError, RecursionError) as e:
            return False, "$: nested too deeply" if isinstance(e, RecursionError) else "$: not JSON", canonical({"arguments": arguments, "id": call, "result": result, "tool": tool})
        return not broken and status != "cycle", errors, line

    def lines(batches):
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tool", "arguments", "result", "status", "call_id", "after", "depth", "role")]
            made = [one(*x) for x in zip(*cols, strict=True)]
            kept = [batch.schema.get_field_index(c) for c in ("conv_id", "line", "call_id", "tool", "depth", "status", "repeats")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array([m[0] for m in made], pa.bool_()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())],
                ["conv_id", "line", "call_id", "tool", "depth", "status", "repeats", "valid", "errors", "json"],
            )

    return lines


_LONE = re.compile("[\ud800-\udfff]")


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth (null: on or below a cycle), dangling, for calls(conv_id, call_id, after), identifiers unique."""
    names = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    now = calls.select("conv_id", "call_id", "after").join(names, ["conv_id", "after"], "left")
    now = stash(now.select("conv_id", "call_id", F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"), (F.col("after").isNotNull() & F.col("there").isNull()).alias("dangling")), "depths")
    n = now.count()
    for _ in range(max(1, n).bit_length() + 1):
        if not now.where("up is not null").limit(1).count():
            break
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        now = stash(now.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "dangling"), "depths")
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), "dangling")


#: Depths, and places of one depth, whose rows are counted together before they are numbered.
SPAN = 4096


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `line`: their place from 1 among the rows of conv_id by level, at and call_id."""
    keyed = rows.withColumn("_b", F.floor(F.col("level") / SPAN)).withColumn("_p", F.floor(F.col("at") / SPAN))
    places = keyed.groupBy("conv_id", "_b", "level", "_p").agg(F.count(F.lit(1)).alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    spans = places.groupBy("conv_id", "_b").agg(F.sum("n").alias("n")).select("conv_id", "_b", F.coalesce(F.sum("n").over(before("conv_id").orderBy("_b")), F.lit(0)).alias("_s"))
    places = places.join(spans, ["conv_id", "_b"]).select("conv_id", "level", "_p", (F.col("_s") + F.coalesce(F.sum("n").over(before("conv_id", "_b").orderBy("level", "_p")), F.lit(0))).alias("_s"))
    own = F.row_number().over(Window.partitionBy("conv_id", "level", "_p").orderBy("at", "call_id"))
    return keyed.join(places, ["conv_id", "level", "_p"]).withColumn("line", F.col("_s") + own).drop("_s", "_p", "_b")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict, messages: DataFrame | None = None) -> DataFrame:
    """conv_id, line, call_id, tool, depth, status, repeats, valid, errors, json: a row per call, message, and result of no call.

    calls: conv_id, call_id, tool, arguments (JSON), after; results: conv_id, call_id, content; messages: conv_id, call_id,
    role, content. Each may have `at`, a whole number by which rows of equal depth are ordered.
    """
    ship(calls.sparkSession)
    place = lambda df: F.col("at").cast("long") if "at" in df.columns else F.lit(None).cast("long")
    calls = calls.select("conv_id", "call_id", "tool", "arguments", "after", place(calls).alias("at"))
    results = results.select("conv_id", "call_id", F.col("content").alias("result"), place(results).alias("at"))
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    once = calls.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("tool", "arguments", "after", "at")).alias("c"), F.count(F.lit(1)).alias("repeats"))
    once = stash(once.select("conv_id", "call_id", "c.*", "repeats"), "calls")
    answers = results.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("result", "at")).alias("r"), F.count(F.lit(1)).alias("answers")).select("conv_id", "call_id", "r.result", F.col("r.at").alias("answered"), "answers")
    status = F.when(F.col("depth").isNull(), "cycle").when(F.col("dangling"), "dangling").when(F.col("answers").isNull(), "unanswered").otherwise("linked")
    both = once.join(answers, ["conv_id", "call_id"], "full_outer").join(depths(once), ["conv_id", "call_id"], "left")
    linked = both.withColumn("status", F.when(F.col("repeats").isNull(), "orphan").otherwise(status)).withColumn("repeats", F.coalesce("repeats", "answers")).withColumn("at", F.when(F.col("status") == "orphan", F.col("answered")).otherwise(F.col("at")))
    kind = calls.schema["conv_id"].dataType.simpleString()
    columns = {"conv_id": kind, "call_id": "string", "tool": "string", "arguments": "string", "after": "string", "result": "string", "depth": "long", "status": "string", "repeats": "long", "role": "string", "at": "long"}

    def shaped(df: DataFrame, **fixed: Column) -> DataFrame:
        return df.select(*[fixed.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    rows, bare = [shaped(linked)], [shaped(calls.where(~named), status=F.lit("unanswered"), repeats=F.lit(1)), shaped(results.where(~named), status=F.lit("orphan"), repeats=F.lit(1))]
    if messages is not None:
        messages = messages.select("conv_id", "call_id", "role", F.col("content").alias("result"), place(messages).alias("at"))
        said = messages.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("role", "result", "at")).alias("m"), F.count(F.lit(1)).alias("repeats")).select("conv_id", "call_id", "m.*", "repeats")
        rows.append(shaped(said, status=F.lit("message")))
        bare.append(shaped(messages.where(~named), status=F.lit("message"), repeats=F.lit(1)))
    level = F.when(F.col("status").isin("orphan", "message"), F.lit(0)).otherwise(F.coalesce("depth", F.lit((1 << 53)))).cast("long")
    at = F.coalesce("at", F.pmod(F.xxhash64("call_id"), F.lit(1 << 31)))
    whole = numbered(reduce(DataFrame.union, rows).withColumn("level", level).withColumn("at", at)).select(*columns, "line")
    every = whole.union(reduce(DataFrame.union, bare).select(*columns, F.lit(None).cast("long").alias("line")))
    return every.mapInArrow(_lines(schemas), f"conv_id {kind}, line long, call_id string, tool string, depth long, status string, repeats long, valid boolean, errors string, json string")


#: The tool that plain turns are calls of.
ANSWER = {
    "answer": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain conversations as calls, results and messages, so that every turn is in one of them.

    A user's turn calls `answer`, and the assistant's next turn is its result. A call uses the result of the user's turn two
    before it. Turns of other roles (system, tool, unknown, null) are messages. Turns repeated with other texts are rows of
    their own, told apart by the text's digest; the one whose digest is least has the plain identifier.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = turns.select("conv_id", "turn", "role", "text", digest.alias("digest"))
    several = rows.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r")).agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least != most")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & F.col("role").eqNullSafe(F.col("r"))
    other = F.when(F.col("digest") != F.col("least"), F.concat(F.lit("~"), F.col("digest"))).otherwise(F.lit(""))
    rows = rows.join(several, same, "left").withColumn("other", F.coalesce(other, F.lit("")))
    name = lambda kind, t: F.concat(F.lit(kind), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")), {"ignoreNullFields": "false"})
    after = F.when(F.col("turn") >= 2, name("c", F.col("turn") - 2))
    turn, at = F.col("turn"), F.col("turn").cast("long").alias("at")
    calls = rows.where("role = 'user'").select("conv_id", F.concat(name("c", turn), "other").alias("call_id"), F.lit("answer").alias("tool"), arguments.alias("arguments"), after.alias("after"), at)
    results = rows.where("role = 'assistant'").select("conv_id", F.concat(name("c", turn - 1), "other").alias("call_id"), F.col("text").alias("content"), at)
    rest = rows.where("role is null or role not in ('user', 'assistant')")
    return calls, results, rest.select("conv_id", F.concat(name("m", turn), F.lit("-"), F.coalesce("role", F.lit("")), "other").alias("call_id"), "role", F.col("text").alias("content"), at)
