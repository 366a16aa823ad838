"""Tool-call linking for chat data: calls and results joined by identifier, ordered, validated and serialised.

``link`` takes calls (conv_id, call_id, turn, name, arguments: JSON text, after: the call_id whose result it uses, an
array of several, or null) and results (conv_id, call_id, turn, content). Everything is DataFrame operations:

* a shuffled hash join by (conv_id, call_id); a call's result is the one of the lowest turn, further ones count in
  ``n_results``; calls without result are ``unanswered``, results without call ``orphan``;
* topological order of the graph of ``after``: ``depth`` is the number of calls before it on the longest way to it; -1
  in and behind a circle; ids in ``after`` that do not exist or are repeated do not count. Chains of calls with one
  predecessor are spanned by pointer doubling in a logarithmic number of joins; calls with several are then resolved in
  as many rounds as lie on one way, and only such calls take part;
* arguments against a schema by tool name: ``errors`` lists what is missing, unknown or of another type;
* canonical JSON: sorted keys, no blanks, from Spark's variant form of the arguments.

Null ids never link; of repeated (conv_id, call_id) the lowest turn counts, then the smallest arguments. Null
arguments are no JSON. Other columns of either table are ignored, whatever their names. Empty tables give no rows. Texts
of any length stay whole; nothing but the row itself grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .text import cut_lineage

KEY = ["conv_id", "call_id"]
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "DOUBLE", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def _fits(value: Column, kind: str) -> Column:
    found = F.schema_of_variant(value)
    if kind == "number":
        return (found == "BIGINT") | (found == "DOUBLE") | found.startswith("DECIMAL")
    return found.startswith(TYPES[kind])


def argument_errors(name: Column, parsed: Column, schemas: dict[str, dict]) -> Column:
    """Array of error texts for arguments in variant form."""
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, schema in schemas.items():
        checks = []
        for field, kind in schema["properties"].items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            wrong = F.when(value.isNotNull() & ~_fits(value, kind), F.lit(f"{field} is not {kind}"))
            checks.append(wrong.when(value.isNull(), F.lit(f"{field} is missing")) if field in schema.get("required", ()) else wrong)
        extra = F.array_except(F.json_object_keys(F.to_json(parsed)), F.array(*map(F.lit, schema["properties"])))
        known = F.array_compact(F.array(*checks))
        out = F.when(name == tool, F.concat(known, F.transform(extra, lambda k: F.concat(k, F.lit(" is unknown"))))).otherwise(out)
    return F.when(parsed.isNull(), F.array(F.lit("arguments are not JSON"))).otherwise(out)


def _edges(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, after) for each call that another one comes after."""
    several = isinstance(calls.schema["after"].dataType, ArrayType)
    pairs = calls.select(*KEY, F.explode(F.array_distinct("after") if several else F.array("after")).alias("after"))
    return pairs.join(calls.select("conv_id", F.col("call_id").alias("after")), ["conv_id", "after"], "left_semi")


def depths(calls: DataFrame) -> DataFrame:
    """KEY and depth of each call over ``after``: chains by pointer doubling, then calls with several predecessors."""
    edges = cut_lineage(_edges(calls))
    before = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("after").alias("to"))
    first = calls.select(*KEY).join(before, KEY, "left").withColumn("several", F.coalesce(F.col("n") > 1, F.lit(False)))
    chained = F.col("n") == 1
    # to: where a call's pointer is; head: where its chain begins, once the pointer has come there; depth: the way so far
    state = cut_lineage(first.select(*KEY, "several", F.when(chained, F.col("to")).alias("to"), F.when(F.coalesce(chained, F.lit(False)), None).otherwise(F.col("call_id")).alias("head"), F.coalesce(chained, F.lit(False)).cast("long").alias("depth")))
    # a pointer spans twice as many calls each round; what is left when it would span all of them runs in a circle
    for _ in range(state.count().bit_length()):
        if not state.where("to IS NOT NULL").limit(1).count():
            break
        up = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("head").alias("found"), F.col("depth").alias("more"))
        state = cut_lineage(state.join(up, ["conv_id", "to"], "left").select(*KEY, "several", F.col("next").alias("to"), F.coalesce("head", "found").alias("head"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    joined = state.join(_joins(state, edges), ["conv_id", "head"], "left") if state.where("several").limit(1).count() else state.withColumn("start", F.when(F.col("head").isNotNull(), F.lit(0)))
    return joined.select(*KEY, F.coalesce(F.col("start") + F.col("depth"), F.lit(-1)).alias("depth"))


def _joins(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, head, start: its depth) of the calls that begin chains; those in and behind circles are left out."""
    heads = state.where("head = call_id")
    ways = edges.join(heads.where("several").select(*KEY), KEY, "left_semi").join(state.select("conv_id", F.col("call_id").alias("after"), "head", (F.col("depth") + 1).alias("hop")), ["conv_id", "after"])
    links = cut_lineage(ways.groupBy(*KEY, "head").agg(F.max("hop").alias("hop")))  # a head in a circle is null
    done, known = cut_lineage(heads.where("NOT several").select("conv_id", "head", F.lit(0).cast("long").alias("start"))), -1
    roots = done
    while (n := done.count()) > known:
        known = n
        tried = links.join(done, ["conv_id", "head"], "left").groupBy(*KEY).agg(F.max(F.col("hop") + F.col("start")).alias("start"), F.count("start").alias("there"), F.count("*").alias("all"))
        done = cut_lineage(roots.unionByName(tried.where("`there` = `all`").select("conv_id", F.col("call_id").alias("head"), "start")))
    return done


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and one per result without call: conv_id, call_id, status, depth, n_results, valid, errors, json."""
    ranked = calls.select(*KEY, "turn", "name", "arguments", "after").withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("turn", "arguments")))
    once = cut_lineage(ranked.where("k = 1 AND conv_id IS NOT NULL AND call_id IS NOT NULL").drop("k"))
    answers = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    parsed = F.try_parse_json("arguments")
    joined = once.withColumn("called", F.lit(True)).hint("shuffle_hash").join(answers, KEY, "full").join(depths(once), KEY, "left")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("result").isNull(), "unanswered").otherwise("linked")
    out = joined.withColumns({"status": status, "parsed": parsed, "n_results": F.coalesce("n_results", F.lit(0))})
    out = out.withColumn("errors", F.when(F.col("called"), argument_errors(F.col("name"), F.col("parsed"), schemas)).otherwise(F.array().cast("array<string>")))
    json = F.to_json(F.struct(F.col("parsed").alias("arguments"), "call_id", F.col("result.content").alias("content"), "conv_id", "depth", "name"))
    return out.select(*KEY, "status", "depth", "n_results", (F.col("called").isNotNull() & (F.size("errors") == 0)).alias("valid"), "errors", json.alias("json"))


def from_turns(turns: DataFrame, tool: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain conversations (conv_id, turn, role, text).

    A user turn is a call of ``tool`` with its text as argument, the assistant turn after it the result; a call comes
    after the user turn two before it.
    """
    name = lambda shift: F.concat_ws(":", "conv_id", (F.col("turn") - shift).cast("string"))
    asked = turns.where("role = 'user'")
    arguments = F.to_json(F.struct("text", "turn"))
    calls = asked.select("conv_id", name(0).alias("call_id"), "turn", F.lit(tool).alias("name"), arguments.alias("arguments"), name(2).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


SCHEMAS = {"reply": {"properties": {"text": "string", "turn": "integer"}, "required": ["text", "turn"]}}


def order(linked: DataFrame) -> DataFrame:
    """The rows of ``link`` in topological order within each conversation; results without call come first.

    A sort over ranges of (conv_id, depth, call_id), so that a giant conversation is no single task.
    """
    return linked.orderBy("conv_id", "depth", "call_id")
