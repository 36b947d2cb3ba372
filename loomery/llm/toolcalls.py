"""Tool-call linking for chats: join by identifier, topological order, schema checks, canonical JSON.

DataFrame functions only. Messages (conversation, turn, role, text) give events. An assistant text that is a JSON object
with tool_calls holds calls {id, name, arguments, depends_on}; a tool text with tool_call_id holds a result. Turns
without such JSON are exchanges: a user turn t is a call "reply" with the id "<conversation>:<t>", which depends on
that of t - 2 if there is one, and an assistant turn t + 1 is its result. Other turns are plain messages.

Calls and results meet by (conversation, id). Dependencies that only point back, as they mostly do, make turn order a
topological order, and a result that stands before its call moves right behind it. Where a dependency points forward,
the turns from the first call that has one to the last call so depended on are the conversation's knot: its calls come
in the order of their levels (the longest chain of dependencies inside the knot), each level's results behind it, and
calls on a cycle or waiting for one last; other messages of these turns follow the knot, and what stands before and
after it stays there. Levels take a number of rounds that grows with the logarithm of the longest chain: each round doubles the length of the chains known. Positions
come from one range sort of all events, so a conversation of any size is spread over tasks.

Ids: the first call of a repeated id is linked, later ones are "repeated". Null conversations, turns, roles and texts
form events of their own (null text: empty; null conversations sort first and link with nothing). Malformed JSON is
plain text; malformed arguments fail validation. Rows that repeat give repeated events. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import drop, materialize, partitions

#: tool -> argument -> type (as JSON names it), required, min_length, minimum, one_of
Schemas = dict[str, dict[str, dict]]
REPLY: Schemas = {"reply": {"prompt": {"type": "string", "required": True, "min_length": 1}, "turn": {"type": "integer", "required": True, "minimum": 0}}}
#: Patterns of Spark's names of variant types.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def events(messages: DataFrame) -> DataFrame:
    """conv_id, turn, ord, kind (call, result or message), id, name, arguments, depends_on, content from messages."""
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("v", F.when(F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    call = "array<struct<id: string, name: string, arguments: variant, depends_on: array<string>>>"
    m = m.withColumn("calls", F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", call)))
    m = m.withColumn("answers", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))
    some = m.where("size(calls) > 0").select("conv_id", "turn", F.posexplode("calls").alias("ord", "c"))
    explicit = some.select("conv_id", "turn", "ord", F.lit("call").alias("kind"), "c.id", "c.name", F.to_json("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"), F.lit(None).cast("string").alias("content"))
    rest = m.where("coalesce(size(calls), 0) <= 0")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    user, plain = F.col("role") == "user", F.col("role") == "assistant"
    kind = F.when(F.col("answers").isNotNull() | plain, "result").when(user, "call").otherwise("message")
    args = F.when(user, F.to_json(F.struct(F.col("text").alias("prompt"), "turn")))
    before = F.when(user & (F.col("turn") >= 2), F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    other = rest.select(
        "conv_id", "turn", F.lit(0).alias("ord"), kind.alias("kind"), F.coalesce("answers", F.when(user, name(F.col("turn"))), F.when(plain, name(F.col("turn") - 1))).alias("id"),
        F.when(user, "reply").alias("name"), args.alias("arguments"), before.alias("depends_on"), F.when(~user | F.col("role").isNull(), F.coalesce(F.when(F.col("answers").isNotNull(), F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit(""))), F.col("text"))).alias("content"),
    )
    return explicit.union(other)


def violations(schemas: Schemas) -> Column:
    """The ways in which the call (name, arguments as the variant a) breaks its tool's schema."""
    found: list[Column] = [F.when(F.col("a").isNull(), "arguments: malformed"), F.when(F.col("name").isNull() | ~F.col("name").isin(list(schemas)), "name: unknown tool")]
    for tool, args in schemas.items():
        mine = (F.col("name") == tool) & F.col("a").isNotNull()
        for arg, want in sorted(args.items()):
            v = F.try_variant_get("a", f"$['{arg}']", "variant")
            kind, there = F.schema_of_variant(v), v.isNotNull() & ~F.is_variant_null(v)
            right = there & kind.rlike(f"^({TYPES[want['type']]})$")
            checks = [(there & ~right, "type")]
            if want.get("required"):
                checks.append((~F.coalesce(there, F.lit(False)), "missing"))
            if "min_length" in want:
                checks.append((right & (F.length(F.try_variant_get("a", f"$['{arg}']", "string")) < want["min_length"]), "too short"))
            if "minimum" in want:
                checks.append((right & (F.try_variant_get("a", f"$['{arg}']", "double") < want["minimum"]), "too small"))
            if "one_of" in want:
                checks.append((right & ~F.try_variant_get("a", f"$['{arg}']", "string").isin(want["one_of"]), "not allowed"))
            found += [F.when(mine & test, f"{arg}: {what}") for test, what in checks]
        extra = F.array_except(F.coalesce(F.map_keys(F.from_json("arguments", "map<string,string>")), F.array().cast("array<string>")), F.array(*map(F.lit, sorted(args))).cast("array<string>"))
        found.append(F.when(mine & (F.size(extra) > 0), F.concat(F.array_join(F.array_sort(extra), " "), F.lit(": unexpected"))))
    return F.array_compact(F.array(*found))


def knots(calls: DataFrame) -> DataFrame:
    """(conv_id, knot_from, knot_to): the span of turns that forward dependencies reach over, where there are any."""
    ahead = dependencies(calls).where("t > turn or (t = turn and o > ord)")
    return ahead.groupBy("conv_id").agg(F.min("turn").alias("knot_from"), F.max("t").alias("knot_to"))


def dependencies(calls: DataFrame) -> DataFrame:
    """conv_id, id, turn, ord of calls with a dependency's id, turn and ord as on, t and o."""
    deps = calls.select("conv_id", "id", "turn", "ord", F.explode(F.array_distinct("depends_on")).alias("on")).where("on <> id")
    known = calls.select("conv_id", F.col("id").alias("on"), F.col("turn").alias("t"), F.col("ord").alias("o"))
    return deps.join(known, ["conv_id", "on"])


def levels(calls: DataFrame, spans: DataFrame) -> DataFrame:
    """(conv_id, id, level) for the calls in knots: the longest chain of dependencies there, null on and behind cycles.

    With steps of 2^k dependencies known as pairs, the longest chain below 2^(k+1) from a call is 2^k plus the longest
    below 2^k from where such a step leads, if it has one. Pairs 2^k apart join to pairs 2^(k+1) apart. Calls that still
    have a step longer than all calls of a knot are on a cycle or behind one. Pairs are distinct, as many as calls times
    the calls that lie so far from one: with one dependency a call, as many as calls.
    """
    inside = calls.join(spans, "conv_id").where("turn between knot_from and knot_to")
    step = materialize(dependencies(inside).select("conv_id", "id", "on"), "steps")
    most = inside.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    nodes = materialize(inside.select("conv_id", "id", F.lit(0).cast("long").alias("level")), "levels")
    length = 1
    while length <= most and not step.isEmpty():
        far = step.join(nodes.withColumnsRenamed({"id": "on", "level": "beyond"}), ["conv_id", "on"]).groupBy("conv_id", "id").agg(F.max("beyond").alias("beyond"))
        old, nodes = nodes, nodes.join(far, ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce(F.col("beyond") + length, "level").alias("level"))
        nodes = materialize(nodes, "levels")
        more = step.select("conv_id", "id", F.col("on").alias("via")).join(step.withColumnRenamed("id", "via"), ["conv_id", "via"]).select("conv_id", "id", "on").distinct()
        before, step = step, materialize(more, "steps")
        drop(old, before)
        length *= 2
    stuck = step.select("conv_id", "id").distinct().withColumn("stuck", F.lit(True))
    return nodes.join(stuck, ["conv_id", "id"], "left").select("conv_id", "id", F.when(F.col("stuck").isNull(), F.col("level")).alias("level"))


def link(messages: DataFrame, schemas: Schemas = REPLY) -> DataFrame:
    """conv_id, turn, position (from 0, in topological order), kind, id, status, partner_turn, valid, errors, json.

    status: calls are answered, unanswered, repeated or cyclic; results linked or orphan; messages plain.
    json: keys sorted, no spaces, numbers in shortest form.
    """
    all_ = materialize(events(messages), "events")
    calls = all_.where("kind = 'call' and id is not null and conv_id is not null")
    place = F.struct("turn", "ord", F.xxhash64("name", "arguments"))
    first = materialize(calls.groupBy("conv_id", "id").agg(F.min(place).alias("p")).select("conv_id", "id", F.col("p.turn").alias("turn"), F.col("p.ord").alias("ord"), F.col("p.col3").alias("print")), "calls")
    answer = all_.where("kind = 'result' and id is not null and conv_id is not null").groupBy("conv_id", "id").agg(F.min("turn").alias("answered"))
    meet = first.join(answer, ["conv_id", "id"], "left")
    owners = calls.select("conv_id", "id", "turn", "ord", F.xxhash64("name", "arguments").alias("print"), "depends_on").join(first, ["conv_id", "id", "turn", "ord", "print"]).dropDuplicates(["conv_id", "id"])
    owners = materialize(owners, "owners")
    spans = materialize(knots(owners), "knots")
    level = levels(owners, spans).withColumn("levelled", F.lit(True))
    meet = meet.join(level, ["conv_id", "id"], "left").join(spans, "conv_id", "left").withColumnsRenamed({"turn": "c_turn", "ord": "c_ord", "print": "c_print", "level": "lv"})

    e = all_.join(meet, ["conv_id", "id"], "left")
    is_first = F.coalesce((F.col("turn") == F.col("c_turn")) & (F.col("ord") == F.col("c_ord")) & (F.xxhash64("name", "arguments") == F.col("c_print")), F.lit(False))
    cyclic = F.col("levelled").isNotNull() & F.col("lv").isNull()
    status = F.when(F.col("kind") == "message", "plain").when(F.col("kind") == "result", F.when(F.col("c_turn").isNotNull(), "linked").otherwise("orphan"))
    status = status.when(~is_first, "repeated").when(cyclic, "cyclic").when(F.col("answered").isNotNull(), "answered").otherwise("unanswered")
    e = e.withColumns({"status": status, "partner_turn": F.when(F.col("kind") == "result", F.col("c_turn")).when(is_first, F.col("answered"))})
    e = e.withColumn("a", F.when(F.col("kind") == "call", F.try_parse_json("arguments")))
    e = e.withColumn("errors", F.when(F.col("kind") == "call", violations(schemas)).otherwise(F.array().cast("array<string>")))
    body = F.when(F.col("kind") == "call", F.to_json(F.struct(F.col("a").alias("arguments"), "id", "name", F.lit("call").alias("type"))))
    body = body.when(F.col("kind") == "result", F.to_json(F.struct("content", "id", F.lit("result").alias("type")))).otherwise(F.to_json(F.struct("content", F.lit("message").alias("type"))))
    # events take their turn's place, knots that of their first turn; a result that isn't behind its call goes there
    early = (F.col("kind") == "result") & F.coalesce(F.col("turn") <= F.col("c_turn"), F.lit(False))
    own = F.when(early, F.col("c_turn")).otherwise(F.col("turn"))
    tied = F.coalesce(own.between(F.col("knot_from"), F.col("knot_to")), F.lit(False))
    rank = F.when(~tied, 0).when(cyclic, F.lit(2**62)).otherwise(F.coalesce("lv", F.lit(0)))
    after = F.when(early | (tied & (F.col("kind") == "result") & F.col("levelled").isNotNull()), 1).otherwise(0)
    e = e.withColumns({"place": F.when(tied, F.col("knot_from")).otherwise(own), "rank": rank, "json": body, "tie": F.xxhash64("kind", "id", "arguments", "content")})
    e = e.withColumns({"after": after, "late": F.when(tied, after).otherwise(0), "own": own, "own_ord": F.when(early, F.col("c_ord")).otherwise(F.col("ord"))})

    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("place"), F.asc("rank"), F.asc("late"), F.asc_nulls_first("own"), F.asc("own_ord"), F.asc("after"), F.asc_nulls_first("turn"), F.asc("tie")]
    e = e.repartitionByRange(partitions(messages.sparkSession), *keys).sortWithinPartitions(*keys)
    e = materialize(e.select("conv_id", "turn", "kind", "id", "status", "partner_turn", "errors", "json", F.monotonically_increasing_id().alias("at")), "ordered")
    part = e.withColumn("part", F.shiftright("at", 33))
    sizes, total, offsets = part.groupBy("part").count().orderBy("part").collect(), 0, []  # a row for each partition
    for r in sizes:
        offsets.append((r["part"], total - (r["part"] << 33)))
        total += r["count"]
    off = messages.sparkSession.createDataFrame(offsets, "part long, off long")
    numbered = part.join(F.broadcast(off), "part").withColumn("index", F.col("at") + F.col("off"))
    start = materialize(numbered.groupBy(F.col("conv_id").alias("c")).agg(F.min("index").alias("start")), "starts")
    out = numbered.join(start, F.col("conv_id").eqNullSafe(F.col("c")))
    return out.select("conv_id", "turn", (F.col("index") - F.col("start")).alias("position"), "kind", "id", "status", "partner_turn", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), "json")
