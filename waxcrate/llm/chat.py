"""Tool-call linking for chat transcripts: calls and results joined by identifier, ordered, validated, and written as canonical JSON.

A message has conv_id, seq, role, content, tool_calls (id, name, arguments as JSON text) and tool_call_id; it may be a result and
hold calls at once. Calls and results of a conversation meet in a hash join on (conv_id, id), both reduced to one row an identifier
first. In the order a result never comes before its call, along chains of any length: chains are followed by joins that double their
reach each round. Otherwise messages keep their sequence. Canonical JSON has sorted keys and no blanks. A conversation may hold any
share of all rows: positions are numbered inside blocks of the sequence and moved on by the blocks' prefix sums, and a block that
grows large, as all its messages have one sequence number or none, is dealt to smaller ones by a hash. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Sequence numbers of a block of positions; rows from which a block is dealt out, if it has a thousandth of all rows too.
BLOCK, LARGE = 256, 20_000
#: tool -> argument -> (JSON type as Spark names it, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]


def canonical_json(text: Column) -> Column:
    """The same JSON with sorted keys and no blanks; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """A comma-separated list of what is wrong with a call's arguments; empty if nothing is."""
    parsed = F.try_parse_json(arguments)

    def of(tool: str) -> Column:
        found = []
        for argument, (kind, required) in sorted(schemas[tool].items()):
            own = F.schema_of_variant(F.try_variant_get(parsed, f"$.{argument}", "variant"))
            missing = F.lit(f"missing:{argument}") if required else F.lit(None).cast("string")
            found.append(F.when(own.isNull(), missing).when(own != kind, F.lit(f"type:{argument}")))
        unknown = F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*[F.lit(a) for a in schemas[tool]]).cast("array<string>"))
        return F.concat_ws(",", *found, F.transform(F.array_sort(unknown), lambda a: F.concat(F.lit("unknown:"), a)))

    known = reduce(lambda c, tool: c.when(name == tool, of(tool)), sorted(schemas), F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("not an object")))
    return known.otherwise(F.lit("unknown tool"))


def _chained(both: DataFrame) -> DataFrame:
    """conv, seq, tie, anchor, rank of messages that are results and hold calls: where they stand.

    both: conv, seq, tie and call_seq, call_tie (the message of the call that it answers). Following its calls upward, a message
    stands at the greatest sequence number so far (anchor), as many places behind it (rank) as messages came since. A stretch of a
    chain is summed up by its greatest number, the messages since, and its length; each round puts two stretches together. Messages
    of a chain that ends in itself keep their own place.
    """
    t = both.select("conv", "seq", "tie", F.struct(F.col("call_seq").alias("seq"), F.col("call_tie").alias("tie")).alias("up"), F.col("seq").alias("anchor"), F.lit(0).alias("rank"), F.lit(1).alias("length"), F.lit(False).alias("done"))
    t, open_ = written(t, "chains"), -1
    while True:
        u = t.select(F.col("conv").alias("u_conv"), F.struct("seq", "tie").alias("u_at"), F.col("up").alias("u_up"), F.col("anchor").alias("u_anchor"), F.col("rank").alias("u_rank"), F.col("length").alias("u_length"), F.col("done").alias("u_done"))
        j = t.join(u, F.col("conv").eqNullSafe(F.col("u_conv")) & (F.col("up") == F.col("u_at")), "left")
        top = F.col("u_at").isNull()  # the call's message is no result itself
        above, behind = F.when(top, F.col("up.seq")).otherwise(F.col("u_anchor")), F.when(top, 0).otherwise(F.col("u_rank"))
        own, done = F.col("anchor") > above, F.col("done")
        after = j.select(
            "conv", "seq", "tie", F.when(done | top, F.col("up")).otherwise(F.col("u_up")).alias("up"), F.when(done | own, F.col("anchor")).otherwise(above).alias("anchor"),
            F.when(done | own, F.col("rank")).otherwise(behind + F.col("length")).alias("rank"), F.when(done | top, F.col("length")).otherwise(F.col("length") + F.col("u_length")).alias("length"), (done | top | F.col("u_done")).alias("done"),
        )
        after, left = written(after, "chains"), t
        now = after.where(~F.col("done")).count()
        discard(left)
        t = after
        if now in (0, open_):
            break
        open_ = now
    at = lambda c, own: F.when(F.col("done"), F.col(c)).otherwise(own)
    return t.select("conv", "seq", "tie", at("anchor", F.col("seq")).alias("anchor"), at("rank", F.lit(0)).alias("rank"))


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each message: conv_id, position (from 0), seq, role, status, errors, json.

    status, the first that applies: "orphan" for a result without a call, "repeated" for a second result of a call; "bad_arguments",
    "duplicate_call" (its id was used before in the conversation) or "unanswered" for a message with such a call; else "ok". errors
    lists argument errors by call, in the order of the arguments' names, joined by semicolons. A null tool_call_id or call id links
    to nothing. Null conversations are one conversation; a null seq comes first. Messages with equal conv_id and seq are ordered by a
    hash of their columns; wholly equal ones are interchangeable. Results in a circle of calls keep their places. Null contents stay
    null in the JSON, where null members are left out. An empty table gives an empty result; other columns are not looked at.
    """
    base = messages.select("conv_id", "seq", "role", "content", F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string,arguments:string>>")).alias("tool_calls"), "tool_call_id")
    base = base.withColumn("tie", F.xxhash64("role", "tool_call_id", "content", F.to_json("tool_calls"))).withColumn("at", F.coalesce("seq", F.lit(-(1 << 62))))
    place = F.struct("at", "tie")
    calls = base.select("conv_id", "at", "tie", F.posexplode("tool_calls").alias("nth", "call")).where("call.id IS NOT NULL")
    first_call = calls.groupBy("conv_id", F.col("call.id").alias("id")).agg(F.min(F.struct("at", "tie", "nth")).alias("call_at"))
    first_result = base.where("tool_call_id IS NOT NULL").groupBy("conv_id", F.col("tool_call_id").alias("id")).agg(F.min(place).alias("result_at"))
    c, r = first_call.toDF("c_conv", "c_id", "call_at"), first_result.toDF("r_conv", "r_id", "result_at")
    linked = c.join(r, F.col("c_conv").eqNullSafe(F.col("r_conv")) & (F.col("c_id") == F.col("r_id")), "full").select(F.when(F.col("c_id").isNull(), F.col("r_conv")).otherwise(F.col("c_conv")).alias("of"), F.coalesce("c_id", "r_id").alias("id"), "call_at", "result_at")

    # Each call is checked and looked up; then put together again, a message at a time.
    checked = calls.join(linked, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("call.id") == F.col("id")))
    checked = checked.select("conv_id", "at", "tie", "nth", argument_errors(F.col("call.name"), F.col("call.arguments"), schemas).alias("bad"), (F.col("call_at") != F.struct("at", "tie", "nth")).alias("again"), F.col("result_at").isNull().alias("open"))
    by_message = checked.groupBy("conv_id", "at", "tie").agg(F.array_sort(F.collect_set(F.when(F.col("bad") != "", F.struct("nth", "bad")))).alias("bad"), F.max("again").alias("again"), F.max("open").alias("open"))
    m = by_message.toDF("m_conv", "m_at", "m_tie", "bad", "again", "open")
    calling = base.where(F.size("tool_calls") > 0).join(m, F.col("conv_id").eqNullSafe(F.col("m_conv")) & (F.col("at") == F.col("m_at")) & (F.col("tie") == F.col("m_tie")), "left")
    called = F.when(F.size("bad") > 0, "bad_arguments").when(F.col("again"), "duplicate_call").when(F.col("open"), "unanswered").otherwise("ok")
    calling = calling.select(*base.columns, called.alias("called"), F.array_join(F.col("bad.bad"), ";").alias("errors"))
    silent = base.where(F.size("tool_calls") == 0).select(*base.columns, F.lit("ok").alias("called"), F.lit("").alias("errors"))

    # Results: after their call, wherever they stood.
    every = calling.unionByName(silent)
    results = every.where("tool_call_id IS NOT NULL").join(linked, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("tool_call_id") == F.col("id")), "left").drop("of", "id")
    both = results.where((F.size("tool_calls") > 0) & F.col("call_at").isNotNull()).select(F.col("conv_id").alias("conv"), F.col("at").alias("seq"), "tie", F.col("call_at.at").alias("call_seq"), F.col("call_at.tie").alias("call_tie")).distinct()
    chained = _chained(both)
    state = F.when(F.col("call_at").isNull(), "orphan").when(F.col("result_at") != place, "repeated").otherwise(F.col("called"))
    up = chained.toDF("u_conv", "u_at", "u_tie", "u_anchor", "u_rank")
    results = results.join(up, F.col("conv_id").eqNullSafe(F.col("u_conv")) & (F.col("call_at.at") == F.col("u_at")) & (F.col("call_at.tie") == F.col("u_tie")), "left")
    above, behind = F.coalesce("u_anchor", "call_at.at"), F.coalesce("u_rank", F.lit(0))
    late = F.coalesce(above >= F.col("at"), F.lit(False))
    results = results.select(*base.columns, state.alias("status"), "errors", F.when(late, above).otherwise(F.col("at")).alias("anchor"), F.when(late, behind + 1).otherwise(0).alias("rank"))
    own = chained.toDF("u_conv", "u_at", "u_tie", "u_anchor", "u_rank")
    joint = F.col("conv_id").eqNullSafe(F.col("u_conv")) & (F.col("at") == F.col("u_at")) & (F.col("tie") == F.col("u_tie"))
    chain = results.where(F.size("tool_calls") > 0).join(own, joint, "left").select(*base.columns, "status", "errors", F.coalesce("u_anchor", "at").alias("anchor"), F.coalesce("u_rank", F.lit(0)).alias("rank"))
    plain = every.where("tool_call_id IS NULL").select(*base.columns, F.col("called").alias("status"), "errors", F.col("at").alias("anchor"), F.lit(0).alias("rank"))
    every = results.where(F.size("tool_calls") == 0).unionByName(chain).unionByName(plain)

    own_calls = F.transform("tool_calls", lambda c: F.struct(F.coalesce(F.to_json(F.try_parse_json(c["arguments"])), c["arguments"]).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    body = F.struct("content", "role", "tool_call_id", F.when(F.size("tool_calls") > 0, own_calls).alias("tool_calls"))
    placed = every.select("conv_id", "at", "seq", "role", "status", "errors", F.to_json(body).alias("json"), "anchor", "rank", "tie", F.floor(F.col("anchor") / BLOCK).alias("block"))
    placed = written(placed, "messages")
    sizes = placed.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    large = F.broadcast(sizes.where(F.col("n") >= max(LARGE, -(-placed.count() // 1000))).select(F.col("conv_id").alias("l_conv"), F.col("block").alias("l_block")))  # a thousand at most
    fine = F.when(F.col("l_block").isNotNull(), F.struct("anchor", "rank", "at", F.shiftright("tie", 52).alias("part")))
    placed = placed.join(large, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("block") == F.col("l_block")), "left").withColumn("fine", fine).drop("l_conv", "l_block")
    inside = F.row_number().over(Window.partitionBy("conv_id", "block", "fine").orderBy("anchor", "rank", "at", "tie", "role", "json")) - 1
    sizes = placed.groupBy("conv_id", "block", "fine").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("block", "fine").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).toDF("b_conv", "b_block", "b_fine", "n", "before")
    out = placed.withColumn("inside", inside).join(before, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")) & F.col("fine").eqNullSafe(F.col("b_fine")))
    return out.select("conv_id", (F.col("before") + F.col("inside")).alias("position"), "seq", "role", "status", "errors", "json")


#: The tools of the derived transcripts.
DERIVED: Schemas = {"search": {"query": ("STRING", True), "limit": ("BIGINT", True)}, "count": {"text": ("STRING", True), "exact": ("BOOLEAN", False)}}


def derived_messages(conversations: DataFrame) -> DataFrame:
    """Transcripts with tool calls, from conversations (conv_id, turn, role, text): the given ones have none.

    Each assistant turn calls a tool about its own whole text, and each user turn after the first is the result of the turn before
    it. The tool, its arguments and what is wrong with them follow from conv_id and turn: every seventh call lacks an argument or has
    one of a wrong type, every eleventh result names a call that nobody made, and every thirteenth stands before its call. Every fifth
    assistant turn answers the assistant turn before it too, some of them from a place before it.
    """
    n = F.coalesce(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(0))
    call_id = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    size = F.length("text")
    search = F.when(n % 7 == 3, F.to_json(F.struct(F.col("text").alias("query")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), size.cast("long").alias("limit"))))
    count = F.when(n % 7 == 5, F.to_json(F.struct(size.alias("text")))).otherwise(F.to_json(F.struct("text", (size % 2 == 0).alias("exact"))))
    is_search = n % 2 == 0
    call = F.struct(call_id(F.col("turn")).alias("id"), F.when(is_search, F.lit("search")).otherwise(F.lit("count")).alias("name"), F.when(is_search, search).otherwise(count).alias("arguments"))
    result = (F.col("role") == "user") & (F.col("turn") > 0)
    chained = (F.col("role") == "assistant") & (F.col("turn") > 1) & (n % 5 == 2)
    turn = F.when(result & (n % 11 == 4), F.col("turn") + 1000).otherwise(F.col("turn") - F.when(chained, 2).otherwise(1))
    back = F.when(result & (n % 13 == 6), 3).when(chained & (n % 3 == 0), 5).otherwise(0)
    return conversations.select(
        "conv_id",
        (F.col("turn") * 2 - back).alias("seq"),
        F.when(result, F.lit("tool")).otherwise(F.col("role")).alias("role"),
        F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.array(call)).alias("tool_calls"),
        F.when(result | chained, call_id(turn)).alias("tool_call_id"),
    )
