"""Quotation linking for conversations, in DataFrame functions only.

A line's quote level is the number of `>` that it starts with. Lines of one level that follow each other, up to a blank line, are a
passage; normalised (lower case, white space to one space) it is known by its md5, and so is each of its lines, as quotations are often cut
short. A quoted passage or line comes from the earliest message of its conversation that says it in its own words, before the quoting one. A
message replies to the message behind its passages of the lowest level, the one with most characters there, the later one of equals.

Threads follow from the replies by pointer jumping: each round doubles the distance, so rounds grow with the logarithm of the longest chain.
So do the places in reply order: the walk around a thread's tree (into a message, through its replies by turn, out again) is a linked list,
and doubling counts how many messages come after each step. No list of a thread or of a message's replies is held anywhere; a formatted
conversation is written in parts of PART messages.

Passages are first reduced to their earliest message by an aggregate with a partial step, so a line that a third of all messages share
costs one row, and no pairs of messages are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm.common import checkpointed, documents, stash

#: A line like "On Monday, Ann wrote:" right above a quotation belongs to it. Fixed: the verbs of common mail programs.
ATTRIBUTION = r"(?i)\b(wrote|writes|schrieb|écrit|escribió)\s?:\s*$"
QUOTE = r"^[ \t]{0,3}(>[> \t]*)?"
#: The white space of words, the same on every engine.
BLANK = r"[ \t\n\x0B\f\r]+"
ENDS = r"\r\n|\n|\r"
#: Messages in one part of a formatted conversation.
PART = 1000


def parsed(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with own (text without quotations), units (level, passage, whole) and, where lines are quoted, quoted:
    each line as it is with its level, whether it is blank, and the digests of itself and of its passage."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), "[^>]", ""))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), ENDS), lambda x: F.struct(level(x).alias("level"), F.when(level(x) > 0, F.regexp_replace(x, QUOTE, "")).otherwise(x).alias("line")))
    rows = messages.withColumn("raw", F.split(F.coalesce("text", F.lit("")), ENDS)).withColumn("lines", lines).withColumn("attribution", F.lit(ATTRIBUTION))
    said = "x.level = 0 and x.line rlike attribution and coalesce(get(lines, i + 1).level, 0) > 0"
    rows = rows.withColumn("lines", F.expr(f"transform(lines, (x, i) -> if({said}, named_struct('level', -1, 'line', ''), x))"))
    own = F.expr("array_join(transform(filter(lines, x -> x.level = 0), x -> x.line), '\\n')")
    # Whether a line goes on with the passage of the line before it, and from there each passage's first and last line.
    rows = rows.withColumn("full", F.transform("lines", lambda x: (x["level"] >= 0) & (F.trim(x["line"]) != "")))
    rows = rows.withColumn("goes_on", F.expr("transform(lines, (x, i) -> coalesce(i > 0 and full[i] and get(full, i - 1) and get(lines, i - 1).level = x.level, false))"))
    first = F.expr("filter(sequence(0, size(lines) - 1), i -> full[i] and not goes_on[i])")
    last = F.expr("filter(sequence(0, size(lines) - 1), i -> full[i] and not coalesce(get(goes_on, i + 1), false))")
    rows = rows.withColumns({"first": first, "last": last})
    rows = rows.withColumn("passages", F.expr("transform(first, (a, k) -> slice(lines, a + 1, last[k] - a + 1))"))
    normal = lambda x: F.trim(F.regexp_replace(F.lower(x), BLANK, " "))
    unit = lambda level, text, whole: F.struct(level.alias("level"), normal(text).alias("passage"), F.lit(whole).alias("whole"))
    whole = lambda p: F.array(unit(p[0]["level"], F.array_join(F.transform(p, lambda x: x["line"]), " "), True))
    units = F.flatten(F.transform("passages", lambda p: F.when(F.size(p) > 1, F.concat(whole(p), F.transform(p, lambda x: unit(x["level"], x["line"], False)))).otherwise(whole(p))))
    rows = rows.withColumn("digests", F.transform("passages", lambda p: F.md5(normal(F.array_join(F.transform(p, lambda x: x["line"]), " ")))))
    of = "get(digests, size(filter(first, a -> a <= i)) - 1)"
    line = F.expr(f"transform(lines, (x, i) -> named_struct('raw', raw[i], 'level', x.level, 'blank', not full[i], 'line', x.line, 'passage', if(full[i], {of}, null)))")
    each = F.transform(line, lambda x: F.struct(x["raw"].alias("raw"), x["level"].alias("level"), x["blank"].alias("blank"), F.md5(normal(x["line"])).alias("own"), x["passage"].alias("passage")))
    rows = rows.withColumn("quoted", F.when(F.exists("lines", lambda x: x["level"] > 0), each))
    return rows.select("conv_id", "turn", "role", "quoted", F.regexp_replace(own, f"^{BLANK}|{BLANK}$", "").alias("own"), F.filter(units, lambda u: u["passage"] != "").alias("units"))


def linked_units(units: DataFrame) -> DataFrame:
    """(conv_id, turn, level, h, n, origin): quotations (conv_id, turn, level, passage) that an earlier message of the conversation says, by digest."""
    keyed = units.select("conv_id", "turn", "level", F.md5("passage").alias("h"), F.length("passage").alias("n"))
    origins = keyed.where("level = 0").groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    return keyed.where("level > 0").join(origins, ["conv_id", "h"]).where("origin < turn")


def reply_links(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) from linked_units(): only messages with a linked quotation."""
    by_origin = linked.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    best = F.min_by("origin", F.struct("level", (-F.col("n")).alias("n"), (-F.col("origin")).alias("o")))
    return by_origin.groupBy("conv_id", "turn").agg(best.alias("reply_to"), F.sum("k").alias("n_linked"))


def without_linked() -> Column:
    """A message's text without the quoted lines that are linked, or whose passage is (their digests in `gone`), and without the line that
    names whom they quote; a message that loses a quotation loses its blank quoted lines. What nobody said stays as it was written."""
    gone = F.coalesce("gone", F.array().cast("array<string>"))
    out = lambda x: (x["level"] > 0) & (F.array_contains(gone, x["own"]) | F.coalesce(F.array_contains(gone, x["passage"]), F.lit(False)) | (x["blank"] & (F.size(gone) > 0)))
    lines = F.filter("quoted", lambda x, i: F.when(x["level"] == -1, ~out(F.get("quoted", i + 1))).otherwise(~out(x)))
    text = F.array_join(F.transform(lines, lambda x: x["raw"]), "\n")
    return F.when(F.col("quoted").isNull(), F.col("own")).otherwise(F.regexp_replace(text, f"^{BLANK}|{BLANK}$", ""))


def threads(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(conv_id, turn, thread, depth): for each linked message the first one of its chain of replies, and how many replies lead there."""
    state = checkpointed(links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    for _ in range(rounds):
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        joined = state.join(up, ["conv_id", "thread"], "left")
        state = checkpointed(joined.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")))
        moved = state.where("moved").limit(1).count()
        state = state.drop("moved")
        if not moved:
            return state
    raise RuntimeError(f"threads did not settle in {rounds} rounds")


def next_replies(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, next_turn): for each reply (conv_id, turn, reply_to) the next one by turn to the same message, or null.

    Rows are dealt by range, so a message with very many replies is spread; the last row of a range looks at the next range's first.
    """
    parts = int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(replies.repartitionByRange(parts, "conv_id", "reply_to", "turn").withColumn("part", F.spark_partition_id()))
    key = F.struct("conv_id", "reply_to", "turn")
    heads = dealt.groupBy("part").agg(F.min(key).alias("head"))
    heads = heads.select((F.lead("part").over(Window.orderBy("part")).isNotNull()).alias("more"), "part", F.lead("head").over(Window.orderBy("part")).alias("head")).where("more").drop("more")  # a row for each range
    after = F.lead(key).over(Window.partitionBy("part").orderBy("conv_id", "reply_to", "turn"))
    rows = dealt.withColumn("after", after).join(heads, "part", "left").withColumn("after", F.coalesce("after", "head"))
    return rows.select("conv_id", "turn", F.when((F.col("after.conv_id") == F.col("conv_id")) & (F.col("after.reply_to") == F.col("reply_to")), F.col("after.turn")).alias("next_turn"))


def reply_order(replies: DataFrame, roots: DataFrame, rounds: int = 60) -> DataFrame:
    """(conv_id, turn, position) from replies (conv_id, turn, reply_to) and roots (conv_id, turn): places from 0 in each thread's reply order."""
    child = replies.groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("first"))
    nodes = next_replies(replies).join(replies, ["conv_id", "turn"]).select("conv_id", "turn", "reply_to", "next_turn")
    nodes = nodes.unionByName(roots.select("conv_id", "turn", F.lit(None).cast(replies.schema["turn"].dataType).alias("reply_to"), F.lit(None).cast(replies.schema["turn"].dataType).alias("next_turn")))
    nodes = nodes.join(child, ["conv_id", "turn"], "left")
    step = lambda out, turn, next_turn, next_out, n: F.struct(F.lit(out).alias("out"), turn.alias("turn"), next_turn.alias("next_turn"), next_out.alias("next_out"), F.lit(n).cast("long").alias("n"))
    into = step(False, F.col("turn"), F.coalesce("first", "turn"), F.col("first").isNull(), 1)
    out = step(True, F.col("turn"), F.coalesce("next_turn", "reply_to"), F.col("next_turn").isNull(), 0)
    state = checkpointed(nodes.select("conv_id", F.explode(F.array(into, out)).alias("s")).select("conv_id", "s.*"))
    for _ in range(rounds):
        ahead = state.select("conv_id", F.col("turn").alias("next_turn"), F.col("out").alias("next_out"), F.col("next_turn").alias("beyond"), F.col("next_out").alias("beyond_out"), F.col("n").alias("more"))
        joined = state.join(ahead, ["conv_id", "next_turn", "next_out"], "left")
        state = checkpointed(joined.select("conv_id", "turn", "out", F.col("beyond").alias("next_turn"), F.col("beyond_out").alias("next_out"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        if state.where("next_turn is not null").isEmpty():
            return state.where("not out").select("conv_id", "turn", F.col("n").alias("ahead"))
    raise RuntimeError(f"reply order did not settle in {rounds} rounds")


def linked_conversations(messages: DataFrame) -> DataFrame:
    """One row for each message (conv_id, turn, role, text): its text without linked quotations, reply_to, thread, depth, position in the thread's
    reply order (from 0; a message stands after what it answers, before later answers to the same), n_quotes, n_linked, the formatted turn.

    Null texts count as empty, null conversations or turns are never linked, repeated rows keep all their rows, links and places. A
    quotation that nobody said before stays in the text. Other columns are left out, an empty table gives an
    empty result.
    """
    rows = stash(parsed(messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))))
    units = rows.select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.level", "u.passage")
    linked = checkpointed(linked_units(units))
    links = checkpointed(reply_links(linked))
    if links.isEmpty():
        found = links.withColumns({"thread": F.col("turn"), "depth": F.lit(0).cast("long"), "position": F.lit(0).cast("long")})
    else:
        above = checkpointed(threads(links))
        roots = above.select("conv_id", F.col("thread").alias("turn")).distinct()
        order = checkpointed(reply_order(links.select("conv_id", "turn", "reply_to"), roots))
        whole = order.join(roots, ["conv_id", "turn"], "left_semi").select("conv_id", F.col("turn").alias("thread"), F.col("ahead").alias("whole"))
        found = links.join(above, ["conv_id", "turn"]).join(order, ["conv_id", "turn"]).join(whole, ["conv_id", "thread"]).withColumn("position", F.col("whole") - F.col("ahead"))
    gone = linked.groupBy("conv_id", "turn").agg(F.collect_set("h").alias("gone"))  # of one message's quotations
    found = found.join(gone, ["conv_id", "turn"], "left") if not links.isEmpty() else found.withColumn("gone", F.array().cast("array<string>"))
    joined = rows.join(found.select("gone", "conv_id", "turn", "reply_to", "n_linked", "thread", "depth", "position"), ["conv_id", "turn"], "left")
    joined = joined.withColumn("own", without_linked())
    role = F.coalesce("role", F.lit("unknown"))
    return joined.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("position", F.lit(0)).cast("long").alias("position"), F.size(F.filter("units", lambda u: (u["level"] > 0) & u["whole"])).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), "own").alias("formatted"),
    )


def formatted_threads(linked: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, thread, part, n_messages, conversation) from linked_conversations(): each thread's formatted turns in reply order.

    A part holds `part` places of the order, so no row grows with the thread; parts follow each other by number.
    """
    rows = linked.select("conv_id", "thread", F.floor(F.col("position") / part).cast("long").alias("part"), F.struct("position", "turn", "formatted").alias("m"))
    listed = rows.groupBy("conv_id", "thread", "part").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return listed.select("conv_id", "thread", "part", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["formatted"]), "\n").alias("conversation"))


def conversations(messages: DataFrame, part: int = PART) -> DataFrame:
    """linked_conversations() with `conversation`: on the first message of each part of a thread the formatted turns of that part, else null.

    Rows equal in conversation and turn share a place, and the text. Messages without conversation or turn have none.
    """
    linked = stash(linked_conversations(messages))
    parts = formatted_threads(linked, part).select("conv_id", "thread", (F.col("part") * part).alias("position"), "conversation")
    return linked.join(parts, ["conv_id", "thread", "position"], "left").select(*(c for c in linked.columns if c != "formatted"), "conversation")


def op8_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(documents(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS lines FROM conversations),
l AS (SELECT rid, conv_id, turn, generate_subscripts(lines, 1) AS i, unnest(lines) AS raw FROM m),
q AS (SELECT *, length(regexp_replace(regexp_extract(raw, '^[ \t]{0,3}(>[> \t]*)?', 1), '[^>]', '', 'g')) AS lv FROM l),
a AS (SELECT rid, conv_id, turn, i, raw, CASE WHEN lv > 0 THEN regexp_replace(raw, '^[ \t]{0,3}(>[> \t]*)?', '') ELSE raw END AS line,
  CASE WHEN lv = 0 AND coalesce(lead(lv) OVER (PARTITION BY rid ORDER BY i), 0) > 0 AND regexp_matches(raw, '(?i)\b(wrote|writes|schrieb|écrit|escribió)\s?:\s*$') THEN -1 ELSE lv END AS lv FROM q),
s AS (SELECT *, CASE WHEN lag(lv) OVER w = lv AND trim(lag(line) OVER w, ' ') <> '' THEN 0 ELSE 1 END AS starts FROM a WINDOW w AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY rid ORDER BY i) AS grp FROM s),
u AS (SELECT rid, conv_id, turn, lv, trim(regexp_replace(lower(string_agg(line, ' ' ORDER BY i)), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS passage, true AS whole FROM g
  WHERE lv >= 0 AND trim(line, ' ') <> '' GROUP BY rid, conv_id, turn, lv, grp UNION ALL SELECT rid, conv_id, turn, lv, trim(regexp_replace(lower(line), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), false FROM g
  WHERE lv >= 0 AND trim(line, ' ') <> '' QUALIFY count(*) OVER (PARTITION BY rid, lv, grp) > 1),
un AS (SELECT * FROM u WHERE passage <> ''),
o AS (SELECT conv_id, passage, min(turn) AS origin FROM un WHERE lv = 0 GROUP BY ALL),
kp AS (SELECT DISTINCT un.conv_id, un.turn, un.passage FROM un JOIN o USING (conv_id, passage) WHERE un.lv > 0 AND o.origin < un.turn),
pw AS (SELECT rid, lv, grp, trim(regexp_replace(lower(string_agg(line, ' ' ORDER BY i)), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS pp FROM g WHERE lv > 0 AND trim(line, ' ') <> '' GROUP BY ALL),
gl AS (SELECT g.*, trim(line, ' ') = '' AS blank, pw.pp, trim(regexp_replace(lower(line), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS lp FROM g LEFT JOIN pw ON pw.rid = g.rid AND pw.lv = g.lv AND pw.grp = g.grp AND trim(line, ' ') <> ''),
dr AS (SELECT gl.*, gl.lv > 0 AND (a1.passage IS NOT NULL OR a2.passage IS NOT NULL OR (blank AND any_.n > 0)) AS gone FROM gl LEFT JOIN kp a1 ON a1.conv_id = gl.conv_id AND a1.turn = gl.turn AND a1.passage = gl.pp
  LEFT JOIN kp a2 ON a2.conv_id = gl.conv_id AND a2.turn = gl.turn AND a2.passage = gl.lp LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM kp GROUP BY ALL) any_ ON any_.conv_id = gl.conv_id AND any_.turn = gl.turn),
dk AS (SELECT *, CASE WHEN lv = -1 THEN lead(gone) OVER (PARTITION BY rid ORDER BY i) ELSE gone END AS out_ FROM dr),
own AS (SELECT rid, regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(out_, false)), ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS own FROM dk GROUP BY rid),
k AS (SELECT un.conv_id, un.turn, un.lv, o.origin, sum(length(passage)) AS n, count(*) AS k FROM un JOIN o USING (conv_id, passage) WHERE un.lv > 0 AND origin < un.turn GROUP BY ALL),
lk AS (SELECT conv_id, turn, first(origin ORDER BY lv, n DESC, origin DESC) AS reply_to, sum(k)::BIGINT AS n_linked FROM k GROUP BY ALL),
t AS (SELECT conv_id, turn, reply_to AS thread, 1::BIGINT AS depth, [reply_to, turn] AS path FROM lk UNION ALL SELECT t.conv_id, t.turn, lk.reply_to, t.depth + 1, list_prepend(lk.reply_to, path) FROM t JOIN lk ON lk.conv_id = t.conv_id AND lk.turn = t.thread),
r AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth, arg_max(path, depth) AS path FROM t GROUP BY ALL),
ps AS (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id, thread ORDER BY path) AS position FROM r),
nq AS (SELECT rid, count(*) FILTER (WHERE lv > 0 AND whole)::BIGINT AS n FROM un GROUP BY rid),
f AS (SELECT m.conv_id, m.turn, m.role, own.own AS text, lk.reply_to, coalesce(r.thread, m.turn) AS thread, coalesce(r.depth, 0)::BIGINT AS depth, coalesce(ps.position, 0)::BIGINT AS position, coalesce(nq.n, 0) AS n_quotes, coalesce(lk.n_linked, 0) AS n_linked
  FROM m JOIN own USING (rid) LEFT JOIN nq USING (rid) LEFT JOIN lk ON lk.conv_id = m.conv_id AND lk.turn = m.turn LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn LEFT JOIN ps ON ps.conv_id = m.conv_id AND ps.turn = m.turn),
c AS (SELECT conv_id, thread, position // 1000 AS part, string_agg(line, chr(10) ORDER BY position, turn, line) AS conversation FROM (SELECT *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || text AS line FROM f) WHERE conv_id IS NOT NULL AND thread IS NOT NULL GROUP BY ALL)
SELECT f.*, CASE WHEN position % 1000 = 0 THEN conversation END AS conversation FROM f LEFT JOIN c ON c.conv_id = f.conv_id AND c.thread = f.thread AND c.part = f.position // 1000
"""
