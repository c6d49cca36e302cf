"""Chat formatting into budgeted windows (native DataFrame operations).

Template: every turn becomes ``<s>role\\ntext</s>``.  Inside roles and texts a
backslash is doubled and one is put after the first character of every control
string, so no text can end a turn or open another, and unescaping (drop each
backslash, keep the character after it) gives back the exact text.

Windows: the prefix sum of turn tokens cuts a conversation into cells of
``budget - system turn - history`` tokens.  Turns inside a cell make one window;
the turn that crosses the end of a cell makes the next window alone, so every
turn is new in exactly one window and no sequential pass is needed.  Each window
starts with the leading system turn, then the turns that begin within the last
``history`` tokens before it, or within what its own turns and the system turn
leave of the budget if that is less; both are repeated without loss, and its own
assistant turns carry the loss.  A window then exceeds the budget only if the
system turn and one other turn do.

A conversation may hold a third of all rows: prefix sums run over chunks of
``CHUNK`` turn numbers, chunk totals are summed per conversation, and windows
are grouped by (conversation, window), so no task needs a whole conversation.

A turn's tokens are estimated natively as its formatted code points over
``chars_per_token``, rounded up.

Defined results: null text or role is empty; rows of equal turn number are
ordered by role, then text; repeated rows are turns of their own; null turn
numbers come first; rows with a null conversation form one conversation; an
empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage, table

#: Strings that the template, or a chat tokenizer, gives a meaning.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BUDGET, HISTORY, CHARS_PER_TOKEN, CHUNK = 1024, 160, 4, 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, chars_per_token: int = CHARS_PER_TOKEN
) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_repeated, n_new, loss_spans.

    ``n_repeated``: leading turns repeated from earlier windows.  ``loss_spans``:
    code point ranges (end exclusive) of ``formatted`` that carry the loss.
    """
    if not 0 <= history <= budget // 4:
        raise ValueError("history must be within a quarter of the budget")
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    head = F.concat(F.lit("<s>"), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    # a key that is never null: plain equality then keeps the partitioning from step to step
    key = ["conv", "no_conv"]
    conv = F.coalesce(F.col("conv_id"), F.lit(0).cast(conversations.schema["conv_id"].dataType))
    t = conversations.select(
        conv.alias("conv"),
        F.col("conv_id").isNull().alias("no_conv"),
        "turn",
        role.alias("role"),
        head.alias("head"),
        escape(text).alias("body"),
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62))).alias("chunk"),
    )
    t = t.withColumn("chars", F.length("head") + F.length("body") + len("</s>"))
    t = t.withColumn("tokens", F.expr(f"(chars + {chars_per_token - 1}) div {chars_per_token}"))

    order = ("turn", "role", "body")
    inside = W.partitionBy(*key, "chunk").orderBy(*order)
    t = t.withColumn("pos", F.row_number().over(inside).cast("long") - 1)
    t = t.withColumn("start", F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens"))
    # the leading turn of each chunk decides, in the first chunk, about the system turn
    sums = t.groupBy(*key, "chunk").agg(
        F.count("*").alias("n"),
        F.sum("tokens").alias("sum"),
        F.max(F.when((F.col("pos") == 0) & (F.col("role") == "system"), F.col("tokens"))).alias("sys"),
    )
    chunks = W.partitionBy(*key).orderBy("chunk")
    before = chunks.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        *key,
        "chunk",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pos0"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start0"),
        F.coalesce(F.first("sys").over(chunks.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).alias("sys"),
    )
    t = t.join(sums, [*key, "chunk"])
    t = t.withColumn("pos", F.col("pos") + F.col("pos0")).withColumn("is_sys", (F.col("pos") == 0) & (F.col("sys") > 0))
    # the system turn stands before the prefix sums of the others
    t = t.withColumn("start", F.when(F.col("is_sys"), F.lit(0)).otherwise(F.col("start") + F.col("start0") - F.col("sys")))
    left = F.lit(budget) - F.col("sys")
    # beside a long system turn cells take from the history first; never so few tokens that it reaches back a cell
    t = t.withColumn("room", F.greatest(left - history, F.least(left, F.lit(budget // 4)), F.lit(1)))
    t = t.withColumn("cell", F.expr("start div room"))
    crosses = (F.col("start") > F.col("cell") * F.col("room")) & (F.col("start") + F.col("tokens") > (F.col("cell") + 1) * F.col("room"))
    t = t.withColumn("window", F.when(F.col("is_sys"), F.lit(0)).otherwise(2 * F.col("cell") + crosses.cast("long")))
    # placed once: new turns, history and system turns are all taken from this table
    t = stage(t.select(*key, "pos", "role", "head", "body", "chars", "tokens", "sys", "is_sys", "start", "cell", "window"), "chat-turns")

    # where windows begin, by the cell of their first turn
    own = F.sum(F.when(F.col("is_sys"), 0).otherwise(F.col("tokens")))
    reach = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.max("sys") - own))
    begins = t.groupBy(*key, "window").agg(F.min("start").alias("begin"), F.min("cell").alias("at_cell"), reach.alias("reach"))
    b = begins.withColumnRenamed("window", "_w")
    columns = [*key, "window", "kind", "pos", "role", "head", "body", "chars"]
    near = (F.col("start") < F.col("begin")) & (F.col("start") >= F.col("begin") - F.col("reach"))
    earlier = t.filter(~F.col("is_sys")).withColumn("at_cell", F.explode(F.array(F.col("cell"), F.col("cell") + 1))).drop("window")
    again = earlier.join(b, [*key, "at_cell"]).filter(near).withColumn("kind", F.lit(1))
    system = t.filter("is_sys").drop("window").join(b.filter("_w > 0"), key).withColumn("kind", F.lit(0))
    new = t.withColumn("kind", F.lit(2)).select(*columns)
    again, system = (x.withColumnRenamed("_w", "window").select(*columns) for x in (again, system))

    parts = new.unionByName(again).unionByName(system)
    so_far = W.partitionBy(*key, "window").orderBy("kind", "pos").rowsBetween(W.unboundedPreceding, 0)
    parts = parts.withColumn("at", F.sum("chars").over(so_far) - F.col("chars") + F.length("head"))
    lossy = (F.col("kind") == 2) & (F.col("role") == "assistant")
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))
    out = parts.groupBy(*key, "window").agg(
        F.array_sort(F.collect_list(F.struct("kind", "pos", F.concat("head", "body", F.lit("</s>")).alias("s")))).alias("_p"),
        F.array_sort(F.collect_list(F.when(lossy, span))).alias("loss_spans"),
        F.sum((F.col("kind") < 2).cast("int")).alias("n_repeated"),
        F.sum((F.col("kind") == 2).cast("int")).alias("n_new"),
    )
    conv_id = F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id")
    return out.select(conv_id, "window", F.array_join("_p.s", "").alias("formatted"), "n_repeated", "n_new", "loss_spans")


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: turns, loss text and their digests.

    The two digests cover the whole conversation, so its text meets in one row
    here; the windows themselves never need that.
    """
    head = r"(?s)^<s>((?:[^\\\n]|\\.)*+)\n"
    role = lambda b: unescape(F.regexp_extract(b, head, 1))
    body = lambda b: unescape(F.regexp_replace(b, head + "(.*)$", "$2"))

    def turns(w: Column) -> Column:
        new = F.filter(F.split(w["formatted"], "</s>"), lambda b, i: (i >= w["n_repeated"]) & (i < w["n_repeated"] + w["n_new"]))
        return F.array_join(F.transform(new, lambda b: F.concat(role(b), F.lit("\n"), body(b), F.lit("\n"))), "")

    def loss(w: Column) -> Column:
        part = lambda s: F.substring(w["formatted"], s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        return F.array_join(F.transform(w["loss_spans"], lambda s: unescape(part(s))), "")

    g = windows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "formatted", "n_repeated", "n_new", "loss_spans"))).alias("_w"),
        F.sum("n_new").cast("long").alias("n_turns"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    g = g.withColumn("_loss", F.array_join(F.transform("_w", loss), ""))
    return g.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("_w", turns), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def op6_budgeted_windows(spark, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return read_back(format_windows(conversations))


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = {
    "op6_budgeted_windows": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 8 + length({_escaped("role")}) + length(role) - length(replace(role, chr(10), '')) + length({_escaped("text")}) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM c
), tok AS (SELECT *, (chars + {CHARS_PER_TOKEN - 1}) // {CHARS_PER_TOKEN} AS tokens FROM sized
), s AS (
  SELECT *, max(CASE WHEN pos = 0 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS sys,
         max(CASE WHEN pos = 0 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_chars,
         sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens AS raw FROM tok
), p AS (
  SELECT *, greatest({BUDGET - HISTORY} - sys, least({BUDGET} - sys, {BUDGET // 4}), 1) AS room, pos = 0 AND sys > 0 AS is_sys,
         CASE WHEN pos = 0 AND sys > 0 THEN 0 ELSE raw - sys END AS start FROM s
), w AS (
  SELECT *, CASE WHEN is_sys THEN 0 ELSE 2 * (start // room)
    + (start > (start // room) * room AND start + tokens > (start // room + 1) * room)::INT END AS win FROM p
), begins AS (
  SELECT conv_id, win, min(start) AS begin, any_value(sys_chars) AS sys_chars,
         greatest(0, least({HISTORY}, {BUDGET} - max(sys) - sum(CASE WHEN is_sys THEN 0 ELSE tokens END))) AS reach FROM w GROUP BY conv_id, win
), repeated AS (
  SELECT b.conv_id, sum(CASE WHEN b.win > 0 THEN b.sys_chars ELSE 0 END) AS chars FROM begins b GROUP BY 1
  UNION ALL
  SELECT b.conv_id, sum(w.chars) FROM begins b JOIN w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND NOT w.is_sys
    AND w.start < b.begin AND w.start >= b.begin - b.reach GROUP BY 1
), extra AS (SELECT conv_id, sum(chars) AS chars FROM repeated GROUP BY 1
), n AS (SELECT conv_id, count(*) AS n_windows FROM begins GROUP BY 1
), t AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
  FROM w GROUP BY conv_id
)
SELECT t.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       (t.chars + extra.chars)::BIGINT AS formatted_chars, n_windows
FROM t JOIN extra ON t.conv_id IS NOT DISTINCT FROM extra.conv_id JOIN n ON n.conv_id IS NOT DISTINCT FROM t.conv_id
"""
}
