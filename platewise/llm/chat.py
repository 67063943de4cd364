"""Chat formatting by Spark expressions alone.

A conversation is its turns in order of turn (ties: role, then text). Adjacent turns of one role are merged into one
block: <|start|>role<|text|>first<|next|>second<|end|>. Control strings inside roles and texts are broken by a
backslash (and backslashes doubled), so what is read back is what went in. Each segment of the output carries whether
the loss counts it: assistants' texts, one segment a turn.

Turns are first sorted and gathered by (conversation, 256 turn numbers), then the pieces by conversation, so that a
long conversation is put together from few pieces. Null role or text counts as empty; a null turn comes first; repeated
rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: strings with a meaning in this template or in common ones
START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(conversations: DataFrame, chunk: int = 256) -> DataFrame:
    """Per conv_id: segments (array of struct s, loss) and formatted, their concatenation."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = turns.groupBy("conv_id", F.expr(f"turn div {chunk}").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = pieces.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "turns"))), lambda x: x["turns"])).alias("t"))
    t = F.col("t")

    def segments(x: Column, i: Column) -> Column:
        first = F.get(t, i - 1)["role"].isNull() | (F.get(t, i - 1)["role"] != x["role"])
        last = F.get(t, i + 1)["role"].isNull() | (F.get(t, i + 1)["role"] != x["role"])
        head = F.when(first, F.concat(F.lit(START), escaped(x["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT))
        part = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escaped(x["text"]), x["role"] == "assistant"), part(F.when(last, F.lit(END)).otherwise(F.lit("")), F.lit(False)))

    out = whole.select("conv_id", F.flatten(F.transform(t, segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["s"]), ""))


def parsed(text: Column) -> Column:
    """formatted text -> array of struct (role, text), one for each turn."""

    def turns(block: Column) -> Column:
        at = F.instr(block, TEXT)
        role = F.substring(block, F.lit(len(START) + 1), at - 1 - len(START))
        return F.transform(F.split(F.substring(block, at + len(TEXT), F.length(block)), r"<\|next\|>", -1), lambda x: F.struct(unescaped(role).alias("role"), unescaped(x).alias("text")))

    blocks = F.filter(F.split(text, r"<\|end\|>", -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns))


def digest(conversations: DataFrame) -> DataFrame:
    """What reading the output back gives: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    done = formatted(conversations)
    back = done.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescaped(x["s"])), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_escapes(conversations: DataFrame) -> DataFrame:
    """conversations and the conversation -7, whose texts are control strings."""
    spark, said = conversations.sparkSession, "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)


_ESCAPE = "replace({x}, '\\', '\\\\')"
for _s in CONTROL:
    _ESCAPE = f"replace({_ESCAPE}, '{_s}', '{_s[0]}\\{_s[1:]}')"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
l AS (SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
             sum(CASE WHEN before IS DISTINCT FROM role THEN {len(START) + len(TEXT)} + length({_ESCAPE.format(x="role")}) ELSE {len(NEXT)} END
                 + length({_ESCAPE.format(x="text")}) + CASE WHEN after IS DISTINCT FROM role THEN {len(END)} ELSE 0 END) AS formatted_chars
      FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM l
"""
