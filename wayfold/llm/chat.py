"""Chat formatting with a grammar round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the template. A rendered conversation is
#:   ### chat <level>\n, then per turn:  ### <role>:\n<text>\n</turn>\n
#: Level 0 holds texts as they are; level 1 escapes the escape sign and the first sign of every control string.
HEAD, OPEN, MIDDLE, CLOSE = "### chat ", "### ", ":\n", "\n</turn>\n"
#: (sign, its escape) in the order of escaping; undone in reverse. After it no "#", "<" or bare ":" is left.
ESCAPES = (("~", "~0"), ("#", "~1"), ("<", "~2"), (":", "~3"))


def escape(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def render(turns: Column, level: int) -> Column:
    """turns array<struct<role, text>> -> one text."""
    code = escape if level else lambda x: x
    parts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), code(t["role"]), F.lit(MIDDLE), code(t["text"]), F.lit(CLOSE)))
    return F.concat(F.lit(f"{HEAD}{level}\n"), F.array_join(parts, ""))


def parse(formatted: Column) -> Column:
    """The deterministic parser: array<struct<role, text, start>>; start is the code point at which the text begins.

    The level stands in the first line. Turns end at every CLOSE; a role ends at the first MIDDLE.
    """
    level = F.substring(formatted, len(HEAD) + 1, 1)
    body = F.substring(formatted, F.lit(len(HEAD) + 3), F.length(formatted))
    # split takes a regular expression; none of the signs of CLOSE is special there
    pieces = F.split(body, CLOSE, -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, MIDDLE, 1)
        role = F.substring(role, F.lit(len(OPEN) + 1), F.length(role))
        text = F.substring(piece, F.lit(len(OPEN) + len(MIDDLE) + 1) + F.length(role), F.length(piece))
        plain = lambda x: F.when(level == "1", unescape(x)).otherwise(x)
        return F.struct(plain(role).alias("role"), plain(text).alias("text"), text.alias("raw"))

    return F.transform(pieces, turn)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> one row per conversation: conv_id, turns, formatted, parsed.

    Turns stand in order of turn, then role, then text; null roles and texts are empty. Each conversation is
    rendered plainly and parsed again; where the turns read back differ from the source (its texts or roles
    hold strings of the template), it is rendered with escapes, parsed again, and an error is raised if even
    then they differ. Repeated rows are turns of their own; an empty table gives no rows; rows with a null
    conv_id form one conversation. A conversation's turns are gathered in one row, as its text is one value;
    nothing else is. Other columns are ignored.
    """
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    grouped = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    turns = grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = turns.withColumn("plain", render(F.col("turns"), 0))
    back = lambda c: F.transform(parse(F.col(c)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = plain.withColumn("formatted", F.when(back("plain") == F.col("turns"), F.col("plain")).otherwise(render(F.col("turns"), 1))).drop("plain")
    out = out.withColumn("parsed", parse(F.col("formatted")))
    same = F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.col("turns")
    return out.withColumn("parsed", F.when(same, F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))))


def loss_mask(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds mask: array<struct<start, length>>, the spans of ``formatted`` (code points) that hold the role's texts."""
    start = F.struct(F.lit(len(HEAD) + 2).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    raw_role = lambda t: F.when(F.substring(F.col("formatted"), len(HEAD) + 1, 1) == "1", escape(t["role"])).otherwise(t["role"])

    def step(acc: Column, t: Column) -> Column:
        at = acc["at"] + F.lit(len(OPEN) + len(MIDDLE)) + F.length(raw_role(t))
        span = F.array(F.struct(at.alias("start"), F.length(t["raw"]).alias("length")))
        mask = F.when(t["role"] == role, F.concat(acc["mask"], span)).otherwise(acc["mask"])
        return F.struct((at + F.length(t["raw"]) + F.lit(len(CLOSE))).alias("at"), mask.alias("mask"))

    return formatted.withColumn("mask", F.aggregate("parsed", start, step, lambda acc: acc["mask"]))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text")
    )
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = loss_mask(format_chats(conv.unionByName(extra)))
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("mask", lambda m: F.substring(F.col("formatted"), m["start"] + 1, m["length"])), "")
    loss = F.when(F.substring("formatted", len(HEAD) + 1, 1) == "1", unescape(masked)).otherwise(masked)
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, 14 + length(role) + length(text) + 2 AS plain,
    len(regexp_extract_all(role || text, '[~#<:]')) AS signs,
    contains(text, chr(10) || '</turn>' || chr(10)) OR starts_with(text, '</turn>' || chr(10)) OR contains(role, ':' || chr(10)) OR contains(role, '</turn>')
      OR ends_with(text, chr(10) || '</turn>') AS odd FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (11 + sum(length(role) + length(text) + 15) + CASE WHEN bool_or(odd) THEN sum(signs) ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
