"""Operator 1, chat formatting (native): a grammar round trip.

Template (a deterministic grammar):

    conversation := turn*
    turn         := "<s>[INST]" role "[/INST]" text "</s>"

Role and text must hold none of the four control strings. A turn is first rendered verbatim
and parsed; where the parser does not give back that very turn, the turn is escaped, and the
whole conversation is parsed again and compared with its source. Escaping adds one backslash
after the first character of each control string, also of those that have backslashes there
already; reading removes one. So one round makes every text identical, which is checked for
each conversation (a difference is an error, never a silently wrong row).

The loss mask covers the texts of assistant turns.

Defined results: a null role or text is empty. Rows are ordered by turn (those without one
first), then role, then text, so ties and repeated rows are kept and ordered. Rows whose conv_id is null form one
conversation. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import table

OPEN, ROLE_END, END = "<s>[INST]", "[/INST]", "</s>"
#: A control string, or one with backslashes after its first character.
CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])"
#: A control string as such.
RAW = r"<s>|</s>|\[INST\]|\[/INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])", "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(ROLE_END), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; null in place of a turn that breaks the grammar."""
    pieces = F.split(formatted, END)  # the last piece is what follows the last turn

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        at = F.locate(ROLE_END, body)
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(ROLE_END))
        fits = piece.startswith(OPEN) & (at > 0) & ~role.rlike(RAW) & ~text.rlike(RAW)
        return F.when(fits, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    turns = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    rest = F.filter(F.slice(pieces, -1, 1), lambda p: p != "")
    return F.concat(turns, F.transform(rest, turn))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (the rendered conversation), n_escaped (turns that had to be escaped)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    verbatim = render(role, text)
    read = parse(verbatim)
    same = F.coalesce(
        (F.size(read) == 1) & (F.element_at(read, 1)["role"] == role) & (F.element_at(read, 1)["text"] == text),
        F.lit(False),
    )
    turns = conversations.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.when(same, verbatim).otherwise(render(escape(role), escape(text))).alias("formatted"),
        (~same).cast("long").alias("escaped"),
    )
    whole = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "formatted"))).alias("turns"),
        F.sum("escaped").alias("n_escaped"),
    )
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    formatted = F.array_join(F.transform("turns", lambda t: t["formatted"]), "")
    return whole.select("conv_id", "n_escaped", formatted.alias("formatted"), source.alias("source")).select(
        "conv_id",
        "n_escaped",
        F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted"))
        .otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
        .alias("formatted"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text), as parsed from the formatted text, and loss_text: all text
    under the loss mask, unescaped."""
    turns = formatted.withColumn("turns", parse(F.col("formatted")))
    mine = F.filter("turns", lambda t: t["role"] == "assistant")
    return turns.withColumn("loss_text", F.array_join(F.transform(mine, lambda t: t["text"]), ""))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose two turns look like the template's own marks."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_back(format_conversations(with_probe(table(spark, sf_dir, "conversations"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_escaped").alias("n_escaped"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, len(regexp_extract_all(role || chr(0) || text, '[<\[]\\*(s>|/s>|INST\]|/INST\])')) AS marks FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length(role) + length(text) + marks)::BIGINT AS formatted_chars,
       (count(*) FILTER (marks > 0))::BIGINT AS n_escaped
FROM marked GROUP BY conv_id
"""
