"""Chat formatting proved by a grammar round trip, in DataFrame functions only.

    conversation := mark turn*
    mark         := "<s>" | "<s1>" | "<s2>"
    turn         := "[INST]" role "[/INST]" text "</s>"

The mark tells how roles and texts are escaped: not at all, by writing the
control strings in another way, or by writing every `<`, `[` and `&` so. Each
conversation is rendered at the lowest level first, parsed again, and compared
with its source; one that does not come back identical (or has a control string
left in a role or text) is rendered at the next level. The last level leaves no
character that a control string starts with, so it always comes back.

Tokens to learn from are those of assistant texts. They are given as spans of
code points in the formatted text, and read back from there.

Nulls and edge cases: a null role or text is empty; rows without a turn number
come first, ties of turn are ordered by role, then text; each row without a
conv_id is a conversation of its own; repeated rows are repeated turns; an empty
table gives no rows; other columns, whatever their names, are not read. A conversation is one text, so one
row: it is as long as its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read, running_sums

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
MARKS = ("<s>", "<s1>", "<s2>")
#: How control strings are written inside roles and texts at level 1.
LEVEL_1 = (("&", "&amp;"), ("</s>", "&lt;/s>"), ("<s>", "&lt;s>"), ("<s1>", "&lt;s1>"), ("<s2>", "&lt;s2>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"))
LEVEL_2 = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
BACK = (("&lt;", "<"), ("&#91;", "["), ("&amp;", "&"))


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for was, now in pairs:
        text = F.replace(text, F.lit(was), F.lit(now))
    return text


def escape(text: Column, level: int) -> Column:
    return _replaced(text, ((), LEVEL_1, LEVEL_2)[level])


def render(turns: Column, level: int) -> Column:
    """The formatted text of turns (role, text)."""
    each = F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"], level), F.lit(CLOSE), escape(t["text"], level), F.lit(END)))
    return F.concat(F.lit(MARKS[level]), F.array_join(each, ""))


def pieces(formatted: Column) -> Column:
    """Still escaped turns (role, text) of a formatted text; null parts where it does not follow the grammar."""
    body = F.regexp_replace(formatted, r"^<s[12]?>", "")
    parts = let(F.split(body, r"</s>", -1), lambda p: F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))))

    def turn(part: Column) -> Column:
        at = F.locate(CLOSE, part)
        role = F.when(part.startswith(OPEN) & (at > 0), F.substring(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        return F.struct(role.alias("role"), F.when(role.isNotNull(), F.substring(part, at + len(CLOSE), F.length(part))).alias("text"))

    return F.transform(parts, turn)


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted text."""
    plain = formatted.startswith(MARKS[0])
    undone = lambda x: F.when(plain, x).otherwise(_replaced(x, BACK))
    return F.transform(pieces(formatted), lambda t: F.struct(undone(t["role"]).alias("role"), undone(t["text"]).alias("text")))


def clean(formatted: Column) -> Column:
    """Whether no role or text has a control string in it."""
    found = lambda x: x.contains(OPEN) | x.contains(CLOSE) | x.rlike("</?s[12]?>")
    return ~F.exists(pieces(formatted), lambda t: F.coalesce(found(t["role"]) | found(t["text"]), F.lit(True)))


def loss_spans(formatted: Column) -> Column:
    """Spans [start, end) of the assistant texts in a formatted text, in code points."""
    fixed = len(OPEN) + len(CLOSE) + len(END)
    mark = F.locate(">", formatted)

    def span(turn: Column, before: Column) -> Column:
        start = mark + before + len(OPEN) + F.length(turn["role"]) + len(CLOSE)
        return F.struct(turn["role"].alias("role"), start.cast("long").alias("start"), (start + F.length(turn["text"])).cast("long").alias("end"))

    def spans(turns: Column) -> Column:
        before = running_sums(F.transform(turns, lambda t: F.length(t["role"]) + F.length(t["text"]) + fixed))
        return F.zip_with(turns, F.slice(before, 1, F.size(turns)), span)

    found = F.filter(let(pieces(formatted), spans), lambda s: s["role"] == "assistant")
    return F.transform(found, lambda s: F.struct(s["start"], s["end"]))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted, level, loss_spans): a row for each conversation."""
    turn = F.struct("turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.select("conv_id", "turn", "role", "text", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("own"))
    convs = rows.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    good = lambda text: (parse(text) == F.col("turns")) & clean(text)
    convs = convs.withColumn("formatted", render(F.col("turns"), 0)).withColumn("level", F.lit(0))
    for level in (1, 2):
        convs = convs.withColumn("again", ~F.coalesce(good(F.col("formatted")), F.lit(False)))
        convs = convs.withColumn("formatted", F.when(F.col("again"), render(F.col("turns"), level)).otherwise(F.col("formatted")))
        convs = convs.withColumn("level", F.when(F.col("again"), level).otherwise(F.col("level"))).drop("again")
    return convs.withColumn("loss_spans", loss_spans(F.col("formatted")))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = format_conversations(rows.union(added)).select("conv_id", "formatted", "level", "loss_spans")
    made = made.withColumn("turns", parse(F.col("formatted")))
    under = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    loss = F.array_join(F.transform(under, lambda x: F.when(F.col("level") == 0, x).otherwise(_replaced(x, BACK))), "")
    made = made.withColumn("loss", loss)
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "level",
    )


#: turns and losses straight from the source; only the length of the formatted text needs the escaping rules.
ORACLE = """
WITH src AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, NULL, 0, 'user', '</s>[INST] ok [/INST]'), (-7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]')
), flagged AS (
  SELECT *, replace(role, '</s>', '') || replace(text, '</s>', '') AS both,
    contains(role || chr(10) || text, '</s>') OR contains(role || chr(10) || text, '<s>') OR contains(role || chr(10) || text, '<s1>')
      OR contains(role || chr(10) || text, '<s2>') OR contains(role || chr(10) || text, '[INST]') OR contains(role || chr(10) || text, '[/INST]') AS conflict
  FROM src
), levelled AS (
  SELECT *, CASE WHEN bool_or(conflict) OVER (PARTITION BY conv_id, own) THEN 1 ELSE 0 END AS level FROM flagged
), written AS (
  SELECT *, CASE WHEN level = 0 THEN role || text ELSE
    replace(replace(replace(replace(replace(replace(replace(role || chr(10) || text, '&', '&amp;'), '</s>', '&lt;/s>'), '<s>', '&lt;s>'),
      '<s1>', '&lt;s1>'), '<s2>', '&lt;s2>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]') END AS escaped
  FROM levelled
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(17 + length(escaped) - level) + 3 + max(level) AS BIGINT) AS formatted_chars,
  max(level) AS level
FROM written GROUP BY conv_id, own
"""
