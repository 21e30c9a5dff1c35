"""Chat formatting with DataFrame functions only.

A declarative template says how a turn is marked, which roles carry loss and which role may follow which. A conversation
becomes a list of text segments with loss flags; joined, they are the formatted text. Inside roles and texts a backslash
becomes backslash-b and an opening angle bracket backslash-l (in roles also a closing one, backslash-g), so no control
string of the template can occur there and the text can be read back exactly.

Cases: null text or role is empty; rows are taken by turn (null first), ties by role, then text, repeated rows are repeated
turns; a conversation that breaks the order is formatted all the same, with `valid` false; null conv_id is a conversation;
an empty table gives an empty table; only conv_id, turn, role and text are read. One conversation is one row of the result,
so its turns meet in one task; conversations themselves spread by id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table


@dataclass(frozen=True)
class Template:
    open: tuple[str, str] = ("<turn:", ">\n")
    close: str = "</turn>\n"
    loss: tuple[str, ...] = ("assistant",)
    #: role -> roles that may follow; "" is the start.
    follow: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    end: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescape(c: Column) -> Column:
    """Every backslash of an escaped text is followed by its letter, so whole replacements in this order are exact."""
    out = F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def format_conversations(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, segments (array of text, loss), formatted, valid."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.select(F.col("conv_id").cast("long"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)
    one = lambda t: F.array(segment(F.concat(F.lit(template.open[0]), escape(t["role"], True), F.lit(template.open[1])), off), segment(escape(t["text"]), t["role"].isin(*template.loss)), segment(F.lit(template.close), off))
    allowed = F.create_map(*(x for k, v in template.follow.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    # the machine's state is the last role, or null once an order was broken
    state = F.aggregate("turns", F.lit("").cast("string"), lambda s, t: F.when(F.array_contains(F.try_element_at(allowed, s), t["role"]), t["role"]))
    out = grouped.select("conv_id", F.flatten(F.transform("turns", one)).alias("segments"), F.coalesce(state.isin(*template.end), off).alias("valid"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted text."""
    head, tail = template.open
    pieces = F.split(formatted, r"\Q" + template.close + r"\E", -1)
    role = lambda p: F.substring_index(F.substring(p, len(head) + 1, 2**31 - 1), tail, 1)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring(p, F.length(role(p)) + len(head) + len(tail) + 1, F.lit(2**31 - 1))).alias("text")))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = format_conversations(rows.unionByName(extra))
    turns = read_turns(F.col("formatted"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumns({"_turns": turns, "_loss": loss})
    return out.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


ORACLE = {
    "op5_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS roles,
         sum(16 + length(role) + 2 * length(text) - length(replace(replace(text, '<', ''), '\', ''))) AS size
  FROM c GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars,
       regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') AS valid
FROM g"""
}
