r"""Chat formatting with Spark expressions only.

A conversation becomes one string, a block a run of turns of one role:

    ### role: text<+>text</turn>\n

``<+>`` stands between turns of a run, so the output keeps every turn.  In
texts and roles ``\`` is written ``\b`` and each control string as ``\`` and a
letter of its own.  In an escaped text every backslash starts such a pair, so
replacing the pairs, ``\b`` last, gives the text back exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HEAD, COLON, JOIN, END = "### ", ": ", "<+>", "</turn>\n"
#: What is escaped in a text, and in a role besides.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("<+>", "\\j"), ("</turn>", "\\t")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]
#: Pieces whose places are summed together, and code points of the strips that loss spans are cut from.
PART, STRIP = 256, 4096


def _escape(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def _unescape(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[1]), F.lit(p[0])), [*pairs[1:], pairs[0]], c)


def _part_spans(pieces: Column) -> Column:
    """Parts of ``PART`` pieces each: their size, and the spans under the loss mask from the part's start.

    An array that grows is copied with each entry, so it grows within a part only.
    """
    none = F.array().cast("array<struct<start:long,length:long>>")
    grown = lambda acc, p: F.struct(
        (acc["size"] + F.length(p["s"])).alias("size"),
        F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["size"].alias("start"), F.length(p["s"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).cast("long").alias("size"), none.alias("spans"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / PART).cast("int"))
    return F.transform(numbers, lambda k: F.aggregate(F.slice(pieces, k * PART + 1, PART), start, grown))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length; code points from 0).

    ``turns`` has conv_id, turn, role, text; other columns are ignored.  Turns
    are sorted by turn (null first), ties by role and text; adjacent turns of
    one role make one block.  Null texts and roles count as empty, a null
    conv_id is a conversation of its own, repeated rows are repeated turns, an
    empty table gives no rows.  A loss span covers the escaped text of one turn
    of ``loss_role``, without marks.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # where a run of one role starts, then each run's role and texts
    starts = F.filter(F.transform("turns", lambda t, i: F.when((i == 0) | (F.get(F.col("turns"), i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull())
    c = c.withColumn("starts", starts)
    c = c.withColumn(
        "runs",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get(F.col("turns"), s)["role"].alias("role"),
                F.transform(F.slice("turns", s + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns")) - s), lambda t: _escape(t["text"], ESCAPES)).alias("texts"),
            ),
        ),
    ).drop("turns", "starts")
    # pieces of the output in order, those under the loss mask marked
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def block(r: Column) -> Column:
        texts = F.transform(r["texts"], lambda t, i: F.array(piece(F.when(i > 0, F.lit(JOIN)).otherwise(F.lit("")), no), piece(t, r["role"] == loss_role)))
        return F.concat(F.array(piece(F.concat(F.lit(HEAD), _escape(r["role"], ROLE_ESCAPES), F.lit(COLON)), no)), F.flatten(texts), F.array(piece(F.lit(END), no)))

    c = c.withColumn("pieces", F.flatten(F.transform("runs", block))).drop("runs")
    c = c.withColumn("parts", _part_spans(F.col("pieces")))
    ends = F.aggregate("parts", F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["size"])))
    # zip_with works out its arguments once a row; the last end has no part
    moved = F.zip_with("parts", F.slice(ends, 1, F.size("parts")), lambda p, at: F.transform(p["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length"))))
    spans = F.flatten(moved)
    return c.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: an array of (role, text) in order."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")
    body = lambda b: F.substring(b, F.lit(len(HEAD) + 1), F.length(b))
    at = lambda b: F.instr(body(b), COLON)
    role = lambda b: _unescape(F.substring(body(b), F.lit(1), at(b) - 1), ROLE_ESCAPES)
    texts = lambda b: F.split(F.substring(body(b), at(b) + len(COLON), F.length(b)), r"<\+>", -1)
    turn = lambda r, t: F.struct(r.alias("role"), _unescape(t, ESCAPES).alias("text"))
    # a block's role is read once, not once a turn
    return F.flatten(F.flatten(F.transform(blocks, lambda b: F.transform(F.array(role(b)), lambda r: F.transform(texts(b), lambda t: turn(r, t))))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between the turns.

    A span is cut from the strips it lies in, as finding a place in the whole string takes longer the further in it is.
    """
    strips = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{STRIP}}}"), F.lit(0))

    def cut(own: Column, s: Column) -> Column:
        first, last = (F.floor(x / STRIP) for x in (s["start"], s["start"] + F.greatest(s["length"], F.lit(1)) - 1))
        within = F.array_join(F.slice(own, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return F.substring(within, (s["start"] - first * STRIP + 1).cast("int"), s["length"].cast("int"))

    texts = F.transform(F.array(strips), lambda own: F.transform(spans, lambda s: _unescape(cut(own, s), ESCAPES)))
    return F.array_join(F.flatten(texts), "")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    f = format_conversations(turns.unionByName(extra)).withColumns({"t": read_turns(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    return f.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS starts,
         length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '<+>', '\j'), '</turn>', '\t')) AS n,
         length(replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '<+>', '\j'), '</turn>', '\t'), ':', '\c')) AS r
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN starts THEN 4 + r + 2 + 8 ELSE 3 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
