"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role are merged
into a block by array functions, and the blocks are concatenated. Inside texts
and roles the characters that control strings begin with are escaped, so that no
text can end a turn or open another, and the formatted string can be read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, JOIN, CLOSE = "### ", ": ", "<turn/>", "</turn>\n"


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _replace(expr: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {_q(old)}, {_q(new)})"
    return expr


def _escape(expr: str) -> str:
    return _replace(expr, ("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def _escape_text(expr: str) -> str:
    return _replace(expr, ("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))


def _unescape(expr: str) -> str:
    """Pairs of backslashes are split off first, so what is left of each escape is unambiguous."""
    parts = _replace("u", ("\\h", "#"), ("\\l", "<"), ("\\c", ":"))
    return f"array_join(transform(split({expr}, {_q('[\\\\][\\\\]')}), u -> {parts}), {_q('\\')})"


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv id, ``formatted`` and ``loss_spans`` (start, length in code points of ``formatted``).

    A block is ``### role: text</turn>``; texts of adjacent turns of one role share
    a block, with ``<turn/>`` between them. The loss spans cover exactly the escaped
    texts of ``loss_role``. Turns are ordered by turn number, then role, then text,
    nulls first, so ties and repeated rows have one order. A null role or text counts
    as empty; rows with a null conversation id form one conversation. No turns, no
    row. Other columns are ignored. A conversation is one string, so its length is
    bounded by what one Spark value can hold (2 GB).
    """
    named = turns.select(
        F.col(f"`{conv_col}`").alias("c"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = named.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("a"))
    starts = "filter(sequence(0, size(a) - 1), i -> i = 0 OR a[i].role <> get(a, i - 1).role)"
    body = f"array_join(transform(slice(a, s + 1, coalesce(get(starts, k + 1), size(a)) - s), t -> {_escape_text('t.text')}), {_q(JOIN)})"
    piece_lengths = f"transform(slice(a, s + 1, coalesce(get(starts, k + 1), size(a)) - s), t -> length({_escape_text('t.text')}))"
    blocks = (
        sorted_turns.withColumn("starts", F.expr(starts))
        .withColumn(
            "blocks",
            F.expr(f"transform(starts, (s, k) -> named_struct('role', a[s].role, 'head', concat({_q(OPEN)}, {_escape('a[s].role')}, {_q(ROLE_END)}), 'body', {body}, 'lengths', {piece_lengths}))"),
        )
        .withColumn("formatted", F.expr(f"array_join(transform(blocks, b -> concat(b.head, b.body, {_q(CLOSE)})), '')"))
        # position and length of each text, marked where it is under the loss
        .withColumn(
            "marks",
            F.expr(f"flatten(transform(blocks, b -> transform(b.lengths, (n, j) -> named_struct('before', if(j = 0, length(b.head), {len(JOIN)}), 'n', n, 'after', if(j = size(b.lengths) - 1, {len(CLOSE)}, 0), 'loss', b.role = {_q(loss_role)}))))"),
        )
        .withColumn(
            "loss_spans",
            F.expr(
                "aggregate(marks, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>)),"
                " (acc, m) -> named_struct('at', acc.at + m.before + m.n + m.after, 'spans', if(m.loss, concat(acc.spans, array(named_struct('start', acc.at + m.before, 'length', cast(m.n as bigint)))), acc.spans)),"
                " acc -> acc.spans)"
            ),
        )
    )
    return blocks.select(F.col("c").alias(conv_col), "formatted", "loss_spans")


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The turns and the texts under the loss, from ``formatted`` and ``loss_spans`` alone."""
    blocks = f"filter(split(formatted, {_q(CLOSE)}), b -> b <> '')"
    role = _unescape(f"substring(b, {len(OPEN) + 1}, locate({_q(ROLE_END)}, b) - {len(OPEN) + 1})")
    texts = f"split(substring(b, locate({_q(ROLE_END)}, b) + {len(ROLE_END)}), {_q(JOIN)})"
    return formatted.select(
        F.col(f"`{conv_col}`").alias(conv_col),
        "formatted",
        F.expr(f"flatten(transform({blocks}, b -> transform({texts}, t -> named_struct('role', {role}, 'text', {_unescape('t')}))))").alias("turns"),
        F.expr(f"transform(loss_spans, s -> {_unescape('substring(formatted, cast(s.start + 1 as int), cast(s.length as int))')})").alias("loss_texts"),
    )


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    back = read_back(format_chats(table.unionByName(extra)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr(r"sha2(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), ''), 256)").alias("turns_sha256"),
        F.expr("aggregate(loss_texts, 0L, (n, t) -> n + length(t))").alias("loss_chars"),
        F.expr("sha2(array_join(loss_texts, ''), 256)").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') AS shown,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') AS shown_role,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS goes_on
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown) + CASE WHEN goes_on THEN 7 ELSE 4 + length(shown_role) + 2 + 8 END)::bigint AS formatted_chars
FROM e GROUP BY conv_id
"""
