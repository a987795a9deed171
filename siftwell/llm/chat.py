"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a rendered conversation::

    <chat esc="LEVEL">\\n   then for each turn   ### ROLE\\nTEXT</turn>\\n

The parser is deterministic: it splits at the closing mark, takes the role up to the first line
break, and rejects a control string anywhere else. Level 0 renders texts as they are. If what
the parser recovers differs from the source, the next level escapes the conflicting content
(percent codes), and so on until the two are identical; a conversation that no level can carry
fails the job.

Work is linear in a conversation's turns (but for the sort): places are prefix sums of byte lengths
in two levels, and texts are cut out of the rendered bytes by place.

Turns are ordered by (turn, role, text). A null role or text is empty; repeated rows are turns of
their own; a null conv_id is a conversation. A conversation is one output row, so its turns come
together in one task. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.arrays import let, sums_before

CLOSE = "</turn>\n"
OPEN = "### "
LEARNT = "assistant"
#: Escapes of level 1, in order of application; undone in reverse.
ESCAPES = [("%", "%25"), ("<", "%3C"), ("#", "%23"), ("\n", "%0A")]


def escape(text: Column, level: int, line_breaks: bool) -> Column:
    for raw, code in ESCAPES if level else []:
        if raw != "\n" or line_breaks:
            text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, level: Column) -> Column:
    plain = text
    for raw, code in reversed(ESCAPES):
        plain = F.replace(plain, F.lit(code), F.lit(raw))
    return F.when(level == 0, text).otherwise(plain)


def header(level: int) -> str:
    return f'<chat esc="{level}">\n'


HEADER_CHARS = len(header(0))


def render(turns: Column, level: int) -> Column:
    one = F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"], level, True), F.lit("\n"), escape(t["text"], level, False), F.lit(CLOSE)))
    return F.concat(F.lit(header(level)), F.array_join(one, ""))


def parsed(formatted: Column) -> Column:
    """array of (role, text, start, bytes): the escaped text is ``bytes`` bytes from ``start`` on; null if it breaks the grammar."""
    level = F.substring(formatted, HEADER_CHARS - 3, 1).cast("int")
    pieces = F.split(F.substring(formatted, HEADER_CHARS + 1, 1 << 30), CLOSE, -1)

    def fits(piece: Column) -> Column:
        inner = F.substring(piece, len(OPEN) + 1, 1 << 30)
        return piece.startswith(OPEN) & (F.instr(piece, "\n") > 0) & ~inner.contains(OPEN) & ~inner.contains(CLOSE.strip())

    def read(piece: Column) -> Column:
        role_end = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(OPEN) + 1), role_end - len(OPEN) - 1)
        text = F.substring(piece, role_end + 1, F.length(piece))
        head = F.octet_length(piece) - F.octet_length(text)
        return F.struct(unescape(role, level).alias("role"), unescape(text, level).alias("text"), head.cast("long").alias("head"), F.octet_length(text).cast("long").alias("bytes"))

    def placed(turns: Column) -> Column:
        sizes = F.transform(turns, lambda t: t["head"] + t["bytes"] + len(CLOSE))
        starts = let(sizes, sums_before)
        return let(starts, lambda before: F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("text"), (F.element_at(before, i + 1) + t["head"] + HEADER_CHARS).alias("start"), t["bytes"].alias("bytes"))))

    def whole(ps: Column) -> Column:
        turns = F.slice(ps, 1, F.size(ps) - 1)
        return F.when((F.element_at(ps, -1) == "") & F.forall(turns, fits), let(F.transform(turns, read), placed))

    return let(pieces, whole)


def same(found: Column, turns: Column) -> Column:
    return F.coalesce(F.transform(found, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == turns, F.lit(False))


def format_chats(rows: DataFrame, levels: int = 2) -> DataFrame:
    """conv_id, formatted, level, turns (role, text, start, bytes as read back), loss spans (bytes of ``formatted``) of the learnt role."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("sorted"))
    source = chats.select("conv_id", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    tried = source.withColumn("formatted", render(F.col("source"), 0)).withColumn("turns", parsed(F.col("formatted")))
    for level in range(1, levels):
        fine = same(F.col("turns"), F.col("source"))
        tried = tried.withColumn("formatted", F.when(fine, F.col("formatted")).otherwise(render(F.col("source"), level)))
        tried = tried.withColumn("turns", F.when(fine, F.col("turns")).otherwise(parsed(F.col("formatted"))))
    checked = F.when(same(F.col("turns"), F.col("source")), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("no escape level carries conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    out = tried.select("conv_id", "formatted", F.substring("formatted", HEADER_CHARS - 3, 1).cast("int").alias("level"), checked.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == LEARNT), lambda t: F.struct(t["start"].alias("start"), t["bytes"].alias("bytes")))
    return out.withColumn("loss", spans)


def digest(chats: DataFrame) -> DataFrame:
    """The contract's columns, all read back from ``formatted`` and its spans."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    cut = let(F.col("formatted").cast("binary"), lambda raw: F.transform("loss", lambda s: F.substring(raw, (s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string")))
    masked = F.array_join(F.transform(cut, lambda x: unescape(x, F.col("level"))), "")
    seen = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"))
    return seen.select("conv_id", "n_turns", "turns_sha256", F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, bool_or(contains(text, '</turn>') OR contains(text, '### ')) OVER (PARTITION BY conv_id) AS esc FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(13 + length(role) + length(text) + CASE WHEN esc THEN 2 * (length(text) - length(replace(replace(replace(text, '%', ''), '<', ''), '#', ''))) ELSE 0 END) + 15)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
