"""Chat formatting: a template whose grammar round-trips (DataFrame operations only).

Grammar of a formatted conversation (`form` is "raw" or "escaped"):

    conversation := ["<s>!"] turn*
    turn         := "[INST]" role "\n" text "[/INST]</s>"

The parser is deterministic: it cuts at "[/INST]</s>", drops one "[INST]" from each piece and splits at the first
newline. A conversation is first rendered as it is and parsed again. If the parsed turns differ from the source, or
a control string stands anywhere but where the template put it, its content is escaped: backslashes double, a
backslash is put behind the first character of every control string, and a newline inside a role becomes
"<" "\\" "n>". Unescaping is the exact inverse, so the second parse is always identical; `round_trip` records that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.llm.common import table

OPEN, CLOSE, MARK = "[INST]", "[/INST]</s>", "<s>!"
CONTROL = r"(</?s>|\[/?INST\])"
ESCAPED = r"(<|\[)\\(/?s>|/?INST\])"


def escape(x: Column, role: bool = False) -> Column:
    doubled = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(doubled, r"(<|\[)(/?s>|/?INST\])", r"$1\\$2")
    return F.replace(out, F.lit("\n"), F.lit("<\\n>")) if role else out


def unescape(x: Column, role: bool = False) -> Column:
    out = F.replace(x, F.lit("<\\n>"), F.lit("\n")) if role else x
    return F.replace(F.regexp_replace(out, ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def render(turns: Column, escaped: bool) -> Column:
    """The formatted conversation of an array of (role, text)."""
    same = lambda x, role=False: escape(x, role) if escaped else x
    pieces = F.transform(turns, lambda t: F.concat(F.lit(OPEN), same(t["role"], True), F.lit("\n"), same(t["text"]), F.lit(CLOSE)))
    return F.concat(F.lit(MARK if escaped else ""), F.array_join(pieces, ""))


def pieces_of(rendered: Column) -> Column:
    """The turns of a formatted conversation, each without its closing string."""
    body = F.when(rendered.startswith(MARK), F.substr(rendered, F.lit(len(MARK) + 1))).otherwise(rendered)
    cut = F.split(body, r"\[/INST\]</s>", -1)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def parse(rendered: Column) -> Column:
    """The array of (role, text) that the grammar finds."""
    escaped = rendered.startswith(MARK)

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        role, text = F.substr(p, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1), F.substr(p, cut + 1)
        return F.struct(F.when(escaped, unescape(role, True)).otherwise(role).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"))

    return F.transform(pieces_of(rendered), turn)


def loss_spans(rendered: Column, role: str = "assistant") -> Column:
    """Where the texts of a role stand in the formatted conversation: array of (start, length), in code points from 0."""
    pieces = pieces_of(rendered)
    first = F.when(rendered.startswith(MARK), F.lit(len(MARK))).otherwise(F.lit(0))
    zero = F.struct(first.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        cut = F.instr(p, "\n")
        span = F.struct((acc["at"] + cut).cast("int").alias("start"), (F.length(p) - cut).cast("int").alias("length"))
        hit = p.startswith(OPEN + role + "\n")
        return F.struct((acc["at"] + F.length(p) + len(CLOSE)).alias("at"), F.when(hit, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Format every conversation. Rows of one conversation are ordered by turn, then role, then text; a null turn comes first,
    a null role or text counts as empty, each row without conv_id is a conversation of its own with a null id, and repeated
    rows are repeated turns. Texts are formatted whole, however long. Other columns of `rows` are ignored, whatever their
    names; an empty table gives no rows. The turns of one conversation meet in one row, as its format is one string.

    Returns conv_id, rendered, form, round_trip, loss_spans.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    alone = F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("alone")
    turns = rows.select(F.col(conv).alias("conv_id"), alone, F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    grouped = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    raw = grouped.withColumn("raw", render(F.col("turns"), False))
    clean = (F.regexp_count("raw", F.lit(CONTROL)) == 3 * F.size("turns")) & (parse(F.col("raw")) == F.col("turns"))
    rendered = F.when(clean, F.col("raw")).otherwise(render(F.col("turns"), True))
    out = raw.withColumn("rendered", rendered).drop("raw")
    return out.select("conv_id", "rendered", F.when(F.col("rendered").startswith(MARK), "escaped").otherwise("raw").alias("form"), (parse(F.col("rendered")) == F.col("turns")).alias("round_trip"), loss_spans(F.col("rendered")).alias("loss_spans"))


def loss_text(rendered: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one after another."""
    escaped = rendered.startswith(MARK)

    def one(s: Column) -> Column:
        part = F.substr(rendered, s["start"] + 1, s["length"])
        return F.when(escaped, unescape(part)).otherwise(part)

    return F.array_join(F.transform(spans, one), "")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, read back from their formatted strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, :said AS text UNION ALL SELECT -7L, 1L, 'assistant', :said", args={"said": said})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = format_conversations(rows)
    back = done.select("conv_id", "rendered", parse(F.col("rendered")).alias("turns"), loss_text(F.col("rendered"), F.col("loss_spans")).alias("loss"), "form", "round_trip")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("rendered").cast("long").alias("formatted_chars"),
        "form", "round_trip",
    )


_ESC = r"regexp_replace(replace({x}, '\', '\\'), '(<|\[)(/?s>|/?INST\])', '\1\\\2', 'g')"
_CONTROL = r"'</?s>|\[/?INST\]'"
OP7_SQL = rf"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS body,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    string_agg('[INST]' || role || chr(10) || text || '[/INST]</s>', '' ORDER BY turn, role, text) AS raw,
    string_agg('[INST]' || {_ESC.format(x="role")} || chr(10) || {_ESC.format(x="text")} || '[/INST]</s>', '' ORDER BY turn, role, text) AS esc
  FROM c GROUP BY conv_id, alone
), f AS (
  SELECT *, len(regexp_extract_all(raw, {_CONTROL})) = 3 * n_turns AS clean FROM g
)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CASE WHEN clean THEN length(raw) ELSE 4 + length(esc) END AS formatted_chars,
  CASE WHEN clean THEN 'raw' ELSE 'escaped' END AS form, true AS round_trip
FROM f
"""
