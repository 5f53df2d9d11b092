"""Chat formatting: records of unlike layouts become canonical turns, and those a marked text.

A record's nested field paths, as far as any layout knows them, are hashed to a fingerprint, which
selects the declarative mapping from that layout to turns. All of it is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What no text may hold as it stands: the marks above (all begin with "<|") and those of common chat models.
CONTROL = ["<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
ESCAPES = {"<": "&lt;", "[": "&#91;"}
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """One layout of records.

    Either ``messages`` names an array and its members for role and text, or ``parts`` lists the
    turns in order: a role, and the members that its text joins (a line feed between, nulls and
    empty ones left out). ``roles`` renames roles.
    """

    name: str
    messages: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> set[str]:
        """The field paths that records of this layout have; [] stands for the members of an array."""
        if self.messages is not None:
            array, *members = self.messages
            return {f"{array}[].{m}" for m in members}
        return {m for _, members in self.parts for m in members}

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()

    def turns(self, record: Column) -> Column:
        def get(path: str, kind: str) -> Column:
            return F.try_variant_get(record, f"$.{path}", kind)

        if self.messages is None:
            return F.array(*(F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*(get(m, "string") for m in members)), lambda x: x != ""), "\n").alias("text")) for role, members in self.parts))
        array, role, text = self.messages

        def turn(x: Column) -> Column:
            named = reduce(lambda c, r: F.when(x[role] == r[0], r[1]).otherwise(c), self.roles, F.coalesce(x[role], F.lit("")))
            return F.struct(named.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

        return F.transform(get(array, f"array<struct<`{role}`:string,`{text}`:string>>"), turn)


LAYOUTS = [
    Layout("messages", messages=("messages", "role", "content")),
    Layout("shared", messages=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system_prompt", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", parts=(("user", ("question",)), ("assistant", ("answer",)))),
]


def has_path(record: Column, path: str) -> Column:
    """Whether a variant record has the field ``path``; in an array, whether any member has."""
    head, _, tail = path.partition("[].")
    if not tail:
        return F.try_variant_get(record, f"$.{path}", "variant").isNotNull()
    members = F.try_variant_get(record, f"$.{head}", "array<variant>")
    return F.coalesce(F.exists(members, lambda x: has_path(x, tail)), F.lit(False))


def fingerprint(record: Column, layouts: list[Layout] = LAYOUTS) -> Column:
    """The SHA-256 of those nested field paths of a variant record that any of ``layouts`` knows; other members do not matter."""
    known = sorted(set().union(*(x.paths for x in layouts)))
    return F.sha2(F.array_join(F.array(*(F.when(has_path(record, p), p) for p in known)), "\n"), 256)


def escape(text: Column) -> Column:
    """``text`` without control strings: each loses its first character to an entity, and ``&`` becomes one too."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(ESCAPES[s[0]] + s[1:])), CONTROL, F.replace(text, F.lit("&"), F.lit("&amp;")))


def unescape(text: Column) -> Column:
    for plain, entity in [*ESCAPES.items(), ("&", "&amp;")]:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def format_chats(records: DataFrame, *, record: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with its variant column ``record`` replaced by the formatted chat.

    New columns: ``layout`` (the name of the mapping, null where no layout has the record's
    fingerprint), ``formatted`` (each turn as mark, role, mark, text, mark; roles and texts
    escaped) and ``loss_spans``, an array of (start, chars): where assistant texts stand in
    ``formatted``, from code point 1 on. Columns of ``records`` of these names are replaced, and
    _print and _turns dropped.

    Members that no layout knows do not matter. Records with the paths of no layout, or of several
    at once, and null records, have a null ``layout``, by which to count them, and no turns: an
    empty text and no spans.
    Null roles and texts are empty ones. Empty messages have no turns. Repeated rows are formatted
    alike. An empty table gives an empty one. Each row is formatted where it lies; nothing is shuffled.
    """
    marked = records.drop("_turns").withColumn("_print", fingerprint(F.col(record), layouts))
    cases = [(F.col("_print") == x.fingerprint, x) for x in layouts]
    name = F.coalesce(*(F.when(hit, x.name) for hit, x in cases))
    turns = F.coalesce(*(F.when(hit, x.turns(F.col(record))) for hit, x in cases), F.array().cast("array<struct<role:string,text:string>>"))
    marked = marked.select(*(c for c in records.columns if c not in (record, "layout", "formatted", "loss_spans", "_print", "_turns")), name.alias("layout"), turns.alias("_turns"))
    escaped = marked.withColumn("_turns", F.transform("_turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))))
    formatted = F.array_join(F.transform("_turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))), "")

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + len(TURN) + F.length(t["role"]) + len(TEXT)
        span = F.struct(start.alias("start"), F.length(t["text"]).alias("chars"))
        spans = F.when(t["role"] == TRAINED_ROLE, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((start + F.length(t["text"]) + len(END)).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))
    spans = F.aggregate("_turns", start, step, lambda s: s["spans"])
    return escaped.withColumns({"formatted": formatted, "loss_spans": spans}).drop("_turns")


def read_turns(formatted: Column) -> Column:
    """The turns, as an array of (role, text), of a text that format_chats made."""
    pieces = F.split(formatted, F.lit(END.replace("|", r"\|")))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        return F.struct(
            unescape(F.substring_index(F.substring_index(piece, TEXT, 1), TURN, -1)).alias("role"),
            unescape(F.substring_index(piece, TEXT, -1)).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["chars"]))), "")


def pack_records(turns: DataFrame) -> DataFrame:
    """One record for each conv_id of ``turns`` (conv_id, turn, role, text), in the layout that suits its turns.

    Turns are in the order of turn, ties by role and text; null roles and texts are empty. One
    question and answer, alone or after a system text, make a prompt record, others messages.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    roles = F.transform("rows", lambda r: r["role"])

    def has(*names: str) -> Column:
        return roles == F.array(*map(F.lit, names))

    text = lambda i: F.col("rows")[i]["content"]
    record = (
        F.when(has("user", "assistant"), F.to_variant_object(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(has("system", "user", "assistant"), F.to_variant_object(F.struct(text(1).alias("prompt"), text(2).alias("response"), text(0).alias("system"))))
        .otherwise(F.to_variant_object(F.struct(F.transform("rows", lambda r: F.struct(r["content"].alias("content"), r["role"].alias("role"))).alias("messages"))))
    )
    return chats.select("conv_id", record.alias("record"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = format_chats(pack_records(given.unionByName(probe)))
    read = chats.select(
        "conv_id", "layout", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def _sql_escape(x: str) -> str:
    x = f"replace({x}, '&', '&amp;')"
    for s in CONTROL:
        x = f"replace({x}, '{s}', '{ESCAPES[s[0]] + s[1:]}')"
    return x


ORACLE = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
chats AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum({len(TURN) + len(TEXT) + len(END)} + length({_sql_escape("role")}) + length({_sql_escape("text")}))::BIGINT AS formatted_chars,
         list(role ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM given GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       CASE WHEN roles = ['user', 'assistant'] THEN 'prompt'
            WHEN roles = ['system', 'user', 'assistant'] THEN 'system_prompt' ELSE 'messages' END AS layout
FROM chats
"""
