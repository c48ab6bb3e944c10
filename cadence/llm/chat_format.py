"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

Prompt, instruction and message layouts may stand in one table. For each row the paths
of its non-null nested fields are hashed; the hash selects one of the declared mappings,
which builds canonical turns ``array<struct<role,text>>``. Turns are put in a template,
with a loss mask over the assistant texts as ranges of code points.

Control strings inside texts are escaped reversibly: in every ``<``, backslashes, ``|``
one backslash is added, so ``<|`` occurs in markers only.

Column expressions only; rows are formatted where they are. A conversation is one row
by nature; ``gather_turns`` sorts the turns of each conversation and combines nothing
across conversations.

Defined results: null roles and texts count as empty; rows of equal turn number are
ordered by role, then text, and repeated rows are repeated turns; a null conversation id
is a conversation of its own; no rows give no rows; a row whose fingerprint no mapping
has keeps null turns and ``layout`` unknown; a very long text or conversation is one row, formatted whole; columns that no layout names are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"

#: layout -> the mappings of its field paths to turns: (role, path) pairs, or
#: (path of the array, field of the role, field of the text).
LAYOUTS: dict[str, list[tuple[str, str]] | tuple[str, str, str]] = {
    "prompt": [("user", "prompt"), ("assistant", "response")],
    "prompt_system": [("system", "system"), ("user", "prompt"), ("assistant", "response")],
    "instruction": [("user", "instruction"), ("assistant", "output")],
    "instruction_input": [("system", "instruction"), ("user", "input"), ("assistant", "output")],
    "messages": ("messages", "role", "content"),
    "conversations": ("conversations", "from", "value"),
}
#: Other names of the canonical roles, in the layouts that use them; elsewhere such a name stays as it is.
ROLES = {"conversations": {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}}


def _paths(layout) -> list[str]:
    if isinstance(layout, tuple):
        return [f"{layout[0]}[].{f}" for f in layout[1:]]
    return [p for _, p in layout]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _fingerprints(layout) -> list[str]:
    """Those of a layout's rows: in an array the role or the text may be null in all elements."""
    if not isinstance(layout, tuple):
        return [fingerprint(_paths(layout))]
    both = _paths(layout)
    return [fingerprint(x) for x in (both, both[:1], both[1:])]


FINGERPRINTS = {name: _fingerprints(x) for name, x in LAYOUTS.items()}


def _leaves(kind: T.DataType, path: str) -> list[str]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        return _leaves(kind.elementType, f"{path}[]")
    return [path]


def _present(path: str) -> Column:
    """Whether a field is non-null; in an array, in any element (an empty one shows the fields of its type)."""
    top, _, field = path.partition("[].")
    if not field:
        return F.col(top).isNotNull()
    return F.col(top).isNotNull() & ((F.size(top) == 0) | F.exists(top, lambda m: m[field].isNotNull()))


def row_fingerprint(df: DataFrame) -> Column:
    """Hash of the sorted paths of a row's non-null fields, of those that some layout names."""
    known = {p for x in LAYOUTS.values() for p in _paths(x)}
    there = [p for p in _leaves(df.schema, "") if p in known]
    present = [F.when(_present(p), F.lit(p)) for p in sorted(there)]
    paths = F.filter(F.array(*present), lambda p: p.isNotNull()) if present else F.array().cast("array<string>")
    return F.sha2(F.concat_ws("\n", paths), 256)


def canonical_turns(df: DataFrame) -> DataFrame:
    """Adds ``layout`` and ``turns``."""
    names = {f for f in df.columns}
    turns, layout = F.lit(None).cast(TURNS), F.lit("unknown")
    df = df.withColumn("fingerprint", row_fingerprint(df))
    for name, x in LAYOUTS.items():
        if not {p.split("[]")[0] for p in _paths(x)} <= names:
            continue
        if isinstance(x, tuple):
            made = F.transform(F.col(x[0]), _turn_of(x[1], x[2], ROLES.get(name, {})))
        else:
            made = F.array(*[F.struct(F.lit(r).alias("role"), F.col(p).alias("text")) for r, p in x])
        mine = F.col("fingerprint").isin(*FINGERPRINTS[name])
        turns, layout = F.when(mine, made.cast(TURNS)).otherwise(turns), F.when(mine, F.lit(name)).otherwise(layout)
    return df.withColumns({"layout": layout, "turns": turns})


def _turn_of(role: str, text: str, aliases: dict[str, str]):
    def turn(m: Column) -> Column:
        name = m[role]
        for other, canonical in aliases.items():
            name = F.when(m[role] == other, F.lit(canonical)).otherwise(name)
        return F.struct(F.coalesce(name, F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))
    return turn


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(turn["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))


def format_chat(df: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` (array of start, end; end exclusive) to rows with ``turns``."""
    parts = F.transform("turns", lambda t: F.struct(
        _head(t).alias("head"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    tail = END + "\n"
    df = df.withColumn("_parts", parts)
    span = "array<struct<start:int,end:int>>"
    masked = F.aggregate(
        "_parts", F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["text"]) + len(tail)).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"),
                (acc["at"] + F.length(p["head"]) + F.length(p["text"])).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["text"], F.lit(tail))), "")
    return df.withColumns({"formatted": text, "loss_mask": masked}).drop("_parts")


def read_back(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"),
                        unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def gather_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv_id, messages`` from a table with one row per turn."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    got = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("messages"))
    return got.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"),
                                                                                m["content"].alias("content"))))


def as_layouts(gathered: DataFrame) -> DataFrame:
    """Gathered messages in the plainest layout that holds them: prompt and response, instruction with input
    and output, human and gpt conversations, else messages."""
    roles = F.array_join(F.transform("messages", lambda m: F.when(
        m["role"].isin("system", "user", "assistant"), m["role"]).otherwise(F.lit("?"))), ",")
    said = F.col("messages")
    kind = (F.when(roles == "user,assistant", "prompt").when(roles == "system,user,assistant", "instruction_input")
            .when(roles.rlike("^user(,assistant,user)+$"), "conversations").otherwise("messages"))
    df = gathered.withColumn("_kind", kind)

    def text(layout: str, k: int) -> Column:
        return F.when(F.col("_kind") == layout, F.get(said, F.lit(k))["content"])

    shared = F.transform(said, lambda m: F.struct(
        F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"),
        m["content"].alias("value")))
    return df.select(
        "conv_id", text("prompt", 0).alias("prompt"), text("prompt", 1).alias("response"),
        text("instruction_input", 0).alias("instruction"), text("instruction_input", 1).alias("input"),
        text("instruction_input", 2).alias("output"),
        F.when(F.col("_kind") == "conversations", shared).alias("conversations"),
        F.when(F.col("_kind") == "messages", said).alias("messages"))
