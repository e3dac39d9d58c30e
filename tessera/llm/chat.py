"""Chat formatting: layouts are told apart by a hash of their field paths and mapped to canonical turns.

A record has a fingerprint for each layout its table can hold: the hash of the sorted nested paths of that layout that hold a value
in it. The registry knows the fingerprints of a layout's whole and of none of its paths; these hashes alone select the declarative
mapping (which path gives role, text, order), and they grow with the layouts; see layouts_of() and selected(). Canonical turns are rendered as

    <|turn|>ROLE<|text|>TEXT<|end|>

Control strings in a role or text get one more backslash after their first character, and reading back
takes one away, so any text survives. The loss mask is run-length coded: for each turn the code points before
its text, of its text, after it, and whether the text counts (assistant turns).

Nulls: a null role or text is empty, rows of a null conv_id are one conversation, a null turn sorts first.
Ties and repeated rows: all are kept, in the order of turn, role, text. No rows: no conversations. Very long texts: linear.
Extra columns: ignored, whatever their names; paths outside a table's layouts never enter a fingerprint.
One conversation is one output string, so its turns meet in one task, as that string does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that this template or common chat templates treat as control strings.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_AFTER = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"([<\[])(\\*)({_AFTER})"
UNESCAPE = rf"([<\[])\\(\\*)({_AFTER})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def paths(schema: T.StructType, at: str = "") -> list[str]:
    """The paths of all fields, `[]` for an array's elements."""
    out: list[str] = []
    for f in schema.fields:
        kind, path = f.dataType, f"{at}{f.name}"
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, f"{path}[]"
        out += paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [path]
    return sorted(out)


@dataclass(frozen=True)
class Mapping:
    """Paths of a layout and how its turns come about.

    rows: one record a turn (role, text, order are columns). messages: an array of turns in one record.
    pairs: (path, role) columns of one record, in order; null ones are left out.
    """

    fields: tuple[str, ...]
    kind: str
    role: str = ""
    text: str = ""
    order: str = ""
    pairs: tuple[tuple[str, str], ...] = ()
    array: str = ""

    def turns(self) -> Column:
        """array<struct<turn, role, text>> of a record."""
        c = lambda turn, role, text: F.struct(turn.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))
        if self.kind == "rows":
            return F.array(c(F.col(self.order), F.col(self.role), F.col(self.text)))
        if self.kind == "messages":
            kept = F.coalesce(F.col(self.array), F.array())
            return F.transform(kept, lambda m, i: c(i, m[self.role], m[self.text]))
        given = F.array(*(c(F.lit(i), F.lit(r), F.col(p)) for i, (p, r) in enumerate(self.pairs)))
        return F.filter(given, lambda m: m["text"].isNotNull())


#: The layouts that are known, in order; a record's fingerprint selects one.
LAYOUTS = (
    Mapping(("role", "text", "turn"), "rows", "role", "text", "turn"),
    Mapping(("content", "role", "turn"), "rows", "role", "content", "turn"),
    Mapping(("messages[].content", "messages[].role"), "messages", "role", "content", array="messages"),
    Mapping(("conversations[].from", "conversations[].value"), "messages", "from", "value", array="conversations"),
    Mapping(("completion", "prompt"), "pairs", pairs=(("prompt", "user"), ("completion", "assistant"))),
    Mapping(("input", "instruction", "output"), "pairs", pairs=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping(("instruction", "output"), "pairs", pairs=(("instruction", "user"), ("output", "assistant"))),
    Mapping(("answer", "question", "system"), "pairs", pairs=(("system", "system"), ("question", "user"), ("answer", "assistant"))),
)
#: Role names of other layouts. Fixed values.
ROLES = {"human": "user", "gpt": "assistant"}


def fingerprint(present: list[str]) -> int:
    """The hash of a set of paths; xxhash64() of Spark gives the same."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest("\n".join(sorted(present)), 42)
    return h - (1 << 64) if h >> 63 else h


def layouts_of(have: set[str], layouts: tuple[Mapping, ...] = LAYOUTS) -> list[Mapping]:
    """The layouts that a table of these paths can hold, in the registry's order. One that shares a path with an earlier
    one would only spell it otherwise, and is left out."""
    out: list[Mapping] = []
    for m in layouts:
        if set(m.fields) <= have and not any(set(m.fields) & set(o.fields) for o in out):
            out.append(m)
    return out


def registry(layouts: list[Mapping]) -> list[tuple[int, int]]:
    """For each layout the fingerprints of all of its paths and of none."""
    return [(fingerprint(list(m.fields)), fingerprint([])) for m in layouts]


def selected(own: list[Column], layouts: list[Mapping]) -> Column:
    """The number of a record's layout by its fingerprints: the first one whose paths are all there, else the first with any, else
    (nothing holds a value) the first."""
    known = registry(layouts)
    whole = [F.when(h == full, i) for i, (h, (full, _)) in enumerate(zip(own, known))]
    some = [F.when(h != none, i) for i, (h, (_, none)) in enumerate(zip(own, known))]
    return F.coalesce(*whole, *some, F.lit(0))


def holds(path: str) -> Column:
    """Whether a record has a value at this path, in any element of an array."""
    top, _, inner = path.partition("[].")
    return F.exists(F.col(f"`{top}`"), lambda m: m[inner].isNotNull()) if inner else F.col(f"`{path}`").isNotNull()


def canonical_turns(df: DataFrame, conv_id: str) -> DataFrame:
    """conv_id, turn, role, text of every record of any known layout; each record's fingerprint selects its layout.

    A table without any known layout is an error. A record that fills several layouts is read by the registry's first.
    """
    have = paths(T.StructType([f for f in df.schema.fields if f.name != conv_id]))
    fits = layouts_of(set(have))
    if not fits:
        raise ValueError(f"no layout has the fields {have}, fingerprint {fingerprint(have)}")
    known = sorted({p for m in fits for p in m.fields})
    own = lambda m: F.xxhash64(F.array_join(F.array_compact(F.array(*(F.when(holds(p), F.lit(p)) for p in sorted(m.fields)))), "\n"))
    turns = fits[0].turns()
    for i, m in enumerate(fits[1:], 1):
        turns = F.when(F.col("_layout") == i, m.turns()).otherwise(turns)
    tops = dict.fromkeys(re.split(r"\[\]|\.", p)[0] for p in known)
    read = df.select(F.col(conv_id).cast("long").alias("_conv"), selected([own(m) for m in fits], fits).alias("_layout"), *(F.col(f"`{c}`") for c in tops if c != conv_id))
    out = read.select(F.col("_conv").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")
    role = F.coalesce(F.col("role"), F.lit(""))
    if any(m.kind == "messages" for m in fits):
        for other, name in ROLES.items():
            role = F.when(F.col("role") == other, F.lit(name)).otherwise(role)
    return out.withColumn("role", role).withColumn("text", F.coalesce("text", F.lit("")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<before, text, after, loss>> of each conversation."""
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    said = rows.select("conv_id", F.transform("rows", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss"))).alias("rows"))
    piece = lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))
    run = lambda t: F.struct((F.length(t["role"]) + len(TURN) + len(TEXT)).alias("before"), F.length(t["text"]).alias("text"), F.lit(len(END)).alias("after"), t["loss"].alias("loss"))
    return said.select("conv_id", F.array_join(F.transform("rows", piece), "").alias("formatted"), F.transform("rows", run).alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and loss texts of the formatted strings alone, by markers and mask."""
    pieces = F.filter(F.split(F.col("formatted"), re.escape(TURN)), lambda p: p != "")
    strip = lambda p: F.substring(p, F.lit(1), F.length(p) - len(END))
    turn = lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring(strip(p), F.instr(p, TEXT) + len(TEXT), F.length(p))).alias("text"))
    masked = F.transform(
        F.filter(F.arrays_zip(pieces.alias("p"), F.col("loss_mask").alias("m")), lambda x: x["m"]["loss"]),
        lambda x: unescape(F.substring(x["p"], x["m"]["before"] - len(TURN) + 1, x["m"]["text"])),
    )
    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(masked, ""))


def digest(chats: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(chats).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PLANTED = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rows by turn, and conversation -7, a record with an array of messages."""
    own = spark.sql(f"SELECT -7L AS conv_id, array(named_struct('role', 'user', 'content', '{PLANTED}'), named_struct('role', 'assistant', 'content', '{PLANTED}')) AS messages")
    turns = canonical_turns(table(spark, sf_dir, "conversations"), "conv_id")
    return digest(format_chats(turns.unionByName(canonical_turns(own, "conv_id"))))


ORACLE_OP1 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
e AS (
  SELECT *, length(role) + length(text)
    + length(regexp_replace(role, '{ESCAPE}', '\1#\2\3', 'g')) - length(role)
    + length(regexp_replace(text, '{ESCAPE}', '\1#\2\3', 'g')) - length(text)
    + {len(TURN + TEXT + END)} AS width FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(width) AS width FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(width AS BIGINT) AS formatted_chars FROM g
"""
