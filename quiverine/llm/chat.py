"""Chat formatting by schema fingerprints, with DataFrame operations only.

Records of many layouts (prompt and response, instruction with input and output,
lists of messages) stand in one table. A record's fingerprint is a hash of the nested
field paths that it fills; it selects one of the declared layouts, and the layout says
how the fields become canonical turns. Turns are then written with a template that
marks them, and control strings inside texts are escaped so that they can be restored.

Defined results: a null role or text counts as empty; turns are taken by turn number,
nulls last, and by role and text among equal ones; turns with a null conversation id are
one conversation, gathered in one row as every conversation is; a record whose fields fit no layout
has null turns and a null output; an empty list gives no turns and an empty output; an
empty table gives no rows; further columns, also ones named like this module's own,
are kept by ``canonical`` and otherwise not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name

TURNS = "array<struct<role:string,text:string>>"
#: The template's control strings.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Layout:
    """A declared layout: which paths its records fill, and how they become turns.

    ``fields`` are (role, path) in order. ``items`` names a list of structs with the
    paths of role and text in it. ``optional`` paths may be empty. ``roles`` renames
    roles; others stay as they are.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> list[str]:
        listed = [f"{self.items[0]}[].{x}" for x in self.items[1:]] if self.items else []
        return sorted({*(p for _, p in self.fields), *listed})

    def variants(self) -> list[list[str]]:
        """The sets of paths that a record of this layout may fill."""
        return [[p for p in self.paths if p not in left] for n in range(len(self.optional) + 1) for left in combinations(self.optional, n)]


LAYOUTS = (
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question", fields=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths: Iterable[Column]) -> Column:
    """A hash of the paths that are not null; the paths come in sorted order."""
    return F.xxhash64(F.concat_ws("\n", *paths))


def _leaf(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a nested path, where ``[]`` steps into a list; None if there is none."""
    at: T.DataType | None = schema
    for step in path.split("."):
        name = step.removesuffix("[]")
        if not isinstance(at, T.StructType) or name not in at.fieldNames():
            return None
        at = at[name].dataType
        if step.endswith("[]"):
            at = at.elementType if isinstance(at, T.ArrayType) else None
    return at


def _filled(schema: T.StructType, path: str) -> Column:
    """The path itself where a record fills it, else null."""
    if _leaf(schema, path) is None:
        return F.lit(None).cast("string")
    head, listed, _ = path.partition("[].")
    # A list counts as filled by being there: an empty one still tells the layout.
    return F.when(F.col(head).isNotNull(), F.lit(path)) if listed else F.when(F.col(path).isNotNull(), F.lit(path))


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    return reduce(lambda other, x: F.when(role == x[0], F.lit(x[1])).otherwise(other), roles.items(), role)


def _turns(layout: Layout, paths: Sequence[str], schema: T.StructType) -> Column:
    if any(_leaf(schema, p) is None for p in paths):
        return F.lit(None).cast(TURNS)
    if layout.items:
        items, role, text = layout.items
        return F.transform(F.col(items), lambda m: F.struct(_renamed(m[role], layout.roles).alias("role"), F.coalesce(m[text].cast("string"), F.lit("")).alias("text"))).cast(TURNS)
    return F.array(*[F.struct(F.lit(role).alias("role"), F.col(p).cast("string").alias("text")) for role, p in layout.fields if p in paths]).cast(TURNS)


def canonical(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """The records with two more columns: ``layout`` and ``turns`` (lengthened names where those are taken)."""
    schema = records.schema
    known = sorted({p for layout in layouts for p in layout.paths})
    print_ = fingerprint([_filled(schema, p) for p in known])
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        for paths in reversed(layout.variants()):
            fits = print_ == fingerprint([F.lit(p) for p in sorted(paths)])
            name = F.when(fits, F.lit(layout.name)).otherwise(name)
            turns = F.when(fits, _turns(layout, paths, schema)).otherwise(turns)
    return records.withColumns({free_name(records, "layout"): name, free_name(records, "turns"): turns})


def escaped(text: Column) -> Column:
    """The text with a backslash more in each ``<|``, ``<\\|``, ...; so none has the template's marks."""
    return F.regexp_replace(text, r"<(\\*)\|", "<\\\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def formatted(turns: Column) -> Column:
    """The turns as one string. Roles are URL-encoded, so that any role can be restored."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE))), "")


def loss_spans(turns: Column, learned: str = "assistant") -> Column:
    """Where the learned texts stand in the formatted string: start (from 0) and length in code points."""
    sized = F.transform(
        turns,
        lambda t: F.struct(
            (t["role"] == learned).alias("learn"), (F.length(F.url_encode(t["role"])) + len(OPEN) + 1).alias("lead"), F.length(escaped(t["text"])).alias("size")
        ),
    )
    spans = F.array().cast("array<struct<start:int,size:int>>")
    return F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), spans.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["lead"] + t["size"] + len(CLOSE)).alias("at"),
            F.when(t["learn"], F.array_append(acc["spans"], F.struct((acc["at"] + t["lead"]).alias("start"), t["size"].alias("size")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def format_chats(records: DataFrame, id_col: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """One row per record: its id, layout, formatted string and loss_spans."""
    own = canonical(records, layouts)
    layout, turns = own.columns[-2:]
    return own.select(id_col, F.col(layout).alias("layout"), formatted(F.col(turns)).alias("formatted"), loss_spans(F.col(turns)).alias("loss_spans"))


def parsed(text: Column) -> Column:
    """The turns of a formatted string."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    return F.transform(
        inner,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.substr(p, F.instr(p, "\n") + 1)).alias("text")
        ),
    )


def learned_texts(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one after another."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, s["start"] + 1, s["size"]))), "")


def records_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record with a list of messages for each conversation that a table holds turn by turn.

    A conversation is one record of the output, so its turns meet in one row.
    """
    item = F.struct(F.col(turn).isNull().alias("none"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(item)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(messages.alias("messages"))


def digests(rows: DataFrame) -> DataFrame:
    """Format the conversations of a table of turns, write the output, and read from it what it holds."""
    scratch = Scratch(rows.sparkSession, "chat")
    out = scratch.table(format_chats(records_of_rows(rows), "conv_id"), "formatted")
    turns = parsed(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = learned_texts(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
