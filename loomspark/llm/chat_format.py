"""Chat formatting [native].

Records of any layout (prompt pairs, instructions, message lists, a row for
each turn) become canonical turns. The nested field paths of a record are
hashed; the hash selects a declarative mapping. Only DataFrame functions run:
a record is a VARIANT, and its paths come from ``schema_of_variant``.

Template: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>`` for each
turn. Inside roles and texts a control string gets a backslash behind its
first character, and one that already has backslashes there gets one more;
so no control string is left and the way back is exact.

Null role or text: empty. A conversation without turns has no row. Turns with
equal order are put in order of role and text; repeated rows are repeated
turns. A null conversation id is an id like any other. An empty table gives
an empty table. A conversation is one row of the result and is put together in
one task, however long it is; other columns aren't read. A record whose paths no mapping declares keeps its
fingerprint, has no layout and gives no turn (``canonical_turns`` with
``keep_unmapped`` returns it for a report).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What a control string is after its first character.
_REST = r"(/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_]+\|>)"
ESCAPE = r"([<\[])(\\*)" + _REST
UNESCAPE = r"([<\[])(\\*)\\" + _REST

#: Mappings: name, nested field paths, and either the path of a list of turns with
#: its role and text fields, or fixed (role, path) turns; a role that starts with $ is a path.
LAYOUTS: list[dict] = [
    {"name": "turn_text", "paths": ["role", "text"], "turns": [("$.role", "$.text")]},
    {"name": "turn_content", "paths": ["role", "content"], "turns": [("$.role", "$.content")]},
    {"name": "messages", "paths": ["messages[].role", "messages[].content"], "list": ("$.messages", "role", "content")},
    {"name": "sharegpt", "paths": ["conversations[].from", "conversations[].value"], "list": ("$.conversations", "from", "value")},
    {"name": "prompt_completion", "paths": ["prompt", "completion"], "turns": [("user", "$.prompt"), ("assistant", "$.completion")]},
    {"name": "prompt_response", "paths": ["prompt", "response"], "turns": [("user", "$.prompt"), ("assistant", "$.response")]},
    {"name": "question_answer", "paths": ["question", "answer"], "turns": [("user", "$.question"), ("assistant", "$.answer")]},
    {"name": "instruction", "paths": ["instruction", "output"], "turns": [("user", "$.instruction"), ("assistant", "$.output")]},
    {
        "name": "instruction_input",
        "paths": ["instruction", "input", "output"],
        "turns": [("user", "$.instruction", "$.input"), ("assistant", "$.output")],
    },
    {
        "name": "system_prompt_response",
        "paths": ["system", "prompt", "response"],
        "turns": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")],
    },
]

#: Names that other layouts use for the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def skeleton(paths: list[str]) -> str:
    """Nested field paths as one string, fields in order of name: what ``schema_of_variant`` says, without the scalar types."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def show(node: dict) -> str:
        if not node:
            return "*"
        inner = []
        for name in sorted(node):
            if name.endswith("[]"):
                inner.append(f"{name[:-2]}: ARRAY<{show(node[name])}>")
            else:
                inner.append(f"{name}: {show(node[name])}")
        return f"OBJECT<{', '.join(inner)}>"

    return show(tree)


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256(skeleton(paths).encode()).hexdigest()


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a VARIANT; scalar types and null values make no difference."""
    return F.sha2(F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\s?\d+\))?", ": *"), 256)


def _turns(layout: dict, record: Column) -> Column:
    text = lambda path: F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))
    if "list" in layout:
        path, role, body = layout["list"]
        got = F.try_variant_get(record, path, f"array<struct<`{role}`:string,`{body}`:string>>")
        return F.transform(got, lambda x: F.struct(F.coalesce(x[role], F.lit("")).alias("role"), F.coalesce(x[body], F.lit("")).alias("text")))
    out = []
    for role, first, *more in layout["turns"]:
        name = text(role) if role.startswith("$") else F.lit(role)
        body = text(first)
        for path in more:
            body = F.when(text(path) == "", body).otherwise(F.concat(body, F.lit("\n"), text(path)))
        out.append(F.struct(name.alias("role"), body.alias("text")))
    return F.array(*out)


def canonical_turns(records: DataFrame, record: Column, keys: list[str], layouts: list[dict] | None = None, keep_unmapped: bool = False) -> DataFrame:
    """keys, fingerprint, layout, part (place within the record), role, text; a row for each turn.

    ``record`` is a VARIANT: ``parse_json`` of a string or ``to_variant_object`` of a struct.
    """
    layouts = LAYOUTS if layouts is None else layouts
    out = records.select(*keys, record.alias("_record")).withColumn("fingerprint", fingerprint(F.col("_record")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in reversed(layouts):
        hit = F.col("fingerprint") == fingerprint_of(layout["paths"])
        name = F.when(hit, F.lit(layout["name"])).otherwise(name)
        turns = F.when(hit, _turns(layout, F.col("_record"))).otherwise(turns)
    out = out.select(*keys, "fingerprint", name.alias("layout"), turns.alias("_turns"))
    explode = F.posexplode_outer if keep_unmapped else F.posexplode
    out = out.select(*keys, "fingerprint", "layout", explode("_turns").alias("part", "_turn"))
    role = F.col("_turn.role")
    for other, canonical in ROLE_NAMES.items():
        role = F.when((F.col("layout") == "sharegpt") & (F.col("_turn.role") == other), F.lit(canonical)).otherwise(role)
    return out.select(*keys, "fingerprint", "layout", "part", role.alias("role"), F.col("_turn.text").alias("text"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, r"$1$2$3")


def format_turns(turns: DataFrame, key: str, order: list[str], train_on: str = "assistant") -> DataFrame:
    """key, n_turns, formatted, loss_mask (start from 0 and length, in characters of ``formatted``, of each text to train on).

    Offsets are running sums over the turns of a conversation, so the work stays linear in its length.
    The result holds a conversation in one row; the shuffle deals conversations out by their ids.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    rows = turns.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], (F.col("role") == train_on).alias("_train"),
        F.concat(F.lit(START), role, F.lit(SEP)).alias("_head"), text.alias("_body"),
    )
    by = [f"_o{i}" for i in range(len(order))] + ["_head", "_body"]
    size = F.length("_head") + F.length("_body") + F.lit(len(END))
    w = W.partitionBy("_key").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_end", F.sum(size.cast("long")).over(w)).withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(*by)))
    span = F.struct((F.col("_end") - F.lit(len(END)) - F.length("_body")).alias("start"), F.length("_body").cast("long").alias("length"))
    grouped = rows.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("_n", F.concat("_head", "_body", F.lit(END)).alias("s")))).alias("_blocks"),
        F.array_sort(F.collect_list(F.when(F.col("_train"), span))).alias("loss_mask"),
    )
    return grouped.select(F.col("_key").alias(key), "n_turns", F.array_join(F.transform("_blocks", lambda x: x["s"]), "").alias("formatted"), "loss_mask")


def read_turns(formatted: Column) -> Column:
    """The way back: array of struct<role, text>."""
    quoted = lambda s: s.replace("|", r"\|")
    parts = F.split(F.regexp_replace(formatted, quoted(END), ""), quoted(START))

    def turn(x: Column) -> Column:
        two = F.split(x, quoted(SEP))
        return F.struct(unescape(two[0]).alias("role"), unescape(two[1]).alias("text"))

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    return F.array_join(
        F.transform(loss_mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
