"""Conversations of many layouts as marked text: schema fingerprints select declarative mappings."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import let, table

#: Layout -> what it needs: field paths, `[]` for the elements of an array. Those named first win.
LAYOUTS = {
    "turn rows": ("conv_id", "role", "text", "turn"),
    "messages": ("messages[].content", "messages[].role"),
    "exchanges": ("conversations[].from", "conversations[].value"),
    "instruction": ("instruction", "output"),
    "prompt": ("completion", "prompt"),
    "question": ("answer", "question"),
}
#: What a layout also reads where it is there.
MAY_HAVE = {"instruction": ("input",)}
#: Names of roles in other layouts -> canonical ones; others stay.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: The learned role, and the mark at the end of a turn. A turn is `<role>text</turn>` and a line end; `\`, `<` and `>`
#: inside roles and texts are written `\b`, `\l` and `\g`, so no text can hold a mark.
LEARNED, END = "assistant", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves of a schema."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}".lstrip("."))]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: tuple[str, ...] | list[str]) -> int:
    """Signed XXH64 (seed 42) of the sorted paths, as Spark's own xxhash64 of the joined string."""
    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def layout_of(schema: T.StructType) -> str:
    """The layout whose fingerprint is that of its paths among the schema's; further columns do not matter."""
    there = set(field_paths(schema))
    for name, needs in LAYOUTS.items():
        if fingerprint([p for p in needs if p in there]) == fingerprint(needs):
            return name
    raise ValueError(f"no known layout among the paths {sorted(there)}")


def canonical_role(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    role = F.coalesce(role.cast("string"), F.lit(""))
    return F.coalesce(names[role], role)


def turn(role: Column, text: Column) -> Column:
    return F.struct(canonical_role(role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def turns_of(layout: str, field) -> Column:
    """Canonical turns of a record; `field(path, type)` reads from it. Empty inputs of instructions give no text."""
    def many(path: str, role: str, text: str) -> Column:
        rows = field(path, f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(F.coalesce(rows, F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>")),
                           lambda m: turn(m[role], m[text]))

    def two(asked: Column, answer: Column) -> Column:
        return F.array(turn(F.lit("user"), asked), turn(F.lit(LEARNED), answer))

    if layout == "messages":
        return many("messages", "role", "content")
    if layout == "exchanges":
        return many("conversations", "from", "value")
    if layout == "instruction":
        extra = F.coalesce(field("input", "string"), F.lit(""))
        asked = F.coalesce(field("instruction", "string"), F.lit(""))
        return two(F.when(extra == "", asked).otherwise(F.concat(asked, F.lit("\n"), extra)), field("output", "string"))
    if layout == "prompt":
        return two(field("prompt", "string"), field("completion", "string"))
    return two(field("question", "string"), field("answer", "string"))


def json_paths(record: Column) -> Column:
    """The paths of a JSON record that layouts may read: its keys, and those of all elements of its lists.

    NULL for a text that is no object. Elements that are no objects have no keys; lists of other names are not read.
    """
    def element_keys(name: str) -> Column:
        rows = F.from_json(F.get_json_object(record, f"$.{name}"), "array<map<string,string>>")
        keys = F.flatten(F.transform(F.filter(rows, lambda m: m.isNotNull()), F.map_keys))
        return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{name}[]."), k))

    lists = sorted({p.split("[]")[0] for needs in LAYOUTS.values() for p in needs if "[]" in p})
    return F.array_distinct(F.concat(F.json_object_keys(record), *map(element_keys, lists)))


def layout_of_json(record: Column) -> Column:
    """The first layout whose fingerprint is that of its paths among the record's, as :func:`layout_of` for schemas.

    Further paths do not matter, those of other layouts neither. NULL for records of no layout, broken and NULL ones.
    """
    def found(paths: Column) -> Column:
        out = F.lit(None).cast("string")
        for layout, needs in reversed(LAYOUTS.items()):
            if layout != "turn rows":
                own = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, needs))))
                out = F.when(F.xxhash64(F.array_join(own, "\n")) == fingerprint(needs), layout).otherwise(out)
        return out

    return let(json_paths(record), found)


def turns_of_json(record: Column) -> Column:
    """Canonical turns of JSON records of mixed layouts; NULL for records of none, broken ones too.

    :func:`layout_counts` says how many those are.
    """
    def read(layout: Column) -> Column:
        out = F.lit(None).cast(TURNS)
        for name in reversed(LAYOUTS):
            if name != "turn rows":
                turns = turns_of(name, lambda path, kind: F.from_json(record, f"`{path}` {kind}")[path])
                out = F.when(layout == name, turns.cast(TURNS)).otherwise(out)
        return out

    return let(layout_of_json(record), read)


def layout_counts(df: DataFrame, column: str) -> DataFrame:
    """(layout, paths, n): records of each layout; those of none have a NULL layout and the paths they have.

    Broken and NULL records have NULL paths. Counts combine before the shuffle.
    """
    record = F.col(column)
    return df.select(layout_of_json(record).alias("layout"), json_paths(record).alias("all")).select("layout", F.when(
        F.col("layout").isNull(), F.array_join(F.array_sort("all"), " ")).alias("paths")).groupBy("layout", "paths").agg(
        F.count("*").alias("n"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"),
                     F.lit("\\g"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"),
                     F.lit("\\"))


def turn_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of any known layout; records need an `id`, turns are numbered from 0."""
    layout = layout_of(df.schema)
    if layout == "turn rows":
        return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), turn(
            F.col("role"), F.col("text")).alias("t")).select("conv_id", "turn", "t.role", "t.text")

    def field(path: str, kind: str) -> Column:
        if path in MAY_HAVE.get(layout, ()) and path not in df.columns:
            return F.lit(None).cast(kind)
        return F.col(path).cast(kind) if kind == "string" else F.col(path)

    turns = turns_of(layout, field)
    return df.select(F.col("id").cast("long").alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): marked text of each conversation and the spans of it that are learned.

    Spans are (start, chars) in characters of `formatted`, one per learned turn, in order. Turns are ordered by turn,
    role and text, so ties and repeated rows have their place; a NULL conv_id is one conversation. Where a turn starts
    is a running sum over sorted rows. A conversation is one text in the end, hence one row, as a document is.
    """
    head = F.concat(F.lit("<"), escaped(F.col("role")), F.lit(">"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    marked = rows.select("conv_id", "turn", "role", "text", F.length(head).alias("head"), F.length(escaped(
        F.col("text"))).alias("chars"), F.concat(head, escaped(F.col("text")), F.lit(END)).alias("piece"))
    placed = marked.select("conv_id", F.row_number().over(by_turn).alias("k"), "role", "head", "chars", "piece", F.sum(
        F.length("piece")).over(by_turn.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    start = F.coalesce(F.col("before"), F.lit(0)) + F.col("head")
    span = F.when(F.col("role") == LEARNED, F.struct(start.alias("start"), F.col("chars").alias("chars")))
    both = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p"), F.array_sort(F.collect_list(span)).alias("loss"))
    return both.select("conv_id", F.array_join(F.col("p.piece"), "").alias("formatted"), "loss")


def read_back(df: DataFrame) -> DataFrame:
    """(conv_id, turns, learned, formatted): turns and the learned text, from nothing but the marked text and spans."""
    parts = F.split("formatted", END)
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescaped(F.substring_index(F.substring_index(p, ">", 1), "<", -1)).alias("role"),
        unescaped(F.substring_index(p, ">", -1)).alias("text")))
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s.start + 1).cast("int"),
                                                                  s.chars.cast("int"))))
    return df.select("conv_id", turns.alias("turns"), F.array_join(learned, "").alias("learned"), "formatted")


def digest(read: DataFrame) -> DataFrame:
    """The query's columns from what :func:`read_back` gives."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op7_schema_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold marks, formatted and read back."""
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return digest(read_back(formatted(turn_rows(table(spark, sf_dir, "conversations")).unionByName(extra))))
