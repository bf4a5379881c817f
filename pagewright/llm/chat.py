r"""Chat formatting with DataFrame functions alone.

A conversation's turns are ordered, each turn's typed parts are visited in order, and the whole becomes one string with
a loss mask. Per turn the template is ``<|turn|>role<|body|>text<|end|>\n``; roles and texts are escaped so that no
control string can occur inside them, and the escape can be undone:

    ``\``  becomes ``\0``, then ``<|`` becomes ``<\1``; undone in the opposite order.

After the first step every backslash is followed by 0, so ``<\1`` comes from the second step alone.

Typed parts (text, image, audio, document) are flattened to text and placeholders ``<|kind:n|>`` where n counts the
conversation's attachments of all kinds; each attachment's reference, kind and expanded token count are recorded. A text
that looks like a placeholder is escaped like any other, so that reading back tells both apart. The loss mask covers
texts alone, never a placeholder.

Defined results: null roles and texts are empty; ties of turn are ordered by role, then text; a null conversation id is
a group of its own; no row, no conversation. One conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
LOSS_ROLES = ("assistant",)
#: Defaults for the tokens that an attachment stands for in a model's input: so many for each unit of its size begun. An
#: image's size is its pixels, 64 tokens a tile of 64 x 64; a sound's is its samples at 16 kHz, one token for 20 ms; a
#: document's is its characters, one token for four. Models differ: give ``expansion`` to count for another.
EXPANSION = {"image": (64, 4096), "audio": (1, 320), "document": (1, 4)}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("<\\1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\1"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as an array of one typed part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("size")))


def expanded_tokens(kind: Column, size: Column, expansion: dict[str, tuple[int, int]] = EXPANSION) -> Column:
    """Tokens of one attachment: some for each unit begun, at least for one."""
    out = F.lit(0).cast("long")
    for name, (per, unit) in expansion.items():
        out = F.when(kind == name, F.greatest(F.lit(per), F.ceil(F.coalesce(size, F.lit(0)) / unit) * per).cast("long")).otherwise(out)
    return out


def _attachment(p: Column, kinds=tuple(EXPANSION)) -> Column:
    """Whether the visitor writes a placeholder for the part. Unknown kinds and null parts are skipped."""
    return F.coalesce(p["kind"].isin(*kinds), F.lit(False))


RANGES = "array<struct<start:int,end:int>>"


def _visit(parts: Column, before: Column, kinds=tuple(EXPANSION)) -> Column:
    """Flatten one turn's parts, in order: what is written, and where its texts lie.

    ``before`` attachments came earlier in the conversation.
    """
    empty = F.struct(F.lit("").alias("out"), before.cast("int").alias("n"), F.array().cast(RANGES).alias("texts"))

    def step(acc: Column, p: Column) -> Column:
        placed = F.concat(acc["out"], F.lit("<|"), p["kind"], F.lit(":"), acc["n"].cast("string"), F.lit("|>"))
        written = F.concat(acc["out"], escape(F.coalesce(p["text"], F.lit(""))))
        text = F.coalesce(p["kind"] == "text", F.lit(False))
        out = F.when(_attachment(p, kinds), placed).when(text, written).otherwise(acc["out"])
        n = F.when(_attachment(p, kinds), acc["n"] + 1).otherwise(acc["n"])
        at = F.struct(F.length(acc["out"]).alias("start"), F.length(written).alias("end"))
        return F.struct(out.alias("out"), n.cast("int").alias("n"), F.when(text, F.concat(acc["texts"], F.array(at))).otherwise(acc["texts"]).alias("texts"))

    return F.aggregate(F.coalesce(parts, F.array().cast(PART)), empty, step)


PART = "array<struct<kind:string,text:string,ref:string,size:bigint>>"


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, loss_roles: tuple[str, ...] = LOSS_ROLES, expansion: dict[str, tuple[int, int]] = EXPANSION) -> DataFrame:
    """One row per conversation: conv_id, formatted, turn_starts, loss_mask, attachments, expanded_tokens.

    turn_starts: array<int>, the character each turn begins at. loss_mask: array<struct<turn:int,start:int,end:int>>,
    half-open character ranges of the texts to learn from, one for each text part. attachments:
    array<struct<n:int,kind:string,ref:string,tokens:bigint>> in placeholder order.
    ``parts`` names a column array<struct<kind,text,ref,size>>; without it the text column is the one part.
    """
    kinds = tuple(expansion)
    if parts:
        cast = F.transform(F.filter(F.coalesce(F.col(parts), F.array()), lambda p: p.isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), p["ref"].alias("ref"), p["size"].cast("long").alias("size")))
        tie = F.to_json(cast)
    else:
        cast = text_parts(F.col(text)).cast(PART)
        tie = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), tie.alias("tie"), cast.alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("i", F.row_number().over(order) - 1)
    rows = rows.withColumn("found", F.filter("parts", lambda p: _attachment(p, kinds)))
    rows = rows.withColumn("n", F.coalesce(F.sum(F.size("found")).over(before), F.lit(0)))
    rows = rows.withColumn("visited", _visit(F.col("parts"), F.col("n"), kinds))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)))
    rows = rows.withColumn("piece", F.concat("head", "visited.out", F.lit(END)))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))
    start = F.col("at") + F.length("head")
    learned = F.when(F.col("role").isin(*loss_roles), F.transform("visited.texts", lambda t: F.struct(F.col("i").alias("turn"), (start + t["start"]).alias("start"), (start + t["end"]).alias("end"))))
    cell = F.struct("i", "at", "piece", F.coalesce(learned, F.array().cast("array<struct<turn:int,start:int,end:int>>")).alias("learned"), "found")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    found = F.flatten(F.transform("cells", lambda c: F.coalesce(c["found"], F.array().cast(PART))))
    out = whole.select(
        "conv_id",
        F.array_join(F.transform("cells", lambda c: c["piece"]), "").alias("formatted"),
        F.transform("cells", lambda c: c["at"]).alias("turn_starts"),
        F.flatten(F.transform("cells", lambda c: c["learned"])).alias("loss_mask"),
        F.transform(found, lambda p, i: F.struct(i.alias("n"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p["kind"], p["size"], expansion).alias("tokens"))).alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]))


def _typed(body: Column, kinds) -> Column:
    """A turn's body read back as typed parts: texts unescaped, placeholders with their numbers; empty texts are left out."""
    mark = rf"<[|](?:{'|'.join(kinds)}):[0-9]+[|]>"
    texts, marks = F.split(body, mark), F.regexp_extract_all(body, F.lit(f"({mark})"), 1)
    said = F.transform(texts, lambda t: F.struct(F.lit("text").alias("kind"), unescape(t).alias("text"), F.lit(None).cast("int").alias("n")))
    held = F.transform(marks, lambda m: F.struct(F.substring_index(F.substring(m, 3, 1 << 20), ":", 1).alias("kind"), F.lit(None).cast("string").alias("text"), F.regexp_extract(m, "[0-9]+", 0).cast("int").alias("n")))
    both = F.flatten(F.zip_with(said, held, lambda a, b: F.array(a, b)))
    return F.filter(both, lambda p: p["kind"].isNotNull() & ((p["kind"] != "text") | (p["text"] != "")))


def read_back(formatted: DataFrame, kinds=tuple(EXPANSION)) -> DataFrame:
    """conv_id, formatted, turns and loss_text, all read from the formatted string and its mask.

    turns: array<struct<role,text,parts>>; text holds the turn's texts without its placeholders, parts both in order,
    array<struct<kind,text,n>>, neighbouring texts as one.
    """
    cut = formatted.withColumn("pieces", F.slice(F.split("formatted", "<[|]turn[|]>"), 2, 2**31 - 1))
    fields = cut.withColumn("fields", F.transform("pieces", lambda p: F.split(p, "<[|]body[|]>|<[|]end[|]>\n")))
    skip = len(TURN)
    learned = lambda m: unescape(F.substring(F.get(F.col("pieces"), m["turn"]), m["start"] - F.get(F.col("turn_starts"), m["turn"]) - skip + 1, m["end"] - m["start"]))
    typed = fields.withColumn("typed", F.transform("fields", lambda f: F.struct(unescape(f[0]).alias("role"), _typed(f[1], kinds).alias("parts"))))
    texts = lambda parts: F.array_join(F.transform(F.filter(parts, lambda p: p["kind"] == "text"), lambda p: p["text"]), "")
    return typed.select(
        "conv_id",
        "formatted",
        F.transform("typed", lambda t: F.struct(t["role"].alias("role"), texts(t["parts"]).alias("text"), t["parts"].alias("parts"))).alias("turns"),
        F.array_join(F.transform("loss_mask", learned), "").alias("loss_text"),
    )


def digests(df: DataFrame, **columns) -> DataFrame:
    """Format, read the output back, and return its digests per conversation."""
    back = read_back(format_conversations(df, **columns))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
