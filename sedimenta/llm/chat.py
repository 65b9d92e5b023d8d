"""Chat formatting with typed content parts, native: DataFrame expressions only.

A message is a list of parts (text, image, audio, document). `flatten_parts` visits them in order: text is kept, any
other part becomes a placeholder `<|image_1|>`, numbered by kind within the message; its reference and the tokens it
expands to are recorded. Texts are escaped after neighbours have been joined, so no control string can be put together
from parts. `format_chat` joins the messages of a conversation under the template

    <|im_start|>role\\ncontent<|im_end|>\\n

and returns the loss mask as run lengths, so that masked text is found in one pass however long a conversation is.

Escaping is reversible: in texts every `<`, backslashes, `|` gets one backslash more, so that no control string is left;
in roles, `%` and line feeds are percent-coded as well. `read_back` undoes both, and tells placeholders from texts that
look like them (its `parts`; text parts that stood side by side come back as one, empty ones not at all).

Defined results: null role and text are empty; a null turn sorts first; turns that tie are ordered by role, then text;
repeated rows are repeated turns; rows without a conversation (conv_id null) form one conversation with a null id; an
empty table gives no row; a null part is skipped, an unknown type is written as `<|part_n|>`. Columns other than those
named are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a part expands to if its own count is null.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("tokens")))


#: While parts are joined: MARK begins what is no text; MARK itself in a text is written as MARK, KEPT.
MARK, KEPT, OPEN, CLOSE = "\x01", "\x02", "\x03", "\x04"


def flatten_parts(parts: Column, default_tokens: dict[str, int] = DEFAULT_TOKENS) -> tuple[Column, Column, Column]:
    """(content, attachments, expanded tokens) of a list of parts of type PART; a null list is an empty one. Linear in the parts."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    kinds = [*default_tokens, "part"]
    is_text = lambda p: p["type"].eqNullSafe(F.lit("text"))
    kind = lambda p: F.when(is_text(p), F.lit("text")).when(p["type"].isin([*default_tokens]), p["type"]).otherwise(F.lit("part"))

    def tokens(p: Column) -> Column:
        out = F.coalesce(p["tokens"], F.lit(0))
        for name, n in default_tokens.items():
            out = F.when((p["type"] == name) & p["tokens"].isNull(), F.lit(n)).otherwise(out)
        return out.cast("bigint")

    def placeholder(name: str, i: Column) -> Column:
        return F.concat(F.lit(f"<|{name}_"), (i + 1).cast("string"), F.lit("|>"))

    mark = lambda name: MARK + OPEN + name + CLOSE
    marked = F.transform(parts, lambda p: F.when(is_text(p), F.replace(F.coalesce(p["text"], F.lit("")), F.lit(MARK), F.lit(MARK + KEPT))).otherwise(F.concat(F.lit(MARK + OPEN), kind(p), F.lit(CLOSE))))
    content = escape(F.array_join(marked, ""))
    for name in kinds:  # the i-th of a kind gets the number i
        content = F.array_join(F.transform(F.split(content, mark(name), -1), lambda x, i: F.when(i > 0, F.concat(placeholder(name, i - 1), x)).otherwise(x)), "")  # noqa: B023
    content = F.replace(content, F.lit(MARK + KEPT), F.lit(MARK))

    placed = F.transform(parts, lambda p, i: F.struct(i.alias("position"), kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    of_kind = lambda name: F.transform(F.filter(placed, lambda a: a["type"] == name), lambda a, i: F.struct(a["position"].alias("position"), a["type"].alias("type"), a["ref"].alias("ref"), placeholder(name, i).alias("placeholder"), a["tokens"].alias("tokens")))
    attached = F.array_sort(F.concat(*map(of_kind, kinds)))
    return content, attached, F.aggregate(attached, F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"])


def format_chat(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, turn, role, parts. One row per conversation: conv_id, formatted, loss_runs, attachments, expanded_tokens.

    loss_runs has for each turn: skip (code points before its content), keep (those of its content), loss (whether they
    are under the mask); the end mark follows. One conversation is one output row, so its turns meet in one task.
    """
    content, attached, tokens = flatten_parts(F.col("parts"))
    turns = messages.select(
        "conv_id", "turn", escape_role(F.coalesce("role", F.lit(""))).alias("role"), F.coalesce("role", F.lit("")).isin(*loss_roles).alias("loss"), content.alias("content"), attached.alias("attached"), tokens.alias("tokens")
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "loss", "attached", "tokens"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["content"], F.lit(END + "\n"))), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(F.char_length(head(t)).alias("skip"), F.char_length(t["content"]).alias("keep"), t["loss"].alias("loss"))).alias("loss_runs"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, t: s + t["tokens"]).alias("expanded_tokens"),
    )


PLACEHOLDER = r"<\|(\w+)_(\d+)\|>"


def parts_of(content: Column) -> Column:
    """The parts of a content: structs (type, text, number); texts that are not empty, and placeholders, in order."""
    # one more text than there are placeholders, so the last placeholder of the zipped arrays is null
    zipped = F.arrays_zip(F.split(content, PLACEHOLDER, -1).alias("text"), F.regexp_extract_all(content, F.lit(PLACEHOLDER), F.lit(0)).alias("mark"))

    def two(z: Column) -> Column:
        own = F.struct(F.lit("text").alias("type"), unescape(z["text"]).alias("text"), F.lit(None).cast("int").alias("number"))
        other = F.struct(F.regexp_extract(z["mark"], PLACEHOLDER, 1).alias("type"), F.lit(None).cast("string").alias("text"), F.regexp_extract(z["mark"], PLACEHOLDER, 2).try_cast("int").alias("number"))
        return F.array(own, other)

    return F.filter(F.flatten(F.transform(zipped, two)), lambda p: F.coalesce(p["text"] != "", p["number"].isNotNull()))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses `formatted` again: adds turns (role, text as before formatting, parts) and loss_texts (those under the mask)."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    cut = formatted.withColumn("__pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    begin = len(START) + 1

    def parsed(p: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(begin)), "\n", 1)
        content = F.substr(p, F.lit(begin + 1) + F.char_length(role))
        return F.struct(unescape_role(role).alias("role"), unescape(content).alias("text"), parts_of(content).alias("parts"))

    masked = F.filter(F.arrays_zip(F.col("__pieces").alias("piece"), F.col("loss_runs").alias("run")), lambda z: z["run"]["loss"])
    return cut.select(
        *formatted.columns,
        F.transform("__pieces", parsed).alias("turns"),
        F.transform(masked, lambda z: unescape(F.substr(z["piece"], z["run"]["skip"] + 1, z["run"]["keep"]))).alias("loss_texts"),
    )
