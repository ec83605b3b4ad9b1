r"""Chat formatting by typed content parts (operator 13, DataFrame operations only).

A message is a list of typed parts.  A visitor turns every part into text in order: text parts are escaped, image, audio
and document parts become a placeholder (``<|image|>``) and are recorded as attachments with their reference and the
number of tokens the placeholder expands to.  Messages are then put into the template below, one string a conversation,
with a loss mask over the assistant bodies:

    system     <<SYS>>body<</SYS>>
    user       [INST] body [/INST]
    assistant  body</s>
    others     <|role|>name<|/role|>body<|/turn|>

Control strings inside texts are escaped reversibly: after the first character of a control string, and of one that has
backslashes there already, a backslash is added; reading back takes one off.  Nothing else in a text changes, so an
unescaped control string in the output is always a mark of the template.

The loss mask is a list of spans (turn from 1, start from 1 within that turn's string, length; in code points), so that
reading under it is linear in the length of the conversation.

Memory: rows of a conversation are gathered map-side first, then once by conversation; a conversation is one row of the
output and has to fit a row.

Defined results: null texts, parts, lists of parts and roles are empty; null conv_id is one conversation; turns go by
number (null first), then role, then text; repeated rows are turns of their own; parts of an unknown type are
documents, and sizes that are null count as 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what the template may write, without the first character
MARKS = [r"s>", r"/s>", r"INST\]", r"/INST\]", r"<SYS>>", r"</SYS>>", r"\|role\|>", r"\|/role\|>", r"\|/turn\|>",
         r"\|image\|>", r"\|audio\|>", r"\|document\|>"]
_CONTROL = r"([<\[])(\\*)(" + "|".join(MARKS) + ")"
_ESCAPED = r"([<\[])\\(\\*)(" + "|".join(MARKS) + ")"
#: One turn; the groups hold the body of a user, of the system, name and body of another role, the body of an assistant.
_TURN = (r"(?s)\[INST\] (.*?) \[/INST\]|<<SYS>>(.*?)<</SYS>>|<\|role\|>(.*?)<\|/role\|>(.*?)<\|/turn\|>|(.*?)</s>")
_PLACEHOLDER = r"<\|(image|audio|document)\|>"

#: A content part; ``width`` and ``height`` are pixels of an image, ``seconds`` of an audio part, ``pages`` of a document.
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_parts(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as messages of one text part each."""
    missing = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    part = F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), *missing)
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def _kind(p: Column) -> Column:
    return F.when(p["kind"].isin("text", "image", "audio", "document"), p["kind"]).otherwise("document")


def _visited(p: Column) -> Column:
    """Text of one part."""
    return F.when(p.isNull(), "").when(p["kind"] == "text", escaped(p["text"])).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>")))


def _expansion(p: Column, patch: int, per_second: float, per_page: int) -> Column:
    """Tokens that the placeholder of a part stands for."""
    tiles = lambda side: F.ceil(F.coalesce(p[side], F.lit(0)) / F.lit(patch))
    return (F.when(_kind(p) == "image", tiles("width") * tiles("height"))
            .when(_kind(p) == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * per_second))
            .otherwise(F.coalesce(p["pages"], F.lit(0)) * F.lit(per_page)).cast("long"))


def flattened(messages: DataFrame, patch: int = 28, per_second: float = 25.0, per_page: int = 1024) -> DataFrame:
    """conv_id, turn, role, body, attachments (kind, ref, tokens; in the order of the placeholders) for each message
    (conv_id, turn, role, parts)."""
    parts = F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)"))
    others = F.filter(parts, lambda p: p.isNotNull() & ~p["kind"].eqNullSafe(F.lit("text")))
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, _visited), "").alias("body"),
        F.transform(others, lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"),
                                               _expansion(p, patch, per_second, per_page).alias("tokens"))).alias("attachments"))


def chats(messages: DataFrame, **sizes) -> DataFrame:
    """conv_id, formatted, loss_mask (turn, start, length), attachments (turn, kind, ref, tokens), expanded_tokens for
    each conversation of ``messages`` (conv_id, turn, role, parts)."""
    flat = flattened(messages, **sizes)
    gathered = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "attachments"))).alias("turns"))
    body, role = (lambda t: t["body"]), (lambda t: t["role"])

    def written(t: Column) -> Column:
        return (F.when(role(t) == "user", F.concat(F.lit("[INST] "), body(t), F.lit(" [/INST]")))
                .when(role(t) == "system", F.concat(F.lit("<<SYS>>"), body(t), F.lit("<</SYS>>")))
                .when(role(t) == "assistant", F.concat(body(t), F.lit("</s>")))
                .otherwise(F.concat(F.lit("<|role|>"), escaped(role(t)), F.lit("<|/role|>"), body(t), F.lit("<|/turn|>"))))

    span = lambda t, i: F.struct((i + 1).alias("turn"), F.when(role(t) == "assistant", 1).otherwise(0).alias("start"), F.length(body(t)).alias("length"))
    mask = F.filter(F.transform("turns", span), lambda s: s["start"] > 0)
    owned = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(
        (i + 1).alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return gathered.select("conv_id", F.array_join(F.transform("turns", written), "").alias("formatted"), mask.alias("loss_mask"),
                           owned.alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (written, role, body), bodies still escaped."""
    group = lambda t, k: F.regexp_extract(t, _TURN, k)
    found = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))

    def parsed(t: Column) -> Column:
        user, system, other = t.startswith("[INST] "), t.startswith("<<SYS>>"), t.startswith("<|role|>")
        return F.struct(t.alias("written"),
                        F.when(user, "user").when(system, "system").when(other, unescaped(group(t, 3))).otherwise("assistant").alias("role"),
                        F.when(user, group(t, 1)).when(system, group(t, 2)).when(other, group(t, 4)).otherwise(group(t, 5)).alias("body"))

    return F.transform(found, parsed)


def parts_of(body: Column) -> Column:
    """The typed parts of an escaped body in order: array of (kind, text); a placeholder has no text."""
    text = lambda x: F.struct(F.lit("text").alias("kind"), unescaped(x).alias("text"))
    kinds = F.regexp_extract_all(body, F.lit(_PLACEHOLDER), F.lit(1))
    between = F.split(body, _PLACEHOLDER, -1)
    pairs = F.flatten(F.transform(between, lambda x, i: F.array(
        text(x), F.struct(F.coalesce(F.get(kinds, i), F.lit("")).alias("kind"), F.lit("").alias("text")))))
    return F.filter(pairs, lambda p: ~(((p["kind"] == "text") & (p["text"] == "")) | (p["kind"] == "")))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_texts from the output of ``chats``: what a trainer would see."""
    read = formatted.withColumn("read", turns_of(F.col("formatted")))
    under = F.transform("loss_mask", lambda s: unescaped(F.substr(F.element_at("read", s["turn"])["written"], s["start"], s["length"])))
    return read.select("conv_id", "formatted", F.transform("read", lambda t: F.struct(
        t["role"].alias("role"), unescaped(t["body"]).alias("text"))).alias("turns"), under.alias("loss_texts"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    read = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
