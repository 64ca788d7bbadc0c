"""Conversations as single training strings with a loss mask, by Spark expressions only.

Turns are gathered as structs and sorted; an array aggregation merges adjacent turns of one role under one opening and
closing mark; array functions join the pieces. Between merged texts stands a mark of its own and control strings inside
texts are broken by a backslash, so the output gives back every single turn. The mask is a list of runs of characters
beside the string: the assistant's texts carry loss, marks and other roles don't.

A conversation is gathered in two steps, so that no task sorts all turns of a long one: blocks of turn numbers become
strings first, and a conversation joins its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers a block spans.
BLOCK = 256

_PIECES = "array<struct<piece:string,loss:boolean>>"


@dataclass(frozen=True)
class Template:
    """Marks of a chat format: an opening and a closing one a role, others for roles without marks of their own.

    Every mark starts with "[" or "<" and has neither behind its first character, so that text before a mark can't
    complete or hide one; no mark holds a backslash, and none is another with more characters before it.
    """

    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    joint: str = "[AND]"
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for m in self.marks:
            if m[0] not in "[<" or "[" in m[1:] or "<" in m[1:] or "\\" in m or len(m) < 3:
                raise ValueError(f"not a usable mark: {m!r}")
        if len(set(self.marks)) < len(self.marks):
            raise ValueError("marks must differ")

    @property
    def marks(self) -> list[str]:
        return [*(m for pair in self.roles.values() for m in pair), *self.other, self.joint]

    @property
    def ends(self) -> list[str]:
        return [*(end for _, end in self.roles.values()), self.other[2]]


def escape(text: Column, template: Template) -> Column:
    """Backslashes doubled, and one put behind the first character of every mark."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    broken = reduce(lambda c, m: F.replace(c, F.lit(m), F.lit(f"{m[0]}\\{m[1:]}")), template.marks, doubled)
    touched = F.contains(text, F.lit("\\")) | F.contains(text, F.lit("[")) | F.contains(text, F.lit("<"))
    return F.when(touched, broken).otherwise(text)


def unescape(text: Column, template: Template) -> Column:
    """A single backslash behind a mark's first character is an escape's; the text's own come in pairs."""
    whole = reduce(lambda c, m: F.replace(c, F.lit(f"{m[0]}\\{m[1:]}"), F.lit(m)), template.marks, text)
    return F.when(F.contains(text, F.lit("\\")), F.replace(whole, F.lit("\\\\"), F.lit("\\"))).otherwise(text)


def _by_role(role: Column, known: dict[str, Column], other: Column) -> Column:
    chain = reduce(lambda c, k: c.when(role == k, known[k]), known, F.when(F.lit(False), other))
    return chain.otherwise(other)


def _mark(text: Column | str) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("piece"), F.lit(False).alias("loss"))


def _opening(role: Column, t: Template) -> Column:
    first, says, _ = t.other
    named = F.array(_mark(first), _mark(escape(role, t)), _mark(says))
    return _by_role(role, {r: F.array(_mark(a)) for r, (a, _) in t.roles.items()}, named)


def _closing(role: Column, t: Template) -> Column:
    return F.array(_mark(_by_role(role, {r: F.lit(b) for r, (_, b) in t.roles.items()}, F.lit(t.other[2]))))


def _between(before: Column, after: Column, t: Template) -> Column:
    """What stands between two texts: one mark where the role stays, else an end and a start."""
    return F.when(before == after, F.array(_mark(t.joint))).otherwise(F.concat(_closing(before, t), _opening(after, t)))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), "")


def _runs(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.struct(F.length(p["piece"]).cast("long").alias("chars"), p["loss"].alias("loss")))


def format_chats(
    turns: DataFrame,
    template: Template | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_runs`` (array of characters and whether they bear loss).

    Turns stand in the order of their number, nulls first; rows with one number follow by role and text, and repeated rows
    all stay. A null text or role counts as empty; an empty role and any role the template doesn't know are written by
    name. Null ids are one conversation. An empty table gives no rows. Only the named columns are read. A conversation is a
    row of the output, so its string must fit one; its turns meet only as strings of whole blocks.
    """
    t = template or Template()
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.floor(F.col(turn_col) / block).alias("block"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def merge(done: Column, x: Column) -> Column:
        said = F.struct(escape(x["text"], t).alias("piece"), x["role"].isin(*t.loss_roles).alias("loss"))
        # no role yet: the mark before a block's first text depends on the block before it
        mark = F.when(done["last"].isNull(), F.array().cast(_PIECES)).otherwise(_between(done["last"], x["role"], t))
        return F.struct(x["role"].alias("last"), F.concat(done["pieces"], mark, F.array(said)).alias("pieces"))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast(_PIECES).alias("pieces"))
    blocks = ordered.select(
        "conv",
        "block",
        F.col("turns")[0]["role"].alias("first"),
        F.element_at("turns", -1)["role"].alias("last"),
        F.filter(F.aggregate("turns", start, merge)["pieces"], lambda p: p["piece"] != "").alias("pieces"),
    ).select("conv", "block", "first", "last", _joined(F.col("pieces")).alias("body"), _runs(F.col("pieces")).alias("runs"))

    whole = blocks.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("block", "first", "last", "body", "runs"))).alias("b")
    )
    b = F.col("b")
    leads = F.transform(
        b, lambda x, i: F.when(i == 0, _opening(x["first"], t)).otherwise(_between(b[i - 1]["last"], x["first"], t))
    )
    led = whole.withColumn("leads", F.transform(leads, lambda m: F.filter(m, lambda p: p["piece"] != "")))
    ending = _closing(F.element_at("b", -1)["last"], t)
    return led.select(
        F.col("conv").alias(conv_col),
        F.concat(
            F.array_join(F.zip_with("leads", "b", lambda m, x: F.concat(_joined(m), x["body"])), ""), _joined(ending)
        ).alias("formatted"),
        F.concat(F.flatten(F.zip_with("leads", "b", lambda m, x: F.concat(_runs(m), x["runs"]))), _runs(ending)).alias("loss_runs"),
    )


def _pattern(marks: list[str], around: str) -> str:
    return f"(?{around}" + "|".join(f"\\Q{m}\\E" for m in marks) + ")"


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted string, one for every row that went in."""
    t = template or Template()
    first, says, end = t.other
    merged = F.filter(F.split(formatted, "(?<=[\\]>])" + _pattern(t.ends, "<=")), lambda x: x != "")

    def opened(x: Column) -> Column:
        named = unescape(F.substring_index(_after(x, first), says, 1), t)
        return _by_mark(x, {a: F.lit(r) for r, (a, _) in t.roles.items()}, named)

    def body(x: Column) -> Column:
        known = {a: _inside(x, F.lit(len(a)), len(e)) for a, e in t.roles.values()}
        return _by_mark(x, known, _inside(x, F.instr(x, says) + len(says) - 1, len(end)))

    def texts(x: Column) -> Column:
        role = opened(x)
        parts = F.split(body(x), f"\\Q{t.joint}\\E")
        return F.transform(parts, lambda s: F.struct(role.alias("role"), unescape(s, t).alias("text")))

    return F.flatten(F.transform(merged, texts))


def _after(x: Column, mark: str) -> Column:
    return F.substring(x, F.lit(len(mark) + 1), F.length(x))


def _inside(x: Column, before: Column, after: int) -> Column:
    return F.substring(x, before + 1, F.length(x) - before - after)


def _by_mark(x: Column, known: dict[str, Column], other: Column) -> Column:
    chain = reduce(lambda c, m: c.when(F.startswith(x, F.lit(m)), known[m]), known, F.when(F.lit(False), other))
    return chain.otherwise(other)


def read_loss(formatted: Column, loss_runs: Column, template: Template | None = None) -> Column:
    """The unescaped text under the loss mask. Fails where the mask's runs aren't the string's marks and texts."""
    t = template or Template()
    cut = f"(?<=[\\]>]){_pattern(t.marks, '<=')}|(?=[\\[<]){_pattern(t.marks, '=')}"
    pieces = F.filter(F.split(formatted, cut), lambda p: p != "")
    under = F.zip_with(
        pieces,
        loss_runs,
        lambda p, r: F.when(F.length(p) != r["chars"], F.raise_error(F.lit("the mask does not fit the text")))
        .when(r["loss"], unescape(p, t))
        .otherwise(""),
    )
    return F.array_join(under, "")


def digest(chats: DataFrame, template: Template | None = None, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from ``formatted`` and ``loss_runs``: counts and digests of turns and of text with loss."""
    t = template or Template()
    back = chats.select(
        conv_col,
        F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted"), t).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_runs"), t).alias("loss"),
    )
    told = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
