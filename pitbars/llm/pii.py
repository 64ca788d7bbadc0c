"""Personal data by bootstrapped contextual extraction.

Fixed expressions find the seeds: e-mail and IP addresses, payment cards, phone numbers. Each occurrence induces lexical
patterns: the characters glued to it with the word before, with the two words before, or with the word after. The
other identifier-like tokens (with a digit or an at sign) are candidates and stand in the same kind of patterns.
Patterns and values form a graph that Spark scores in rounds: a pattern's score for a kind is the share of its distinct
values that are of the kind (smoothed), and an unknown value's score comes from its patterns. Patterns that end with a
high score and enough distinct seed values name further tokens; the seeds themselves always stay.

All counting is over distinct values, so copies of a document give a pattern no weight. The graph holds only
patterns with enough seeds; sums are grouped with partial sums before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitbars.llm.common import Workspace, over_batches, sized

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans the patterns add, after the kinds of the fixed expressions.
ALL_KINDS = (*KINDS, *(f"context_{k}" for k in KINDS))
ROUNDS, LEAST_SEEDS, LEAST_SCORE, SMOOTHING = 3, 5, 0.8, 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a start inside a run of digits can only match where the start of the run does; so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_DIGITS = re.compile(r"[0-9]")
#: What stands between two marks of fields. An apostrophe inside a word and a comma before three digits are no such marks.
_PIECE = re.compile(
    r"""(?:[^\x20\x09-\x0D"'`,;:=|&<>{}\[\]]++|(?<=[A-Za-z])'(?=[A-Za-z])|(?<=[0-9])(?<![0-9]{4}),(?=[0-9]{3}(?![0-9])))++"""
)
_NUMBER = re.compile(r"[+(]*[0-9][0-9().,/+-]*")
#: Characters around a value that count as glued context rather than as its part.
_EDGE = "\"'()[]{}<>,.;:!?=|`*"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, pos = text.find("@"), 0
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        pos = found.end() if found else at + 1
        at = text.find("@", pos)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed expressions, in order; kind counts in ``KINDS``."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(
            len(p.lstrip("0")) <= 3 for p in m[0].split(".")
        ):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _word(text: str) -> str:
    return _DIGITS.sub("0", text[-24:].lower())


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of an occurrence. Context reaches no further than 80 characters."""
    left, right = text[max(0, start - 80) : start], text[end : end + 80]
    before = _BLANK.split(left)
    after = _BLANK.split(right)
    glued, tail = _word(before[-1]), _word(after[0][:8])
    words = [w for w in before[:-1] if w]
    follow = next((w for w in after[1:] if w), "")
    w1, w2 = (_word(words[-1]) if words else "^"), (_word(words[-2]) if len(words) > 1 else "^")
    return [f"1\0{w1}\0{glued}", f"2\0{w2}\0{w1}\0{glued}", f"3\0{tail}\0{_word(follow[:24]) or '$'}"]


def _trim(text: str, start: int, end: int, number: bool) -> tuple[int, int]:
    """A span without the marks at its edges; a number keeps brackets around a part of it."""
    edge = _EDGE + " -/" if number else _EDGE
    while end > start and text[end - 1] in edge and not (number and text[end - 1] == ")" and text.find("(", start + 1, end) >= 0):
        end -= 1
    while start < end and text[start] in edge and not (number and text[start] == "(" and text.find(")", start, end - 1) >= 0):
        start += 1
    return start, end


def _runs(text: str) -> Iterator[tuple[int, int, bool]]:
    """Pieces between blanks, quotes, commas and other marks of fields; pieces of a number that single blanks part are one."""
    at = 0
    while mark := _MARK.search(text, at):
        line = text.rfind("\n", 0, mark.start()) + 1
        at = stop if (stop := text.find("\n", mark.start())) >= 0 else len(text)
        start = end = depth = -1
        for m in _PIECE.finditer(text, line, at):
            piece = m[0]
            number = _NUMBER.fullmatch(piece) is not None
            # a hyphen or slash between blanks goes on with a number
            if start >= 0 and not (m.start() == end + 1 and text[end] == " " and text[end - 1] != "." and depth >= 0 and (number or piece in "-/")):
                yield start, end, True
                start = -1
            if number or start >= 0:
                if start < 0:
                    start, depth = m.start(), 0
                end, depth = m.end(), depth + piece.count("(") - piece.count(")")
            elif _MARK.search(piece):
                yield m.start(), m.end(), False
        if start >= 0:
            yield start, end, True


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of identifier-like runs with a digit or an at sign, without what base spans cover and without glued marks."""
    out, k = [], 0
    for start, end, number in _runs(text):
        while k < len(base) and base[k][2] <= start:
            k += 1
        j = k
        while start < end:  # the parts between base spans
            while j < len(base) and base[j][2] <= start:
                j += 1
            cut = base[j] if j < len(base) and base[j][0] < end else (end, 0, end)
            s, e = _trim(text, start, max(start, cut[0]), number)
            if e - s >= 5 and _MARK.search(text, s, e):
                out.append((s, e))
            start = max(start, cut[2])
    return out


def fits(value: str, kind: int) -> bool:
    """Whether a candidate can be of a kind at all: an address needs its at sign, numbers at least five digits."""
    return "@" in value if kind == 0 else len(_DIGITS.findall(value)) >= 5


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_FOUND = (
    "base array<struct<start:int,kind:int,end:int>>, "
    "seen array<struct<start:int,end:int,kind:int,fits:int,value:long,patterns:array<long>>>"
)


def observe(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and every seed (its kind) and candidate (kind -1) with value and patterns."""
    base = base_spans(text)
    seen = []
    spans = [(s, e, k) for s, k, e in base] + [(s, e, -1) for s, e in candidates(text, base)]
    for s, e, kind in spans:
        value = text[s:e]
        mask = sum(1 << k for k in range(len(KINDS)) if fits(value, k)) if kind < 0 else 0
        if kind >= 0 or mask:
            seen.append({"start": s, "end": e, "kind": kind, "fits": mask, "value": _key(f"{kind}\0{value}"),
                         "patterns": [_key(c) for c in contexts(text, s, e)]})
    return [{"start": s, "kind": k, "end": e} for s, k, e in base], seen


def score_patterns(ws: Workspace, edges: DataFrame, rounds: int, least_seeds: int, smoothing: float) -> DataFrame:
    """(pattern, kind, score, seeds) from distinct edges (pattern, value, kind); kind -1 is unknown."""
    rich = (
        edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds)
    )
    graph = ws.table(edges.join(rich.select("pattern").distinct(), "pattern", "left_semi"), "graph")
    sizes = graph.groupBy("pattern").agg((F.count("*") + smoothing).alias("size"))
    seeds = graph.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    unknown = graph.where("kind < 0").select("pattern", "value")
    scores = seeds.join(sizes, "pattern").select("pattern", "kind", (F.col("seeds") / F.col("size")).alias("score"))
    for _ in range(rounds):
        scores = ws.table(scores, "scores")
        value = (
            unknown.join(scores, "pattern")
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.99)) / 2)))).alias("score"))
        )
        more = unknown.join(value, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
        scores = (
            seeds.join(more, ["pattern", "kind"], "left")
            .join(sizes, "pattern")
            .select("pattern", "kind", ((F.col("seeds") + F.coalesce("more", F.lit(0.0))) / F.col("size")).alias("score"))
        )
    return scores.join(rich, ["pattern", "kind"])


def extract(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    least_seeds: int = LEAST_SEEDS,
    least_score: float = LEAST_SCORE,
    keep_rows: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (start, kind, end) in order; kind counts in ``ALL_KINDS``.

    Places are code points, ends exclusive. With ``keep_rows`` the row comes along as the struct ``doc``. A null or empty
    text has no spans; rows that share an id are searched one by one; a null id stays null; an empty table gives no rows.
    Other columns pass inside ``doc`` only, so their names can't clash.
    """
    ws = Workspace(docs.sparkSession, "pii")
    base = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),  # fixed by the table written below
        F.col(text_col).alias("text"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if keep_rows else []),
    )
    carried = [f for f in base.schema.fields if f.name != "text"]

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = [observe(x or "") for x in part.column("text").to_pylist()]
            yield {f.name: part.column(f.name) for f in carried} | {
                "base": [b for b, _ in found], "seen": [s for _, s in found],
            }

    rows = ws.table(over_batches(base, run, StructType(carried + StructType.fromDDL(_FOUND).fields)), "rows")
    seen = rows.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    edges = seen.select("value", "kind", F.explode("patterns").alias("pattern")).distinct()
    strong = score_patterns(ws, edges, rounds, least_seeds, SMOOTHING).where(F.col("score") >= least_score)
    strong = ws.table(strong.select("pattern", F.col("kind").alias("as_kind"), "score"), "strong")
    hits = (
        seen.where("kind < 0")
        .select("row", "start", "end", "fits", F.explode("patterns").alias("pattern"))
        .join(strong, "pattern")
        .where(F.expr("shiftright(fits, as_kind) & 1") == 1)
        .groupBy("row", "start", "end")
        .agg(F.max_by("as_kind", F.struct("score", -F.col("as_kind"))).alias("as_kind"))
    )
    added = hits.groupBy("row").agg(
        F.collect_list(F.struct("start", (F.col("as_kind") + len(KINDS)).alias("kind"), "end")).alias("added")
    )
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return rows.join(added, "row", "left").select(
        F.col("id").alias(id_col), spans.alias("spans"), *(["doc"] if keep_rows else [])
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text, from ``extract``."""
    names = F.array(*map(F.lit, ALL_KINDS))
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in capitals; spans that overlap are replaced together."""
    out, pos, k = [], 0, 0
    spans = sorted(spans)
    while k < len(spans):
        start, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[pos:start], f"<{ALL_KINDS[kind].removeprefix('context_').upper()}>"]
        pos = end
    return "".join(out) + text[pos:]


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows of ``docs`` with personal data masked, columns as they were; ``n_chars`` is set anew where it exists."""
    found = extract(docs, id_col, text_col, keep_rows=True, **options)

    @F.pandas_udf("string")
    def hide(text, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(
            [masked(t, [(x["start"], x["kind"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object
        )

    text = F.when(F.size("spans") == 0, F.col(f"doc.{text_col}")).otherwise(hide(F.col(f"doc.{text_col}"), F.col("spans")))
    out = found.select("doc", text.alias("masked"))
    return sized(
        out.select(*[(F.col("masked") if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns]), text_col
    )
