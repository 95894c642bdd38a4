"""Column functions over texts: lengths, entropy, and what models' answers hold."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\r\n\f\x0b]+"

#: What answers are matched against.
KEEP_WORDS = ("GOOD_AS_IS", "GOOD AS IS")
DROP_WORDS = ("NO_TRANSITION", "NO TRANSITION")
FOUR_NUMBERS = r"(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
SOME_OBJECTS = r"(?s)\[\s*\{.*?\}\s*\]"
SOME_LISTS = r"\[\s*\[[\d,\s]+\]\s*(?:,\s*\[[\d,\s]+\]\s*)*\]"
CLASS_FIELD = r'(?i)classification["\s:]+([A-Za-z]+)'
REASON_FIELD = r"""(?i)reasoning["\s:]+["']?([^"'}\]]+)"""
OPENING_FENCE, CLOSING_FENCE = r"^```(?:json)?\s*", r"\s*```$"
ONE_OBJECT = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
SEPARATORS = (" <TO> ", " to ", " and ", " vs ", " | ")


def words(text: Column) -> Column:
    """Words apart by white space; none for an empty text."""
    return F.array_remove(F.split(text, SPACES), "")


def length_reason(a: Column, b: Column, least: int = 4, most: int = 12) -> Column:
    """`OK`, or the first way in which two texts leave the window of word counts; too short comes first."""
    na, nb = F.size(words(a)), F.size(words(b))
    return F.when(na < least, "texture_a too short").when(nb < least, "texture_b too short").when(na > most, "texture_a too long").when(nb > most, "texture_b too long").otherwise("OK")


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits, within the row; 0 for an empty text.

    Tasks count the characters of a text at a time in numpy.
    """
    return F.coalesce(F.arrow_udf(_entropies, "double")(text), F.lit(0.0))


def _entropies(texts: pa.Array) -> pa.Array:
    return pa.array([_entropy(t) for t in texts.cast(pa.large_binary()).to_pylist()], pa.float64())


def _entropy(text: bytes | None) -> float:
    if not text:
        return 0.0
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    if n[128:].any():  # characters of several bytes
        points = np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.bincount(points) if points.max() < 1 << 16 else np.unique(points, return_counts=True)[1]
    n = n[n > 0].astype(float)
    total = n.sum()
    return float(np.log2(total) - (n * np.log2(n)).sum() / total) + 0.0


def refine_action(answer: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """`keep`, `discard` or `refine`, and the box to refine to.

    Key words decide first; then the first box in the text, double brackets before single ones, must lie in the image.
    """
    upper = F.upper(F.trim(answer))
    keep, drop = (upper.contains(w[0]) | upper.contains(w[1]) for w in (KEEP_WORDS, DROP_WORDS))
    double, single = r"\[\[" + FOUR_NUMBERS + r"\]\]", r"\[" + FOUR_NUMBERS + r"\]"
    # a box in double brackets, put in front, is the first that single ones find; each search is made once a row
    searched = F.contains(answer, F.lit("[")) & ~(keep | drop)
    found = F.when(searched, F.regexp_extract(F.concat(F.regexp_extract(answer, double, 0), answer), single, 0)).otherwise("")
    numbers = F.array_remove(F.split(F.translate(found, "[] \t\r\n\f\x0b", ""), ","), "")
    sides = F.transform(numbers, lambda n: n.cast("long"))  # none, or four

    def judged(r: Column) -> Column:
        x1, y1, x2, y2 = (F.get(r["s"], F.lit(k)) for k in range(4))
        inside = (x1 < x2) & (x2 <= width) & (y1 < y2) & (y2 <= height)
        action = F.when(r["keep"], "keep").when(r["drop"], "discard").when(F.size(r["s"]) == 0, "keep").when(inside, "refine").otherwise("discard")
        return F.struct(action.alias("action"), F.when(inside, r["s"]).alias("bbox"))

    # `transform` binds what was found to a name
    out = F.transform(F.array(F.struct(keep.alias("keep"), drop.alias("drop"), sides.alias("s"))), judged)[0]
    return out["action"], out["bbox"]


BOX_LIST = "array<array<long>>"
BOX_OBJECTS = "array<struct<description:string,bbox:array<long>>>"


def parse_boxes(text: Column) -> Column:
    """Array of (id, description, coords) from a JSON list of boxes or of objects with a bbox; prose around it is tolerated.

    Ids count entries from 1, also those left out for not having four numbers. Nothing that parses gives an empty array.
    """
    shape = "array<struct<id:int,description:string,coords:array<long>>>"

    def numbered(items: Column, described: bool) -> Column:
        def entry(x: Column, i: Column) -> Column:
            at = (i + 1).cast("int")
            said = F.coalesce(x["description"], F.concat(F.lit("Transition "), at.cast("string"))) if described else F.lit(None).cast("string")
            return F.struct(at.alias("id"), said.alias("description"), (x["bbox"] if described else x).alias("coords"))

        return F.filter(F.transform(items, entry), lambda e: F.size(e["coords"]) == 4)

    def objects(t: Column) -> Column:
        return F.when(t.rlike(r"(?s)^\s*\[\s*\{"), F.from_json(t, BOX_OBJECTS))

    def lists(t: Column) -> Column:
        return F.when(t.rlike(r"(?s)^\s*\[\s*\["), F.from_json(t, BOX_LIST))

    some_objects = F.regexp_extract(text, SOME_OBJECTS, 0)
    some_lists = F.regexp_extract(text, SOME_LISTS, 0)
    found = [numbered(objects(text), True), numbered(lists(text), False), numbered(objects(some_objects), True), numbered(lists(some_lists), False)]
    return F.coalesce(*found, F.array().cast(shape))


def parse_classification(text: Column) -> tuple[Column, Column]:
    """Class (upper case, UNKNOWN if none) and reasoning, from JSON or else by pattern."""
    parsed = F.from_json(F.trim(text), "classification string, reasoning string", {"mode": "PERMISSIVE"})
    ok = F.trim(text).rlike(r"(?s)^\{.*\}$") & (parsed["classification"].isNotNull() | parsed["reasoning"].isNotNull())
    by_pattern = F.upper(F.regexp_extract(text, CLASS_FIELD, 1))
    reason = F.trim(F.regexp_extract(text, REASON_FIELD, 1))
    label = F.when(ok, F.upper(F.coalesce(parsed["classification"], F.lit("UNKNOWN")))).otherwise(F.when(by_pattern != "", by_pattern).otherwise("UNKNOWN"))
    return label, F.when(ok, F.coalesce(parsed["reasoning"], F.lit(""))).otherwise(reason)


TRANSITIONS = "struct<transitions:array<struct<texture_a:string,texture_b:string,colors_a:array<array<double>>,colors_b:array<array<double>>>>>"


def parse_transitions(text: Column) -> Column:
    """Array of transitions with both names and RGB lists; fences are stripped, and prose around the widest braces."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), OPENING_FENCE, ""), CLOSING_FENCE, ""))
    widest = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    parsed = F.from_json(widest, TRANSITIONS)["transitions"]

    def colours(c: Column) -> Column:
        return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda rgb: (F.size(rgb) == 3) & F.forall(rgb, lambda v: v.isNotNull() & v.between(0, 255)))

    kept = F.filter(parsed, lambda t: t["texture_a"].isNotNull() & t["texture_b"].isNotNull() & colours(t["colors_a"]) & colours(t["colors_b"]))
    return F.coalesce(kept, F.from_json(F.lit("[]"), TRANSITIONS.removeprefix("struct<transitions:").removesuffix(">")))


def fenced_json(text: Column) -> Column:
    """The first balanced object (one level deep inside) of the first fenced block, or of the text; null if there is none."""
    trimmed = F.trim(text)
    block = F.regexp_extract(trimmed, r"(?s)^```[^\n]*\n(.*?)(?:\n```|$)", 1)
    body = F.when(trimmed.startswith("```"), block).otherwise(trimmed)
    found = F.regexp_extract(body, ONE_OBJECT, 0)
    return F.when(found != "", found)


def split_description(text: Column, mode: str = "balanced") -> tuple[Column, Column]:
    """Two descriptions in one: at ` <TO> `, else at ` to ` (of several, the one that balances word counts best, or with
    mode="first" the first), else at the first of ` and `, ` vs `, ` | `, else in half.

    Tasks go through a text once for both.
    """
    both = F.arrow_udf(_splitter(mode == "balanced"), "first string, second string")(text)
    return both["first"], both["second"]


def _splitter(balanced: bool) -> Callable[[pa.Array], pa.Array]:
    def split(texts: pa.Array) -> pa.Array:
        halves = [_halves(t, balanced) for t in texts.cast(pa.large_binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([h[k] for h in halves], pa.binary()).cast(pa.string()) for k in range(2)], ["first", "second"])

    return split


def _halves(text: bytes | None, balanced: bool) -> tuple[bytes | None, bytes | None]:
    """Bytes split at the white space of `SPACES`, and only blanks are trimmed."""
    if text is None:
        return None, None
    sure, usual, *others = (s.encode() for s in SEPARATORS)
    if balanced and sure not in text and usual in text:
        parts = text.split(usual)
        sizes = np.array([len(p.split()) for p in parts])
        left = np.cumsum(sizes)[:-1] + np.arange(len(parts) - 1)  # separators are words too
        at = int(np.abs(sizes.sum() + len(parts) - 2 - 2 * left).argmin()) + 1
        return usual.join(parts[:at]).strip(b" "), usual.join(parts[at:]).strip(b" ")
    for separator in (sure, usual, *others):
        first, found, second = text.partition(separator)
        if found:
            return first.strip(b" "), second.strip(b" ")
    whole = text.split()
    return b" ".join(whole[: len(whole) // 2]), b" ".join(whole[len(whole) // 2 :])


def render_colours(colours: Column) -> Column:
    """Lines `[r, g, b] (12.5%)` of an array of (rgb, share)."""
    return F.array_join(F.transform(colours, lambda c: F.concat(F.lit("["), F.array_join(F.transform(c["rgb"], lambda v: v.cast("string")), ", "), F.lit("] ("), F.format_string("%.1f%%)", c["share"] * 100))), "\n")
