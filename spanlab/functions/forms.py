"""Names, labels and short forms: parsing what people and models wrote, rendering what others read."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def part_number(text: Column, strict: bool = True) -> Column:
    """'2.0' as 2; other text is an error, or null where that isn't asked for."""
    n = F.nullif(F.regexp_extract(F.trim(text), r"^(\d+)\.0$", 1), F.lit("")).cast("long")
    return F.when(text.isNotNull() & n.isNull(), F.raise_error(F.concat(F.lit("no part number: "), text)).cast("long")).otherwise(n) if strict else n


def polarity_of(text: Column) -> Column:
    """Yes or No where the first word of an answer, without the marks behind it, is just that; null for anything else."""
    first = F.regexp_replace(F.get(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "), F.lit(0)), "^[,;:.]+|[,;:.]+$", "")
    return F.when(first == "yes", "Yes").when(first == "no", "No")


def judged(text: Column, candidates: Column, free: bool = False) -> Column:
    """What a judge decided: struct(answer, source).

    "Answer N", alone or before a colon, dot or dash, is the candidate N (source choice), out of range nothing
    (unparseable), like an empty reply; other text is the answer itself (freetext) only where ``free``, else nothing (suppressed).
    """
    reply = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    digits = F.nullif(F.regexp_extract(reply, r"^(?i:answer)\s*(\d+)\s*(?:$|[:.-])", 1), F.lit(""))
    n = F.least(digits.try_cast("long"), F.lit(1 << 30).cast("long")).cast("int")
    chosen = F.when(n >= 1, F.try_element_at(candidates, F.greatest(n, F.lit(1))))
    source = F.when(digits.isNotNull(), F.when(chosen.isNotNull(), "choice").otherwise("unparseable")).when(reply == "", "unparseable").otherwise("freetext" if free else "suppressed")
    return F.struct(F.when(digits.isNotNull(), chosen).when(reply == "", None).otherwise(reply if free else F.lit(None).cast("string")).alias("answer"), source.alias("source"))


def display_noun(name: Column) -> Column:
    """'a_b' as 'A B'."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def plural(noun: Column) -> Column:
    """With an s; null where its last word is a number or ends in a hiss."""
    head = F.element_at(F.split(noun, " "), -1)
    return F.when((head != "") & ~head.rlike(r"^[0-9]+\z") & ~head.rlike(r"(s|x|z|ch|sh)\z"), F.concat(noun, F.lit("s")))


def shard_name(case: Column, part: Column, frame: Column) -> Column:
    return F.format_string("case_%03d/part%d/%06d.jpg", case, part, frame)


def name_parts(path: Column) -> Column:
    """What stands between the separators of a file name or path."""
    return F.filter(F.split(path, r"[/_\-\s.]+"), lambda t: t != "")


def number_behind(parts: Column, label: str) -> Column:
    """The digits behind the first part that ends in ``label``, in the same part or the next; null without any."""
    at = F.array_position(F.transform(parts, lambda t: F.regexp_replace(F.lower(t), r"[0-9]+$", "").endswith(label)), True).cast("int")
    own = F.regexp_extract(F.get(parts, at - 1), r"([0-9]*)$", 1)
    return F.when(at > 0, F.nullif(F.when(own != "", own).otherwise(F.regexp_extract(F.coalesce(F.get(parts, at), F.lit("")), r"^([0-9]*)", 1)), F.lit("")))


def parsed_name(path: Column) -> Column:
    """case, part and frame (longs, null where absent) of the usual file names of shards, clips and frames."""
    parts = name_parts(path)
    last = F.get(parts, F.size(parts) - 2)  # before the extension
    frame = F.when(last.rlike("^[0-9]+$"), last)
    return F.struct(number_behind(parts, "case").cast("long").alias("case"), number_behind(parts, "part").cast("long").alias("part"), frame.cast("long").alias("frame"))


def valid_threshold(x: Column) -> Column:
    """Whether a number is a finite share from 0 to 1; null isn't."""
    return F.coalesce(~F.isnan(x) & x.between(0, 1), F.lit(False))


def clipped(text: Column, width: int) -> Column:
    """White space squeezed, at most ``width`` characters, the last an ellipsis where something was cut."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)


def capped_list(items: Column, most: int, n: Column | None = None) -> Column:
    """The first ``most`` items, and how many more there are; ``n`` counts all where ``items`` holds only the first."""
    n = F.size(items) if n is None else n
    shown = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(n > most, F.concat(shown, F.lit(" +"), (n - most).cast("string"), F.lit(" more"))).otherwise(shown)


def evidence_prompt(blocks: Sequence[tuple[str, Column]]) -> Column:
    """A line a block, "title: text"; blocks without text are left out."""
    return F.concat_ws("\n", *(F.when(text != "", F.concat(F.lit(f"{title}: "), text)) for title, text in blocks))


def mapped(name: Column, known: dict[str, str | None]) -> Column:
    """The name's entry, which may be null; a name without an entry is an error."""
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.when(name.isin(*known), F.try_element_at(table, name)).when(name.isNotNull(), F.raise_error(F.concat(F.lit("unknown name: "), name)).cast("string"))


def variant_gate(asked: Column, intent: Column, classes: Column, detected: Column, decided: Column, family: Column, of: Column, families: Sequence[str]) -> Column:
    """Yes or No to "is it of the asked family", null where the answer must come from elsewhere.

    It takes a known family in the question, the intent "presence", just the class ``of`` among the
    classes asked about, that class detected, and a model that decided for a known family.
    """
    known = asked.isin(*families) & family.isin(*families)
    return F.when(known & (intent == "presence") & (classes == F.array(of)) & detected & decided, F.when(family == asked, "Yes").otherwise("No"))


def response_text(answer: Column, fallback: str) -> Column:
    """An answer as a JSON string, its white space squeezed; the fallback where nothing is left."""
    text = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), r"[ \t\n\f\r]+", " "))
    encoded = F.to_json(F.array(F.when(text == "", fallback).otherwise(text)))
    return F.substring(encoded, F.lit(2), F.length(encoded) - 2)


def annotation(line: Column, shapes: Sequence[tuple[str, str]]) -> Column:
    """intent and answer of a "question|answer" line by the first shape its question begins with, else null."""
    question, answer = F.trim(F.split_part(line, F.lit("|"), F.lit(1))), F.trim(F.split_part(line, F.lit("|"), F.lit(2)))
    intent = F.coalesce(*(F.when(question.startswith(prefix), name) for prefix, name in shapes))
    return F.when(line.contains("|") & (answer != "") & intent.isNotNull(), F.struct(intent.alias("intent"), answer.alias("answer")))


def rendered(template: str, slots: Mapping[str, Column], allowed: Mapping[str, Sequence[str]]) -> Column:
    """A template with its ``{slot}``s filled in, white space squeezed.

    A slot's value has to be one of those ``allowed`` for it (any text where nothing is said of it); another value, an
    empty one, and a text that comes out empty are errors.  A slot the template doesn't know, or lacks, is a ValueError.
    """
    asked = re.findall(r"\{(\w+)\}", template)
    if set(asked) != set(slots):
        raise ValueError(f"slots {sorted(slots)} for a template with {sorted(set(asked))}")
    parts: list[Column] = []
    for k, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if k % 2 == 0:
            parts.append(F.lit(piece))
            continue
        value = slots[piece]
        good = value.isin(*allowed[piece]) if piece in allowed else F.trim(value) != ""
        parts.append(F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{piece} can't be "), F.coalesce(value, F.lit("null")))).cast("string")))
    line = F.trim(F.regexp_replace(F.concat(*parts), r"\s+", " "))
    return F.when(line != "", line).otherwise(F.raise_error(F.lit(f"nothing rendered from {template!r}")).cast("string"))
