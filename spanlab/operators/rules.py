"""Question intents, polarity, answer forms, arbitration between answers.

A question is read as words.  What it asks is told by how it asks (why, how many, who, ...) and,
failing that, by its focus, the asked-about concept nearest to its beginning; a question for yes
or no by the concepts it names.  Concepts are looked up word by word in ``CONCEPTS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import words_only

# The instrument classes and the named tasks that records carry.
TOOLS = (
    "bipolar forceps",
    "cadiere forceps",
    "clip applier",
    "force bipolar",
    "grasping retractor",
    "monopolar curved scissors",
    "needle driver",
    "permanent cautery hook/spatula",
    "prograsp forceps",
    "stapler",
    "tip-up fenestrated grasper",
    "vessel sealer",
)
TASKS = ("range of motion", "rectal artery", "collision avoidance", "skills application", "suspensory ligament", "uterine horn")

# Words that name each concept.  A term of two words goes before its words.
CONCEPTS = {
    "instrument": "forceps scissors stapler clip_applier clip_appliers vessel_sealer vessel_sealers cautery_hook hook spatula grasper graspers retractor retractors prograsp bipolar needle_driver needle_drivers",
    "tool": "tool tools instrument instruments device devices instrumentation",
    "cut": "cut cuts cutting divide divides divided dividing division transect transected transecting transection incise incised incising incision dissect dissected dissecting dissection resect resected resection sever severed severing trim trimmed trimming",
    "sew": "suture sutures sutured suturing stitch stitches stitched stitching sew sewn sewing knot knots knotting tied needle anastomosis",
    "organ": "organ organs tissue tissues anatomy anatomical anatomic structure structures region location body_part",
    "task": "task tasks step steps phase activity exercise drill doing happening going_on taking_place scene",
    "procedure": "procedure surgery operation intervention",
    "place": "arm arms hand hands side camera",
}
ASKED = {
    "purpose": "why purpose function role reason used_for meant_for intended_for",
    "count": "many number count",
    "other": "who whose when where how_long how_often how_much many_seconds many_minutes many_times",
}
APPROACHES = "laparoscopic laparoscopy laparotomy endoscopic robotic robot keyhole open_surgery open_procedure open_operation minimally_invasive"
AUXILIARY = "am is are was were do does did has have had can could will would shall should may might isn aren wasn weren don doesn didn hasn haven couldn wouldn".split()
COURTESY = ("can", "could", "would", "will")
OPENING = "what which who whose where when why how name identify describe list state specify tell explain count summarize summarise".split()
NEGATION = ("no", "not", "none", "never", "without", "absent", "nothing", "neither", "lack", "lacking")
TAGS = ("or not", "right", "correct", "yes or no", "true or false")


INTENTS = ("tool_presence", "tool_identity", "organ", "cutting", "suture", "procedure", "purpose", "task", "count", "task_confirm", "approach", "unknown_polar", "unknown_open")


def known_intents(listed: Sequence[str]) -> tuple[str, ...]:
    """Of the intents that a setting lists those that exist, in their own order; a name that was mistyped allows nothing."""
    return tuple(i for i in INTENTS if i in set(listed))


def ladder(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """The name of the first test that holds."""
    out = F.lit(default)
    for name, test in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    line = words_only(text)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def clauses(question: Column) -> Column:
    """The words of each clause; commas, colons, semicolons, full stops and dashes part clauses."""
    return F.transform(F.split(F.coalesce(question, F.lit("")), r"[,;:.!?]+|\s-+\s"), tokens)


def _in(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))


def _opens(words: Column) -> Column:
    """After "can you", "could you please" and the like stands a word that opens an open question."""
    at = F.when(F.get(words, F.lit(2)) == "please", 3).otherwise(2)
    return F.get(words, F.lit(0)).isin(*COURTESY) & (F.get(words, F.lit(1)) == "you") & F.coalesce(F.get(words, at).isin(*OPENING), F.lit(False))


def polite_open(words: Column) -> Column:
    """An open question in polite form; "would you describe this as ..." and "can you tell whether ..." ask for yes or no."""
    return F.coalesce(_opens(words) & ~F.arrays_overlap(words, _in(("as", "whether", "if"))), F.lit(False))


def is_polar(question: Column) -> Column:
    """Some clause opens with an auxiliary and isn't an open question in polite form, or a tag closes the question."""
    opened = F.exists(clauses(question), lambda c: F.coalesce(F.get(c, F.lit(0)).isin(*AUXILIARY), F.lit(False)) & ~polite_open(c))
    return opened | words_only(question).rlike(rf"(^| )({'|'.join(TAGS)})$")


def negated(question: Column) -> Column:
    """The existence asked about is negated, which turns the answer, not the intent; the "no" of a tag like "yes or no" isn't a negation."""
    return F.arrays_overlap(tokens(F.regexp_replace(words_only(question), r"(^| )(or not|yes or no|true or false)$", "")), _in(NEGATION))


def concepts(words: Column, table: dict[str, str]) -> Column:
    """The concepts that a question's words name, in their order; a pair of words goes before its first word."""
    known = F.create_map(*(F.lit(x) for concept, terms in table.items() for term in terms.split() for x in (term, concept)))
    found = F.transform(words, lambda w, i: F.coalesce(F.try_element_at(known, F.concat_ws("_", w, F.get(words, i + 1))), F.try_element_at(known, w)))
    return F.filter(found, lambda c: c.isNotNull())


def intent(question: Column) -> Column:
    """One of 13 intents."""
    facts = F.struct(words_only(question).alias("whole"), is_polar(question).alias("polar"))
    read = lambda f: F.struct(f["whole"].alias("whole"), f["polar"].alias("polar"), F.filter(F.split(f["whole"], " "), lambda w: w != "").alias("words"))
    named = lambda f: F.struct(f.alias("f"), concepts(f["words"], CONCEPTS).alias("named"), concepts(f["words"], ASKED).alias("asked"))
    return let(let(let(facts, read), named), _intent)


def _intent(facts: Column) -> Column:
    whole, words, named, asked = facts["f"]["whole"], facts["f"]["words"], facts["named"], facts["asked"]
    names = lambda concept: F.array_contains(named, concept)
    approaches = F.size(F.array_distinct(concepts(words, {a: a for a in APPROACHES.split()})))
    polar = F.coalesce(
        F.when(names("instrument"), "tool_presence"),
        F.when(whole.rlike("|".join(TASKS)), "task_confirm"),
        F.when(approaches == 1, "approach"),  # of two, the question is which
        F.when(names("cut"), "cutting"),
        F.when(names("sew"), "suture"),
        F.when(names("tool"), "tool_presence"),
        F.lit("unknown_polar"),
    )
    focus = {"instrument": "tool_identity", "tool": "tool_identity", "organ": "organ", "task": "task", "procedure": "procedure", "place": "unknown_open"}
    about = F.get(F.filter(named, lambda c: c.isin(*focus)), F.lit(0))
    how = F.when(F.array_contains(asked, "other"), "unknown_open").when(F.array_contains(asked, "purpose") | (F.element_at(words, -1) == "for"), "purpose").when(F.array_contains(asked, "count"), "count")
    open_ = F.coalesce(how, F.try_element_at(F.create_map(*(F.lit(x) for pair in focus.items() for x in pair)), about), F.lit("unknown_open"))
    return F.when(whole == "", "unknown_open").when(facts["f"]["polar"], polar).otherwise(open_)


def arbitrated(mode: Column, base: Column, draft: Column, intent_: Column, judged: Column, allowed: Sequence[str]) -> Column:
    """The answer under one of five policies; an unusable draft or an unknown mode gives the base answer.

    ``allowed`` counts as far as it names known intents.
    """
    usable = draft.isNotNull() & (F.trim(draft) != "") & (F.lower(F.trim(draft)) != "nan")
    differs = words_only(draft) != words_only(base)
    return (
        F.when(~F.coalesce(usable, F.lit(False)), base)
        .when(mode == "primary", draft)
        .when((mode == "challenger") & differs, draft)
        .when((mode == "per_intent") & intent_.isin(*known_intents(allowed)), draft)
        .when((mode == "judge") & differs & (judged == 2), draft)
        .otherwise(base)
    )
