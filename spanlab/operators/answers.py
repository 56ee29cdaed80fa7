"""Answers to questions about a clip, from what its record shows.

The intent (``rules.intent``) picks the form of the answer.  A record is the list of instrument classes in view (null: not
measured), their scores, the task and whether the picture stands still (null: not measured).
Nothing here fails: a record that lacks what a form needs gets that form's fallback.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import english_list, let
from ..functions.records import DISPLAY, PURPOSE, TASK_NAME, TASK_ORGAN, class_display, entry_of
from ..functions.text import finalized, matched_phrases, words_only
from .rules import TOOLS, intent, is_polar, ladder, negated

# What a question may call an instrument besides the names of its class.
TERMS = {
    "forceps": ("bipolar forceps", "cadiere forceps", "force bipolar", "prograsp forceps"),
    "grasper": ("cadiere forceps", "grasping retractor", "prograsp forceps", "tip-up fenestrated grasper"),
    "graspers": ("cadiere forceps", "grasping retractor", "prograsp forceps", "tip-up fenestrated grasper"),
    "retractor": ("grasping retractor", "tip-up fenestrated grasper"),
    "scissors": ("monopolar curved scissors",),
    "shears": ("monopolar curved scissors",),
    "monopolar": ("monopolar curved scissors",),
    "bipolar": ("bipolar forceps", "force bipolar"),
    "cadiere": ("cadiere forceps",),
    "prograsp": ("prograsp forceps",),
    "needle holder": ("needle driver",),
    "needle drivers": ("needle driver",),
    "clip applier": ("clip applier",),
    "stapler": ("stapler",),
    "sealer": ("vessel sealer",),
    "cautery": ("permanent cautery hook/spatula",),
    "cautery hook": ("permanent cautery hook/spatula",),
    "hook": ("permanent cautery hook/spatula",),
    "spatula": ("permanent cautery hook/spatula",),
    "tip up": ("tip-up fenestrated grasper",),
}
# Classes by how often they are in use, and those named first where one that is absent is asked for.
USUAL = (
    "cadiere forceps",
    "monopolar curved scissors",
    "bipolar forceps",
    "needle driver",
    "grasping retractor",
    "prograsp forceps",
    "force bipolar",
    "vessel sealer",
    "permanent cautery hook/spatula",
    "clip applier",
    "stapler",
    "tip-up fenestrated grasper",
)
SELDOM = (
    "tip-up fenestrated grasper",
    "clip applier",
    "vessel sealer",
    "force bipolar",
    "stapler",
    "permanent cautery hook/spatula",
    "grasping retractor",
    "prograsp forceps",
)
# Instruments that cut and that divide, those that sew; the names of tasks in questions, longer ones first.
CUTTING = ("monopolar curved scissors", "permanent cautery hook/spatula", "vessel sealer", "stapler")
SEWING, SEWING_TASK = ("needle driver",), "suturing"
TASK_PHRASES = (
    ("rectal artery and vein dissection", "rectal artery/vein"),
    ("rectal artery/vein dissection", "rectal artery/vein"),
    ("uterine horn mobilization", "uterine horn"),
    ("suspensory ligament dissection", "suspensory ligaments"),
    ("retraction and collision avoidance", "retraction and collision avoidance"),
    ("range of motion", "range of motion"),
    ("skills application", "skills application"),
    ("suspensory ligaments", "suspensory ligaments"),
    ("rectal artery", "rectal artery/vein"),
    ("uterine horn", "uterine horn"),
    ("surgical activity", "other"),
    ("retraction", "retraction and collision avoidance"),
)
# Answers that need no record.
SAYS_YES, SAYS_OPEN = "Yes", "The procedure involves surgical instruments."
SAYS_ORGAN, SAYS_PROCEDURE, SAYS_PURPOSE = "Tissue", "Endoscopic surgery or a laparoscopic surgery", "To manipulate and control tissue during the surgery."
NUMBERS = "Zero One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve".split()
USUAL_COUNT, LISTED, SOFT_SHARE, SOFT_MOST = 3, 3, 0.5, 3


def plain(phrase: str) -> str:
    """A phrase as ``words_only`` leaves it."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower()).split())


def phrase_table(classes: Sequence[str] = TOOLS, terms: Mapping[str, Sequence[str]] = TERMS) -> dict[str, tuple[str, ...]]:
    """Every phrase for an instrument with its classes: class names, terms, and plurals of those that have one."""
    table: dict[str, set[str]] = {}
    for phrase, own in [*((c, (c,)) for c in classes), *terms.items()]:
        table.setdefault(plain(phrase), set()).update(own)
    for phrase, own in list(table.items()):
        head = phrase.split(" ")[-1]
        if not head.isdigit() and not head.endswith(("s", "x", "z", "ch", "sh")):
            table.setdefault(phrase + "s", set()).update(own)
    return {p: tuple(sorted(c)) for p, c in table.items()}


def _listed(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _by_phrase(table: Mapping[str, Column]) -> Column:
    return F.create_map(*(x for phrase, value in table.items() for x in (F.lit(phrase), value)))


def mentioned(question: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """The classes a question may mean: those of its phrases, leftmost and longest first, none inside another."""
    found = F.transform(matched_phrases(words_only(question), list(table)), lambda p: F.try_element_at(_by_phrase({k: _listed(v) for k, v in table.items()}), p))
    return F.array_distinct(F.flatten(found))


def credible(tools: Column, scores: Column) -> Column:
    """The classes in view; where the list is empty, those that score a half or more, if they are few enough to be true."""
    soft = F.map_keys(F.map_filter(F.coalesce(scores, F.create_map().cast("map<string,double>")), lambda k, v: v >= SOFT_SHARE))
    hard = F.coalesce(tools, F.array().cast("array<string>"))
    return F.when(F.size(hard) > 0, hard).when(F.size(soft).between(1, SOFT_MOST), soft).otherwise(hard)


def ranked(classes: Column, scores: Column) -> Column:
    """Classes by falling score, then by how usual they are."""
    usual = F.create_map(*(F.lit(x) for k, c in enumerate(USUAL) for x in (c, k)))
    order = F.transform(classes, lambda c: F.struct((-F.coalesce(F.try_element_at(scores, c), F.lit(0.0))).alias("s"), F.coalesce(F.try_element_at(usual, c), F.lit(len(USUAL))).alias("u"), c.alias("c")))
    return F.transform(F.array_sort(order), lambda x: x["c"])


def named_task(question: Column) -> Column:
    """The task a question names, null without one."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " ")))
    return F.coalesce(*(F.when(F.contains(text, F.lit(phrase)), task) for phrase, task in TASK_PHRASES))


def sentence(tools: Column, task: Column) -> Column:
    """What a record shows, in one of four sentences."""
    order = ranked(tools, F.create_map().cast("map<string,double>"))
    names = english_list(F.transform(order, lambda c: F.lower(class_display(c))))
    doing = F.lower(entry_of(task, TASK_NAME))
    verb = F.when(F.size(tools) == 1, " is in use ").otherwise(" are in use ")
    some = F.size(tools) > 0
    shown = F.when(some & doing.isNotNull(), F.concat(names, verb, F.lit("during "), doing, F.lit("."))).when(some, F.concat(names, verb, F.lit("in this procedure."))).when(doing.isNotNull(), F.concat(F.lit("The procedure involves "), doing, F.lit(".")))
    return finalized(F.coalesce(shown, F.lit(SAYS_OPEN)), SAYS_OPEN)


def answered(question: Column, tools: Column, task: Column, scores: Column | None = None, still: Column | None = None, table: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The answer to a question from a record; never empty.

    Presence, cutting and suturing are yes or no by the classes in view (cutting counts instruments that divide, and not
    where the picture stands still; suturing counts the task too), turned by a negation.
    An instrument is named within the family that the question names, an absent one where it negates; several
    where it asks for several.  What isn't understood gets yes, no where it negates, or a general sentence.
    """
    table = table or phrase_table()
    none = F.create_map().cast("map<string,double>")
    hard = F.coalesce(tools, F.array().cast("array<string>"))
    scores = none if scores is None else F.coalesce(scores, none)
    still = F.lit(False) if still is None else F.coalesce(still, F.lit(False))
    facts = F.struct(
        intent(question).alias("kind"),
        negated(question).alias("no"),
        words_only(question).alias("words"),
        is_polar(question).alias("polar"),
        named_task(question).alias("asked_task"),
        matched_phrases(words_only(question), list(table)).alias("phrases"),
        credible(hard, scores).alias("seen"),
        hard.alias("hard"),
        scores.alias("scores"),
        still.alias("still"),
        task.alias("task"),
    )
    return finalized(let(facts, lambda r: _form(r, table)), SAYS_OPEN)


def _form(r: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """The answer of a question's intent from the facts of question and record."""
    no, seen, hard, task, words = r["no"], r["seen"], r["hard"], r["task"], r["words"]
    classes = _by_phrase({k: _listed(v) for k, v in table.items()})
    with_wanted = lambda use: let(F.array_distinct(F.flatten(F.transform(r["phrases"], lambda p: F.try_element_at(classes, p)))), use)
    yes = lambda test: F.when(test, "Yes").otherwise("No")
    turned = lambda form: F.when(no, F.when(form == "Yes", "No").otherwise("Yes")).otherwise(form)
    any_of = lambda own: F.arrays_overlap(seen, _listed(own))
    word = lambda n: F.coalesce(F.get(_listed(NUMBERS), n), n.cast("string"))

    def presence(wanted: Column) -> Column:
        return F.when(F.size(wanted) > 0, yes(F.arrays_overlap(seen, wanted))).when(words.rlike(r"\b(tool|instrument|device)s?\b"), yes(F.size(seen) > 0)).otherwise(SAYS_YES)

    def count(wanted: Column) -> Column:
        family = F.size(wanted) > 0
        return word(F.when(F.size(seen) == 0, F.when(family, 1).otherwise(USUAL_COUNT)).when(family, F.size(F.array_intersect(seen, wanted))).otherwise(F.size(seen)))

    def named(wanted: Column) -> Column:
        family = F.when(F.size(wanted) > 0, wanted).otherwise(_listed(TOOLS))
        pool = F.when(F.arrays_overlap(family, hard), F.array_intersect(family, hard)).otherwise(family)
        several = words.rlike(r"\b(tools|instruments|devices)\b")
        return let(ranked(pool, r["scores"]), lambda x: F.when(several, english_list(F.transform(F.slice(x, 1, LISTED), class_display))).otherwise(class_display(F.get(x, F.lit(0)))))

    present = F.when(F.size(hard) > 0, hard).otherwise(seen)
    absent = F.get(F.filter(_listed([*SELDOM, *(t for t in TOOLS if t not in SELDOM)]), lambda c: ~F.array_contains(present, c)), F.lit(0))
    place = {c: k for k, c in enumerate(USUAL)}
    meant = {p: PURPOSE.get(p) or next((PURPOSE[c] for c in sorted(own, key=lambda c: place.get(c, 99)) if c in PURPOSE), SAYS_PURPOSE) for p, own in table.items()}
    forms = {
        "tool_presence": turned(with_wanted(presence)),
        "cutting": turned(yes(any_of(CUTTING) & ~r["still"])),
        "suture": turned(yes(F.coalesce(task == SEWING_TASK, F.lit(False)) | any_of(SEWING))),
        "task_confirm": F.when(r["asked_task"].isNull() | task.isNull(), SAYS_YES).otherwise(yes(r["asked_task"] == task)),
        "approach": yes(words.rlike(r"\b(open (surgery|surgical|procedure|operation|approach|technique)|laparotomy)\b") == no),
        "count": with_wanted(count),
        "organ": F.coalesce(entry_of(task, TASK_ORGAN), F.lit(SAYS_ORGAN)),
        "task": F.coalesce(entry_of(task, TASK_NAME), F.lit(SAYS_OPEN)),
        "tool_identity": F.when(no, F.when(absent.isNotNull(), class_display(absent)).otherwise(SAYS_OPEN)).otherwise(with_wanted(named)),
        "purpose": F.coalesce(F.try_element_at(_by_phrase({p: F.lit(t) for p, t in meant.items()}), F.get(r["phrases"], F.lit(0))), F.lit(SAYS_PURPOSE)),
        "procedure": F.lit(SAYS_PROCEDURE),
        "unknown_polar": yes(~no),
    }
    answer = F.lit(SAYS_OPEN)
    for name, form in forms.items():
        answer = F.when(r["kind"] == name, form).otherwise(answer)
    return F.coalesce(answer, F.when(r["polar"], SAYS_YES).otherwise(SAYS_OPEN))


RECORD = "tools_present array<string>, tools map<string,double>, task_top string, still boolean"


def answered_from(question: Column, record: Column, table: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The answer from a record's JSON text; text that is no record leaves every field unmeasured."""
    return let(F.from_json(record, RECORD, {"mode": "PERMISSIVE"}), lambda r: answered(question, r["tools_present"], r["task_top"], r["tools"], r["still"], table))


def evidence_verdict(intent_: Column, question: Column, answer: Column, tools: Column, family: Column, decided: Column, names: Sequence[str]) -> Column:
    """agrees, contradicts or undecidable: a yes or no against what the record shows.

    Two lenses: the family of a variant that the question names against the one decided for, and the
    class that the question names, longer names first, against the classes in view (null: not measured).
    """
    said = F.regexp_replace(F.lower(F.trim(answer)), r"\.+$", "")
    polar = F.when(said.isin("yes", "no"), said == "yes")
    text = F.lower(question)
    asked = F.when(F.contains(text, F.lit("mega")), "mega").when(F.contains(text, F.lit("large")), "large")
    found = F.lower(family)
    variant = F.when(decided & found.isin("mega", "large"), asked == found)
    name = F.coalesce(*(F.when(F.contains(text, F.lit(n.lower())), n.lower()) for n in sorted(names, key=lambda n: (-len(n), n))))
    present = F.when(name.isNotNull(), F.exists(tools, lambda t: F.lower(t) == name))
    says = F.when(intent_ == "variant_presence_polar", variant).when(intent_ == "tool_presence_polar", present)
    return ladder([("agrees", F.coalesce(says == polar, F.lit(False))), ("contradicts", F.coalesce(says != polar, F.lit(False)))], "undecidable")


def display_of(cls: str) -> str:
    """A class as answers write it."""
    return DISPLAY.get(cls) or " ".join(w.capitalize() for w in cls.split(" "))
