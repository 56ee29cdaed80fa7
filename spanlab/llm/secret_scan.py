"""Secret scans: fixed patterns plus character Markov models of random strings and ordinary identifiers.

Two first-order character models are counted from labelled samples (label 1: random
strings such as keys and digests, label 0: ordinary identifiers and words).  A candidate
is a run of at least ``LEAST`` key characters; its score is the mean log-likelihood ratio of
its character pairs under the two models, and it becomes a span of kind ``random`` when the
score exceeds ``threshold``.  In a run that is ordinary on the whole, such as a key name or
path with a secret behind it, the segments are found whose pairs exceed the threshold by the
largest sum; one of more than ``LEAST * threshold`` takes the parts between separators whole
that lie in it by half or more, leaves the others, and becomes a span when it has ``LEAST``
characters.  A span of the models may overlap pattern
spans, so a secret that is longer than what a pattern takes of it is covered whole; it is left
out where a pattern span has just its bounds.  Shorter strings than ``LEAST`` are left to the
patterns: their few pairs tell too little.  The models are tables over ASCII pairs, so their
size doesn't depend on the samples or the corpus.

Everything on the main path is DataFrame functions evaluated row by row: no shuffle, no
Python.  Nulls: a null text has no spans; a null id is kept.  Empty and repeated rows give
a row each; extra columns are ignored by ``scan`` and kept by ``redact``.  Ties in start
are ordered by kind as listed in ``KINDS``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, running, shielded

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"[0-9a-f]{24,}"  # the runs [0-9a-f]+ of 24 or more characters
LEAST = 20  # the least characters of a candidate; from 16 on ordinary long words begin to pass
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:long,rank:int,end:long>>"
WIDTH = 128

# Words that ordinary identifiers are made of.
WORDS = """access account action active address after align amount append array author average background balance base
batch before block body border bottom branch buffer build button bytes cache call cancel catalog category center change
channel check child class client close cluster code color column command comment common compare config connect console
content context control copy count create cursor custom data date default delete depth design detail device direction
disable display document domain download driver edit element email empty enable encode engine entry error event example
execute export factory field file filter first folder font footer format frame function gateway general global group
handler hash header height helper history host image import index info input install instance interval item iterator
journal keyboard label language last layout length level library limit line list load local location login manager
matrix member memory menu message method model module monitor name network node number object offset option order
output package page parent parse path pattern payload people please point policy position prefix process project
property protocol provider query queue random range reader record region register release remote render report request
resource response result return route schedule schema screen search section select server service session setting
shadow signal simple size source stack start state static status storage stream string style submit switch system table
target template thread time title total track transfer tree trigger type update upload user value vector version view
visible warning weather width window worker wrapper write zone aber allgemein arbeit auch bereich besser dieser einheit
erste gegen geschichte immer keit lich mensch nicht schaft schule ungen unter verein wieder zeit zusammen ainsi aussi
avec beaucoup comme donner encore entre femme homme jamais maintenant notre pouvoir premier quelque toujours ahora
antes ciudad cuando desde donde estado grande mismo mundo mujer nunca pueblo siempre tiempo trabajo""".split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """The default training sample, ``n`` strings a form: (token string, label int).

    Random strings are hexadecimal and base-64 digests of a counter and mixtures of
    their letters; identifiers join words in the usual ways or
    repeat one character.
    """
    words = F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))
    cap = lambda k: F.initcap(pick(k))
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    number = F.pmod("id", F.lit(100)).cast("string")
    forms = [
        (digest, 1),
        (raw, 1),
        (F.regexp_replace(raw, "[+/]", ""), 1),
        (F.upper(F.regexp_replace(raw, "[+/]", "")), 1),
        (F.lower(F.regexp_replace(raw, "[+/]", "")), 1),
        (F.concat_ws("_", pick(1), pick(2), pick(3)), 0),
        (F.concat(pick(1), cap(2), cap(3)), 0),
        (F.concat_ws("-", pick(1), pick(2), number), 0),
        (F.concat_ws("/", pick(1), pick(2), pick(3), pick(4)), 0),
        (F.upper(F.concat_ws("_", pick(1), pick(2), pick(3))), 0),
        (F.concat(pick(1), pick(2), pick(3)), 0),
        (F.concat(cap(1), F.lit("="), pick(2)), 0),
        (F.repeat(F.substring(F.lit("-_=+/0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.pmod("id", F.lit(67)) + 1).cast("int"), F.lit(1)), F.lit(8)), 0),
    ]
    each = F.explode(F.array(*(F.struct(t.alias("token"), F.lit(x).alias("label")) for t, x in forms)))
    return spark.range(n).select(each.alias("s")).select("s.token", "s.label")


def train(samples: DataFrame, alpha: float = 0.5) -> list[float]:
    """Log ratios log P(b|a, random) - log P(b|a, ordinary) at ``a * 128 + b``, add-``alpha`` smoothed.

    ``samples(token, label)``; null tokens and characters outside ASCII are left out.  At most
    2 * 128 * 128 counts reach the driver.
    """
    chars = F.split(F.regexp_replace("token", r"[^\x00-\x7F]", ""), "")
    pairs = F.arrays_zip(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))).alias("a"), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))).alias("b"))
    rows = samples.where("token is not null").select("label", F.explode(pairs).alias("p")).groupBy("label", F.ascii("p.a").alias("a"), F.ascii("p.b").alias("b")).count().collect()
    seen = [[0.0] * (WIDTH * WIDTH) for _ in range(2)]
    for r in rows:
        seen[1 if r.label else 0][r.a * WIDTH + r.b] += r["count"]
    ratios = [0.0] * (WIDTH * WIDTH)
    used = sorted({i % WIDTH for s in seen for i, n in enumerate(s) if n} | {i // WIDTH for s in seen for i, n in enumerate(s) if n})
    for a in used:
        sums = [sum(s[a * WIDTH : (a + 1) * WIDTH]) + alpha * len(used) for s in seen]
        for b in used:
            p = [(s[a * WIDTH + b] + alpha) / n for s, n in zip(seen, sums, strict=True)]
            ratios[a * WIDTH + b] = math.log(p[1] / p[0])
    return ratios


HITS = "array<struct<start:long,rank:int,end:long,hit:string>>"


def _hits(text: Column, pattern: str, kind: str, size: Callable[[Column], Column]) -> Column:
    """All leftmost, non-overlapping matches with their strings; positions from the text between matches."""

    def placed(x: Column) -> Column:
        at = lambda i: F.get(x["before"], i) + size(F.get(x["pieces"], i))
        return F.transform(x["hits"], lambda h, i: F.struct(at(i).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (at(i) + size(h)).alias("end"), h.alias("hit")))

    cut = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    steps = lambda x: F.transform(x["hits"], lambda h, i: (size(F.get(x["pieces"], i)) + size(h)).cast("long"))
    found = let(let(cut, lambda x: F.struct(x["pieces"].alias("pieces"), x["hits"].alias("hits"), running(steps(x)).alias("before"))), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(HITS))


def _span(start: Column, rank: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), rank.cast("int").alias("rank"), end.cast("long").alias("end"))


def _segments(hit: Column, excess: Column, least: float) -> Column:
    """(a, b) of the segments whose pairs sum up to more than ``least``, cut at separators, apart, in order."""
    none = F.array().cast("array<struct<a:int,b:int>>")
    first = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0).alias("a"), F.lit(0).alias("b"), none.alias("found"))
    emitted = lambda acc: F.when(acc["peak"] > least, F.concat(acc["found"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))).otherwise(acc["found"])

    def step(acc: Column, x: Column) -> Column:
        now, i = acc["sum"] + x, acc["i"]
        ends, best = (now <= 0) | (acc["peak"] - now > least), now > acc["peak"]
        return F.struct(
            (i + 1).alias("i"),
            F.when(ends, 0.0).otherwise(now).alias("sum"),
            F.when(ends, 0.0).when(best, now).otherwise(acc["peak"]).alias("peak"),
            F.when(ends, i).otherwise(acc["a"]).alias("a"),
            F.when(ends | best, i + 1).otherwise(acc["b"]).alias("b"),
            F.when(ends, emitted(acc)).otherwise(acc["found"]).alias("found"),
        )

    def wide(s: Column) -> Column:
        to_a, from_a = F.substring(hit, F.lit(1), s["a"]), F.substring(hit, s["a"] + 1, F.length(hit))
        to_b, from_b = F.substring(hit, F.lit(1), s["b"]), F.substring(hit, s["b"] + 1, F.length(hit))
        before = lambda part: F.length(F.regexp_extract(part, "[^=/_-]*$", 0))
        behind = lambda part: F.length(F.regexp_extract(part, "^[^=/_-]*", 0))
        a = F.when(before(to_a) > behind(from_a), s["a"] + behind(from_a) + 1).otherwise(s["a"] - before(to_a))
        b = F.when(behind(from_b) > before(to_b), s["b"] - before(to_b) - 1).otherwise(s["b"] + behind(from_b))
        return F.struct(a.alias("a"), b.alias("b"))

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (s["a"] < F.try_element_at(acc, F.lit(-1))["b"]), joined).otherwise(F.concat(acc, F.array(s)))

    found = F.transform(F.aggregate(excess, first, step, emitted), wide)
    return F.aggregate(found, none, merge)


def spans(text: Column, ratios: list[float], threshold: float = 0.5, size: Callable[[Column], Column] = F.length) -> Column:
    """Struct of ``base`` and ``random`` spans of a text, each sorted: (start, rank of kind, end), end exclusive.

    Positions are in what ``size`` measures, code points (F.length) or bytes (F.octet_length).
    """
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    text = F.coalesce(text, F.lit(""))
    long_value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6
    plain = lambda found: F.transform(found, lambda s: _span(s["start"], s["rank"], s["end"]))
    base = F.array_sort(F.concat(plain(F.filter(_hits(text, ASSIGN, "assign", size), long_value)), plain(_hits(text, ACCESS, "access", size)), plain(_hits(text, HEX, "hex", size))))

    def coded(run: Column) -> Column:
        return F.struct(*(run[k].alias(k) for k in ("start", "rank", "end", "hit")), F.transform(F.split(run["hit"], ""), lambda c: F.ascii(c)).alias("codes"))

    def scored(run: Column) -> Column:
        """A run with what each of its pairs has above the threshold."""
        excess = F.transform(run["codes"], lambda c, i: F.when(i == 0, 0.0).otherwise(F.get(table, F.get(run["codes"], i - 1) * WIDTH + c) - threshold))
        return F.struct(*(run[k].alias(k) for k in ("start", "rank", "end", "hit")), excess.alias("excess"))

    def random_in(x: Column) -> Column:
        total = F.aggregate(x["excess"], F.lit(0.0), lambda acc, e: acc + e)
        parts = F.filter(_segments(x["hit"], x["excess"], LEAST * threshold), lambda s: s["b"] - s["a"] >= LEAST)
        return F.when(total > 0, F.array(_span(x["start"], x["rank"], x["end"]))).otherwise(F.transform(parts, lambda s: _span(x["start"] + s["a"], x["rank"], x["start"] + s["b"])))

    def random(found: Column) -> Column:
        every = F.flatten(F.transform(F.transform(F.transform(found["runs"], coded), scored), random_in))
        bounds = lambda spans: F.transform(spans, lambda s: F.shiftleft(s["start"], 32) + s["end"])
        own = F.transform(F.array_except(bounds(every), bounds(found["base"])), lambda x: _span(F.shiftright(x, 32), F.lit(KINDS.index("random")), F.pmod(x, F.lit(1 << 32))))
        return F.struct(found["base"].alias("base"), own.alias("random"))

    return let(F.struct(base.alias("base"), _hits(text, CANDIDATE, "random", size).alias("runs")), random)


def scan(docs: DataFrame, ratios: list[float], threshold: float = 0.5) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the columns ``base`` and ``every`` (arrays of spans) added."""
    found = docs.withColumn("_found", spans(F.col("text"), ratios, threshold))
    return found.withColumn("base", F.col("_found.base")).withColumn("every", F.array_sort(F.concat("_found.base", "_found.random"))).drop("_found")


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float], threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans get one mark.

    Texts are cut by bytes, where a piece is found without going through what comes before it.
    """
    inner, restore = shielded(docs, "text")
    found = inner.withColumn("_found", spans(F.col("text"), ratios, threshold, F.octet_length))
    found = found.withColumn("_every", F.array_sort(F.concat("_found.base", "_found.random")))

    def cut(x: Column) -> Column:
        piece = lambda a, b: F.substring(x["raw"], (a + 1).cast("int"), (b - a).cast("int")).cast("string")
        upto = lambda i: F.get(x["upto"], i)
        pieces = F.transform(x["every"], lambda s, i: F.when(s["start"] >= upto(i), F.concat(piece(upto(i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), piece(F.array_max(F.transform(x["every"], lambda s: s["end"])), F.octet_length(x["raw"]).cast("long")))

    upto = running(F.transform("_every", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    clean = let(F.struct(F.col("text").cast("binary").alias("raw"), F.col("_every").alias("every"), upto.alias("upto")), cut)
    return restore(found.withColumn("text", F.when(F.size("_every") > 0, clean).otherwise(F.col("text"))))
