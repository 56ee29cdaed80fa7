"""Queries over documents, conversations and literal questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import draw, sha1_bucket, stable_index
from ..functions.votes import early_vote, normal_answer
from ..operators import answers as A
from ..operators import metrics as M
from ..operators import rules as R
from ..operators import sampling as S
from .registry import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def q_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each text, grouped by digest so that texts aren't shuffled."""
    first = F.min(F.struct("doc_id", "source")).alias("f")
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("h")).agg(first, F.count(F.lit(1)).alias("copies")).select("f.doc_id", "f.source", "copies")


@query("SELECT sha256(text) AS digest, any_value(substr(sha1(text), 1, 2) || '/' || sha1(text) || '.txt') AS path, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def q_doc_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("digest"), F.sha1("text").alias("s"))
    return d.groupBy("digest").agg(F.min(F.concat(F.substring("s", 1, 2), F.lit("/"), "s", F.lit(".txt"))).alias("path"), F.count(F.lit(1)).alias("n"))


@query(r"""SELECT conv_id, turn, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS words, length(regexp_replace(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' '), '\.+$', ''))::BIGINT AS collapsed,
sha256(trim(lower(translate(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')), ' ')) AS plain FROM conversations""")
def q_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.sha2(X.words_only(t), 256).alias("words"), F.length(X.collapsed(t)).cast("long").alias("collapsed"), F.sha2(X.unpunctuated(t), 256).alias("plain"))


_PREFIXES = ("", "Answer: ", "response - ", 'A: "', "I cannot say: ", "Sorry, ", "Unable to tell ", "'")
_PREFIX_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _PREFIXES) + "]"


@query(rf"""WITH t AS (SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN chr(10) || ' ' || {_PREFIX_SQL}[turn % {len(_PREFIXES)} + 1] || text END AS said FROM conversations),
l AS (SELECT conv_id, turn, turn % {len(_PREFIXES)} AS k, trim(regexp_replace([x FOR x IN string_split(said, chr(10)) IF trim(regexp_replace(x, '[ \t\r\x0B\f]+', ' ', 'g'), ' ') <> ''][1], '[ \t\r\x0B\f]+', ' ', 'g'), ' ') AS line FROM t),
u AS (SELECT conv_id, turn, k, CASE WHEN k IN (1, 2, 3) THEN trim(regexp_replace(line, '^(?i:answer|response|a) *[:-] *', ''), ' ') ELSE line END AS line FROM l),
q AS (SELECT conv_id, turn, k, trim(trim(trim(line, '"'), chr(39)), ' ') AS line FROM u)
SELECT conv_id, turn, CASE WHEN k NOT IN (4, 5, 6) AND line <> '' THEN array_to_string(string_split(line, ' ')[1:24], ' ') END AS clean, CASE WHEN k NOT IN (4, 5, 6) AND line <> '' THEN len(string_split(line, ' ')[1:24]) END::BIGINT AS n_words FROM q""")
def q_sanitize_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns behind labels, quotes and openings of refusals."""
    prefix = F.get(F.array(*map(F.lit, _PREFIXES)), (F.col("turn") % len(_PREFIXES)).cast("int"))
    clean = X.sanitized(F.concat(F.lit("\n "), prefix, F.col("text")))
    return _turns(spark, sf_dir).select("conv_id", "turn", clean.alias("clean")).withColumn("n_words", F.when(F.col("clean").isNotNull(), F.size(F.split("clean", " "))).cast("long"))


# Question, its intent, whether it asks for yes or no, whether it negates, whether it is an open question in polite form.
QUESTIONS = [
    ("Is a needle driver in the picture?", "tool_presence", 1, 0, 0),
    ("Is there no stapler on the screen?", "tool_presence", 1, 1, 0),
    ("Do we see scissors, yes or no?", "tool_presence", 1, 0, 0),
    ("Vessel sealer - in use or not?", "tool_presence", 1, 0, 0),
    ("Have any instruments entered the field?", "tool_presence", 1, 0, 0),
    ("A retractor stands by, right?", "tool_presence", 1, 0, 0),
    ("Am I right that a ProGrasp holds the bowel?", "tool_presence", 1, 0, 0),
    ("Aren't those bipolar forceps?", "tool_presence", 1, 0, 0),
    ("Can you tell whether a clip applier was fired?", "tool_presence", 1, 0, 0),
    ("Will the cautery hook be needed for the incision?", "tool_presence", 1, 0, 0),
    ("Has the duct been transected?", "cutting", 1, 0, 0),
    ("At this moment, are adhesions trimmed?", "cutting", 1, 0, 0),
    ("Is nothing severed here?", "cutting", 1, 1, 0),
    ("Would you describe that as dissection?", "cutting", 1, 0, 0),
    ("Are stitches placed?", "suture", 1, 0, 0),
    ("Does the trainee finish without a knot?", "suture", 1, 1, 0),
    ("Is the range of motion drill running?", "task_confirm", 1, 0, 0),
    ("Do they work near the uterine horn?", "task_confirm", 1, 0, 0),
    ("Was it done as open surgery?", "approach", 1, 0, 0),
    ("Is it a robotic case?", "approach", 1, 0, 0),
    ("Is it robotic or laparoscopic?", "unknown_polar", 1, 0, 0),
    ("Did the patient wake up?", "unknown_polar", 1, 0, 0),
    ("Is the light bright?", "unknown_polar", 1, 0, 0),
    ("Could you please name the device at the top?", "tool_identity", 0, 0, 1),
    ("Would you list the tools laid out?", "tool_identity", 0, 0, 1),
    ("Which grasper pulls on the liver tissue?", "tool_identity", 0, 0, 0),
    ("What sort of scissors does one see?", "tool_identity", 0, 0, 0),
    ("How many devices can be told apart?", "count", 0, 0, 0),
    ("Give the number of instruments, please.", "count", 0, 0, 0),
    ("How many minutes does the step last?", "unknown_open", 0, 0, 0),
    ("How long did the operation take?", "unknown_open", 0, 0, 0),
    ("Who holds the retractor?", "unknown_open", 0, 0, 0),
    ("Where was the film made?", "unknown_open", 0, 0, 0),
    ("Which hand moves first?", "unknown_open", 0, 0, 0),
    ("Which organ is lifted by the forceps?", "organ", 0, 0, 0),
    ("What tissue lies under the hook?", "organ", 0, 0, 0),
    ("Can you identify the anatomical region?", "organ", 0, 0, 1),
    ("What are bipolar forceps for?", "purpose", 0, 0, 0),
    ("Why does one take a stapler here?", "purpose", 0, 0, 0),
    ("State the role of the second instrument.", "purpose", 0, 0, 0),
    ("What is a vessel sealer used for?", "purpose", 0, 0, 0),
    ("Which step of the operation do we watch?", "task", 0, 0, 0),
    ("What exercise is this?", "task", 0, 0, 0),
    ("What is going on?", "task", 0, 0, 0),
    ("Explain what the team is doing.", "task", 0, 0, 0),
    ("Which operation was filmed?", "procedure", 0, 0, 0),
    ("Could you specify the procedure?", "procedure", 0, 0, 1),
    ("Name the surgery.", "procedure", 0, 0, 0),
    ("Sing a song.", "unknown_open", 0, 0, 0),
    ("", "unknown_open", 0, 0, 0),
    ("What's the weather like?", "unknown_open", 0, 0, 0),
    ("Which forceps are not in use?", "tool_identity", 0, 1, 0),
    ("How many forceps are there?", "count", 0, 0, 0),
    ("What are the graspers for?", "purpose", 0, 0, 0),
]
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_LIT = "q(id, question, intent, polar, negated, polite) AS (VALUES " + ", ".join(f"({i}, {_QUOTED(q)}, '{k}', {p}, {n}, {o})" for i, (q, k, p, n, o) in enumerate(QUESTIONS)) + ")"


# The classes that a question may mean, the task and the purpose it names, which ask for several instruments.
_FORCEPS = ["bipolar forceps", "cadiere forceps", "force bipolar", "prograsp forceps"]
_GRASPERS = ["cadiere forceps", "grasping retractor", "prograsp forceps", "tip-up fenestrated grasper"]
MEANT = {0: ["needle driver"], 1: ["stapler"], 2: ["monopolar curved scissors"], 3: ["vessel sealer"], 5: ["grasping retractor", "tip-up fenestrated grasper"], 6: ["prograsp forceps"], 7: ["bipolar forceps"], 8: ["clip applier"], 9: ["permanent cautery hook/spatula"], 25: _GRASPERS, 26: ["monopolar curved scissors"], 51: _FORCEPS, 52: _FORCEPS}
TASK_MEANT = {16: "range of motion", 17: "uterine horn"}
PURPOSE_MEANT = {37: "To grasp tissue and apply bipolar energy to control bleeding.", 38: "To staple and divide tissue during the surgery.", 40: "To seal and divide vessels during the surgery.", 53: "To grasp and hold tissues or objects during the surgery."}
SEVERAL = (24, 28)
_CELL = lambda x: "NULL" if x is None else str(x) if isinstance(x, list) else _QUOTED(x)
_MEANT = "meant(id, wanted, asked_task, purpose) AS (VALUES " + ", ".join(f"({i}, {_CELL(MEANT[i]) if i in MEANT else 'CAST([] AS VARCHAR[])'}, {_CELL(TASK_MEANT.get(i))}, {_CELL(PURPOSE_MEANT.get(i))})" for i in range(len(QUESTIONS))) + ")"
_PICK = f"CAST(('0x' || sha256(conv_id || '|' || turn)[1:16])::UHUGEINT % {len(QUESTIONS)} AS BIGINT)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every turn of a conversation, in capitals or with spaces around for some."""
    pick = stable_index(F.concat_ws("|", "conv_id", "turn"), len(QUESTIONS))
    q = F.get(F.array(*(F.lit(x[0]) for x in QUESTIONS)), F.col("id").cast("int"))
    k = F.col("turn") % 3
    written = F.when(k == 0, q).when(k == 1, F.upper(q)).otherwise(F.concat(F.lit("  "), q, F.lit(" ")))
    return _turns(spark, sf_dir).select("conv_id", "turn", pick.alias("id")).withColumn("question", written)


@query(f"WITH {_LIT}, c AS (SELECT {_PICK} AS id FROM conversations) SELECT id, intent, count(*)::BIGINT AS n FROM c JOIN q USING (id) GROUP BY ALL")
def q_intent_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).groupBy("id", R.intent(F.col("question")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LIT}, c AS (SELECT {_PICK} AS id FROM conversations) SELECT id, polar, negated, polite, count(*)::BIGINT AS n FROM c JOIN q USING (id) GROUP BY ALL")
def q_text_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    kinds = (R.is_polar(q).cast("int").alias("polar"), R.negated(q).cast("int").alias("negated"), R.polite_open(R.tokens(q)).cast("int").alias("polite"))
    return _asked(spark, sf_dir).groupBy("id", *kinds).agg(F.count(F.lit(1)).alias("n"))


# Records are made of a user's events of a day: their kinds stand for instruments, the user's number for the task.
_STANDS = {"click": "cadiere forceps", "error": "monopolar curved scissors", "signup": "needle driver", "purchase": "vessel sealer"}
_DOES = (None, "suturing", "uterine horn", "range of motion", "other")
_NAMED_SQL = "MAP {" + ", ".join(f"{_QUOTED(c)}: {_QUOTED(A.display_of(c))}" for c in R.TOOLS) + "}"
_ORDER_SQL = str(list(A.USUAL))
_SEEN_SQL = "list_sort(list(DISTINCT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STANDS.items()) + " END) FILTER (WHERE event_type <> 'view' AND event_id % 3 <> 0))"
_LISTED_SQL = "CASE WHEN len({0}) = 1 THEN {0}[1] ELSE array_to_string({0}[1:len({0}) - 1], ', ') || ' and ' || {0}[len({0})] END"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type")
    stands = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in _STANDS.items()))
    u = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_set(F.when(F.col("event_id") % 3 != 0, stands))).alias("tools_present"), (F.count_if(F.col("event_type") == "view") > 1).alias("still"))
    return u.withColumn("task_top", F.get(F.array(*map(F.lit, _DOES)), (F.col("user_id") % 5).cast("int")))


@query(rf"""WITH {_LIT}, {_MEANT}, u AS (SELECT user_id, ts::DATE AS day, {_SEEN_SQL} AS seen, count(*) FILTER (WHERE event_type = 'view') > 1 AS still FROM events GROUP BY 1, 2),
r AS (SELECT coalesce(seen, []) AS seen, still, [NULL, 'suturing', 'uterine horn', 'range of motion', 'other'][user_id % 5 + 1] AS task, CAST(('0x' || sha256(user_id || '|' || day)[1:16])::UHUGEINT % {len(QUESTIONS)} AS BIGINT) AS id FROM u),
j AS (SELECT *, negated = 1 AS no, list_intersect(seen, wanted) AS hit, [t FOR t IN {_ORDER_SQL} IF list_contains(CASE WHEN len(wanted) > 0 THEN wanted ELSE {_ORDER_SQL} END, t)] AS family FROM r JOIN q USING (id) JOIN meant USING (id)),
p AS (SELECT *, CASE WHEN len([t FOR t IN family IF list_contains(seen, t)]) > 0 THEN [t FOR t IN family IF list_contains(seen, t)] ELSE family END AS pool FROM j),
y AS (SELECT *, CASE intent WHEN 'tool_presence' THEN CASE WHEN len(wanted) > 0 THEN len(hit) > 0 WHEN id = 4 THEN len(seen) > 0 ELSE true END WHEN 'cutting' THEN len(list_intersect(seen, {list(A.CUTTING)})) > 0 AND NOT still WHEN 'suture' THEN coalesce(task = 'suturing', false) OR list_contains(seen, 'needle driver')
 WHEN 'task_confirm' THEN coalesce(asked_task = task, true) WHEN 'approach' THEN (id = 18) = no WHEN 'unknown_polar' THEN NOT no END AS yes FROM p),
a AS (SELECT id, CASE WHEN yes IS NOT NULL THEN CASE WHEN yes <> (no AND intent IN ('tool_presence', 'cutting', 'suture')) THEN 'Yes' ELSE 'No' END
 WHEN intent = 'count' THEN {A.NUMBERS}[1 + CASE WHEN len(seen) = 0 THEN CASE WHEN len(wanted) > 0 THEN 1 ELSE 3 END WHEN len(wanted) > 0 THEN len(hit) ELSE len(seen) END]
 WHEN intent = 'organ' THEN CASE task WHEN 'suturing' THEN 'Sigmoid colon' WHEN 'uterine horn' THEN 'Uterine horn' WHEN 'range of motion' THEN 'Abdominal wall' ELSE 'Tissue' END
 WHEN intent = 'task' THEN CASE task WHEN 'suturing' THEN 'Suturing' WHEN 'uterine horn' THEN 'Uterine horn mobilization' WHEN 'range of motion' THEN 'Range of motion' WHEN 'other' THEN 'Surgical activity' ELSE '{A.SAYS_OPEN}' END
 WHEN intent = 'tool_identity' THEN CASE WHEN no THEN {_NAMED_SQL}[[t FOR t IN {list(A.SELDOM)} IF NOT list_contains(seen, t)][1]] WHEN id IN {SEVERAL} THEN {_LISTED_SQL.format(f'[{_NAMED_SQL}[t] FOR t IN pool[1:3]]')} ELSE {_NAMED_SQL}[pool[1]] END
 WHEN intent = 'purpose' THEN coalesce(purpose, '{A.SAYS_PURPOSE}') WHEN intent = 'procedure' THEN '{A.SAYS_PROCEDURE}' ELSE '{A.SAYS_OPEN}' END AS answer FROM y)
SELECT id, answer, count(*)::BIGINT AS n FROM a GROUP BY ALL""")
def q_answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every user and day of the event log, and the answer to one question about it."""
    q = F.get(F.array(*(F.lit(x[0]) for x in QUESTIONS)), F.col("id").cast("int"))
    r = _records(spark, sf_dir).select(stable_index(F.concat_ws("|", "user_id", "day"), len(QUESTIONS)).alias("id"), F.to_json(F.struct("tools_present", "task_top", "still")).alias("record"))
    same = r.groupBy("id", "record").agg(F.count(F.lit(1)).alias("n"))  # equal records are answered once
    return same.groupBy("id", A.answered_from(q, F.col("record")).alias("answer")).agg(F.sum("n").alias("n"))


@query(rf"""WITH u AS (SELECT user_id, ts::DATE AS day, {_SEEN_SQL} AS seen FROM events GROUP BY 1, 2),
r AS (SELECT [lower({_NAMED_SQL}[t]) FOR t IN {_ORDER_SQL} IF list_contains(coalesce(seen, []), t)] AS names, [NULL, 'suturing', 'uterine horn mobilization', 'range of motion', 'surgical activity'][user_id % 5 + 1] AS task FROM u),
l AS (SELECT *, CASE WHEN len(names) > 0 THEN {_LISTED_SQL.format('names')} || CASE WHEN len(names) = 1 THEN ' is' ELSE ' are' END || ' in use ' END AS held FROM r),
x AS (SELECT CASE WHEN held IS NOT NULL AND task IS NOT NULL THEN held || 'during ' || task || '.' WHEN held IS NOT NULL THEN held || 'in this procedure.' WHEN task IS NOT NULL THEN 'The procedure involves ' || task || '.' ELSE '{A.SAYS_OPEN}' END AS sentence FROM l)
SELECT upper(sentence[1]) || sentence[2:] AS sentence, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def q_record_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same records show, in one sentence each."""
    return _records(spark, sf_dir).groupBy(A.sentence(F.col("tools_present"), F.col("task_top")).alias("sentence")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(('0x' || sha256(doc_id::VARCHAR)[1:16])::UHUGEINT % 7 AS BIGINT) AS bucket, CAST(('0x' || sha1(doc_id::VARCHAR)[1:8])::BIGINT % 200 AS BIGINT) AS shard, CAST(('0x' || sha256(doc_id::VARCHAR)[1:16])::UHUGEINT % 25 = 0 AS INT) AS keep FROM documents")
def q_stable_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return _docs(spark, sf_dir).select("doc_id", stable_index(key, 7).alias("bucket"), sha1_bucket(key).alias("shard"), (stable_index(key, 25) == 0).cast("int").alias("keep"))


@query("SELECT source, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS texts, round(1 - count(DISTINCT text) / count(*), 6) AS redundancy FROM documents GROUP BY source")
def q_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against distinct texts; two hash aggregations on digests, so a hot source is combined before it is shuffled."""
    per = _docs(spark, sf_dir).groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).withColumn("redundancy", F.round(1 - F.col("texts") / F.col("n"), 6))


@query("SELECT source, lang, n::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY n DESC, first)::BIGINT AS rank FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2)")
def q_mode_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return c.select("source", "lang", "n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "first")).cast("long").alias("rank"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_extract(lower(text), '^[^ \t\n.,]+') AS word FROM conversations), c AS (SELECT conv_id, word, count(*) AS n, min(turn) AS first FROM w GROUP BY 1, 2),
b AS (SELECT conv_id, arg_max(word, (n, -first)) AS word, max(n) AS n, sum(n) AS total FROM c GROUP BY conv_id) SELECT conv_id, word, round(n / total, 6) AS share, CAST(round(n / total, 6) >= 0.66 AS INT) AS accepted FROM b""")
def q_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent first word of a conversation's turns, earliest on ties, and whether two thirds agree."""
    w = _turns(spark, sf_dir).select("conv_id", "turn", F.regexp_extract(F.lower("text"), r"^[^ \t\n.,]+", 0).alias("word"))
    c = w.groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))
    b = c.groupBy("conv_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "word")).alias("b"), F.sum("n").alias("total"))
    share = F.round(F.col("b.n") / F.col("total"), 6)
    return b.select("conv_id", "b.word", share.alias("share"), (share >= 0.66).cast("int").alias("accepted"))


_FIRST_WORD, _SAMPLES, _AGREED, _SECONDS = r"^[^ \t\n.,]+", 5, 0.6, 900


@query(rf"""WITH w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r, rtrim(lower(trim(regexp_extract(text, '{_FIRST_WORD}'), ' ')), '.') AS word, length(text) AS secs FROM conversations WHERE text IS NOT NULL),
a AS (SELECT *, coalesce(sum(secs) OVER (PARTITION BY conv_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {_SECONDS} AS open FROM w WHERE r <= {_SAMPLES}),
c AS (SELECT x.conv_id, x.r AS i, y.word, count(*) AS n, min(y.r) AS first FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.r <= x.r WHERE x.open GROUP BY 1, 2, 3),
s AS (SELECT conv_id, i, arg_max(word, (n, -first)) AS answer, max(n) / i AS share FROM c GROUP BY 1, 2),
e AS (SELECT conv_id, min(i) FILTER (WHERE i >= 2 AND share >= {_AGREED}) AS stop, max(i) AS last FROM s GROUP BY 1),
o AS (SELECT conv_id, count(*) AS offered FROM a GROUP BY 1)
SELECT conv_id, answer, round(share, 6) AS confidence, i::BIGINT AS calls, CAST(stop IS NOT NULL AS INT) AS agreed, CAST(stop IS NULL AND last < offered AS INT) AS curtailed FROM e JOIN o USING (conv_id) JOIN s USING (conv_id) WHERE i = coalesce(stop, last)""")
def q_early_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of a conversation's turns as answers, their lengths as seconds; only a key's first answers are gathered."""
    w = _turns(spark, sf_dir).where("text is not null").select("conv_id", "turn", "text")
    w = w.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))).where(F.col("r") <= _SAMPLES)
    answer = F.struct("r", normal_answer(F.regexp_extract("text", _FIRST_WORD, 0)).alias("word"), F.length("text").cast("double").alias("secs"))
    g = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(answer)).alias("a"))
    v = g.select("conv_id", early_vote(F.col("a.word"), F.col("a.secs"), _AGREED, _SAMPLES, _SECONDS).alias("v"))
    return v.select("conv_id", "v.answer", F.round("v.confidence", 6).alias("confidence"), F.col("v.calls").cast("long").alias("calls"), F.col("v.agreed").cast("int").alias("agreed"), F.col("v.curtailed").cast("int").alias("curtailed"))


@query("SELECT conv_id, sha256(arg_min(text, turn) FILTER (WHERE role = 'user')) AS asked, sha256(arg_min(text, turn) FILTER (WHERE role = 'assistant')) AS answered FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0")
def q_conv_first_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda role: F.min_by(F.sha2("text", 256), F.when(F.col("role") == role, F.col("turn")))
    return _turns(spark, sf_dir).groupBy("conv_id").agg(first("user").alias("asked"), first("assistant").alias("answered")).where("asked is not null and answered is not null")


@query("""SELECT problem, count(*)::BIGINT AS n FROM (SELECT CASE WHEN text IS NULL THEN 'missing' WHEN trim(text, ' ') = '' THEN 'empty' WHEN length(text) < 20 THEN 'short' WHEN length(text) > 1000 THEN 'long' ELSE 'ok' END AS problem FROM conversations WHERE role = 'assistant') GROUP BY 1""")
def q_conv_response_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    problem = R.ladder([("missing", t.isNull()), ("empty", F.trim(t) == ""), ("short", F.length(t) < 20), ("long", F.length(t) > 1000)], "ok")
    return _turns(spark, sf_dir).where("role = 'assistant'").groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH n AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS t FROM conversations), l AS (SELECT *, lag(t) OVER (PARTITION BY conv_id, role ORDER BY turn) AS p FROM n)
SELECT conv_id, role, count(*) FILTER (WHERE p <> '' AND t <> '' AND p <> t)::BIGINT AS disagreements FROM l GROUP BY 1, 2""")
def q_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _turns(spark, sf_dir).select("conv_id", "turn", "role", X.words_only(F.col("text")).alias("t"))
    n = n.withColumn("p", F.lag("t").over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    return n.groupBy("conv_id", "role").agg(F.count_if((F.col("p") != "") & (F.col("t") != "") & (F.col("p") != F.col("t"))).alias("disagreements"))


@query("""WITH v AS (SELECT CASE WHEN d.n_chars BETWEEN 300 AND 600 THEN 'undecidable' WHEN (d.n_chars > 600) = (l.quality = 1) THEN 'agrees' ELSE 'contradicts' END AS verdict, l.toxic FROM documents d JOIN labels l USING (doc_id))
SELECT verdict, count(*)::BIGINT AS n, round(avg(toxic), 6) AS toxic_rate FROM v GROUP BY 1""")
def q_verdict_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    verdict = F.when(F.col("n_chars").between(300, 600), "undecidable").when((F.col("n_chars") > 600) == (F.col("quality") == 1), "agrees").otherwise("contradicts")
    return j.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))


MODES = ("fallback", "challenger", "primary", "per_intent", "judge", "other")
_MODES_SQL = "[" + ", ".join(f"'{m}'" for m in MODES) + "]"


@query(rf"""WITH n AS (SELECT conv_id, turn, regexp_extract(coalesce(text, ''), '^[^ \n.,]+[ .,]?') AS said, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS after FROM conversations),
c AS (SELECT conv_id, turn, said AS base, CASE turn % 4 WHEN 0 THEN upper(said) WHEN 1 THEN 'nan' ELSE regexp_extract(after, '^[^ \n.,]+') END AS draft, ['unknown_open', 'count', 'purpose', 'task'][conv_id % 4 + 1] AS intent, conv_id % 3 AS judged FROM n),
x AS (SELECT *, unnest({_MODES_SQL}) AS mode, trim(regexp_replace(lower(draft), '[^a-z0-9]+', ' ', 'g'), ' ') <> trim(regexp_replace(lower(base), '[^a-z0-9]+', ' ', 'g'), ' ') AS differs FROM c)
SELECT conv_id, turn, mode, CASE WHEN draft IS NULL OR trim(draft, ' ') = '' OR lower(trim(draft, ' ')) = 'nan' THEN base WHEN mode = 'primary' THEN draft WHEN mode = 'challenger' AND differs THEN draft
WHEN mode = 'per_intent' AND intent IN ('unknown_open', 'purpose') THEN draft WHEN mode = 'judge' AND differs AND judged = 2 THEN draft ELSE base END AS answer FROM x""")
def q_arbitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of a turn and of the next as two answers, under every policy."""
    t = _turns(spark, sf_dir).withColumn("after", F.lead("text").over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), F.asc_nulls_last("text"))))
    base = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^ \n.,]+[ .,]?", 0)
    k = F.col("turn") % 4
    t = t.withColumn("base", base).withColumn("draft", F.when(k == 0, X.upper_each(F.col("base"))).when(k == 1, "nan").otherwise(F.regexp_extract("after", r"^[^ \n.,]+", 0)))
    intent = F.get(F.array(*map(F.lit, ("unknown_open", "count", "purpose", "task"))), (F.col("conv_id") % 4).cast("int"))
    c = t.select("conv_id", "turn", "base", "draft", intent.alias("intent"), (F.col("conv_id") % 3).alias("judged"), F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    return c.select("conv_id", "turn", "mode", R.arbitrated(F.col("mode"), F.col("base"), F.col("draft"), F.col("intent"), F.col("judged"), ("unknown_open", "purpose")).alias("answer"))


@query("""WITH p(policy, said) AS (VALUES ('always_0', 0), ('always_1', 1)) SELECT policy, count(*)::BIGINT AS n, round(avg(CAST(quality = said AS INT)), 6) AS quality_accuracy, round(avg(CAST(toxic = said AS INT)), 6) AS toxic_accuracy FROM labels, p GROUP BY policy""")
def q_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant policies scored from the label counts."""
    counts = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    each = counts.withColumn("said", F.explode(F.array(F.lit(0), F.lit(1))))
    rate = lambda c: F.round(F.sum(F.when(F.col(c) == F.col("said"), F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return each.groupBy("said").agg(F.sum("n").alias("n"), rate("quality").alias("quality_accuracy"), rate("toxic").alias("toxic_accuracy")).select(F.concat(F.lit("always_"), "said").alias("policy"), "n", "quality_accuracy", "toxic_accuracy")


@query("""WITH x AS (SELECT n_chars AS s, quality AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id))
SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc, sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives FROM x""")
def q_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.auc(j, [], "n_chars", "quality").withColumn("auc", F.round("auc", 6))


@query("""WITH x AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT DISTINCT s AS cut FROM x), b AS (SELECT cut, (count(*) FILTER (WHERE s >= cut AND y = 1) / (SELECT sum(y) FROM x) + count(*) FILTER (WHERE s < cut AND y = 0) / (SELECT count(*) - sum(y) FROM x)) / 2 AS v FROM c, x GROUP BY cut)
SELECT arg_max(cut, (round(v, 12), -cut))::BIGINT AS cut, round(max(v), 6) AS balanced FROM b""")
def q_best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.balanced_cut(j, "n_chars", "quality").withColumn("balanced", F.round("balanced", 6))


_TOKEN_F1 = r"""t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), ' '), lambda x: x <> '')) AS w FROM conversations),
s AS (SELECT r.conv_id, r.turn, CASE WHEN len(a.w) + len(r.w) = 0 THEN 0.0 ELSE 2 * len(list_intersect(a.w, r.w)) / (len(a.w) + len(r.w)) END AS score FROM t a JOIN t r ON a.conv_id = r.conv_id AND a.turn = 0 AND r.turn > 0)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token F1 of each conversation's turn 0 against its later turns."""
    t = _turns(spark, sf_dir).select("conv_id", "turn", F.array_distinct(F.filter(F.split(X.words_only(F.col("text")), " "), lambda w: w != "")).alias("w"))
    j = t.where("turn > 0").join(t.where("turn = 0").select("conv_id", F.col("w").alias("a")), "conv_id")
    both = F.size("a") + F.size("w")
    return j.select("conv_id", "turn", F.when(both == 0, 0.0).otherwise(2 * F.size(F.array_intersect("a", "w")) / both).alias("score"))


@query(f"WITH {_TOKEN_F1} SELECT conv_id, round(max(score), 6) AS best, arg_max(turn, (round(score, 9), -turn))::BIGINT AS best_turn FROM s GROUP BY conv_id")
def q_best_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.struct(F.round("score", 9).alias("r"), (-F.col("turn")).alias("t"), "score")).alias("b")
    return _scores(spark, sf_dir).groupBy("conv_id").agg(best).select("conv_id", F.round("b.score", 6).alias("best"), (-F.col("b.t")).alias("best_turn"))


@query(f"WITH {_TOKEN_F1}, m AS (SELECT conv_id, max(score) AS every, max(score) FILTER (WHERE turn = 1) AS one, max(score) FILTER (WHERE turn <= 2) AS two, max(score) FILTER (WHERE turn > 1) AS late FROM s GROUP BY conv_id) SELECT count(*)::BIGINT AS n, round(avg(every), 6) AS every, round(avg(one), 6) AS one, round(avg(two), 6) AS two, round(avg(late), 6) AS late FROM m")
def q_reference_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score under four subsets of the references, averaged over conversations."""
    s = F.col("score")
    m = _scores(spark, sf_dir).groupBy("conv_id").agg(F.max(s).alias("every"), F.max(F.when(F.col("turn") == 1, s)).alias("one"), F.max(F.when(F.col("turn") <= 2, s)).alias("two"), F.max(F.when(F.col("turn") > 1, s)).alias("late"))
    return m.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("every", "one", "two", "late")))


@query("""WITH r AS (SELECT d.doc_id, coalesce(l.toxic, 0) AS toxic, row_number() OVER (PARTITION BY coalesce(l.toxic, 0) ORDER BY sha256('cap|' || d.doc_id)) AS r FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id, toxic FROM r WHERE toxic = 1 OR r <= 100""")
def q_protected_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return S.protected_cap(j, F.col("toxic") == 1, draw("cap", F.col("doc_id")), 100)


@query("SELECT quality, toxic, sum(CASE WHEN toxic = 1 THEN 3 ELSE 1 END)::BIGINT AS n FROM labels GROUP BY 1, 2")
def q_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = S.oversample(table(spark, sf_dir, "labels"), F.when(F.col("toxic") == 1, 3).otherwise(1))
    return more.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages""")
def q_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^https?://([^/?#]+)").alias("host"), part("^https?://[^/]+/([a-z]{2})/").alias("lang"), part("/([0-9]+)").alias("number"))
