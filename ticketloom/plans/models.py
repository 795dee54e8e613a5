"""Registered feature, training, triage and rate-limit queries."""

from pyspark.sql import functions as F

from ..functions.rules import with_rules
from ..operators import features as ft, limits, retrieval as rt, training as tr, triage as tg
from ..operators.corpus import grouped_split
from ..schema import CATEGORIES, MODELS, TOP_K, URGENCIES
from ..session import checkpointed
from .registry import query
from .text import MESSAGES, SPACE, _CONF, _FIRED, _REASONS, messages, newest_confidences, normalized

CLASSES = list(URGENCIES)
#: Places of the registered fits. With the default 2 ** 16 they take minutes at sf0.01 (figures in the README); some of the
#: sentences' 1,700 terms then share a place.
PLACES = 1 << 12
_TOKENS = r"regexp_extract_all(" + normalized("text") + r", '[\p{L}\p{N}_]{2,}')"
_TFIDF = """df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY term HAVING count(*) >= {min_df} {top}),
w AS (SELECT c.doc_id, c.term, (1 + ln(c.tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + d.df)) + 1) AS w FROM counts c JOIN df d USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""
_WORD = f"""tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok UNION ALL SELECT doc_id, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || ' ' || p[2])) FROM tok WHERE len(t) > 1) GROUP BY ALL),
{_TFIDF.format(min_df=2, top='')}"""
_CHAR = f"""words AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array({normalized('text')}, '{SPACE}+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL),
grams AS (SELECT doc_id, n, unnest(flatten(list_transform([3, 4, 5], lambda k: list_transform(generate_series(1, length(word) + 2 - k + 1), lambda i: substr(' ' || word || ' ', i, k))))) AS term FROM words),
counts AS (SELECT doc_id, term, CAST(sum(n) AS BIGINT) AS tf FROM grams GROUP BY ALL),
{_TFIDF.format(min_df=3, top='ORDER BY total DESC, term LIMIT 40000')}"""


def docs(t):
    return t.table("documents").select("doc_id", "text")


@query("tfidf_word", f"WITH {_WORD} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def _(t):
    return ft.tfidf_word(docs(t), "doc_id").withColumn("weight", F.round("weight", 6))


@query("tfidf_char", f"WITH {_CHAR} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def _(t):
    return ft.tfidf_char(docs(t), "doc_id").withColumn("weight", F.round("weight", 6))


def _split(rows):
    """Rows split by group. They are written first, because the split reads them several times, and the split because each set reads it."""
    split = checkpointed(grouped_split(checkpointed(rows.withColumn("category", F.lit("all")), "labelled")).select("row_id", "text", "label", "split"), "split")
    return {s: split.filter(F.col("split") == s).select("row_id", "text", "label") for s in ("train", "val", "test")}


def training_sets(t):
    """Weakly labelled texts split by phrase group."""
    rows = with_rules(messages(t)).select(F.col("ticket_id").alias("row_id"), "text", F.col("weak_label").alias("label"), F.col("body").alias("grp"))
    return _split(rows)


@query("feature_union")
def _(t):
    rows = ft.with_terms(messages(t).select("ticket_id", "text"))
    model = ft.feature_pipeline().fit(rows)
    vector = model.transform(rows).select("ticket_id", F.unwrap_udt("features").alias("v"))
    # a sparse vector states its size; written out, each row would have all places
    filled = F.size(F.filter("v.values", lambda v: v != 0))
    return vector.select("ticket_id", F.coalesce("v.size", F.size("v.values")).alias("dimensions"), filled.alias("filled"))


@query("train_logreg")
def _(t):
    sets = training_sets(t)
    return tr.train_logreg(sets["train"], sets["val"], CLASSES, places=PLACES)[1]


@query("train_trees")
def _(t):
    sets = training_sets(t)
    return tr.train_trees(sets["train"], sets["val"], CLASSES)[1]


@query("top_coefficients")
def _(t):
    sets = training_sets(t)
    model, _ = tr.train_logreg(sets["train"], sets["val"], CLASSES, places=PLACES)
    return t.spark.createDataFrame(tr.top_coefficients(model, sets["train"], CLASSES), "class string, rank int, feature string, coefficient double")


def human_folds(t):
    sets = training_sets(t)
    human = messages(t).filter("corrected_urgency IS NOT NULL OR urgency IS NOT NULL").select(
        F.col("ticket_id").alias("row_id"), "text", F.coalesce("corrected_urgency", "urgency").alias("label")
    )
    return tr.cv_human_weight(sets["train"], human, CLASSES, places=PLACES)


@query("cv_human_weight")
def _(t):
    """Predictions out of fold for every weight; the chosen weight is marked and comes with its tuned class weights."""
    folded = human_folds(t)
    choice = tr.choose_human_weight(folded, CLASSES).first()  # one row
    chosen = F.col("human_weight") == choice["human_weight"]
    tuned = F.when(chosen, F.array(*map(F.lit, choice["weights"])))
    return folded.select("*", chosen.alias("chosen"), tuned.alias("class_weights"))


def category_sets(t):
    """Texts with their category, a reviewer's before the stored one, split by phrase group."""
    rows = messages(t).select(F.col("ticket_id").alias("row_id"), "text", F.coalesce("corrected_category", "category").alias("label"), F.col("body").alias("grp"))
    return _split(rows.filter("label IS NOT NULL"))


@query("batch_triage")
def _(t):
    """Two rows a ticket: its category and its urgency, each by a model of its own; the urgency's class weights are tuned on val."""
    sets, own = training_sets(t), category_sets(t)
    urgency, _ = tr.train_logreg(sets["train"], sets["val"], CLASSES, places=PLACES)
    weights = tr.tuned_weights(urgency, sets["val"], CLASSES)
    category, _ = tr.train_logreg(own["train"], own["val"], list(CATEGORIES), balanced=False, places=PLACES)
    of_category, of_urgency = MODELS
    return tr.triage_predictions(
        messages(t), [tr.Classifier(category, CATEGORIES, of_category, "v2"), tr.Classifier(urgency, CLASSES, of_urgency, "v5", weights)]
    )


# --- triage --------------------------------------------------------------------------------


def given_labels(t):
    """Stored labels with the newest confidences, as the classifiers' output."""
    return t.tickets.select("ticket_id", "category", "urgency").join(newest_confidences(t), "ticket_id", "left")


def ticket_hits(t):
    """A ticket's query vector is the stored embedding that its key names, so queries and entries share one space; each
    distinct (tenant, vector) is searched once and joined back to its tickets."""
    size = t.embeddings.agg(F.count("*")).scalar()
    keyed = t.tickets.select("tenant_id", "ticket_id", (F.col("ticket_id") % size).alias("vec_id")).withColumn("query_id", F.col("vec_id") * 16 + F.col("tenant_id"))
    asked = keyed.select("query_id", "tenant_id", "vec_id").distinct().join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    return keyed.select("ticket_id", "query_id").join(rt.search_topk(asked, t.kb), "query_id").drop("query_id").withColumnRenamed("ticket_id", "query_id")


_LENGTH = "sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v)))"
_HITS = f"""keyed AS (SELECT tenant_id, ticket_id, ticket_id % (SELECT count(*) FROM embeddings) AS vec_id FROM fx_tickets),
asked AS (SELECT tenant_id, vec_id, embedding, {_LENGTH} AS len FROM (SELECT DISTINCT tenant_id, vec_id FROM keyed) JOIN embeddings USING (vec_id)),
hit_sims AS (SELECT a.tenant_id, a.vec_id, e.entry_id, e.title, e.tag,
  round(list_sum(list_transform(list_zip(a.embedding, e.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (a.len * e.len), 9) AS sim
  FROM asked a JOIN (SELECT *, {_LENGTH} AS len FROM fx_kb) e ON e.tenant_id = a.tenant_id),
hit_top AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, vec_id ORDER BY sim DESC, entry_id) AS rank FROM hit_sims QUALIFY rank <= {TOP_K}),
found AS (SELECT k.ticket_id, string_agg(CAST(h.entry_id AS VARCHAR), ',' ORDER BY h.rank) AS entries FROM keyed k JOIN hit_top h ON h.tenant_id = k.tenant_id AND h.vec_id = k.vec_id GROUP BY k.ticket_id)"""
_TRIAGE = """r.tenant_id, r.ticket_id, r.category, r.urgency, l.weak_label, CASE WHEN l.order_id IS NOT NULL THEN CASE WHEN r.amount IS NULL THEN 'no order found' ELSE 'found' END END AS order_result,
  'awaiting_review' AS status, CASE WHEN r.category IS NULL THEN true ELSE len(reasons) > 0 END AS needs_escalation,
  CASE WHEN r.category IS NULL THEN 'Agent pipeline failed (no label); review manually or rerun' ELSE nullif(array_to_string(reasons, '; '), '') END AS escalation_reason"""


@query("ticket_triage_rules", f"WITH {_REASONS} SELECT {_TRIAGE} FROM r JOIN labelled l USING (ticket_id)")
def _(t):
    return tg.triage(t.tickets, given_labels(t), t.orders).drop("entries")


@query("ticket_triage", f"WITH {_REASONS}, {_HITS} SELECT {_TRIAGE}, f.entries FROM r JOIN labelled l USING (ticket_id) LEFT JOIN found f USING (ticket_id)")
def _(t):
    return tg.triage(t.tickets, given_labels(t), t.orders, ticket_hits(t)).withColumn("entries", F.array_join(F.col("entries").cast("array<string>"), ","))


@query("grounded_prompt_rows")
def _(t):
    entries = t.kb.select("entry_id", "title", F.concat(F.lit("Section with tag "), F.col("tag").cast("string")).alias("content"))
    return tg.grounded_prompts(t.tickets, t.orders, ticket_hits(t), entries)


# --- rate limits ---------------------------------------------------------------------------
VISITOR, BUSINESS, SECONDS = 3, 40, 43200


def _walk(name, source, key, limit):
    return f"""{name}_o AS (SELECT attempt_id, {key} AS key, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY {key} ORDER BY ts, attempt_id) AS rn FROM {source}),
{name} AS (SELECT attempt_id, key, rn, at_us, [at_us] AS hits, true AS allowed FROM {name}_o WHERE rn = 1
  UNION ALL SELECT o.attempt_id, o.key, o.rn, o.at_us,
    CASE WHEN len(list_filter(w.hits, lambda h: h > o.at_us - {SECONDS}000000)) < {limit} THEN list_append(list_filter(w.hits, lambda h: h > o.at_us - {SECONDS}000000), o.at_us)
      ELSE list_filter(w.hits, lambda h: h > o.at_us - {SECONDS}000000) END,
    len(list_filter(w.hits, lambda h: h > o.at_us - {SECONDS}000000)) < {limit}
  FROM {name} w JOIN {name}_o o ON o.key = w.key AND o.rn = w.rn + 1)"""


_VISITOR_WALK = _walk("v", "fx_attempts", "business || ':' || visitor", VISITOR)


@query("rate_limit_decisions", f"""
WITH RECURSIVE {_VISITOR_WALK}, pass AS (SELECT a.* FROM fx_attempts a JOIN v USING (attempt_id) WHERE v.allowed), {_walk('b', 'pass', 'business', BUSINESS)}
SELECT attempt_id, 'visitor limit' AS verdict FROM v WHERE NOT allowed UNION ALL SELECT attempt_id, CASE WHEN allowed THEN 'allowed' ELSE 'business limit' END FROM b""")
def _(t):
    return limits.contact_decisions(t.attempts, VISITOR, BUSINESS, SECONDS).select("attempt_id", "verdict")


_LOGINS = "logins AS (SELECT attempt_id, visitor AS email, CAST(attempt_id % 50 AS VARCHAR) AS address, ts FROM fx_attempts)"


@query("login_limit_decisions", f"""
WITH RECURSIVE {_LOGINS}, {_walk('u', 'logins', 'email', 2)}, asked AS (SELECT l.* FROM logins l JOIN u USING (attempt_id) WHERE u.allowed), {_walk('w', 'asked', 'address', 4)}
SELECT attempt_id, 'email limit' AS verdict FROM u WHERE NOT allowed UNION ALL SELECT attempt_id, CASE WHEN allowed THEN 'allowed' ELSE 'address limit' END FROM w""")
def _(t):
    logins = t.attempts.select("attempt_id", F.col("visitor").alias("email"), (F.col("attempt_id") % 50).cast("string").alias("address"), "ts")
    return limits.login_decisions(logins, limit=2, address_times=2, seconds=SECONDS).select("attempt_id", "verdict")


@query("rate_limit_suspects", f"""
WITH c AS (SELECT business AS key, epoch_us(ts) AS at_us, count(*) OVER (PARTITION BY business ORDER BY ts RANGE BETWEEN INTERVAL {SECONDS * 1000000 - 1} MICROSECOND PRECEDING AND CURRENT ROW) AS in_window FROM fx_attempts)
SELECT DISTINCT key, at_us, in_window FROM c WHERE in_window > 60""")
def _(t):
    out = limits.suspects(t.attempts, "business", 60, SECONDS)
    return out.select("key", F.col("at").alias("at_us"), F.col("trailing").alias("in_window"))
