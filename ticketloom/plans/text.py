"""Registered text, rule and escalation queries."""

from pyspark.sql import functions as F

from ..functions import rules, sentiment, text as x
from ..functions.tone import with_tone
from ..operators import tickets as k
from ..operators.scale import newest
from ..schema import ORDER_STATUSES
from .registry import query

# RE2 spells the Unicode classes out
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def squeezed(sql):
    return f"trim(regexp_replace({sql}, '{SPACE}+', ' ', 'g'))"


def stripped(sql):
    return f"regexp_replace({sql}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def normalized(sql):
    return rf"regexp_replace(lower({sql}), '\p{{Nd}}+', '0', 'g')"


TEXTS = "texts AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT conv_id * 1000 + turn + 1000000000, text FROM conversations)"


def texts(t):
    """All document texts and conversation turns."""
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn") + 1000000000).alias("id"), "text")
    return t.table("documents").select(F.col("doc_id").alias("id"), "text").unionByName(turns)


def messages(t):
    return t.tickets.withColumn("text", x.ticket_text())


MESSAGES = "messages AS (SELECT *, subject || chr(10) || body AS text FROM fx_tickets)"


@query("normalize_text", f"WITH {TEXTS} SELECT id, {normalized('text')} AS out FROM texts")
def _(t):
    return texts(t).select("id", x.normalize_text("text").alias("out"))


@query("leak_key", f"WITH {TEXTS} SELECT id, lower({squeezed('text')}) AS out FROM texts")
def _(t):
    return texts(t).select("id", x.leak_key("text").alias("out"))


SKELETON = squeezed("regexp_replace(" + normalized("text") + ", '[[:punct:]]', '', 'g')")


@query("skeleton", f"WITH {TEXTS} SELECT id, {SKELETON} AS out FROM texts")
def _(t):
    return texts(t).select("id", x.skeleton("text").alias("out"))


@query("dedupe_key", f"WITH {TEXTS} SELECT id, regexp_replace(lower(text), '^[[:punct:] ]+|[[:punct:] ]+$', '', 'g') AS out FROM texts")
def _(t):
    return texts(t).select("id", x.dedupe_key("text").alias("out"))


_WORDS = "regexp_extract_all(text, '[A-Za-z]{3,}')"
_CAPS = f"coalesce(len(list_filter({_WORDS}, lambda w: w = upper(w))) / nullif(len({_WORDS}), 0), 0)"


@query("caps_ratio", f"WITH {TEXTS} SELECT id, CAST({_CAPS} AS DOUBLE) AS out FROM texts")
def _(t):
    return texts(t).select("id", x.caps_ratio("text").alias("out"))


_LEX = "MAP {" + ", ".join(f"'{w}': {v!r}::DOUBLE" for w, v in sentiment.LEXICON.items()) + "}"
_SENT = f"""v AS (SELECT *, list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: coalesce(lex[w], 0.0)) AS v FROM (SELECT *, {_LEX} AS lex FROM messages)),
s AS (SELECT *, coalesce(list_sum(v), 0.0) AS total, coalesce(list_sum(list_transform(list_filter(v, lambda a: a > 0), lambda a: a + 1)), 0.0) AS p,
  coalesce(list_sum(list_transform(list_filter(v, lambda a: a < 0), lambda a: 1 - a)), 0.0) AS n, len(list_filter(v, lambda a: a = 0)) AS u FROM v),
sent AS (SELECT *, round(total / sqrt(total * total + 15.0), 4) AS compound, round(coalesce(n / nullif(p + n + u, 0), 0.0), 3) AS neg,
  round(coalesce(p / nullif(p + n + u, 0), 0.0), 3) AS pos, round(coalesce(u / nullif(p + n + u, 0), 0.0), 3) AS neu FROM s)"""


@query("lexicon_sentiment", f"WITH {MESSAGES}, {_SENT} SELECT ticket_id, neg, neu, pos, compound FROM sent")
def _(t):
    return sentiment.with_sentiment(messages(t).select("ticket_id", "text")).select("ticket_id", "neg", "neu", "pos", "compound")


@query("lexicon_table_sentiment", f"WITH {MESSAGES}, {_SENT} SELECT ticket_id, compound FROM sent")
def _(t):
    lexicon = t.spark.createDataFrame(list(sentiment.LEXICON.items()), "token string, valence double")
    return sentiment.sentiment_by_lexicon(messages(t), "ticket_id", lexicon)


@query("tone_features", f"""
WITH {MESSAGES}, {_SENT}
SELECT ticket_id, compound, neg, pos, round(CAST({_CAPS} AS DOUBLE), 6) AS caps_ratio, least(length(text) - length(replace(text, '!', '')), 5) AS exclamations,
  least(length(text) - length(replace(text, '?', '')), 5) AS questions, round(ln(1 + length(text)), 6) AS log_length FROM sent""")
def _(t):
    out = with_tone(messages(t).select("ticket_id", "text")).drop("text")
    return out.withColumns({c: F.round(c, 6) for c in ("caps_ratio", "log_length")})


@query("mask_emails", rf"""
WITH {TEXTS} SELECT id, regexp_replace(text, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)+', '[email]', 'g') AS out FROM texts""")
def _(t):
    return texts(t).select("id", x.mask_emails("text").alias("out"))


@query("mask_contact")
def _(t):
    both = texts(t).unionByName(messages(t).select((F.col("ticket_id") + 2000000000).alias("id"), "text"))
    return both.select("id", x.mask_contact("text").alias("out"))


@query("content_fingerprint", f"WITH {TEXTS} SELECT id, sha256(text) AS out FROM texts")
def _(t):
    return texts(t).select("id", x.content_fingerprint("text").alias("out"))


@query("embedding_text", f"""
SELECT document_id, title || '. ' || content AS entry, '{x.QUERY_PREFIX}' || content AS query FROM fx_sections""")
def _(t):
    return t.sections.select("document_id", x.embedding_text("title", "content").alias("entry"), x.query_text("content").alias("query"))


@query("doc_title", r"""
WITH s AS (SELECT d.document_id, d.title, h.content, regexp_replace(d.filename, '([^.])\.[^.]+$', '\1') AS stem FROM fx_documents d JOIN fx_help h USING (document_id))
SELECT document_id, left(coalesce(nullif(trim(title), ''), nullif(trim(regexp_extract(content, '^#\s+(.+)', 1)), ''), nullif(trim(translate(stem, '_-', '  ')), ''), 'Untitled'), 200) AS title FROM s""")
def _(t):
    both = t.documents.select("document_id", "title", "filename").join(t.help.select("document_id", F.col("content").alias("body")), "document_id")
    return both.select("document_id", x.doc_title("title", "body", "filename").alias("title"))


@query("text_decode_normalise", rf"""
WITH {TEXTS}, raw AS (SELECT id, replace(text, chr(10), '  ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)) AS text FROM texts)
SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{SPACE}+|{SPACE}+$', '', 'g') AS out FROM raw""")
def _(t):
    raw = texts(t).select("id", F.replace("text", F.lit("\n"), F.lit("  \r\n\n\n\n")).alias("text"))
    return raw.select("id", x.normalise_document("text").alias("out"))


@query("human_duration", """
WITH v AS (SELECT event_id, value * value * 10 AS s, value / 490.0 AS r, CAST(floor(value * 20) AS BIGINT) AS ms FROM events),
h AS (SELECT *, CAST(floor(s / 60 / 60 * 10 + 0.5) AS BIGINT) AS h10, CAST(floor(s / 60 / 60 / 24 * 10 + 0.5) AS BIGINT) AS d10, CAST(floor(ms / 1000 * 10 + 0.5) AS BIGINT) AS s10 FROM v)
SELECT event_id, CASE WHEN s < 60 THEN CAST(floor(s + 0.5) AS BIGINT) || 's' WHEN s / 60 < 60 THEN CAST(floor(s / 60 + 0.5) AS BIGINT) || ' min'
  WHEN s / 60 / 60 < 10 THEN (h10 // 10) || '.' || (h10 % 10) || ' h' WHEN s / 60 / 60 < 48 THEN CAST(floor(s / 60 / 60 + 0.5) AS BIGINT) || ' h'
  ELSE (d10 // 10) || '.' || (d10 % 10) || ' days' END AS duration, CAST(floor(r * 100 + 0.5) AS BIGINT) || '%' AS percent,
  CASE WHEN ms < 1000 THEN ms || ' ms' ELSE (s10 // 10) || '.' || (s10 % 10) || ' s' END AS millis FROM h""")
def _(t):
    v = F.col("value")
    return t.events.select(
        "event_id", x.human_duration(v * v * 10).alias("duration"), x.human_percent(v / 490.0).alias("percent"),
        x.human_millis(F.floor(v * 20)).alias("millis"),
    )


_SLOTTED = "Order {{Order Number}} of {{Person Name}}, {{Currency Symbol}}{{Refund Amount}} {{Nothing Known}}: "
_PEOPLE = ["Sam", "Priya", "Jordan", "Maria"]


@query("fill_placeholders", f"""
WITH k AS (SELECT ticket_id, body, md5(CAST(ticket_id AS VARCHAR)) AS h FROM fx_tickets)
SELECT ticket_id, 'Order ORD' || ticket_id || ' of ' || list_extract(['Sam', 'Priya', 'Jordan', 'Maria'], CAST(1 + CAST('0x' || left(h, 8) AS BIGINT) % 4 AS INT))
  || ', $' || (15 + ticket_id % 486) || ' : ' || body AS text FROM k""")
def _(t):
    key = F.md5(F.col("ticket_id").cast("string").cast("binary"))
    values = {
        "Order Number": F.concat(F.lit("ORD"), F.col("ticket_id").cast("string")),
        "Person Name": x.pick(_PEOPLE, key),
        "Currency Symbol": F.lit("$"),
        "Refund Amount": (F.col("ticket_id") % 486 + 15).cast("string"),
    }
    return t.tickets.select("ticket_id", x.fill_placeholders(F.concat(F.lit(_SLOTTED), "body"), values).alias("text"))


@query("too_long_entries", rf"""
WITH n AS (SELECT document_id, len(list_filter(regexp_split_to_array(coalesce(title, '') || '. ' || content, '{SPACE}+'), lambda w: w <> '')) AS tokens FROM fx_documents)
SELECT document_id, tokens FROM n WHERE tokens > 256""")
def _(t):
    entry = x.embedding_text(F.coalesce("title", F.lit("")), "content")
    return t.documents.select("document_id", x.word_tokens(entry).cast("bigint").alias("tokens")).filter("tokens > 256")


# --- rules ---------------------------------------------------------------------------------


def _sql_condition(name, pattern):
    if pattern is not None:
        return "regexp_matches(text, '(?i)" + pattern.replace("'", "''") + "')"
    return {
        "shouting": "len(loud) >= 2 AND (len(loud) / len(words) >= 0.3 OR len(list_filter(loud, lambda w: length(w) >= 4)) >= 2)",
        "exclamation_burst": "contains(text, '!!') OR length(text) - length(replace(text, '!', '')) >= 3",
        "very_negative": "compound <= -0.75",
        "negative_sentiment": "compound > -0.75 AND compound <= -0.4",
    }[name]


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_FIRED = f"""{MESSAGES}, {_SENT},
w AS (SELECT *, {_WORDS} AS words, list_filter({_WORDS}, lambda w: w = upper(w) AND NOT list_contains({_sql_list(rules.NOT_SHOUTED)}, w)) AS loud FROM sent),
f AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_sql_condition(n, p)} THEN '{n}' END" for n, _, _, p in rules.RULES)}], lambda r: r IS NOT NULL) AS fired FROM w),
vt AS (SELECT *, CASE WHEN list_contains(fired, 'calm_language') THEN list_filter(fired, lambda r: NOT list_contains({_sql_list(rules.CANCELLED_BY_CALM)}, r)) ELSE fired END AS votes FROM f),
c AS (SELECT *, list_filter(votes, lambda r: list_contains({_sql_list(rules.STRONG)}, r)) AS signals,
  len(list_filter(votes, lambda r: list_contains({_sql_list(rules.WEAK_HIGH)}, r))) AS weak, len(list_filter(votes, lambda r: list_contains({_sql_list(rules.MEDIUM)}, r))) AS med FROM vt),
labelled AS (SELECT *, CASE WHEN len(signals) > 0 OR weak >= 2 OR (weak >= 1 AND med > 0) THEN 'high' WHEN weak >= 1 OR med > 0 THEN 'medium' ELSE 'low' END AS weak_label FROM c)"""


def labelled(t):
    return rules.with_rules(messages(t))


@query("rules_fired", f"WITH {_FIRED} SELECT ticket_id, array_to_string(fired, ',') AS fired FROM labelled")
def _(t):
    return labelled(t).select("ticket_id", F.array_join("fired", ",").alias("fired"))


@query("weak_label", f"WITH {_FIRED} SELECT ticket_id, weak_label FROM labelled")
def _(t):
    return labelled(t).select("ticket_id", "weak_label")


THREADS = """messages AS (SELECT c.conv_id * 100 + c.turn AS message_id, coalesce(t.body || chr(10), '') || c.text AS text
  FROM conversations c LEFT JOIN fx_tickets t ON t.ticket_id = c.conv_id * 10 + c.turn)"""


@query("thread_rules", f"WITH {_FIRED.replace(MESSAGES, THREADS)} SELECT message_id, array_to_string(fired, ',') AS fired, array_to_string(signals, ',') AS signals, weak_label FROM labelled")
def _(t):
    """The rules over every whole turn of the conversations, after the body of the ticket that its key names, if there is one."""
    turns = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), (F.col("conv_id") * 10 + F.col("turn")).alias("ticket_id"), F.col("text").alias("turn_text"))
    text = F.concat(F.coalesce(F.concat("body", F.lit("\n")), F.lit("")), "turn_text")
    met = turns.join(t.tickets.select("ticket_id", "body"), "ticket_id", "left").select("message_id", text.alias("text"))
    return rules.with_rules(met).select("message_id", F.array_join("fired", ",").alias("fired"), F.array_join("signals", ",").alias("signals"), "weak_label")


@query("strong_signals", f"WITH {_FIRED} SELECT ticket_id, array_to_string(signals, ',') AS signals FROM labelled")
def _(t):
    return labelled(t).select("ticket_id", F.array_join("signals", ",").alias("signals"))


_CONF = """cat AS (SELECT ticket_id, confidence FROM fx_predictions WHERE model_name = 'category_classifier' QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC) = 1),
urg AS (SELECT ticket_id, confidence FROM fx_predictions WHERE model_name = 'urgency_classifier' QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC) = 1)"""
_REASONS = f"""{_FIRED}, {_CONF},
e AS (SELECT l.ticket_id, l.tenant_id, l.category, l.urgency, l.signals, cat.confidence AS cc, urg.confidence AS uc, CAST(o.amount AS DOUBLE) AS amount
  FROM labelled l LEFT JOIN cat USING (ticket_id) LEFT JOIN urg USING (ticket_id) LEFT JOIN fx_orders o ON o.tenant_id = l.tenant_id AND o.order_id = l.order_id),
r AS (SELECT *, list_filter([
  CASE WHEN urgency = 'high' THEN 'Urgency classified high (confidence ' || coalesce(printf('%.2f', uc), 'n/a') || ')' END,
  CASE WHEN cc < 0.6 THEN 'Low category confidence (' || printf('%.2f', cc) || ' < 0.6)' END,
  CASE WHEN uc < 0.6 THEN 'Low urgency confidence (' || printf('%.2f', uc) || ' < 0.6)' END,
  CASE WHEN category = 'refund_request' AND amount > 100 THEN 'Refund request on a $' || printf('%.2f', amount) || ' order (over $100)' END,
  CASE WHEN urgency IS DISTINCT FROM 'high' AND len(signals) > 0 THEN 'Strong urgency signal in the text: ' || array_to_string(signals, ', ') END], lambda q: q IS NOT NULL) AS reasons FROM e)"""


def newest_confidences(t):
    """The newest confidence of each classifier per ticket."""
    latest = newest(t.predictions, ["ticket_id", "model_name"], ["created_at", "model_version"], ["confidence"])
    return latest.groupBy("ticket_id").agg(
        F.max(F.when(F.col("model_name") == "category_classifier", F.col("confidence"))).alias("category_confidence"),
        F.max(F.when(F.col("model_name") == "urgency_classifier", F.col("confidence"))).alias("urgency_confidence"),
    )


def escalation_inputs(t):
    """Tickets with rules, the newest confidences and the amount of the linked order."""
    return k.with_order(labelled(t), t.orders).withColumn("order_amount", F.col("amount").cast("double")).join(newest_confidences(t), "ticket_id", "left")


@query("escalation_reasons", f"WITH {_REASONS} SELECT ticket_id, CAST(i AS BIGINT) AS position, reasons[i] AS reason FROM r, unnest(generate_series(1, len(reasons))) AS u(i)")
def _(t):
    out = escalation_inputs(t).withColumn("reasons", rules.escalation_reasons())
    return out.select("ticket_id", F.posexplode("reasons").alias("position", "reason")).withColumn("position", F.col("position").cast("bigint") + 1)


@query("escalation_decision", f"""
WITH {_REASONS} SELECT ticket_id, len(reasons) > 0 AS needs_escalation, nullif(array_to_string(reasons, '; '), '') AS escalation_reason FROM r""")
def _(t):
    return rules.with_decision(escalation_inputs(t).drop("needs_escalation")).select("ticket_id", "needs_escalation", "escalation_reason")


@query("lf_coverage", f"""
WITH {_FIRED}, n AS (SELECT unnest({_sql_list((*rules.RULE_NAMES, 'none'))}) AS rule)
SELECT n.rule, count(l.ticket_id) AS n, count(l.ticket_id) / (SELECT count(*) FROM labelled) AS share
FROM n LEFT JOIN labelled l ON CASE WHEN n.rule = 'none' THEN len(l.fired) = 0 ELSE list_contains(l.fired, n.rule) END GROUP BY n.rule""")
def _(t):
    return rules.rule_coverage(labelled(t))


@query("weak_label_distribution", f"WITH {_FIRED} SELECT weak_label AS label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM labelled GROUP BY weak_label")
def _(t):
    return rules.label_distribution(labelled(t))


@query("rule_conflicts", f"""
WITH {_FIRED} SELECT a.rule, b.other, count(*) AS n FROM labelled, unnest(fired) AS a(rule), unnest(fired) AS b(other) GROUP BY ALL""")
def _(t):
    return rules.rule_conflicts(labelled(t))


_VOTES = " ".join(f"WHEN '{n}' THEN '{v}'" for n, v, _, _ in rules.RULES)


@query("rule_precision", f"""
WITH {_FIRED} SELECT rule, count(*) AS fires, count(*) FILTER (urgency = CASE rule {_VOTES} END) AS agreed, count(*) FILTER (urgency = CASE rule {_VOTES} END) / count(*) AS precision
FROM labelled, unnest(fired) AS a(rule) GROUP BY rule""")
def _(t):
    return rules.rule_precision(labelled(t), "urgency")
