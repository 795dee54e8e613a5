"""Registered evaluation and feedback queries."""

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.vectors import weighted_argmax
from ..operators import evaluate as ev, feedback as fb, leaks
from ..schema import URGENCIES
from ..session import shared_dir
from ..sources import readers, writers
from .registry import query
from .text import SPACE, labelled, messages, squeezed, _FIRED, MESSAGES

CLASSES = list(URGENCIES)
_CLASSES = "(SELECT unnest(['low', 'medium', 'high']) AS class)"


@query("eval_rows", rf"""
WITH r AS (SELECT conv_id, turn, text, lower(regexp_replace(CASE WHEN turn = 3 THEN '  ' ELSE ' ' || upper(role) || chr(9) END, '^{SPACE}+|{SPACE}+$', '', 'g')) AS label FROM conversations)
SELECT conv_id, turn, text, label, label IN ('user', 'assistant') AS known FROM r WHERE label <> ''""")
def _(t):
    raw = t.conversations.select(
        "conv_id", "turn", "text",
        F.when(F.col("turn") == 3, "  ").otherwise(F.concat(F.lit(" "), F.upper("role"), F.lit("\t"))).alias("label"),
    )
    return ev.label_rows(raw, "label", ["user", "assistant"])


_REPORT = f"""m AS (SELECT v.version, c.class, count(*) FILTER (s.y_true = c.class AND s.y_pred = c.class) AS tp, count(*) FILTER (s.y_true = c.class) AS support, count(*) FILTER (s.y_pred = c.class) AS predicted
  FROM (SELECT DISTINCT version FROM fx_scored) v CROSS JOIN {_CLASSES} c JOIN fx_scored s ON s.version = v.version GROUP BY ALL),
p AS (SELECT version, class, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0), 0.0) AS f1, support FROM m)"""


@query("classification_report", f"WITH {_REPORT} SELECT version, class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM p")
def _(t):
    return ev.classification_report(t.scored, CLASSES)


@query("confusion_matrix", f"""
SELECT v.version, a.class AS y_true, b.class AS y_pred, (SELECT count(*) FROM fx_scored s WHERE s.version = v.version AND s.y_true = a.class AND s.y_pred = b.class) AS n
FROM (SELECT DISTINCT version FROM fx_scored) v CROSS JOIN {_CLASSES} a CROSS JOIN {_CLASSES} b""")
def _(t):
    return ev.confusion(t.scored, CLASSES)


_ACC = "acc AS (SELECT version, count(*) AS n, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM fx_scored GROUP BY version)"
_CAL = """cal AS (SELECT version, round(avg(confidence), 4) AS mean_confidence, round(avg(CASE WHEN confidence < 0.6 THEN 1.0 ELSE 0.0 END), 4) AS share_below,
  round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FILTER (confidence >= 0.6), 4) AS accuracy_above, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FILTER (confidence < 0.6), 4) AS accuracy_below
  FROM fx_scored GROUP BY version)"""
_CMP = f"""{_REPORT}, {_ACC}, {_CAL}, cmp AS (SELECT a.*, (SELECT round(avg(f1), 4) FROM p WHERE p.version = a.version) AS macro_f1,
  (SELECT round(recall, 4) FROM p WHERE p.version = a.version AND p.class = 'high') AS last_recall, c.* EXCLUDE (version) FROM acc a JOIN cal c USING (version))"""


@query("accuracy_macro_f1", f"WITH {_CMP} SELECT version, n, accuracy, macro_f1 FROM cmp")
def _(t):
    return ev.accuracy_macro_f1(t.scored, CLASSES)


@query("confidence_calibration", f"WITH {_CAL} SELECT * FROM cal")
def _(t):
    return ev.calibration(t.scored)


@query("model_compare", f"WITH {_CMP} SELECT * FROM cmp")
def _(t):
    return ev.compare_versions(t.scored, CLASSES)


@query("promotion_gate", f"""
WITH {_CMP} SELECT version, macro_f1, (SELECT macro_f1 FROM cmp WHERE version = 'v1') AS served_f1, last_recall,
  CASE WHEN macro_f1 <= (SELECT macro_f1 FROM cmp WHERE version = 'v1') THEN 'not better than the served version' WHEN last_recall < 0.85 THEN 'recall of the last class too low' ELSE 'promote' END AS decision
FROM cmp WHERE version <> 'v1'""")
def _(t):
    return ev.promotion(ev.compare_versions(t.scored, CLASSES), "v1")


@query("rules_as_model", f"""
WITH {_FIRED}, sc AS (SELECT urgency AS y_true, weak_label AS y_pred FROM labelled WHERE urgency IS NOT NULL),
m AS (SELECT c.class, count(*) FILTER (sc.y_true = c.class AND sc.y_pred = c.class) AS tp, count(*) FILTER (sc.y_true = c.class) AS support, count(*) FILTER (sc.y_pred = c.class) AS predicted FROM {_CLASSES} c CROSS JOIN sc GROUP BY c.class)
SELECT 'rules' AS version, class, round(coalesce(tp / nullif(predicted, 0), 0.0), 4) AS precision, round(coalesce(tp / nullif(support, 0), 0.0), 4) AS recall,
  round(coalesce(2 * tp / nullif(predicted + support, 0), 0.0), 4) AS f1, support FROM m""")
def _(t):
    scored = labelled(t).filter("urgency IS NOT NULL").select(F.lit("rules").alias("version"), F.col("urgency").alias("y_true"), F.col("weak_label").alias("y_pred"))
    return ev.classification_report(scored, CLASSES)


@query("error_samples", f"""
WITH {_FIRED}, sc AS (SELECT ticket_id AS row_id, replace(replace(text, '|', '/'), chr(10), ' ') AS text, urgency AS y_true, weak_label AS y_pred FROM labelled)
SELECT row_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS text, y_true, y_pred FROM sc WHERE y_true <> y_pred ORDER BY row_id LIMIT 20""")
def _(t):
    scored = labelled(t).select(F.col("ticket_id").alias("row_id"), "text", F.col("urgency").alias("y_true"), F.col("weak_label").alias("y_pred"), F.lit(1.0).alias("confidence"))
    return ev.error_samples(scored, 20, 40).drop("confidence")


_SCALED = "(SELECT *, p_low AS a, p_medium * 1.25 AS b, p_high * 2.0 AS c FROM fx_proba)"


@query("weighted_argmax", f"""
SELECT row_id, CASE WHEN a >= b AND a >= c THEN 'low' WHEN b >= c THEN 'medium' ELSE 'high' END AS label,
  round(CASE WHEN a >= b AND a >= c THEN p_low WHEN b >= c THEN p_medium ELSE p_high END, 9) AS confidence FROM {_SCALED}""")
def _(t):
    best = weighted_argmax(F.array("p_low", "p_medium", "p_high"), CLASSES, F.array(F.lit(1.0), F.lit(1.25), F.lit(2.0)))
    return t.proba.select("row_id", best.alias("best")).select("row_id", "best.label", F.round("best.confidence", 9).alias("confidence"))


_GRID = ", ".join(str(w) for w in ev.WEIGHT_GRID)


@query("tune_class_weights", f"""
WITH g AS (SELECT row_number() OVER (ORDER BY i, j) AS setting, wm, wh FROM (SELECT unnest([{_GRID}]::DOUBLE[]) AS wm, generate_subscripts([{_GRID}], 1) AS i) x CROSS JOIN (SELECT unnest([{_GRID}]::DOUBLE[]) AS wh, generate_subscripts([{_GRID}], 1) AS j) y),
s AS (SELECT setting, wm, wh, y_true, CASE WHEN p_low >= p_medium * wm AND p_low >= p_high * wh THEN 'low' WHEN p_medium * wm >= p_high * wh THEN 'medium' ELSE 'high' END AS y_pred FROM fx_proba CROSS JOIN g),
m AS (SELECT setting, wm, wh, c.class, count(*) FILTER (y_true = class AND y_pred = class) AS tp, count(*) FILTER (y_true = class) AS support, count(*) FILTER (y_pred = class) AS predicted FROM s CROSS JOIN {_CLASSES} c GROUP BY ALL),
f AS (SELECT setting, wm, wh, avg(coalesce(2 * tp / nullif(predicted + support, 0), 0.0)) AS f1, max(coalesce(tp / nullif(support, 0), 0.0)) FILTER (class = 'high') AS recall FROM m GROUP BY ALL)
SELECT '1.0,' || wm || ',' || wh AS weights, recall >= 0.4 AS feasible, CASE WHEN recall >= 0.4 THEN round(f1, 4) ELSE 0.0 END AS macro_f1, round(recall, 4) AS last_recall FROM f
ORDER BY feasible DESC, macro_f1 DESC, last_recall DESC, abs(wm - 1) + abs(wh - 1), setting LIMIT 1""")
def _(t):
    proba = t.proba.select("y_true", F.array("p_low", "p_medium", "p_high").alias("proba"))
    best = ev.tune_weights(proba, CLASSES, min_last_recall=0.4)
    return best.withColumn("weights", F.array_join(F.col("weights").cast("array<string>"), ","))


# --- feedback ------------------------------------------------------------------------------
_KEYS = f"keys AS (SELECT DISTINCT lower({squeezed('text')}) AS key FROM fx_eval)"


def keys(t):
    sets = [t.eval.filter(F.col("eval_set") == s) for s in ("bench", "system", "fresh")]
    return fb.eval_keys(*sets)


@query("eval_text_set", f"WITH {_KEYS} SELECT key FROM keys")
def _(t):
    return keys(t)


@query("eval_leak_rows", f"""
WITH {_KEYS}, {MESSAGES}, rows AS (SELECT ticket_id AS row_id, lower({squeezed('text')}) AS a, lower({squeezed('body')}) AS b FROM messages
  UNION ALL SELECT doc_id + 1000000000, lower({squeezed('text')}), '' FROM documents UNION ALL SELECT conv_id * 1000 + turn + 2000000000, lower({squeezed('text')}), '' FROM conversations)
SELECT row_id FROM rows WHERE a IN (SELECT key FROM keys) OR b IN (SELECT key FROM keys)""")
def _(t):
    rows = messages(t).select(F.col("ticket_id").alias("row_id"), "text", "body")
    docs = t.table("documents").select((F.col("doc_id") + 1000000000).alias("row_id"), "text", F.lit("").alias("body"))
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn") + 2000000000).alias("row_id"), "text", F.lit("").alias("body"))
    return fb.leak_rows(rows.unionByName(docs).unionByName(turns), keys(t), "text", "body")

_PASSAGES = f"""words AS (SELECT doc_id AS row_id, string_split(lower({squeezed('text')}), ' ') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT item_id, string_split(lower({squeezed('text')}), ' ') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 7], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 6)) AS k FROM item_words)),
starts AS (SELECT row_id, k - 1 AS place, array_to_string(w[k:k + 7], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 6)) AS k FROM words)),
met AS (SELECT row_id, item_id, place, gram, place - row_number() OVER (PARTITION BY row_id, item_id ORDER BY place) AS island FROM starts JOIN windows USING (gram)),
runs AS (SELECT row_id, item_id, min(place) || ':' || (count(*) + 7) AS span, min(place) AS place FROM met GROUP BY row_id, item_id, island),
spans AS (SELECT row_id, item_id, string_agg(span, ',' ORDER BY place) AS spans FROM runs GROUP BY ALL),
passages AS (SELECT row_id, item_id, spans, shared, n AS windows, shared / n AS share FROM spans JOIN (SELECT row_id, item_id, count(DISTINCT gram) AS shared FROM met GROUP BY ALL) s USING (row_id, item_id)
  JOIN (SELECT item_id, count(*) AS n FROM windows GROUP BY ALL) n USING (item_id))"""


def _documents(t):
    return t.table("documents").withColumnRenamed("doc_id", "row_id")


@query("eval_leak_fuzzy", f"WITH {_PASSAGES} SELECT row_id, item_id, spans, shared, windows, round(share, 6) AS share FROM passages")
def _(t):
    return leaks.passages(_documents(t), t.benchmark).withColumn("share", F.round("share", 6))


@query("eval_free_rows", f"WITH {_PASSAGES} SELECT doc_id AS row_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT row_id FROM passages WHERE share >= 0.8)")
def _(t):
    return leaks.without_passages(_documents(t), t.benchmark).select("row_id", "lang", "source")


_EXPORT = f"""{_KEYS}, {MESSAGES}, pred AS (SELECT * FROM fx_predictions QUALIFY row_number() OVER (PARTITION BY ticket_id, model_name ORDER BY created_at DESC, model_version DESC) = 1),
export AS (SELECT CAST(m.ticket_id AS VARCHAR) AS ticket_id, m.tenant_id, m.text, coalesce(m.corrected_category, '') AS category, coalesce(m.corrected_urgency, '') AS urgency,
  coalesce(m.category, '') AS predicted_category, coalesce(m.urgency, '') AS predicted_urgency, coalesce(c.model_version, '') AS category_model_version, coalesce(u.model_version, '') AS urgency_model_version,
  coalesce(m.corrected_by, '') AS corrected_by, coalesce(strftime(m.corrected_at, '%Y-%m-%dT%H:%M:%S.%f+00:00'), '') AS corrected_at
  FROM messages m LEFT JOIN pred c ON c.ticket_id = m.ticket_id AND c.model_name = 'category_classifier' LEFT JOIN pred u ON u.ticket_id = m.ticket_id AND u.model_name = 'urgency_classifier'
  WHERE (m.corrected_category IS NOT NULL OR m.corrected_urgency IS NOT NULL) AND lower({squeezed('m.text')}) NOT IN (SELECT key FROM keys) AND lower({squeezed('m.body')}) NOT IN (SELECT key FROM keys))"""


def export(t):
    return fb.feedback_export(t.tickets, t.predictions, keys(t))


@query("feedback_export", f"WITH {_EXPORT} SELECT * FROM export")
def _(t):
    return export(t)


@query("corrections_manifest", f"""
WITH {_EXPORT} SELECT tenant_id, count(*) AS rows, count(*) FILTER (category <> '') AS category_labels, count(*) FILTER (urgency <> '') AS urgency_labels,
  CAST(sum(CAST('0x' || left(md5(ticket_id || chr(1) || text || chr(1) || category || chr(1) || urgency), 8) AS BIGINT)) AS BIGINT) AS checksum FROM export GROUP BY tenant_id""")
def _(t):
    return fb.manifest(export(t))


@query("feedback_rows", f"WITH {_EXPORT} SELECT text, urgency AS label FROM export WHERE urgency <> ''")
def _(t):
    return fb.feedback_rows(export(t), "urgency")


@query("feedback_backlog", f"""
WITH {_EXPORT}, r AS (SELECT * FROM (VALUES ('category_classifier', 'category', 5), ('urgency_classifier', 'urgency', 1000000)) v(model, label, trained_rows)),
a AS (SELECT label, CASE label WHEN 'category' THEN (SELECT count(*) FROM export WHERE category <> '') ELSE (SELECT count(*) FROM export WHERE urgency <> '') END AS available FROM r)
SELECT r.*, a.available, greatest(a.available - r.trained_rows, 0) AS backlog FROM r JOIN a USING (label)""")
def _(t):
    registry = t.spark.createDataFrame([("category_classifier", "category", 5), ("urgency_classifier", "urgency", 1000000)], "model string, label string, trained_rows bigint")
    return fb.feedback_backlog(export(t), registry)


_POOL = f"""{_EXPORT}, pool AS (SELECT text, role AS label, 'dev' AS source FROM conversations WHERE role = 'user' UNION ALL SELECT text, role, 'holdout' FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT text, role, 'fresh' FROM conversations WHERE role = 'system' UNION ALL SELECT text, urgency, 'feedback' FROM export WHERE urgency <> '')"""


def pool(t):
    role = lambda r: t.conversations.filter(F.col("role") == r).select("text", F.col("role").alias("label"))
    return fb.human_label_pool(dev=role("user"), holdout=role("assistant"), fresh=role("system"), feedback=fb.feedback_rows(export(t), "urgency"))


@query("human_label_pool", f"WITH {_POOL} SELECT * FROM pool")
def _(t):
    return pool(t)


@query("training_rows", f"WITH {_FIRED}, {_EXPORT.replace(MESSAGES + ', ', '')} SELECT text, weak_label AS label, 1.0::DOUBLE AS weight FROM labelled UNION ALL SELECT text, urgency, 30.0 FROM export WHERE urgency <> ''")
def _(t):
    weak = rules.with_rules(messages(t)).select("text", F.col("weak_label").alias("label"))
    return fb.training_rows(weak, fb.feedback_rows(export(t), "urgency"), 30)


@query("corrections_sink", f"WITH {_EXPORT} SELECT tenant_id, count(*) AS rows, count(*) FILTER (category <> '') AS category_labels FROM export GROUP BY tenant_id")
def _(t):
    path = shared_dir(t.spark, "corrections")
    for _version in ("first", "replaced"):
        writers.corrections(export(t), path)
    back = readers.corrections(t.spark, path).join(t.tickets.select(F.col("ticket_id").cast("string").alias("ticket_id"), "tenant_id"), "ticket_id")
    return back.groupBy("tenant_id").agg(F.count("*").alias("rows"), F.count_if(F.col("category") != "").alias("category_labels"))
