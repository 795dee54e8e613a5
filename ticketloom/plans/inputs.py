"""The operators' input tables, derived from the driver's parquet tables.

One SQL text per table serves both engines: ``{name}`` is a driver table and ``{each a c 0,1}``
repeats a row for each listed value. Values are arithmetic on keys, so every branch of the
operators occurs: no category yet, undecided, missing order, another tenant's customer, one or
two runs, failed steps, reviewed, pending and absent drafts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

PHRASES = (
    "Does the kettle come with a warranty?",
    "My blender arrived cracked.",
    "I need this sorted out today or I am filing a chargeback.",
    "THIS IS RIDICULOUS, WHERE IS IT",
    "My package is late!!",
    "Nothing urgent, just wanted to update my email preferences.",
    "The outlet feels warm to the touch.",
    "My UPS tracking says it was handed to USPS.",
    "Where is my order",
    "That refund was my rent money and I am upset.",
    "There is a charge I did not make on my account.",
    "My refund went to a closed account.",
    "This is the third time I have asked and it is still bad.",
    "What the hell is this terrible horrible awful mess",
    "I am fed up, your service is useless.",
    "My patience has run out after being a loyal customer.",
    "I hate it, awful, terrible, horrible and sad.",
    "I am frustrated, still waiting for my parcel.",
    "I want a full refund please.",
    "The tracking has not updated and there is no movement.",
    "My discount code did not work at checkout.",
    "Can you look into what happened?",
    "This is a bad and sad experience.",
    "No rush, I love it, but the urgent parcel is a terrible awful horrible idea.",
    "Call me on +1 (415) 555-0134 or write to jo.doe@mail.example.com today.",
    "Order 12345 and order 987: please EXCHANGE IT for a LARGER size!!!",
)

_TEMPLATES: dict[str, str] = {
    "fx_tenants": "SELECT r_regionkey AS tenant_id, r_name AS name, lower(r_name) AS slug FROM {region}",
    "fx_users": """
SELECT s_suppkey AS user_id, CAST(s_nationkey % 4 AS INT) AS tenant_id, s_name AS name,
  lower(concat(s_name, '@desk.example')) AS email, s_acctbal > 1000 AS is_active FROM {supplier}""",
    "fx_customers": """
SELECT c_custkey AS customer_id, CAST(c_nationkey % 4 AS INT) AS tenant_id, c_name AS name,
  lower(concat(c_mktsegment, '.', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(20)), '@example.com')) AS email
FROM {customer}""",
    "fx_orders": """
SELECT s.order_id, s.tenant_id, s.customer_id, s.item_name, s.status, s.amount, s.order_date,
  CASE WHEN s.status IN ('processing', 'cancelled') AND s.priority <> '5-LOW' THEN NULL
       WHEN s.priority = '1-URGENT' AND s.status = 'delayed' THEN NULL
       ELSE concat('1Z', lpad(CAST(s.order_id AS VARCHAR(20)), 16, '0')) END AS tracking_number,
  CASE WHEN s.status = 'cancelled' AND s.priority <> '4-NOT SPECIFIED' THEN NULL
       ELSE s.order_date + INTERVAL '5' DAY END AS expected_delivery
FROM (SELECT o.o_orderkey AS order_id, CAST(c.c_nationkey % 4 AS INT) AS tenant_id, o.o_custkey AS customer_id,
  concat('Item ', o.o_orderpriority) AS item_name, o.o_orderpriority AS priority,
  CASE WHEN o.o_orderkey % 10 = 0 THEN 'cancelled' WHEN o.o_orderkey % 10 = 1 THEN 'delayed'
       WHEN o.o_orderstatus = 'F' THEN 'delivered' WHEN o.o_orderstatus = 'O' THEN 'shipped' ELSE 'processing' END AS status,
  CAST(floor(o.o_totalprice / 1000) AS DECIMAL(10,2)) AS amount, CAST(o.o_orderdate AS DATE) AS order_date
  FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey) s""",
    "fx_phrases": "SELECT * FROM (VALUES {phrases}) AS t(phrase_id, phrase)",
    "fx_tickets": """
SELECT b.*, CASE WHEN b.corrected_category IS NOT NULL OR b.corrected_urgency IS NOT NULL
    THEN concat('reviewer', CAST(b.ticket_id % 3 AS VARCHAR(4))) END AS corrected_by,
  CASE WHEN b.corrected_category IS NOT NULL OR b.corrected_urgency IS NOT NULL
    THEN b.created_at + INTERVAL '1' DAY END AS corrected_at
FROM (SELECT e.event_id AS ticket_id, CAST(c.c_nationkey % 4 AS INT) AS tenant_id,
  CASE WHEN e.event_id % 13 = 0 THEN e.user_id WHEN e.event_id % 29 = 0 THEN e.event_id + 1000000000
       ELSE o.o_custkey END AS customer_id,
  CASE WHEN e.event_id % 3 = 0 THEN NULL WHEN e.event_id % 17 = 0 THEN e.event_id + 1000000000
       WHEN e.event_id % 23 = 0 THEN e.event_id + 1 ELSE e.event_id END AS order_id,
  concat('Ticket ', e.event_type) AS subject, p.phrase AS body,
  CASE e.event_id % 7 WHEN 0 THEN 'order_status' WHEN 1 THEN 'refund_request' WHEN 2 THEN 'damaged_item'
       WHEN 3 THEN 'delivery_delay' WHEN 4 THEN 'product_question' WHEN 5 THEN 'cancellation' END AS category,
  CASE WHEN e.event_id % 7 = 6 THEN NULL
       ELSE CASE e.event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END END AS urgency,
  CASE WHEN e.event_id % 7 = 6 THEN CASE e.event_type WHEN 'view' THEN 'new' ELSE 'in_progress' END
       WHEN e.event_id % 2 = 0 THEN 'resolved' ELSE 'awaiting_review' END AS status,
  CASE e.event_type WHEN 'signup' THEN 'contact_form' ELSE 'staff' END AS channel,
  CASE WHEN e.event_id % 7 = 6 THEN NULL ELSE e.value > 100 END AS needs_escalation,
  CASE WHEN e.event_id % 19 = 0 AND e.event_id % 7 <> 6 THEN 'cancellation' END AS corrected_category,
  CASE WHEN e.event_id % 11 = 0 AND e.event_id % 7 <> 6 THEN 'high' END AS corrected_urgency,
  e.value AS severity, CAST(e.ts AS TIMESTAMP) AS created_at
  FROM {events} e JOIN {orders} o ON o.o_orderkey = e.event_id
  JOIN {customer} c ON c.c_custkey = o.o_custkey
  JOIN fx_phrases p ON p.phrase_id = e.event_id % {n_phrases}) b""",
    "fx_drafts": """
SELECT t.ticket_id * 2 + k.n AS draft_id, t.tenant_id, t.ticket_id, concat('Draft for ', t.subject) AS draft_text,
  CASE WHEN t.status = 'resolved' AND k.n = 1 THEN TRUE END AS approved,
  CASE WHEN t.status = 'resolved' AND k.n = 1 AND t.severity > 80 THEN 'edited' END AS edited_text,
  CASE WHEN t.status = 'resolved' AND k.n = 1 THEN 'reviewer1' END AS reviewer_id,
  t.created_at + k.n * INTERVAL '1' HOUR AS created_at,
  CASE WHEN t.status = 'resolved' AND k.n = 1
    THEN t.created_at + (90 + CAST(floor(t.severity) AS INT)) * INTERVAL '1' MINUTE END AS reviewed_at
FROM fx_tickets t {each k n 0,1}
WHERE t.category IS NOT NULL AND NOT (t.status = 'awaiting_review' AND t.severity < 20)
  AND (k.n = 0 OR t.status = 'resolved' OR t.severity < 60)""",
    "fx_predictions": """
SELECT t.ticket_id, t.tenant_id, m.model_name, concat('v', CAST(k.n AS VARCHAR(4))) AS model_version,
  CASE m.model_name WHEN 'category_classifier' THEN t.category ELSE t.urgency END AS prediction,
  t.created_at + k.n * INTERVAL '1' MINUTE AS created_at,
  CAST((t.ticket_id * 37 + k.n * 11) % 100 AS DOUBLE) / 100 AS confidence
FROM fx_tickets t {each m model_name 'category_classifier','urgency_classifier'} {each k n 1,2}
WHERE t.category IS NOT NULL""",
    "fx_agent_logs": """
SELECT t.ticket_id * 100 + r.n * 10 + s.step AS log_id, t.tenant_id, t.ticket_id,
  CASE s.step WHEN 1 THEN 'triage' WHEN 2 THEN 'knowledge' WHEN 3 THEN 'order_lookup' WHEN 4 THEN 'draft' ELSE 'escalation' END AS agent_name,
  CASE
    WHEN s.step = 4 AND t.severity > 400 THEN '{"error": "DraftError: no provider could draft a reply"}'
    WHEN s.step = 1 THEN concat('{"category": {"label": "', coalesce(t.category, 'order_status'), '", "confidence": 0.', CAST(10 + t.ticket_id % 90 AS VARCHAR(4)),
      '}, "urgency": {"label": "', coalesce(t.urgency, 'low'), '", "confidence": 0.', CAST(10 + t.ticket_id * 7 % 90 AS VARCHAR(4)), '}}')
    WHEN s.step = 2 THEN CASE t.ticket_id % 4 WHEN 0 THEN '{"retrieved": []}'
      WHEN 1 THEN '{"retrieved": [{"id": "1", "title": "Returns", "similarity": 0.71}]}'
      ELSE '{"retrieved": [{"id": "1", "title": "Returns", "similarity": 0.71}, {"id": "2", "title": "Delivery", "similarity": 0.64}]}' END
    WHEN s.step = 3 THEN CASE t.ticket_id % 17 WHEN 0 THEN '{"result": "no order found"}'
      ELSE '{"result": {"item_name": "Mug", "status": "shipped"}}' END
    WHEN s.step = 4 THEN concat('{"draft_text": "Hello", "mode": "', CASE WHEN t.severity < 10 THEN 'offline' ELSE 'hosted' END,
      '", "model": "m', CAST(t.tenant_id AS VARCHAR(4)), '", "usage": {"input_tokens": ', CAST(100 + t.ticket_id % 50 AS VARCHAR(6)),
      ', "output_tokens": ', CAST(20 + t.ticket_id % 30 AS VARCHAR(6)), '}, "attempts": [',
      CASE t.tenant_id WHEN 0 THEN '{"provider": "first", "skipped": "not allowed for this tenant"}, ' WHEN 1 THEN '{"provider": "first", "error": "timeout"}, ' ELSE '' END,
      '{"provider": "second", "ok": "drafted"}]}')
    ELSE concat('{"decision": {"needs_escalation": ', CASE WHEN t.needs_escalation THEN 'true' ELSE 'false' END,
      ', "reason": null}, "rules_fired": []}') END AS output,
  CAST((t.ticket_id * 13 + s.step * 7) % 900 AS INT) AS duration_ms,
  t.created_at + (r.n * 10 + s.step) * INTERVAL '1' MINUTE AS created_at
FROM fx_tickets t {each r n 0,1} {each s step 1,2,3,4,5}
WHERE (r.n = 0 OR t.severity < 40) AND (s.step <> 3 OR t.order_id IS NOT NULL) AND (s.step <> 5 OR t.severity <= 400)
  AND NOT (t.status = 'new') AND (t.status <> 'in_progress' OR s.step <= 3 OR t.severity < 20)""",
    "fx_documents": """
SELECT doc_id AS document_id, CAST(doc_id % 4 AS INT) AS tenant_id, lang, source,
  CASE WHEN lang = 'en' THEN concat(source, ' guide') END AS title, text AS content,
  concat(source, '_', lang, '-', CAST(doc_id AS VARCHAR(20)), CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.html' ELSE '.docx' END) AS filename,
  n_chars * 300 AS byte_length FROM {documents}""",
    "fx_sections": """
SELECT d.document_id, d.tenant_id, CAST(s.pos AS INT) AS position, concat(d.lang, ' ', d.source) AS title, s.line AS content
FROM fx_documents d {lines s d.content}""",
    "fx_help": """
SELECT d.document_id, d.tenant_id, concat(d.lang, ' ', d.source) AS title, {markdown d.content} AS content FROM fx_documents d""",
    "fx_kb": """
SELECT vec_id AS entry_id, CAST(vec_id % 4 AS INT) AS tenant_id, concat('Entry ', CAST(vec_id AS VARCHAR(20))) AS title,
  label AS tag, embedding FROM {embeddings}""",
    "fx_kb_queries": "SELECT vec_id AS query_id, CAST((vec_id + 1) % 4 AS INT) AS tenant_id, label AS category, embedding FROM {embeddings}",
    "fx_scored": """
SELECT e.vec_id AS row_id, k.version, CASE e.label % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS y_true,
  CASE WHEN (k.version = 'v1' AND e.vec_id % 4 = 0) OR (k.version = 'v2' AND e.vec_id % 9 = 0)
    THEN CASE (e.label + 1) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END
    ELSE CASE e.label % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END END AS y_pred,
  CAST(e.vec_id * 29 % 100 AS DOUBLE) / 100 AS confidence
FROM {embeddings} e {each k version 'v1','v2'}""",
    "fx_proba": """
SELECT row_id, y_true, a / (a + b + c) AS p_low, b / (a + b + c) AS p_medium, c / (a + b + c) AS p_high
FROM (SELECT vec_id AS row_id, CASE label % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS y_true,
  abs(CAST(embedding{1} AS DOUBLE)) + 0.01 AS a, abs(CAST(embedding{2} AS DOUBLE)) + 0.01 AS b, abs(CAST(embedding{3} AS DOUBLE)) + 0.01 AS c
  FROM {embeddings}) v""",
    "fx_corpus": """
SELECT doc_id AS row_id, text, lang AS category, source, concat(lang, ':', source) AS grp FROM {documents}""",
    "fx_attempts": """
SELECT event_id AS attempt_id, CAST(user_id AS VARCHAR(20)) AS visitor, CAST(user_id % 4 AS VARCHAR(4)) AS business,
  CAST(ts AS TIMESTAMP) AS ts FROM {events}""",
    "fx_requests": """
SELECT conv_id * 100 + turn AS request_id, CAST(conv_id % 4 AS INT) AS tenant_id, concat('  Visitor ', CAST(conv_id AS VARCHAR(20)), ' ') AS name,
  CASE WHEN conv_id % 9 = 4 THEN 'no address' WHEN conv_id % 9 = 5 THEN ' padded@mail.example'
       ELSE concat('User', CAST(conv_id % 50 AS VARCHAR(20)), '@Mail.Example') END AS email,
  concat(' About turn ', CAST(turn AS VARCHAR(20)), ' ') AS subject, text AS message,
  CASE WHEN conv_id % 7 = 3 THEN 'http://spam.example' ELSE '' END AS website
FROM {conversations} WHERE role = 'user'""",
    "fx_eval": """
SELECT 'bench' AS eval_set, text FROM {benchmark} UNION ALL SELECT 'system', text FROM {conversations} WHERE role = 'system'
UNION ALL SELECT 'fresh', concat('  ', upper(phrase), ' ') FROM fx_phrases WHERE phrase LIKE 'My%' OR phrase LIKE 'Where%'
UNION ALL SELECT 'fresh', concat('ticket   view ', phrase) FROM fx_phrases WHERE phrase LIKE 'Can%'""",
}


def _render(template: str, engine: str, path: str = "") -> str:
    def each(m: re.Match) -> str:
        alias, column, values = m.group(1), m.group(2), m.group(3)
        if engine == "spark":
            return f"LATERAL VIEW explode(array({values})) {alias} AS {column}"
        return f"CROSS JOIN unnest([{values}]) AS {alias}({column})"

    def lines(m: re.Match) -> str:
        alias, column = m.group(1), m.group(2)
        if engine == "spark":
            return f"LATERAL VIEW posexplode(split({column}, '\\n')) {alias} AS pos, line"
        return (
            f"CROSS JOIN LATERAL (SELECT unnest(string_split({column}, chr(10))) AS line, "
            f"generate_subscripts(string_split({column}, chr(10)), 1) - 1 AS pos) AS {alias}"
        )

    def markdown(m: re.Match) -> str:
        # lines under 60 characters become headings, so documents have a heading structure
        column, mark = m.group(1), "CASE WHEN length(x) BETWEEN 1 AND 30 THEN concat('# ', x) WHEN length(x) BETWEEN 31 AND 60 THEN concat('## ', x) ELSE x END"
        if engine == "spark":
            return f"array_join(transform(split({column}, '\\n'), x -> {mark}), '\\n\\n')"
        return f"array_to_string(list_transform(string_split({column}, chr(10)), lambda x: {mark}), chr(10) || chr(10))"

    text = re.sub(r"\{each (\w+) (\w+) ([^}]*)\}", each, template)
    text = re.sub(r"\{lines (\w+) ([\w.]+)\}", lines, text)
    text = re.sub(r"\{markdown ([\w.]+)\}", markdown, text)
    text = re.sub(r"\{(\d)\}", lambda m: f"[{int(m.group(1)) - (engine == 'spark')}]", text)
    rows = ",".join("({}, '{}')".format(i, p.replace("'", "''")) for i, p in enumerate(PHRASES))
    text = text.replace("{phrases}", rows).replace("{n_phrases}", str(len(PHRASES)))
    for table in DRIVER_TABLES:
        text = text.replace("{" + table + "}", f"parquet.`{path}/{table}.parquet`" if engine == "spark" else table)
    return text.strip()


SQL_VIEWS: dict[str, str] = {name: _render(t, "duckdb") for name, t in _TEMPLATES.items()}


class Inputs:
    """Lazy frames over one scale-factor folder; each attribute is one input table."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = _render(_TEMPLATES[name], "spark", self.sf_dir)
        needed = [v for v in _TEMPLATES if re.search(rf"\b{v}\b", text)]
        return self.spark.sql(self._with(text) if needed else text)

    def _with(self, text: str) -> str:
        order: list[str] = []

        def need(sql: str) -> None:
            for v in _TEMPLATES:
                if v not in order and re.search(rf"\b{v}\b", sql):
                    need(_render(_TEMPLATES[v], "spark", self.sf_dir))
                    if v not in order:
                        order.append(v)

        need(text)
        ctes = ", ".join(f"{v} AS ({_render(_TEMPLATES[v], 'spark', self.sf_dir)})" for v in order)
        return f"WITH {ctes} {text}"

    def streaming(self, name: str, table: str, stream: DataFrame) -> DataFrame:
        """The input table with one driver table replaced by a stream of it."""
        view = f"stream_of_{table}"
        stream.createOrReplaceTempView(view)
        text = _render(_TEMPLATES[name], "spark", self.sf_dir)
        needed = any(re.search(rf"\b{v}\b", text) for v in _TEMPLATES)
        sql = self._with(text) if needed else text
        return self.spark.sql(sql.replace(f"parquet.`{self.sf_dir}/{table}.parquet`", view))

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in _TEMPLATES:
            frame = self.view(f"fx_{name}")
            self.__dict__[name] = frame
            return frame
        if name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)
