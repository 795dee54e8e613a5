"""Registered corpus-building queries."""

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import corpus as c
from ..operators.scale import oldest
from ..session import shared_dir
from ..sources import writers
from .registry import query
from .text import SKELETON

_FIRSTS = f"(SELECT row_id FROM (SELECT *, {SKELETON} AS k FROM fx_corpus) QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_id) = 1)"


@query("dedupe_groups", f"SELECT row_id, text, category, source FROM fx_corpus WHERE row_id IN {_FIRSTS}")
def _(t):
    return c.dedupe_groups(t.corpus, x.skeleton("text")).select("row_id", "text", "category", "source")


@query("dedupe_text", "SELECT row_id, text FROM fx_corpus QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1")
def _(t):
    return c.dedupe_text(t.corpus).select("row_id", "text")


@query("balanced_weights", """
SELECT row_id, category, round(count(*) OVER () / ((SELECT count(DISTINCT category) FROM fx_corpus) * count(*) OVER (PARTITION BY category)), 9) AS weight FROM fx_corpus""")
def _(t):
    return c.balanced_weights(t.corpus.select("row_id", "category")).withColumn("weight", F.round("weight", 9))


_SPLIT = """g AS (SELECT category, grp, count(*) AS size, md5('42|' || grp) AS h FROM fx_corpus GROUP BY ALL),
e AS (SELECT category, grp, sum(size) OVER (PARTITION BY category ORDER BY h, grp ROWS UNBOUNDED PRECEDING) / sum(size) OVER (PARTITION BY category) AS share FROM g),
split AS (SELECT f.*, CASE WHEN e.share <= 0.15 THEN 'test' WHEN e.share <= 0.3 THEN 'val' ELSE 'train' END AS split FROM fx_corpus f JOIN e USING (category, grp))"""


def split(t):
    return c.grouped_split(t.corpus.select("row_id", "category", "source", "grp"))


@query("grouped_split", f"WITH {_SPLIT} SELECT row_id, category, source, grp, split FROM split")
def _(t):
    return split(t).select("row_id", "category", "source", "grp", "split")


# a split by row, blind to groups: the check must find every group it divides
@query("split_leak_check", """
WITH f AS (SELECT grp, (row_number() OVER (PARTITION BY category ORDER BY md5('42|' || row_id), row_id) - 1) % 5 AS fold FROM fx_corpus)
SELECT grp, count(DISTINCT CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END) AS splits FROM f GROUP BY grp HAVING splits > 1""")
def _(t):
    folds = c.stratified_folds(t.corpus.select("row_id", "category", "grp"), "category")
    return c.split_leaks(folds.withColumn("split", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train")))


@query("grouped_split_leaks", f"WITH {_SPLIT} SELECT grp, count(DISTINCT split) AS splits FROM split GROUP BY grp HAVING count(DISTINCT split) > 1")
def _(t):
    return c.split_leaks(split(t))


@query("dataset_crosstab", f"""
WITH {_SPLIT} SELECT CASE WHEN grouping(category) = 1 THEN 'All' ELSE category END AS category, CASE WHEN grouping(split) = 1 THEN 'All' ELSE split END AS split, count(*) AS n FROM split GROUP BY CUBE (category, split)""")
def _(t):
    return c.crosstab(split(t), "split")


@query("dataset_crosstab_source", """
SELECT CASE WHEN grouping(category) = 1 THEN 'All' ELSE category END AS category, CASE WHEN grouping(source) = 1 THEN 'All' ELSE source END AS source, count(*) AS n FROM fx_corpus GROUP BY CUBE (category, source)""")
def _(t):
    return c.crosstab(t.corpus, "source")


@query("stratified_folds", "SELECT row_id, category, (row_number() OVER (PARTITION BY category ORDER BY md5('42|' || row_id), row_id) - 1) % 5 AS fold FROM fx_corpus")
def _(t):
    return c.stratified_folds(t.corpus.select("row_id", "category"), "category")


@query("mix_sources", """
WITH a AS (SELECT f.* FROM fx_corpus f WHERE row_id IN (SELECT doc_id FROM labels)), b AS (SELECT f.* FROM fx_corpus f WHERE row_id NOT IN (SELECT doc_id FROM labels)),
key AS (SELECT row_id, regexp_replace(lower(text), '^[[:punct:] ]+|[[:punct:] ]+$', '', 'g') AS key FROM fx_corpus),
ta AS (SELECT a.* FROM a QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('mix|' || row_id), row_id) <= 20),
ub AS (SELECT b.category, k.key, min(b.row_id) AS row_id FROM b JOIN key k USING (row_id) GROUP BY ALL),
ob AS (SELECT u.row_id, u.category, row_number() OVER (PARTITION BY u.category ORDER BY md5('mix|' || u.row_id), u.row_id) AS rank FROM ub u
  WHERE NOT EXISTS (SELECT 1 FROM ta JOIN key k USING (row_id) WHERE ta.category = u.category AND k.key = u.key)),
tb AS (SELECT b.* FROM b JOIN ob USING (row_id) WHERE ob.rank <= 40 - (SELECT count(*) FROM ta WHERE ta.category = b.category))
SELECT row_id, text, category, source, grp FROM ta UNION ALL SELECT row_id, text, category, source, grp FROM tb""")
def _(t):
    marked = t.labels.select(F.col("doc_id").alias("row_id"))
    return c.mix_sources(t.corpus.join(marked, "row_id", "left_semi"), t.corpus.join(marked, "row_id", "left_anti"), per_class=40)


# templates and slot values are parameters of the operators; these few come from the tables' words
_TEMPLATES = [("order_status", 0, "Where is my {item}? I ordered it {days} days ago."), ("order_status", 1, "Has the {item} shipped yet?"),
              ("refund_request", 0, "I want my money back for the {item}."), ("damaged_item", 0, "The {item} arrived broken after {days} days."),
              ("delivery_delay", 0, "My {item} is {days} days late."), ("product_question", 0, "Does the {item} fit?"), ("cancellation", 0, "Please cancel the {item}."),
              ("cancellation", 1, "I changed my mind about the {item}.")]
_SLOTS = {"item": ["kettle", "lamp", "mug", "desk"], "days": ["2", "5", "9"]}
_VALUES = ", ".join("('{}', {}, '{}')".format(a, b, d) for a, b, d in _TEMPLATES)


def hex_mod(sql, n):
    return f"CAST('0x' || left(md5({sql}), 8) AS BIGINT) % {n}"


@query("expand_templates", f"""
WITH tpl AS (SELECT * FROM (VALUES {_VALUES}) v(category, position, template)), n AS (SELECT category, count(*) AS n FROM tpl GROUP BY category),
q AS (SELECT t.ticket_id, t.category, {hex_mod("'gen.template|' || t.ticket_id", 'n.n')} AS position FROM fx_tickets t JOIN n USING (category))
SELECT q.ticket_id AS row_id, replace(replace(p.template, '{{item}}', list_extract(['kettle', 'lamp', 'mug', 'desk'], CAST({hex_mod("'gen.item|' || q.ticket_id", 4)} + 1 AS INT))),
  '{{days}}', list_extract(['2', '5', '9'], CAST({hex_mod("'gen.days|' || q.ticket_id", 3)} + 1 AS INT))) AS text, q.category, 'template' AS source, q.category || ':core' || q.position AS grp
FROM q JOIN tpl p ON p.category = q.category AND p.position = q.position""")
def _(t):
    templates = t.spark.createDataFrame(_TEMPLATES, "category string, position bigint, template string")
    requests = t.tickets.filter("category IS NOT NULL").select(F.col("ticket_id").alias("request_id"), "category")
    return c.expand_templates(requests, templates, _SLOTS)


@query("augment_noise")
def _(t):
    return c.augment_noise(t.corpus.select("row_id", "text"))


_PHRASES = {"calm": ["No rush.", "Take your time."], "medium": ["I am a bit worried.", "It is frustrating."],
            "high": ["I need it today!", "This is urgent."], "stakes": ["It feels warm to the touch.", "I did not make this charge."]}
_WRAP = "CASE level " + " ".join(
    f"WHEN '{lv}' THEN list_extract([{', '.join(repr(p) for p in ps)}], CAST(" + hex_mod(f"'urgency.{lv}|' || k", len(ps)) + " + 1 AS INT))" for lv, ps in _PHRASES.items()
) + " END"


@query("augment_urgency", f"""
WITH v AS (SELECT row_id, text, variant, row_id || '|' || variant AS k FROM (SELECT ticket_id AS row_id, body AS text FROM fx_tickets) CROSS JOIN unnest([1, 2]) u(variant)),
d AS (SELECT *, {hex_mod("'urgency.level|' || k", 100)} AS draw FROM v),
l AS (SELECT *, CASE WHEN draw < 28 THEN 'none' WHEN draw < 42 THEN 'calm' WHEN draw < 70 THEN 'medium' WHEN draw < 88 THEN 'high' ELSE 'stakes' END AS level FROM d)
SELECT row_id, variant, level, CASE WHEN level = 'none' THEN text WHEN {hex_mod("'urgency.side|' || k", 4)} = 0 THEN {_WRAP} || ' ' || rtrim(text) ELSE rtrim(text) || ' ' || {_WRAP} END AS text FROM l""")
def _(t):
    base = t.tickets.select(F.col("ticket_id").alias("row_id"), F.col("body").alias("text"))
    return c.augment_urgency(base, _PHRASES).select("row_id", "variant", "level", "text")


@query("first_of_source", "SELECT source, min(row_id) AS row_id, arg_min(category, row_id) AS category FROM fx_corpus GROUP BY source")
def _(t):
    return oldest(t.corpus, ["source"], ["row_id"], ["row_id", "category"])


@query("dataset_sink", f"WITH {_SPLIT} SELECT split, category, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS letters FROM split GROUP BY ALL")
def _(t):
    path = shared_dir(t.spark, "dataset")
    writers.dataset(c.grouped_split(t.corpus), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("split", "category", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"))


# the second write is refused, a reset of the English rows leaves the other partitions alone
@query("sink_guard", """
SELECT category, count(*) AS n, CAST(sum(CASE category WHEN 'en' THEN 0 ELSE length(text) END) AS BIGINT) AS letters, true AS refused FROM fx_corpus GROUP BY category""")
def _(t):
    path = shared_dir(t.spark, "guard")
    rows = t.corpus.select("row_id", "category", F.length("text").alias("letters"))
    writers.guarded(rows, path, partition_by=("category",))
    try:
        writers.guarded(rows, path, partition_by=("category",))
        refused = False
    except writers.AlreadyExists:
        refused = True
    blank = rows.filter("category = 'en'").withColumn("letters", F.lit(0))
    writers.guarded(blank, path, reset=True, partition_by=("category",))
    back = t.spark.read.schema("row_id bigint, letters int, category string").parquet(path)
    return back.groupBy("category").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"), F.lit(refused).alias("refused"))
