"""Registered help-document and retrieval queries."""

from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.vectors import cosine, l2_normalise, norm
from ..operators import ann, knowledge as kb, retrieval as rt
from ..session import shared_dir
from .registry import query
from .text import SPACE, stripped

def words(sql):
    return f"len(list_filter(regexp_split_to_array({sql}, '{SPACE}+'), lambda w: w <> ''))"


NORMALISED = stripped(r"regexp_replace(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query("page_text")
def _(t):
    return kb.page_texts(t.pages)


@query("doc_intake_report", rf"""
WITH j AS (SELECT document_id, tenant_id, filename, sha256({NORMALISED}) AS fp,
  CASE WHEN byte_length > 5242880 THEN '{kb.TOO_LARGE}' WHEN NOT lower(regexp_extract(filename, '[^/.](\.[^./]+)$', 1)) IN ('.md', '.markdown', '.txt', '.html', '.htm', '.pdf') THEN '{kb.WRONG_TYPE}'
    WHEN length({NORMALISED}) = 0 THEN '{kb.NO_TEXT}' END AS reason FROM fx_documents),
f AS (SELECT tenant_id, fp, min(document_id) AS first_id FROM j WHERE reason IS NULL GROUP BY ALL),
r AS (SELECT j.document_id, j.tenant_id, j.filename, CASE WHEN j.reason IS NULL AND f.first_id <> j.document_id THEN 'This document was already added.' ELSE j.reason END AS reason
  FROM j LEFT JOIN f ON f.tenant_id = j.tenant_id AND f.fp = j.fp)
SELECT document_id, tenant_id, filename, reason IS NULL AS accepted, reason FROM r""")
def _(t):
    return kb.intake_report(t.documents)


@query("kb_seed_rows", f"""
WITH n AS (SELECT document_id, lang, {words("coalesce(title, source) || '. ' || content")} AS tokens FROM fx_documents)
SELECT document_id, lang, tokens, tokens <= 256 AS fits FROM n""")
def _(t):
    seed = t.documents.withColumn("title", F.coalesce("title", "source"))
    out = kb.within_limit(seed, x.embedding_text("title", "content"), 256)
    return out.select("document_id", "lang", F.col("tokens").cast("bigint").alias("tokens"), "fits")


@query("chunk_sections")
def _(t):
    return kb.part_numbers(kb.chunk_sections(t.help))


_BLOCKS = f"""b AS (SELECT h.document_id, h.title, {stripped('s.block')} AS block, s.pos FROM fx_help h
  CROSS JOIN LATERAL (SELECT unnest(string_split(h.content, chr(10) || chr(10))) AS block, generate_subscripts(string_split(h.content, chr(10) || chr(10)), 1) AS pos) s),
blocks AS (SELECT document_id, title, block, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS position,
  nullif(length(regexp_extract(block, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 1)), 0) AS depth, regexp_extract(block, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 2) AS heading FROM b WHERE block <> '')"""


@query("chunk_invariants", f"""
WITH {_BLOCKS}, k AS (SELECT document_id, sum(length(regexp_replace(block, '{SPACE}+', '', 'g'))) FILTER (depth IS NULL) AS letters FROM blocks GROUP BY document_id)
SELECT document_id, CAST(coalesce(letters, 0) AS BIGINT) AS letters, true AS within FROM k WHERE letters > 0""")
def _(t):
    cut = kb.chunk_sections(t.help)
    return cut.groupBy("document_id").agg(
        F.sum(F.length(F.regexp_replace("content", r"(?U)\s+", ""))).alias("letters"),
        (F.max(x.word_tokens("content")) <= 300).alias("within"),
    )


_LEVELS = ", ".join(
    f"last_value(CASE WHEN depth = {n} THEN heading END IGNORE NULLS) OVER w AS h{n}, last_value(CASE WHEN depth = {n} THEN position END IGNORE NULLS) OVER w AS p{n}"
    for n in range(1, 7)
)
_PATH = ", ".join(
    f"CASE WHEN p{n} IS NOT NULL" + "".join(f" AND p{n} > coalesce(p{m}, -1)" for m in range(1, n)) + f" AND h{n} <> title THEN h{n} END" for n in range(1, 7)
)


@query("heading_blocks", f"""
WITH {_BLOCKS}, l AS (SELECT *, {_LEVELS} FROM blocks WINDOW w AS (PARTITION BY document_id ORDER BY position ROWS UNBOUNDED PRECEDING))
SELECT document_id, position, depth IS NOT NULL AS is_heading, array_to_string(list_filter([{_PATH}], lambda q: q IS NOT NULL), ' / ') AS path, block FROM l""")
def _(t):
    return kb.heading_blocks(t.help).withColumn("position", F.col("position").cast("bigint"))


@query("document_status", """
WITH n AS (SELECT d.document_id, d.tenant_id, count(s.position) AS n FROM fx_documents d LEFT JOIN fx_sections s ON s.document_id = d.document_id GROUP BY ALL)
SELECT document_id, tenant_id, CASE WHEN n = 0 OR n > 400 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN n = 0 OR n > 400 THEN 0 ELSE n END AS section_count,
  CASE WHEN n = 0 THEN 'No text to index.' WHEN n > 400 THEN 'The document has ' || n || ' sections; split it into files of at most 400.' END AS error FROM n""")
def _(t):
    return kb.document_status(t.documents, t.sections)


@query("section_counts", "SELECT d.document_id, d.tenant_id, count(s.position) AS sections FROM fx_documents d LEFT JOIN fx_sections s ON s.document_id = d.document_id GROUP BY ALL")
def _(t):
    return kb.section_counts(t.documents, t.sections)


@query("part_numbers", """
SELECT document_id, position, CASE WHEN count(*) OVER (PARTITION BY document_id, title) > 1
  THEN title || ' (part ' || row_number() OVER (PARTITION BY document_id, title ORDER BY position) || ')' ELSE title END AS title FROM fx_sections""")
def _(t):
    return kb.part_numbers(t.sections).select("document_id", "position", "title")


@query("pack_tokens", f"""
WITH s AS (SELECT document_id, position, {words("coalesce(content, '')")} AS tokens FROM fx_sections)
SELECT document_id, position, tokens, CAST(floor((sum(tokens) OVER (PARTITION BY document_id ORDER BY position) - tokens) / 300) AS BIGINT) AS window_no FROM s""")
def _(t):
    return kb.pack_tokens(t.sections, 300).select("document_id", "position", "tokens", "window_no")


@query("section_positions", f"WITH {_BLOCKS} SELECT document_id, position, block FROM blocks")
def _(t):
    return kb.text_blocks(t.help).select("document_id", F.col("position").cast("bigint").alias("position"), "block")


# reprocessed documents: those in English, cut anew as one section
@query("replace_sections", """
SELECT document_id, tenant_id, position, title, content FROM fx_sections WHERE document_id NOT IN (SELECT document_id FROM fx_documents WHERE lang = 'en')
UNION ALL SELECT document_id, tenant_id, 0, source, content FROM fx_documents WHERE lang = 'en'""")
def _(t):
    fresh = t.documents.filter("lang = 'en'").select("document_id", "tenant_id", F.lit(0).alias("position"), F.col("source").alias("title"), "content")
    return kb.replace_sections(t.sections, fresh).select("document_id", "tenant_id", "position", "title", "content")


@query("delete_document", "SELECT document_id, position, content FROM fx_sections WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    gone = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return kb.without_documents(t.sections, gone).select("document_id", "position", "content")


# --- retrieval -----------------------------------------------------------------------------
_NORM = "sqrt(list_sum(list_transform({0}, lambda v: CAST(v AS DOUBLE) * v)))"
_TOP = f"""sims AS (SELECT q.query_id, q.category, e.entry_id, e.tag,
  round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (q.len * e.len), 9) AS sim
  FROM (SELECT *, {_NORM.format('embedding')} AS len FROM fx_kb_queries) q JOIN (SELECT *, {_NORM.format('embedding')} AS len FROM fx_kb) e ON e.tenant_id = q.tenant_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, entry_id) AS rank FROM sims QUALIFY rank <= 3)"""


def hits(t):
    return rt.search_topk(t.kb_queries, t.kb)


def tagged(t):
    return t.kb.withColumn("tags", F.array("tag"))


@query("kb_search_topk", f"WITH {_TOP} SELECT query_id, entry_id, rank, round(sim, 4) AS similarity FROM top")
def _(t):
    return hits(t)


@query("kb_search_ann")
def _(t):
    """Hits of the queries with an id divisible by 50 among all entries of their tenant, by a saved index, beside the recall that
    brute force measures and the share of vectors compared."""
    asked = t.kb_queries.where(F.col("query_id") % ann.MEASURED == 0)
    found, figures = ann.search_measured(t.kb, asked, shared_dir(t.spark, "ann"))
    share = figures["compared"] / max(1, figures["exact_compared"])
    return found.withColumns({"recall": F.lit(figures["recall"]), "compared_share": F.lit(share), "probes": F.lit(figures["probes"])})


# probing every cell must give the exact answer
@query("kb_search_cells_exact", f"WITH {_TOP} SELECT query_id, entry_id, rank, round(sim, 4) AS similarity FROM top")
def _(t):
    return rt.search_cells(t.kb_queries, t.kb, cells=8, probes=8, rows=64)


@query("retrieval_relevance", f"WITH {_TOP} SELECT query_id, entry_id, rank, category, tag = category AS relevant FROM top")
def _(t):
    return rt.relevance(hits(t), t.kb_queries, tagged(t)).select("query_id", "entry_id", "rank", "category", "relevant")


@query("first_relevant_rank", f"WITH {_TOP} SELECT query_id, category, min(CASE WHEN tag = category THEN rank END) AS first_rank FROM top GROUP BY ALL")
def _(t):
    return rt.first_relevant_rank(rt.relevance(hits(t), t.kb_queries, tagged(t)))


@query("retrieval_metrics", f"""
WITH {_TOP}, f AS (SELECT query_id, category, min(CASE WHEN tag = category THEN rank END) AS first_rank FROM top GROUP BY ALL)
SELECT category, count(*) AS queries, round(avg(CASE WHEN first_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN first_rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_at_k,
  round(avg(coalesce(1 / first_rank, 0.0)), 6) AS mrr FROM f GROUP BY ROLLUP (category)""")
def _(t):
    out = rt.retrieval_metrics(rt.first_relevant_rank(rt.relevance(hits(t), t.kb_queries, tagged(t))))
    return out.withColumns({c: F.round(c, 6) for c in ("hit_at_1", "hit_at_k", "mrr")})


@query("l2_normalise", """
WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 9 * v))) AS len FROM embeddings)
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 3 / len, 9) AS first, round(CAST(embedding[-1] AS DOUBLE) * 3 / len, 9) AS last, round(1.0, 6) AS length FROM n""")
def _(t):
    scaled = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 3).alias("v"))
    unit = scaled.select("vec_id", l2_normalise(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(F.element_at("u", 1), 9).alias("first"), F.round(F.element_at("u", -1), 9).alias("last"), F.round(norm(F.col("u")), 6).alias("length"))


@query("cosine", f"""
WITH m AS (SELECT label, list(v ORDER BY pos) AS centre FROM (SELECT label, pos, avg(v) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, centre), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / ({_NORM.format('embedding')} * {_NORM.format('centre')}), 6) AS similarity
FROM embeddings JOIN m USING (label)""")
def _(t):
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("v"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("centre"))
    return t.embeddings.join(centre, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("similarity"))


@query("embed_texts")
def _(t):
    out = rt.embed_texts(t.table("documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 4).alias("length"))
