"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, gru_lm, html_text, language, packing, quality, resampling, secret_scan, simhash, spelling, token_files, toxicity
from .common import fold, table


def language_model(docs: DataFrame) -> language.Model:
    """Fitted on the rows that are not held out."""
    rows = docs.where(fold("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), "text", "lang")
    return language.fit(rows)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language_model(docs))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("class"))
    return quality.judge(docs, quality.fit(docs, labels), "id").withColumnRenamed("id", "doc_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(kinds: list[str] | None = None):
        spans = F.filter("spans", lambda s: s["kind"].isin(kinds)) if kinds else F.col("spans")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = [r.kind for r in secret_scan.BASE]
    kinds = F.transform("spans", lambda s: s["kind"])
    number = [F.size(F.array_remove(kinds, k)) for k in base]
    number = [(F.size(kinds) - n).cast("long").alias(f"n_{k}") for n, k in zip(number, base)]
    return found.select(F.col("id").alias("doc_id"), *number, F.sha2(joined(base), 256).alias("base_sha256"), joined().alias("spans"))


def _secret_sql() -> str:
    """Matches and the texts between them give the positions."""
    quoted = [r.pattern.replace("'", "''") for r in secret_scan.RULES]
    per_kind = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}') AS found, "
        f"regexp_extract_all(t, '{p}', {r.group}) AS value, regexp_split_to_array(t, '{p}') AS parts FROM d"
        for k, (r, p) in enumerate(zip(secret_scan.RULES, quoted))
    )
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({per_kind}),
        u AS (SELECT doc_id, k, kind, least, unnest(found) AS found, unnest(value) AS value, unnest(parts[1:len(found)]) AS part, unnest(range(len(found))) AS i FROM m WHERE len(found) > 0),
        p AS (SELECT *, sum(length(part) + length(found)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM u),
        s AS (SELECT doc_id, k, kind, (stop - length(found))::BIGINT AS start, kind || ':' || (stop - length(found))::BIGINT || ':' || stop::BIGINT AS span FROM p WHERE length(value) >= least),
        a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                     string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (doc_id)
    """


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("class"))
    model = toxicity.fit(docs, labels.where(fold("id", 3) != 1))
    found = toxicity.toxicity(docs, model, "id")
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return found.select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "score", predicted)


def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (fold("doc_id", 7) == 2).alias("held"), "text")
    found = gru_lm.score(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.main_text(pages, html_text.Weights(html_text.count(pages)))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    found = resampling.resample(docs, target)
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_files.read(token_files.write(docs, public_tokenizers.path("word_bpe_49k.json")))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crcs)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_sql(text: str) -> str:
    """Checksum of a text's UTF-8 bytes, by the table `crcs`."""
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)))"


def _resampling_sql() -> str:
    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH k AS {_CRC_TABLE},
        w AS (SELECT 's' AS side, row_number() OVER () AS r, {words} AS w FROM documents UNION ALL SELECT 't', -row_number() OVER (), {words} FROM benchmark),
        o AS (SELECT doc_id, row_number() OVER () AS r FROM documents),
        f AS (SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
        b AS (SELECT f, {_crc_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), k),
        c AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN b USING (f) GROUP BY bucket),
        a AS (SELECT sum(s)::DOUBLE + 10000 AS s, sum(t)::DOUBLE + 10000 AS t FROM c),
        g AS (SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * a.s / ((c.s + 1)::DOUBLE * a.t)))::BIGINT AS gain FROM c, a),
        d AS (SELECT r, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE side = 's' GROUP BY r),
        e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM o LEFT JOIN d USING (r)),
        p AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
        q AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 39) OVER () AS n FROM p)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND place <= 25 * n // 100 THEN place END AS rank FROM q
    """


def _spelling_sql() -> str:
    h = _crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")
    return rf"""
        WITH RECURSIVE k AS {_CRC_TABLE},
        o AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
        d AS (SELECT doc_id, run, count(*) AS n FROM o GROUP BY ALL),
        h AS (SELECT run, n, {h} AS h FROM d, k),
        x AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
        w AS (SELECT word, sum(n)::BIGINT AS n FROM x WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        v AS (SELECT word, n, word AS key, -1 AS i FROM w UNION ALL SELECT word, n, left(word, i) || substr(word, i + 2), i FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
        p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b USING (key) WHERE a.word <> b.word AND (a.i = b.i OR a.i = -1 OR b.i = -1)),
        t AS (SELECT word, count(*) AS n_near, min_by(struct_pack(near, near_n), (-near_n, near)) AS top FROM p GROUP BY word),
        f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top.near_n >= 2 * n THEN top.near END AS form, CASE WHEN top.near_n >= 2 * n THEN top.near_n END AS form_n FROM w LEFT JOIN t USING (word)),
        r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.next = f.word)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON f.word = r.word AND r.next IS NULL
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_byte_bpe, op4_hilbert_packing, op5_secret_scan, op6_exact_dedup, op7_toxicity, op8_gru_lm, op9_html_text, op10_simhash,
                              op11_target_resampling, op12_wavelet_tokens, op13_spelling_variants)
}

ORACLES: dict[str, str] = {
    "op5_secret_scan": _secret_sql(),
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)
    """,
    "op11_target_resampling": _resampling_sql(),
    "op13_spelling_variants": _spelling_sql(),
}
