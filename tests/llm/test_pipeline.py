import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ticketloom.llm import pipeline_stages as stages
from ticketloom.llm import packing, pipeline_stages, simhash

WORDS = {
    "en": "the quick brown fox jumps over lazy dogs and then it runs through forest with other animals while rain falls on every green tree".split(),
    "de": "der schnelle braune fuchs springt über den faulen hund und dann läuft er durch dunklen wald mit anderen tieren bei starkem regen".split(),
}


def row(i, text, lang="en", source="s", n=None):
    return (i, text, lang, source, len(text or "") if n is None else n, "x")


def rows():
    rng = np.random.default_rng(2)
    out = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        out.append(row(i, " ".join(WORDS[lang][k] + (str(k) if k % 9 == 0 else "") for k in rng.integers(0, 22, 70)), lang))
    out += [row(200, out[5][1]), row(201, out[5][1].replace(" ", "  ")), row(202, out[6][1] + " end"), row(203, None), row(204, ""), row(205, "12 34 !!")]
    out += [row(206, out[7][1] + " token = abcdef123"), row(207, "the rain " * 20_000), row(5, out[5][1]), row(None, out[9][1]), row(None, None)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


def plain(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_stages_keep_columns_and_clean_rows(spark, docs, tmp_path):
    stage_in, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "secret_scans", "packing"]
    before = Counter(r.doc_id for r in docs.collect())
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, stage_in, "")
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        stage_in = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = Counter(r.doc_id for r in stage_in.collect())
    assert before - seen["language_id"] == Counter({203: 1, 204: 1, 205: 1, None: 1})
    gone = seen["language_id"] - seen["exact_dedup"]
    # of texts 5, 200, 201 and a repeated 5 the longest original stays; of 9 and a row without id the row with one
    assert gone == Counter({5: 2, 200: 1, None: 1})
    assert all(seen["simhash_near_dedup"][i] == 1 for i in range(120) if i not in (5, 6, 7))
    assert seen["secret_scans"] == seen["simhash_near_dedup"]
    texts = {r.doc_id: r for r in stage_in.collect()}
    if 206 in texts:
        assert "abcdef123" not in texts[206].text and texts[206].n_chars == len(texts[206].text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, stage_in, "").collect()
    own = packing.tokenizer(*(lambda P: (P.path("byte_bpe_50k.json"), P.PATTERN))(__import__("public_tokenizers")))
    assert sum(p.length for p in pieces) == sum(len(own.encode(r.text)) for r in texts.values())
    assert all(zlib.crc32(bytes(p.ids)) == zlib.crc32(own.encode(texts[p.doc_id].text)[p.start : p.start + p.length].tobytes()) for p in pieces)


def test_one_of_each_group(spark):
    base = " ".join(f"w{k}" for k in range(300))
    given = [row(3, base), row(1, base + " x"), row(7, base), row(7, base), row(None, base), row(None, "alone here now"), row(None, "some other words"), row(9, None), row(8, "")]
    out = simhash.one_of_each(spark.createDataFrame(given, SCHEMA)).collect()
    assert Counter(r.doc_id for r in out) == Counter({1: 1, None: 2, 8: 1})
    assert next(r for r in out if r.doc_id == 1).text == base + " x"


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_run_is_the_stages_in_turn(spark, tmp_path, docs):
    docs.drop("kept").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    step = docs.drop("kept")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, step, "").write.parquet(f"{tmp_path}/{k}")
        step = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted((r.doc_id, r.doc_tokens) for r in out.select("doc_id", "doc_tokens").distinct().collect()) == sorted(
        (r.doc_id, r.doc_tokens) for r in pipeline_stages.packed(spark, step, "").select("doc_id", "doc_tokens").distinct().collect()
    )


def test_columns_named_like_a_result_keep_their_values(spark):
    rows = [(1, "a b", "yes", -1, "x"), (2, "ab", "no", -2, None), (3, "c", None, -3, "z"), (4, None, "q", 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, group_size int, keep_id string")
    out = stages.first_copies(spark, docs, "")
    assert out.schema == docs.schema and sorted(map(tuple, out.collect())) == [rows[0], rows[2], rows[3]]
