import time

from hypothesis import given, settings, strategies as st

from ticketloom.functions import documents as d
from ticketloom.operators import knowledge as kb
from conftest import rows
from pyspark.sql import functions as F

POLICY = "# Returns\n\nSend it back in 30 days.\n\n## Timing\n\nMoney arrives in 5 days.\n\n### Cards\nSlower by a day.\n\n## Damage\n\nSend a photo."


DOCS = "document_id bigint, tenant_id int, title string, content string"


def cut(spark, texts, limit, title="T", **more):
    docs = spark.createDataFrame([(k, 0, title, t) for k, t in enumerate(texts)], DOCS)
    out = {k: [] for k in range(len(texts))}
    for r in kb.chunk_sections(docs, limit, **more).orderBy("document_id", "position").collect():
        assert r["position"] == len(out[r["document_id"]])
        out[r["document_id"]].append((r["title"], r["content"]))
    return out


def test_sections_follow_headings(spark):
    found = cut(spark, [POLICY], 300, "Returns")[0]
    assert [t for t, _ in found] == ["Returns", "Returns: Timing", "Returns: Timing / Cards", "Returns: Damage"]
    assert found[2][1] == "Slower by a day."


def test_page_chrome_is_left_out():
    html = "<html><head><title>Help &amp; more</title><style>p{}</style></head><body><nav>Home</nav><h2>Times</h2><p>We <b>ship</b> fast.</p><ul><li>One<li>Two</ul><script>x()</script><footer>c</footer>"
    assert d.page_text(html) == ("Help & more", "## Times\n\nWe ship fast.\n\nOne\n\nTwo")


def test_a_bad_page_does_not_stop_the_rest(spark):
    df = spark.createDataFrame([(1, "<p>ok"), (2, None)], "page_id bigint, html string")
    out = {r["page_id"]: r for r in kb.page_texts(df).collect()}
    assert out[1]["text"] == "ok" and out[1]["error"] is None
    assert out[2]["text"] is None and out[2]["error"]


def test_open_tags_and_quotes_are_read_once():
    """A page of unclosed tags, quotes or declarations takes time in proportion to its length."""
    for piece in ("<a href=x ", "<a 'x ", '<a "x', "<!x ", "<a \"<a' ", "<script ", "<!-- "):
        for end in ("", ">", '">"', "'>' z"):
            started = time.perf_counter()
            d.page_text(piece * 40_000 + end)
            assert time.perf_counter() - started < 2, (piece, end)
    assert d.page_text("<p>five <x and 3 < 4") == (None, "five <x and 3 < 4")
    assert d.page_text("<p title='a>b' x=\">\">one<br/>two</p> <b") == (None, "one\n\ntwo\n\n<b")
    assert d.page_text("<p a=it's>one</p>two") == (None, "one\n\ntwo")


def test_many_headings_take_time_in_proportion(spark):
    """5,000 headings in one document; its sections are those of the same text cut by hand."""
    text = "\n\n".join(f"{'#' * (1 + k % 3)} H{k}\n\nbody {k}" for k in range(5000))
    started = time.perf_counter()
    out = cut(spark, [text], 300)[0]
    assert time.perf_counter() - started < 20 and len(out) == 5000
    held = {}
    for k, (title, content) in enumerate(out):
        depth = 1 + k % 3
        held = {n: h for n, h in held.items() if n < depth} | {depth: f"H{k}"}
        assert (title, content) == ("T: " + " / ".join(held.values()), f"body {k}")


def test_strip_takes_the_white_space_of_unicode(spark):
    from ticketloom.functions.text import strip

    data = [(k, f"{chr(k)}a{chr(k)}") for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000]
    df = spark.createDataFrame(data, "k int, text string")
    assert df.where(strip("text") != F.regexp_replace("text", r"(?U)^\s+|\s+\z", "")).count() == 0


def test_repeated_titles_are_numbered(spark):
    text = "## Policy\n\n" + " ".join(f"Sentence {i} tells one detail." for i in range(60))
    docs = spark.createDataFrame([(1, 0, "Doc", text)], "document_id bigint, tenant_id int, title string, content string")
    out = kb.part_numbers(kb.chunk_sections(docs, limit=50)).orderBy("position").collect()
    assert len(out) > 3 and out[0]["title"] == "Doc: Policy (part 1)" and out[1]["title"] == "Doc: Policy (part 2)"
    assert all(words(r["content"]) <= 50 for r in out)


def prose(alphabet):
    return st.lists(st.lists(st.text(alphabet=alphabet, min_size=1, max_size=6), max_size=40).map(" ".join), max_size=6)


def examples(strategy, n=150):
    """A fixed batch of generated texts, so that one Spark job tests them all."""
    found = []

    @settings(max_examples=n, deadline=None, database=None, derandomize=True)
    @given(strategy)
    def collect(value):
        found.append("\n\n".join(value))

    collect()
    return found


def words(text):
    return len(text.split())


def test_sections_lose_nothing_and_keep_the_limit(spark):
    for limit in (1, 5, 12):
        texts = examples(prose("abc.!?"))
        for k, out in cut(spark, texts, limit).items():
            assert "".join("".join(c.split()) for _, c in out) == "".join(texts[k].split())
            assert all(0 < words(c) <= limit for _, c in out)


def test_packing_is_greedy(spark):
    text = "one two. three four five. six\n\nseven\n\neight nine ten eleven twelve thirteen. fourteen\n\n# H\n\nend"
    assert cut(spark, [text, "", None], 5) == {
        0: [("T", "one two. three four five."), ("T", "six\n\nseven"), ("T", "eight nine ten eleven twelve"), ("T", "thirteen. fourteen"), ("T: H", "end")], 1: [], 2: [],
    }


def test_another_measure_cuts_long_words(spark):
    letters = lambda c: F.ceil(F.length(c) / 4)
    out = cut(spark, ["x" * 50 + " yy"], 3, count=letters)[0]
    assert "".join(c for _, c in out).replace(" ", "") == "x" * 50 + "yy" and all(-(-len(c) // 4) <= 3 for _, c in out)


def test_malformed_pages_and_files_stop_no_other(spark, tmp_path):
    bad = "<p>a<![foo[x]]>b</p>"
    df = spark.createDataFrame([(1, bad), (2, "<p>fine"), (3, None)], "page_id bigint, html string")
    out = {r["page_id"]: r for r in kb.page_texts(df).collect()}
    assert out[2]["text"] == "fine" and out[1]["error"] is None and out[3]["error"]
    for name, data in (("bad.html", bad.encode()), ("ok.md", b"# Good\n\ntext"), ("big.txt", b"x" * (5 * 1024 * 1024 + 1)), ("no.png", b"x"), ("p.pdf", b"%PDF"), ("e.txt", b" \n")):
        (tmp_path / name).write_bytes(data)
    files = {r["path"].rsplit("/", 1)[1]: r for r in kb.file_texts(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert len(files) == 6 and files["ok.md"]["title"] == "Good" and files["ok.md"]["error"] is None and files["bad.html"]["text"] == "ab"
    assert [files[n]["error"] for n in ("big.txt", "no.png", "p.pdf", "e.txt")] == [kb.TOO_LARGE, kb.WRONG_TYPE, kb.PDF_FILE, kb.NO_TEXT]


def test_intake_report(spark):
    files = [
        (1, 1, "a.md", "Hello", 10), (2, 1, "b.md", "Hello  \n", 10), (3, 2, "c.md", "Hello", 10), (4, 1, "d.png", "x", 10),
        (5, 1, "e.txt", " \n ", 10), (6, 1, "f.md", "big", 6_000_000),
    ]
    df = spark.createDataFrame(files, "document_id bigint, tenant_id int, filename string, content string, byte_length bigint")
    out = {r["document_id"]: r["reason"] for r in kb.intake_report(df).collect()}
    assert out[1] is None and out[3] is None
    assert out[2].startswith("This document") and out[4] == kb.WRONG_TYPE and out[5] == kb.NO_TEXT and out[6] == kb.TOO_LARGE


def test_heading_blocks_agree_with_the_packer(spark):
    docs = spark.createDataFrame([(1, 0, "Returns", POLICY)], "document_id bigint, tenant_id int, title string, content string")
    paths = [r["path"] for r in kb.heading_blocks(docs).orderBy("position").collect() if not r["block"].startswith("# ")]
    assert paths == ["", "Timing", "Timing", "Timing / Cards", "Damage", "Damage"]


def test_status(spark):
    docs = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "document_id bigint, tenant_id int")
    secs = spark.createDataFrame([(1,), (1,), (2,), (2,), (2,)], "document_id bigint")
    assert rows(kb.document_status(docs, secs, most=2), "document_id", "status", "section_count") == [(1, "ready", 2), (2, "failed", 0), (3, "failed", 0)]


def test_windows_of_tokens(spark):
    texts = ["a b c", "", None, "d e f g h", "i", "j k"]
    data = [(1, k, t) for k, t in enumerate(texts)] + [(2, 0, "x " * 9), (2, 1, "y")] + [(3, k, "z") for k in range(2500)]
    out = kb.pack_tokens(spark.createDataFrame(data, "document_id bigint, position int, content string"), 4).collect()
    found = {(r["document_id"], r["position"]): (r["tokens"], r["window_no"]) for r in out}
    assert [found[1, k] for k in range(6)] == [(3, 0), (0, 0), (0, 0), (5, 0), (1, 2), (2, 2)]
    assert found[2, 1] == (1, 2) and all(found[3, k] == (1, k // 4) for k in range(2500))
