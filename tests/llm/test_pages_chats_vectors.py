"""Operators 4, 6, 8, 9 and 10, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isobar.llm import chat, common, embeddings, htmltext, packing, quality, urls, warc

from . import brute
from .test_documents import check_packing

BODIES = [None, "", "", "a", "a", "x" * 70000, "é" * 20000, "line\r\n\r\n0\r\n\r\nmore", "b" * 16384]


def as_set(rows):
    return Counter(tuple(r) for r in rows)


def test_warc_round_trip(spark):
    rows = [(i, f"http://h.example/{i} ü" if i % 3 else None, b, "x") for i, b in enumerate(BODIES)] + [(4, "http://again", "a", "y"), (20, "u", "x" * 70000, "z"), (20, "u", "x" * 70000, "z"), (None, None, "a", "n"), (None, None, "lone" * 9000, "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    out = warc.read_pages(warc.write_archives(pages)).collect()
    assert len(out) == len(rows)
    last = {}
    for i, _, b, _ in rows:
        if i is not None:
            last[b or ""] = max(i, last.get(b or "", i))
    html = {(i, (b or "").encode()) for i, _, b, _ in rows}
    for r in out:
        assert (r.page_id, bytes(r.payload)) in html
        body = bytes(r.payload).decode()
        assert r.payload_bytes == len(r.payload) and r.payload_digest == warc.base32_sha1(bytes(r.payload))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == last.get(body) else ("revisit", last[body]))
    assert warc.read_pages(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_headers_are_standard(spark):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", "y" * 40000)], "page_id long, url string, html string")
    found = [h for r in warc.write_archives(pages).collect() for h, _ in warc.records(bytes(r.content))]
    by = {(h["warc-type"], h.get("x-page-id")): h for h in found}
    assert ("warcinfo", None) in by and by["revisit", "1"]["warc-refers-to"] == by["response", "2"]["warc-record-id"]
    assert {h["warc-segment-origin-id"] for h in found if h["warc-type"] == "continuation"} == {by["response", "3"]["warc-record-id"]}
    assert len({h["warc-record-id"] for h in found}) == len(found)


def test_warc_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    got = warc.op4_warc(spark, sf_dir)
    assert as_set(got.collect()) == as_set(con.execute(warc.OP4_SQL).fetchall())


def test_warc_missing_segment_raises(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 70000)], "page_id long, url string, html string")
    content = warc.write_archives(pages).first().content
    kept = [warc.record({k.upper(): v for k, v in h.items() if k != "content-length"}, b) for h, b in warc.records(bytes(content)) if h.get("warc-segment-number") != "2"]
    broken = spark.createDataFrame([("a", b"".join(kept))], "path string, content binary")
    with pytest.raises(Exception, match="segments do not make up"):
        warc.read_pages(broken).collect()


def test_chunked_framing():
    body = bytes(range(256)) * 40
    assert warc.from_chunks(warc.to_chunks(body, 100)) == body
    assert warc.from_chunks(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.from_chunks(b"2\r\nabc\r\n0\r\n\r\n")


def test_html_model_on_held_out_pages():
    model = htmltext.train()
    right = total = 0
    for seed in range(5000, 5080):
        source, labels = htmltext.labelled_page(seed)
        forest = htmltext.Forest([htmltext.Page(source)])
        got = forest.marginals(*model)[0] >= 0.5
        right += int((got == np.array(labels, bool)).sum())
        total += len(labels)
    assert right / total > 0.97


def test_html_marginals_are_exact():
    """Messages against a sum over all labellings of a small tree."""
    source, _ = "<div><p>one two</p><ul><li>a</li></ul></div>", None
    forest = htmltext.Forest([htmltext.Page(source)])
    weights, tables = htmltext.train(pages=20, rounds=20)
    got, _, z = forest.marginals(weights, tables)
    total, on = 0.0, np.zeros(forest.n)
    own = forest.x @ weights
    for mask in range(1 << forest.n):
        y = [mask >> i & 1 for i in range(forest.n)]
        score = sum(own[i] * y[i] for i in range(forest.n)) + sum(tables[forest.edge[i], y[forest.parent[i]], y[i]] for i in range(forest.n) if forest.parent[i] >= 0)
        total += np.exp(score)
        on += np.exp(score) * np.array(y)
    assert np.allclose(got, on / total) and np.isclose(z, np.log(total))


def test_html_text(spark):
    page = ("<html><head><title>no</title><script>var a = '<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"
            "<article><h1>The  harbour &amp; its\n lights</h1><p>Ships came in at dawn, one by one, and the keeper counted them by the sound of their bells.</p>"
            "<p>Nobody knew the tall one; it had no name on its bow and its sails were patched with red cloth.</p></article>"
            "<div class='comments'><p>Nice read, thanks!</p></div><footer><p>Copyright 2020, all rights reserved</p></footer></body></html>")
    rows = [(1, page), (2, None), (3, ""), (4, "<<<>>> & <"), (5, "<p" * 3000), (None, page), (1, page), (7, "<div>" * 400 + "x")]
    out = htmltext.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")).collect()
    assert len(out) == len(rows)
    want = "The harbour & its lights\nShips came in at dawn, one by one, and the keeper counted them by the sound of their bells.\n" \
           "Nobody knew the tall one; it had no name on its bow and its sails were patched with red cloth."
    by = defaultdict(list)
    for r in out:
        by[r.page_id].append(r.text)
    assert by[1] == [want, want] and by[None] == [want] and by[2] == by[3] == [""]
    assert htmltext.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


ARTICLE = ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title of it</h1><p>First paragraph of the story, long enough to be kept as text here.</p>%s"
           "<p>Second paragraph of the story, which also has to be kept as text.</p></article><footer><p>Copyright</p></footer></body></html>")


@pytest.mark.parametrize("inner, kept", [
    ("<svg><path>", []), ("<button>Go", []), ("<select><option>a</select>", []), ("<p>text <button>Push</button> on</p>", ["text on"]),
    ("<p>With <object>inner object words</object> and <math><mi>x</mi></math>.</p>", ["With inner object words and x."]), ("<xmp>a <b> c</xmp>", ["a <b> c"]),
    ('<p class="notice">We use cookies on this site, please accept them.</p>', []), ('<div class="cookie-notice"><p>We use cookies here.</p></div>', []),
    ("<template><p>no</p></template>", []), ("<script>if (a<b) x='</p>'</script>", [])])
def test_odd_elements_inside_an_article(inner, kept):
    lines = htmltext.main_texts([ARTICLE % inner], htmltext.train())[0].split("\n")
    assert lines[0] == "Title of it" and lines[1].startswith("First") and lines[-1].startswith("Second") and lines[2:-1] == kept


@pytest.mark.parametrize("bit", ["<b><p>x", "<div>", "<p", "<ul><li>a", '<a ">', "<table><tr><td>x", "<!", "<button>", "<svg><p>a"])
def test_hostile_pages_take_linear_time(bit):
    import time

    began = time.process_time()
    htmltext.Page(bit * 20000)
    assert time.process_time() - began < 3


def test_pages_against_a_plain_extractor(sf_dir):
    """The given pages' articles by their tags alone, without a model."""
    rows = duckdb.connect().execute(f"select html from '{sf_dir}/pages.parquet' where html is not null").fetchall()
    model = htmltext.train()
    block = re.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|article|blockquote|table|tr|td)\b[^>]*>", re.I)
    for html_, text in zip([h for h, in rows], htmltext.main_texts([h for h, in rows], model)):
        inner = re.search("<article[^>]*>(.*)</article>", html_, re.S | re.I)
        parts = block.split(re.sub("<!--.*?-->", "", inner[1], flags=re.S)) if inner else []
        plain = [" ".join(htmltext.html.unescape(re.sub("<[^>]+>", "", re.sub("<br[^>]*>", " ", p))).split()) for p in parts]
        assert text == "\n".join(p for p in plain if p)


def test_chat_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    got = chat.op8_chat(spark, sf_dir)
    assert as_set(got.collect()) == as_set(con.execute(chat.OP8_SQL).fetchall())


def test_chat_round_trip(spark):
    r = random.Random(3)
    bits = ["\\", "###", "</turn>", "<turn/>", "\n", "### assistant:", "a", "é", "\\\\", "", "\n</turn>\n", "\n<turn/>\n", " "]
    rows = [(c, t, r.choice(("user", "assistant", "tool x", "", None)), r.choice((None, "".join(r.choice(bits) for _ in range(r.randint(0, 8))))), "z")
            for c in (1, 2, 3, None) for t in range(9)] + [(5, 0, "user", "only", "z"), (5, 0, "user", "only", "z"), (5, None, "assistant", "first", "z")]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string"))).collect()
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert len(out) == len(want)
    for row in out:
        turns = [x[2:] for x in sorted(want[row.conv_id])]
        assert [(t.role, t.text) for t in row.turns] == turns
        assert row.loss_text == "".join(t for role, t in turns if role == "assistant")
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=None)


def test_urls(spark, sf_dir):
    made = [None, "", "no scheme", "http://", "http://ORG", "https://A.Example.ORG/en/1?x", "http://example.org/es/", "http://xexample.org/es/1", "ftp://a.com/de/#q",
            "http://com/fr/", "http://a.com?u=/fr/", "x://b.org://c/", "http://É.org/ü", "http://a.com/fr\n/", "http://a.\ncom/fr/"]
    pages = spark.createDataFrame([(i, u, "old", 1.0) for i, u in enumerate(made + made[:2])], "page_id long, url string, verdict string, score double")
    real = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for df in (pages, real):
        given = {r.page_id: r.url for r in df.collect()}
        out = urls.judge(df, urls.labelled_urls(spark)).collect()
        assert len(out) == df.count()
        for r in out:
            host, path, rule = plain_rule(given[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]), r.page_id
            assert r.verdict == (rule[1] if rule else "block" if r.score >= 0.5 else "allow")
    assert urls.judge(pages.limit(0), urls.labelled_urls(spark)).count() == 0


def test_url_model_on_held_out_urls(spark):
    tried = [("http://cdn.casino-bets.example.net/poker/9", "block"), ("https://www.jackpotslots.example.com/", "block"), ("http://payday-loan.example.net/x", "block"),
             ("http://museum-history.example.net/science/4", "allow"), ("https://www.newslibrary.example.com/", "allow"), ("http://garden-recipes.example.net/a", "allow")]
    out = urls.judge(spark.createDataFrame(list(enumerate(u for u, _ in tried)), "page_id long, url string"), urls.labelled_urls(spark)).collect()
    assert {r.page_id: r.verdict for r in out} == {i: v for i, (_, v) in enumerate(tried)}


def test_vectors_with_odd_values(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in np.float32(base[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.25))], i % 4 % 3) for i in range(150)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None, *[1.0] * 15], 0), (204, rows[0][1], None), (205, rows[0][1], 0), (206, [], 0), (207, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node int, m int")
    want = brute.vector_links(rows, 0.93)
    out = embeddings.near_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want and len(out) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_vectors_recall_in_many_cells(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 60)
    monkeypatch.setattr(embeddings, "CELL", 30)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute.vector_links([(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()], 0.93)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    assert all(got[i] <= n for i, (n, _) in want.items())
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_vectors_with_rare_links_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 60)
    monkeypatch.setattr(embeddings, "CELL", 30)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(30):  # partners at cosine 0.932, in places of their own
        off = rng.normal(size=64)
        off -= off @ x[i] * x[i]
        x[1500 + i] = 0.932 * x[i] + np.sqrt(1 - 0.932**2) * off / np.linalg.norm(off)
    rows = [(i, [float(v) for v in np.float32(v)], 0) for i, v in enumerate(x)]
    want = brute.vector_links(rows, 0.93)
    assert sum(n for n, _ in want.values()) == 60
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want


def test_rare_link_lost_by_the_graph_is_found(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "graph_links", lambda vectors, least, overlap: embeddings.stored(
        vectors.select("node", F.col("m").alias("n"), F.col("node").alias("root")).limit(0), "links"))
    x = np.random.default_rng(7).normal(size=(2000, 16))
    x[1000] = x[0] * 2 + 0.01
    rows = [(i, [float(v) for v in np.float32(v)], i if i % 1000 else -1) for i, v in enumerate(x)]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id for r in out if r.n_links} == {0, 1000} and {r.recall for r in out} == {None}


def test_audit_without_evidence_does_not_pass(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 16))
    x[20:] = x[:20] + rng.normal(size=(20, 16)) * 0.01
    nodes = spark.createDataFrame([("0", 16, i, 1, [float(v) for v in v]) for i, v in enumerate(x)], "label string, size int, node long, m long, vector array<double>")
    links = embeddings.exact_links(nodes, 0.93)
    assert {(r.node, r.n) for r in links.where("n > 0").collect()} == {(i, 1) for i in range(40)}
    assert embeddings.audit(nodes, links, 0.93) is None
    monkeypatch.setattr(embeddings, "EVIDENCE", 40)
    assert embeddings.audit(nodes, links, 0.93) == 1.0
    assert embeddings.audit(nodes, links.where("node % 20 < 10"), 0.93) == 0.5


def test_dense_groups_in_crowded_cells(spark, monkeypatch):
    """Near copies in hundreds, all different: cut in blocks, chains of links kept whole."""
    monkeypatch.setattr(embeddings, "BLOCK", 70)
    monkeypatch.setattr(embeddings, "CELL", 30)
    monkeypatch.setattr(embeddings, "EVIDENCE", 5)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 32))
    x[100:400] = x[7] + rng.normal(size=(300, 32)) * 0.12
    for i in range(400, 430):
        x[i] = 0.85 * x[i - 1] + 0.3 * rng.normal(size=32)
    rows = [(i, [float(v) for v in v], "one" if i % 50 else "two") for i, v in enumerate(x)]
    want = brute.vector_links(rows, 0.93)
    out = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert all(out[i][0] <= n for i, (n, _) in want.items())
    assert np.mean([out[i][0] / n for i, (n, _) in want.items() if n]) >= 0.97 and sum(out[i] == w for i, w in want.items()) > 0.97 * len(want)


def test_vectors_in_double_precision_and_repeated_rows(spark):
    big = [(1, [1e300, 0.0], "a"), (2, [1e300, 1e290], "a"), (3, [1e-300, 0.0], "a"), (3, [1e-300, 0.0], "a"), (None, [2e-300, 1e-310], "a"), (5, [0.0, 1.0], "b")]
    out = embeddings.near_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.n_links, r.component_id) for r in out) == [(0, 5)] + [(4, 1)] * 5
    wide = spark.createDataFrame([(1, [1.0], 1 << 60), (2, [2.0], 1 << 60), (3, [2.0], None)], "vec_id long, embedding array<float>, label long")
    assert {r.vec_id: r.n_links for r in embeddings.near_vectors(wide).collect()} == {1: 1, 2: 1, 3: 0}


def test_robust_prune_spreads_edges():
    x = np.array([[1, 0], [0.999, 0.04], [0.998, 0.06], [0.6, 0.8], [0, 1.0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = embeddings.robust_prune(x, degree=2)
    assert lists.shape == (5, 2) and 1 in lists[0] and 2 not in lists[0]


def test_pipeline_against_plain_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    rows = [(i, t) for (i, t), (_, c) in zip(rows, (brute.simhash_components(rows)[i] for i, _ in rows)) if i == c]
    left = [(i, x[4].decode("utf-8", "ignore")) for (i, _), x in zip(rows, brute.without_repeats([t for _, t in rows]))]
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(pieces, left, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_pipeline_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == docs.columns, name


@pytest.mark.parametrize("with_chars", [True, False])
def test_pipeline_with_clashes_nulls_and_repeats(spark, sf_dir, tmp_path, with_chars):
    """Names that operators use themselves, null ids, texts and languages, rows twice, no ``n_chars``:
    every stage keeps the columns and their values, the last one packs every row that is left."""
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    shared = "a passage of some length which two clean documents have in common word for word and letter for letter so that it has to go from both of them in the third stage of this " * 2
    more = spark.createDataFrame([(None, f"The first one begins by itself here. {shared} And it ends.", "en"), (7001, f"Another one begins in its own way there. {shared} It goes on for a while.", None), (7002, None, None), (7003, "", "en")],
                                 "doc_id long, text string, lang string").withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    docs = own.unionByName(more).unionByName(own.limit(5))
    clashes = {"kept": F.lit("yes"), "n_bytes": F.concat(F.lit("b"), F.col("doc_id").cast("string")), "n_removed": F.lit(1.5), "n_spans": F.lit(None).cast("int"), "row": F.lit("r"), "doc": F.lit(3), "fp": F.lit("x"),
               "id": F.lit("i"), "key": F.lit("k"), "component_id": F.lit(-1), "spans": F.lit("s"), "share": F.lit(9), "good": F.lit(True)}
    docs = docs.withColumns(clashes)
    docs = docs if with_chars else docs.drop("n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, before, str(tmp_path)), "clashes")
        assert after.dtypes == before.dtypes, name
        rest = [c for c in before.columns if c not in ("text", "n_chars")]
        left = Counter(tuple(r) for r in after.select(rest).collect())
        assert left and not left - Counter(tuple(r) for r in before.select(rest).collect()), name
        if name == "suffix-array dedup":
            rows = before.select("doc_id", "text").collect()
            want = Counter((r.doc_id, r.text and w[4].decode("utf-8", "ignore")) for r, w in zip(rows, brute.without_repeats([r.text for r in rows])))
            assert Counter((r.doc_id, r.text) for r in after.select("doc_id", "text").collect()) == want
            assert not with_chars or after.where("n_chars <> length(text)").count() == 0
        before = after
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in before.select("doc_id").collect())
