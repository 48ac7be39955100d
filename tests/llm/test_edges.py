"""Every operator on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from millrace.llm import decontaminate, extract, licences, lines, packing, quality, simhash, tokens, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, gone long, h string, w string, seed long, fp long"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))


def rows():
    base = [(1, "A plain text with more than ten words in it, so that it may stay."), (1, "A plain text with more than ten words in it, so that it may stay.")]
    base += [(2, None), (3, ""), (4, " \n\t "), (5, LONG), (None, "Nobody knows the number of this text of more than ten words, none."), (7, "x\n" * 50)]
    return [(i, t, None, "s", None, "r", 1, "h", "w", 2, 3) for i, t in base]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(rows() if request.param == "rows" else [], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, " ".join(f"word{k}" for k in range(40)))], "item_id long, text string")


def test_quality(docs):
    got = quality.judge(docs).collect()
    assert len(got) == docs.count()
    if got:
        n = {r.doc_id: r for r in got}
        assert n[2].n_words == n[3].n_words == n[4].n_words == 0 and not n[2].kept and n[2].base_failed
        assert n[1].kept and n[5].n_words == 30_000
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert all(r.doc_tokens == 1 for r in got if r.doc_id in (2, 3, 4))


def test_tokens(docs):
    got = tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == docs.count()
    assert all(r.n_bytes == r.n_tokens == 0 for r in got if r.doc_id in (2, 3))


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} <= {2}
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and sum(r.doc_id in (2, 3, 4) for r in one.collect()) == (1 if got else 0)


def test_lines(docs):
    got = lines.line_classes(docs).collect()
    assert {(r.doc_id, r.line_no) for r in got if not r.kept} == ({(7, k) for k in range(1, 50)} if docs.count() else set())
    left = lines.drop_repeated(docs)
    assert left.columns == docs.columns and left.count() == docs.count()


def test_decontamination(docs, bench):
    hits = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert hits == ({(5, 4)} if docs.count() else set())
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.where("doc_id = 5").count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_licences(docs):
    assert licences.scan(docs).count() == 0


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    net = toxicity.train(docs, labels)
    got = toxicity.score(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    net = toxicity.fit([LONG, None, "you idiot", "", "fine words"] * 3, [0, 0, 1, 0, 0] * 3, 2)
    got = toxicity.score(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, rule string, counts string, text string"
    page = lambda n: f"<html><body><nav><a href=/>x</a></nav><article><h1>T{n}</h1><p>Body {n} &amp; more</article><footer>f</footer>"
    data = [(k, f"http://h.net/{k}", page(k)) for k in range(6)] + [(6, None, None), (6, None, None), (7, "nothing", ""), (None, "http://h.net", "<p>stray")]
    for some in (data, []):
        pages = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in some], schema)
        got = extract.main_texts(pages).collect()
        assert len(got) == len(some)
        judged = urls.judge_urls(pages).collect()
        assert len(judged) == len(some)
        if some:
            texts = {r.page_id: r.text for r in got}
            assert texts[2] == "T2 Body 2 & more" and texts[6] == texts[7] == "" and texts[None] == "stray"
            v = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged}
            assert v[1] == ("h.net", "/1", "net/", "block") and v[6] == ("", "", None, "allow")
            assert v[None][:3] == ("h.net", "", None)


def test_pages_of_many_hosts_take_the_same_way(spark, monkeypatch):
    page = lambda n: f"<body><div class=m>Menu</div><div class=c><p>Text {n} of a page with some words</p></div></body>"
    pages = spark.createDataFrame([(k, f"http://h{k % 2}.net/{k}", page(k)) for k in range(20)], "page_id long, url string, html string")
    want = {r.page_id: r.text for r in extract.main_texts(pages).collect()}
    assert want[3] == "Text 3 of a page with some words"
    monkeypatch.setattr(extract, "MOST_BROADCAST", 1)
    assert {r.page_id: r.text for r in extract.main_texts(pages).collect()} == want


def test_pipeline_stages(spark, tmp_path, bench):
    docs = spark.createDataFrame(rows(), DOCS)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (docs, docs.limit(0)):
        empty.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
        assert {r.doc_id for r in got} == ({1, None} if empty is docs else set())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"
    ]
