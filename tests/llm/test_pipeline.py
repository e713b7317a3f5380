"""The pipeline's stages on a small table with every awkward row."""

from __future__ import annotations

import random

import corpus_pipeline
from sievemill.llm.common import workers_import


def test_stages(spark, tmp_path):
    workers_import(spark)
    r = random.Random(3)
    words = "the and with river stone other think été garçon naïve über schön".split()
    say = lambda n: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
    shared = say(120)
    texts = [None, "", "123 456", "short", say(80), say(200) + " " + shared, shared + " " + say(200), "x" + shared + say(300), "Dear Mrs Maria Lopez, mail me at jo.doe@corp.example.com or +1 (942) 555-3818 " + say(30)]
    texts.append(texts[4])
    texts.append(texts[4] + " tail")
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)] + [(4, texts[4], None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    schema, seen = docs.schema, {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert [(c.name, c.dataType) for c in docs.schema] == [(c.name, c.dataType) for c in schema], name
        seen[name] = docs.collect()
    ids = lambda name: sorted(x.doc_id for x in seen[name])
    assert ids("language ID") == [3, 4, 4, 5, 6, 7, 8, 9, 10]
    assert ids("n-gram Jaccard join") == [3, 4, 5, 6, 7, 8]
    cut = {x.doc_id: x.text for x in seen["suffix-array dedup"]}
    assert cut[4] == texts[4]
    assert all(shared not in cut[i] and cut[i] for i in (5, 6, 7)) and cut[8] == texts[8]
    assert all("jo.doe" not in x.text and "Lopez" not in x.text and "942" not in x.text[:80] for x in seen["PII"] if x.doc_id == 8)
    packed = seen["best-fit packing"]
    assert {x.doc_id for x in packed} == set(cut)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_repeated_rows_keep_one(spark, tmp_path):
    workers_import(spark)
    r = random.Random(4)
    say = lambda n: " ".join(r.choice("the and with river stone other think".split()) + str(r.randint(0, 99)) for _ in range(n))
    text, other = say(120), say(120)
    rows = [(4, text, "en", "a", 1), (4, text, "en", "a", 1), (4, text, None, None, 2), (9, text, "en", "a", 1), (5, other, "en", "a", 1), (6, "short", "en", "a", 1), (6, "short", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for _, f in corpus_pipeline.STAGES[1:3]:
        docs = f(spark, docs, str(tmp_path))
    assert sorted((x.doc_id, x.text) for x in docs.collect()) == [(4, text), (5, other), (6, "short")]


def test_columns_named_as_the_operators_own(spark, tmp_path):
    workers_import(spark)
    r = random.Random(5)
    say = lambda n: " ".join(r.choice("the and with river stone other think".split()) + str(r.randint(0, 99)) for _ in range(n))
    shared = say(120)
    rows = [(i, say(60) + " " + shared, "k", i, 7, [f"e{i}"], "c", 1, 2, 3) for i in range(3)] + [(3, "mail a.b@corp.example.com", "k", 3, 7, ["e3"], "c", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, tid long, n_entities long, entities array<string>, cuts string, n_bytes int, n_removed int, n_spans int")
    names, extra = docs.columns, docs.drop("text").orderBy("doc_id").collect()
    for f in (corpus_pipeline.repeated_passages, corpus_pipeline.private_data):
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == names
    got = docs.orderBy("doc_id").collect()
    assert [tuple(x[c] for c in names if c != "text") for x in got] == [tuple(x) for x in extra]
    assert all(shared not in x.text for x in got) and "corp" not in got[3].text


def test_rows_of_one_id_stand_alone(spark, tmp_path):
    """A bad or spare row does not take others of its doc_id along; groups leave one row each."""
    workers_import(spark)
    r = random.Random(6)
    say = lambda n: " ".join(r.choice("the and with river stone other think".split()) + str(r.randint(0, 99)) for _ in range(n))
    a, b, c = say(150), say(150), say(150)
    rows = [(1, a, "x"), (1, "12 34", "x"), (0, a + " more", "x"), (1, b, "y"), (2, c, "z"), (2, c + " tail", "z"), (None, say(50), "n"), (None, None, "n"), (3, "Mr. John Smith wrote to Dr Anna Lee", "k")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4) for i, t, s in rows], "doc_id long, text string, lang string, source string, tid long, kept int, cuts int, first int").repartition(2)
    out = corpus_pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns and sorted(((x.doc_id or -1, x.text) for x in out.collect())) == sorted((i or -1, t) for i, t, _ in rows if t and t != "12 34")
    out = corpus_pipeline.near_duplicates(spark, out, "")
    texts = {x.text for x in out.collect()}
    assert out.columns == docs.columns and a + " more" in texts and a not in texts and b in texts and len({c, c + " tail"} & texts) == 1 and len(texts) == out.count() == 5
    for f in (corpus_pipeline.repeated_passages, corpus_pipeline.private_data):
        out = f(spark, out, "")
        assert out.columns == docs.columns and out.count() == 5
    assert not any("Smith" in x.text or "Anna" in x.text for x in out.collect())
    assert corpus_pipeline.best_fit_packing(spark, out, "").count() == 5


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, "")
        assert docs.count() == 0
