"""The pipeline on a small table, stage by stage against plain rules."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_simhash import plain_components
from verdikt.llm import decontaminate, pieces


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root, rng = str(tmp_path_factory.mktemp("tables")), random.Random(18)
    prose = {"aa": [f"{a}a{b}" for a in "bdglm" for b in "kprst"], "bb": [f"{a}o{b}" for a in "zwxjv" for b in "hnyfq"]}
    docs = [(k, " ".join(rng.choices(prose[lang], k=rng.randint(30, 90))), lang, "s", 0) for k in range(240) for lang in [rng.choice(["aa", "bb"])]]
    labels = [(k, 1, 0) for k in range(0, 240, 2)]
    for k in range(240, 300):   # junk
        docs.append((k, " ".join(["%%", "zz"] * rng.randint(10, 40)), "aa", "s", 0))
        labels.append((k, 0, 0))
    bench = [(k, " ".join(f"{w}{rng.randrange(40)}" for w in rng.choices(prose["aa"], k=20))) for k in range(3)]
    docs += [(300 + k, docs[k][1] + " " + bench[k % 3][1], docs[k][2], "s", 0) for k in range(6)]
    docs += [(400 + k, docs[k][1], docs[k][2], "s", 0) for k in range(10, 40)]     # copies
    docs += [(500, "12 34", "aa", "s", 0), (501, "", "aa", "s", 0), (502, None, None, None, None), (20, docs[20][1], docs[20][2], "s", 0)]
    for name, rows, kind in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
                             ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{root}/{name}.parquet")
    return root


def test_stages(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        seen.append((docs.collect(), spark.read.parquet(f"{tmp_path}/{k}").collect()))
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    ids = lambda rows: {r.doc_id for r in rows}
    before, after = seen[0]
    assert not {r.doc_id for r in after} & set(range(240, 300)) and ids(after) >= set(range(240)) | set(range(300, 306))
    before, after = seen[1]
    assert ids(before) - ids(after) <= {500, 501, 502} and not ids(after) & {500, 501, 502}
    before, after = seen[2]
    components = plain_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in components})
    before, after = seen[3]
    leaked = ids(before) - ids(after)
    assert leaked == set(range(300, 306)) & ids(before) and leaked
    before, after = seen[4]
    assert ids(before) == ids(after) and all(r.exact for r in after)
    book = pieces.pieces(public_tokenizers.path(corpus_pipeline.PIECES))
    texts = {r.doc_id: r.text for r in before}
    for r in after[:20]:
        assert list(r.ids) == book.encode(pa.array([texts[r.doc_id]]))[0].tolist()
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, after), key=str)


def test_columns_of_the_names_that_stages_make_are_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["score", "Predicted", "lang_pred", "ambiguous", "_id", "_digest", "_leak"]
    wide = docs.selectExpr("*", *[f"concat('{n} ', doc_id) as `{n}`" for n in names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        plain, kept = stage(spark, docs, folder), stage(spark, wide, folder)
        assert kept.columns == wide.columns
        kept = kept.collect()
        assert all(r[n] == (None if r.doc_id is None else f"{n} {r.doc_id}") for r in kept for n in names)
        assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(r.doc_id), str(r.text)) for r in plain.collect())


def test_one_of_each_keeps_one(spark):
    from verdikt.llm import simhash
    rows = [(None, "a b c"), (None, "a b c"), (7, "x y z"), (7, "x y z"), (7, "other words here"), (9, "x y z"), (None, None), (3, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, "a b c"), (7, "x y z"), (7, "other words here"), (3, "")], key=str)


def test_clean_on_equal_texts(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(None, text), (1, text), (2, "clean"), (None, None)], "doc_id long, text string")
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, text)], "item_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == [(2, "clean"), (None, None)]
