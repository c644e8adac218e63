"""The pipeline's stages one by one on planted cases, each against what it must do."""

import hashlib
import random

import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("data"))
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    bench = [" ".join(word() for _ in range(25)) for _ in range(3)]
    docs, labels = [], []
    for i in range(300):
        w = [word() for _ in range(60)]
        toxic = i % 10 == 3
        if toxic:
            w[rnd.randrange(60)] = "idiot"
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    near = docs[0][1].split()
    near[30] = "changed"
    docs += [(300, docs[0][1], "en", "s", 0), (301, " ".join(near), "en", "s", 0), (302, docs[5][1] + " " + bench[0], "en", "s", 0)]
    docs += [(303, " ".join(word() for _ in range(40)) + ' password = "hunter2secret" end', "en", "s", 0), (304, None, None, None, None), (305, "", "en", "s", 0), (306, bench[1], "en", "s", 0)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, cols).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    import sentencepiece

    import corpus_pipeline
    from tideline.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{folder}/stage{k}.parquet")
        docs = spark.read.parquet(f"{folder}/stage{k}.parquet")
        seen.append({r.doc_id: r for r in docs.collect()})
    toxic, near, bench, secret, last = seen
    assert set(toxic) == {i for i in start if not (i < 300 and i % 10 == 3)}
    assert set(near) == set(toxic) - {300, 301}
    assert set(bench) == set(near) - {306}
    assert bench[302].text.strip() == start[5] and all(bench[i].text == start[i] for i in bench if i != 302)
    assert secret[303].text.endswith(" [SECRET] end") or "hunter2secret" not in secret[303].text
    assert all(secret[i].text == bench[i].text for i in secret if i != 303) and set(secret) == set(bench)
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    assert set(last) == set(secret)
    for i, r in last.items():
        ids = lib.encode(secret[i].text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {i: r.ids_sha256 for i, r in last.items()}
