import random

import public_tokenizers
import sentencepiece

import corpus_pipeline


def test_stages_drop_what_was_planted(spark, tmp_path):
    rnd = random.Random(11)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) + ("." if k % 9 == 8 else "") for k in range(n)) + "."
    clean = {i: text(150) for i in range(60)}
    docs, labels = dict(clean), {i: 0 for i in range(60)}
    for i in range(100, 160):
        docs[i] = text(40) + " you are an idiot. " + text(40)
        labels[i] = 1
    for i in range(10):
        docs[200 + i] = clean[i]
    docs[210] = clean[10] + " end"
    passage = text(60)
    docs[20], docs[220] = clean[20] + " " + passage, text(100) + " " + passage
    bench = [(0, text(30)), (1, text(5))]
    docs[230] = text(100) + " " + bench[0][1]
    docs |= {240: None, 241: ""}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs.items()] + [(30, clean[30], "en", "s", len(clean[30]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r.doc_id: r for r in now.collect()})
    toxic, near, cut, bench_free = left
    assert set(docs) - set(toxic) == set(range(100, 160))
    assert set(toxic) - set(near) == {*range(200, 211), 241}
    assert set(cut) == set(near) and passage in cut[20].text and passage[20:] not in cut[220].text and cut[220].n_chars == len(cut[220].text)
    assert set(cut) - set(bench_free) == {230}
    codec = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(bench_free)
    assert all(r.round_trip and r.ids == codec.encode(bench_free[r.doc_id].text or "") for r in got)
