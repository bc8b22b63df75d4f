import random

import corpus_pipeline

KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("abcdeiou", k=rng.randint(2, 8))) for _ in range(n)) + "."
    clean = [(i, prose(60), "en", f"src{i % 3}") for i in range(200)]
    junk = [(i, " ".join(w.upper() + "!!" for w in prose(60).split()), "en", "src1") for i in range(200, 300)]
    item = prose(40)
    extra = [
        (400, clean[0][1], "en", "a"), (401, clean[1][1] + " more", "en", "a"), (402, f"{prose(30)} {item} {prose(30)}", "en", "a"),
        (403, f'{prose(40)} token = "{KEY}" {prose(20)}', "en", "a"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in clean + junk + extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        step = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in step.collect()})
        if k < 4:
            assert step.columns == docs.columns
    good = {r[0] for r in clean}
    assert set(kept[0]) == good | {400, 401, 402, 403}
    assert set(kept[1]) == good | {402, 403}
    assert set(kept[2]) == good | {403} == set(kept[3]) == set(kept[4])
    assert KEY not in kept[3][403].text and "[SECRET]" in kept[3][403].text
    assert all(kept[3][i].text == t for i, t, *_ in clean)


def test_run_reads_what_stages_wrote(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Rows without an id, repeated ids, null texts and clashing columns go through all stages, each decided by its text."""
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choices("abcdeiou", k=rng.randint(2, 8))) for _ in range(n)) + "."
    item, texts = prose(40), [prose(60) for _ in range(60)]
    rows = [(i, t, "en", "s", 1, 0.5) for i, t in enumerate(texts)] + [
        (None, texts[0], "en", "s", 1, 0.5), (None, "free of an id: " + prose(50), None, None, None, None), (None, f"{prose(30)} {item} {prose(30)}", "en", "s", 1, 0.5),
        (7, "another text under this id: " + prose(50), "en", "s", 1, 0.5), (8, texts[8], "en", "s", 1, 0.5), (None, f'{prose(40)} token = "{KEY}"', "en", None, 1, 0.5), (90, None, "en", "s", 1, 0.5), (91, "", "en", "s", 1, 0.5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, root long, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        step = spark.read.parquet(f"{tmp_path}/{k}")
        assert step.columns == docs.columns
        counts.append(step.count())
    assert counts == [68, 65, 64, 64]
    got = step.collect()
    assert sorted(r.text for r in got if r.doc_id == 7) == sorted([texts[7], rows[63][1]])
    assert sum(r.text == texts[8] for r in got) == 1 and sum(not r.text for r in got) == 1
    assert [r.text[-8:] for r in got if r.doc_id is None and "token" in r.text] == ["SECRET]\""[-8:]]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 64
