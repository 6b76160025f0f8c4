"""Sources, sinks, settings, the pipeline and the resumable stream."""

import pytest
from pyspark.sql import functions as F

from glossmill.functions import numeric as num
from glossmill.operators import packing
from glossmill.plans import corpus, settings
from glossmill.sources import files, writers
from glossmill.streaming import resumable


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")


def test_shards_round_trip(spark, tmp_path):
    path = str(tmp_path / "shards")
    writers.write_shards(texts(spark, "first row", "second row").coalesce(1), path, rows_per_file=1)
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == 2
    assert files.row_count(spark, path) == 2
    writers.write_shards(texts(spark, "third", None), path, append=True)
    assert files.row_count(spark, path) == 4
    assert sorted(r["text"] for r in files.text_rows(spark, path).collect()) == ["first row", "second row", "third"]
    with pytest.raises(ValueError, match="no column"):
        files.text_rows(spark, path, "other")
    with pytest.raises(ValueError, match="no Parquet"):
        files.text_rows(spark, str(tmp_path / "none"))


def test_text_files(spark, tmp_path):
    writers.write_text(texts(spark, " a b \n", "c"), str(tmp_path / "t"))
    assert sorted(r["text"] for r in files.text_lines(spark, str(tmp_path / "t")).collect()) == ["a b", "c"]
    parts = texts(spark, "x", "y").withColumn("part", F.when(F.col("id") == 0, "dev").otherwise("train"))
    writers.write_splits(parts, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s/part=dev")).first()[0] == "x"
    assert files.exported(texts(spark, "x", None, "z"), limit=1, key="id").first()["text"] == "x"


def test_features_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, s, "Labas rytas, Lietuva!") for s in range(9)], "doc long, sent int, text string")
    f = corpus.make_features(rows, "doc", "sent", settings.Settings(length=24), packing.FixedChunk(4))
    writers.write_features(f, str(tmp_path / "f"), 24, files=1)
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == f.count() > 0
    with pytest.raises(Exception, match="feature row not of length"):
        writers.write_features(f, str(tmp_path / "g"), 25)
    lines = []
    for r in back.collect():
        lines += [" ".join(map(str, r[c])) for c in files.FIELDS[:-1]] + [str(r["label_len"])]
    (tmp_path / "old.txt").write_text("\n".join(lines) + "\n")
    old = files.legacy_features(spark, str(tmp_path / "old.txt"), 24)
    assert sorted(map(str, old.drop("row").collect())) == sorted(map(str, back.select(*files.FIELDS).collect()))
    with pytest.raises(Exception, match="bad feature row"):
        files.legacy_features(spark, str(tmp_path / "old.txt"), 23).collect()


def test_settings():
    s = settings.Settings(length=50)
    assert settings.Settings.from_json(s.to_json()) == s
    assert settings.truth("Yes") and not settings.truth(" 0")
    assert settings.addresses(" a, b", "c,") == ["a", "b", "c"]
    for bad in (lambda: settings.truth("maybe"), lambda: settings.addresses(" , ")):
        with pytest.raises(ValueError):
            bad()
    got = settings.Settings.from_options(length="9", share="0.5", carry="n", alphabet="any", taggers="http://a,http://b")
    assert got == settings.Settings(length=9, share=0.5, carry=False, alphabet="any", taggers=["http://a", "http://b"])
    with pytest.raises(KeyError):
        settings.Settings.from_options(lenght="9")


def test_shards_by_size(spark, tmp_path):
    rows = texts(spark, *["x" * 1000] * 100).coalesce(1)
    assert writers.rows_in(rows, 4000) == 10 and writers.rows_in(texts(spark, None), 10) == 1_000_000
    writers.write_shards(rows, str(tmp_path / "s"), size=10_000)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 4


def test_counting_rows_leaves_the_session_as_it_was(spark, tmp_path):
    texts(spark, "a").write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.parquet.aggregatePushdown")
    assert files.row_count(spark, str(tmp_path / "t")) == 1 and spark.conf.get("spark.sql.parquet.aggregatePushdown") == before


def test_intermediate_tables(spark, monkeypatch):
    from glossmill.plans import shared

    made = shared.cut(texts(spark, "a", "b"), "x")
    assert made.count() == 2 and shared._written
    shared.clear()
    assert not shared._written
    with pytest.raises(Exception):
        spark.read.parquet(made.inputFiles()[0]).count()

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: Cluster.conf)

    with pytest.raises(ValueError, match="executors share"):
        shared.shared_dir(Cluster)


def test_metrics_of_a_run(spark, tmp_path):
    from glossmill.operators import metrics

    rows, seen = metrics.observed(texts(spark, "a", None, "c"), rows=F.count(F.lit(1)), texts=F.count("text"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "texts": 2}
    frame = spark.createDataFrame([("f1", 0.5)], "name string, value double")
    for run in ("one", "two"):
        metrics.write_metrics(frame, str(tmp_path / "m"), run)
    assert sorted(r["run"] for r in spark.read.json(str(tmp_path / "m")).collect()) == ["one", "two"]


def test_averaged_checkpoints(spark, tmp_path):
    from glossmill.operators import averaging

    def save(name, rows):
        spark.createDataFrame(rows, "name string, values array<double>, shares string").write.parquet(str(tmp_path / name))
        return str(tmp_path / name)

    a = save("a", [("w", [1.0, 2.0], None), ("tied", [1.0, 2.0], "w")])
    b = save("b", [("w", [3.0, 6.0], None)])
    c = save("c", [("v", [3.0], None)])
    assert sorted(tuple(r) for r in averaging.averaged(spark, [a, b]).collect()) == [("w", 0, 2.0), ("w", 1, 4.0)]
    with pytest.raises(FileNotFoundError):
        averaging.averaged(spark, [a, str(tmp_path / "none")])
    with pytest.raises(ValueError, match="not in every"):
        averaging.averaged(spark, [a, c])
    assert tuple(averaging.parameter_count(spark.read.parquet(a)).first()) == (2, 4)


def test_stream_resumes(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    texts(spark, "Labas rytas.", "blogas rytas", None).write.parquet(source)
    run = lambda: sorted(r["text"] for r in resumable.clean_new(spark, source, target, state, "id long, text string").collect())
    assert run() == ["Labas rytas."]
    assert run() == ["Labas rytas."]
    texts(spark, "Geras vakaras!").write.mode("append").parquet(source)
    assert run() == ["Geras vakaras!", "Labas rytas."]


def test_subword_model(spark, tmp_path):
    lines = texts(spark, *[f"labas rytas lietuva {i} kaip sekasi vilnius kaunas" for i in range(200)])
    path = corpus.train_subwords(corpus.lowered(lines), str(tmp_path / "m"), settings.Settings(vocabulary=60))
    v = writers.vocabulary(path, spark)
    got = {r["piece"]: r["id"] for r in v.collect()}
    assert (got["<blk>"], got["<s>"], got["</s>"]) == (0, 1, 2)
    ids = spark.createDataFrame([("labas",), (None,)], "w string").select(packing.SentencePiece(path).encode(F.col("w")).alias("i")).collect()
    assert len(ids[0]["i"]) >= 1 and not ids[1]["i"]
    writers.write_vocabulary(v, str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).first()[0] == "<blk> 0"


def test_arithmetic(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>")
    r = df.select(num.argmax("a"), num.softmax("a"), num.layer_norm("a"), num.cross_entropy(F.col("a"), F.lit(0))).first()
    assert r[0] == 1 and sum(r[1]) == pytest.approx(1) and sum(r[2]) == pytest.approx(0) and r[3] == pytest.approx(2.7586, abs=1e-3)


def test_running_states(spark):
    rows = [("a", 2, 5, 1, 1, 9), ("a", 1, 9, 9, 9, 9), ("a", 2, 5, 1, 1, 9)]
    df = spark.createDataFrame(rows, "run_id string, saved_at long, read_rows long, sentences_written long, words_written long, total_rows long")
    assert [tuple(r) for r in resumable.progress(df).collect()] == [("a", 2, 5, 1, 1, 9)]
