import json
from pathlib import Path

import pytest
from test_text import ADVERSARIAL

from maskloom.operators.vocabulary import Vocabulary
from maskloom.session import broadcast_if_small, clear_scratch, materialise, shared_dir, spread
from maskloom.sources import artifacts, tables


@pytest.fixture
def frame(spark):
    rows = [(i, s) for i, s in enumerate(ADVERSARIAL) if "\x00" not in s] + [(99, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("separator", [";", ","])
def test_csv(spark, frame, tmp_path, separator):
    # a carriage return alone is read back as a line break
    frame = frame.where("text is null or instr(text, char(13)) = 0")
    tables.write_csv(frame, str(tmp_path / "t"), separator)
    back = tables.read_csv(spark, str(tmp_path / "t"), frame.schema, separator)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, frame.collect()))


def test_splits_are_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "doc_id long, split string")
    tables.write_splits(df, str(tmp_path / "t"))
    train = tables.read_split(spark, str(tmp_path / "t"), "train")
    assert rows_of(train.select("doc_id")) == [(1,), (3,)]
    assert tables.read_split(spark, str(tmp_path / "t")).count() == 3
    assert len(train.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()


def test_parquet_is_snappy(spark, tmp_path):
    tables.write_parquet(spark.range(3), str(tmp_path / "t"))
    assert any(f.name.endswith(".snappy.parquet") for f in (tmp_path / "t").iterdir())
    assert tables.read_parquet(spark, str(tmp_path / "t")).count() == 3


def test_samples(spark, tmp_path):
    texts = ["Ærø Århus", "漢字 \"q\"", "line\nbreak"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tables.write_sample(df, str(tmp_path / "lines"))
    assert rows_of(tables.read_sample(spark, str(tmp_path / "lines"))) == sorted((t,) for t in texts)
    assert any("Ærø" in f.read_text() for f in (tmp_path / "lines").glob("part-*"))
    (tmp_path / "array.json").write_text(json.dumps(texts, ensure_ascii=False, indent=4))
    assert rows_of(tables.read_sample_array(spark, str(tmp_path / "array.json"))) == sorted((t,) for t in texts)


def test_results(spark, tmp_path):
    nested = {"model": "m", "results": {"a text": {"ppl": 1.5}, "Ærø": {"ppl": 2.0}}}
    (tmp_path / "r.json").write_text(json.dumps(nested, indent=4, ensure_ascii=False))
    assert rows_of(tables.read_results(spark, str(tmp_path / "r.json"))) == [("m", "a text", 1.5), ("m", "Ærø", 2.0)]
    nested["results"]["long " * 20_000] = {"ppl": 3.0}
    (tmp_path / "long.json").write_text(json.dumps(nested))
    found = tables.read_results(spark, str(tmp_path / "long.json")).collect()
    assert sorted((len(r["text"]), r["ppl"]) for r in found) == [(3, 2.0), (6, 1.5), (100_000, 3.0)]
    long = spark.createDataFrame([("m", "s", "t", 1.5)], "model string, sample string, text string, ppl double")
    tables.write_results(long, str(tmp_path / "out"))
    assert rows_of(spark.read.json(str(tmp_path / "out")).select("model", "ppl")) == [("m", 1.5)]


def test_statistics(spark, tmp_path):
    df = spark.createDataFrame([("m", "s", "mean", 1.5)], "model string, sample string, stat string, value double")
    tables.write_statistics(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "model=m" / "sample=s").is_dir()


def test_vocabulary(spark, tmp_path):
    made = Vocabulary({"[PAD]": 0, "a": 1, "ab": 2}, [("a", "b"), ("ab", "a")])
    artifacts.save_vocabulary(made, spark, str(tmp_path), model_max_length=1024)
    back = artifacts.load_vocabulary(spark, str(tmp_path))
    assert (back.tokens, back.merges) == (made.tokens, made.merges)
    assert artifacts.read_config(spark, str(tmp_path / "config")).first()["model_max_length"] == 1024


def test_added_tokens(spark, tmp_path):
    entry = {"content": "æ", "lstrip": False, "normalized": True, "rstrip": False, "single_word": False, "special": True}
    (tmp_path / "t.json").write_text(json.dumps({"added_tokens_decoder": {"5": entry}}, indent=2))
    [row] = artifacts.read_added_tokens(spark, str(tmp_path / "t.json")).collect()
    assert (row["id"], row["content"], row["special"]) == (5, "æ", True)


def test_session_helpers(spark):
    df = spark.range(10)
    assert rows_of(materialise(df, "t")) == rows_of(df)
    kept = materialise(df, "t").inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert Path(kept).exists()
    clear_scratch(spark)
    assert not Path(kept).exists()
    assert shared_dir(spark) and spark.sparkContext.getCheckpointDir()
    assert spread(df.coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = df.repartition(50)
    assert spread(wide, "id") is wide
    assert broadcast_if_small(df, 5) is df and broadcast_if_small(df, 10) is not df


class _Cluster:
    """A session's context under the name of a cluster's master."""

    def __init__(self, context):
        self._context, self.master = context, "spark://host:7077"

    def __getattr__(self, name):
        return getattr(self._context, name)


def test_shared_dir_of_a_cluster_by_a_mounted_path(spark, tmp_path, monkeypatch):
    class Session:
        sparkContext, conf = _Cluster(spark.sparkContext), {"spark.checkpoint.dir": str(tmp_path)}

    assert shared_dir(Session) == f"file:{tmp_path}"
    Session.conf = {}
    monkeypatch.setattr(Session.sparkContext, "getCheckpointDir", lambda: None, raising=False)
    monkeypatch.setattr(Session.sparkContext, "setCheckpointDir", lambda path: None, raising=False)
    monkeypatch.setattr(Session.sparkContext, "getConf", lambda: {}, raising=False)
    with pytest.raises(ValueError):
        shared_dir(Session)
    monkeypatch.setattr(
        Session.sparkContext, "getConf", lambda: {"spark.sql.warehouse.dir": str(tmp_path)}, raising=False
    )
    assert shared_dir(Session) == f"file:{tmp_path}"
