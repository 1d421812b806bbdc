import json

import pytest

from opinara.sources import readers, writers


def test_dataset_and_prompt(spark, tmp_path):
    (tmp_path / "dataset").mkdir()
    (tmp_path / "dataset/train.json").write_text(json.dumps([{"id": 1, "language": "es", "text": "a", "gold": {"service": "positive"}}, {"id": 2}]))
    rows = readers.dataset(spark, "train", [str(tmp_path)]).orderBy("ordinal").collect()
    assert [(r.id, r.gold) for r in rows] == [("1", {"service": "positive"}), ("2", None)]
    (tmp_path / "p.json").write_text(json.dumps({"system": "", "sysprompt": "s", "user": "u"}))
    assert tuple(readers.prompt(spark, str(tmp_path / "p.json")).first()) == ("p", "s", "u")
    (tmp_path / "q.json").write_text(json.dumps({"system": "s"}))
    with pytest.raises(Exception, match="no user prompt"):
        readers.prompt(spark, str(tmp_path / "q.json")).collect()


def test_padded_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Config ,  Temp\n x ,  0.5 \n y, 1\n x , 0.7\n")
    got = {tuple(r) for r in readers.padded_csv(spark, str(tmp_path / "a.csv"), readers.SWEEP_COLUMNS, ["temperature"], "config").collect()}
    assert got == {("x", 0.7), ("y", 1.0)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    writers.json_records(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="already exists"):
        writers.json_records(df, str(tmp_path / "o"))
    assert writers.markdown(df).splitlines()[0] == "| n | s |"
