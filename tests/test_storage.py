import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from attesta import storage
from attesta.functions import text as X
from attesta.operators import funnel
from attesta.streaming import ledger_stream


def session(master, **settings):
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default), set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.scratch_dir(session(master))
    assert storage.scratch_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert storage.scratch_dir(session("local[2]"))


def test_a_lost_version_of_the_ledger_stops_the_stream(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / n) for n in ("in", "ledger", "check"))
    read = lambda: spark.readStream.schema("id string").parquet(source)
    for ids in (["a"], ["b"]):
        spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.mode("append").parquet(source)
        ledger_stream.keep_ledger(read(), folder, checkpoint, lambda n: f"2024-01-0{n + 1}").awaitTermination()
    assert {r.id for r in ledger_stream.current_ledger(spark, folder).collect()} == {"a", "b"}
    shutil.rmtree(f"{folder}/v1")
    spark.createDataFrame([("c",)], "id string").coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="missing or incomplete"):
        ledger_stream.keep_ledger(read(), folder, checkpoint, lambda n: "2024-01-09").awaitTermination()


def test_batches_are_numbered_in_order(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") * 7919 % 1000).alias("n"))
    got = {r.n: r.batch for r in funnel.batches(df, ["n"], 30).collect()}
    assert got == {n: n // 30 for n in range(1000)}


def test_any_number_of_thousands_groups(values):
    long = ",".join(["1", *["234"] * 12])
    texts = {"a": long, "b": f"x {long}, {long} y", "c": "1,234,56", "d": "1,234,567x", "e": "a1,234", "f": "12345,678,901"}
    got = values(**{k: X.without_thousands(F.lit(t)) for k, t in texts.items()})
    plain = long.replace(",", "")
    assert got == {"a": plain, "b": f"x {plain}, {plain} y", "c": "1234,56", "d": "1234,567x", "e": "a1,234", "f": "12345,678901"}


def test_stems_are_those_of_the_list_in_order(spark):
    words = [a + b for a in ("nat", "card", "mort", "stud", "x1y2z") for b in ["", *X.STEM_SUFFIXES, "ationss", "yes"]]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", X.stem(F.col("w")).alias("s"), X.significant_tokens(F.concat("w", F.lit(" 12 ab "), "w")).alias("t")).collect():
        assert r.s == X._stem(r.w)
        want = [(X._stem(r.w), r.w)] if len(r.w) >= 3 and X._stem(r.w) not in {X._stem(w) for w in X.STOPWORDS} else []
        assert [tuple(t) for t in r.t] == want
