"""g17_two_passes against its SQL on tables in which tracks are left without a centroid."""

import os

import pytest

from tracewell.queries import judging
from tracewell.queries.book import table

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def compared(spark, folder, lineitem, embeddings):
    """Rows of the query over the two tables, given as SELECTs over the driver's, and those of its SQL."""
    own = duckdb.connect()
    for name, made in (("lineitem", lineitem), ("embeddings", embeddings)):
        own.execute(f"COPY ({made.format(f'{SF}/{name}.parquet')}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    names = ["track_id", "frame_idx", "reason", "cos_self", "cos_other"]
    want = own.execute(f"SELECT {', '.join(names)} FROM ({judging.BOOK.sql['g17_two_passes']})").fetchall()
    got = [tuple(r[n] for n in names) for r in judging.g17(spark, str(folder)).collect()]
    plain = lambda rows: sorted((tuple(0.0 if x == 0 else "none" if x != x else x for x in r) for r in rows), key=repr)
    return plain(got), plain(want)


def test_tracks_without_a_centroid(spark, tmp_path):
    # of clip 3 only supplier 93 has frames enough for a centroid, of clip 4 none; most frames that are left lack a blink, so that only their identity can make them valid
    few = "SELECT * FROM '{}' WHERE l_suppkey % 10 NOT IN (3, 4) OR l_suppkey = 93 OR l_linenumber = 5 OR l_orderkey % 20 = 0"
    got, want = compared(spark, tmp_path, few, "SELECT * FROM '{}'")
    assert got == want
    lone = [r for r in got if r[3] is None]
    assert {r[0] % 10 for r in lone} == {3, 4} and {r[0] % 10 for r in lone if r[4] is None} == {4}


def test_awkward_vectors_and_tracks(spark, tmp_path):
    # ids that are there twice, one without a vector, one of length 0 that only clips 0 to 4 can meet, numbers that are missing; lines without a supplier
    lines = "SELECT * REPLACE (CASE WHEN l_orderkey % 50 <> 0 THEN l_suppkey END AS l_suppkey) FROM '{}' WHERE l_suppkey < 40"
    vectors = """SELECT * FROM '{0}' WHERE vec_id % 7 <> 3 UNION ALL SELECT vec_id, list_reverse(embedding), label FROM '{0}' WHERE vec_id % 5 = 0
        UNION ALL SELECT 3, NULL, 0 UNION ALL SELECT vec_id, list_transform(embedding, lambda x: x * 0), 0 FROM '{0}' WHERE vec_id = 10"""
    got, want = compared(spark, tmp_path, lines, vectors)
    assert got == want and len(got) > 20_000
    assert any(r[3] == "none" for r in got) and any(isinstance(r[3], float) for r in got) and any(r[3] is None for r in got)


def shuffled(spark):
    """Bytes that all stages of the session have written for others."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_frames_travel_without_vectors(spark):
    before, n = shuffled(spark), table(spark, SF, "lineitem").count()
    judging.g17(spark, SF).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    # a vector has 256 bytes as it is stored
    assert sum(b for i, b in shuffled(spark).items() if i not in before) < 256 * n
