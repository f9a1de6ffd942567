"""Lines written between the last run and a rotation are read from the renamed file."""

import os

from sievelog.sources.tail import tail


def test_a_rotated_file_is_drained(spark, tmp_path):
    root, out, check = tmp_path / "pods", str(tmp_path / "out"), str(tmp_path / "check")
    folder = root / "prod_web_u1" / "app"
    folder.mkdir(parents=True)

    def drain():
        for _ in range(2):
            tail(spark, str(root)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["line"] for r in spark.read.parquet(out).collect())

    (folder / "0.log.never").write_text("before the first run\n")
    (folder / "0.log").write_text("1 first\n")
    assert drain() == ["1 first"]
    with open(folder / "0.log", "a") as f:
        f.write("2 appended\n3 appended\n")
    os.rename(folder / "0.log", folder / "0.log.20260530-120000")
    (folder / "0.log").write_text("4 new\n")
    assert drain() == ["1 first", "2 appended", "3 appended", "4 new"]
    with open(folder / "0.log.20260530-120000", "a") as f:  # a writer that has not reopened yet
        f.write("5 late\n")
    assert drain() == ["1 first", "2 appended", "3 appended", "4 new", "5 late"] == drain()
