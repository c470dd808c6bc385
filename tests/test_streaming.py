from __future__ import annotations

import json

from siftwell.streaming import checks


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": i, "text": t, "source": "s", "created_at": "2024-01-01T00:00:00"} for i, t in ((1, "A fine sentence that is long enough to pass the checks."), (1, "again"), (2, ""))]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = checks.validated(checks.read_chunks(spark, f"file://{tmp_path}/in", "id long, text string, source string, metadata map<string,string>, created_at timestamp"))
    q = stream.select("id", "passed").writeStream.format("memory").queryName("checked").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = sorted((r.id, r.passed) for r in spark.table("checked").collect())
    assert [g[0] for g in got] == [1, 2] and got[1] == (2, False)
