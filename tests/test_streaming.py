"""Streamed result rows."""

import json
import math

from kinfold.streaming import results


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("ts", "condition", "loss", "tokens"), r))) + "\n" for r in rows))

    def run():
        stream = results.read_results(spark, str(tmp_path / "in"), "ts string, condition string, loss double, tokens long", 1)
        results.log_metrics(results.windowed_nll(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        return {(str(r.start)[11:16], r.condition): (r.nll, r.tokens) for r in spark.read.schema("start timestamp, end timestamp, condition string, nll double, tokens long").json(str(tmp_path / "out")).collect()}

    put("a.json", [("2024-01-01 00:01:00", "clean", 1.0, 1), ("2024-01-01 00:02:00", "clean", 2.0, 3), ("2024-01-01 00:03:00", "leak", 5.0, 2)])
    put("b.json", [("2024-01-01 00:45:00", "clean", 9.0, 1)])
    first = run()
    assert math.isclose(first["00:00", "clean"][0], 1.75) and first["00:00", "leak"] == (5.0, 2) and ("00:40", "clean") not in first
    put("c.json", [("2024-01-01 00:04:00", "clean", 100.0, 1), ("2024-01-01 01:30:00", "clean", 1.0, 1)])
    second = run()
    assert second["00:00", "clean"] == first["00:00", "clean"] and second["00:40", "clean"] == (9.0, 1)
