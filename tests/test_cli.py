"""The command line from logs to an evaluation."""

import json

from spoor.__main__ import main


def test_logs_to_evaluation(spark, tmp_path):
    lines = []
    for i in range(400):
        minute, second = divmod(i, 60)
        bad = 200 <= i < 260
        lines.append(json.dumps({
            "time": f"2026-05-01T10:{minute:02d}:{second:02d}.000000001Z",
            "process_kprobe": {
                "process": {"exec_id": f"p{i % 4}", "pid": i % 4, "uid": 0, "binary": "/tmp/evil" if bad else "/usr/bin/ok", "cwd": "/", "ns": {"pid": {"inum": 4026533329}}},
                "function_name": "sys_ptrace" if bad and i % 2 else "tcp_connect", "args": [],
            },
        }))
    (tmp_path / "log.json").write_text("\n".join(lines))
    (tmp_path / "labels.csv").write_text("technique_id,trial,start_ts,end_ts\nT1,1,2026-05-01T10:03:20Z,2026-05-01T10:04:20Z\n")
    raw, table, out = str(tmp_path / "raw"), str(tmp_path / "table"), tmp_path / "out"
    main(["parse", "--input", str(tmp_path / "log.json"), "--output", raw])
    main(["enrich", "--input", raw, "--output", table])
    assert spark.read.parquet(raw).count() == spark.read.parquet(table).count() == 400
    out.mkdir()
    main(["evaluate", "--model", "ngram", "--train", table, "--test", table, "--labels", str(tmp_path / "labels.csv"), "--output", str(out)])
    e = json.loads((out / "evaluation.json").read_text())
    (tmp_path / "loocv").mkdir()
    main(["loocv", "--train", table, "--test", table, "--labels", str(tmp_path / "labels.csv"), "--output", str(tmp_path / "loocv"), "--rounds", "2", "--depth", "2"])
    assert spark.read.parquet(str(tmp_path / "loocv" / "scores")).count() == 400
    assert e["n_attack"] == 60 and e["n_events"] == 400 and e["auroc"] > 0.9 and e["auroc_ci_low"] <= e["auroc"] <= e["auroc_ci_high"]
    assert spark.read.parquet(str(out / "scores")).columns == ["event_time", "score", "is_attack", "technique_id"]
