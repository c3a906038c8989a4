import json

from docketspark import cli


def test_list_and_run(spark, small, capsys):
    assert cli.main(["list"]) == 0 and "rrf_fusion" in capsys.readouterr().out
    assert cli.main(["--json", "run", "coverage_counts", small, "--limit", "3"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 3
    assert cli.main(["run", "nothing", small]) == 2


def test_health_and_validate(spark, small, tmp_path, capsys):
    assert cli.main(["health", small]) == 0 and cli.main(["health", str(tmp_path)]) == 1
    assert cli.main(["validate", small, "--output", str(tmp_path / "r.md")]) == 1
    assert (tmp_path / "r.md").read_text().startswith("# Validation")


def test_ask_eval_and_ingest(spark, small, tmp_path, capsys):
    words = [w for w in spark.read.parquet(f"{small}/documents.parquet").filter("lang = 'en' and n_chars > 500").first()["text"].split() if w.isalpha() and len(w) > 7][:3]
    code = cli.main(["--json", "ask", small, " ".join(words), "--top", "3", "--index", str(tmp_path / "index")])
    out = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert 1 < len(out) <= 4 and out[0]["rank"] == 1 and code == (0 if out[-1]["outcome"] == "answered" else 1)
    assert cli.main(["ask", small, "zzzzqqqq xxxxjjjj"]) == 1
    capsys.readouterr()
    assert cli.main(["--json", "eval", small]) == 0 and "pass_rate" in capsys.readouterr().out
    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")):
        (tmp_path / "in" / name).write_text(text)
    for _ in range(2):
        assert cli.main(["--json", "ingest", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
        assert json.loads(capsys.readouterr().out) == {"stored": 2}
