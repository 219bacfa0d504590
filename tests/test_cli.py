from maskwright import __version__
from maskwright.__main__ import main


def test_commands_without_a_session(tmp_path, capsys):
    assert main(["version"]) == 0 and capsys.readouterr().out.strip() == __version__
    assert main(["list-detectors"]) == 0 and "handle\tHANDLE\t80" in capsys.readouterr().out
    assert main(["init-key", str(tmp_path / "k")]) == 0 and (tmp_path / "k").exists()


def test_run_restore_inspect(spark, tmp_path, capsys, monkeypatch):
    main(["init-key", str(tmp_path / "k")])
    (tmp_path / "a.txt").write_text("an a@b.de", "utf-8")
    out = str(tmp_path / "out")
    assert main([str(tmp_path / "a.txt"), "--output", out, "--key-file", str(tmp_path / "k")]) == 0
    assert "(1 replacements)" in capsys.readouterr().out
    assert main(["restore", out, "--output", str(tmp_path / "back")]) == 0
    assert spark.read.parquet(str(tmp_path / "back")).first().text == "an a@b.de"
    assert main(["inspect", out]) == 0 and "\tEMAIL\ta@b.de" in capsys.readouterr().out
    assert main([str(tmp_path / "a.txt"), "--output", out, "--key-file", str(tmp_path / "none")]) == 3
