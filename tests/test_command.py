import json

from sieveline.__main__ import main


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.txt").write_text("first\nNeedle here\nlast\n")
    (tmp_path / "b.txt").write_text("needle\n")
    folder, index = str(tmp_path), f"file://{tmp_path}/.index"
    assert main(["index", folder + "/src", index], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"generation": 1, "files": 1, "removed": []}
    assert main(["search", "needle", "--folder", folder, "--literal"], spark) == 0
    assert "b.txt:1: needle" in capsys.readouterr().out
    assert main(["search", "needle", "--index", index, "--literal", "--ignore-case", "--json"], spark) == 0
    row = json.loads(capsys.readouterr().out)
    assert (row["path"], row["line_no"], row["ranges"]) == ("a.txt", 2, [{"abs_start": 6, "abs_end": 12, "line_start": 0, "line_end": 6}])
    assert main(["search", "absent_thing", "--index", index], spark) == 1
    assert main(["search", "(?=x)", "--index", index], spark) == 2 and main(["search", "x"], spark) == 2
