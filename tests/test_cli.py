import contextlib
import io
import os

import pytest

from tessera.cli import main


@pytest.fixture
def run(spark, capsysbinary, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)

    def go(*argv):
        with contextlib.redirect_stderr(io.StringIO()):
            code = main([str(a) for a in argv])
        return code, capsysbinary.readouterr().out.decode()

    return go


def test_commands(run, tmp_path):
    os.makedirs(tmp_path / "in/sub")
    (tmp_path / "in/a.txt").write_bytes(b"The quick brown fox jumps over the lazy dog\n")
    (tmp_path / "in/sub/b.txt").write_bytes(b"The quick brown fox jumps over the lazy cat\n")
    a, b = tmp_path / "a.bin", tmp_path / "b.bin"
    assert run("create", a, "in", "-C", tmp_path, "--compression", "none")[0] == 0
    assert run("create", a, "in", "-C", tmp_path)[0] == 1
    assert run("list", a) == (0, "in/\nin/a.txt\nin/sub/\nin/sub/b.txt\n")
    assert run("get", a, "in/a.txt")[1].startswith("The quick") and run("get", a, "in/none")[0] == 1 and run("get", a, "in/sub")[0] == 1
    assert run("cat", a, "--all")[1].count("\n") == 2
    assert run("get", a, "--json", "in/a.txt")[1] == '[{"filename": "in/a.txt", "contents": "The quick brown fox jumps over the lazy dog\\n"}]\n'
    assert run("validate", a)[1] == "valid\n" and "files 4" in run("header", a)[1]
    assert run("index", a, "--with", "bit_width=32", "-o", tmp_path / "i")[0] == 0
    assert run("search", a, "-i", tmp_path / "i", "--with", "file=in/a.txt")[1] == "1.0000 in/a.txt\n0.8047 in/sub/b.txt\n"
    assert run("redact", a, "in/a.txt", "-o", b)[0] == 0 and run("get", b, "in/a.txt")[1] == "" and run("validate", b)[0] == 0
    assert "modified: 1 files" in run("diff", a, b)[1]
    assert run("extract", a, "-o", tmp_path / "out", "--strip-components", 1)[0] == 0 and (tmp_path / "out/sub/b.txt").exists()


def test_exit_codes(run, tmp_path):
    assert run()[0] == 2 and run("get")[0] == 2 and run("header", tmp_path / "none")[0] == 1
    (tmp_path / "junk").write_bytes(b"x" * 100)
    assert run("header", tmp_path / "junk")[0] == 65
    assert run("version") == (0, "0.1.1\n")
    assert len(run("hash", tmp_path / "junk")[1]) == 17
