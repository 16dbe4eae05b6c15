"""Command line and hook on a small repository."""

import json
import subprocess

import pytest

from plinth import cli, hook


@pytest.fixture
def repo(tmp_path):
    for args in (["init", "-q"], ["config", "user.email", "a@b.c"], ["config", "user.name", "n"]):
        subprocess.run(["git", "-C", tmp_path, *args], check=True)
    (tmp_path / "a.py").write_text("def f(x):\n    return x\n")
    (tmp_path / "b.py").write_text("from a import f\n\n\ndef main():\n    return f(1)\n")
    subprocess.run(["git", "-C", tmp_path, "add", "."], check=True)
    subprocess.run(["git", "-C", tmp_path, "commit", "-qm", "one"], check=True)
    return tmp_path


def test_hook_lifecycle(repo):
    path = repo / ".git/hooks/pre-commit"
    path.parent.mkdir(exist_ok=True)
    path.write_text("#!/bin/sh\necho mine\n")
    hook.install(str(repo))
    hook.install(str(repo))
    assert path.read_text().count(hook.BEGIN) == 1 and "echo mine" in path.read_text()
    assert hook.uninstall(str(repo)) and path.read_text() == "#!/bin/sh\necho mine\n"
    assert hook.config(str(repo)) == hook.DEFAULTS and hook.config(str(repo), mode="warn")["mode"] == "warn"


def test_staged_text_wins(spark, repo, monkeypatch, capsys):
    (repo / "a.py").write_text("def f(x, y):\n    return x\n")
    subprocess.run(["git", "-C", repo, "add", "a.py"], check=True)
    (repo / "a.py").write_text("def f(x, y=1):\n    return x\n")
    assert hook.run(str(repo)) == 1 and "ARITY_MISMATCH" in capsys.readouterr().out
    hook.config(str(repo), mode="warn")
    assert hook.run(str(repo)) == 0
    monkeypatch.setenv("PLINTH_SKIP", "1")
    hook.config(str(repo), mode="block")
    assert hook.run(str(repo)) == 0


def test_commands(spark, repo, capsys, monkeypatch):
    assert cli.main(["perf-lint", "--root", str(repo)]) == 0
    assert cli.main(["dead-code", "--root", str(repo)]) == 0
    capsys.readouterr()
    assert cli.main(["slice", "main", "--root", str(repo)]) == 0
    assert {n["node"] for n in json.loads(capsys.readouterr().out)["nodes"]} == {"b.py::main", "a.py::f"}
    (repo / "p").write_text("def f(x, y):\n    return x\n")
    assert cli.main(["verify", "a.py", "--replacement", "--patch-file", str(repo / "p"), "--root", str(repo)]) == 1
    (repo / "p").write_text("")
    assert cli.main(["verify", "a.py", "--patch-file", str(repo / "p"), "--root", str(repo)]) == 2
