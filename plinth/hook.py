"""Pre-commit hook: install and remove without touching what else stands in the hook file, switch, run on staged files."""

from __future__ import annotations

import json
import os
import stat

from .sources.records_io import dirty, git, staged

BEGIN, END = "# >>> plinth >>>", "# <<< plinth <<<"
_BODY = "python -m plinth.cli hook run || exit 1"
DEFAULTS = {"enabled": True, "mode": "block"}


def _paths(repo: str) -> tuple[str, str]:
    top = git(repo, "rev-parse", "--git-dir").strip()
    top = top if os.path.isabs(top) else os.path.join(repo, top)
    return os.path.join(top, "hooks", "pre-commit"), os.path.join(repo, ".plinth.json")


def config(repo: str, **changes: object) -> dict:
    """The settings, after ``changes``; written beside and renamed over."""
    path = _paths(repo)[1]
    try:
        with open(path) as f:
            found = DEFAULTS | json.load(f)
    except (OSError, ValueError):
        found = dict(DEFAULTS)
    if changes:
        found |= changes
        with open(path + ".tmp", "w") as f:
            json.dump(found, f)
        os.replace(path + ".tmp", path)
    return found


def install(repo: str) -> str:
    path = _paths(repo)[0]
    uninstall(repo)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    before = open(path).read() if os.path.exists(path) else "#!/bin/sh\n"
    with open(path, "w") as f:
        f.write(before.rstrip("\n") + f"\n{BEGIN}\n{_BODY}\n{END}\n")
    os.chmod(path, os.stat(path).st_mode | stat.S_IXUSR)
    return path


def uninstall(repo: str) -> bool:
    path = _paths(repo)[0]
    if not os.path.exists(path):
        return False
    text = open(path).read()
    if BEGIN not in text:
        return False
    head, rest = text.split(BEGIN, 1)
    left = head.rstrip("\n") + "\n" + rest.split(END, 1)[-1].lstrip("\n")
    if left.strip() in ("", "#!/bin/sh"):
        os.remove(path)
    else:
        with open(path, "w") as f:
            f.write(left)
    return True


def run(repo: str) -> int:
    """0 to let the commit by; staged Python files are judged together, and in mode ``warn`` never stop it."""
    settings = config(repo)
    if os.environ.get("PLINTH_SKIP") or not settings["enabled"]:
        return 0
    texts = [s for s in staged(repo) if s[0].endswith(".py")]
    if not texts:
        return 0
    from .cli import session, workspace
    from .operators.verify import verify

    spark = session()
    files = workspace(spark, repo)
    changes = spark.createDataFrame([("commit", path, new, True) for path, new, _ in texts], "patch_id string, file_path string, patch string, is_replacement boolean")
    # Staged files are judged against what is committed; what is staged stands for other dirty working copies.
    base = {path: text for path, text in dirty(repo)} | {path: old for path, _, old in texts}
    overlays = spark.createDataFrame(sorted(base.items()), "file_path string, content string")
    rejected = False
    for row in verify(files, changes, overlays=overlays).collect():
        rejected |= row.status == "REJECTED"
        print(f"{row.file_path}: {row.status}" + "".join(f"\n  {v}" for v in row.violations))
    return int(rejected and settings["mode"] == "block")
