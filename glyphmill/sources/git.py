"""What git knows about a repository, by its command line."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass
from pathlib import Path

from glyphmill.functions.ids import repo_id
from glyphmill.schema import EXTENSIONS, RepoNotFoundError

DEFAULT_BRANCH = "default"


@dataclass(frozen=True)
class RepoContext:
    root: Path
    repo_id: str
    branch: str
    commit: str | None


def _git(root: Path, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, timeout=120, check=False)
    except OSError:
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def is_git_repo(root: Path) -> bool:
    return (_git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def current_commit(root: Path) -> str | None:
    return (_git(root, "rev-parse", "--verify", "-q", "HEAD") or "").strip() or None


def branch_of(root: Path) -> str:
    """The branch; ``detached-<commit>`` without one, ``default`` outside of git."""
    if not is_git_repo(root):
        return DEFAULT_BRANCH
    name = (_git(root, "rev-parse", "--abbrev-ref", "HEAD") or "").strip()
    if name == "HEAD" and (commit := current_commit(root)):
        return f"detached-{commit}"
    return name if name and name != "HEAD" else (_git(root, "branch", "--show-current") or "").strip() or DEFAULT_BRANCH


def repo_context(root: str | Path) -> RepoContext:
    path = Path(root).resolve()
    if not path.is_dir():
        raise RepoNotFoundError(f"no such directory: {path}")
    return RepoContext(path, repo_id(path), branch_of(path), current_commit(path) if is_git_repo(path) else None)


def changed_files(root: Path, since: str) -> dict[str, list[str]] | None:
    """Committed changes since a commit by type, of files in known languages; none if git can't tell."""
    out = {}
    for flag, name in (("A", "added"), ("M", "modified"), ("D", "deleted")):
        listed = _git(root, "diff", "--name-only", "--no-renames", f"--diff-filter={flag}", "-z", since, "HEAD")
        if listed is None:
            return None
        out[name] = sorted({p for p in listed.split("\0") if p.rpartition(".")[2] in EXTENSIONS})
    return out
