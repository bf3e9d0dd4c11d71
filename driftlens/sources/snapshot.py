"""Baseline snapshots: a digest of every file, staged publishing with a way back, layouts."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import posixpath
import shutil
import stat
import tempfile
from collections.abc import Iterator
from pathlib import Path

INVENTORY, VERSION = "inventory.json", 1


class SnapshotError(ValueError):
    """A snapshot that cannot be trusted."""


def canonical(path: object) -> str:
    """A relative POSIX path without steps upwards, or an error."""
    ok = isinstance(path, str) and path and "\\" not in path and "\0" not in path and not path.startswith("/") and posixpath.normpath(path) == path
    if not ok or path.split("/")[0] in ("..", ".") or ":" in path.split("/")[0]:
        raise SnapshotError(f"not a canonical path: {path!r}")
    return path


def files(root: Path) -> Iterator[str]:
    """Relative paths of all regular files, sorted; links and special files are refused."""
    out = []
    for folder, names, own in os.walk(root):
        for name in [*names, *own]:
            mode = os.lstat(os.path.join(folder, name)).st_mode
            if not (stat.S_ISREG(mode) or stat.S_ISDIR(mode)):
                raise SnapshotError(f"link or special file: {name}")
        out += [Path(folder, name).relative_to(root).as_posix() for name in own]
    yield from sorted(canonical(p) for p in out if p != INVENTORY)


def sha256(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_inventory(root: Path) -> None:
    entries = [{"path": p, "sha256": sha256(root / p)} for p in files(root)]
    (root / INVENTORY).write_text(json.dumps({"version": VERSION, "files": entries}, indent=1))


def verify(root: Path) -> str:
    """verified or unrecorded; anything that differs from the inventory is an error."""
    record = root / INVENTORY
    if not record.exists():
        return "unrecorded"

    def unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
        if len(dict(pairs)) != len(pairs):
            raise SnapshotError("a key occurs twice")
        return dict(pairs)

    try:
        data = json.loads(record.read_text(), object_pairs_hook=unique)
    except (OSError, ValueError) as e:
        raise SnapshotError(f"unreadable inventory: {e}") from e
    if not isinstance(data, dict) or set(data) != {"version", "files"} or data["version"] != VERSION or not isinstance(data["files"], list):
        raise SnapshotError("unknown inventory")
    paths = [canonical(e.get("path")) if isinstance(e, dict) and set(e) == {"path", "sha256"} else canonical(None) for e in data["files"]]
    if paths != sorted(set(paths)):
        raise SnapshotError("paths are not sorted and unique")
    if "manifest.json" not in paths:
        raise SnapshotError("no manifest")
    if list(files(root)) != paths:
        raise SnapshotError("files were added or removed")
    changed = [e["path"] for e in data["files"] if sha256(root / e["path"]) != e["sha256"]]
    if changed:
        raise SnapshotError(f"changed: {', '.join(changed)}")
    return "verified"


@contextlib.contextmanager
def staged(target: Path) -> Iterator[Path]:
    """A folder to fill; what it holds is recorded, verified and put in target's place, or target stays as it was."""
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=f".{target.name}-", dir=target.parent))
    backup = stage.with_name(stage.name + ".old")
    try:
        yield stage
        write_inventory(stage)
        verify(stage)
        if target.exists():
            target.rename(backup)
        try:
            stage.rename(target)
        except BaseException:
            if backup.exists():
                backup.rename(target)
            raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
        if target.exists():
            shutil.rmtree(backup, ignore_errors=True)


def take(project: Path, target: Path, compiled: str = "target/compiled", manifest: str = "target/manifest.json") -> None:
    """Publishes the project's compiled statements and manifest as the baseline."""
    source = compiled_folder(project / compiled, project / manifest)
    with staged(target) as stage:
        shutil.copytree(source, stage / "compiled", symlinks=True)
        shutil.copyfile(project / manifest, stage / "manifest.json")


def compiled_folder(compiled: Path, manifest: Path) -> Path:
    """The folder of one project's statements: that which the manifest names where there are several."""
    own = [p for p in sorted(compiled.iterdir()) if p.is_dir()] if compiled.is_dir() else []
    if not own:
        raise SnapshotError(f"nothing compiled in {compiled}")
    if len(own) == 1:
        return own[0]
    try:
        name = (json.loads(manifest.read_text()).get("metadata") or {}).get("project_name")
    except (OSError, ValueError):
        name = None
    named = [p for p in own if p.name == name]
    if not named:
        raise SnapshotError(f"several projects in {compiled}")
    return named[0]
