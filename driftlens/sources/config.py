"""Settings: a small file of `key: value` lines, then the environment, then what the caller says."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

FILE, PREFIX = ".driftlens.yml", "DRIFTLENS_"
FAIL_ON = ("never", "destructive", "warning")
FORMATS = ("text", "github", "json")


class ConfigError(ValueError):
    """A setting that must not be guessed."""


@dataclass(frozen=True)
class Config:
    ignore_models: tuple[str, ...] = ()
    acknowledge_models: tuple[str, ...] = ()
    warning_exit_code: int = 2
    fail_on: str | None = None
    format: str = "text"
    no_color: bool = False
    verbose: bool = False
    dialect: str | None = None
    compile_command: str | None = None
    warnings: tuple[str, ...] = field(default=(), compare=False)


def _names(text: str) -> tuple[str, ...]:
    if text.startswith("[") != text.endswith("]"):
        raise ValueError(text)
    inner = text[1:-1] if text.startswith("[") else text
    return tuple(_bare(x.strip()) for x in inner.split(",") if x.strip())


def _flag(text: str) -> bool:
    low = text.lower()
    if low not in ("true", "1", "yes", "false", "0", "no"):
        raise ValueError(text)
    return low in ("true", "1", "yes")


def _code(text: str) -> int:
    if not 0 <= (n := int(text)) <= 255:
        raise ValueError(text)
    return n


def _matching(pattern: str) -> Callable[[str], str]:
    def read(text: str) -> str:
        if not re.fullmatch(pattern, text):
            raise ValueError(text)
        return text

    return read


READERS: dict[str, Callable[[str], object]] = {
    "ignore_models": _names,
    "acknowledge_models": _names,
    "warning_exit_code": _code,
    "fail_on": str,
    "format": _matching("|".join(FORMATS)),
    "no_color": _flag,
    "verbose": _flag,
    "dialect": _matching(r"[A-Za-z0-9]+"),
    "compile_command": _matching(r".+"),
}
_LISTS = ("ignore_models", "acknowledge_models")


def _bare(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def _uncommented(line: str) -> str:
    """The line up to a # that follows white space and lies outside of quotes."""
    m = re.match(r"""(?:"[^"]*"|'[^']*'|(?<!\s)\#|[^#"']|["'])*?(?=\s\#|$)""", line) if not line.lstrip().startswith("#") else None
    return m[0] if m else ""


def parse_file(text: str, path: str = FILE) -> tuple[dict[str, object], list[str]]:
    """(settings, warnings); a line that is not understood is told and left out."""
    found: dict[str, object] = {}
    warnings: list[str] = []
    block: tuple[str, int, list[str]] | None = None
    for number, raw in enumerate(text.lstrip("﻿").splitlines(), 1):
        line = _uncommented(raw)
        if not line.strip():
            continue
        depth = len(raw) - len(raw.lstrip())
        if block and depth > block[1]:
            item = re.fullmatch(r"-\s*(.*)", line.strip())
            if not item:
                warnings.append(f"{path}:{number}: cannot understand {block[0]} list item")
            elif item[1]:
                block[2].append(_bare(item[1]))
                found[block[0]] = tuple(block[2])
            continue
        block = None
        key, colon, value = (x.strip() for x in line.partition(":"))
        if not colon or key not in READERS:
            warnings.append(f"{path}:{number}: cannot understand {key if colon and key else 'setting'}")
        elif key in _LISTS and not value:
            found[key], block = (), (key, depth, [])
        else:
            try:
                found[key] = READERS[key](_bare(value))
            except ValueError:
                warnings.append(f"{path}:{number}: cannot understand {key}")
    return found, warnings


def load(folder: str | Path = ".", environ: Mapping[str, str] | None = None, **said: object) -> Config:
    """The settings of a folder; an unreadable file or a fail_on that is unknown is an error."""
    environ = os.environ if environ is None else environ
    path = Path(folder) / FILE
    try:
        text = path.read_text(encoding="utf-8") if path.exists() else ""
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"cannot read {path}: {e}") from e
    found, warnings = parse_file(text, str(path))
    for key, read in READERS.items():
        value = environ.get(PREFIX + key.upper(), "")
        if value:
            try:
                found[key] = read(value)
            except ValueError:
                warnings.append(f"{PREFIX}{key.upper()}: cannot understand {key}")
    config = replace(Config(warnings=tuple(warnings)), **found, **{k: v for k, v in said.items() if v is not None})
    if config.fail_on is not None and config.fail_on not in FAIL_ON:
        raise ConfigError(f"fail_on must be one of {', '.join(FAIL_ON)}")
    if config.warning_exit_code == 3:
        raise ConfigError("exit code 3 is kept for failures of the check itself")
    return config
