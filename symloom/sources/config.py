"""Settings from TOML, with a default for each."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from typing import ClassVar

from symloom.sources.filters import GLOBS, LANGUAGES, Rules

# Fixed value: the default list of languages before tsx was one; a file that holds it exactly is brought up to date.
_BEFORE_TSX = ["python", "typescript", "javascript", "rust", "go", "java", "c", "cpp", "ruby"]


@dataclass
class Config:
    languages: list[str] = field(default_factory=lambda: list(LANGUAGES))
    exclude_patterns: list[str] = field(default_factory=lambda: list(GLOBS))
    include_tests: bool = False
    max_file_size_kb: int = 512
    default_token_budget: int = 32_000
    debounce_ms: int = 200

    _SECTIONS: ClassVar[dict] = {"index": ("languages", "exclude_patterns", "include_tests", "max_file_size_kb"), "compression": ("default_token_budget",), "watcher": ("debounce_ms",)}

    @classmethod
    def load(cls, path: str) -> Config:
        """The file's settings; all defaults where there is none or it can't be read."""
        if not os.path.exists(path):
            return cls()
        try:
            with open(path, "rb") as f:
                data = tomllib.load(f)
        except (OSError, tomllib.TOMLDecodeError):
            return cls()
        got = {k: data.get(section, {})[k] for section, keys in cls._SECTIONS.items() for k in keys if k in data.get(section, {})}
        out = cls(**got)
        if out.languages == _BEFORE_TSX:
            out.languages = [*_BEFORE_TSX[:2], "tsx", *_BEFORE_TSX[2:]]
        return out

    def save(self, path: str) -> None:
        def value(v: object) -> str:
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, str):
                return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
            return "[" + ", ".join(map(value, v)) + "]" if isinstance(v, list) else str(v)

        with open(path, "w", encoding="utf-8") as f:
            for section, keys in self._SECTIONS.items():
                f.write(f"[{section}]\n" + "".join(f"{k} = {value(getattr(self, k))}\n" for k in keys) + "\n")

    def rules(self) -> Rules:
        return Rules(self.languages, self.exclude_patterns, self.include_tests, self.max_file_size_kb)
