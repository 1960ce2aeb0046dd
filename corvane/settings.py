"""Settings from the environment (SCL-11): CORVANE_<NAME>, typed, with defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime


@dataclass
class Settings:
    notes_dir: str = ""
    longform_dir: str = ""
    tables_dir: str = "corvane-tables"
    embedding_dim: int = 64
    skip_folders: list[str] = field(default_factory=lambda: ["node_modules", "__pycache__", "templates"])
    exclude: list[str] = field(default_factory=list)
    path_weights: dict[str, float] = field(default_factory=dict)
    archive_folder: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Lists are comma-separated; mappings are JSON, in the variable or in the file that it names."""
        env, given = dict(os.environ if env is None else env), {}
        for f in fields(cls):
            raw = env.get(f"CORVANE_{f.name.upper()}")
            if raw is None:
                continue
            kind = str(f.type)
            if kind.startswith("list"):
                given[f.name] = [x.strip() for x in raw.split(",") if x.strip()]
            elif kind.startswith("dict"):
                if os.path.isfile(raw):
                    with open(raw, encoding="utf-8") as file:
                        raw = file.read()
                given[f.name] = {k: float(v) for k, v in json.loads(raw or "{}").items() if not k.startswith("_")}
            else:
                given[f.name] = int(raw) if kind == "int" else os.path.expanduser(raw) if f.name.endswith("_dir") else raw
        return cls(**given)


def now_iso() -> str:
    """SCL-8."""
    return datetime.now(UTC).isoformat()
