"""Settings of an engine: strict names and kinds, with defaults."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class Config:
    enabled: bool = True
    searchMaxBytes: int = 6144
    debounceMs: int = 300
    generationRetention: int = 3
    quotaBytes: int = 128 * 1024 * 1024
    excludePatterns: list[str] = field(default_factory=list)

    def __post_init__(self):
        if not isinstance(self.enabled, bool):
            raise ValueError("enabled must be a boolean")
        for k in ("searchMaxBytes", "debounceMs", "generationRetention", "quotaBytes"):
            v = getattr(self, k)
            if isinstance(v, bool) or not isinstance(v, int) or not 0 < v < 2**53:
                raise ValueError(f"{k} must be a positive safe integer")
        if self.searchMaxBytes < 512:
            raise ValueError("searchMaxBytes must be at least 512 bytes")
        if not isinstance(self.excludePatterns, list) or any(not isinstance(p, str) or not p.strip() for p in self.excludePatterns):
            raise ValueError("excludePatterns must be an array of non-empty strings")

    @staticmethod
    def parse(text: str | None) -> Config:
        """Settings from JSON text; None means there is no file."""
        if text is None:
            return Config()
        values = json.loads(text)
        if not isinstance(values, dict):
            raise ValueError("configuration must be a JSON object")
        unknown = set(values) - {f.name for f in fields(Config)}
        if unknown:
            raise ValueError(f"unknown option: {', '.join(sorted(unknown))}")
        return Config(**values)

    def build_key(self) -> str:
        """Builds under equal keys can take over each other's files: versions of what analyses, and the exclusions."""
        facts = {"build": 1, "schema": 1, "analyzers": {"script": 1, "java": 1}, "exclude": sorted(set(self.excludePatterns))}
        return hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()

    def as_dict(self) -> dict:
        return asdict(self)


def project_id(root: str) -> str:
    """The first 32 hex digits of the root's sha256."""
    return hashlib.sha256(root.encode()).hexdigest()[:32]
