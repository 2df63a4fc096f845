"""Settings: a YAML tree over defaults, with dotted lookup and ${VAR} replaced in its SECURITY part."""

from __future__ import annotations

import os
import re
from pathlib import Path
from typing import Any

from lexiforge.errors import ConfigError

DEFAULTS: dict[str, Any] = {
    "FILE_SCANNER": {"DOCUMENT_PATH": "./docs", "ALLOWED_EXTENSIONS": [], "EXCLUDE_PATTERNS": [], "HASH_ALGORITHM": "sha256"},
    "DOCUMENT_PROCESSING": {"MAX_CHUNK_SIZE": 3072, "MIN_CHUNK_SIZE": 1024, "CHUNK_OVERLAP": 768},
    "EMBEDDING_MODEL": {"BATCH_SIZE": 32, "DIMENSIONS": 768, "EMBEDDING_RATE_LIMITER": {"MAX_CALLS": 500, "PERIOD_SECONDS": 60}},
    "VECTOR_STORE": {"PERSIST_DIRECTORY": "./data/vector_store", "COLLECTION_NAME": "corpus", "DISTANCE_METRIC": "cosine", "TOP_K": 40},
    "QUERY": {
        "TOP_K": 40, "MIN_SIMILARITY": 0.2, "TAG_MATCH_MIN_SIMILARITY": 0.1, "RECENCY_BOOST": 1.0, "TAG_BOOST": 1.5,
        "SOURCE_BOOST": 1.0, "PREFERRED_SOURCES": [], "CONTEXT_WINDOW": 4096, "TEMPERATURE": 0.2, "MAX_TOKENS": 512, "USER_QUESTION_CAPTURE": True,
    },
    "USER_INTERACTION_DIRECTORY": "./data/user_interaction/",
}


class Config:
    def __init__(self, tree: dict[str, Any] | None = None):
        self.tree = tree or {}

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        if not Path(path).is_file():
            raise ConfigError(f"no such file: {path}")
        try:
            tree = yaml.safe_load(Path(path).read_text()) or {}
        except yaml.YAMLError as e:
            raise ConfigError(str(e)) from e
        for k, x in (tree.get("SECURITY") or {}).items():
            if isinstance(x, str):
                tree["SECURITY"][k] = re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), x)
        return cls(tree)

    def get(self, path: str, default: Any = None) -> Any:
        for tree in (self.tree, DEFAULTS):
            node: Any = tree
            for part in path.split("."):
                node = node.get(part) if isinstance(node, dict) else None
            if node is not None:
                return node
        return default
