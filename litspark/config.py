"""Settings, from the environment."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def _env(name: str, default: str):  # noqa: ANN202
    return field(default_factory=lambda: os.environ.get(f"LITSPARK_{name}", default))


@dataclass
class Config:
    home: str = _env("HOME", "./state")
    provider: str = _env("PROVIDER", "auto")
    model: str = _env("MODEL", "qwen2.5:7b")
    server: str = _env("SERVER", "http://127.0.0.1:11434")
    context_tokens: int = field(default_factory=lambda: int(os.environ.get("LITSPARK_CONTEXT_TOKENS", "8000")))
    output_reserve: int = field(default_factory=lambda: int(os.environ.get("LITSPARK_OUTPUT_RESERVE", "1500")))
    feed_delay: float = field(default_factory=lambda: float(os.environ.get("LITSPARK_FEED_DELAY", "3.0")))
    page_delay: float = field(default_factory=lambda: float(os.environ.get("LITSPARK_PAGE_DELAY", "16.0")))
    user_agent: str = _env("USER_AGENT", "litspark/0.1 (research use)")

    @property
    def store(self) -> str:
        return f"{self.home}/store"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir. Where that is unset, one of this machine in local mode; a cluster has none to share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="litspark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
