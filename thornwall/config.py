"""Scan settings: defaults, overlaid by a TOML file, overlaid by the command line."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from .schema import MEDIUM, SEVERITIES


@dataclass
class DetectorConfig:
    heuristic: bool = True
    hidden_chars: bool = True
    encoded: bool = True
    canary: bool = True
    perplexity: bool = True
    embedding: bool = False
    llm_classifier: bool = False
    extra_rules: list[str] = field(default_factory=list)
    extra_canaries: list[str] = field(default_factory=list)
    embedding_model: str | None = None
    embedding_tokenizer: str | None = None
    embedding_bundled: bool = False
    llm_base_url: str | None = None
    llm_model: str | None = None
    llm_api_key_env: str | None = None


@dataclass
class ScanConfig:
    rev: str = "HEAD"
    fail_on: int = MEDIUM
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    use_default_excludes: bool = True
    no_clone: bool = False
    keep: bool = False
    since: str | None = None
    quarantine: bool = False
    ignore_file: str = ".thornwall-ignore"
    quiet: bool = False
    jobs: int = field(default_factory=lambda: os.cpu_count() or 1)
    max_binary_bytes: int = 1 << 20
    detectors: DetectorConfig = field(default_factory=DetectorConfig)

    def merge_file(self, path: str) -> None:
        """Overlay a TOML file: single values replace, lists are added to."""
        with open(path, "rb") as f:
            data = tomllib.load(f)
        scan, found = data.get("scan", {}), data.get("detectors", {})
        self.max_binary_bytes = int(scan.get("max_binary_bytes", self.max_binary_bytes))
        self.jobs = int(scan.get("jobs", self.jobs))
        if "fail_on" in scan:
            if scan["fail_on"] not in SEVERITIES:
                raise ValueError(f"unknown severity {scan['fail_on']!r} in {path}")
            self.fail_on = SEVERITIES.index(scan["fail_on"])
        self.include += scan.get("include", [])
        self.exclude += scan.get("exclude", [])
        own = self.detectors
        for name in ("heuristic", "hidden_chars", "encoded", "canary", "perplexity", "embedding", "llm_classifier"):
            setattr(own, name, found.get(name, {}).get("enabled", getattr(own, name)))
        own.extra_rules += found.get("heuristic", {}).get("extra_rules", [])
        own.extra_canaries += found.get("canary", {}).get("tokens", [])
        similar, judge = found.get("embedding", {}), found.get("llm_classifier", {})
        own.embedding_model = similar.get("model", own.embedding_model)
        own.embedding_tokenizer = similar.get("tokenizer", own.embedding_tokenizer)
        own.embedding_bundled = similar.get("bundled", own.embedding_bundled)
        own.llm_base_url = judge.get("base_url", own.llm_base_url)
        own.llm_model = judge.get("model", own.llm_model)
        own.llm_api_key_env = judge.get("api_key_env", own.llm_api_key_env)
