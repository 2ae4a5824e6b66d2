"""Entity types, span structure and settings."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The entity types by layer.
DETERMINISTIC_TYPES = (
    "SSN", "ITIN", "EIN", "CREDIT_CARD", "ROUTING_NUMBER", "BANK_ACCOUNT", "IP_ADDRESS", "MAC_ADDRESS", "API_KEY",
    "PRIVATE_KEY", "JWT", "DATE_OF_BIRTH", "DEVICE_ID", "CREDENTIAL", "MEDICAL_ID", "HEALTH_INFORMATION", "FINANCIAL_INFORMATION",
)
SHARED_TYPES = ("EMAIL", "PHONE", "URL")
MODEL_TYPES = (
    "GIVEN_NAME", "SURNAME", "TAX_ID", "GOVERNMENT_ID", "PASSPORT", "DRIVERS_LICENSE", "BUILDING_NUMBER", "STREET_NAME",
    "SECONDARY_ADDRESS", "CITY", "STATE", "ZIP_CODE",
)
CUSTOM_TYPE = "CUSTOM"
ALL_TYPES = (*DETERMINISTIC_TYPES, *SHARED_TYPES, *MODEL_TYPES, CUSTOM_TYPE)
PUBLIC_TYPES = ("CITY", "STATE", "ZIP_CODE", "URL")
RELEASE_BLOCKING_TYPES = ("SSN", "EIN", "CREDIT_CARD", "ROUTING_NUMBER", "BANK_ACCOUNT", "API_KEY", "PRIVATE_KEY", "JWT")

#: Offsets are code points, end exclusive; ``rank`` is the place of the rule that found the span.
SPAN = "struct<start:int,end:int,entity_type:string,text:string,confidence:double,source:string,rank:int>"


@dataclass(frozen=True)
class Settings:
    """What a run detects, keeps, skips and limits."""

    enable_rules: bool = True
    enable_model: bool = False
    model_id: str = ""
    model_confidence: float = 0.5
    type_thresholds: dict[str, float] = field(default_factory=lambda: {"SECONDARY_ADDRESS": 0.85, "STREET_NAME": 0.85, "BUILDING_NUMBER": 0.85})
    public_types: tuple[str, ...] = PUBLIC_TYPES
    custom_keywords: tuple[str, ...] = ()
    allow_globs: tuple[str, ...] = ()
    deny_globs: tuple[str, ...] = ()
    skip_globs: tuple[str, ...] = ("**/node_modules/**", "**/.git/**", "**/__pycache__/**", "**/*.lock")
    max_file_bytes: int = 20 * 1024 * 1024
    cache_max_bytes: int = 500 * 1024 * 1024
    fail_mode: str = "closed"
    propagate: bool | None = None

    def __post_init__(self):
        if self.fail_mode not in ("closed", "open"):
            raise ValueError(f"fail_mode is 'closed' or 'open', not {self.fail_mode!r}")
        for name in (*self.public_types, *self.type_thresholds):
            if name not in ALL_TYPES:
                raise ValueError(f"unknown entity type {name!r}")

    @property
    def propagates(self) -> bool:
        """Values spread only where a model takes part, unless asked for."""
        return self.enable_model if self.propagate is None else self.propagate

    @classmethod
    def from_toml(cls, text: str) -> Settings:
        import tomllib

        t = tomllib.loads(text)
        engines, entities, paths = t.get("engines", {}), t.get("entities", {}), t.get("paths", {})
        given = {
            "enable_rules": engines.get("regex"),
            "enable_model": engines.get("model"),
            "model_id": engines.get("model_id"),
            "model_confidence": engines.get("model_confidence"),
            "type_thresholds": engines.get("model_type_thresholds"),
            "public_types": entities.get("public_types"),
            "custom_keywords": entities.get("custom_keywords"),
            "allow_globs": paths.get("allow"),
            "deny_globs": paths.get("deny"),
            "skip_globs": paths.get("skip"),
            "max_file_bytes": t.get("limits", {}).get("max_file_bytes"),
            "cache_max_bytes": t.get("cache", {}).get("max_bytes"),
            "fail_mode": t.get("fail_mode"),
        }
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if v is not None})

    @classmethod
    def load(cls, path: str | None = None) -> Settings:
        """Settings of a TOML file: the given one, else ``config.toml`` in the folder that QUILLVEIL_CONFIG_DIR names
        (~/.config/quillveil where it is unset), else the defaults. A given file must be there."""
        folder = os.environ.get("QUILLVEIL_CONFIG_DIR") or os.path.expanduser("~/.config/quillveil")
        file = path or os.path.join(folder, "config.toml")
        if not path and not os.path.isfile(file):
            return cls()
        with open(file, encoding="utf-8") as f:
            return cls.from_toml(f.read())

    def fingerprint(self) -> str:
        """A short hash of the fields that change what a text redacts to."""
        names = (
            "enable_rules", "enable_model", "model_id", "model_confidence", "type_thresholds", "public_types", "custom_keywords",
            "allow_globs", "deny_globs", "skip_globs", "max_file_bytes",
        )
        told = {n: getattr(self, n) for n in names}
        told |= {"type_thresholds": sorted(self.type_thresholds.items()), "public_types": sorted(self.public_types)}
        return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:16]


def type_dimension(spark: SparkSession) -> DataFrame:
    """entity_type, tier, default_public, release_blocking: one row a type."""
    tier = {t: "deterministic" for t in DETERMINISTIC_TYPES} | {t: "shared" for t in SHARED_TYPES} | {t: "model" for t in MODEL_TYPES} | {CUSTOM_TYPE: "custom"}
    return spark.createDataFrame(
        [(t, tier[t], t in PUBLIC_TYPES, t in RELEASE_BLOCKING_TYPES) for t in ALL_TYPES],
        "entity_type string, tier string, default_public boolean, release_blocking boolean",
    )
