"""Engine configuration, resolved once on the driver and shipped as plain values."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class EngineConf:
    """Every knob of the note pipeline with the values its results are defined by.

    An absent or unreadable file means defaults: configuration is optional by design.
    """

    lowercase: bool = True
    remove_extra_whitespace: bool = True
    normalize_accents: bool = False
    confidence_threshold: float = 0.65
    max_entities_per_text: int = 200
    relation_window: int = 150
    evidence_context: int = 20
    prompt_text_chars: int = 2000
    abbreviation_dict_path: str | None = None
    fhir_base_url: str = "http://localhost:8080/fhir"
    patient_id: str = "synthetic-patient-001"
    as_of: str = "2024-01-01"
    random_ids: bool = False
    env: dict[str, str] = field(default_factory=dict, compare=False)

    def with_(self, **changes: Any) -> EngineConf:
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, sections: dict[str, Any] | None) -> EngineConf:
        """Build from nested sections (``preprocessing``, ``ner``, ``fhir`` ...).

        Unknown keys are ignored, so a file written for another version still loads.
        """
        known = {f.name for f in fields(cls)} - {"env"}
        flat: dict[str, Any] = {}
        for key, value in (sections or {}).items():
            if isinstance(value, dict):
                flat.update({k: v for k, v in value.items() if k in known})
                if key == "fhir" and "base_url" in value:
                    flat["fhir_base_url"] = value["base_url"]
            elif key in known:
                flat[key] = value
        return cls(**flat)

    @classmethod
    def from_yaml(cls, path: str | Path) -> EngineConf:
        """Read a YAML file; a missing file gives the defaults."""
        path = Path(path)
        if not path.exists():
            return cls()
        try:
            import yaml
        except ImportError as e:  # pragma: no cover - depends on the installation
            raise RuntimeError("PyYAML is needed to read a YAML configuration") from e
        return cls.from_mapping(yaml.safe_load(path.read_text(encoding="utf-8")))

    @classmethod
    def from_env(cls, prefix: str = "NOTAFLUX_", base: EngineConf | None = None) -> EngineConf:
        """Override fields from environment variables such as NOTAFLUX_PATIENT_ID."""
        base = base or cls()
        changes: dict[str, Any] = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None or f.name == "env":
                continue
            now = getattr(base, f.name)
            if isinstance(now, bool):
                changes[f.name] = raw.strip().lower() in {"1", "true", "yes", "on"}
            elif isinstance(now, int):
                changes[f.name] = int(raw)
            elif isinstance(now, float):
                changes[f.name] = float(raw)
            else:
                changes[f.name] = raw
        return replace(base, **changes)
