"""Model presets and options: typed defaults, one-time migration of single settings, clamps."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Preset:
    name: str = "Default"
    base_url: str = ""
    api_key: str = ""
    model: str = ""
    temperature: str = "0.3"


@dataclass(frozen=True)
class ModelConfig:
    base_url: str
    api_key: str
    model: str
    temperature: float
    max_tokens: int


def presets_of(prefs: dict) -> list[Preset]:
    """Presets of the settings; a broken list is empty, and a lone key from before presets becomes the first one."""
    try:
        found = [Preset(**{k: v for k, v in p.items() if k in Preset.__dataclass_fields__}) for p in json.loads(prefs.get("presets") or "[]")]
    except (ValueError, AttributeError, TypeError):
        found = []
    if not found and prefs.get("api_key"):
        found = [Preset("Default", prefs.get("base_url") or "", prefs["api_key"], prefs.get("model") or "", prefs.get("temperature") or "0.3")]
    return found


def model_config(prefs: dict, default: Preset, aliases: dict[str, str] | None = None) -> ModelConfig:
    """The active preset, with defaults for what it lacks and renamed models rewritten; without presets the single settings."""
    presets, at = presets_of(prefs), int(prefs.get("active_index") or 0)
    own = presets[at] if 0 <= at < len(presets) else Preset("", prefs.get("base_url") or "", prefs.get("api_key") or "", prefs.get("model") or "", prefs.get("temperature") or "")
    model = own.model or default.model
    try:
        heat = float(own.temperature or default.temperature)
    except ValueError:
        heat = math.nan
    return ModelConfig(own.base_url or default.base_url, own.api_key, (aliases or {}).get(model, model), heat, int(prefs.get("max_tokens") or 1024))


def save_preset(prefs: dict, preset: Preset) -> dict:
    """Saving a provider replaces the list by that one and resets the index."""
    return prefs | {"presets": json.dumps([preset.__dict__]), "active_index": 0}


def first_that_works(urls: list[str], fetch):
    """The first mirror that answers; the last error if none does."""
    error: Exception = ValueError("no mirror given")
    for url in urls:
        try:
            return fetch(url)
        except Exception as e:  # noqa: BLE001
            error = e
    raise error


def poll(check, sleep, first: float = 2.0, most: float = 30.0, deadline: float = 1800.0):
    """Calls ``check`` until it returns something, waiting twice as long each time up to a limit; TimeoutError at the deadline."""
    waited, wait = 0.0, first
    while (got := check()) is None:
        if waited >= deadline:
            raise TimeoutError("no result before the deadline")
        sleep(wait)
        waited, wait = waited + wait, min(most, wait * 2)
    return got
