"""Settings: defaults with their types, overlaid and checked. The type of a default is the type of its value."""

from __future__ import annotations

from copy import deepcopy

#: Defaults and bounds that a run starts from.
DEFAULTS = {
    "general": {"output_root": "runs", "contact_email": ""},
    "search": {"workers": 5, "max_records": 100_000},
    "network": {"timeout_seconds": 30, "body_deadline_seconds": 90, "max_retries": 2, "max_inline_delay_seconds": 10, "max_total_delay_seconds": 30},
    "reading": {"chunk_chars": 4000, "pack_chars": 24_000},
    "openalex_content": {"enabled": False, "free_only": True, "allow_paid": False, "max_files": 0, "max_cost_usd": 0.0},
}
MAY_BE_ZERO = {("network", "max_retries"), ("openalex_content", "max_files"), ("openalex_content", "max_cost_usd")}


class SettingsError(ValueError):
    pass


def overlay(base: dict, over: dict) -> dict:
    """A new mapping: values of ``over`` win, mappings are overlaid in turn; neither argument is changed."""
    out = deepcopy(base)
    for name, value in over.items():
        out[name] = overlay(out[name], value) if isinstance(value, dict) and isinstance(out.get(name), dict) else deepcopy(value)
    return out


def positive(value, name: str, zero: bool = False):
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0 or (value == 0 and not zero) or value != value or value == float("inf"):
        raise SettingsError(f"{name} is a finite number above zero")
    return value


def section(settings: dict, name: str) -> dict:
    found = settings.get(name, {})
    if not isinstance(found, dict):
        raise SettingsError(f"{name} is a section")
    return found


def effective(over: dict | None = None) -> dict:
    """Defaults under ``over``; an unknown name or a value of another type is an error."""
    over = over or {}
    for part, values in over.items():
        known = DEFAULTS.get(part)
        if known is None or not isinstance(values, dict):
            raise SettingsError(f"unknown section {part}" if known is None else f"{part} is a section")
        for name, value in values.items():
            if name not in known:
                raise SettingsError(f"unknown setting {part}.{name}")
            wanted = type(known[name])
            if wanted in (int, float):
                positive(value, f"{part}.{name}", zero=(part, name) in MAY_BE_ZERO)
            if wanted is not float and type(value) is not wanted:
                raise SettingsError(f"{part}.{name} is of type {wanted.__name__}")
    return overlay(DEFAULTS, over)
