"""Configuration from TOML folders: a root file, then those of each company in order; later keys win."""

from __future__ import annotations

import tomllib
from pathlib import Path

from ledgerloom.functions.currency import CURRENCIES
from ledgerloom.functions.fields import Field, Modifier
from ledgerloom.functions.standard import ConfigError, Reference, Standard

FILES = ("companies", "accounts", "account_types", "statement_types", "statement_tables", "standard_fields")


def load(folder: str | Path) -> dict[str, dict]:
    """The tables of every known file, by file name."""
    folder = Path(folder)
    out: dict[str, dict] = {name: {} for name in FILES}
    for part in [folder, *sorted(p for p in folder.iterdir() if p.is_dir())]:
        for name in FILES:
            path = part / f"{name}.toml"
            if path.exists():
                out[name] |= tomllib.loads(path.read_text(encoding="utf-8"))
    for key, account in out["accounts"].items():
        code = account.get("currency")
        if code is not None and code not in CURRENCIES:
            raise ConfigError(f"account {key}: unknown currency {code!r}")
        company = account.get("company_key")
        if company is not None and company not in out["companies"]:
            raise ConfigError(f"account {key}: unknown company {company!r}")
    return out


def field(raw: dict, currency: str | None = None) -> Field:
    """A field from its table; the account's currency applies to currency fields."""
    m = raw.get("numeric_modifier")
    kind = raw.get("type", "string")
    code = raw.get("currency_override") or (currency if kind == "currency" else None)
    return Field(raw["field"], kind, raw.get("column", 0), tuple(raw["cell"].values()) if "cell" in raw else None, raw.get("vital", False), raw.get("strip_characters_start"), raw.get("strip_characters_end"),
                 raw.get("string_pattern"), raw.get("regex_groups"), raw.get("string_max_length"),
                 m and Modifier(m.get("prefix"), m.get("suffix"), m.get("multiplier", 1.0), m.get("exclude_negative_values", False), m.get("exclude_positive_values", False)), code)


def standards(raw: dict[str, dict], section: str) -> list[Standard]:
    """The standard fields of a section."""
    def ref(r: dict) -> Reference:
        return Reference(r["statement_type"], r.get("field"), tuple(r.get("concat_fields") or ()), r.get("default"), r.get("format"), r.get("terminator"), r.get("multiplier", 1.0),
                         r.get("exclude_negative_values", False), r.get("exclude_positive_values", False))

    return [Standard(name, s.get("type", "string"), s.get("vital", False), tuple(map(ref, s.get("std_refs", ())))) for name, s in raw.items() if s.get("section") == section]
