"""Currencies that statements are written in."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Currency:
    """How amounts of a currency are written; the pattern is that of a cleaned amount."""

    symbols: tuple[str, ...]
    thousands: tuple[str, ...] = (",", " ")
    decimal: str = "."
    pattern: str = r"^[\d]+[.][\d]{2}$"


#: Symbols, thousands separators and amount pattern of each ISO code.
CURRENCIES = {
    "GBP": Currency(("GBP", "£")),
    "USD": Currency(("USD", "$")),
    "EUR": Currency(("EUR", "EURO", "EUROS", "€"), (".", " "), ",", r"^[\d]+[,][\d]{2}$"),
    "PHP": Currency(("PHP", "₱")),
    "JPY": Currency(("JPY", "¥", "円"), pattern=r"^[\d]+$"),
    "CHF": Currency(("CHF", "Fr", "SFr"), (",", " ", "'")),
    "AUD": Currency(("AUD", "A$")),
    "CAD": Currency(("CAD", "C$")),
    "SGD": Currency(("SGD", "S$")),
    "HKD": Currency(("HKD", "HK$")),
    "AED": Currency(("AED", "د.إ")),
    "SAR": Currency(("SAR", "﷼", "SR")),
    "CNY": Currency(("CNY", "RMB", "元", "¥")),
    "NZD": Currency(("NZD", "NZ$")),
    "IDR": Currency(("IDR", "Rp"), (".", " "), ",", r"^[\d]+$"),
}
