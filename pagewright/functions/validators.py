"""Checks of structured identifiers as column expressions over digit strings; false for null or ill-formed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of an IBAN by country, from the public IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

# Weights of the first ten digits of a PESEL number.
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)


def _digits(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def luhn(s: Column) -> Column:
    """Two or more digits whose Luhn sum is a multiple of ten."""
    return _sure(s.rlike("^[0-9]{2,}$") & F.call_function("luhn_check", F.when(s.rlike("^[0-9]{2,}$"), s)))


def ssn(s: Column) -> Column:
    """Nine digits whose area, group and serial may have been given out."""
    area, group, serial = F.substring(s, 1, 3), F.substring(s, 4, 2), F.substring(s, 6, 4)
    return _sure(s.rlike("^[0-9]{9}$") & ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000"))


def date(year: Column, month: Column, day: Column) -> Column:
    """Whether the day exists in the Gregorian calendar."""
    first = F.when(month.between(1, 12) & year.between(1, 9999), F.make_date(year, month, F.lit(1)))
    return _sure((day >= 1) & (day <= F.dayofmonth(F.last_day(first))))


def pesel(s: Column) -> Column:
    """Eleven digits: the check digit holds and the month, less its century's offset, gives a day that exists."""
    safe = F.when(s.rlike("^[0-9]{11}$"), s)
    digits = _digits(safe)
    total = sum((F.get(digits, i) * w for i, w in enumerate(PESEL_WEIGHTS)), F.lit(0))
    year, month, day = (F.substring(safe, p, 2).cast("int") for p in (1, 3, 5))
    # months 81-92 belong to the 1800s, 01-12 to the 1900s, and each 20 more to a later century
    century = F.when(month > 80, 1800).otherwise(1900 + 100 * F.floor(month / 20))
    return _sure((F.pmod(10 - total % 10, F.lit(10)) == F.get(digits, 10)) & date((century + year).cast("int"), (month % 20).cast("int"), day))


def iban(s: Column) -> Column:
    """The country's length, and remainder 1 of 97 with the first four characters moved to the end."""
    safe = F.when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), s)
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    turned = F.concat(F.substr(safe, F.lit(5)), F.substring(safe, 1, 4))
    # letters are numbers of two digits: at most 68 digits, whose remainder is taken 30 at a time
    number = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c >= "A", (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    rest = F.lit("")
    for at in (1, 31, 61):
        block = F.concat(rest, F.substring(number, at, 30))
        rest = (F.when(block != "", block).otherwise("0").cast("decimal(38,0)") % 97).cast("int").cast("string")
    return _sure((F.length(safe) == F.try_element_at(lengths, F.substring(safe, 1, 2))) & (rest == "1"))


# The same checks on plain strings, for code that runs within workers.


def luhn_text(s: str) -> bool:
    if len(s) < 2 or not (s.isascii() and s.isdigit()):
        return False
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def ssn_text(s: str) -> bool:
    return len(s) == 9 and s.isascii() and s.isdigit() and s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"


def date_text(year: int, month: int, day: int) -> bool:
    import calendar

    return 1 <= month <= 12 and 1 <= year <= 9999 and 1 <= day <= calendar.monthrange(year, month)[1]


def pesel_text(s: str) -> bool:
    if len(s) != 11 or not (s.isascii() and s.isdigit()):
        return False
    d = [int(c) for c in s]
    month = 10 * d[2] + d[3]
    century = 1800 if month > 80 else 1900 + 100 * (month // 20)
    return (-sum(a * w for a, w in zip(d, PESEL_WEIGHTS, strict=False))) % 10 == d[10] and date_text(century + 10 * d[0] + d[1], month % 20, 10 * d[4] + d[5])


def iban_text(s: str) -> bool:
    if len(s) < 5 or not (s.isascii() and s.isalnum() and s[:2].isalpha() and s[:2].isupper() and s[2:4].isdigit()) or IBAN_LENGTHS.get(s[:2]) != len(s):
        return False
    return s == s.upper() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
