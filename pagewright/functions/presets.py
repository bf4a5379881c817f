"""Recogniser presets by script, and the choice of one for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "v6-small"

# Names of presets and the scripts that each can read, in catalogue order.
PRESETS = {
    "v6-small": ("Latin", "Han", "Hiragana", "Katakana"),
    "v6-medium": ("Latin", "Han", "Hiragana", "Katakana"),
    "v6-tiny": ("Latin", "Han"),
    "v5-latin-mobile": ("Latin",),
    "v5-eslav-mobile": ("Latin", "Cyrillic"),
    "v5-cyrillic-mobile": ("Cyrillic",),
    "v5-devanagari-mobile": ("Latin", "Devanagari"),
    "v5-arabic-mobile": ("Latin", "Arabic"),
    "v5-greek-mobile": ("Latin", "Greek"),
    "v5-korean-mobile": ("Latin", "Hangul"),
    "v5-thai-mobile": ("Latin", "Thai"),
    "v5-tamil-mobile": ("Latin", "Tamil"),
    "v5-telugu-mobile": ("Latin", "Telugu"),
    "v5-en-mobile": ("Latin",),
}


def for_script(script: Column) -> Column:
    """Presets that read the script, in catalogue order."""
    return F.array_compact(F.array(*[F.when(script.isin(*scripts), F.lit(name)) for name, scripts in PRESETS.items()]))


def for_row(named: Column, fallback: str = DEFAULT) -> Column:
    """The first known preset of an array (or of one name), else the fallback."""
    known = F.filter(named, lambda p: p.isin(*PRESETS))
    return F.coalesce(F.get(known, 0), F.lit(fallback))
