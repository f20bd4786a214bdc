"""Lexicon sentiment (F6, F7) as native expressions.

Each lexicon term counts once when it occurs as a substring of the
lower-cased text; score = (pos - neg) / (pos + neg), 0 when nothing hits.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mktlens.functions.exprs import col

# Fixed values of the reference heuristic: its two six-word lexicons and the
# label cut-off.
DEFAULT_POSITIVE = ("good", "growth", "profit", "bull", "upgrade", "surge")
DEFAULT_NEGATIVE = ("bad", "loss", "downgrade", "drop", "bear", "fraud")
LABEL_CUTOFF = 0.1


@dataclass(frozen=True)
class Lexicon:
    positive: tuple[str, ...] = DEFAULT_POSITIVE
    negative: tuple[str, ...] = DEFAULT_NEGATIVE


# Lexicon used over the driver's invented prose (FIXTURES.md: the real terms
# never occur there).
FIXTURE_LEXICON = Lexicon(positive=("the", "tion"), negative=("bea", "keit", "ent"))


def _hits(lower_text: Column, terms: tuple[str, ...]) -> Column:
    if not terms:
        return F.lit(0)
    total = None
    for term in terms:
        hit = (F.instr(lower_text, term.lower()) > 0).cast("int")
        total = hit if total is None else total + hit
    return total


def lexicon_score(text: str | Column, lexicon: Lexicon = Lexicon()) -> Column:
    """F6."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    pos = _hits(low, lexicon.positive)
    neg = _hits(low, lexicon.negative)
    total = pos + neg
    return F.when(total == 0, F.lit(0.0)).otherwise((pos - neg).cast("double") / total.cast("double"))


def sentiment_label(score: str | Column, cutoff: float = LABEL_CUTOFF) -> Column:
    """F7."""
    s = col(score)
    return F.when(s > cutoff, F.lit("positive")).when(s < -cutoff, F.lit("negative")).otherwise(F.lit("neutral"))


def signed_confidence(label: str | Column, confidence: str | Column) -> Column:
    """M14 sign rule: only the exact upper-case POSITIVE / NEGATIVE survive the
    upper-casing in the reference (star labels never match)."""
    lab = F.upper(col(label))
    conf = col(confidence).cast("double")
    return F.when(lab == "POSITIVE", conf).when(lab == "NEGATIVE", -conf).otherwise(F.lit(0.0))
