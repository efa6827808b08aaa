"""Detector rules: a pattern, a base confidence, an optional validator and known example values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regexes import WORD, jvm_regex
from ..functions.scalar import luhn_valid, ssn_valid


@dataclass(frozen=True)
class PatternSpec:
    """One detection rule.

    ``regex`` is Python ``re`` syntax. ``validator`` maps a value column to a boolean column.
    ``gate`` maps the text column to a cheap necessary condition, tested before the pattern runs;
    ``first`` is the character class a match can begin with. Both only save time.
    """

    name: str
    entity_type: str
    regex: str
    confidence: float
    validator: Callable[[Column], Column] | None = None
    test_values: list[str] = field(default_factory=list)
    ignore_case: bool = False
    gate: Callable[[Column], Column] | None = None
    first: str | None = None
    #: JVM regex that finds the same matches faster; its first group, which ends the match, is the value
    scan: str | None = None

    @property
    def jvm(self) -> str:
        return self.scan or jvm_regex(self.regex, self.ignore_case, self.first)


def has_digit_run(text: Column) -> Column:
    """Four digits in a row: every number rule below contains such a run."""
    return text.rlike(r"\p{Nd}{4}")


def has_at_sign(text: Column) -> Column:
    return F.contains(text, F.lit("@"))


# --- Fixed values: patterns, base confidences and known test values -------------------------------

SSN = PatternSpec(
    name="us_ssn",
    entity_type="ssn",
    regex=r"\b(?!000|666|9\d{2})([0-8]\d{2}|7([0-6]\d|7[012]))[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b",
    confidence=0.75,
    validator=ssn_valid,
    test_values=[
        "123-45-6789",
        "000-00-0000",
        "111-11-1111",
        "222-22-2222",
        "333-33-3333",
        "444-44-4444",
        "555-55-5555",
        "999-99-9999",
        "123-12-1234",
        "987-65-4321",
    ],
    gate=has_digit_run,
    first="[0-8]",
)

CREDIT_CARD = PatternSpec(
    name="credit_card",
    entity_type="credit_card",
    regex=(
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}"
        r"|6(?:011|5[0-9]{2})[0-9]{12}|3(?:0[0-5]|[68][0-9])[0-9]{11})\b"
    ),
    confidence=0.70,
    validator=luhn_valid,
    test_values=[
        "4111111111111111",
        "4111-1111-1111-1111",
        "5500000000000004",
        "340000000000009",
        "4242424242424242",
        "5555555555554444",
        "378282246310005",
    ],
    gate=has_digit_run,
    first="[3-6]",
)

#: All starts inside one run of local-part characters reach the same ``@``, so only a run's first start is tried: where the
#: run begins or the last match ended, after the characters before its first word boundary. Each run is read once.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL_SCAN = (
    rf"(?:\G|(?<!{_LOCAL}))(?:(?<=[{WORD}])[A-Za-z0-9_]*+|(?<![{WORD}])[.%+-]*+)"
    rf"({_LOCAL}++@" + jvm_regex(r"[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b") + ")"
)

EMAIL = PatternSpec(
    name="email",
    entity_type="email",
    regex=r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    confidence=0.90,
    test_values=[
        "test@example.com",
        "test@example.org",
        "user@test.com",
        "noreply@example.com",
        "no-reply@example.com",
        "admin@localhost",
        "foo@bar.test",
        "example@example.com",
    ],
    gate=has_at_sign,
    scan=_EMAIL_SCAN,
)

PHONE = PatternSpec(
    name="us_phone",
    entity_type="phone",
    regex=r"\b(?:\+1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b",
    confidence=0.65,
    test_values=[
        "555-555-5555",
        "555-123-4567",
        "(555) 555-5555",
        "555.555.5555",
        "123-456-7890",
        "000-000-0000",
    ],
    gate=has_digit_run,
    first=r"[+(\d]",
)

MEDICAL_RECORD = PatternSpec(
    name="medical_record_number",
    entity_type="medical_record_number",
    regex=r"\b(?:MRN|mrn|M\.R\.N\.?)[-:\s]?(\d{6,12})\b",
    confidence=0.85,
    test_values=["MRN12345678", "MRN-00000000", "MRN-11111111", "MRN00000000"],
    ignore_case=True,
    gate=has_digit_run,
    first="[Mm]",
)

HEALTH_PLAN = PatternSpec(
    name="health_plan_id",
    entity_type="health_plan_id",
    regex=r"\b(?:HP|Health\s*Plan(?:\s*ID)?|HPID)[-:\s#]*(\d{8,12})\b",
    confidence=0.85,
    test_values=["HP0000000000", "HP1111111111", "HP1234567890"],
    ignore_case=True,
    gate=has_digit_run,
    first="[Hh]",
)

#: In priority order: ties at one offset with equal confidence go to the earlier rule.
DEFAULT_PATTERNS = [SSN, CREDIT_CARD, EMAIL, PHONE, MEDICAL_RECORD, HEALTH_PLAN]
