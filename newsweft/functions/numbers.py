"""Numbers with units and numeric claims as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions.text import let

_NUM = r"\$?\d{1,3}(?:,\d{3})*(?:\.\d+)?|\$?\d+(?:\.\d+)?"


def _number_pattern(strict_wan_yi: bool) -> str:
    units = list(rules.NUMBER_UNITS)
    if not strict_wan_yi:
        units = [rules.WAN_YI, *units]
    return rf"(?i)(?<![\d.])({_NUM})\s*({'|'.join(units)})"


def parse_numbers(text: Column, parity: bool = False) -> Column:
    """All numbers of a text that carry a unit, as doubles with the unit multiplied in.

    ``parity=True`` reads the two-character unit for 1e12 as its first character only.
    """
    pattern = _number_pattern(strict_wan_yi=parity)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    factors = dict(rules.NUMBER_UNITS)
    if not parity:
        factors = {rules.WAN_YI: rules.WAN_YI_FACTOR, **factors}
    unit_map = F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])

    def value(hit: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(hit, pattern, 1), r"[,$]", "")
        unit = F.lower(F.regexp_extract(hit, pattern, 2))
        return digits.cast("double") * F.element_at(unit_map, unit)

    # The look-behind needs the text before a hit, so digits and unit are cut from the hit itself.
    return F.transform(hits, value)


def first_number(text: Column) -> Column:
    """First bare number of a claim, commas removed; null when it is none."""
    hit = F.regexp_extract(text, r"[\d,]+\.?\d*", 0)
    return F.regexp_replace(hit, ",", "").try_cast("double")


def extract_claims(text: Column, limit: int = rules.CLAIMS_PER_DOC) -> Column:
    """Numeric claims in family order, first spelling per lower-cased claim, at most ``limit``."""
    def family(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda h: F.struct(F.lit(kind).alias("type"), h.alias("claim")))

    claims = F.concat(*[family(kind, pattern) for kind, pattern in rules.CLAIM_PATTERNS])

    def first_spellings(found: Column) -> Column:
        lowered = F.transform(found, lambda c: F.lower(c["claim"]))
        return let(lowered, lambda low: F.filter(
            found, lambda c, i: F.array_position(low, F.lower(c["claim"])) == i + 1
        ))

    return F.slice(let(claims, first_spellings), 1, limit)


def claim_context(text: Column, claim: Column, kind: Column) -> Column:
    """Surroundings of the first occurrence of a claim, 80 characters each side (dates 40)."""
    reach = F.when(kind == rules.CLAIM_DATE, 40).otherwise(80)
    start = F.greatest(F.position(claim, text) - reach, F.lit(1))
    length = F.position(claim, text) + F.length(claim) + reach - start
    return F.trim(F.replace(F.substr(text, start, length), F.lit("\n"), F.lit(" ")))


# Unit aliases of the strict comparison; nothing is multiplied out.
STRICT_UNITS = (
    ("USD_BILLION", r"(?:\$\s?%N\s?(?:bn|billion)|%N\s?(?:bn|billion)\s?(?:usd|us dollars|dollars|美元))"),
    ("USD_MILLION", r"(?:\$\s?%N\s?(?:mn|million)|%N\s?(?:mn|million)\s?(?:usd|us dollars|dollars|美元))"),
    ("USD_TRILLION", r"(?:\$\s?%N\s?(?:tn|trillion)|%N\s?(?:tn|trillion)\s?(?:usd|us dollars|dollars|美元))"),
    ("USD_HUNDRED_MILLION", r"%N\s?亿美元"),
    ("USD", r"(?:\$\s?%N|%N\s?(?:usd|us dollars|dollars|美元))"),
    ("PERCENT", r"%N\s?(?:%|percent)"),
    ("BILLION", r"%N\s?(?:bn|billion)"),
    ("MILLION", r"%N\s?(?:mn|million)"),
    ("TRILLION", r"%N\s?(?:tn|trillion)"),
    ("PEOPLE", r"%N\s?(?:people|person|人)"),
)


def strict_number(surface: Column) -> Column:
    """Digits and unit of a number's spelling without expanding magnitudes.

    ``status`` is ``ok``, or ``not_comparable`` when there is no single known unit.
    """
    text = F.translate(F.trim(surface), "０１２３４５６７８９．，−％＄", "0123456789.,-%$")
    text = F.lower(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", ""))
    number = r"(-?\d+(?:\.\d+)?)"
    unit: Column | None = None
    for name, template in STRICT_UNITS:
        test = F.rlike(text, F.lit("^" + template.replace("%N", number) + "$"))
        unit = F.when(test, name) if unit is None else unit.when(test, name)
    digits = F.regexp_extract(text, number, 1)
    digits = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.struct(
        F.when(unit.isNotNull(), digits).alias("digits"),
        unit.alias("unit"),
        F.when(unit.isNull(), "not_comparable").otherwise("ok").alias("status"),
    )
