"""Personal-data redaction with built-in expressions only.

Order matters: cards first, since a phone pattern would eat part of a card number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusward.functions.text import let, regex_literal

# ASCII word edges, spelled out so that accented letters count as non-word on every engine.
_START = "(?<![0-9A-Za-z_])"
_END = "(?![0-9A-Za-z_])"
# Names may hold any letters.
_LETTER = r"[\p{L}\p{M}\p{N}_]"

CARD = _START + r"[0-9](?:[ -]?[0-9]){12,18}" + _END
SSN = _START + r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}" + _END
# North American forms with separators, then any international number with its sign. Ten digits in a
# row may be a time or an order number; they count only behind a word that announces a phone.
PHONE = (
    r"(?:\+[0-9]{1,3}[ .-]?)?"
    r"(?:\([0-9]{3}\) ?|" + _START + r"[0-9]{3}[. -])[0-9]{3}[. -][0-9]{4}" + _END
    + r"|\+[0-9](?:[ .-]?[0-9]){7,14}" + _END
)
# Words that announce a phone number.
PHONE_WORDS = ("tel", "telephone", "phone", "mobile", "cell", "call", "fax", "telefon", "téléphone", "teléfono")
ANNOUNCED_PHONE = rf"(?i)(?<!{_LETTER})((?:{'|'.join(PHONE_WORDS)})[.:]{{0,2}} ?)[0-9]{{10}}" + _END
# Only the start of a run is tried, so a long run without a sign is read once.
_LOCAL = r"[\p{L}\p{N}._%+-]"
EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++@[\p{{L}}\p{{N}}.-]+\.\p{{L}}{{2,}}"


def luhn_ok(number: Column) -> Column:
    """Luhn check over the digits of ``number``."""
    digits = F.regexp_replace(number, "[^0-9]", "")

    def weigh(position: Column) -> Column:
        digit = F.substring(digits, position, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return F.when((F.length(digits) - position) % 2 == 1, twice).otherwise(digit)

    weighed = F.transform(F.sequence(F.lit(1), F.length(digits)), weigh)
    return F.aggregate(weighed, F.lit(0), lambda total, d: total + d) % 10 == 0


def redact_cards(text: Column) -> Column:
    """Replace card-like numbers that pass the Luhn check, in place."""
    between = F.split(text, CARD, -1)
    found = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    parts = F.zip_with(
        between,
        found,
        lambda gap, card: F.concat(
            gap,
            F.when(card.isNull(), "").when(luhn_ok(card), "<CREDIT_CARD>").otherwise(card),
        ),
    )
    return F.when(text.rlike(CARD), F.array_join(parts, "")).otherwise(text)


def _where(sign: str, step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """``step`` for texts in which ``sign`` is found."""
    return lambda text: F.when(text.rlike(sign), step(text)).otherwise(text)


def redact(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Cards, social security numbers, phones, e-mails; then the caller's own patterns.

    ``extra`` maps an entity name to a Java regular expression, e.g. employee numbers.
    """
    steps = [
        # what a text must hold for the pattern to match at all is looked for first, as most hold none
        ("[0-9]", redact_cards),
        ("[0-9]{4}", lambda t: F.regexp_replace(t, SSN, "<US_SSN>")),
        (r"[0-9]{4}|\+[0-9]", lambda t: F.regexp_replace(t, PHONE, "<PHONE_NUMBER>")),
        ("[0-9]{10}", lambda t: F.regexp_replace(t, ANNOUNCED_PHONE, "$1<PHONE_NUMBER>")),
        ("@", lambda t: F.regexp_replace(t, EMAIL, "<EMAIL_ADDRESS>")),
    ]
    out = text
    for sign, step in steps:
        out = let(out, _where(sign, step))
    for tag, pattern in (extra or {}).items():
        out = F.regexp_replace(out, pattern, f"<{tag}>")
    return out


def mask_names(text: Column, names: Column) -> Column:
    """Replace each name of the array, as whole words, by ``<PERSON>``, in one pass."""
    any_name = F.array_join(F.transform(names, regex_literal), "|")
    pattern = F.concat(F.lit(rf"(?<!{_LETTER})(?:"), any_name, F.lit(rf")(?!{_LETTER})"))
    return F.when(F.size(names) > 0, F.regexp_replace(text, pattern, F.lit("<PERSON>"))).otherwise(text)


def name_tokens(text: Column) -> Column:
    """Distinct words of a text, the unit names are looked up by."""
    return F.array_distinct(F.filter(F.split(text, rf"[^\p{{L}}\p{{M}}\p{{N}}_]+"), lambda w: w != ""))
