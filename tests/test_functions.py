from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusward.functions import access, guard, pii, text

POLICY = """
# Leave

## Annual
All staff have 20 days.

## Restricted
> **Allowed Groups:** HR, Management
> **Note:** five more days.
"""


def test_sections_and_groups(spark, one):
    assert one(text.sections(F.lit(POLICY))) == [
        "# Leave", "## Annual\nAll staff have 20 days.",
        "## Restricted\n> **Allowed Groups:** HR, Management\n> **Note:** five more days.",
    ]
    groups = F.transform(text.sections(F.lit(POLICY)), access.section_groups)
    assert one(groups) == [["Public"], ["Public"], ["HR", "Management"]]
    assert one(access.section_groups(F.lit("> **allowed groups:** , "))) == []


@pytest.mark.parametrize("raw", ["#\n# x", "a\n#\n\n## b#c\n#no", "x # y\n\n\n# z ", "#a\n #b\n# c", " # t\n# u"])
def test_sections_like_python(one, raw):
    pieces = [p.strip() for p in re.split(r"(?=(?:^|\n)#+\s+)", raw)]
    assert one(text.sections(F.lit(raw))) == [p for p in pieces if p]


@pytest.mark.parametrize("raw", ["a b\x1cc　d e​f", "  ", "", "\x85x\x0by"])
def test_words_like_python(one, raw):
    assert one(text.words(F.lit(raw))) == raw.split()
    assert one(text.strip(F.lit(raw))) == raw.strip()


@pytest.mark.parametrize("word", ["leave", "Ünïcode", "", "\U0001f600 x"])
def test_token_id(one, word):
    assert one(text.token_id(F.lit(word))) == int(hashlib.sha256(word.encode()).hexdigest(), 16) % 2147483647


def test_overlap_windows(one):
    body = " ".join(str(i) for i in range(20))
    got = one(text.overlap_windows(F.lit(body), 8, 2))
    assert [g.split()[0] for g in got] == ["0", "6", "12"]
    assert got[-1].split()[-1] == "19"
    assert one(text.overlap_windows(F.lit(" "), 8, 2)) == []


def test_filename_rules(one):
    assert one(access.filename_groups(F.lit("/payroll/x/Salary_bands.csv"))) == ["HR", "Management", "Finance"]
    assert one(access.filename_groups(F.lit("/payroll/plan.csv"))) == ["Public"]
    assert one(access.extension_source(F.lit("a/b.tar.PDF"))) == "pdf"
    assert one(access.extension_source(F.lit("a/.md"))) is None
    assert one(access.extension_source(F.lit("a.md/readme"))) is None


def test_chunk_access(one):
    def see(allowed, mine):
        return one(access.may_see(access.strings(*allowed), access.strings(*mine)))

    assert see(["HR", "Public"], [])
    assert see(["HR"], ["HR"])
    assert not see(["Management"], ["HR"])
    assert not see([], ["HR"])


def test_cached_answer_access(one):
    def reuse(allowed, mine):
        return one(access.may_reuse(access.strings(*allowed), access.strings(*mine)))

    assert reuse(["HR", "Public"], ["Engineering"])
    assert not reuse(["Management"], ["HR"])
    assert reuse(["Management"], ["Management"])
    assert reuse([], ["HR"])


def test_principal(one):
    claims = '{"preferred_username": "", "email": "a@x.org", "groups": ["HR"], "realm_access": {"roles": ["ops", "HR"]}}'
    got = one(access.principal(F.lit(claims)))
    assert (got["username"], sorted(got["groups"]), got["email"]) == ("a@x.org", ["HR", "Public", "ops"], "a@x.org")
    assert one(access.principal(F.lit("{}")))["username"] == "oidc_user"


def test_redact(one):
    raw = (
        "mail a.b@x.org, ssn 123-45-6789, call +1 (743) 555-3824 or 743-555-3824, "
        "card 4111 1111 1111 1111 and 4111111111111112, no 1234"
    )
    assert one(pii.redact(F.lit(raw), {"EMPLOYEE": "E[0-9]{4}"})) == (
        "mail <EMAIL_ADDRESS>, ssn <US_SSN>, call <PHONE_NUMBER> or <PHONE_NUMBER>, "
        "card <CREDIT_CARD> and 4111111111111112, no 1234"
    )
    assert one(pii.redact(F.lit("E1234"), {"EMPLOYEE": "E[0-9]{4}"})) == "<EMPLOYEE>"


def test_names(one):
    names = access.strings("Ann", r"B\E.o")
    assert one(pii.mask_names(F.lit(r"Ann Anna B\E.o xAnn Ann."), names)) == r"<PERSON> Anna <PERSON> xAnn <PERSON>."


def test_gate(one):
    assert one(guard.gate(F.lit(0), F.lit(None).cast("double"))) == guard.REFUSE_NOTHING_FOUND
    assert one(guard.gate(F.lit(1), F.lit(-3.5))) == guard.REFUSE_LOW_CONFIDENCE
    assert one(guard.gate(F.lit(1), F.lit(-3.0))) is None


def test_citations(one):
    answer = F.lit("Yes [Source: valid.pdf]  no [Source: made up.pdf ]. [Source: valid.pdf]")
    files = access.strings("valid.pdf")
    assert one(guard.citations(answer)) == ["valid.pdf", "made up.pdf", "valid.pdf"]
    assert one(guard.valid_citations(answer, files)) == ["valid.pdf"]
    assert one(guard.strip_invalid(answer, files)) == "Yes [Source: valid.pdf] no . [Source: valid.pdf]"
    assert not one(guard.needs_review(answer, files))
    assert one(guard.needs_review(answer, access.strings()))


@pytest.mark.parametrize(("text", "want"), [
    ("+44 20 7946 0958", "<PHONE_NUMBER>"), ("5551234567", "5551234567"), ("123 45 6789", "<US_SSN>"),
    ("josé@x.org", "<EMAIL_ADDRESS>"), ("a" * 80 + "@x.org", "<EMAIL_ADDRESS>"), ("555-123-4567", "<PHONE_NUMBER>"),
    ("order 12345678", "order 12345678"), ("2024 10 2024", "2024 10 2024"),
])
def test_more_personal_data(one, text, want):
    assert one(pii.redact(F.lit(text))) == want


def test_page_limit_is_refused(spark):
    from corpusward.operators import admin

    with pytest.raises(ValueError):
        admin.page(spark.range(3), "id", "id", 0, 900, 500)


@pytest.mark.parametrize("text, want", [
    ("order 1690890000 shipped", None), ("ts=1700000000;", None), ("id 0123456789.", None),
    ("recall 1234567890", None), ("build 2024.11.0312", None),
    ("Phone: 5551234567", "Phone: <PHONE_NUMBER>"), ("call 5551234567 now", "call <PHONE_NUMBER> now"),
    ("TEL.5551234567", "TEL.<PHONE_NUMBER>"), ("(555) 123-4567", "<PHONE_NUMBER>"),
    ("555-123-4567", "<PHONE_NUMBER>"), ("+49 30 1234567", "<PHONE_NUMBER>"), ("+1 (743) 555-3824", "<PHONE_NUMBER>"),
    ("mail a.b@c.org", "mail <EMAIL_ADDRESS>"), ("4111 1111 1111 1111", "<CREDIT_CARD>"), ("078-05-1120", "<US_SSN>"),
    ("no digits at all", None), ("", None),
])
def test_redaction_literals(one, text, want):
    from corpusward.functions import pii

    assert one(pii.redact(F.lit(text))) == (text if want is None else want)
