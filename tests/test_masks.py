"""Replacement texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veilwork.functions import checks, masks


def _value(spark, sql):
    return spark.range(1).select(F.expr(sql)).first()[0]


@pytest.mark.parametrize(
    ("kind", "text", "masked"),
    [
        ("EMAIL", "john@example.com", "j***@*******.com"),
        ("EMAIL", "john@mail.example.com", "j***@****.com"),
        ("EMAIL", "a@localhost", "a@*********"),
        ("EMAIL", "a@b@c.com", "*********"),
        ("SSN", "123-45-6789", "***-**-6789"),
        ("SSN", "12-45-6789", "**********"),
        ("CREDIT_CARD", "4111-1111-1111-1111", "****-****-****-1111"),
        ("CREDIT_CARD", "4111", "****"),
        ("PHONE_NUMBER", "+1 555-123-4567", "***-***-4567"),
        ("PHONE_NUMBER", "123456", "******"),
        ("IBAN", "DE89370400440532013000", "*" * 18 + "3000"),
        ("IBAN", "abc", "***"),
        ("IBAN", "é😀xyz", "*😀xyz"),
    ],
)
def test_partial(spark, kind, text, masked):
    assert _value(spark, masks.partial(f"'{kind}'", f"'{text}'")) == masked


def test_partial_options(spark):
    assert _value(spark, masks.partial_generic("'abcdef'", "#", 2)) == "####ef"


@pytest.mark.parametrize("algorithm", ["sha256", "md5", "other"])
def test_hash(spark, algorithm):
    function = hashlib.md5 if algorithm == "md5" else hashlib.sha256
    expected = f"{algorithm.upper()}:{function('salté'.encode()).hexdigest()[:12]}"
    assert _value(spark, masks.hashed("'é'", algorithm, 12, "salt")) == expected


def test_redact_template(spark):
    assert _value(spark, masks.redact("'EMAIL'")) == "<EMAIL_REDACTED>"
    assert _value(spark, masks.redact("'EMAIL'", "[{entity_type}]")) == "[EMAIL]"


@pytest.mark.parametrize(
    ("kind", "index", "fake"),
    [
        ("EMAIL", 7, "user_0007@anon.example"),
        ("EMAIL", 12345, "user_12345@anon.example"),
        ("PHONE_NUMBER", 3, "+1-555-000-0003"),
        ("SSN", 3, "000-00-0003"),
        ("CREDIT_CARD", 3, "4000-0000-0000-0003"),
        ("PERSON_NAME", 8, "Alice Person8"),
        ("PERSON_NAME", 2, "Bob Person2"),
        ("ORGANIZATION", 3, "Organization_3"),
        ("LOCATION", 3, "3 Anon Street, Anytown"),
        ("ADDRESS", 3, "3 Anon Street, Anytown"),
        ("IP_ADDRESS", 256, "10.0.0.1"),
        ("JWT_TOKEN", 3, "eyJmYWtl.eyJmYWtl.ZmFrZV9zaWduYXR1cmU"),
        ("IBAN", 3, "<ANON_IBAN_3>"),
    ],
)
def test_pseudonym(spark, kind, index, fake):
    assert _value(spark, masks.pseudonym(f"'{kind}'", "'x'", f"{index}L")) == fake


def test_pseudo_key_shape(spark):
    first, again, other = (
        _value(spark, masks.pseudo_key("'API_KEY_AWS'", f"'{v}'")) for v in ("a", "a", "b")
    )
    assert first == again != other
    assert first.startswith("FAKE_KEY_") and first[9:].isalnum() and len(first) == 25


@pytest.mark.parametrize(
    ("number", "valid"),
    [("4111111111111111", True), ("5500 0000 0000 0004", True), ("1234567890123456", False),
     ("1", False), ("", False), ("٤١١١111111111111", True)],
)
def test_luhn(spark, number, valid):
    assert _value(spark, checks.luhn_ok(f"'{number}'")) is valid


@pytest.mark.parametrize(
    ("iban", "valid"),
    [("DE89 3704 0044 0532 0130 00", True), ("DE8937040044053201300", False), ("XX12", True)],
)
def test_iban(spark, iban, valid):
    assert _value(spark, checks.iban_length_ok(f"'{iban}'")) is valid
