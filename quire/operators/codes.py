"""Which product codes and texts a barcode can carry: an audit before labels are run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Data codewords of QR versions 1 to 10 at level M.
QR_CODEWORDS = (16, 28, 44, 64, 86, 108, 124, 154, 182, 216)


def _check_digit(digits: Column, n: int) -> Column:
    """The digit after n digits whose weights alternate 3, 1 from the right."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda s, i: s + F.substring(digits, i, F.lit(1)).try_cast("int") * F.when((n - i) % 2 == 0, 3).otherwise(1))
    return ((10 - total % 10) % 10).cast("string")


def gtin_audit(code: Column, kind: str = "ean13") -> Column:
    """``struct(reason, canonical)`` of an EAN-13 or UPC-A code, with or without its check digit: reasons are ok, empty,
    wrongLength, nonDigit and checkDigit, looked for in this order."""
    n = {"ean13": 12, "upca": 11}[kind]
    text = F.coalesce(code, F.lit(""))
    size = F.length(text)
    check = _check_digit(text, n)
    whole = F.concat(F.left(text, F.lit(n)), check)
    reason = F.when(size == 0, "empty").when(~size.isin(n, n + 1), "wrongLength").when(~text.rlike("^[0-9]+$"), "nonDigit").when((size == n + 1) & (F.right(text, F.lit(1)) != check), "checkDigit").otherwise("ok")
    return F.struct(reason.alias("reason"), F.when(reason == "ok", whole).alias("canonical"))


def code128_audit(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", "empty").when(t.rlike(r"^[\x20-\x7F]+$"), "ok").otherwise("notEncodable")


def qr_version(text: Column) -> Column:
    """The smallest version, 1 to 10 at level M, that holds the bytes; null if it is too long or empty."""
    n = F.octet_length(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("int")
    for version in range(len(QR_CODEWORDS), 0, -1):
        count_bits = 8 if version < 10 else 16
        out = F.when(4 + count_bits + 8 * n <= 8 * QR_CODEWORDS[version - 1], version).otherwise(out)
    return F.when(n > 0, out)
