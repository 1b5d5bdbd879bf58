"""Small text helpers shared by the scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, also when the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# regex whitespace of RE2: no vertical tab, unlike Java's \s
BLANK = r"\t\n\f\r "
# Unicode White_Space, for trimming
UNI_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def trim_space(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(col, rf"^[{UNI_SPACE}]+|[{UNI_SPACE}]+\z", "")


def go_quote(col: Column) -> Column:
    """Double-quoted form of a name."""
    escaped = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def byte_cut(col: Column, n: int) -> Column:
    """Number of bytes of the longest prefix of at most n bytes that ends between characters."""

    def shift(window: Column) -> Column:
        # hex digits of the bytes n-1, n and n+1: how many steps back to a byte that starts a character
        def continues(i: int) -> Column:
            return F.substring(window, 2 * i + 1, 2).between("80", "BF")

        return F.when(~continues(2), 0).when(~continues(1), 1).when(~continues(0), 2).otherwise(3)

    window = F.lpad(F.hex(F.encode(col, "UTF-8").substr(max(n - 1, 1), min(n + 1, 3))), 6, "0")
    return F.when(F.octet_length(col) <= n, F.octet_length(col)).otherwise(F.lit(n) - let(window, shift))


def byte_prefix(col: Column, n: int) -> Column:
    """Longest prefix of at most n bytes that does not split a character."""
    cut = F.decode(F.encode(col, "UTF-8").substr(F.lit(1), byte_cut(col, n)), "UTF-8")
    return F.when(F.octet_length(col) <= n, col).otherwise(cut)


def truncate(col: Column, n: int) -> Column:
    """Cut texts of more than n bytes and append three dots."""
    return F.when(F.octet_length(col) <= n, col).otherwise(F.concat(byte_prefix(col, n), F.lit("...")))


def rfc3339(ts: Column) -> Column:
    """Whole-second UTC time text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def double_text(col: Column) -> Column:
    """Shortest decimal text of a double, never with an exponent; 1.0 is '1'."""
    s = col.cast("string")
    sci = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign, lead, frac = (F.regexp_extract(s, sci, i) for i in (1, 2, 3))
    exp = F.coalesce(F.regexp_extract(s, sci, 4).try_cast("int"), F.lit(0))
    digits = F.concat(lead, F.regexp_replace(frac, "0+$", ""))
    point = exp + 1
    big = F.when(F.length(digits) <= point, F.rpad(digits, point, F.lit("0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    return (
        F.when(s.isin("Infinity", "-Infinity"), F.when(col > 0, "+Inf").otherwise("-Inf"))
        .when(s.rlike(sci), F.concat(sign, F.when(exp >= 0, big).otherwise(small)))
        .otherwise(F.regexp_replace(s, r"\.0$", ""))
    )
