"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found by pattern, validated (Luhn sum, octets, calendar) and permuted within their format by a
keyed Feistel network, so the same value gets the same pseudonym in every document and different values of a format
never meet. A value x of a domain of a * b values is split into x div b and x mod b; ten rounds add a keyed hash of one
half to the other, modulo its radix, which is a bijection on the domain whatever the hash.

| kind | validated by | permuted |
|---|---|---|
| card | 13 to 19 digits with a right Luhn sum | the digits between the first and the check digit, which is renewed |
| phone | its layout | the ten digits after the country code |
| ssn | its layout | all nine digits |
| ip | four octets up to 255 | the 32-bit address |
| date | the calendar, years 1 to 9599 | the day within its 400-year cycle |
| email | its layout | the local part becomes a keyed hash (no number format to keep) |

Dates with slashes and the year last have the month first, those with dots the day first. Values that do not validate
are left alone. Null texts stay null, empty texts empty, both with zero counts. Repeated rows get the same result.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("card", "phone", "ssn", "ip", "date", "email")
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
NUMBERS = (
    r"(?<![0-9])(?=[0-9+(])(?:"
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{4}/[0-9]{2}/[0-9]{2}(?![0-9])"
    r"|[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9])|[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])"
    r"|(?<!\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
    r"|(?:\+[0-9]{1,3}[ -]?)?\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3}[ -][0-9]{4}(?![0-9])|(?<!-)[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
    r"|(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|[0-9]{13,19}(?![0-9])|[0-9]{4}(?: [0-9]{4}){3}(?![0-9])|[0-9]{4}(?:-[0-9]{4}){3}(?![0-9])"
    r")")
PATTERN = f"{EMAIL}|{NUMBERS}"
CYCLE = 146097  # days in 400 years, 189 * 773
TO_MARCH_0 = 719468  # days from 0000-03-01 to 1970-01-01


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(value: str, a: str, b: str, key: str, tweak: str, rounds=10) -> str:
    """SQL of the keyed permutation of ``value`` in 0 .. a * b - 1."""
    def mixed(half):
        return (f"CAST(conv(substring(sha2(concat_ws('|', {_text(key)}, {tweak}, i, {half}), 256), 1, 15), 16, 10)"
                " AS BIGINT)")

    return f"""aggregate(sequence(0, {rounds - 1}),
        named_struct('l', CAST(({value}) div ({b}) AS BIGINT), 'r', CAST(({value}) % ({b}) AS BIGINT)),
        (s, i) -> CASE WHEN i % 2 = 0
            THEN named_struct('l', CAST((s.l + {mixed('s.r')}) % ({a}) AS BIGINT), 'r', s.r)
            ELSE named_struct('l', s.l, 'r', CAST((s.r + {mixed('s.l')}) % ({b}) AS BIGINT)) END,
        s -> s.l * ({b}) + s.r)"""


def digits_permuted(digits: str, key: str, tweak: str) -> str:
    """SQL of the keyed permutation of a string of 1 to 18 digits."""
    left, right = (f"CAST(pow(10, length({digits}) div 2) AS BIGINT)",
                   f"CAST(pow(10, length({digits}) - length({digits}) div 2) AS BIGINT)")
    return f"lpad(CAST({feistel(f'CAST({digits} AS BIGINT)', left, right, key, tweak)} AS STRING), length({digits}), '0')"


def luhn_sum(digits: str) -> str:
    return f"""aggregate(sequence(1, length({digits})), 0, (sum, i) -> sum + CASE
        WHEN (length({digits}) - i) % 2 = 0 THEN CAST(substring({digits}, i, 1) AS INT)
        WHEN substring({digits}, i, 1) >= '5' THEN 2 * CAST(substring({digits}, i, 1) AS INT) - 9
        ELSE 2 * CAST(substring({digits}, i, 1) AS INT) END)"""


def _pour(mask: str, digits: str) -> str:
    """SQL: the digits of ``mask`` replaced one after the other by those of ``digits``."""
    return rf"""aggregate(split({mask}, ''), named_struct('out', '', 'k', 1),
        (s, c) -> CASE WHEN c rlike '[0-9]'
            THEN named_struct('out', concat(s.out, substring({digits}, s.k, 1)), 'k', s.k + 1)
            ELSE named_struct('out', concat(s.out, c), 'k', s.k) END, s -> s.out)"""


# For a date: where its parts start in the text, by layout.
_ISO = r"m rlike '^[0-9]{4}[-/]'"
_DATE = rf"""try_cast(CASE WHEN {_ISO} THEN concat_ws('-', substring(m, 1, 4), substring(m, 6, 2), substring(m, 9, 2))
    WHEN substring(m, 3, 1) = '.' THEN concat_ws('-', substring(m, 7, 4), substring(m, 4, 2), substring(m, 1, 2))
    ELSE concat_ws('-', substring(m, 7, 4), substring(m, 1, 2), substring(m, 4, 2)) END AS DATE)"""


def found_values(text: str = "text") -> str:
    """SQL: an array of (m, kind, digits, day) for every place of the pattern, in order; kind null if not valid."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    return rf"""transform(transform(regexp_extract_all({text}, {_text(PATTERN)}, 0), m -> named_struct(
            'm', m, 'digits', {digits}, 'layout', CASE
                WHEN contains(m, '@') THEN 'email'
                WHEN m rlike '^([0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}})$' THEN 'date'
                WHEN contains(m, '.') THEN 'ip'
                WHEN m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'
                WHEN contains(m, '(') OR startswith(m, '+') OR m rlike '^[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}$' THEN 'phone'
                ELSE 'card' END,
            'day', CASE WHEN m rlike '^[0-9]{{2}}([0-9]{{2}}[-/]|[./])[0-9]{{2}}[-/.][0-9]{{2}}' THEN unix_date({_DATE}) END)),
        v -> named_struct('m', v.m, 'digits', v.digits, 'day', v.day, 'kind', CASE
            WHEN v.layout = 'date' AND v.day IS NULL THEN NULL
            WHEN v.layout = 'date' AND year(date_from_unix_date(v.day)) NOT BETWEEN 1 AND 9599 THEN NULL
            WHEN v.layout = 'ip' AND exists(split(v.m, '[.]'), o -> CAST(o AS INT) > 255) THEN NULL
            WHEN v.layout = 'card' AND {luhn_sum('v.digits')} % 10 != 0 THEN NULL
            ELSE v.layout END))"""


def pseudonym(key: str) -> str:
    """SQL: the pseudonym of a found value v."""
    ten = "right(v.digits, 10)"
    phone = f"concat(left(v.digits, length(v.digits) - 10), {digits_permuted(ten, key, _text('phone'))})"
    middle = "substring(v.digits, 2, length(v.digits) - 2)"
    tweak = f"concat('card', left(v.digits, 1), length(v.digits))"
    # The check digit: what a trailing 0 leaves to the next multiple of ten.
    card = f"""transform(array(concat(left(v.digits, 1), {digits_permuted(middle, key, tweak)})),
        d -> concat(d, CAST((10 - {luhn_sum("concat(d, '0')")} % 10) % 10 AS STRING)))[0]"""
    address = feistel("aggregate(split(v.m, '[.]'), 0L, (x, o) -> x * 256 + CAST(o AS INT))", "65536", "65536", key,
                      _text("ip"))
    ip = f"""transform(array({address}), x -> concat_ws('.', x div 16777216, x div 65536 % 256, x div 256 % 256,
        x % 256))[0]"""
    cycle = f"floor((v.day + {TO_MARCH_0}) / {CYCLE})"
    moved = feistel(f"(v.day + {TO_MARCH_0} - {cycle} * {CYCLE})", "189", "773", key,
                    f"concat('date', {cycle})")
    day = f"date_from_unix_date(CAST({cycle} * {CYCLE} + {moved} - {TO_MARCH_0} AS INT))"
    date = f"""transform(array(date_format({day}, 'yyyyMMdd')), d -> CASE
        WHEN v.m rlike '^[0-9]{{4}}[-/]' THEN d
        WHEN substring(v.m, 3, 1) = '.' THEN concat(substring(d, 7, 2), substring(d, 5, 2), substring(d, 1, 4))
        ELSE concat(substring(d, 5, 4), substring(d, 1, 4)) END)[0]"""
    email = (f"concat('user', substring(sha2(concat_ws('|', {_text(key)}, 'email', lower(v.m)), 256), 1, 16), "
             "substring(v.m, instr(v.m, '@')))")
    ssn = digits_permuted("v.digits", key, _text("ssn"))
    return f"""CASE v.kind WHEN 'email' THEN {email} WHEN 'card' THEN {_pour('v.m', card)}
        WHEN 'phone' THEN {_pour('v.m', phone)} WHEN 'ssn' THEN {_pour('v.m', ssn)}
        WHEN 'date' THEN {_pour('v.m', date)} WHEN 'ip' THEN {ip} ELSE v.m END"""


def pseudonymize(docs: DataFrame, key: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text with pseudonyms, and the number of values replaced per kind (n_card, n_phone, ...)."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .withColumn("found", F.coalesce(F.expr(found_values()), F.expr(
            "CAST(array() AS array<struct<m: string, digits: string, day: int, kind: string>>)")))
    replaced = found.withColumn("new", F.expr(f"transform(found, v -> {pseudonym(key)})"))
    text = F.expr(f"""CASE WHEN size(new) = 0 THEN text ELSE array_join(flatten(
        transform(split(text, {_text(PATTERN)}, -1), (gap, i) -> array(gap, coalesce(get(new, i), '')))), '') END""")
    counts = [F.size(F.expr(f"filter(found, v -> v.kind = '{kind}')")).cast("long").alias(f"n_{kind}")
              for kind in KINDS]
    return replaced.select("doc_id", text.alias("text"), *counts)
