"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds, in this order: email, ip, card (Luhn), phone, iban (mod-97), ssn (needs context).  The first
four are the base kinds; every valid base match is kept whatever its score.  An iban has its country's
length, which ends it whatever follows after a blank.  An iban or ssn is kept when its score reaches
``THRESHOLD``: the checksum alone is enough for an iban, an ssn needs context.

A score is the kind's prior, plus ``CONTEXT_BONUS`` when one of the kind's words lies within
``CONTEXT_CHARS`` characters of the span on either side, at most 1.

Rows: null text counts as empty and has no spans; repeated rows are scored each for itself; an empty
table gives an empty result.  Only the id and text columns are read.  One narrow projection: no
shuffle, and the work of a row depends on that row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .textcols import let, text_or_empty

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
EMAIL, IP, CARD, PHONE, IBAN, SSN = range(6)

# The look-behinds only skip starts inside a run whose first start has failed already, so that a run
# of n characters costs n steps and not n squared; \G admits the start right after a match.  The
# possessive loops are iterative in Java: a digit chain of any length uses no stack.
EMAIL_RE = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_RE = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_RE = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE_RE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The length of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _iban_re() -> str:
    """A country, two digits, and as many characters as that country's numbers have, blanks between them or not."""
    of = {n: [c for c, k in IBAN_LENGTHS.items() if k == n] for n in sorted(set(IBAN_LENGTHS.values()))}
    kinds = "|".join(rf"(?:{'|'.join(cs)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, cs in of.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{kinds})(?![A-Za-z0-9])"


IBAN_RE = _iban_re()
SSN_RE = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

PRIOR = [0.9, 0.6, 0.7, 0.6, 0.8, 0.3]
CONTEXT_BONUS, CONTEXT_CHARS, THRESHOLD = 0.3, 40, 0.5
PART = 256
CONTEXT_WORDS = [
    "mail|contact|write to",
    "ip|address|host|server",
    "card|visa|mastercard|credit|payment",
    "phone|tel|call|mobile|fax",
    "iban|bank|account|transfer",
    "ssn|social security|tax id",
]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled (less 9 above 9); the sum ends in 0."""
    n = F.length(digits)
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(parts, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count 10 to 35, remainder 1."""
    s = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97)) == 1


def _valid_card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _valid_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: F.when(F.length(q) <= 3, F.coalesce(F.try_to_number(q, F.lit("999")), F.lit(0)) <= 255).otherwise(False)))


def _parts(text: Column) -> Column:
    """The text in parts of PART characters: a place deep in a long text is then found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def _cut(parts: Column, start: Column, length: Column) -> Column:
    """At most PART characters from ``start`` (from 0) on."""
    k = F.floor(start / PART).cast("int")
    two = F.concat(F.coalesce(F.get(parts, k), F.lit("")), F.coalesce(F.get(parts, k + 1), F.lit("")))
    return F.substring(two, start - k * PART + 1, length)


def _score(parts: Column, x: Column) -> Column:
    def near(words: str) -> Column:
        lo = F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0))
        around = F.concat(_cut(parts, lo, x["s"] - lo), F.lit(" "), _cut(parts, x["e"], F.lit(CONTEXT_CHARS)))
        return F.rlike(around, F.lit(rf"(?i)(?<![a-z])(?:{words})(?![a-z])"))

    score = F.lit(None).cast("double")
    for k in reversed(range(len(KINDS))):
        score = F.when(x["k"] == k, F.least(F.lit(1.0), F.lit(PRIOR[k]) + F.when(near(CONTEXT_WORDS[k]), CONTEXT_BONUS).otherwise(0.0))).otherwise(score)
    return score


def pii_spans(text: Column) -> Column:
    """``array<struct<s,k,e,m>>`` of the valid spans of a text, base kinds and candidates."""
    n_digits = lambda m: F.length(_digits(m))
    return F.flatten(
        F.array(
            S.find(text, EMAIL_RE, EMAIL, "@"),
            S.keep(S.find(text, IP_RE, IP, "."), _valid_ip),
            S.keep(S.find(text, CARD_RE, CARD), _valid_card),
            S.keep(S.find(text, PHONE_RE, PHONE, "+"), lambda m: n_digits(m).between(10, 15)),
            S.keep(S.find(text, IBAN_RE, IBAN), mod97),
            S.find(text, SSN_RE, SSN, "-"),
        )
    )


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans``, an array of (start, kind, end, text, score)."""
    text = text_or_empty(text_col)
    found = df.select(F.col(id_col).alias("id"), text.alias("text"), pii_spans(text).alias("found"))
    score = lambda parts: F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["m"].alias("m"), _score(parts, x).alias("score")))
    kept = F.filter(let(_parts(F.col("text")), score), lambda x: (x["k"] <= PHONE) | (x["score"] >= THRESHOLD))
    return found.select(F.col("id").alias(id_col), F.array_sort(F.when(F.size("found") > 0, kept).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,m:string,score:double>>"))).alias("spans"))


def pii_digest(df: DataFrame) -> DataFrame:
    """The contract's columns from ``find_pii``'s."""
    base = F.filter("spans", lambda x: x["k"] <= PHONE)
    return df.select(
        "doc_id",
        *[S.count_kind(F.col("spans"), k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(S.listed(base, KINDS), 256).alias("base_sha256"),
        S.listed(F.col("spans"), KINDS).alias("spans"),
        F.array_join(F.transform("spans", lambda x: F.format_string("%.2f", x["score"])), ",").alias("scores"),
    )
