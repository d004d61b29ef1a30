"""Secrets: known shapes, and tokens that pass a battery of randomness tests.

Base kinds, in this order: assign, access, hex; their matches always stay.  Further spans of kind
``random`` are maximal runs of at least ``MIN_TOKEN`` characters of the base64 alphabets that look
drawn at random.  Each run's encoding is inferred (decimal, hex, base32, base36, base62, base64),
then three tests of uniform independent symbols are made: chi-squared over ``CELLS`` equal classes
of the alphabet, runs above and below its middle, and lag-1 serial correlation.  A run of decimal digits is
never reported: numbers that people give to things are as uniform as secrets.

False discovery: here a discovery is a run declared a secret, so the null is written language.
Bonferroni's combination x of a run's three p-values is uniform for a random run; for language it
gathers near 0, the more so the longer the run, and is taken as distributed like x ** a with a = 2 to
the minus ``BITS_PER_CHAR`` times length.  A run's p-value under the null is therefore 1 - x ** a, and
1 where x is below ``ALPHA``.  Benjamini-Hochberg at level ``Q`` over all runs of a document reports
the k smallest with p <= Q * rank / runs: a short run with middling x stands alone but falls among many.

Rows: null text counts as empty; repeated rows are searched each for itself; an empty table gives an
empty result.  Only the id and text columns are read; one narrow projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .textcols import let, text_or_empty

KINDS = ["assign", "access", "hex", "random"]
ASSIGN, ACCESS, HEX, RANDOM = range(4)
ASSIGN_RE = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short to count cannot hide a longer match, so the length stands in the pattern.
ACCESS_RE = r"AKIA[A-Z0-9]{16,}+"
HEX_RE = r"[0-9a-f]{24,}+"
MIN_TOKEN = 20
TOKEN_RE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}+"
CELLS = 8
ALPHA, Q, BITS_PER_CHAR = 0.01, 0.05, 0.4

#: Alphabets from the narrowest; the first that holds every character of a token is its encoding.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def encoding_of(token: Column) -> Column:
    """The narrowest alphabet that holds the token, or null."""
    out = F.lit(None).cast("string")
    for name, chars in reversed(ALPHABETS.items()):
        fits = F.translate(token, chars, "") == ""
        if name.lower() == "base36":  # letters of one case alone are a word, and no draw from 36 symbols
            fits = fits & F.rlike(token, F.lit("[0-9]"))
        out = F.when(fits, name).otherwise(out)
    return out


def _ranks(token: Column, encoding: Column) -> Column:
    """Each character's place in the token's alphabet."""
    chars = F.lit("")
    for name, alphabet in ALPHABETS.items():
        chars = F.when(encoding == name, alphabet).otherwise(chars)
    return let(chars, lambda a: F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(a, c) - 1))


def _size_of(encoding: Column) -> Column:
    out = F.lit(64)
    for name, alphabet in ALPHABETS.items():
        out = F.when(encoding == name, len(alphabet)).otherwise(out)
    return out


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of a standard normal deviate (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.least(F.lit(1.0), F.lit(2.0) * F.exp(-x * x / 2) / F.sqrt(F.lit(2.0) * F.pi()) * poly)


def chi_squared_p(ranks: Column, size: Column) -> Column:
    """p of the counts in CELLS classes of the alphabet (Wilson-Hilferty's normal form, upper tail)."""
    n = F.size(ranks).cast("double")

    def share(j: int) -> Column:  # of symbols r with floor(r * CELLS / size) = j
        return (F.ceil(size * (j + 1) / F.lit(float(CELLS))) - F.ceil(size * j / F.lit(float(CELLS)))) / size.cast("double")

    def in_cell(j: int):
        return lambda r: F.floor(r * CELLS / size) == j

    x2 = F.lit(0.0)
    for j in range(CELLS):
        seen = F.size(F.filter(ranks, in_cell(j))).cast("double")
        x2 = x2 + (seen - n * share(j)) * (seen - n * share(j)) / (n * share(j))
    df = CELLS - 1
    z = (F.pow(x2 / df, F.lit(1 / 3)) - F.lit(1 - 2 / (9 * df))) / F.lit((2 / (9 * df)) ** 0.5)
    return F.when(z > 0, _normal_tail(z)).otherwise(1.0)


def runs_p(ranks: Column, size: Column) -> Column:
    """Wald-Wolfowitz runs of symbols below and above the middle of the alphabet."""
    high = F.transform(ranks, lambda r: (r * 2 >= size).cast("int"))
    n = F.size(ranks).cast("double")

    def on(h: Column) -> Column:
        n1 = F.aggregate(h, F.lit(0), lambda a, v: a + v).cast("double")
        n0 = n - n1
        runs = F.aggregate(F.zip_with(F.slice(h, 2, F.size(h) - 1), F.slice(h, 1, F.size(h) - 1), lambda p, q: (p != q).cast("int")), F.lit(1), lambda a, v: a + v)
        mean = F.lit(2.0) * n1 * n0 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(var > 0, _normal_tail((runs - mean) / F.sqrt(var))).otherwise(0.0)

    return let(high, on)


def serial_p(ranks: Column) -> Column:
    """Lag-1 correlation; under independence its standard error is one over the root of n."""
    n = F.size(ranks).cast("double")

    def on(r: Column) -> Column:
        mean = F.aggregate(r, F.lit(0.0), lambda a, v: a + v) / n
        dev = F.transform(r, lambda v: v - mean)

        def of(d: Column) -> Column:
            var = F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v)
            cov = F.aggregate(F.zip_with(F.slice(d, 2, F.size(d) - 1), F.slice(d, 1, F.size(d) - 1), lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
            return F.when(var > 0, _normal_tail((cov / var + 1 / n) * F.sqrt(n))).otherwise(0.0)

        return let(dev, of)

    return let(F.transform(ranks, lambda v: v.cast("double")), on)


def randomness_p(token: Column) -> Column:
    """Bonferroni's combination of the battery's p-values; 0 for a token of no known encoding."""

    def on(x: Column) -> Column:
        return F.least(F.lit(1.0), F.lit(3.0) * F.least(chi_squared_p(x["r"], x["n"]), runs_p(x["r"], x["n"]), serial_p(x["r"])))

    enc = encoding_of(token)
    return let(enc, lambda e: F.when(e.isNull() | (e == "decimal"), 0.0).otherwise(let(F.struct(_ranks(token, e).alias("r"), _size_of(e).alias("n")), on)))


def language_p(token: Column) -> Column:
    """p-value of a run under written language: small if it is long and the battery finds it random."""
    share = F.pow(F.lit(2.0), F.length(token) * F.lit(-BITS_PER_CHAR))
    return let(randomness_p(token), lambda x: F.when(x >= ALPHA, -F.expm1(share * F.log(x))).otherwise(1.0))


def _discovered(tokens: Column) -> Column:
    """Benjamini-Hochberg over a document's runs."""

    def on(p: Column) -> Column:
        admitted = F.aggregate(
            F.transform(F.array_sort(p), lambda w, i: F.when(w <= F.lit(Q) * (i + 1) / F.size(p), w).otherwise(-1.0)),
            F.lit(-1.0), lambda a, v: F.greatest(a, v),
        )
        return let(admitted, lambda most: F.filter(tokens, lambda x, i: F.get(p, i) <= most))

    return let(F.transform(tokens, lambda x: language_p(x["m"])), on)


def secret_spans(text: Column) -> Column:
    """``array<struct<s,k,e,m>>`` of the secrets of a text."""
    empty = F.array().cast(f"array<{S.SPAN}>")
    tokens = S.find(text, TOKEN_RE, RANDOM)
    return F.flatten(
        F.array(
            S.keep(S.find(text, ASSIGN_RE, ASSIGN), lambda m: F.length(F.regexp_extract(m, ASSIGN_RE, 2)) >= 6),
            S.find(text, ACCESS_RE, ACCESS, "AKIA"),
            S.find(text, HEX_RE, HEX),
            let(tokens, lambda t: F.when(F.size(t) > 0, _discovered(t)).otherwise(empty)),
        )
    )


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans``, an array of (start, kind, end, text)."""
    return df.select(F.col(id_col), F.array_sort(secret_spans(text_or_empty(text_col))).alias("spans"))


def secret_digest(df: DataFrame) -> DataFrame:
    """The contract's columns from ``find_secrets``'s."""
    base = F.filter("spans", lambda x: x["k"] <= HEX)
    return df.select(
        "doc_id",
        *[S.count_kind(F.col("spans"), k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(S.listed(base, KINDS), 256).alias("base_sha256"),
        S.listed(F.col("spans"), KINDS).alias("spans"),
    )
