"""Secret scan: fixed patterns, and a battery of randomness tests with FDR control.

Everything is a DataFrame expression. The three fixed kinds are found by pattern. The
battery adds a fourth kind, ``random``: every run of 20 or more characters of the usual
encodings is a candidate, and for the encoding that its characters suggest it gets

* a chi-squared statistic of its characters against a uniform alphabet,
* a runs test over the lower and upper half of the alphabet,
* the correlation of neighbouring characters' places in the alphabet.

Each is standardised by its exact mean and variance for random characters, the three are
added (the last two without their signs), and the cube root of the sum is close to
normal, as that of a chi-squared is. A candidate's p-value is the chance that written
text of its length and encoding has as small a root. What written text has comes from a
table: mean and spread by encoding and length, simulated for letters and digits as
frequent as in writing, interpolated between lengths. (Simulated chances of
0.001 come out 0.75 to 5 times as large, so it mostly errs on the side of no discovery.) The
Benjamini-Hochberg procedure then controls the false discovery rate for each encoding
and length class, over the candidates of all documents. It works on a grid of p-values
(counts by encoding, class and bin, some thousand rows at most), so no candidates are
ranked or gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm.common import cut_table, sha256_of, table

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Runs that are long enough: greedy runs of one class are maximal, so the length can be in the pattern.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/=_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ALPHANUMERIC = _LETTERS.upper() + _LETTERS + "0123456789"
#: Encodings by what their characters are, tried in this order: pattern and alphabet.
ENCODINGS = (
    ("^[0-9]+$", "0123456789"),
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+=*$", _LETTERS.upper() + "234567"),
    ("^[A-Za-z0-9]+$", _ALPHANUMERIC),
    ("^[A-Za-z0-9+/]+=*$", _ALPHANUMERIC + "+/"),
    ("^[A-Za-z0-9_-]+=*$", _ALPHANUMERIC + "-_"),
)
#: Percentages of the letters a to z in English writing.
LETTER_SHARES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Lower ends of the length classes.
CLASSES = (20, 28, 40, 64, 128)
#: Lengths for which text is simulated, and how many texts.
LENGTHS, TEXTS = (20, 22, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 512), 2_000
FDR = 0.01
#: Bins of -log10(p), and bins to a decade.
BIN_COUNT, BINS_A_DECADE = 400, 20
BLOCK = 256


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array<int>, by blocks: no step copies a long array."""
    grow = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
    before = F.aggregate(sums, F.array(F.lit(0).cast("long")), grow)
    inside = F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, at: F.slice(F.aggregate(b, F.array(at), grow), 2, BLOCK))
    return F.flatten(inside)


_NO_SPANS = "cast(array() as array<struct<start: long, end: long, token: string>>)"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as structs (start, end, token) in code points; token is ``group``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(found, F.length)
    between = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
    ends = running_sums(F.zip_with(between, sizes, lambda a, b: a + b))
    tokens = found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(ends.alias("end"), sizes.alias("size"), tokens.alias("token"))
    spans = F.transform(zipped, lambda m: F.struct((m.end - m["size"]).alias("start"), m.end.alias("end"), m.token.alias("token")))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(_NO_SPANS))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by the usual rational approximation of its tail."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = F.lit(1.0) / (1.0 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def text_weights(alphabet: str) -> np.ndarray:
    """How frequent an alphabet's characters are in writing.

    Digits by Benford's law with 0 as the first, a tenth as frequent as letters; capitals
    as letters are, a tenth as frequent where there are small ones too; a sign as
    frequent as a seventh of all letters, the space between words.
    """
    small = any(c in _LETTERS for c in alphabet)
    letters = dict(zip(_LETTERS, LETTER_SHARES, strict=True))

    def weight(c: str) -> float:
        if c.isdigit():
            return 10 * float(np.log10(1 + 1 / (int(c) + 1)))
        if c.isalpha():
            return letters[c.lower()] * (0.1 if small and c.isupper() else 1.0)
        return 100 / 7 / 2

    weights = np.array([weight(c) for c in alphabet])
    return weights / weights.sum()


def least_sum(k: int) -> float:
    """What is added to the sum of the tests before the root: it is never lower than minus this."""
    return ((k - 1) / 2) ** 0.5 + 0.5


def statistic(places: np.ndarray, k: int) -> np.ndarray:
    """The root of the three standardised tests' sum for rows of places (from 0) in an alphabet of k."""
    rows, n = places.shape
    counts = np.stack([(places == c).sum(axis=1) for c in range(k)], axis=1)
    chi = (counts.astype(float) ** 2).sum(axis=1) * k / n - n
    chi_z = (chi - (k - 1)) / np.sqrt(2.0 * (k - 1) * (n - 1) / n)
    upper = places >= k // 2
    ones = upper.sum(axis=1).astype(float)
    mean = 2 * ones * (n - ones) / n
    runs_z = ((upper[:, 1:] != upper[:, :-1]).sum(axis=1) - mean) / np.sqrt(np.maximum(mean * (mean - 1) / (n - 1), 0.25))
    centred = places + 1 - (k + 1) / 2
    serial_z = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / ((k * k - 1) / 12.0) / np.sqrt(n - 1)
    return np.cbrt(chi_z + np.abs(runs_z) + np.abs(serial_z) + least_sum(k))


@cache
def text_table(alphabet: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Mean and spread of written text's statistic at LENGTHS, simulated with a fixed seed."""
    rng = np.random.default_rng(len(alphabet))
    weights = text_weights(alphabet)
    found = [statistic(rng.choice(len(alphabet), (TEXTS, n), p=weights), len(alphabet)) for n in LENGTHS]
    return tuple(float(x.mean()) for x in found), tuple(float(x.std()) for x in found)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def table_at(encoding: Column, n: Column, which: int, power: float) -> Column:
    """An encoding's mean (0) or spread (1) at n, linear between LENGTHS; beyond them it grows with a power of n."""
    rows = ", ".join(f"array({', '.join(f'{v!r}D' for v in text_table(alphabet)[which])})" for _, alphabet in ENCODINGS)
    own, knots = F.get(F.expr(f"array({rows})"), encoding), F.expr(f"array({', '.join(map(str, LENGTHS))})")

    def between(k: Column) -> Column:
        low, high, at = F.get(own, k), F.get(own, k + 1), F.get(knots, k)
        return low + (n - at) * (high - low) / (F.get(knots, k + 1) - at)

    segment = F.greatest(F.size(F.filter(knots, lambda x: x <= n)), F.lit(1)) - 1
    last = len(LENGTHS) - 1
    return F.when(n > LENGTHS[-1], F.get(own, F.lit(last)) * F.pow(n / LENGTHS[-1], F.lit(power))).otherwise(
        let(F.least(segment, F.lit(last - 1)), between)
    )


def battery(token: Column) -> Column:
    """struct(encoding, length, p) of a candidate; null if its characters suit no encoding."""
    number = F.lit(None).cast("int")
    for i in range(len(ENCODINGS) - 1, -1, -1):
        number = F.when(token.rlike(ENCODINGS[i][0]), i).otherwise(number)
    alphabets = F.array(*(F.lit(alphabet) for _, alphabet in ENCODINGS))
    # the halves of each alphabet as 0 and 1
    halves = F.array(*(F.lit("0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)) for _, a in ENCODINGS))
    body = F.rtrim(F.translate(token, "=", " "))
    without = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))

    def prepared(number: Column) -> Column:
        alphabet = F.get(alphabets, number)
        return F.struct(
            number.alias("number"),
            alphabet.alias("alphabet"),
            F.length(alphabet).cast("double").alias("k"),
            body.alias("body"),
            F.greatest(F.length(body), F.lit(2)).cast("double").alias("n"),
            F.call_function("translate", body, alphabet, F.get(halves, number)).alias("halves"),
        )

    def counted(t: Column) -> Column:
        counts = F.transform(F.split(t.alphabet, ""), lambda c: without(t.body, c))
        places = F.transform(F.split(t.body, ""), lambda c: F.instr(t.alphabet, c) - (t.k + 1) / 2)
        size = F.greatest(F.length(t.body) - 1, F.lit(0))
        products = let(places, lambda x: F.zip_with(F.slice(x, 1, size), F.slice(x, 2, size), lambda a, b: a * b))
        ones = without(t.halves, F.lit("1")).cast("double")
        return F.struct(
            t.number.alias("encoding"),
            t.k.alias("k"),
            t.n.alias("n"),
            F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c * c).alias("squares"),
            (2 * ones * (t.n - ones) / t.n).alias("mean"),
            ((without(t.halves, F.lit("01")) + without(t.halves, F.lit("10"))) / 2).alias("changes"),
            F.aggregate(products, F.lit(0.0), lambda a, x: a + x).alias("products"),
        )

    def root(s: Column) -> Column:
        chi_z = (s.squares * s.k / s.n - s.n - (s.k - 1)) / F.sqrt(2.0 * (s.k - 1) * (s.n - 1) / s.n)
        runs_z = (s.changes - s["mean"]) / F.sqrt(F.greatest(s["mean"] * (s["mean"] - 1) / (s.n - 1), F.lit(0.25)))
        serial_z = s.products / ((s.k * s.k - 1) / 12.0) / F.sqrt(s.n - 1)
        return F.cbrt(chi_z + F.abs(runs_z) + F.abs(serial_z) + F.sqrt((s.k - 1) / 2) + 0.5)

    def judged(s: Column) -> Column:
        z = (table_at(s.encoding, s.n, 0, 1 / 3) - root(s)) / table_at(s.encoding, s.n, 1, -1 / 6)
        return F.struct(s.encoding.alias("encoding"), s.n.alias("length"), let(z, normal_tail).alias("p"))

    return F.when(number.isNotNull(), let(number, lambda i: let(prepared(i), lambda t: let(counted(t), judged))))


def length_class(length: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(CLASSES[1:], 1):
        out = F.when(length >= low, k).otherwise(out)
    return out


def p_bin(p: Column) -> Column:
    """Bins of p, smaller p in higher bins: 10 ** (-bin / BINS_A_DECADE) is a bin's largest p."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_A_DECADE), F.lit(BIN_COUNT - 1)).cast("int")


def spans_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the spans of each kind; those of ``random`` are all candidates, with encoding, length class and bin of p.

    No text stays in it: it is written, and both the counts and the result are read from it.
    """
    text = F.coalesce("text", F.lit(""))
    place = lambda m: (m.start.alias("start"), m.end.alias("end"))

    def judged(m: Column) -> Column:
        return let(battery(m.token), lambda t: F.struct(*place(m), t.encoding.alias("encoding"), length_class(t["length"]).alias("class"), p_bin(t.p).alias("bin")))

    plain = lambda found: F.transform(found, lambda m: F.struct(*place(m)))
    found = docs.select(
        "doc_id",
        plain(F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m.token) >= 12)).alias("assign"),
        plain(matches(text, ACCESS)).alias("access"),
        plain(matches(text, HEX)).alias("hex"),
        F.filter(F.transform(matches(text, CANDIDATE), judged), lambda t: t.encoding.isNotNull()).alias("random"),
    )
    return cut_table(found)


def discovery_bins(found: DataFrame, fdr: float = FDR) -> dict[tuple[int, int], int]:
    """By encoding and length class, the lowest bin whose candidates are discoveries.

    found: rows of ``spans_of``. A bin passes if its largest p, times the candidates of its
    kind, is at most ``fdr`` times the candidates in this bin and higher ones.
    """
    kinds = found.select(F.inline("random")).groupBy("encoding", "class", "bin")
    by_kind: dict[tuple[int, int], dict[int, int]] = {}
    for r in kinds.agg(F.count("*").alias("n")).collect():  # encodings times classes times bins, whatever the input
        by_kind.setdefault((r.encoding, r["class"]), {})[r.bin] = r.n
    return {kind: least for kind, bins in by_kind.items() if (least := lowest_bin(bins, fdr)) is not None}


def lowest_bin(bins: dict[int, int], fdr: float) -> int | None:
    """Benjamini-Hochberg on counts by bin."""
    total, found, least = sum(bins.values()), 0, None
    for b in sorted(bins, reverse=True):
        found += bins[b]
        if 10 ** (-b / BINS_A_DECADE) * total <= fdr * found:
            least = b
    return least


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Secrets of every document.

    docs: ``doc_id``, ``text``; other columns are not read. Returns one row for each row
    of docs: ``doc_id`` and ``spans``, an array of struct<kind, start, end> by start and
    then by kind in the order of KINDS; places in code points, end exclusive. Spans of
    one kind don't overlap, spans of different kinds may. Null and empty texts have none.
    """
    every_span = spans_of(docs)
    least = discovery_bins(every_span, fdr)
    found = every_span.withColumn("random", F.filter("random", lambda t: _reaches(t, least)))

    def placed(number: int) -> Column:
        return F.transform(KINDS[number], lambda m: F.struct(m.start.alias("start"), F.lit(number).alias("kind"), m.end.alias("end")))

    every = F.array_sort(F.concat(*map(placed, range(len(KINDS)))))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(every, lambda s: F.struct(F.get(names, s.kind).alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return found.select("doc_id", named.alias("spans"))


def _reaches(t: Column, least: dict[tuple[int, int], int]) -> Column:
    out = F.lit(False)
    for (encoding, k), b in sorted(least.items()):
        out = out | ((t.encoding == encoding) & (t["class"] == k) & (t.bin >= b))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != KINDS[-1])
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in KINDS),
        sha256_of(text(base)).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
