"""Secret scan with native expressions only.

Three patterned kinds (assignments, access keys, long hex runs) are found by
regular expressions.  A fourth kind, ``entropy``, covers opaque tokens that no
pattern names: over each candidate string a window slides one character at a time
and the Shannon entropy of the window is kept up to date by incremental counts, for
the character classes hex and base64 apart; a token whose best window reaches its
class's threshold is a finding unless an allow-list suppresses it.

Everything is a row-local projection: no shuffle, no Python, memory bounded by one
row.  Positions come from the lengths of the pieces between matches, so they count
code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The patterns of the three base kinds and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: Of a run of capitals and digits only the first AKIA can be long enough, and of a
#: run of hex digits only the whole run, so the least length can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Candidate tokens: runs of 20 or more token characters, however long, a digit and a
#: letter among them.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
WINDOW = 20
#: Bits a character that the best window must reach, per character class.
HEX_BITS, BASE64_BITS = 3.0, 3.6

#: Harmless look-alikes: UUIDs, dates and versions in names, paths, examples.  Repeated
#: groups are possessive: nothing they give back could match, and the JVM then loops
#: over them in place of a recursion, whose stack a long token would overflow.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)(example|sample|dummy|placeholder|changeme|xxxx|lorem)",
    r"(?i)(0123456789|abcdefghij|qwertyuiop)",
    r"^[A-Za-z]+([/_-][A-Za-z]+)*+[/_-]?[0-9]{1,4}$",
    r"^/?([a-z0-9_-]{1,16}/){2,}+[a-z0-9_-]{0,24}$",
)

KINDS = ("assign", "access", "hex", "entropy")
SPAN = "array<struct<s:long,k:int,e:long>>"
#: Matches that are folded together.
LOT = 64
#: Counts in one 64-bit word, and bits of a count; a window's counts fit in a few words.
PACKED, COUNT_BITS = 12, 5


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans (with the matched string) of all leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(
        found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).cast("long").alias("g"))
    )
    empty = F.array().cast("array<struct<s:long,k:int,e:long,m:string>>")

    def fold(lot, begin):
        """The spans of a few matches, of which the first's gap begins at ``begin``."""

        def step(acc, x):
            s = acc["at"] + x["g"]
            e = s + F.length(x["m"]).cast("long")
            one = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["m"].alias("m"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(lot, F.struct(begin.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def spans(pairs):
        # A fold copies what it has so far at each step, so lots of a fixed size are
        # folded, each from the sum of the lengths before it.
        lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / LOT).cast("int")), lambda i: F.slice(pairs, i * LOT + 1, F.lit(LOT)))
        total = lambda lot: F.aggregate(lot, F.lit(0).cast("long"), lambda n, x: n + x["g"] + F.length(x["m"]))
        start = F.array(F.lit(0).cast("long"))
        begins = lambda own: F.aggregate(own, start, lambda acc, lot: F.concat(acc, F.array(F.element_at(acc, -1) + total(lot))))
        return F.flatten(F.zip_with(lots, F.slice(begins(lots), F.lit(1), F.size(lots)), fold))

    # Bound once as a lambda's variable, so that the pairs are not made anew for each use.
    whole = F.get(F.transform(F.array(pairs), spans), F.lit(0))
    # Most texts have no match: they skip the fold and the split altogether.
    return F.when(F.rlike(text, F.lit(pattern)), whole).otherwise(empty)


def _clogc(c: int) -> float:
    return c * math.log2(c) if c > 1 else 0.0


def window_bits(token: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, over windows of the token.

    A window's entropy is log2(w) - sum(c*log2(c))/w over its character counts.  As
    the window moves, one character enters and one leaves: only their two counts and
    the running sum change.  A token shorter than the window gives null.
    """
    chars = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    if window >= 1 << COUNT_BITS:
        raise ValueError("a count of the window does not fit its bits")
    # Counts are kept 12 to a word; characters are numbered from 1.
    places = range(len(ALPHABET))
    counts0 = F.array_repeat(F.lit(0).cast("long"), len(ALPHABET) // PACKED + 1)
    words, shifts = (F.array(*map(F.lit, x)) for x in ([p // PACKED for p in places], [p % PACKED * COUNT_BITS for p in places]))
    count = lambda counts, code: F.call_function(
        "shiftright", F.element_at(counts, F.element_at(words, code) + 1), F.element_at(shifts, code)
    ).bitwiseAND((1 << COUNT_BITS) - 1).cast("int")
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), F.element_at(shifts, code))
    start = F.struct(counts0.alias("c"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("least"))
    gain = F.array(*(F.lit(0.0 if c < 1 else _clogc(c + 1) - _clogc(c)) for c in range(window + 2)))

    def bits(codes):
        n = F.size(codes)

        def step(acc, i):
            enter = F.element_at(codes, i)
            leave = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            gone = F.greatest(leave, F.lit(1))
            summed = acc["sum"] + F.element_at(gain, count(acc["c"], enter) + 1)
            c_out = count(acc["c"], gone) + (enter == leave).cast("int")
            summed = F.when(leave > 0, summed - F.element_at(gain, F.greatest(c_out, F.lit(1)))).otherwise(summed)
            counts = F.transform(
                acc["c"],
                lambda v, j: v
                + F.when(F.element_at(words, enter) == j, one(enter)).otherwise(F.lit(0).cast("long"))
                - F.when((leave > 0) & (F.element_at(words, gone) == j), one(gone)).otherwise(F.lit(0).cast("long")),
            )
            least = F.when(i >= window, F.least(acc["least"], summed)).otherwise(acc["least"])
            return F.struct(counts.alias("c"), summed.alias("sum"), least.alias("least"))

        folded = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["least"])
        return F.when(n >= window, F.log2(F.lit(float(window))) - folded / float(window))

    # Bound once as a lambda's variable: named in the step, the codes would be computed
    # anew at every character, and the fold would grow with the square of the length.
    return F.get(F.transform(F.array(F.filter(chars, lambda c: c > 0)), bits), F.lit(0))


def _entropy_spans(text: Column) -> Column:
    def secret(x):
        token = x["m"]
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | F.rlike(token, F.lit(pattern))
        least = F.when(F.rlike(token, F.lit("^([0-9a-f-]+|[0-9A-F-]+)$")), F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))
        return ~allowed & (F.coalesce(window_bits(token), F.lit(0.0)) >= least)

    return F.filter(_matches(text, CANDIDATE, 3), secret)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_entropy: bool = True) -> DataFrame:
    """One row per document: ``id_col`` and ``found``, an array of (s, k, e).

    ``s`` and ``e`` are code points, end exclusive; ``k`` is the place of the kind in
    ``KINDS``.  Spans are ordered by start, then kind.  Base kinds are searched each
    for itself, leftmost and non-overlapping; an assignment covers the whole match
    and needs a value of 6 characters.  Entropy findings that overlap a base finding
    are left out, base findings never.  A null or empty text has no finding; rows with
    the same id are scanned each; other columns are ignored; an empty table gives an
    empty result.
    """
    text = text_or_empty(text_col)
    assign = F.filter(
        _matches(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST
    )
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    base = F.concat(plain(assign), plain(_matches(text, ACCESS, 1)), plain(_matches(text, HEX, 2)))
    out = docs.select(F.col(id_col), text.alias("text")).select(id_col, "text", base.alias("base"))
    if with_entropy:
        extra = F.filter(
            plain(_entropy_spans(F.col("text"))),
            lambda x: ~F.exists(F.col("base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])),
        )
    else:
        extra = F.array().cast(SPAN)
    return out.select(id_col, F.array_sort("base").alias("base"), F.array_sort(F.concat("base", extra)).alias("found"))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))),
        ",",
    )
