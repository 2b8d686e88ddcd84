"""Secret scan (operator 8, DataFrame functions only): three patterns, and sliding-window entropy over candidate strings.

Patterns give spans by kind:

    assign  an assignment to a key-like name whose value has 12 characters or more
    access  AKIA and 14 or more of [A-Z0-9]
    hex     16 or more of [0-9a-f]

`entropy` spans are added to these.  A candidate is a maximal run of 20 or more of [A-Za-z0-9+/_=-].  A window of 20 characters slides over it with a table of character counts (a string with one digit-like character for each symbol): a step takes one off the count of the symbol that goes out, adds one to that of the symbol that comes in, and corrects the sum of c * log2(c) by these two.  The largest entropy of a window is held against the limit of the candidate's character class, which follows from how many lower-case letters, capitals, digits and other symbols it has.  Every candidate has a class.  Candidates that fit the allow-list, or that overlap a span of another kind, are suppressed.

Long texts: candidates are cut into overlapping pieces of a few hundred characters, whose largest entropy is that of the whole; no pattern repeats a group, so nothing recurses with the length; spans are added up in blocks.  Time is linear in the text's length.  No shuffle.

Positions come from the lengths of what lies between matches (`split`) and of the matches (`regexp_extract_all`), in code points, since no built-in function returns them.

Defined cases: null text counts as empty and has no span; the whole text is scanned whatever its length; repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import let

# The patterns of the three kinds, in the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LOWER, UPPER, DIGITS, OTHER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-"
#: Least entropy in bits of the best window, by character class.
LIMITS = {"hex": 3.0, "lower_digits": 3.7, "all": 3.9, "upper_digits": 3.4, "one_case_digits": 3.7, "digits": 3.2, "one_case": 3.6, "few_digits": 3.8, "both_cases": 3.9}
#: Strings that look random and are not secret: UUIDs, whole dates with times, well-known placeholders; besides, `words` lets paths of words and words in camel case pass.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-]?[0-9]{2}([_-]?[0-9]{2}){0,2}([_-][0-9]{1,9})?(Z|[+-][0-9]{2}-?([0-9]{2})?)?)?$",
    r"(?i)example|placeholder|dummy|changeme|sample|your[_-]",
]
#: Matches of a text, and candidates, that are handled together.
BLOCK = 256

_SPANS = "array<struct<start:bigint,end:bigint,kind:int,hit:string>>"


def _blocks(n: Column) -> Column:
    """First places (from 1) of the blocks of n things; none for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n, F.lit(BLOCK))).otherwise(F.expr("cast(array() as array<int>)"))


def matches(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose value_group has `least` or more characters."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    empty = F.expr(f"cast(array() as {_SPANS})")
    zero = F.lit(0).cast("bigint")

    def one(acc: Column, p: Column) -> Column:
        start = acc.at + F.char_length(p.gap)
        end = start + F.coalesce(F.char_length(p.hit), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), p.hit.alias("hit"))
        fits = p.hit.isNotNull()
        if least:
            fits = fits & (F.char_length(F.regexp_extract(p.hit, pattern, value_group)) >= least)
        return F.struct(end.alias("at"), F.when(fits, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    def whole(parts: Column) -> Column:
        block = lambda first: F.aggregate(F.slice(parts, first, F.lit(BLOCK)), F.struct(zero.alias("at"), empty.alias("spans")), one)
        return let(F.transform(_blocks(F.size(parts)), block), placed)

    def placed(blocks: Column) -> Column:
        start = F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("starts"))
        starts = F.aggregate(blocks, start, lambda acc, b: F.struct((acc.at + b.at).alias("at"), F.concat(acc.starts, F.array(acc.at)).alias("starts")), lambda acc: acc.starts)
        move = lambda b, at: F.transform(b.spans, lambda s: F.struct((s.start + at).alias("start"), (s.end + at).alias("end"), s.kind.alias("kind"), s.hit.alias("hit")))
        return F.flatten(F.zip_with(blocks, starts, move))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, whole)).otherwise(empty)


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits) of a window of that many characters of a candidate; null if it is shorter."""
    symbols = LOWER + UPPER + DIGITS + OTHER
    blank, zero = len(symbols) + 1, ord("0")
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    weigh = lambda c: F.element_at(weights, c + 1)
    count = lambda table, symbol: F.ascii(F.substring(table, symbol, F.lit(1))) - zero
    put = lambda table, symbol, c: F.overlay(table, F.char(c + zero), symbol, F.lit(1))

    def step(acc: Column, move: Column) -> Column:
        out, come = count(acc.table, move.go), count(acc.table, move.come) - (move.go == move.come).cast("int")
        total = acc.total - weigh(out) + weigh(out - 1) - weigh(come) + weigh(come + 1)
        table = put(put(acc.table, move.go, out - 1), move.come, come + 1)
        return F.struct(table.alias("table"), total.alias("total"), F.when(move.full, F.least(acc.least, total)).otherwise(acc.least).alias("least"))

    def least(codes: Column) -> Column:
        """Of a piece, as symbol numbers.  Its first window is filled with a symbol of its own, the last of the table."""
        at = lambda i: F.when(i > 0, F.get(codes, i - 1)).otherwise(F.lit(blank))
        moves = F.transform(F.sequence(F.lit(1), F.size(codes)), lambda i: F.struct(at(i).alias("come"), at(i - window).alias("go"), (i >= window).alias("full")))
        begin = F.struct(F.lit("0" * len(symbols) + chr(zero + window)).alias("table"), F.lit(window * math.log2(window)).alias("total"), F.lit(None).cast("double").alias("least"))
        return F.aggregate(moves, begin, step, lambda acc: acc.least)

    pieces = F.regexp_extract_all(s, F.lit(f"(?=(.{{1,{BLOCK + window - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    numbers = lambda p: F.transform(F.split(p, ""), lambda c: F.instr(F.lit(symbols), c))
    best = F.array_min(F.transform(pieces, lambda p: F.when(F.char_length(p) >= window, let(numbers(p), least))))
    return F.lit(math.log2(window)) - best / window


def limit(s: Column) -> Column:
    """The entropy limit of a candidate's character class."""
    has = lambda symbols: F.char_length(s) - F.char_length(F.translate(s, symbols, ""))
    counts = F.struct(has(LOWER).alias("lower"), has(UPPER).alias("upper"), has(DIGITS).alias("digits"), has(OTHER).alias("other"), has("abcdefABCDEF").alias("hex"))

    def pick(n: Column) -> Column:
        lower, upper, digits, plain = n.lower > 0, n.upper > 0, n.digits > 0, n.other == 0
        one_case = ~(lower & upper)
        rules = [
            ("hex", digits & plain & (n.hex > 0) & (n.hex == n.lower + n.upper)),
            ("lower_digits", (n.digits >= 3) & lower & ~upper & plain),
            ("all", digits & lower & upper),
            ("upper_digits", digits & upper & ~lower & plain),
            ("one_case_digits", (n.digits >= 3) & one_case & (lower | upper)),
            ("digits", ~lower & ~upper),
            ("one_case", ~digits & one_case),
            ("few_digits", one_case),
        ]
        out = F.lit(LIMITS["both_cases"])
        for name, holds in reversed(rules):
            out = F.when(holds, F.lit(LIMITS[name])).otherwise(out)
        return out

    return let(counts, pick)


def words(s: Column) -> Column:
    """Whether a candidate is words of up to 19 letters joined by symbols, or words in camel case, with up to four digits after."""
    stem = F.regexp_replace(s, r"[0-9]{1,4}$", "")
    joined = F.forall(F.split(stem, "[/_=-]+", -1), lambda p: F.regexp_like(p, F.lit("^([A-Z]?[a-z]{0,18}|[A-Z]{2,19})$")))
    humps = F.filter(F.split(F.regexp_replace(stem, "([A-Z])", " $1"), " ", -1), lambda p: p != "")
    camel = let(humps, lambda h: (F.size(h) > 1) & F.forall(h, lambda p: F.regexp_like(p, F.lit("^[A-Za-z][a-z]{2,18}$"))))
    return joined | camel


def suspicious(s: Column, allowed: list[str] | None = None) -> Column:
    """Whether a candidate's best window reaches the limit of its class, it is not made of words, and no pattern of the allow-list fits it."""
    fine = words(s)
    for pattern in ALLOWED if allowed is None else allowed:
        fine = fine | F.regexp_like(s, F.lit(pattern))
    return F.when(fine, F.lit(False)).otherwise(window_entropy(s) >= limit(s))


def scan(docs: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, base and added (arrays of start, end, kind index, hit)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("t"))
    found = found.select("doc_id", matches(F.col("t"), ASSIGN, 0, 2, 12).alias("a"), matches(F.col("t"), ACCESS, 1).alias("k"), matches(F.col("t"), HEX, 2).alias("h"), matches(F.col("t"), CANDIDATE, 3).alias("c"))
    found = found.select("doc_id", F.array_sort(F.concat("a", "k", "h")).alias("base"), "c")
    meet = lambda a, b: (a.start < b.end) & (b.start < a.end)

    def block(first: Column) -> Column:
        """Added spans of a block of candidates, which only the base spans about the block can suppress."""
        about = lambda c: F.filter("base", lambda b: (b.start < F.element_at(c, -1).end) & (F.element_at(c, 1).start < b.end))
        keep = lambda c: let(about(c), lambda near: F.filter(c, lambda x: ~F.exists(near, lambda b: meet(b, x)) & suspicious(x.hit, allowed)))
        return let(F.slice("c", first, F.lit(BLOCK)), keep)

    return found.select("doc_id", "base", F.flatten(F.transform(_blocks(F.size("c")), block)).alias("added"))
