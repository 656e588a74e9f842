"""Secret scans: fixed patterns, and strings that look random, by DataFrame functions alone.

Tokens long enough are told their likely encoding; a battery of tests (chi-squared uniformity over the encoding's
alphabet, runs above and below its middle, serial correlation) gives each a number: how surely it isn't random. The same
battery goes over strings put together from ordinary words of every document, which tells how often text looks as random
as a token does. Within each class of lengths, a step-up procedure over all tokens of the corpus reports those that text
hardly ever looks like, so that the share of plain strings among what is reported stays below the class's level.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so asking for the least length in the pattern finds what filtering all runs by length would.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
#: The same holds here; looking behind spares trying every place inside a word.
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Strings of which a text with a match has at least one, in lower case for the first: a quick look before the pattern.
WORDS = {ASSIGN: ("password", "passwd", "secret", "token", "apikey", "api_key"), ACCESS: ("AKIA",)}
LEAST_ASSIGNED = 6
#: Least lengths of the classes, and the false-discovery level of each: laxer where the tests have little power.
LENGTHS = ((20, 0.2), (28, 0.1), (40, 0.05), (64, 0.02), (128, 0.01))
#: Steps of the histogram of -ln p under randomness; the last holds all beyond.
STEPS, MOST_BINS = 8, 400
#: Elements of an array that are walked at once where each needs what came before it.
PART = 64
#: How words are put together to stand for plain strings; the first two give strings of letters alone.
JOINED = ("", "initcap", "-", "_", "/")
#: Longer tokens are tested in blocks of this length, the last with what is left over; the whole token is the span.
TESTED = 512
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("^[0-9]+$", _DIGITS), ("^[0-9a-f]+$", _DIGITS + "abcdef"), ("^[0-9A-F]+$", _DIGITS + "ABCDEF"), ("^[a-z]+$", _LOWER), ("^[A-Z]+$", _LOWER.upper()), ("^[A-Za-z]+$", _LOWER.upper() + _LOWER), ("^[A-Z2-7]+$", _LOWER.upper() + "234567"), ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _LOWER.upper()), ("^[0-9A-Za-z]+$", _DIGITS + _LOWER.upper() + _LOWER), ("^[0-9A-Za-z_-]+$", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
)
BASE64 = _LOWER.upper() + _LOWER + _DIGITS + "+/-_"
SPANS = "array<struct<start:int,end:int,found:string>>"
MASK = "[SECRET]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def before(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each value, what all values before it merge to; in parts, so that long arrays take little more than linear time."""

    def all_of(array: Column) -> Column:
        return F.aggregate(array, zero, merge)

    def inside(part: Column, start: Column) -> Column:
        return F.transform(part, lambda _, i: merge(start, all_of(F.slice(part, F.lit(1), i))))

    last = F.greatest(F.ceil(F.size(values) / PART).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * PART + 1, F.lit(PART)))
    joined = lambda p, totals: F.flatten(F.transform(p, lambda part, k: inside(part, all_of(F.slice(totals, F.lit(1), k)))))
    return let(parts, lambda p: let(F.transform(p, all_of), lambda totals: joined(p, totals)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap, with the code points at which they start and end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    walk = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("n"), m.alias("m")))

    def spans(rows: Column) -> Column:
        starts = before(F.transform(rows, lambda x: x["gap"] + x["n"]), F.lit(0), lambda a, b: a + b)
        out = F.zip_with(rows, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["m"].alias("found")))
        return F.slice(out, F.lit(1), F.size(rows) - 1)  # what follows the last match is no match

    if pattern in WORDS:
        body = F.lower(text) if pattern == ASSIGN else text
        there = reduce(lambda a, b: a | b, [body.contains(w) for w in WORDS[pattern]])
    else:
        there = text.rlike(pattern)
    return F.when(there, let(walk, spans)).otherwise(F.array().cast(SPANS))


def tail(z: Column) -> Column:
    """Chance that a normal variable exceeds z (a rational approximation, good to seven digits)."""

    def upper(x: Column, t: Column) -> Column:
        poly = F.lit(0.17087277)
        for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
            poly = poly * t + c
        return 0.5 * t * F.exp(-x * x - 1.26551223 + t * poly)

    beyond = let(F.abs(z) / F.sqrt(F.lit(2.0)), lambda x: let(1 / (1 + 0.5 * x), lambda t: upper(x, t)))
    return let(beyond, lambda u: F.when(z >= 0, u).otherwise(1 - u))


def bin_of(token: Column) -> Column:
    """Step of -ln p at which the battery puts a token.

    The hypothesis is that some block of the token is random, so its p-value is the largest of its blocks' ones.
    """
    n = F.length(token)
    last = F.greatest(F.floor(n / TESTED).cast("int"), F.lit(1)) - 1
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(token, k * TESTED + 1, F.when(k == last, n).otherwise(F.lit(TESTED))))
    return F.array_min(F.transform(blocks, block_bin))


def block_bin(s: Column) -> Column:
    """Step of -ln p at which the battery puts a token, or a block of one."""
    chosen = F.lit(BASE64)
    for pattern, letters in reversed(ENCODINGS):
        chosen = F.when(s.rlike(pattern), F.lit(letters)).otherwise(chosen)

    def tested(x: Column) -> Column:
        n, a, v = x["n"].cast("double"), x["a"].cast("double"), x["v"]
        df = a - 1
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, u: acc + F.pow(F.size(F.filter(v, lambda w: w == u)).cast("double"), F.lit(2.0)))
        chi = F.pow(F.greatest(a / n * squares - n, F.lit(0.0)) / df, F.lit(1 / 3))
        z_chi = (chi - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        pairs = F.zip_with(F.slice(v, F.lit(1), x["n"] - 1), F.slice(v, F.lit(2), x["n"] - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

        def z_runs(high: Column, runs: Column, mean: Column) -> Column:
            spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
            return F.when((high == 0) | (high == n), F.lit(6.0)).otherwise((runs - mean) / spread)

        def z_lag(y: Column, centre: Column) -> Column:
            spread = F.aggregate(v, F.lit(0.0), lambda acc, w: acc + (w - centre) * (w - centre))
            lag = F.aggregate(y, F.lit(0.0), lambda acc, e: acc + (e["p"] - centre) * (e["q"] - centre))
            return let(spread, lambda d: F.when(d == 0, F.lit(6.0)).otherwise((lag / F.greatest(d, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))

        def both(y: Column) -> Column:
            changes = 1.0 + F.size(F.filter(y, lambda e: (e["p"] >= a / 2) != (e["q"] >= a / 2)))
            high = F.size(F.filter(v, lambda w: w >= a / 2)).cast("double")
            runs = let(high, lambda h: let(2 * h * (n - h) / n + 1, lambda mean: z_runs(h, changes, mean)))
            lag = let(F.aggregate(v, F.lit(0.0), lambda acc, w: acc + w) / n, lambda centre: z_lag(y, centre))
            return F.array(let(z_chi, tail), let(F.abs(runs), lambda z: 2 * tail(z)), let(F.abs(lag), lambda z: 2 * tail(z)))

        def fisher(parts: Column) -> Column:
            half = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - F.log(F.least(F.greatest(p, F.lit(1e-30)), F.lit(1.0))))
            return let(half, lambda h: h - F.log(1 + h + h * h / 2))

        minus_log_p = let(let(pairs, both), fisher)
        return F.least(F.floor(minus_log_p * STEPS), F.lit(MOST_BINS)).cast("int")

    def valued(alphabet: Column) -> Column:
        values = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        return F.struct(F.length(s).alias("n"), F.length(alphabet).alias("a"), values.alias("v"))

    return let(let(chosen, valued), tested)


def group_of(token: Column) -> Column:
    """Number of the tokens that are judged together: a class of lengths, with letters alone or with other signs."""
    out = F.lit(0)
    for i, (least, _) in enumerate(LENGTHS):
        out = F.when(F.length(token) >= least, F.lit(i)).otherwise(out)
    return 2 * out + F.when(token.rlike("[^A-Za-z]"), 1).otherwise(0)


def judged(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(group_of(t).alias("group"), bin_of(t).alias("bin")))


def plain_strings(text: Column) -> Column:
    """One string of each length class's least length, put together from words at a place that the text's hash picks."""
    words = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: (w != "") & (F.length(w) < LENGTHS[0][0]))

    def joined(words: Column, least: int, k: int) -> Column:
        at = F.pmod(F.xxhash64(text, F.lit(k)), F.size(words)).cast("int") + 1
        some = F.slice(F.concat(words, words), at, F.least(F.size(words), F.lit(least)))
        way = F.pmod(F.xxhash64(text, F.lit(k), F.lit(1)), F.lit(len(JOINED)))
        out = F.array_join(some, "")
        for i, by in enumerate(JOINED[1:], 1):
            out = F.when(way == i, F.array_join(F.transform(some, F.initcap), "") if by == "initcap" else F.array_join(some, by)).otherwise(out)
        return F.substring(out, 1, least)

    def made(words: Column) -> Column:
        return F.filter(F.array(*(F.when(F.length(s) == least, s) for k, (least, _) in enumerate(LENGTHS) for s in [joined(words, least, k)])), lambda s: s.isNotNull())

    return F.when(F.size(words) > 0, let(words, made)).otherwise(F.array().cast("array<string>"))


def random_up_to(docs: DataFrame, text: str = "text") -> list[int]:
    """For each group the largest bin that the step-up procedure reports as random; -1 if it reports none.

    p-value of a bin: the share of plain strings of the group, from all documents, that look as random or more. Counts
    cover all tokens of all documents; to the driver comes one row a group.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.transform(matches(body, TOKEN), lambda x: x["found"])
    both = F.concat(F.transform(judged(found), lambda x: x.withField("token", F.lit(1))), F.transform(judged(plain_strings(body)), lambda x: x.withField("token", F.lit(0))))
    # the outer form, as Spark would work the tokens out again to filter rows before the other
    each = docs.select(F.explode_outer(both).alias("t")).select("t.*").where("bin is not null")
    counts = each.groupBy("group", "bin").agg(F.sum("token").alias("n"), F.sum(1 - F.col("token")).alias("plain"))
    # at most 2 * len(LENGTHS) * (MOST_BINS + 1) rows from here on
    up = Window.partitionBy("group").orderBy("bin")
    whole = Window.partitionBy("group")
    p = (1 + F.sum("plain").over(up)) / (1 + F.sum("plain").over(whole))
    level = F.element_at(F.array(*(F.lit(q) for _, q in LENGTHS)), F.floor(F.col("group") / 2).cast("int") + 1)
    share = F.sum("n").over(up) / F.greatest(F.sum("n").over(whole), F.lit(1))
    rows = counts.withColumn("yes", p <= level * share).where("yes and n > 0").groupBy("group").agg(F.max("bin").alias("most")).collect()
    most = {r["group"]: r["most"] for r in rows}
    return [most.get(i, -1) for i in range(2 * len(LENGTHS))]


def secrets_in(body: Column, most: list[int]) -> Column:
    """Spans (start, kind, end) in a text, sorted; most: the largest bin of each group that counts as random."""
    spans = lambda found, kind: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    assigned = F.filter(matches(body, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= LEAST_ASSIGNED)
    limits = F.array(*map(F.lit, most))
    random = F.filter(matches(body, TOKEN), lambda x: bin_of(x["found"]) <= F.element_at(limits, group_of(x["found"]) + 1))
    found = F.array_sort(F.concat(spans(assigned, 0), spans(matches(body, ACCESS), 1), spans(matches(body, HEX), 2), spans(random, 3)))

    def listed_once(all_: Column) -> Column:
        """Without random tokens inside a span of another kind: none of those before reaches beyond them."""
        reach = before(F.transform(all_, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(-1)), F.lit(-1), lambda a, b: F.greatest(a, b))
        kept = F.zip_with(all_, reach, lambda x, r: F.when((x["kind"] < 3) | (r < x["end"]), x))
        return F.filter(kept, lambda x: x.isNotNull())

    return let(found, lambda all_: F.when(F.size(all_) > 0, listed_once(all_)).otherwise(all_))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds secrets: array of (start, kind, end), sorted; kind is a place in KINDS. A column of this name is replaced.

    Null text counts as empty. Spans are code points, the end exclusive. Random tokens inside a span of another kind
    are not listed again. An empty table stays empty. In a corpus with little plain text there is no telling what text
    looks like, and few tokens or none are called random.
    """
    return docs.withColumn("secrets", secrets_in(F.coalesce(F.col(text), F.lit("")), random_up_to(docs, text)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same documents, with each secret's span (overlapping ones as one) replaced by MASK; no column is added."""
    body = F.col(text)

    def blank(spans: Column) -> Column:
        at = before(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        gaps = F.zip_with(spans, at, lambda x, a: F.when(x["start"] >= a, F.concat(F.substring(body, a + 1, x["start"] - a), F.lit(MASK))))
        return F.concat(F.array_join(gaps, ""), F.substring(body, F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length(body)))

    spans = secrets_in(F.coalesce(body, F.lit("")), random_up_to(docs, text))
    return docs.withColumn(text, let(spans, lambda s: F.when(F.size(s) > 0, blank(s)).otherwise(body)))
