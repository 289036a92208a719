"""Secrets in whole texts: known patterns, and strings that a battery of tests finds random.

All of it is column expressions. Patterns give spans. Other long strings are
tested in what sets random characters of their encoding apart: even use of the
alphabet (chi-squared), as many runs above and below its middle (runs test),
no correlation of neighbours. Each test has two p-values. ``battery`` gives
those of the null "the characters are random". What is reported, though, is
decided on the null "the string is ordinary": its characters coincide as often
as those of prose or of numbers, its runs or its neighbours are fixed. A string
must reject all three parts, so its p-value is the largest of theirs; and the
step-up rule of false-discovery control over the whole corpus, with longer
strings, whose tests see more, weighted up, alone says which are found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparsight.session import materialize

#: kind, pattern, group that must reach the length, least length
PATTERNS = (
    (
        "assign",
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
        r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1, 6,
    ),
    # runs of one class: the length may stand in the pattern, as a shorter run has no longer match in it
    ("access", r"AKIA[A-Z0-9]{16,}+", 0, 20),
    ("hex", r"[0-9a-f]{24,}+", 0, 24),
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = tuple(p[0] for p in PATTERNS) + ("random",)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: of the strings reported, the share that may be ordinary
FALSE_DISCOVERY = 0.01
#: how often two characters of an ordinary string are equal. Letters of one case as in English prose; of both
#: cases and with signs less, as names in CamelCase or with numbers spread over more characters; digits, in times of random
ONE_CASE, MIXED, NUMBERS = 0.0655, 0.05, 2.5
#: matches whose places are summed up together, so that a text with very many is not copied for each
CHUNK = 256
#: width of a p-value bin, in powers of ten, and the smallest p-value told apart
BIN, LEAST = 0.05, 1e-30
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: pattern that a string of the encoding matches, and its alphabet in order; the first that matches holds, so smaller ones stand first
ENCODINGS = (
    ("[0-9]+", _DIGITS),
    ("[0-9a-f]+", _DIGITS + "abcdef"),
    ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("[A-Z2-7]+=*", _UPPER + "234567"),
    ("(?=.*[2-7])[a-z2-7]+", _LOWER + "234567"),
    ("(?=.*[0-9])[0-9a-z]+", _DIGITS + _LOWER),
    ("[0-9A-Z]+", _DIGITS + _UPPER),
    ("(?=.*[0-9])[1-9A-HJ-NP-Za-km-z]+", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"),
    ("(?=.*[0-9])[0-9A-Za-z]+", _DIGITS + _UPPER + _LOWER),
)
_BASE_64 = _UPPER + _LOWER + _DIGITS + "+/"
#: groups of digits between dashes, as in a UUID; the dashes are not tested
DASHED = "^(?:[0-9a-f]{4,}(?:-[0-9a-f]{4,})+|[0-9A-F]{4,}(?:-[0-9A-F]{4,})+)$"
SPAN = "struct<start:int,kind:int,end:int>"


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match of the kind passes."""
    if kind == "assign":
        low = F.lower(text)
        return reduce(Column.__or__, (low.contains(k) for k in _KEYWORDS))
    return text.contains("AKIA") if kind == "access" else text.rlike("[0-9a-f]{24}")


def pattern_spans(text: Column, kind: str) -> Column:
    """``start, kind, end`` of the leftmost matches of a kind, in code points."""
    number = KINDS.index(kind)
    pattern, group, least = next((p[1:] for p in PATTERNS if p[0] == kind), (CANDIDATE, 0, 20))
    spans = _spans(text, pattern, number)
    if group:
        # keep each match whose group is long enough
        sizes = F.regexp_extract_all(text, F.lit(pattern), group)
        spans = F.filter(
            F.zip_with(spans, sizes, lambda s, g: F.when(F.length(g) >= least, s)), lambda s: s.isNotNull()
        )
    return F.when(_may_hold(text, kind), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _spans(text: Column, pattern: str, number: int) -> Column:
    """``start, kind, end`` of all matches."""
    return F.transform(_matches(text, pattern), lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")
    ))


def _matches(text: Column, pattern: str) -> Column:
    """``start, end, word``: matches are what stands between the parts of the text that the pattern splits.

    Places are running sums, taken within chunks of matches and then over these.
    """
    parts = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"), m.alias("word")),
    )
    state = lambda at, kind: F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("found"))
    match = "struct<start:int,end:int,word:string>"

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        found = F.struct(start.alias("start"), (start + x["m"]).alias("end"), x["word"].alias("word"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(
            (start + x["m"]).alias("at"), F.concat(acc["found"], F.array(found)).alias("found")
        ))

    def chunk(acc: Column, part: Column) -> Column:
        return _bound(F.aggregate(part, state(acc["at"], match), one), lambda got: F.struct(
            got["at"].alias("at"), F.concat(acc["found"], F.array(got["found"])).alias("found")
        ))

    def chunked(parts: Column) -> Column:
        last = F.floor((F.size(parts) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(parts, i * CHUNK + 1, F.lit(CHUNK)))
        return F.aggregate(chunks, state(F.lit(0), f"array<{match}>"), chunk, lambda acc: F.flatten(acc["found"]))

    return _bound(parts, chunked)


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, by start and then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )))


def _upper_tail(z: Column) -> Column:
    """The share of a standard normal above ``z``, by a logistic fit good to about 1e-4."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(word: Column) -> dict[str, Column]:
    """The tests of a string: its encoding's size, and the p-value of each test.

    The encoding is the first of ``ENCODINGS`` that the string matches, else
    base 64; random characters of a larger alphabet that fall into a smaller
    one are random in that too. Letters without a digit are no base 36, 58 or
    62, so that long words are held against base 64. P-values are small where
    the string is unlike random characters.
    """
    tests = _tested(word)
    return {name: tests[name] for name in ("alphabet", "p_uniform", "p_runs", "p_serial")}


def _tested(word: Column) -> Column:
    bare = F.when(word.rlike(DASHED), F.replace(word, F.lit("-"), F.lit(""))).otherwise(word)
    return _bound(bare, lambda w: _bound(_alphabet(w), lambda alphabet: _tests(w, alphabet)))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often and in whatever loop it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _alphabet(word: Column) -> Column:
    return reduce(
        lambda rest, e: F.when(word.rlike(f"^{e[0]}$"), F.lit(e[1])).otherwise(rest), reversed(ENCODINGS), F.lit(_BASE_64)
    )


def _tests(word: Column, alphabet: Column) -> Column:
    size, n = F.length(alphabet), F.length(word)
    letters = F.split(word, "(?!^)(?!$)")
    squares = F.aggregate(
        F.array_distinct(letters), F.lit(0.0),
        lambda acc, c: acc + F.pow(n - F.length(F.replace(word, c, F.lit(""))), F.lit(2.0)),
    )
    # the place of a character in its alphabet; what is none of its letters and digits stands at 62
    code = lambda c: F.when(
        c.isin("+", "/", "-", "_", "="), F.least(size - 1, F.lit(62))
    ).otherwise(F.position(c, alphabet) - 1).cast("double")
    codes = F.transform(letters, code)
    sums = lambda codes: F.struct(
        size.alias("size"), n.alias("n"), squares.alias("squares"),
        (F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + x) / n).alias("mean"),
        F.size(F.filter(codes, lambda x: x >= size / 2)).alias("above"),
    )
    return _bound(codes, lambda codes: _bound(sums(codes), lambda x: _p_values(codes, x)))


def _p_values(codes: Column, sums: Column) -> Column:
    size, n, squares, mean, above = (sums[x] for x in ("size", "n", "squares", "mean", "above"))
    chi = size / n * squares - n
    df = size - 1
    # cube roots of chi-squared are close to normal
    z_chi = (F.cbrt(chi / df) - (1 - 2 / (9.0 * df))) / F.sqrt(2 / (9.0 * df))
    below = n - above
    pairs = lambda f: F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), f)
    changes = F.size(F.filter(pairs(lambda a, b: (a >= size / 2) != (b >= size / 2)), lambda x: x))
    expected = 2.0 * above * below / n + 1
    spread = F.sqrt(F.greatest(F.lit(1e-9), (expected - 1) * (expected - 2) / (n - 1)))
    z_runs = F.when((above == 0) | (below == 0), 8.0).otherwise(F.abs(changes + 1 - expected) / spread)
    power = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    product = F.aggregate(pairs(lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda acc, x: acc + x)
    z_serial = _bound(power, lambda power: F.when(power == 0, 8.0).otherwise(
        F.abs(product / power + 1.0 / n) * F.sqrt(n.cast("double"))
    ))
    p = lambda z, sides: _bound(z, lambda z: F.greatest(sides * _upper_tail(z), F.lit(LEAST)))
    # the null of ordinary strings: coincidences raise chi-squared by a part that grows with the length
    equal = F.when(size <= 16, F.lit(NUMBERS)).when(size <= 36, size * ONE_CASE).otherwise(size * MIXED)
    more = n * (equal - 1)
    degrees = (df + more) * (df + more) / (df + 2 * more)
    z_even = (F.cbrt(chi / (df + more)) - (1 - 2 / (9 * degrees))) / F.sqrt(2 / (9 * degrees))
    # and runs or neighbours are fixed
    z_changing = F.when((above == 0) | (below == 0), 8.0).otherwise(
        (F.abs(changes + 1 - expected) - (expected - 1)) / spread
    )
    z_free = _bound(power, lambda power: F.when(power == 0, 8.0).otherwise(
        (F.abs(product / power + 1.0 / n) - 1) * F.sqrt(n.cast("double"))
    ))
    return F.struct(
        size.alias("alphabet"), n.alias("n"),
        p(z_chi, 1).alias("p_uniform"), p(z_runs, 2).alias("p_runs"), p(z_serial, 2).alias("p_serial"),
        p(-F.greatest(z_even, z_changing, z_free), 1).alias("p"),
    )


def _strings(text: Column, base: Column) -> Column:
    """``start, end, word`` of the long strings that no pattern covers."""
    return F.filter(_matches(text, CANDIDATE), lambda m: ~F.exists(
        base, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])
    ))


def _bin(p: Column, n: Column, mean: float) -> Column:
    """The p-value of a string of ``n`` characters over its weight, in bins; weights have mean one."""
    scaled = F.least(F.lit(1.0), p * F.lit(mean) / _weight(n))
    return F.ceil(F.log10(F.greatest(scaled, F.lit(LEAST))) / BIN).cast("int")


def _weight(n: Column) -> Column:
    return F.log2(n / 20.0 + 1)


def step_up(tested: DataFrame, rate: float = FALSE_DISCOVERY) -> tuple[float, int]:
    """Mean weight and last bin found, over all strings (``p, n``), by the step-up rule at ``rate``.

    P-values meet in bins, of which there is a fixed number, so that no sort
    runs over all strings. A bin counts with its upper end.
    """
    mean, total = tested.agg(F.avg(_weight(F.col("n"))), F.count("*")).first()
    cut, rank = -(10**6), 0
    for row in sorted(tested.groupBy(_bin(F.col("p"), F.col("n"), mean or 1.0).alias("bin")).count().collect()):
        rank += row[1]
        if 10 ** (row[0] * BIN) <= rate * rank / total:
            cut = row[0]
    return mean or 1.0, cut


def secret_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with the array ``name`` of all spans: ``start, kind`` (place in ``KINDS``), ``end``.

    Null and empty texts have none. Repeated rows are judged each for itself.
    Pattern spans are the leftmost of each kind and may overlap between kinds.
    """
    while name in docs.columns:
        name += "_"
    held = "__base"
    while held in docs.columns:
        held += "_"
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*(pattern_spans(t, p[0]) for p in PATTERNS))
    long = t.rlike(CANDIDATE)  # a text without needs no look at its strings
    strings = docs.where(long).select(F.explode(_strings(t, base)).alias("s")).select(_tested(F.col("s.word")).alias("x"))
    mean, cut = step_up(materialize(strings.select("x.p", "x.n"), "strings"))
    # what was found is told from the text again: rows need no key, and nothing is joined
    found = F.filter(_strings(t, F.col(held)), lambda m: _bound(
        _tested(m["word"]), lambda x: _bin(x["p"], x["n"], mean) <= cut
    ))
    found = F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), m["end"].alias("end")
    ))
    more = F.when(long, found).otherwise(F.array().cast(f"array<{SPAN}>"))
    return docs.withColumn(held, base).select(
        *(F.col(f"`{c}`") for c in docs.columns), F.array_sort(F.concat(held, more)).alias(name)
    )


def masked(text: Column, spans: Column, mark: str = "***") -> Column:
    """``text`` with every span, and what spans overlap, replaced by ``mark``."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        F.array_sort(spans), state,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["end"] <= acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.when(s["start"] >= acc["at"], F.concat(
                    F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)
                )).otherwise(F.lit("")),
            )).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
