"""Which strings the secret scan reports: against plain loops, and both rates of error in prose."""

import math
import re

import numpy as np
import pytest

from sparsight.llm import secret_scan

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = (
    "account address between business children company country different document education example experience family "
    "following government history important information interest language library market material member nothing number "
    "office original people picture possible president problem program question reason remember research school science "
    "service several social special student subject system thousand together understand university usually without writing"
).split()


def ordinary(rng, n):
    pick = lambda: rng.choice(WORDS, rng.integers(3, 7))
    makers = [
        lambda: "/".join(pick()), lambda: "".join(w.capitalize() for w in pick()), lambda: "_".join(pick()),
        lambda: "".join(pick()), lambda: "-".join(pick()) + str(rng.integers(0, 1000)), lambda: f"{rng.integers(0, 10**7):022}",
        lambda: f"{rng.integers(1990, 2030)}{rng.integers(1, 13):02}{rng.integers(1, 29):02}{rng.integers(0, 24):02}0000000000",
        lambda: "_".join(pick()).upper(),
    ]
    made = (makers[i % len(makers)]() for i in range(10 * n))
    return [w for w in made if len(w) >= 20][:n]


def tokens(rng, n):
    kinds = [
        (DIGITS + UPPER + LOWER, 32), (DIGITS + UPPER + LOWER + "+/", 40), (DIGITS + "ABCDEF", 32), (DIGITS + LOWER, 64),
        (UPPER + "234567", 48),
    ]
    return ["".join(rng.choice(list(kinds[i % 5][0]), kinds[i % 5][1])) for i in range(n)]


def prose(rng, strings):
    """Each string between words, ten in a text."""
    texts = []
    for at in range(0, len(strings), 10):
        parts = []
        for w in strings[at : at + 10]:
            parts += [*rng.choice(WORDS, 3), w]
        texts.append(" ".join(parts) + " end")
    return texts


def plain_p(word):
    """The p-value of the ordinary string, by loops."""
    if re.match(secret_scan.DASHED, word):
        word = word.replace("-", "")
    alphabet = next((a for p, a in secret_scan.ENCODINGS if re.fullmatch(p, word)), UPPER + LOWER + DIGITS + "+/")
    k, n = len(alphabet), len(word)
    chi = k / n * sum(word.count(c) ** 2 for c in set(word)) - n
    equal = 2.5 if k <= 16 else k * (0.0655 if k <= 36 else 0.05)
    mean, df = k - 1 + n * (equal - 1), (k - 1 + n * (equal - 1)) ** 2 / (k - 1 + 2 * n * (equal - 1))
    zs = [((chi / mean) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))]
    codes = [min(k - 1, 62) if c in "+/-_=" else alphabet.index(c) for c in word]
    up = [c >= k / 2 for c in codes]
    above = sum(up)
    if above in (0, n):
        zs.append(8.0)
    else:
        runs = 1 + sum(a != b for a, b in zip(up, up[1:]))
        e = 2 * above * (n - above) / n + 1
        zs.append((abs(runs - e) - (e - 1)) / math.sqrt(max(1e-9, (e - 1) * (e - 2) / (n - 1))))
    m = sum(codes) / n
    power = sum((c - m) ** 2 for c in codes)
    r = sum((a - m) * (b - m) for a, b in zip(codes, codes[1:])) / power if power else None
    zs.append(8.0 if r is None else (abs(r + 1 / n) - 1) * math.sqrt(n))
    z = -min(8.0, max(-8.0, max(zs)))
    return max(1e-30, 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3)))


def plain_found(words, rate=0.01):
    """The step-up rule over weighted p-values rounded up to bins, by sorting."""
    weights = [math.log2(len(w) / 20 + 1) for w in words]
    mean = sum(weights) / len(words)
    bins = [math.ceil(math.log10(max(min(1.0, plain_p(w) * mean / x), 1e-30)) / 0.05) for w, x in zip(words, weights)]
    ranked = sorted(bins)
    cut = max((b for i, b in enumerate(ranked) if 10 ** (b * 0.05) <= rate * (i + 1) / len(words)), default=-(10**6))
    return [w for w, b in zip(words, bins) if b <= cut]


def reported(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    rows = secret_scan.secret_spans(df).collect()
    return [texts[r.doc_id][s.start : s.end] for r in rows for s in r.spans if s.kind == 3]


@pytest.mark.parametrize(("share", "n", "least"), [(0.02, 3000, 0.75), (0.2, 1000, 0.9), (0.7, 1000, 0.9)])
def test_few_ordinary_strings_are_reported_and_few_random_ones_lost(spark, share, n, least):
    """The rarer random strings are, the stronger the evidence that the rule asks for."""
    rng = np.random.default_rng(int(100 * share))
    planted = tokens(rng, int(n * share))
    strings = planted + ordinary(rng, n - len(planted))
    rng.shuffle(strings)
    texts = prose(rng, strings)
    found = reported(spark, texts)
    held = [m.group() for t in texts for m in re.finditer(secret_scan.CANDIDATE.replace("}+", "}"), t)]
    held = [w for w in held if not re.search("[0-9a-f]{24}|AKIA", w)]
    assert sorted(found) == sorted(plain_found(held))
    print(share, len(set(found) & set(planted)), len(planted), "ordinary:", len(set(found) - set(planted)))
    assert len(set(found) & set(planted)) >= least * len(planted)
    # one in a hundred by the rule, with room for chance
    assert len(set(found) - set(planted)) <= max(1, 0.03 * len(found))


def test_ordinary_strings_alone(spark):
    rng = np.random.default_rng(4)
    strings = ordinary(rng, 800) + [DIGITS + LOWER + UPPER, LOWER + "0123", "0" * 30, "AB" * 15, "x" * 25, "qwerty" * 5]
    assert len(reported(spark, prose(rng, strings))) <= 1


def test_places_of_very_many_matches(spark):
    n = 3 * secret_scan.CHUNK + 1
    texts = ["token=abcdef é " * n, "token=abcdef", "token=abcdef " * secret_scan.CHUNK, "é token=abc" + " secret:abcdefg" * n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    df = df.selectExpr("*", "'kept' AS __base", "1 AS spans")
    pattern = re.compile(r"(?:token|secret)[:=][a-z]{6,}")
    for r in secret_scan.secret_spans(df).collect():
        assert [(s.start, s.end) for s in r.spans_] == [m.span() for m in pattern.finditer(texts[r.doc_id])]
        assert r["__base"] == "kept" and r.spans == 1
