"""Merkle manifest, Hilbert clusters and personal data against plain code."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight.llm import hilbert_clusters as hc, merkle_manifest as mm, midstates as sha, personal_data as pd, queries as llm_queries

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
# names that the operators use inside
EXTRA = "g string, b int, i int, n int, at int, v string, spans string, place int, leaf string"


def extra(spark, rows, schema):
    return spark.createDataFrame([(*r, "g", 1, 2, 3, 4, "v", "s", 5, "l") for r in rows], f"{schema}, {EXTRA}")


# --- Merkle manifest


def plain_levels(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[k:k + arity]) for k in range(0, len(below), arity)])
    return levels


def siblings(levels, at, arity):
    out = []
    for below in levels[:-1]:
        q = at // arity
        out += [below[t] for t in range(q * arity, min(q * arity + arity, len(below))) if t != at]
        at = q
    return out


def words_of(digests):
    return sha.unpacked(b"".join(map(bytes.fromhex, digests)))


def hexes(words):
    return [x.hex() for x in sha.pieces(sha.packed(words))]


def test_midstates_are_those_of_sha256():
    assert hexes(sha.finished(sha.START, 0)) == [H()]
    digests = [H(str(k)) for k in range(5)]
    state = sha.absorb(sha.START, sha.as_block(words_of(digests)))
    assert hexes(sha.finished(state, 1)) == [H(d) for d in digests]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_folding_a_block_is_building_it_anew(arity):
    for n in (1, 2, 3, 7, 26, 33):
        old, new = [H(str(k)) for k in range(n)], [H("new", str(k)) for k in range(n)]
        levels = plain_levels(old, arity)
        nodes, states = mm.subtree(words_of(old), len(levels) - 1, arity)
        assert [hexes(x) for x in nodes] == levels
        top, proof, length = mm.fold_block(nodes, states, np.arange(n), words_of(new), arity)
        assert hexes(top) == [plain_levels([*old[:k], new[k], *old[k + 1:]], arity)[-1][0] for k in range(n)]
        assert hexes(sha.finished(proof, length)) == [H(*siblings(levels, k, arity)) for k in range(n)]


@pytest.mark.parametrize("arity, block", [(2, 8), (3, 9), (2, 4096)])
def test_manifest_matches_plain_trees(spark, tmp_path, arity, block):
    rng = random.Random(5)
    # many groups, one large, one of a null key, an empty name; repeated, tied and null ids; null, empty and long texts
    rows = [(k, rng.choice(["en"] * 4 + ["de", "", None]), rng.choice(["x", "", None, "é" * 40])) for k in range(150)]
    rows += [(7, "en", "x"), (7, "en", "x"), (7, "en", "other"), (None, "en", "x"), (None, None, None), (900, "long", "w " * 200_000)]
    rows += [(1000 + k, f"lang{k}", "y") for k in range(20)]
    docs = extra(spark, rows, "doc_id bigint, lang string, text string").repartition(3)
    fields = [F.col(c) for c in ("doc_id", "lang", "text")]
    leaves = docs.select(F.col("doc_id").alias("id"), mm.group_key(F.col("lang")).alias("g"), mm.leaf(fields).alias("leaf"))
    tree = mm.manifest(leaves, [F.col("id").asc_nulls_first()], arity, block)
    if block == 8:
        tree.write(str(tmp_path / "tree"))
        tree = mm.Manifest.read(spark, str(tmp_path / "tree"))
    new = F.when(F.col("id") % 3 == 0, F.unhex(F.sha2(F.lit("changed"), 256))).otherwise(F.col("leaf"))
    got = mm.folded(tree, tree.leaves.withColumn("new", new)).collect()

    sized = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = {}
    for r in rows:
        groups.setdefault("" if r[1] is None else "=" + r[1], []).append((r[0] is not None, r[0] or 0, H(*map(sized, r)), r[0]))
    names = sorted(groups, key=str.encode)
    trees = {g: plain_levels([x[2] for x in sorted(groups[g])], arity) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names], arity)
    expected = []
    for place, g in enumerate(names):
        for at, (_, _, leaf, key) in enumerate(sorted(groups[g])):
            proof = H(*siblings(trees[g], at, arity), *siblings(top, place, arity))
            own = [x[2] for x in sorted(groups[g])]
            own[at] = H("changed") if key is not None and key % 3 == 0 else leaf
            roots = [trees[x][-1][0] for x in names]
            roots[place] = plain_levels(own, arity)[-1][0]
            expected.append((str(key), leaf, proof, trees[g][-1][0], top[-1][0], plain_levels(roots, arity)[-1][0]))
    found = [(str(r.id), *(bytes(r[c]).hex() for c in ("leaf", "proof", "subroot", "root", "folded"))) for r in got]
    assert sorted(found) == sorted(expected)


def test_manifest_of_an_empty_table_and_refused_names(spark):
    none = spark.createDataFrame([], "id bigint, g string, leaf binary")
    tree = mm.manifest(none, [F.col("id")])
    assert mm.folded(tree, tree.leaves.withColumn("new", F.col("leaf"))).collect() == []
    with pytest.raises(ValueError, match="otherwise"):
        mm.manifest(none.withColumn("b", F.lit(1)), [F.col("id")])


# --- Hilbert clusters


@pytest.mark.parametrize("dimensions, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_in_unit_steps(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = hc.hilbert_keys(cells, bits)
    order = sorted(range(len(cells)), key=keys.__getitem__)
    assert len(set(keys)) == len(cells)
    assert all(abs(cells[a] - cells[b]).sum() == 1 for a, b in zip(order, order[1:]))


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(0)
    seen = 0
    for _ in range(400):
        c = rng.integers(-9, 9, (6, 3))
        v = rng.integers(-9, 9, 3) + rng.integers(-2, 3, (20, 3))
        among = hc.candidates(v.min(0), v.max(0), c)
        seen += len(among)
        for x, y in zip(hc.nearest(v, c, np.arange(6)), hc.nearest(v, c, among)):
            assert (x == y).all()
    assert seen < 400 * 4


def plain_clusters(rows, k, rounds, dimensions):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and abs(x) < 131072 for x in v):
            kept.append((key, [int(np.floor(1024 * float(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, H(f"3:{r[0]}"), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    total = sum(d for d, _ in near)
    by = {n: sum(d for d, m in near if m == n) for n in range(len(centroids))}
    return [(key, n, d, by[n], total) for (key, _), (d, n) in zip(kept, near)], centroids


def test_clusters_match_plain_code(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 3, (5, 4))
    rows = [(k, [float(np.float32(x)) for x in middle[k % 5] + rng.normal(0, 0.5, 4)]) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(200)]  # one vector very often
    rows += [(3, rows[3][1]), (3, [0.0] * 4), (None, [1.0] * 4), (5000, None), (5001, []), (5002, [1.0] * 3), (5003, [1.0, None, 1.0, 1.0])]
    rows += [(5004, [float("nan")] * 4), (5005, [float("inf"), 0.0, 0.0, 0.0]), (5006, [3e38] * 4), (5007, [131071.0, -131071.0, 0.0, 0.0])]
    df = extra(spark, rows, "vec_id bigint, embedding array<float>").repartition(5)
    got, centroids = hc.clusters(df, k=6, rounds=4, dimensions=4)
    expected, plain = plain_clusters(rows, 6, 4, 4)
    assert centroids.tolist() == plain
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    got, centroids = hc.clusters(df, k=8, rounds=2, dimensions=2)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)] and len(centroids) == 2
    got, centroids = hc.clusters(df.where("false"), dimensions=2)
    assert got.collect() == [] and len(centroids) == 0


# --- Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                (name == "ip" and any(int(p) > 255 for p in m.group().split(".")))
                or (name == "card" and not (12 <= len(digits) <= 19 and luhn(digits)))
                or (name == "phone" and not 9 <= len(digits) <= 15)
            ):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "-", "_", " ", "  ", "1", "42", "255", "256", "0007", "+1", "(", ")", "4041894974608795", "é", "x@y.z", "%"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 50_000, "a@b." * 20_000, "+1" * 50_000, " " * 200_000, "- dot " * 20_000, "at dot " * 20_000]
    found = 0
    for text in texts[:4000]:
        got = [s[:3] for s in pd.spans(text) if not s[3]]
        assert got == plain_spans(text), text
        found += len(got)
    assert found > 3000
    for text in texts[4000:]:  # long runs take time in proportion
        pd.spans(text)


DISGUISED = [  # the whole of what stands between the bars is the span
    ("email", "write |jo.42 [at] mail8.example.com| now"), ("email", "|jo(at)mail8(dot)example(dot)com|."),
    ("email", "we meet at |jo dot 42 at mail8 dot example dot com| dot Then"), ("email", "|jo42 AT mail8 DOT example DOT com|"),
    ("email", "see |jo.42 at mail8.example.com| today"), ("email", "|jo @ mail8.example.com|"), ("email", "|jo-at-example-dot-com|"),
    ("email", "|jo.42＠mail8.example.com| y"), ("email", "|j​o.42@mail8.exаmple.com|"), ("email", "|jo@mail8 dot example dot com|"),
    ("email", "escribe a |jo arroba example punto com|"), ("email", "|jo {at} example {dot} org|"), ("email", "|ϳo.ѕ@exаmple.com|".replace("ϳ", "ј")),
    ("phone", "call |plus one nine eight eight five five five two four eight five| ok"), ("phone", "|+1 (988) five five five two four eight five|"),
    ("phone", "|+1\u00a0988\u00a0555\u00a02485|"), ("phone", "|＋1 (988) 555‑2485|"), ("phone", "|plus four nine, double five, one two three four five six|"),
    ("phone", "|plus eins neun acht acht fünf fünf fünf zwei vier acht fünf|"),
    ("ip", "at |42 dot 144 dot 35 dot 254| x"), ("ip", "|four two dot one four four dot three five dot two five four|"), ("ip", "|192[.]168[.]1[.]10|"),
    ("card", "card |4O41894974608795| x"), ("card", "|four oh four one eight nine four nine seven four six oh eight seven nine five|."),
    ("card", "|４０４１ ８９４９ ７４６０ ８７９５|"), ("card", "|quatre zéro quatre un huit neuf quatre neuf sept quatre six zéro huit sept neuf cinq|"),
]
CLEAN = [
    "arrive at the dot com bubble", "available at example.com today", "look at me dot the", "user@example.com", "a@b.com dot de",
    "num 4041894974608795 un étre", "double five", "une un deux", "one two three four", "plus one", "le point de vue at the point", "1990–1995",
    "en tres puntos, dos de los cuales son seis", "version 2 dot 0 dot 1", "почта и телефон", "x² + y² = 5²", "file 12\u00a0345 pages", "price @ 5.99", "",
]


@pytest.mark.parametrize("kind, marked", DISGUISED)
def test_disguises_map_back_to_their_characters(kind, marked):
    before, span, after = marked.split("|")
    got = [(pd.KINDS[k], a, b) for a, k, b, added in pd.spans(before + span + after) if added]
    assert got == [(kind, len(before), len(before) + len(span))]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_gain_nothing(text):
    assert not [s for s in pd.spans(text) if s[3]]


def test_edits_map_every_place_back():
    rng = random.Random(1)
    for _ in range(300):
        text, stages = "".join(rng.choices("abcdefgh", k=30)), []
        owner = [(k, k + 1) for k in range(len(text))]
        new = text
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(new) + 1), min(6, len(new) + 1) // 2 * 2))
            edits = [(a, b, rng.choice(["", "X", "YZ"])) for a, b in zip(cuts[::2], cuts[1::2])]
            out, at = [], 0
            for a, b, to in edits:
                out += owner[at:a] + [(owner[a][0], owner[b - 1][1])] * len(to)
                at = b
            owner = out + owner[at:]
            stages.append(pd.Rewritten(new, edits))
            new = stages[-1].text
        assert len(new) == len(owner)
        for a in range(len(new)):
            for b in range(a + 1, len(new) + 1):
                assert pd._source_of(stages, a, b)[:2] == (owner[a][0], owner[b - 1][1])


def test_table_of_texts(spark):
    texts = [*[m.replace("|", "") for _, m in DISGUISED], *CLEAN, None, "w " * 300_000 + "a@b.cd", "mail a@b.cd", "mail a@b.cd"]
    rows = [(k if k else None, t) for k, t in enumerate(texts)]
    df = extra(spark, [*rows, rows[-1]], "doc_id bigint, text string").repartition(3)
    got = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in pd.personal_spans(df).collect())
    assert got == sorted((str(k), pd.spans(t or "")) for k, t in [*rows, rows[-1]])
    assert pd.personal_spans(df.where("false")).collect() == []
    assert df.limit(1).select(pd.joined(F.expr(f"cast(array() as array<{pd.SPAN}>)")).alias("x")).first().x == ""


def test_letters_that_only_match_without_case(spark):
    """``İ`` matches ``i`` but has another lower case: such words are digits too, and base spans are all there."""
    text = "mail a@b.cd, +SİX ſEVEN nıne six six SİX NİNE six FİVE ſix"
    base = [(5, "email", 11)]
    found = pd.spans(text)
    assert [(a, pd.KINDS[k], b) for a, k, b, added in found if not added] == base
    assert [(a, pd.KINDS[k]) for a, k, _, added in found if added] == [(13, "phone")]
    row = pd.personal_spans(extra(spark, [(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(s) for s in row.spans] == found


def test_query_counts_each_kind(spark, tmp_path):
    texts = ["a@b.cd, c@d.ef and 1.2.3.4", "+1 234 567 8901 or 4111 1111 1111 1111, a@b.cd", "1.2.3.4 5.6.7.8 9.9.9.9", "none", None]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = llm_queries.QUERIES["op13_personal_data"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [
        (2, 1, 0, 0), (1, 0, 1, 1), (0, 3, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0),
    ]
