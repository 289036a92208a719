import pytest
from pyspark.sql import functions as F

from sparsight.operators import budget, latents


def codes(spark):
    rows = [(i % 50, 1 + i % 7, 0 if i % 3 else 1, (i * 37 % 101) / 10) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, tok_pos int, latent int, z double"), rows


@pytest.mark.parametrize("k", [1, 7, 1_500])
def test_top_equals_a_full_sort(spark, k):
    df, rows = codes(spark)
    got = latents.top_activations(df, k).orderBy("latent", "rank").collect()
    for latent in (0, 1):
        mine = sorted((r for r in rows if r[2] == latent), key=lambda r: (-r[3], r[0], r[1]))[:k]
        found = [(r.doc_id, r.tok_pos, r.latent, r.z) for r in got if r.latent == latent]
        assert found == mine


def test_small_k_is_cut_before_the_exchange(spark):
    df, _ = codes(spark)
    plan = latents.top_activations(df, 5)._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Exchange hashpartitioning")[-1]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_context_and_highlight(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    top = spark.createDataFrame(
        [(0, 1, 1, 1), (0, 2, 1, 4), (1, 1, 1, 6)], "latent int, rank int, doc_id long, tok_pos int"
    )
    got = latents.highlight(latents.with_context(top, docs, 2)).orderBy("latent", "rank").collect()
    assert [" ".join(r.tokens) for r in got] == ["<<a>> b c", "b c <<d>> e f", "d e <<f>>"]
    assert [r.token for r in got] == ["a", "d", "f"]


def test_import_of_marked_sentences(spark):
    text = "3. We <<talk>> often\n\n  \n10. say <<talk>>, <<hello>> <<twice>>\n<<<odd>>> one\n12."
    df = spark.createDataFrame([(1, text)], "k int, text string")
    rows = latents.import_marked(df, ["k"])
    assert [(r["rank"], r.tokens) for r in rows.orderBy("rank").collect()] == [
        (0, ["We", "<<talk>>", "often"]),
        (1, ["say", "<<talk>>,", "<<hello>>", "<<twice>>"]),
        (2, ["<<odd>>", "one"]),
        (3, []),
    ]
    counts = {r.token: r.n for r in latents.marked_counts(rows).collect()}
    assert counts == {"<<talk>>": 1, "<<hello>>": 1, "<<twice>>": 1, "<<odd>>": 1}


def test_prompt_to_explanations(spark):
    df = spark.createDataFrame(
        [(4, 2, ["you", "<<say>>", "it"]), (4, 1, ["We", "<<talk>>", "often"])],
        "latent int, rank int, tokens array<string>",
    )
    prompts = latents.build_prompts(df)
    row = prompts.first()
    assert row.user == "The activating examples are:\n\n1. We <<talk>> often\n2. you <<say>> it"
    assert row.system == latents.SYSTEM_PROMPT and row.assistant == latents.ASSISTANT_PROMPT
    rows = latents.explanations(latents.named_tokens(df, n=2)).orderBy("n").collect()
    assert [(r.latent, r.n) for r in rows] == [(4, 1), (4, 2)]
    assert rows[0].explanation == "tokens like talk say"
    client = lambda prompt, n: [f" {len(prompt['user'])} {i} " for i in range(n)]
    asked = latents.explanations(latents.explain(prompts, client, n=2)).orderBy("n").collect()
    assert [r.explanation for r in asked] == [f"{len(row.user)} 0", f"{len(row.user)} 1"]


@pytest.mark.parametrize(
    "text, ok",
    [("words about speaking", True), ("", False), ("- a list", False), ("**bold** claim", False),
     ("1. first", False), ("two\nlines", False), (" ".join("x" * 19), True), (" ".join("x" * 20), False)],
)
def test_valid_explanation(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(latents.valid_explanation(F.col("t")).alias("v")).first().v is ok


def test_keywords(spark):
    rows = [(0, 5, 1.0)] * 3 + [(0, 6, 2.0)] * 3 + [(0, 7, 9.0)] + [(1, 7, 1.0)]
    df = spark.createDataFrame(rows, "latent int, token_id int, z double")
    got = latents.latent_keywords(df, 2).orderBy("latent", "rank").collect()
    assert [(r.latent, r.token_id, r.n, r.max_z) for r in got] == [
        (0, 5, 3, 1.0), (0, 6, 3, 2.0), (1, 7, 1, 1.0)
    ]


def test_budgets(spark):
    counts = spark.createDataFrame([("a", 10), ("a", 5), ("b", 1)], "source string, n_tokens long")
    got = {r.source: r for r in budget.compute_budget(counts).collect()}
    assert got["a"].n_tokens == 15 and got["a"].forward_flops == 15 * 1.2e9
    assert got["a"].training_flops == 15 * 6 * 2 * 2048 * 16384
    words = spark.createDataFrame([("x", 2), ("y", 1), ("z", 1)], "token string, n long")
    row = budget.token_entropy(words, 9).first()
    assert row.entropy_bits == pytest.approx(1.5) and row.uniform_bits == pytest.approx(1.584963)
    assert row.equivalent_tokens == pytest.approx(2.0)
    curve = spark.createDataFrame([(float(x), 3.0 * x**0.5) for x in range(1, 9)], "x double, y double")
    fit = budget.powerlaw_fit(curve, "x", "y").first()
    assert (fit.a, fit.b) == (pytest.approx(3.0), pytest.approx(0.5))
