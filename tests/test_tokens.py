import random

from pyspark.sql import functions as F

from sparsight.operators import filters, ordering, packing, tokens

SEQS = [(1, [0, 5, 1]), (2, [0, 6, 7, 1]), (3, [0, 8, 1])]


def seqs(spark, rows=SEQS):
    return spark.createDataFrame(rows, "doc_id long, seq array<int>")


def texts(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_vocabulary_order(spark):
    df = spark.createDataFrame([(1, "b a c a"), (2, "c a d")], "doc_id long, text string")
    got = tokens.build_vocab(df).orderBy("token_id").collect()
    assert [(r.token, r.n, r.token_id) for r in got] == [
        ("a", 3, 2), ("c", 2, 3), ("b", 1, 4), ("d", 1, 5)
    ]


def test_tokenize_both_ways_and_back(spark):
    rows, df = texts(spark)
    vocab = tokens.build_vocab(df)
    ids = {r.token: r.token_id for r in vocab.collect()}
    expected = {k: [ids[w] for w in t.split()] for k, t in rows}
    whole = tokens.tokenize(df, vocab)
    split = tokens.tokenize(df, vocab, broadcast_words=3, head_words=5)
    for result in (whole, split):
        assert {r.doc_id: r.ids for r in result.collect()} == expected
    rows_ = filters.drop_special(tokens.token_rows(tokens.sequences(whole)), [0, 1])
    for kwargs in ({}, {"broadcast_words": 3, "head_words": 5}):
        back = tokens.rebuild_text(rows_, vocab, **kwargs)
        assert {r.doc_id: r.text for r in back.collect()} == {k: t for k, t in rows if t}


def test_tokenize_leaves_out_unknown_words(spark):
    vocab = tokens.build_vocab(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    df = spark.createDataFrame([(7, "b zzz a"), (8, "zzz"), (9, " ")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.tokenize(df, vocab).collect()}
    assert got == {7: [3, 2], 8: [], 9: []}


def test_tokenize_with_any_encoder(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id long, text string")
    got = tokens.tokenize_with(df, lambda ts: [[len(c) for c in t] for t in ts])
    assert {r.doc_id: r.ids for r in got.collect()} == {1: [1, 1, 1], 2: []}


def test_sequences_and_lengths_agree(spark):
    _, df = texts(spark)
    made = tokens.sequences(tokens.tokenize(df, tokens.build_vocab(df)), 16)
    sizes = {r.doc_id: r.n for r in made.select("doc_id", F.size("seq").alias("n")).collect()}
    lengths = {r.doc_id: r.n_tokens for r in tokens.sequence_lengths(df, 16).collect()}
    assert sizes == lengths and max(sizes.values()) == 18


def test_chunks(spark):
    rows = [(1, [0, 5, 6, 1]), (2, [0, 5, 1]), (3, [0, 5, 6, 7, 8, 9, 1]), (4, list(range(18)))]
    got = tokens.chunk(seqs(spark, rows), 4).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.start, r.ids) for r in got[:2]] == [(1, 0, [0, 5, 6, 1]), (3, 0, [0, 5, 6, 7])]
    assert [r.start for r in got[2:]] == [0, 4, 8, 12]
    tails = tokens.chunk(seqs(spark, rows), 4, keep_tail=True)
    total = tails.select(F.sum(F.size("ids")).alias("n")).first()["n"]
    assert total == sum(len(s) for _, s in rows)


def test_pack_keeps_order_and_positions(spark):
    blocks = packing.pack(seqs(spark), 4)
    got = packing.unpack(blocks).orderBy("block_id", "doc_id", "tok_pos").collect()
    assert [(r.block_id, r.doc_id, r.tok_pos) for r in got] == [
        (0, 1, 0), (0, 1, 1), (0, 1, 2), (0, 2, 0), (1, 2, 1), (1, 2, 2), (1, 2, 3), (1, 3, 0)
    ]
    tail = packing.pack(seqs(spark), 4, keep_tail=True).where("block_id = 2").first()
    assert tail.n_tokens == 2 and tail.segments[0].start == 1


def test_pack_equals_a_loop_with_one_huge_document(spark):
    rng = random.Random(3)
    rows = [(i * 7, [rng.randint(2, 99) for _ in range(rng.randint(2, 20))]) for i in range(40)]
    rows[17] = (17 * 7, [rng.randint(2, 99) for _ in range(900)])
    stream = [(d, p, t) for d, s in rows for p, t in enumerate(s)]
    block = 16
    expected = [stream[i : i + block] for i in range(0, len(stream) - block + 1, block)]
    df = seqs(spark, rows)
    lengths = df.select("doc_id", F.size("seq").alias("n"))
    for kwargs in ({}, {"lengths": lengths}, {"splits": [30.0, 100.0]}, {"splits": []}):
        got = packing.unpack(packing.pack(df, block, **kwargs)).orderBy("block_id", "doc_id", "tok_pos")
        flat = [(r.doc_id, r.tok_pos, r.token_id) for r in got.collect()]
        assert flat == [t for b in expected for t in b]


def test_segment_batches(spark):
    docs = spark.createDataFrame([(d, len(s)) for d, s in SEQS], "doc_id long, n_tokens int")
    got = packing.segment_batches(docs, 4).orderBy("batch_id", "doc_id").collect()
    assert [(r.batch_id, r.doc_id, r.lo, r.hi) for r in got] == [
        (0, 1, 0, 3), (0, 2, 0, 1), (1, 2, 1, 4), (1, 3, 0, 1), (2, 3, 1, 3)
    ]


def test_special_tokens_and_kept_rank(spark):
    rows = tokens.token_rows(seqs(spark))
    kept = filters.drop_special(rows, [0, 1]).where("doc_id = 1").first()
    assert (kept.tok_pos, kept.token_id) == (1, 5)
    assert tokens.kept_rank(rows, [0, 1], 4).where("doc_id = 1").first().tok_pos == 0


def test_padding(spark):
    got = tokens.pad_batch(seqs(spark), 2).orderBy("doc_id").collect()
    assert [r.input_ids for r in got] == [[0, 5, 1, 1], [0, 6, 7, 1], [0, 8, 1]]
    assert [r.attention_mask for r in got] == [[1, 1, 1, 0], [1, 1, 1, 1], [1, 1, 1]]
    assert [r.batch_id for r in got] == [0, 0, 1]


def test_index_with_clustered_and_extreme_keys(spark):
    keys = [-(2**62), 2**62] + list(range(1000, 1500)) + [10**12 + i for i in range(5)]
    random.Random(0).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    got = {r.doc_id: r.doc_idx for r in ordering.index_documents(df).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_rank_rows_with_many_ties(spark):
    rows = [(1, f"t{i:03d}") for i in range(200)] + [(5, "z"), (5, "a")]
    df = spark.createDataFrame(rows, "n int, token string").repartition(5)
    got = ordering.rank_rows(df, [F.desc("n"), F.asc("token")], "rank").orderBy("rank").collect()
    assert [(r.n, r.token) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [r["rank"] for r in got] == list(range(202))


def test_shuffle_is_repeatable_and_complete(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    order = [r.doc_id for r in ordering.shuffle(df).collect()]
    assert sorted(order) == list(range(100)) and order != sorted(order)
    assert order == [r.doc_id for r in ordering.shuffle(df.repartition(7)).collect()]
    placed = {r.doc_id: r.shuffled_idx for r in ordering.shuffle_index(df).collect()}
    assert [placed[d] for d in order] == list(range(100))


def test_rare_words_are_coded_in_place_by_rows(spark):
    """A vocabulary beyond the broadcast: repeated keys, unknown, long and null texts give the ids of the whole one."""
    rows = [(1, "a b rare1 a b"), (1, "rare2 a rare1"), (None, "a rare3 unknown b"), (3, None), (4, ""), (5, "x" * 200 + " a zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = tokens.build_vocab(df).where("token <> 'unknown'").localCheckpoint()
    whole = tokens.tokenize(df, vocab).collect()
    split = tokens.tokenize(df, vocab, broadcast_words=1, head_words=2).collect()
    assert sorted(map(str, whole)) == sorted(map(str, split)) and len(split) == 6


def test_counts_and_first_uses_against_all_rows(spark):
    seqs = spark.createDataFrame([(7, [0, 5, 5, 6, 5, 1]), (3, [0, 6, 5, 6, 1]), (9, [0, 1]), (4, None)], "doc_id long, seq array<int>").coalesce(1)
    rows = sorted((r.token_id, r.doc_id, r.tok_pos) for r in tokens.token_rows(seqs).collect() if r.token_id > 1)
    assert sorted(tokens.token_counts(seqs).collect()) == [(5, 4), (6, 3)]
    got = sorted((r.token_id, r.doc_id, r.tok_pos) for r in tokens.first_uses(seqs, 2).collect())
    assert got == [r for k in (5, 6) for r in [x for x in rows if x[0] == k][:2]]
