"""Corpus operators against brute force, the tokenizers library, exact round trips and edge cases."""

import hashlib
import random
import re
import struct
import tracemalloc
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowloom.llm import bpe_trie, corpus, exact_dedup, hnsw, minhash, mixing, pii, quality, range_coder, scratch, shards, token_counts
from flowloom.llm import queries as q
from flowloom.llm import vocab as V

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, kept boolean"
ODD = ["", None, "  ", "a", "a", "same text here", "same text here", "x" * 30_000, "Don't  stop\n\n now <|endoftext|> é漢🙂\x01", "1 " * 5000, "a@b.co +1 (415) 555-0100 4539 1488 0343 6467 10.0.0.1 GB82 WEST 1234 5698 7654 32"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else f"src{i % 2}", None, "z", False) for i, t in enumerate(ODD)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_prefix_counts_equal_the_library(tok):
    v = V.parsed(open(PATH, "rb").read())
    c, rnd = token_counts.PrefixCounter(v), random.Random(1)
    letters = [*"ab e'srtvelmd  \n\t1²½Ⅷ٣é漢\x1c\x85  🙂!?-", "<|endoftext|>", "'re", "'ll", "<|end", " the", "ing", " b c"]
    for _ in range(400):
        x = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        want = [len(ids_of(tok, x[:i])) for i in range(len(x) + 1)]
        assert c.prefixes(x) == want
        for limit in (1, 3):
            assert c.cut(x, limit) == max(i for i, n in enumerate(want) if n <= limit)


def test_token_counts_and_encoding(spark, docs, odd, tok):
    for df in (docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in token_counts.count_tokens(df, PATH).collect():
            n = len(ids_of(tok, texts[r["doc_id"]]))
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)
        ids = bpe_trie.encode_texts(df, PATH)
        for r in bpe_trie.digests(bpe_trie.decode_ids(ids, PATH, keep=("doc_id", "ids"))).collect():
            want = ids_of(tok, texts[r["doc_id"]])
            assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(tok.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert token_counts.count_tokens(odd.limit(0), PATH).count() == 0


def test_prefix_tables_equal_the_library(odd, tok):
    rows = odd.where("doc_id NOT IN (7, 9)")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in token_counts.prefix_tables(rows, PATH).collect():
        x = texts[r["doc_id"]]
        assert r["prefix_tokens"] == [len(ids_of(tok, x[:i])) for i in range(len(x) + 1)]


def test_long_words_take_linear_memory(tok):
    rnd = random.Random(8)
    v, word = V.parsed(open(PATH, "rb").read()), "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    bpe_trie.encode_words(v, ["warm"])
    tracemalloc.start()
    part = bpe_trie.encode_words(v, [word[:20_000]])[word[:20_000]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    want = ids_of(tok, word[:20_000])
    assert part == struct.pack(f"<{len(want)}I", *want)
    want = ids_of(tok, word)
    assert bpe_trie.Encoder(v).encode([word]) == [struct.pack(f"<{len(want)}I", *want)]


def test_token_files_round_trip(spark, docs, odd, tok):
    for df in (docs, odd):
        path = scratch.place(spark, "test-files")
        range_coder.write(df, PATH, path, 2)
        at = 0
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in sorted(range_coder.read(spark, path).collect()):
            ids = [*ids_of(tok, texts[r["doc_id"]]), 2]
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            at += len(ids)


def test_blocks_notice_damage():
    ids = np.random.default_rng(1).integers(0, 50257, 3000)
    blocks = range_coder.encode_blocks(ids, 512)
    assert (range_coder.decode_blocks(blocks) == ids).all()
    blocks[2] = blocks[2][:-9] + bytes([blocks[2][-9] ^ 1]) + blocks[2][-8:]
    with pytest.raises(ValueError, match="damaged"):
        range_coder.decode_blocks(blocks)


def test_exact_copies(spark, docs, odd):
    for df, keep in ((docs, "largest"), (odd, "smallest")):
        groups = defaultdict(list)
        for r in df.collect():
            groups[r["text"] or ""].append(r["doc_id"])
        rows = exact_dedup.duplicates(df, keep=keep).collect()
        assert len(rows) == sum(map(len, groups.values()))
        best = {d: (max if keep == "largest" else min)(g) for g in groups.values() for d in g}
        assert all(r["keep_id"] == best[r["doc_id"]] and r["kept"] == (r["doc_id"] == best[r["doc_id"]]) for r in rows)
        assert exact_dedup.deduplicate(df, keep=keep).columns == df.columns and exact_dedup.deduplicate(df, keep=keep).count() == len(groups)
    assert exact_dedup.duplicates(odd.limit(0)).count() == 0


def test_tree_merge_over_many_runs(spark):
    rows = spark.range(0, 4000, 1, 40).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
    got = exact_dedup.duplicates(rows, keep="smallest").groupBy("keep_id").agg(F.count("*").alias("n"), F.max("group_size").alias("m")).collect()
    assert sorted(r["keep_id"] for r in got) == list(range(7)) and all(r["n"] == r["m"] for r in got)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, con = q.queries()[name](spark, SF), duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_mixing_meets_budgets_and_survives_odd_rows(odd):
    levels = {"domain": "'d'", "lang": "lang", "source": "source"}
    got = mixing.mix(odd, levels, {}, budget=20, max_epochs=1).collect()
    assert 15 <= sum(r["take_tokens"] for r in got) <= 20
    assert mixing.mix(odd, levels, {}, fraction=1.0, max_epochs=1, whole_rows=True).columns == odd.columns
    assert mixing.mix(odd.limit(0), levels, {}, budget=5).count() == 0


def test_shards_are_even_and_gapless(docs, odd):
    for df in (docs, odd):
        per = defaultdict(list)
        for r in shards.shard(df, 40).collect():
            per[r["shard"]].append(r["slot"])
        sizes = [len(per[s]) for s in range(40)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in per.values())
    assert shards.shard(odd.limit(0)).count() == 0
    m = shards.communication_matrix([10, 0, 7], [6, 6, 5], 1)
    assert m.sum(axis=1).tolist() == [10, 0, 7] and m.sum(axis=0).tolist() == [6, 6, 5]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_equals_plain_patterns(spark, docs, odd):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rnd = random.Random(3)
    bits = ["a", "b@", "c.d", "1", "44", "255", ".", "192.168.0.1", "-", " ", "+", "(", "4539 1488 0343 6467", "\x01", "é", "🙂", "x@y.z", "+1 (415) 555-0100", "00", "_"]
    made = spark.createDataFrame([(1000 + i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for i in range(600)], "doc_id long, text string")
    for df in (docs, odd, made):
        texts = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
        for r in pii.report(df).collect():
            spans = []
            for k, (kind, p) in enumerate(plain.items()):
                for m in re.finditer(p, texts[r["doc_id"]]):
                    d = re.sub("[^0-9]", "", m.group())
                    if {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]():
                        spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
            assert r["base_sha256"] == hashlib.sha256(",".join(s for _, _, s in sorted(spans)).encode()).hexdigest()
    last = pii.report(odd).where("doc_id = 10").first()
    assert "iban:" in last["spans"] and last["n_ip"] == 1


def test_iban_before_other_words_and_numbers(spark):
    de, gb, no = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    texts = [f"{de} Please", f"pay {de} BIC COBADEFFXXX", f"{gb} 2024", f"{no} EUR 10", f"{de} {gb} {no}", f"AB12 {de}", f"FR76 {de} 12345 6789", "DE89370400440532013001 Please", f"X{de}", f"é🙂 {de}. bank {no}"]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        want = [f"iban:{t.index(x)}:{t.index(x) + len(x)}" for x in (de, gb, no) if x in t and not t.startswith("X")]
        assert sorted(want) == sorted(x for x in r["spans"].split(",") if x.startswith("iban")), t
    assert [x.rsplit(":", 1)[1] for x in rows[9]["scored"].split(",") if x.startswith("iban")] == ["0.80", "0.90"]


def test_quality_on_labels(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.assess(docs, labels, "source", "lang").join(labels, "doc_id").collect()
    assert np.mean([(r["kept"] == bool(r["quality"])) for r in got]) > 0.95
    more, marked = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = [r for r in quality.assess(more, marked.where("doc_id % 2 = 0"), "source", "lang").join(marked, "doc_id").collect() if r["doc_id"] % 2]
    assert np.mean([(r["kept"] == bool(r["quality"])) for r in held]) > 0.97  # labels that the classifier has not seen
    assert quality.assess(odd, labels, "source", "lang").count() == len(ODD)
    assert quality.keep_good(odd, labels.limit(0), "source", "lang").columns == odd.columns
    assert quality.assess(odd.limit(0), labels, "source", "lang").count() == 0


def test_near_duplicates_equal_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: set(minhash.shingles(r["text"] or "").tolist()) for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            x, y = sets[a], sets[b]
            if texts[a] == texts[b] or (x and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    rows = minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {d: root(d) for d in sets}
    members = defaultdict(list)
    for d in sets:
        members[root(d)].append(d)
    for r in rows:
        own = members[r["class_id"]]
        alike = len({texts[d] for d in own})
        assert r["class_size"] == len(own) and alike - 1 <= r["n_links"] <= alike * (alike - 1) // 2
    kinds = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(odd).collect()}
    assert kinds[1] == 0 and kinds[4] == 3 and kinds[6] == 5 and minhash.keep_one(odd).columns == odd.columns
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_every_class_of_a_mixed_bucket_is_compared(spark, monkeypatch):
    """One bucket of 300 texts, no two alike but for twins that no leader links."""
    rnd = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = [f"w{rnd.randrange(10**9)}" for _ in range(40)]
        rows.append((i, " ".join(common + own)))
        if i % 10 == 5:
            rows.append((1000 + i, " ".join(common + own + ["more"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(minhash, "_sketches", lambda docs: docs.select("__id", F.lit(96).cast("long").alias("__n"), F.array(F.lit(7).cast("long")).alias("__keys")))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {d: d % 1000 for d, _ in rows}


def test_prefix_pairs_do_not_hang_on_how_texts_are_dealt(spark):
    """300 texts of which no two are alike, but all share most shingles, one or two a task: shared ones must stand last for all of them."""
    rnd = random.Random(7)
    common = [f"c{i}" for i in range(60)]
    rows = [((i, i), (i, i), " ".join(common + [f"w{rnd.randrange(10**9)}" for _ in range(40)])) for i in range(300)]
    rows.append(((900, 900), (900, 900), rows[0][2] + " more"))
    kind = "struct<id: long, x: long>"
    texts = spark.createDataFrame(rows, f"__node {kind}, __class {kind}, __text string").repartition(200)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        pairs = minhash._prefix_pairs(texts.select("__node", "__class"), texts.select("__node", "__text"), 0.8)
        got = {(r["a"]["id"], r["b"]["id"]) for r in pairs.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert (0, 900) in got and len(got) <= len(rows)


def test_texts_that_fall_just_short_do_not_all_meet(spark):
    """200 texts with two edits each, alike to the text without edits but hardly to each other: few pairs, and all that are alike."""
    rnd, rows = random.Random(11), []
    for i in range(200):
        own = [f"w{k}" for k in range(120)]
        for _ in range(2):
            own[rnd.randrange(5, 115)] = f"edit{rnd.randrange(10**9)}"
        rows.append(((i, i), (i, i), " ".join(own)))
    kind = "struct<id: long, x: long>"
    texts = spark.createDataFrame(rows, f"__node {kind}, __class {kind}, __text string").repartition(4)
    pairs = minhash._prefix_pairs(texts.select("__node", "__class"), texts.select("__node", "__text"), 0.8)
    got = {(r["a"]["id"], r["b"]["id"]) for r in pairs.collect()}
    alike = {(i, j) for j in range(200) for i in range(j) if minhash.jaccard(rows[i][2], rows[j][2]) >= 0.8}
    assert alike <= got and len(got) < 2000


def test_parities_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(0, 300)).astype(np.uint64)) for _ in range(2))
        differ = sum(int(v).bit_count() for v in (minhash.parities(x) ^ minhash.parities(y)).view(np.uint64))
        assert differ <= len(np.setxor1d(x, y)) and (len(x) or not minhash.parities(x).any())


def test_the_classifier_is_fitted_outside_the_driver(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), F.col("id"), F.when(F.col("id") % 2 == 0, "!!! $$$")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    tracemalloc.start()
    try:
        weights = quality.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2_000_000  # the features take over 3 MB
    x = np.array([quality.features(r["text"]) for r in docs.collect()])
    np.testing.assert_allclose(weights, quality.fit(x, np.arange(3000) % 2.0), atol=1e-4)


def test_filter_keeps_all_that_is_wanted_and_exchanges_no_rows(spark):
    node = F.struct(F.col("id"), (F.col("id") * 7).alias("x"))
    rows = spark.range(20_000).union(spark.range(1).select(F.lit(None).cast("long"))).select(node.alias("__node"), F.lit("text").alias("__text"))
    found = minhash._filtered(rows, F.col("__node"), rows.where("__node.id % 40 = 3 or __node.id is null").select("__node"))
    assert found.columns == rows.columns
    got = [r["__node"]["id"] for r in found.collect()]
    assert {None, *range(3, 20_000, 40)} <= set(got) and len(got) <= 520
    assert minhash._filtered(rows, F.col("__node"), rows.limit(0).select("__node")).count() == 0
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_unequal_repeats_do_not_hide_copies(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(5):
        words = [f"w{i}_{rnd.randrange(10**6)}" for _ in range(100)]
        rows += [(i, " ".join(words + words[:9])), (100 + i, " ".join(words + words[:5] * 180))]
    assert all(minhash.jaccard(a[1], b[1]) > 0.85 for a, b in zip(rows[::2], rows[1::2], strict=True))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] % 100 for r in got)


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 8)).astype(np.uint64)]))
        known = np.sort(rng.choice(x, len(x) // 2, replace=False))
        rank = rng.permutation(len(known))
        both = len(np.intersect1d(x, y))
        if both >= 0.8 * (len(x) + len(y) - both):
            assert len(np.intersect1d(minhash.prefix(x, 0.8, known, rank), minhash.prefix(y, 0.8, known, rank)))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    a, b = x[:300], x[100:]
    agree = np.mean([minhash.signature(a ^ np.uint64(k), 128) == minhash.signature(b ^ np.uint64(k), 128) for k in range(1, 20)])
    assert abs(agree - 0.5) < 0.05


def test_neighbours_recall_and_odd_vectors(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    odd = spark.createDataFrame([(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, [None] * 64), (9004, []), (9050, [1.0, 2.0]), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    twins = v.where("vec_id = 50").select(F.explode(F.sequence(F.lit(8000).cast("long"), F.lit(8019).cast("long"))).alias("vec_id"), "embedding")
    got = hnsw.search(v.union(odd).union(twins), F.col("vec_id") % 50 == 0).collect()
    assert not {9000, 9001, 9002, 9003, 9004, 9050} & {r["query_id"] for r in got}
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in v.union(twins).collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    hits = total = 0
    for query in [i for i in ids if i % 50 == 0]:
        s = np.round(x @ (rows[query] / np.linalg.norm(rows[query])), 12)
        s[ids == query] = -9
        want = ids[np.lexsort((ids, -s))[:5]].tolist()
        found = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == query]
        hits, total = hits + len({*want} & {*found}), total + 5
        if query == 50:
            assert found == [8000, 8001, 8002, 8003, 8004]
    assert hits / total >= 0.9


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = scratch.materialize(stage(spark, step, SF), name.replace(" ", ""))
        assert step.columns == docs.columns
        sizes.append(step.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert step.groupBy("text").count().where("count > 1").isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, step, SF).count() == sizes[-1]


def classes_of(texts):
    """The smallest identifier connected to each, by all pairs."""
    sets = {d: set(minhash.shingles(t).tolist()) for d, t in texts.items()}
    label, moved = {d: d for d in texts}, True
    pairs = [(a, b) for a in sets for b in sets if a < b and (texts[a] == texts[b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    while moved:
        moved = False
        for a, b in pairs:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                moved = True
    return label


def test_pipeline_equals_plain_versions(spark, tok):
    """Each stage on sf0.001 against a version without Spark that takes what the plain one before it kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = {name: stage for name, stage in corpus_pipeline.STAGES}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    x = {d: quality.features(r["text"] or "") for d, r in rows.items()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] in (0, 1) and r["doc_id"] in rows]
    w = quality.fit(np.array([x[d] for d, _ in labels]), np.array([float(y) for _, y in labels]))
    p = {d: float(1 / (1 + np.exp(-np.clip(np.append(v, 1.0) @ w, -30, 30)))) for d, v in x.items()}
    sites = defaultdict(list)
    for d, r in rows.items():
        sites[r["source"], f"{r['source']}/{r['lang']}"].append(p[d])
    mean, n = np.mean([*p.values()]), len(p)
    hosts = defaultdict(list)
    for (h, _), v in sites.items():
        hosts[h] += v
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in sites.values()) / max(n - len(sites), 1)

    def strength(groups, means, parents):
        own = (sum(len(v) * (np.mean(v) - means[k]) ** 2 for k, v in groups.items()) - max(len(groups) - parents, 0) * within) / n
        return min(max(sum(len(v) * means[k] * (1 - means[k]) for k, v in groups.items()) / n / max(own, 1e-9) - 1, 1), 10_000)

    kh = strength(hosts, dict.fromkeys(hosts, mean), 1)
    p_host = {h: (sum(v) + kh * mean) / (len(v) + kh) for h, v in hosts.items()}
    kp = strength(sites, {k: p_host[k[0]] for k in sites}, len(hosts))
    logit = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))

    def good(d):
        h, v = hosts[rows[d]["source"]], sites[rows[d]["source"], f"{rows[d]['source']}/{rows[d]['lang']}"]
        others = (sum(v) - p[d] + kp * (sum(h) - p[d] + kh * mean) / (len(h) - 1 + kh)) / (len(v) - 1 + kp)
        return logit(p[d]) + logit(others) - logit(mean) >= 0

    kept = sorted(d for d in rows if good(d))
    step = scratch.materialize(stages["quality"](spark, docs, SF), "plain-quality")
    assert ids(step) == kept and 0 < len(kept) < len(rows)

    first = {}
    for d in kept:
        first.setdefault(rows[d]["text"] or "", d)
    kept = sorted(first.values())
    step = scratch.materialize(stages["exact copies"](spark, step, SF), "plain-exact")
    assert ids(step) == kept

    label = classes_of({d: rows[d]["text"] or "" for d in kept})
    kept = sorted(set(label.values()))
    step = scratch.materialize(stages["near copies"](spark, step, SF), "plain-near")
    assert ids(step) == kept

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet') WHERE doc_id IN ({', '.join(map(str, kept))})")
    kept = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({q.mixing_sql(corpus.WEIGHTS, 0.8, 1)})").fetchall())
    step = scratch.materialize(stages["mixture"](spark, step, SF), "plain-mixture")
    assert ids(step) == kept

    got = {r["doc_id"]: r for r in stages["encoding"](spark, step, SF).collect()}
    assert sorted(got) == kept
    for d in kept:
        want = ids_of(tok, rows[d]["text"])
        assert got[d]["n_tokens"] == len(want) and got[d]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, got.values()))


def test_a_large_class_of_near_copies_takes_few_pairs(spark, monkeypatch):
    """2,000 edited copies of one text: one class, with pairs in proportion to texts."""
    rnd, rows, tried = random.Random(9), [], []
    words = [f"w{i}" for i in range(300)]
    for i in range(2000):
        own = list(words)
        for _ in range(2):
            own[rnd.randrange(300)] = f"edit{rnd.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    verified = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, texts, threshold: tried.append(pairs.count()) or verified(pairs, texts, threshold))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["class_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    assert sum(tried) <= 3 * len(rows)


def test_copies_by_text_where_identifiers_repeat(spark):
    """One identifier on two texts, and rows repeated whole: texts are judged one by one, of equal rows one stays."""
    a, b, near = "some words that stand here in a row", "quite another text with its own words", " ".join(f"w{i}" for i in range(60))
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "y"), (3, a, "z"), (3, a, "z"), (4, near, "n"), (4, near, "n"), (5, near + " end", "m"), (None, a, "q"), (0, near + " stop", "__own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __own string")
    exact = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.deduplicate(df, keep="largest").collect()), key=str)
    assert exact == sorted([(3, a), (2, b), (4, near), (5, near + " end"), (0, near + " stop")], key=str)
    got = minhash.keep_one(df)
    assert got.columns == df.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert {x for x in kept if x[1] in (a, b)} == {(1, a), (1, b)}  # not the row without identifier
    assert [x for x in kept if x[1].startswith("w0")] == [(0, near + " stop")]
    classes = minhash.near_duplicates(df).collect()
    assert len(classes) == len(rows) and all(r["class_id"] == 0 for r in classes if r["doc_id"] in (0, 4, 5))


def test_large_hypergeometric_draws_follow_the_law():
    rng = np.random.default_rng(3)
    good, bad, draws = 3_000_000_000, 1_000_000_000, 40_000
    got = [shards._hypergeometric(rng, good, bad, draws) for _ in range(4000)]
    sd = np.sqrt(draws * 0.75 * 0.25)
    assert abs(np.mean(got) - 30_000) < 5 * sd / np.sqrt(4000) and abs(np.std(got) / sd - 1) < 0.06
    assert shards._hypergeometric(rng, 10**12, 0, 10**12) == 10**12 and shards._hypergeometric(rng, 10**12, 5, 10**12 + 5) == 10**12
    m = shards.communication_matrix([2 * 10**9, 10**9], [10**9] * 3, 1)
    assert m.sum(axis=1).tolist() == [2 * 10**9, 10**9] and m.sum(axis=0).tolist() == [10**9] * 3


def test_mixing_deals_every_token(odd):
    levels = {"domain": "'d'", "lang": "lang", "source": "source"}
    for budget in (7, 20, 101):
        assert sum(r["take_tokens"] for r in mixing.mix(odd, levels, {"source": {"src0": 3}}, budget=budget, max_epochs=1).collect()) == budget


@pytest.mark.parametrize("weights", [{"source": {"src1": 0}}, {"lang": {"en": 0, "de": 3}}, {"domain": {"web": 0}, "lang": {"fr": 0}}, {"source": {"src0": 0, "src1": 0, "src2": 0}, "lang": {"es": 0}}])
def test_nothing_is_lost_under_weights_of_zero(spark, docs, weights):
    """At several depths: rows equal the SQL, and the budget is dealt as far as what has a weight can give."""
    levels = ["domain", "lang", "source"]
    got = mixing.mix(docs, corpus.LEVELS, weights, fraction=0.6, max_epochs=2, seed=17).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(q.mixing_sql(weights))
    columns = [d[0] for d in want.description]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want.fetchall(), key=repr)
    rows = docs.select(*(F.expr(e).alias(n) for n, e in corpus.LEVELS.items()), mixing.word_count(F.col("text")).alias("n")).collect()
    total = sum(r["n"] for r in rows)
    can = 2 * sum(r["n"] for r in rows if all(weights.get(c, {}).get(r[c], 1) > 0 for c in levels))
    assert sum(r["take_tokens"] for r in got) == min(int(total * 0.6), can)


def test_mixing_deals_real_tokens(docs):
    counted = docs.join(token_counts.count_tokens(docs, PATH).select("doc_id", F.col("n_tokens").alias("held")), "doc_id")
    got = mixing.mix(counted, corpus.LEVELS, corpus.WEIGHTS, budget=30_000, max_epochs=1, tokens=F.col("held")).collect()
    assert sum(r["take_tokens"] for r in got) == 30_000 and all(r["take_tokens"] <= r["n_tokens"] for r in got)


def test_neighbours_of_vectors_out_of_range(spark):
    """Squares of these leave double range; cosines don't."""
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [-1e300, 1.0]), (3, [1e-310, 0.0]), (4, [0.0, 1e-200]), (5, [3.0, 4.0])]
    got = {r["vec_id"]: r["score"] for r in hnsw.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for k, want in ((1, 0.5**0.5), (2, -1.0), (3, 1.0), (4, 0.0), (5, 0.6)):
        assert abs(got[k] - want) < 1e-15
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, __id string, query_id long, rank int")
    assert hnsw.search(none, F.col("vec_id") == 0).count() == 0


def test_shards_carry_sizes_checksums_and_every_row(docs):
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    got = shards.shard(docs, 40).collect()
    assert len(got) == len(want) and {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_sites_shrink_towards_their_hosts(spark):
    """Posteriors equal the method of moments worked out plainly."""
    rnd = np.random.default_rng(12)
    rows = [(f"h{h}", f"h{h}/{p}", float(np.clip(0.2 + 0.15 * h + 0.1 * p + rnd.normal(0, 0.1), 0, 1))) for h in range(4) for p in range(3) for _ in range(4 + 9 * p)]
    scored = spark.createDataFrame(rows, "host string, path string, p_classifier double")
    found = quality.site_posteriors(scored)
    sites, mean, *strengths = found
    group = lambda at: {k: np.array([r[2] for r in rows if r[at] == k]) for k in {r[at] for r in rows}}
    hosts, paths, n = group(0), group(1), len(rows)
    assert abs(mean - np.mean([r[2] for r in rows])) < 1e-9
    within = sum(((x - x.mean()) ** 2).sum() for x in paths.values()) / (n - len(paths))

    def strength(groups, means, parents):
        own = (sum(len(x) * (x.mean() - means[k]) ** 2 for k, x in groups.items()) - (len(groups) - parents) * within) / n
        return min(max(sum(len(x) * means[k] * (1 - means[k]) for k, x in groups.items()) / n / max(own, 1e-9) - 1, 1), 10_000)

    kh = strength(hosts, dict.fromkeys(hosts, mean), 1)
    p_host = {k: (x.sum() + kh * mean) / (len(x) + kh) for k, x in hosts.items()}
    up = {k: p_host[k.split("/")[0]] for k in paths}
    kp = strength(paths, up, len(hosts))
    for r in sites.collect():
        x = paths[r["__path"]]
        assert abs(r["p_host"] - p_host[r["__host"]]) < 1e-9 and abs(r["p_path"] - (x.sum() + kp * up[r["__path"]]) / (len(x) + kp)) < 1e-9
    assert np.allclose(strengths, (kh, kp))
    logit = lambda x: np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6)))
    for r in quality.with_posterior(scored, *found).collect():
        h, x, p = hosts[r["host"]], paths[r["path"]], r["p_classifier"]
        others = (x.sum() - p + kp * (h.sum() - p + kh * mean) / (len(h) - 1 + kh)) / (len(x) - 1 + kp)
        assert abs(logit(r["p_quality"]) - np.clip(logit(p) + logit(others) - logit(mean), -13.9, 13.9)) < 1e-6 or abs(logit(p) + logit(others) - logit(mean)) > 13


def test_sites_decide_where_texts_say_nothing(spark):
    """Texts all alike: what a document gets above or below the mean comes from the other documents of its site; one on its own gets its host's."""
    rows = [(f"h{h}", f"h{h}/{p}", min(max(0.5 + (0.3 if h else -0.3) + 0.01 * (i % 5), 0), 1)) for h in range(2) for p in range(2) for i in range(200)] + [("h1", "h1/alone", 0.5), ("h0", "h0/alone", 0.5)]
    scored = spark.createDataFrame(rows, "host string, path string, p_classifier double")
    got = {r["path"]: r["p_quality"] for r in quality.with_posterior(scored, *quality.site_posteriors(scored)).where("path LIKE '%alone'").collect()}
    assert got["h1/alone"] > 0.7 and got["h0/alone"] < 0.3


@pytest.mark.parametrize(("table", "shard_rows"), [("sf0.1", 400), ("check_s", hnsw.SHARD_ROWS)])
def test_neighbours_over_several_shards(spark, monkeypatch, table, shard_rows):
    """Three shards and more merged: recall against brute force over all vectors (some 2,000, and 10,000 where that table is)."""
    path = Path(f"/root/testdata/{table}/embeddings.parquet")
    if not path.exists():
        pytest.skip("no such table")
    v = spark.read.parquet(str(path)).select("vec_id", "embedding")
    monkeypatch.setattr(hnsw, "SHARD_ROWS", shard_rows)
    rows = v.toPandas()
    assert len(rows) > 2 * shard_rows
    x = np.array(rows["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rows["vec_id"].to_numpy()
    found = defaultdict(dict)
    for r in hnsw.search(v, F.col("vec_id") % 50 == 0).collect():
        found[r["query_id"]][r["rank"]] = r["vec_id"]
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.round(x @ x[i], 12)
        s[i] = -9
        want = ids[np.lexsort((ids, -s))[:5]]
        assert sorted(found[ids[i]]) == [1, 2, 3, 4, 5]
        hits, total = hits + len({*want} & {*found[ids[i]].values()}), total + 5
    assert hits / total >= 0.9


def test_empty_tables_repeated_rows_and_clashing_names(spark, odd):
    clash = ["__id", "__text", "__node", "__key", "__row", "__own", "n_tokens", "kept", "shard", "ids", "start"]
    none, twice = odd.limit(0), odd.union(odd).select("doc_id", "text", "lang", "source", *(F.lit("x").alias(c) for c in clash))
    n = 2 * len(ODD)
    path, empty = scratch.place(spark, "twice"), scratch.place(spark, "empty")
    range_coder.write(twice, PATH, path, 2)
    back = range_coder.read(spark, path).orderBy("start").collect()
    assert len(back) == n and [r["start"] for r in back] == [sum(x["n_tokens"] for x in back[:i]) for i in range(n)]
    range_coder.write(none, PATH, empty, 2)
    assert range_coder.read(spark, empty).count() == 0
    for made in (bpe_trie.digests(bpe_trie.round_trip(twice, PATH)), token_counts.count_tokens(twice, PATH), pii.report(twice), shards.shard(twice, 4), exact_dedup.duplicates(twice), minhash.near_duplicates(twice)):
        assert made.count() == n
    assert bpe_trie.round_trip(none, PATH).count() == 0 and pii.report(none).count() == 0
    once = exact_dedup.deduplicate(twice)
    assert once.columns == twice.columns and once.count() == len({t or "" for t in ODD})
    with pytest.raises(ValueError, match="already"):
        pii.find(odd.withColumn("pii_spans", F.lit(1)))


def test_round_trip_equals_both_steps(spark, odd):
    ids = bpe_trie.decode_ids(bpe_trie.encode_texts(odd, PATH), PATH, keep=("doc_id", "ids"))
    assert sorted(map(tuple, ids.collect())) == sorted(map(tuple, bpe_trie.round_trip(odd, PATH).collect()))


def test_long_runs_of_blanks_are_counted_in_linear_time(tok):
    c = token_counts.PrefixCounter(V.parsed(open(PATH, "rb").read()))
    text = "a" + " " * 60_000 + "b"
    got = c.prefixes(text)
    for i in (0, 1, 2, 17, 30_000, 60_000, 60_001, 60_002):
        assert got[i] == len(ids_of(tok, text[:i]))


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    rows = [(i % 13, t, None if i % 5 == 3 else "en", None if i == 4 else f"src{i % 2}", None) for i, t in enumerate(ODD + ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        made = scratch.materialize(stage(spark, docs, SF), f"odd-{name.replace(' ', '')}")
        assert name == "encoding" or made.columns == docs.columns
        assert made.count() <= len(rows) and stage(spark, docs.limit(0), SF).count() == 0
    kept = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for t in ODD})


def test_the_library_encodes_each_piece_once(tok, monkeypatch):
    """Whole texts' ids on odd white space, special strings and letters, from pieces that the library gets once."""
    rnd = random.Random(5)
    marks = ["a", "Zwölf", "don't", "\n", "\t", "\xa0", "\u3000", "", "", "<|endoftext|>", "x\n", "\ny", "1234", "...", "日本", "'s", "\x1c", "🙂"]
    texts = ["", " ", "  ", *(" ".join(rnd.choices(marks, k=rnd.randrange(1, 12))) for _ in range(3000))]
    library = range_coder.Library(open(PATH, "rb").read())
    got = library.encode(texts[:1500]) + library.encode(texts[1500:])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(tok, x) for x in texts]
    asked, whole = [], library.whole
    monkeypatch.setattr(library, "whole", lambda text: asked.append(text) or whole(text))
    text = " ".join(["some", *(f"word{i}" for i in range(1000))])
    assert np.frombuffer(b"".join(library.encode([text] * 50)), "<u4").tolist() == ids_of(tok, text) * 50
    assert sum(map(len, asked)) < 2 * len(text)


def test_prefix_keys_move_once(spark):
    """Both sides of the join of prefixes are one exchange."""
    kind, common = "struct<id: long, x: long>", " ".join(f"c{i}" for i in range(60))
    rows = [((i, i), (i, i), f"{common} own{i}") for i in range(20)]
    nodes = spark.createDataFrame(rows, f"__node {kind}, __class {kind}, __text string")
    pairs = minhash._prefix_pairs(nodes.select("__node", "__class"), nodes.select("__node", "__text"), 0.8)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(pairs.collect()) == 190
        assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_the_library_encodes_words_of_pieces_once(tok, monkeypatch):
    """Words with marks behind them aren't encoded again, nor are pieces in use when the tables turn over."""
    monkeypatch.setattr(range_coder, "REMEMBERED", 1500)
    rnd = random.Random(7)
    words = ["".join(rnd.choices("aeinorst\xe9", k=9)) for _ in range(1000)]
    library = range_coder.Library(open(PATH, "rb").read())
    asked, whole = [], library.whole
    monkeypatch.setattr(library, "whole", lambda text: asked.append(text) or whole(text))
    for k in range(12):
        rare = " ".join(f"rare{k}x{i}" for i in range(400))
        text = "the " + " ".join(w + rnd.choice(["", ",", ".", "!?", ".\n" + rnd.choice(words), "\n"]) for w in words) + " " + rare
        assert np.frombuffer(library.encode([text])[0], "<u4").tolist() == ids_of(tok, text)
    assert sum(map(len, asked)) < 3 * 10 * len(words) + 12 * 410 * 12


def test_marks_are_cut_from_words_as_in_whole_texts(tok):
    rnd = random.Random(9)
    marks = ["a", "Zw\xf6lf", "it's", ".", ",", "?!", "\n", ".\n", "\n\n", "12", "€", "\xd7", "\xaa", "́", "\x00", " ", " ", "-", "日"]
    texts = ["".join(rnd.choices(marks, k=rnd.randrange(1, 14))) for _ in range(4000)]
    library = range_coder.Library(open(PATH, "rb").read())
    assert [np.frombuffer(x, "<u4").tolist() for x in library.encode(texts)] == [ids_of(tok, x) for x in texts]


def test_a_rare_id_does_not_cost_order_0_a_share_for_each_of_its_magnitude():
    """The whole ids of a skewed draw, any sizes of blocks, in fewer bits than when each id of the largest magnitudes had a share."""
    rnd = np.random.default_rng(3)
    ids = np.minimum(rnd.geometric(0.02, 40_000), 50_256)
    for n, block in ((1, 512), (512, 512), (513, 512), (40_000, 2048)):
        blocks = range_coder.encode_blocks(ids[:n], block)
        assert (range_coder.decode_blocks(blocks) == ids[:n]).all()
    assert sum(map(len, blocks)) < 38_000  # 38,902 when each had one
    few = np.random.default_rng(4).integers(0, 1 << 17, 3000)
    assert (range_coder.decode_blocks(range_coder.encode_blocks(few, 256)) == few).all()
