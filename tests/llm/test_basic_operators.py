"""Sharding, packing, chat rotation, neighbours and language identification, on small inputs."""

import collections
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import chat, language, neighbours, packing, sharding

DOCS = "doc_id bigint, text string, lang string, shard int, row string"


def odd_documents(spark):
    rows = [
        (1, "One two three.\nFour  five", "en", 7, "x"),
        (1, "One two three.\nFour  five", "en", 7, "x"),
        (2, None, None, None, None),
        (None, "", "fr", 1, None),
        (3, "12345 !!!", None, 1, "y"),
        (4, "a" * 70_000, "en", 1, "y"),
        (5, "spelled <|endoftext|> here \n x", "en", 1, "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_communication_matrix_margins():
    m = sharding.communication_matrix([5, 0, 17, 100], 7, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 100]
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_shuffle_is_exact_and_keeps_rows(spark):
    docs = odd_documents(spark)
    out = sharding.shuffle_into_shards(docs, 3, bucket_rows=2).collect()
    assert sorted(map(str, [(r["doc_id"], r["text"], r["row"]) for r in out])) == sorted(map(str, [(r["doc_id"], r["text"], r["row"]) for r in docs.collect()]))
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(len(v))) for k, v in by.items()}
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shuffle_into_shards(docs.limit(0), 3).count() == 0


def test_shuffle_is_about_uniform(spark):
    out = sharding.shuffle_into_shards(spark.range(4000).repartition(8), 4, bucket_rows=100).collect()
    ids = np.array([r["id"] for r in out], dtype=float)
    for of in ([r["shard"] for r in out], [r["slot"] for r in out]):
        assert abs(np.corrcoef(ids, np.array(of, dtype=float))[0, 1]) < 0.06


def test_sharded_documents_digests(spark):
    got = {(r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.sharded_documents(odd_documents(spark)).collect()}
    assert got == {(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd_documents(spark).collect()}


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    model = packing.public_path("byte_bpe_50k.json")
    encoder, t = packing.Encoder(model, packing.public_path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(model)
    texts = ["", " ", "\n", "a b", " lead", "trail ", "a  b", "a\n\nb", "it's we'll\n'd x", "é²½ ñ x", "a\tb \tc", "x\x1cy \x1c", "日本 語。", "<|endoftext|> a", "😀 é", "a  b", "1 22 a1b_c __"]
    for text in texts:
        assert np.frombuffer(encoder(text), dtype="<u2").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_on_documents(spark, sf):
    from tokenizers import Tokenizer

    model = packing.public_path("byte_bpe_50k.json")
    encoder, t = packing.Encoder(model, packing.public_path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(model)
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        assert np.frombuffer(encoder(r["text"]), dtype="<u2").tolist() == t.encode(r["text"], add_special_tokens=False).ids


def check_packed(docs, out, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for d in docs:
        want[d["doc_id"], tuple(t.encode(d["text"] or "", add_special_tokens=False).ids + [0])] += 1
    seqs, got = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], dtype="<u2")
        assert len(ids) == r["length"] and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        got[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(ids.tolist())))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= window
    for (doc, n), parts in got.items():
        copies = sum(c for (d, ids), c in want.items() if d == doc and len(ids) == n)
        assert sum(len(p) for _, p in parts) == copies * n
        if copies == 1:
            assert sum((list(p) for _, p in sorted(parts)), []) == list(next(i for (d, i) in want if d == doc and len(i) == n))
    return sum(len(p) for v in got.values() for _, p in v), len(seqs)


def test_pack_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokens, sequences = check_packed(docs.collect(), packing.pack(docs).collect(), 1024)
    assert tokens / (sequences * 1024) > 0.99


def test_pack_odd_rows(spark):
    docs = odd_documents(spark)
    check_packed(docs.collect(), packing.pack(docs).collect(), 1024)
    assert packing.pack(docs.limit(0)).count() == 0
    slim = packing.pack(docs, with_ids=False).drop("sequence_id", "offset").collect()
    assert sorted(map(str, slim)) == sorted(map(str, packing.pack(docs).drop("ids", "sequence_id", "offset").collect()))


def test_plan_with_one_hot_length_wastes_nothing():
    places = packing.Places(packing.plan({700: 1000}, 1024), 1024)
    assert places.sequences == 0  # all go to the tail, which is cut


def test_nnls_finds_an_exact_filling():
    patterns = packing.plan({600: 50, 424: 50, 300: 30, 400: 30, 324: 30}, 1024)
    assert sum(t * sum(n * m for n, m in p) for p, t in patterns) == 80 * 1024


def test_encoder_on_random_unicode():
    from tokenizers import Tokenizer

    model = packing.public_path("byte_bpe_50k.json")
    encoder, t = packing.Encoder(model, packing.public_path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(model)
    rng = random.Random(2)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()] + [chr(c) for c in range(32)] + ["\u200b", "\ufeff", "\u0085"]
    letters = ["a", "B", "é", "'", "s", "ll", "7", "²", "!", "-", "日", "ß", "\u0301", "😀", "ﬁ", "_", "\U0010ffff"]
    for _ in range(10_000):
        text = "".join(rng.choice(rng.choice([blanks, letters, letters])) if rng.random() < 0.97 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(1, 30)))
        assert np.frombuffer(encoder(text), dtype="<u2").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_rotation_odd_rows(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob b", None), (1, 1, "bob b", None), (None, None, None, "x"), (2, 0, None, "")]
    out = chat.rotate_perspectives(spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, name int")).collect()
    assert len(out) == 6 + 1 + 1
    own = [r for r in out if r["perspective"] == r["speaker"]]
    assert all(r["segment"][r["mask_start"] : r["mask_end"]] == r["content"] + "<|im_end|>" and r["chat_role"] == "assistant" for r in own)
    bob = "bob_b_" + hashlib.md5(b"bob b").hexdigest()[:8]
    assert all(r["mask_start"] == r["mask_end"] and r["name"] in ("ann", bob) for r in out if r not in own)
    told = {(r["conv_id"], r["perspective"]): r["dialogue"] for r in chat.assembled(chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    assert told[1, "ann"].startswith(f"<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name={bob}\n<|im_end|>")
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.rotate_perspectives(empty).count() == 0


def test_rotation_keeps_speakers_apart_and_frames_untrained(spark):
    long = "word <|im_end|> " * 50_000
    rows = [(1, 0, "system", "be kind"), (1, 1, "bob b", "x"), (1, 2, "bob_b", long), (1, 3, None, "y"), (1, 4, "unknown", "z"), (2, 0, "system", "alone")]
    out = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {r["perspective"] for r in out} == {"bob b", "bob_b", None, "unknown"} and len(out) == 20
    names = collections.defaultdict(set)
    for r in out:
        if r["chat_role"] == "user":
            names[r["name"]].add(r["speaker"])
    assert len(names) == 4 and all(len(v) == 1 for v in names.values())
    framed = [r for r in out if r["speaker"] == "system"]
    assert all(r["chat_role"] == "system" and r["mask_start"] == r["mask_end"] and r["segment"] == "<|im_start|>system\nbe kind<|im_end|>\n" for r in framed)
    told = [r for r in out if r["perspective"] == r["speaker"] == "bob_b"]
    assert told[0]["segment"].count("<|im_end|>") == 1 and len(told[0]["content"]) == len(long) and told[0]["mask_end"] == len(told[0]["segment"]) - 1


def brute_nearest(rows, every, k):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("factor", [1.0, 1.5])
def test_nearest_against_brute_force(spark, sf, factor):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(df, every=50, factor=factor, shard_rows=200).collect())
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in df.collect()], 50, 10)
    same = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)
    assert got == want if factor == 1 else same >= 0.9


def test_trees_prune_by_their_factor():
    """Of all distances, clustered vectors take a tenth at factor 3 with nearly all neighbours, and fewer than all at factor 1."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 32))[rng.integers(0, 100, 8000)] + 0.15 * rng.normal(size=(8000, 32))
    ids, q = np.arange(len(x)), np.arange(0, 8000, 100)
    want = [set(sorted((float(np.sqrt(((x[i] - v) ** 2).sum())), k) for k, v in enumerate(x) if k != i)[:10]) for i in q.tolist()]
    shares = []
    for factor, least in ((1.0, 1.0), (2.0, 0.99), (3.0, 0.95)):
        tree = neighbours.VantageTree.build(x, leaf=64)
        row, found, _ = tree.search(x[q], q, ids[tree.order], 10, factor)
        recall = np.mean([len({int(v) for v in found[row == k]} & {v for _, v in want[k]}) / 10 for k in range(len(q))])
        shares.append(tree.computed / (len(q) * len(x)))
        assert recall >= least, (factor, recall)
    assert shares[0] < 0.7 and shares[1] < 0.35 and shares[2] < 0.2 and shares == sorted(shares, reverse=True), shares


def test_nearest_spreads_equal_ids(spark):
    """Rows of one id don't meet in one shard, and a shard isn't larger than asked."""
    rows = [(5, [float(k % 7), 1.0]) for k in range(600)] + [(i, [float(i % 13), 2.0]) for i in range(100, 300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(df, shard_rows=100, sample=64).collect())
    assert got == brute_nearest(rows, 100, 10)


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (100, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows += [(i, [1.0, 0.0]) for i in range(200, 600)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(df, shard_rows=150).collect())
    assert {x for x in got if x[0] != 0} == {x for x in brute_nearest(rows, 100, 10) if x[0] != 0}
    assert {x[2] for x in got if x[0] == 0} == set(range(200, 210))
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identified_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark):
    docs = odd_documents(spark)
    got = {(r["doc_id"], r["text"]): r for r in language.identify(docs.withColumnRenamed("row", "score"), language.fit(docs)).collect()}
    assert got[2, None]["lang_pred"] == got[None, ""]["lang_pred"] == got[3, "12345 !!!"]["lang_pred"] == "und"
    assert got[1, "One two three.\nFour  five"]["lang_pred"] == "en"
    assert language.identified_documents(docs.limit(0)).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [r["lang_pred"] for r in language.identified_documents(unlabelled).collect()] == ["und"]
