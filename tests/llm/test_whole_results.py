"""Results that an earlier state of the code left incomplete, against hand-made cases and brute force."""

import random
import re

import pytest

import corpus_pipeline
from millrace.llm import lines, similar, spans

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], COLUMNS)


# near-duplicates


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def pair_at(rng, wanted):
    """Two texts of 404 words, scattered words of the second replaced until the similarity is under `wanted`, at best equal to it."""
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(404)]
    a, order = " ".join(words), rng.sample(range(404), 404)
    b = a
    for k in order:
        words[k] = "x" + words[k]
        if similarity(a, " ".join(words)) < wanted:
            words[k] = words[k][1:]
            continue
        b = " ".join(words)
        if similarity(a, b) - wanted < 0.002:
            break
    return a, b


@pytest.mark.parametrize(("wanted", "linked"), [(0.78, False), (0.80, True), (0.85, True), (0.90, True)])
def test_near_dedup_draws_the_line_at_its_similarity(spark, wanted, linked):
    rng = random.Random(int(wanted * 100))
    pairs = [pair_at(rng, wanted) for _ in range(40)]
    assert all(wanted <= similarity(a, b) < wanted + 0.01 for a, b in pairs)
    docs = documents(spark, [(i, t) for k, (a, b) in enumerate(pairs) for i, t in ((k, a), (100 + k, b))])
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(range(40)) | (set() if linked else set(range(100, 140)))


def test_similar_components_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(8):  # groups around a centre: some members are linked only by way of others
        words = ["".join(rng.choices("abcd", k=6)) for _ in range(150)]
        for _ in range(12):
            w = list(words)
            for k in rng.sample(range(150), rng.randrange(1, 8)):
                w[k] = "y" + str(rng.random())
            texts.append(" ".join(w))
    texts += ["", None, "one two", "ONE  two", texts[0].upper()]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity((texts[i] or "").lower(), (texts[j] or "").lower()) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = similar.without_similar(documents(spark, enumerate(texts)).coalesce(1)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(root)) and 8 < len(set(root)) < 100
    assert similar.without_similar(documents(spark, enumerate(texts)).limit(0)).count() == 0


# sentence spans


def every_run(docs, least, words):
    """All runs of consecutive sentences that are long enough, or a whole shorter text."""
    seen, out = {}, []
    for doc, text in docs:
        parts = spans.sentences(text)
        w = [re.findall(r"\w+", text[a:b].lower()) for a, b in parts]
        said, gone = [k for k in range(len(parts)) if w[k]], set()
        ranges = [(x, y) for x in range(len(said)) for y in range(x + least, len(said) + 1) if sum(len(w[k]) for k in said[x:y]) >= words]
        for x, y in ranges or [(0, len(said))] * bool(said):
            key = tuple(tuple(w[k]) for k in said[x:y])
            if seen.setdefault(key, (doc, x)) != (doc, x):
                gone |= set(range(said[x], said[y - 1] + 1))
        out.append((doc, "".join(text[a:b] for k, (a, b) in enumerate(parts) if k not in gone)))
    return out


def test_spans_cover_every_repeated_run(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 5, 9, 15, 30]))) + ". " for _ in range(12)]
    tail = " ".join(["long"] * 30) + ". five more words are here. and five others end it."
    texts = ["Start. " + tail, "Other. " + tail, "Short text.", "short TEXT", "", "$$$"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    got = spans.deduped_documents(documents(spark, enumerate(texts))).collect()
    want = dict(every_run(enumerate(texts), 2, 20))
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert want[1] == "Other. " and want[3] == ""


# lines


def test_short_repeated_lines_go(spark):
    texts = ["And ornd.\n\nfirst", "second\n\nAnd ornd.", "}\nthird\n\n}", "\n\n", "\n\n", "a\n\nb\n\nc", "x\n\nb\n\nc\ny"]
    got = {r["doc_id"]: r["text"] for r in lines.deduped_documents(documents(spark, enumerate(texts))).collect()}
    assert got == {0: "And ornd.\n\nfirst", 1: "second\n", 2: "}\nthird\n", 3: "\n\n", 4: "\n\n", 5: "a\n\nb\n\nc", 6: "x\ny"}
    kept = corpus_pipeline.line_dedup(spark, documents(spark, [(1, "And ornd.\none"), (2, "two\nAnd ornd.")]), "").collect()
    assert sorted(r["text"] for r in kept) == ["And ornd.\none", "two"]


# pipeline


def test_language_stage_keeps_documents_when_nothing_can_be_learned(spark):
    docs = spark.createDataFrame([(1, "Some clean text.", None, "s", 16), (2, "1 2 3", None, "s", 5), (3, None, None, "s", 0)], COLUMNS)
    assert [(r["doc_id"], r["lang"]) for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [(1, None)]


def test_stages_on_odd_rows(spark, sf):
    """Nulls, repeats, empty tables and columns of other names in every stage; none but those of documents come out."""
    columns = "doc_id bigint, text string, lang string, source string, removed string, fp int, component_id string, leaks int, node int, start int"
    rows = [(1, "Some clean text of its own.\nAnd a line.", "en"), (1, "Some clean text of its own.\nAnd a line.", "en"), (2, None, None), (None, "", "fr"), (None, None, None), (3, "\n\n", None), (4, "word other " * 30_000, "en"), (5, "Quite another text.", "en")]
    docs = spark.createDataFrame([(*r, "s", "x", 1, "c", 2, 3, 4) for r in rows], columns)
    kept = {"language_id": 4, "line_dedup": 7, "near_dedup": 4, "decontamination": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name == "packing":
            assert sum(r["start"] == 0 for r in got) == 8
            continue
        assert out.columns == ["doc_id", "text", "lang", "source"] and len(got) == kept[name], (name, got)
