"""Personal data, spans, near-duplicates, lines, decontamination and the pipeline, against brute force on small inputs."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import decontaminate, lines, pii, simhash, spans

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, removed string, fp int, leaks int, spans int"


def odd(spark):
    rows = [
        (1, "Same line that repeats here.\nshort\nSame line that repeats here.", "en"),
        (1, "Same line that repeats here.\nshort\nSame line that repeats here.", "en"),
        (2, None, None),
        (None, "", "fr"),
        (None, None, None),
        (3, "\n\n", None),
        (4, "word " * 30_000, "en"),
        (5, "a@b.co 1.2.3.4 +1 (415) 555-0100", "en"),
    ]
    return spark.createDataFrame([(*r, "s", 1, "x", 1, 2, 3) for r in rows], DOCS)


def empty(spark):
    return odd(spark).limit(0)


# personal data


def plain_rules(s):
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda v: (v[0], v[2]))


def test_rules_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        s = "".join(rng.choice("a1.@+- (5-90)b") for _ in range(60))
        assert pii.base_spans(s) == plain_rules(s)
    assert pii.base_spans("1" * 100_000 + "@" + "a." * 50_000) is not None  # in linear time


def test_tagger_gradients():
    m = pii.Tagger(hidden=4)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 100, (3, 12)).astype(np.int16), rng.integers(0, pii.TAGS, (3, 12)).astype(np.int8)
    _, grads = m.gradients(x, y)
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        at, e = m.p[k][i], 1e-3
        m.p[k][i] = at + e
        up = m.gradients(x, y)[0]
        m.p[k][i] = at - e
        down = m.gradients(x, y)[0]
        m.p[k][i] = at
        assert abs((up - down) / (2 * e) - g[i]) < 0.02 * abs(g[i]) + 1e-3, k


def test_paths_and_their_sum_equal_enumeration():
    m = pii.Tagger(hidden=3)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    m.p["t"] = np.random.default_rng(3).normal(size=m.p["t"].shape)
    x = np.random.default_rng(4).integers(0, 100, (2, 4)).astype(np.int16)
    e = m.emissions(x)[0]
    for row, path in enumerate(m.decode(x)):
        paths = list(itertools.product(range(pii.TAGS), repeat=4))
        scores = np.array([sum(e[t, row, y] for t, y in enumerate(p)) + sum(m.p["t"][a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert tuple(path.tolist()) == paths[int(scores.argmax())]
        y = np.array([paths[7]], dtype=np.int8)
        loss, _ = m.gradients(x[row : row + 1], y)
        assert abs(loss - (np.log(np.exp(scores - scores.max()).sum()) + scores.max() - scores[7])) < 1e-6


def test_reconciling_is_not_quadratic_and_keeps_the_first(spark):
    text = "(415) 555-0100 " * 20_000
    found = [(k, k + 14, 3) for k in range(0, len(text), 15)]
    start = time.time()
    assert len(pii.reconciled(text, [], found)) == 20_000 and time.time() - start < 5
    assert pii.reconciled("1.2.3.4 5", [(0, 7, 1)], [(2, 9, 3)]) == [(0, 7, 1)]


def test_very_long_texts_are_read_in_slices():
    text = "call +1 (415) 555-0100 or x@y.org now, please; " * 6000
    got = list(pii.answers(["a@b.co", text, "", None, "1.2.3.4"], pii.Tagger()))
    assert len(got) == 5 and len(pii.starts_of(pii.characters(text))) > 2048
    for t, (base, spans) in zip(["a@b.co", text, "", "", "1.2.3.4"], got):
        assert base == pii.base_spans(t) and set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (x[0], x[2]))


def test_network_finds_forms_that_the_rules_do_not_know():
    """Held-out made-up values: the rules know none of them, the network most."""
    prose = ["The ship was at sea for a long time and nobody came to see it again.", "Call or write to us when you have an hour to spare, please."]
    x, y = pii.generated(prose, 700, seed=3)
    m = pii.Tagger()
    m.fit(x, y)
    rng, hit, wrong, total = np.random.default_rng(99), 0, 0, 0
    for k in range(200):
        kind = k % 4
        value = pii.made_up(rng, kind)
        text = f"{prose[k % 2][:30]} {value} {prose[k % 2][30:]}"
        base = pii.base_spans(text)
        (_, spans), at = next(iter(pii.answers([text], m))), text.index(value)
        if any(s < at + len(value) and at < e for s, e, _ in base):
            continue
        total += 1
        hit += any(kd == kind and s < at + len(value) and at < e for s, e, kd in spans)
        wrong += any(e <= at or s >= at + len(value) for s, e, _ in spans)
    assert total > 60 and hit / total > 0.6 and wrong / total < 0.05, (hit, wrong, total)


def test_windows_hold_every_trigger():
    c = pii.characters("x" * 200 + "7" + "y" * 300 + "@" + "z" * 40)
    starts, w = pii.windows(c)
    assert {200, 501} <= {s + i for s, row in zip(starts.tolist(), w.tolist()) for i, v in enumerate(row) if v in (ord("7"), ord("@"))}
    assert all(sum(s <= at < s + pii.WINDOW for s in starts) == 2 for at in (200, 501))


def test_pii_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = pii.fit(docs, sample=200, made=300)
    for frame in (docs, odd(spark)):
        text = {(r["doc_id"], r["text"]) for r in frame.collect()}
        got = pii.find(frame, model).collect()
        assert len(got) == frame.count() and {(r["doc_id"], r["text"]) for r in got} == text
        for r in got:
            base = plain_rules(r["text"] or "")
            said = pii.joined(base)
            assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, _, k in base) for j in range(4)]
            assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
    assert pii.private_documents(empty(spark)).count() == 0


# sentence spans


def brute_spans(docs, least, words):
    seen, out = set(), []
    for doc, text in docs:
        parts = spans.sentences(text)
        assert "".join(text[a:b] for a, b in parts) == text
        w = [re.findall(r"\w+", text[a:b].lower()) for a, b in parts]
        said, gone = [k for k in range(len(parts)) if w[k]], set()
        for x in range(len(said)):
            y = total = 0
            y = x
            while y < len(said) and (y - x < least or total < words):
                total += len(w[said[y]])
                y += 1
            if y - x < least or total < words:
                break
            key = tuple(tuple(w[k]) for k in said[x:y])
            if key in seen:
                gone |= set(range(said[x], said[y - 1] + 1))
            seen.add(key)
        out.append((doc, "".join(text[a:b] for k, (a, b) in enumerate(parts) if k not in gone)))
    return sorted(out)


def test_spans_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = spans.dedup_spans(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute_spans(sorted((r["doc_id"], r["text"]) for r in docs.collect()), 2, 20)
    assert any(r["n_removed"] for r in got)


def test_spans_odd_rows(spark):
    passage = "This sentence has exactly eight words in it. And here are eight more words for it. Then eight other words finish the whole passage."
    rows = [*[(r["doc_id"], r["text"]) for r in odd(spark).collect()], (8, "Intro one. " + passage), (9, "$$$ " + passage.upper() + "%%% rest")]
    got = spans.dedup_spans(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, removed string").coalesce(1)).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] in (8, 9)}
    assert by[8]["n_removed"] == 0 and by[9]["n_removed"] == 3 and "SENTENCE" not in by[9]["text"] and "rest" in by[9]["text"]
    assert len(got) == len(rows) and sum(r["text"] is None for r in got) == 2
    assert spans.deduped_documents(empty(spark)).count() == 0


# near-duplicates


def reachable(fps, budget):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize(("budget", "walks"), [(4, 3), (10, 4), (3, 1)])
def test_trie_join_misses_no_link(spark, budget, walks):
    rng = random.Random(budget)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:100]:
        for _ in range(2):
            for b in rng.sample(range(64), rng.randrange(budget + 2)):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "node bigint, fp bigint")
    edges = simhash.linked_nodes(nodes, budget, walks, block_rows=40)
    pairs = edges.collect()
    assert all((p["a"] ^ p["b"]) != 0 for p in pairs)
    roots = {r["node"]: r["root"] for r in simhash.star_components(edges).collect()}
    want, groups = reachable(fps, budget), collections.defaultdict(set)
    for k, f in enumerate(signed):
        groups[want[k]].add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_query(spark, sf):
    import xxhash

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(900, None), (901, ""), (902, "one TWO"), (903, "one two"), (None, "x")]
    got = simhash.linked_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()

    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    text = dict(rows)
    assert all(int(r["fingerprint"], 16) == fp(text[r["doc_id"]]) and len(r["fingerprint"]) == 16 for r in got)
    order = sorted((r for r in got if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    want = reachable([int(r["fingerprint"], 16) for r in order], 4)
    assert [r["component_id"] for r in order] == [order[k]["doc_id"] for k in want]
    assert next(r for r in got if r["doc_id"] == 901)["component_id"] == 900
    assert simhash.linked_documents(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    base = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400)) for _ in range(20)]
    near = [t.replace(t.split()[200], "changed", 1) for t in base]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(near)] + [(200 + i, t) for i, t in enumerate(base)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(range(20))


# lines


def brute_lines(docs, least):
    """Every run of every length is looked up; the longest with an earlier copy goes if it has `least` characters."""
    raw = [[] if t is None else t.split("\n") for _, t in docs]
    trimmed = [[x.strip(" ") for x in r] for r in raw]
    deepest, size, starts = {}, 1, [(k, p) for k, r in enumerate(raw) for p in range(len(r))]
    while starts:
        seen, met = set(), collections.Counter(tuple(trimmed[k][p : p + size]) for k, p in starts)
        for k, p in starts:
            key = tuple(trimmed[k][p : p + size])
            if key in seen:
                deepest[k, p] = size
            seen.add(key)
        starts = [(k, p) for k, p in starts if met[tuple(trimmed[k][p : p + size])] > 1 and p + size < len(raw[k])]
        size += 1
    gone = collections.defaultdict(set)
    for (k, p), n in deepest.items():
        if len("\n".join(raw[k][p : p + n])) >= least:
            gone[k] |= set(range(p, p + n))
    return sorted((str(d), str(None if t is None else "\n".join(x for i, x in enumerate(raw[k]) if i not in gone[k]))) for k, (d, t) in enumerate(docs))


def test_a_run_pieced_together_from_two_sources(spark):
    rows = [(1, "xxxxxxx\nyyyyyyy\nq"), (2, "yyyyyyy\nzzzzzzz\nr"), (3, "xxxxxxx\nyyyyyyy\nzzzzzzz\ns"), (4, "t\nxxxxxxx\nyyyyyyy\nzzzzzzz")]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), 20).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 3}


def test_lines_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = lines.dedup_lines(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == brute_lines(rows, 20)
    assert "Python" not in lines.dedup_lines(docs)._jdf.queryExecution().toString()


def test_lines_random_runs(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "bb", "a long line of text, number one", "c" * 19, "", " a"]) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == brute_lines(rows, 20)


def test_lines_odd_rows(spark):
    got = lines.dedup_lines(odd(spark)).collect()
    one = sorted((r["text"] for r in got if r["doc_id"] == 1), key=len)
    assert one == ["", "Same line that repeats here.\nshort"] and len(got) == 8
    assert all(r["n_lines"] == 0 and r["n_removed"] == 0 for r in got if r["text"] is None)
    assert lines.dedup_lines(empty(spark)).count() == 0


# rows keep their identity


def test_results_do_not_depend_on_how_the_scan_is_split(spark, tmp_path):
    line = "A line that all of these documents hold in common. And another sentence holds " + " ".join(f"w{k}" for k in range(120)) + "."
    rows = [(7, f"own line {i} {'x' * i}\n{line}\n{'tail ' * 300}", "en", "s", 9) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "d"))

    def at(most: str):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        return spark.read.parquet(str(tmp_path / "d"))

    for job in (lines.deduped_documents, spans.deduped_documents, lambda d: corpus_pipeline.near_dedup(spark, d, "")):
        built = job(at("1000000"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
        split = sorted(r["text"] for r in built.collect())
        again = sorted(r["text"] for r in job(at("1000000")).collect())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
        assert split == again
        assert sum(line in t for t in split) == 1 and len(split) in (1, 60)


# decontamination


def test_banded_alignment_equals_plain_edit_distance():
    rng = random.Random(4)
    for _ in range(60):
        part = [rng.randrange(3) + 97 for _ in range(30)]
        text = [rng.randrange(3) + 97 for _ in range(20)] + [c if rng.random() > 0.1 else 99 for c in part if rng.random() > 0.05] + [97] * 9
        row = [0] * (len(text) + 1)
        for j, c in enumerate(part, 1):
            new = [j]
            for i, d in enumerate(text, 1):
                new.append(min(row[i - 1] + (c != d), row[i] + 1, new[-1] + 1))
            row = new
        d, a, b = decontaminate.banded(np.array(text, np.uint32), [np.array(part, np.uint32)], np.array([-30]), len(text) + 40)
        assert d[0] == min(row) and 0 <= a[0] <= b[0] <= len(text)


def test_decontamination_finds_edited_passages(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    letters = decontaminate.Letters()
    norm = lambda s: "".join(map(chr, letters(s)[0])).strip()
    bench = {r["item_id"]: r["text"] for r in items.collect()}
    whole = {(r["doc_id"], i) for r in docs.collect() for i, t in bench.items() if norm(t) in norm(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_documents(docs, items).collect()}
    assert whole and whole <= got and len(got - whole) <= 1
    rng, rows = random.Random(6), []
    for n in range(60):
        item, text = rng.choice(sorted(bench.items()))
        t = list(text)
        for _ in range(int(0.03 * len(t))):
            t[rng.randrange(len(t))] = rng.choice("aeiou ")
        rows.append((n * 1000 + item, "Words before it, quite different. " + "".join(t).upper() + "\n and after."))
    found = decontaminate.leaked_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()
    text = dict(rows)
    assert {r["doc_id"] for r in found if r["doc_id"] % 1000 == r["item_id"]} == set(text)
    assert all(0 <= r["start"] < r["stop"] <= len(text[r["doc_id"]]) for r in found)


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "tiny"), (None, None), (2, ""), (3, "Same line that repeats here.")], "item_id bigint, text string")
    got = decontaminate.contaminated(odd(spark), items).collect()
    assert len(got) == 8 and {bool(r["leaks"]) for r in got if r["doc_id"] == 1} == {True} and not any(r["leaks"] for r in got if r["doc_id"] != 1)
    blocks = decontaminate.contaminated(odd(spark), items, block_chars=5).collect()
    assert sorted(str(r["leaks"]) for r in blocks) == sorted(str(r["leaks"]) for r in got)
    assert all(not r["leaks"] for r in decontaminate.contaminated(odd(spark), items.limit(0)).collect())
    assert decontaminate.contaminated(empty(spark), items).count() == 0


# pipeline


def test_pipeline_keeps_clean_documents(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in rows}
    leaks = {r["doc_id"] for r in decontaminate.leaked_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    assert not kept & leaks and len(kept) > 0.8 * len(set(first.values()) - leaks)
    assert all(sum(r["length"] for r in rows if r["doc_id"] == i) == next(r["doc_tokens"] for r in rows if r["doc_id"] == i) for i in list(kept)[:20])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
