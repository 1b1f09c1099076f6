"""The registered queries and the whole pipeline on a small folder with odd rows, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = {"en": "the of and to in was that heron thwhou onand ereti ingles streat ouble wherst".split(), "de": "der die und zu in war das reiher schwung ungen lichkeit strasse doppelt einst wurst".split()}
WHITE = " \t\n\x0b\x0c\r"


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang] + [""] * 9) for _ in range(n))


@pytest.fixture(scope="module")
def documents():
    rng, rows = random.Random(17), []

    def put(text, lang="en", source="s0"):
        rows.append((len(rows), text, lang, source))

    for k in range(60):
        lang = ("en", "de")[k % 2]
        put("\n".join(prose(rng, rng.randint(5, 40), lang) for _ in range(3)), lang if k % 7 else None, f"s{k % 5}" if k % 6 else None)
    for size in (2, 9, 10, 30):
        text = "\n".join(prose(rng, 40) for _ in range(3))
        for k in range(size):
            put(text, "en", f"s{k % 3}")
    base = prose(rng, 150).split()
    for k in range(8):
        put(" ".join(base[:k] + ["changed"] + base[k + 1 :]), "en", "s1")
    for odd in (None, "", " \n ", "123 456", "a", "é ́ 日本 🙂", 'password: "hunter22xx" AKIA' + "Z" * 16 + " " + "0f" * 13, prose(rng, 4000)):
        put(odd, "en", "s2")
    rows.append(rows[5])  # a row that is there twice
    return rows


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(*r, None if r[1] is None else len(r[1])) for r in documents]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(4)
    vectors = [(k, rng.normal(size=8).tolist(), 0) for k in range(400)]
    for k in (50, 51, 52):
        vectors[k] = (k, vectors[7][1], 0)
    vectors += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [None] * 8, 0), (404, [float("inf")] + [0.0] * 7, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_secret_scans(spark, folder, documents):
    from tidemark.llm import queries

    base = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in queries.op1_secret_scans(spark, folder).collect())
    want = Counter()
    for i, text, *_ in documents:
        spans = sorted((m.start(), k, m.end()) for k, (_, rule, group, least) in enumerate(base) for m in rule.finditer(text or "") if len(m[group]) >= least)
        listed = ",".join(f"{base[k][0]}:{a}:{b}" for a, k, b in spans)
        counts = Counter(k for _, k, _ in spans)
        want[i, counts[0], counts[1], counts[2], hashlib.sha256(listed.encode()).hexdigest()] += 1
    assert got == want and any(key[1] and key[2] and key[3] for key in want)


def test_sentencepiece(spark, folder, documents):
    import sentencepiece

    from tidemark.llm import queries

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for i, text, *_ in documents:
        ids = sp.encode(text or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))] += 1
    assert Counter(tuple(r)[:4] for r in queries.op2_sentencepiece(spark, folder).collect()) == want


def test_near_duplicates(spark, folder, documents):
    from tidemark.llm import queries
    from test_llm_operators import brute_components

    want = brute_components([(i, t) for i, t, *_ in documents], 2, 80)
    got = queries.op4_near_duplicates(spark, folder).collect()
    assert len(got) == len(documents)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def test_language(spark, folder, documents):
    from tidemark.llm import queries

    truth = {i: lang for i, text, lang, _ in documents if lang and text and len(text) > 60}
    got = {r["doc_id"]: r for r in queries.op5_language(spark, folder).collect()}
    letters = {i: any(c.isalpha() for c in t or "") for i, t, *_ in documents}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not letters[i]) and (letters[i] or r["score"] == 0)
    assert all(got[i]["lang_pred"] == lang for i, lang in truth.items())


def test_language_sums_are_those_of_the_words(spark, folder, documents):
    """Brute force: each word's known or backed-off log frequencies, summed by text; ties go to the first language by name."""
    import pyarrow as pa

    from tidemark.llm import lang_id

    model = lang_id.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    texts = [t or "" for _, t, *_ in documents]
    langs, scores = model.predict(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores):
        words = re.findall(r"[^\W\d_]+", text.lower())
        sums = [math.fsum(model.word(w)[k] for w in words) for k in range(len(model.langs))]
        if not words:
            assert (lang, score) == ("und", 0.0)
        else:
            assert lang == model.langs[sums.index(max(sums))]
            assert score == pytest.approx(1 / math.fsum(math.exp(max(s - max(sums), -700)) for s in sums), abs=1e-6)
    tied = lang_id.Model(["aa", "bb"], {"x": (-1.0, -1.0)}, {n: {} for n in range(1, 5)})
    assert tied.predict(pa.array(["x x"]))[0] == ["aa"]
    odd = spark.createDataFrame([("x y", 1, "old")], "text string, score int, lang_pred string")
    assert lang_id.identify(odd, tied).collect()[0]["lang_pred"] == "aa"


def test_nearest(spark, folder):
    from tidemark.llm import queries

    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 400").collect()}
    got = {}
    for r in queries.op7_nearest(spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in rows if i % 50 == 0}
    hits = total = 0
    for q, found in got.items():
        exact = sorted((-float(v @ rows[q]) / float(np.linalg.norm(v) * np.linalg.norm(rows[q])), i) for i, v in rows.items() if i != q)[:5]
        found.sort()
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(float(rows[i] @ rows[q]) / float(np.linalg.norm(rows[i]) * np.linalg.norm(rows[q])), abs=1e-12)
        hits += len({i for _, i in exact} & {i for _, i, _ in found})
        total += 5
    assert hits / total >= 0.9
    same = [(i, s) for _, i, s in got[50] if i in (7, 51, 52)]
    assert [i for i, _ in same] == [7, 51, 52] and len({s for _, s in same}) == 1  # equal vectors tie, smaller ids first


def test_exact_top_k_refuses_what_is_no_exact_number(spark):
    from pyspark.sql import functions as F

    from tidemark.llm import pivot_topk

    df = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="whole numbers"):
        pivot_topk.search(df, F.col("vec_id") == 0)
    again = spark.createDataFrame([(0, [1.0, 1.0], "x", 1), (0, [1.0, 1.0], "y", 2), (1, [1.0, 2.0], "z", 3)], "vec_id long, embedding array<double>, pivot string, distance int")
    assert [(r["query_id"], r["vec_id"]) for r in pivot_topk.search(again, F.col("vec_id") == 1, k=2).collect()] == [(1, 0)]
    assert pivot_topk.search(again.limit(0), F.col("vec_id") == 1).count() == 0


def test_near_duplicates_without_ids_and_on_several_rows(spark):
    from tidemark.llm import near_dup

    rng = random.Random(3)
    a, b = prose(rng, 50), prose(rng, 50)
    df = spark.createDataFrame([(None, a), (1, a), (2, b), (1, b), (3, None), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.find(df).collect()), key=str)
    assert got == sorted([(None, None, False), (None, None, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)], key=str)
    assert near_dup.dedup(df).count() == 5 and near_dup.find(df.limit(0)).count() == 0


@pytest.mark.parametrize("errors", [4.5, None])
def test_ids_on_several_rows_with_different_texts_lose_no_link(spark, errors):
    """Each of 30 ids has two texts, and each text a near copy of its own; some texts stand under several ids."""
    from tidemark.llm import near_dup

    rng, rows, parent = random.Random(11), [], {}
    for k in range(30):
        for half in (0, 1):
            words = prose(rng, 60).split()
            rows += [(k, " ".join(words)), (1000 + 2 * k + half, " ".join(words[:-1] + ["changed"]))]
            parent[1000 + 2 * k + half] = k
    rows += [(7, rows[0][1]), (200, rows[0][1]), (200, prose(rng, 50)), (300, prose(rng, 50))]
    want = {i: 0 if p in (0, 7) else p for i, p in {**parent, **{k: k for k in range(30)}, 200: 0, 300: 300}.items()}
    rng.shuffle(rows)
    found = near_dup.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2, 80, errors=errors).collect()
    assert len(found) == len(rows) and {(r["doc_id"], r["component_id"]) for r in found} == set(want.items())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_links_near_the_threshold_are_not_lost(spark):
    """Pairs of sets of equal and unequal sizes at just 0.80 and somewhat above: none is lost by bands or sketches."""
    from tidemark.llm import near_dup

    rng, rows, pairs = random.Random(8), [], []
    word = iter(range(10**9))
    for n in range(700):
        size = rng.randint(12, 400)
        grow = rng.choice([0, 0, 1, 2])  # the second text may be longer
        shared = [f"w{next(word)}" for _ in range(size)]
        extra = int(size * (1 / 0.8 - 1)) if grow else 0
        first = " ".join(shared)
        second = " ".join(shared + [f"w{next(word)}" for _ in range(extra)]) if grow else " ".join(shared[:-1] + [f"w{next(word)}"])
        a, b = len(rows), len(rows) + 1
        rows += [(a, first), (b, second)]
        x, y = ({tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for t in (first, second))
        if 100 * len(x & y) >= 80 * len(x | y):
            pairs.append((a, b))
    found = {r["doc_id"]: r["component_id"] for r in near_dup.find(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert len(pairs) > 500 and all(found[b] == a for a, b in pairs)


def brute_pipeline(spark, rows):
    """The pipeline's rows by plain loops: (doc_id, ids, decoded), counted."""
    import sentencepiece

    import corpus_pipeline as C
    from tidemark.llm import lang_id
    from test_llm_operators import brute_components

    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = []
    for r in rows:
        words = re.findall(r"[^\W\d_]+", (r[1] or "").lower())
        sums = [math.fsum(model.word(w)[k] for w in words) for k in range(len(model.langs))]
        if words and 1 / math.fsum(math.exp(max(s - max(sums), -700)) for s in sums) >= C.CLEAR:
            kept.append(r)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))
    seen = {}
    for n, r in enumerate(kept):
        for line, text in enumerate((r[1] or "").split("\n")):
            if key(text):
                seen.setdefault(key(text), {}).setdefault(n, (r[0], line))
    first = {k: min(v.values()) for k, v in seen.items() if len(v) >= C.LINE_DOCUMENTS}
    lines = []
    for r in kept:
        parts = [x for n, x in enumerate((r[1] or "").split("\n")) if key(x) not in first or first[key(x)] == (r[0], n)]
        lines.append((r[0], "\n".join(parts), *r[2:]))
    roots = brute_components([(r[0], r[1]) for r in lines], C.SHINGLE, C.PERCENT)
    single = [r for r in lines if roots[r[0]][1] == r[0]]
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in single]
    sources = sorted({r[3] for r in single}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for r, n in zip(single, sizes) if r[3] == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    target, cut, rest = {}, True, set(sources)
    left = sum(total.values())
    while cut:
        share = {s: weight[s] * left / sum(weight[x] for x in rest) for s in rest}
        cut = [s for s in rest if share[s] > 3 * total[s]]
        for s in cut:
            target[s] = 3.0 * total[s]
            left -= target[s]
            rest.discard(s)
    target |= {s: share[s] for s in rest}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = Counter()
    for s in sources:
        start, rounds = 0, int(target[s] // total[s]) if total[s] else 0
        over = target[s] - rounds * total[s]
        mine = sorted((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], n, r[1]) for r, n in zip(single, sizes) if r[3] == s)
        for _, doc, n, text in mine:
            copies = (rounds + (2 * start + n < 2 * over)) if n else 0
            start += n
            ids = sp.encode(text)
            out[doc, tuple(ids), sp.decode(ids)] += copies
    return +out


def test_the_pipeline_is_what_plain_loops_give(spark, documents, tmp_path):
    import corpus_pipeline

    rows = documents[:-1]  # the row that is there twice has a test of its own below
    table = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute_pipeline(spark, rows)


def test_the_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm import common

    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, bucket int"
    rows = [(None, "the heron and the heron", None, None, 3, "x", 1), (1, None, None, None, None, None, None), (1, "", "en", "s", 0, None, 1), (2, "der reiher und die wurst", "de", "t", 4, "y", 2), (2, "der reiher und die wurst", "de", "t", 4, "y", 2), (3, "the " * 3000, "en", "s", 9, "z", 3)]
    for name, some in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(some, schema)
        for k, (stage, function) in enumerate(corpus_pipeline.STAGES):
            after = common.staged(function(spark, docs, str(tmp_path)), "odd-stage")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == docs.columns, stage
            docs = after
        found = sorted({(r["doc_id"], r["decoded"]) for r in docs.collect()}, key=str)
        assert found == ([] if name == "none" else sorted([(None, "the heron and the heron"), (2, "der reiher und die wurst"), (3, "the " * 3000)], key=str))
