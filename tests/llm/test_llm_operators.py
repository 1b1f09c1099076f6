"""Each operator on small tables with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the of and to in was that heron thwhou onand ereti ingles streat ouble wherst".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS + [""] * 9) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [None, "", " ", "a", "  two  words ", "\n\n x\n", "é ́ 日本 🙂 \x00", prose(rng, 6000), "AKIA" + "A" * 20 + " password = 'hunter22xx' " + "0a" * 14]
    base = prose(rng, 120)
    for k in range(12):
        words = base.split()
        words[k * 7] = f"changed{k}"
        rows.append(" ".join(words))
    rows += [base, base, base.upper(), prose(rng, 60) + "\ncommon line here\n" + prose(rng, 30), "Common LINE here \t\n", "common line here"]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None, "clash") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_dropped string")


EMPTY = "doc_id long, text string, lang string, source string"


def test_trigram_queries_hold_for_every_match():
    from tidemark.llm.secret_scan import BASE, MORE, SPELLED, trigram_query, trigrams_of

    assert trigram_query("[0-9a-f]+") is True
    assert trigrams_of(trigram_query("abcd")) == {0x616263, 0x626364}
    assert trigram_query("(abc|x*)") is True
    assert trigram_query("abc|def") == ("or", (0x616263, 0x646566))
    assert SPELLED and all(trigram_query(r.pattern, r.flags) is not True for r in BASE[:2] + MORE)


def test_secret_scan(spark, docs, texts):
    from tidemark.llm import secret_scan

    rules = secret_scan.BASE + secret_scan.MORE
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in secret_scan.scan(docs).collect()}
    for i, t in texts:
        want = sorted(((a, k, b) for k, r in enumerate(rules) for a, b in r.spans(t or "")))
        assert got[i] == [(rules[k].kind, a, b) for a, k, b in want]
    assert len(got[8]) == 3
    assert secret_scan.scan(spark.createDataFrame([], EMPTY)).count() == 0


def test_sentencepiece(spark, docs, texts):
    import sentencepiece

    from tidemark.llm import sentencepiece_codec as codec

    model = codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for r in codec.decode(codec.encode(docs, model), model).collect():
        ids = sp.encode(texts[r["doc_id"]][1] or "")
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids)
    table, rng = codec.table_of(model), random.Random(2)
    pieces = list(table.id)
    many = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(3000)] + [" " * 70 + "x", "\x1f a", "▁▁a  b", "~\x7f"]
    for text in many:
        assert table.encode(text) == sp.encode(text)
    import pyarrow as pa

    assert table.encode_many(pa.array(many)).to_pylist() == sp.encode(many)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(1, 12))]
        assert table.decode(ids) == sp.decode(ids)
    assert codec.encode(spark.createDataFrame([], EMPTY), model).count() == 0


def test_token_files(spark, docs, texts):
    from tokenizers import Tokenizer

    from tidemark.llm import token_files

    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tokenizer, start = Tokenizer.from_str(spec), 0
    odd = [(100, "Ab. C, d.e İ. it's <|endoftext|> B."), (101, None)]
    frames = token_files.write(docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")), spec, end=1)
    got = {r["doc_id"]: r for r in token_files.read(frames).collect()}
    for i, t in texts + odd:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert zlib.crc32(bytes(got[i]["ids"])) == zlib.crc32(raw)
        start += len(ids)
    assert token_files.read(token_files.write(spark.createDataFrame([], EMPTY), spec, end=1)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 5000])
def test_token_blocks_round_trip_and_notice_damage(n):
    from tidemark.llm import token_files

    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), np.full(n, 65535), np.arange(n) % 7, np.minimum(rng.zipf(1.3, n), 49000)):
        frame = token_files.write_frame([3, None], np.array([n, 0]), ids)
        found, lengths, back = token_files.read_frame(frame)
        assert found == [3, None] and lengths.tolist() == [n, 0] and (back == ids).all()
    if n > 2000:
        damaged = bytearray(frame)
        damaged[-n // 8 - 40] ^= 8
        with pytest.raises(ValueError):
            token_files.read_frame(bytes(damaged))


@pytest.mark.parametrize("odd", [1 << 32, -1])
def test_token_files_refuse_ids_that_do_not_fit(odd):
    from tidemark.llm import token_files

    with pytest.raises(ValueError):
        token_files.write_frame([1], np.array([2]), np.array([7, odd]))


def brute_components(rows, shingle, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("shingle", [2])
def test_near_duplicates(spark, texts, shingle):
    from tidemark.llm import near_dup

    rng, rows = random.Random(3), list(texts)
    base = prose(rng, 150).split()
    for k in range(60):  # a family on both sides of the threshold
        words = list(base)
        for _ in range(rng.randint(2, 14)):
            words[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(words)))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.find(df, shingle, 80).collect()}
    assert got == brute_components(rows, shingle, 80)


def test_near_duplicates_of_an_empty_table(spark):
    from tidemark.llm import near_dup

    assert near_dup.find(spark.createDataFrame([], EMPTY)).count() == 0


def test_odd_sketches_tell_the_threshold():
    from tidemark.llm import near_dup

    rng = np.random.default_rng(1)
    for similarity, passes in ((0.67, False), (0.82, True), (1.0, True)):
        shared = int(similarity * 800)
        values = np.unique(rng.integers(0, 2**63, 800).astype(np.uint64))
        a, b = values[: (800 + shared) // 2], np.concatenate([values[:shared], values[(800 + shared) // 2 :]])
        sketches = near_dup.odd_sketches(near_dup.min_hashes(np.concatenate([a, b]), np.array([len(a), len(b)]), near_dup.WIDE_SAMPLE), near_dup.WIDE_BITS)
        apart = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        assert (apart <= near_dup.most_odd_bits(0.8, near_dup.WIDE_SAMPLE, near_dup.WIDE_BITS)) == passes


def test_language(spark):
    from tidemark.llm import lang_id

    rng = random.Random(9)
    own = {"aa": "ka lo mi ru".split(), "bb": "ßen für und ich".split()}
    rows = [(i, " ".join(rng.choice(own[lang]) + rng.choice(own[lang] + [""]) for _ in range(30)), lang) for i in range(60) for lang in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df)
    tests = [(1, "kalo mi"), (2, "fürund ichßen"), (3, None), (4, "12 34 !"), (5, ""), (6, "lorumika " * 4000), (6, "ka")]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in lang_id.identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()]
    assert [x[1] for x in sorted(got, key=lambda x: x[0])] == ["aa", "bb", "und", "und", "und", "aa", "aa"]
    assert all(0 <= x[2] <= 1 for x in got)
    nothing = lang_id.fit(df.where("lang = 'zz'"))
    assert {r["lang_pred"] for r in lang_id.identify(df, nothing).collect()} == {"und"}


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for n, (_, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            seen.setdefault(k, set()).add(n)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(seen[key(x)]) >= least)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
@pytest.mark.parametrize("bits", [1 << 30, 1 << 16])
def test_line_dedup(spark, docs, texts, broadcast_keys, bits):
    from tidemark.llm import line_dedup

    found = line_dedup.dedup(docs, min_docs=3, keep_first=False, broadcast_keys=broadcast_keys, most_bits=bits)
    assert found.columns[:2] == ["doc_id", "text"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in found.collect()), key=str) == brute_lines(texts, 3)


def test_line_dedup_keeps_the_first(spark):
    from tidemark.llm import line_dedup

    df = spark.createDataFrame([(1, "x\nsame"), (2, "Same \ny\nsame"), (3, None)], "doc_id long, text string")
    for keys in (100, 0):
        got = {r["doc_id"]: r["text"] or "" for r in line_dedup.dedup(df, broadcast_keys=keys).collect()}
        assert got == {1: "x\nsame", 2: "y", 3: ""}
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(1500, 16)).tolist()
    vecs[7], vecs[8], vecs[9], vecs[10], vecs[11] = None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 3
    vecs[20:40] = [vecs[100]] * 20
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, rank string"), vecs


def test_permutation_search_recall_and_ties(spark, embeddings):
    from pyspark.sql import functions as F

    from tidemark.llm import permutation_ann

    df, vecs = embeddings
    got = {}
    for r in permutation_ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fit = [i for i, v in enumerate(vecs) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    m = np.array([vecs[i] for i in fit])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    right = total = 0
    for q in [i for i in fit if i % 50 == 0]:
        s = m @ m[fit.index(q)]
        want = sorted((round(-x, 9), i) for x, i in zip(s, fit) if i != q)[:5]
        right += len({i for _, i in want} & {v for _, v, _ in got[q]})
        total += 5
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
    assert right / total >= 0.9
    assert {v for _, v, _ in got[100]} == {20, 21, 22, 23, 24}  # equal scores go to smaller ids
    assert permutation_ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("scale", [256, 10**8])
def test_exact_topk(spark, embeddings, scale):
    from pyspark.sql import functions as F

    from tidemark.llm import pivot_topk

    df, vecs = embeddings
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in pivot_topk.search(df, F.col("vec_id") % 50 == 0, scale=scale).collect()}
    whole = {i: [int(np.floor(scale * x)) for x in v] for i, v in enumerate(vecs) if v and None not in v and np.isfinite(v).all()}
    for q in [i for i in whole if i % 50 == 0]:
        want = sorted((-sum(a * b for a, b in zip(v, whole[q])), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in want]
    assert pivot_topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_html(spark):
    from tidemark.llm import html_extract

    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>'
        '<div class="cookie-notice">We use cookies so that this notice can be as long as a paragraph of the article would be</div>'
        "<article><h1>A  head</h1><p>First &amp; best<br>line a &lt; b 3 < 4 of this &eacute;t&#233; text.<p>Two.</p>"
        '<div class="comments"><p>I like this very much and write a long comment about it here</p></div></article>'
        "<form>Your mail <input></form><aside>Other things</aside><footer>&copy; all</footer></body>"
    )
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>no end <b"), (4, "u", "plain words only"), (5, "u", "<article>" + "<p>word " * 20000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert got[0]["text"] == "A head\nFirst & best line a < b 3 < 4 of this été text.\nTwo." and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == got[2]["text"] == "" and len(got) == 6
    assert got[5]["text"] == "\n".join(["word"] * 20000)
    x, y = html_extract.labelled()
    tree = html_extract.fit_tree(x, y)
    assert np.mean([html_extract.classify(tree, r) == bool(v) for r, v in zip(x.tolist(), y)]) > 0.95
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("tag", ["<svg-icon>", "<video-player src=x></video-player>", '<svg viewBox="0 0 1 1"/>', "<MATH />", "<svg><title>no</title></svg>"])
def test_html_goes_on_after_what_is_no_silent_element(tag):
    from tidemark.llm import html_extract

    blocks = html_extract.blocks_of(f"<p>one</p>{tag}<p>two</p><p>three</p>")
    assert [b[0] for b in blocks] == ["one", "two", "three"]


def test_mix(spark, docs, texts):
    from tidemark.llm import curriculum_mix

    rows = curriculum_mix.mix(docs).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts}
    by_source = {}
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] == r["size"] * len(r["positions"]) <= 3 * r["size"]
        assert list(r["positions"]) == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        by_source.setdefault(r["source"], []).append(r)
    assert abs(sum(x[0]["target"] for x in by_source.values()) - sum(sizes.values())) < 1e-6
    for found in by_source.values():
        assert found[0]["target"] <= 3 * found[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= max(r["size"] for r in found)
    again = {r["doc_id"]: (r["taken"], tuple(r["positions"])) for r in curriculum_mix.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: (r["taken"], tuple(r["positions"])) for r in rows}
    for most in (1000, 0):  # totals joined by broadcast and by shuffle
        order = curriculum_mix.training_order(docs, broadcast_rows=most)
        taken = {r["doc_id"]: r["count"] for r in order.groupBy("doc_id").count().collect()}
        assert order.columns == docs.columns and taken == {r["doc_id"]: len(r["positions"]) for r in rows if r["positions"]}
    assert curriculum_mix.mix(spark.createDataFrame([], EMPTY)).count() == 0


def test_training_order_follows_positions_and_takes_any_columns(spark):
    from tidemark.llm import curriculum_mix

    rng = random.Random(2)
    rows = [(k, prose(rng, rng.randint(0, 12)) or None, f"s{k % 4}" if k % 5 else None, k, "c") for k in range(600)] + [(None, "no id here", "s1", 0, "c"), (7, "again", "s3", 7, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _position long, row string")
    got = curriculum_mix.training_order(df).collect()
    assert got[0].__fields__ == df.columns and {r["row"] for r in got} == {"c"}
    first = {}
    for n, r in enumerate(got):
        first.setdefault(r["doc_id"], n)
    exact = {r["doc_id"]: r["positions"][0] for r in curriculum_mix.mix(df).collect() if r["positions"] and r["doc_id"] not in (None, 7)}
    order = sorted(exact, key=exact.get)
    far = [abs(first[d] - n * len(got) / len(order)) for n, d in enumerate(order)]
    assert sum(far) / len(far) < len(got) / 6
    empty = spark.createDataFrame([], EMPTY)
    assert curriculum_mix.training_order(empty).count() == 0


def test_positions_follow_the_schedule(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.curriculum_mix import LATE, position_of

    shares = [x / 20 for x in range(21)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in shares], "s double").select(position_of(F.col("s"), LATE)).collect()]
    grid = np.linspace(0, 1, 20001)
    weight = np.interp(grid, [t for t, _ in LATE], [w for _, w in LATE])
    demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    assert np.allclose(got, np.interp(shares, demand / demand[-1], grid), atol=1e-3)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.001")
        assert after.columns == docs.columns, name
        from tidemark.llm import common

        before = common.staged(after, "test-stage")
    rows = corpus_pipeline.STAGES[-1][1](spark, before, "/root/testdata/sf0.001").collect()
    assert len(rows) == before.count() > 0
    texts = {}
    for r in before.collect():
        texts.setdefault(r["doc_id"], set()).add(hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert all(hashlib.sha256(r["decoded"].encode()).hexdigest() in texts[r["doc_id"]] for r in rows)
    near = brute_components([(r["doc_id"], r["text"]) for r in before.dropDuplicates(["doc_id"]).collect()], 5, 80)
    assert all(root == i for i, (n, root) in near.items())


def test_pipeline_keeps_one_of_many_copies(spark):
    import corpus_pipeline

    rng, rows, groups = random.Random(11), [], {}
    for size in (2, 9, 10, 30):
        text = "\n".join(prose(rng, 40) for _ in range(3))
        groups[size] = text, range(len(rows), len(rows) + size)
        rows += [(len(rows) + k, text, "en", f"s{k % 3}", len(text)) for k in range(size)]
    docs = spark.createDataFrame(rows, EMPTY + ", n_chars long")
    lines = {r["doc_id"]: r for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert len(lines) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_lines(spark, docs, ""), "").collect()}
    for size, (text, ids) in groups.items():
        assert [lines[i]["text"] for i in ids] == ([text] * size if size < 10 else [text] + [""] * (size - 1))
        assert [left[i] for i in ids if left.get(i)] == [text]
